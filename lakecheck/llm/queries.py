"""Queries of the numbered operators over the whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakecheck.llm.chat import format_chats, read_back
from lakecheck.llm.collocations import collocations
from lakecheck.llm.exact import exact_groups
from lakecheck.llm.fingerprint import fingerprints_with_edit
from lakecheck.llm.language import held_out, predict, train_on
from lakecheck.llm.lattice import lattice_scores
from lakecheck.llm.lines import drop_boilerplate
from lakecheck.llm.mixing import mixed_sizes
from lakecheck.llm.repeats import cut_repeats
from lakecheck.llm.secrets import ALL_RULES, BASE_RULES, scan_secrets, spans_by_path
from lakecheck.llm.setsketch import near_groups
from lakecheck.llm.spelling import spelling_variants
from lakecheck.llm.text import sha256_hex
from lakecheck.llm.viterbi import decode, encode

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    def add(build: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_secrets")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # the base rules first; when the others are added, the ledger leaves only these to be scanned
    first, ledger = scan_secrets(docs, "text", BASE_RULES)
    more, _ = scan_secrets(docs, "text", ALL_RULES, ledger)
    paths = spans_by_path(docs, "doc_id", "text", first.union(more), ALL_RULES)
    base = [r.kind for r in BASE_RULES]
    of = lambda kinds: F.filter("found", lambda s: s["rule"].isin(kinds))
    listed = lambda found: F.array_join(F.transform(found, lambda s: F.concat_ws(":", s["rule"], s["start"], s["end"])), ",")
    return paths.select(
        F.col("path").alias("doc_id"),
        *(F.size(of([k])).cast("long").alias(f"n_{k}") for k in base),
        sha256_hex(listed(of(base))).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
    )


@query(
    "op7_line_dedup",
    r"""
WITH pages AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
one AS (
  SELECT DISTINCT doc_id, source, regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g') AS bare
  FROM (SELECT doc_id, source, unnest(lines) AS line FROM pages)
),
often AS (
  SELECT o.source, o.bare FROM one o
  JOIN (SELECT source, count(*) AS pages FROM documents GROUP BY source) t ON o.source IS NOT DISTINCT FROM t.source
  WHERE o.bare <> '' GROUP BY o.source, o.bare, t.pages
  HAVING count(*) >= 5 AND count(*) > 0.05 * t.pages
),
marked AS (
  SELECT p.doc_id, p.pos, p.line, o.bare IS NOT NULL AS gone
  FROM (SELECT doc_id, source, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM pages) p
  LEFT JOIN often o ON o.source IS NOT DISTINCT FROM p.source
    AND o.bare = regexp_replace(p.line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')
)
SELECT doc_id, count(*) FILTER (WHERE NOT gone) AS n_lines, count(*) FILTER (WHERE gone) AS removed_lines,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS text_sha256
FROM marked GROUP BY doc_id
""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_boilerplate(table(spark, sf_dir, "documents"))
    text = F.coalesce("text", F.lit(""))
    n_lines = F.when((text == "") & (F.col("removed_lines") > 0), 0).otherwise(F.size(F.split(text, "\n")))
    return out.select("doc_id", n_lines.cast("long").alias("n_lines"), "removed_lines", sha256_hex(text).alias("text_sha256"))


@query("op8_fingerprints")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints_with_edit(table(spark, sf_dir, "documents"))


@query(
    "op10_exact_dedup",
    r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id) AS keep_id,
       count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY n DESC, doc_id) = 1 AS kept,
       sha256(norm) AS text_sha256
FROM t
""",
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


@query(
    "op2_chat_format",
    r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
marked AS (
  SELECT *, regexp_replace(text, '(<|\[)(\\*)(\|im_start\|>|\|im_end\|>|/?s>|/?INST\])', '\1\\\2\3', 'g') AS escaped FROM rows
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(24 + length(role) + length(escaped)) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
""",
)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return read_back(format_chats(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)))


@query("op3_mixing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(table(spark, sf_dir, "documents"))


@query("op6_language")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    told = predict(docs.select("doc_id", "text"), train_on(docs))
    return told.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query("op5_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


@query("op4_repeats")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = cut_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"), "kept_sha256")


@query("op9_sentencepiece")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = decode(encode(docs))
    return back.select(
        "doc_id",
        F.size("tokens").cast("long").alias("n_tokens"),
        F.xxhash64("tokens").alias("tokens_hash"),
        sha256_hex(F.coalesce("decoded", F.lit(""))).alias("text_sha256"),
        F.col("decoded").eqNullSafe(F.col("text")).alias("exact"),
    )


@query(
    "op11_collocations",
    r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
sizes AS (SELECT unnest(range(1, 6)) AS size),
counts AS (
  SELECT lang, array_to_string(w[i:i + size - 1], ' ') AS phrase, size, count(*) AS f
  FROM starts JOIN sizes ON i + size - 1 <= len(w) GROUP BY ALL HAVING count(*) >= 100
),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
cuts AS (SELECT lang, phrase, c.size, f AS a, string_split(phrase, ' ') AS w, s.size AS k FROM counts c JOIN sizes s ON s.size < c.size),
scored AS (
  SELECT x.lang, x.phrase, x.a, l.f AS l, r.f AS r, t.n, x.k, (1000::HUGEINT * x.a * t.n) // (l.f::HUGEINT * r.f) AS score
  FROM cuts x JOIN totals t ON t.lang = x.lang
  JOIN counts l ON l.lang = x.lang AND l.phrase = array_to_string(x.w[1:x.k], ' ')
  JOIN counts r ON r.lang = x.lang AND r.phrase = array_to_string(x.w[x.k + 1:], ' ')
),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[i:i + s.size - 1], ' ') AS phrase, max(f) AS around
  FROM (SELECT *, unnest(range(1, size)) AS i FROM counts) c JOIN sizes s ON s.size < c.size AND i + s.size - 1 <= c.size GROUP BY 1, 2
),
inside_last AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[size - s + 1:], ' ') AS phrase, max(f) AS around
  FROM (SELECT *, unnest(range(1, size)) AS s FROM counts) GROUP BY 1, 2
),
kept AS (
  SELECT x.* FROM lowest x
  LEFT JOIN (SELECT lang, phrase, max(around) AS around FROM (FROM inside UNION ALL FROM inside_last) GROUP BY ALL) o ON o.lang = x.lang AND o.phrase = x.phrase
  WHERE o.around IS NULL OR 100 * o.around < 100 * x.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score
FROM kept QUALIFY rank <= 2000
""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("text", "lang"))


@query("op12_lm_scores")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_scores(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(
    "op13_spelling",
    r"""
WITH RECURSIVE steps AS (
  SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b)
),
crc AS (SELECT list(v ORDER BY b) AS t FROM steps),
runs AS (
  SELECT doc_id, run, count(*) AS c FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
    FROM documents
  ) GROUP BY ALL
),
bytes AS (
  SELECT run, c, flatten([CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT)] ELSE [192 | (unicode(ch) >> 6), 128 | (unicode(ch) & 63)] END
                          FOR ch IN string_split(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || run, '')]) AS b
  FROM runs
),
hashed AS (
  SELECT run, c, xor(list_reduce([4294967295] || b, lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1])), 4294967295) AS h FROM bytes, crc
),
words AS (
  SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed
  ) GROUP BY word HAVING sum(c) >= 2 AND length(word) >= 7
),
holes AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT *, unnest(range(length(word))) AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON a.rest = b.word
),
best AS (
  SELECT word, other, other_n, count(*) OVER (PARTITION BY word) AS n_near FROM near
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1
),
forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
),
chains AS (
  SELECT word, form AS root FROM forms WHERE form IS NOT NULL
  UNION SELECT c.word, f.form FROM chains c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
),
roots AS (SELECT c.word, c.root FROM chains c JOIN forms f ON f.word = c.root WHERE f.form IS NULL)
SELECT f.word, f.form, coalesce(r.root, f.word) AS root, f.n, f.n_near, f.form_n FROM forms f LEFT JOIN roots r ON r.word = f.word
""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents").select("doc_id", "text"))
