"""Spelling variants against plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

from lakecheck.llm.queries import QUERIES
from lakecheck.llm.spelling import LEAST, near_pairs, signatures, spelling_forms, spelling_variants, word_counts
from tests.llm.data import empty, ordered, table

SF = "/root/testdata/sf0.001"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def counts(rows, every=31):
    out = Counter()
    for key, text in rows:
        for word in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = lower(word)
            h = zlib.crc32(f"{'null' if key is None else key}:{word}".encode())
            if every and h % every == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            if word:
                out[word] += 1
    return out


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def expected(words, times=10):
    holes, near = defaultdict(set), defaultdict(set)
    for w in words:
        for k in range(len(w) if len(w) < 1000 else 0):  # long ones stand alone here
            holes[k, w[:k] + w[k + 1 :]].add(w)
            if w[:k] + w[k + 1 :] in words:
                near[w].add(w[:k] + w[k + 1 :])
                near[w[:k] + w[k + 1 :]].add(w)
    for same in holes.values():
        for w in same:
            near[w] |= same - {w}
    forms = {}
    for w in words:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= times * words[w]:
            forms[w] = best

    def root(w):
        while w in forms:
            w = forms[w]
        return w

    return ordered((w, forms.get(w), root(w), n, len(near[w]), words[forms[w]] if w in forms else None) for w, n in words.items())


def long_enough(found, often=2):
    return {w: n for w, n in found.items() if len(w) >= LEAST and n >= often}


def test_query_against_plain_code(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert ordered(map(tuple, QUERIES["op13_spelling"](spark, SF).collect())) == expected(long_enough(counts(rows)))


def test_odd_rows(spark):
    docs = table(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert {r["word"]: r["n"] for r in word_counts(docs).collect()} == counts(rows)
    assert ordered(map(tuple, spelling_variants(docs).collect())) == expected(long_enough(counts(rows)))
    assert spelling_variants(empty(spark)).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, ""), (3, "short words only 1234567")], "doc_id long, text string")
    assert spelling_variants(nothing).count() == 0


def test_letters_beyond_ascii_and_a_very_long_text(spark):
    text = "Übermaß übermaß ÀÉÎÕÜàé ÀÉÎÕÜàé x÷×abcdef x÷×abcdef naïveté日本 naïvetés naïvetés " + "unbroken" * 100_000 + " " + "langword longword " * 3000
    docs = spark.createDataFrame([(5, text), (5, text), (None, text)], "doc_id long, text string")
    rows = [(5, text), (5, text), (None, text)]
    assert ordered(map(tuple, spelling_variants(docs).collect())) == expected(long_enough(counts(rows)))


def test_chains_of_forms_and_ties(spark):
    words = {"abcdefgh": 20000, "abcdefgi": 1500, "abcdefji": 120, "abcdekji": 11, "abldekji": 1, "bbcdefgh": 20000, "xbcdefgh": 7, "zzzzzzzz": 3}
    df = spark.createDataFrame([(w, n) for w, n in words.items()] + [(None, 4), ("nocount", None), ("tiny", 9)], "word string, n long")
    got = ordered(map(tuple, spelling_forms(df).collect()))
    assert got == expected(words)
    assert {r[0]: r[2] for r in got}["abldekji"] == "abcdefgh" and {r[0]: r[1] for r in got}["xbcdefgh"] == "abcdefgh"


def test_all_pairs_of_a_dense_vocabulary(spark):
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abé") for _ in range(rng.choice((7, 7, 8, 9)))) for _ in range(700)})
    df = spark.createDataFrame([(w, 1) for w in words], "word string, n long").repartition(5)
    got = {(r["a"], r["b"]) for r in near_pairs(df).collect()}
    assert got == {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b)}


def test_no_table_of_words_is_broadcast(spark):
    # a small file of words stands for twenty times as many signatures
    words = {"abcdefgh": 2000, "abcdefgi": 150, "abcdefji": 12, "abcdekji": 1, "zzzzzzzz": 3}
    pairs = near_pairs(spark.createDataFrame(list(words.items()), "word string, n long"))
    forms = spelling_forms(spark.createDataFrame(list(words.items()), "word string, n long"))
    for df, joins in ((pairs, 1), (forms, 1)):
        found = df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert found and "Broadcast" not in plan and plan.split("Initial Plan")[0].count("SortMergeJoin") == joins
    assert ordered(map(tuple, forms.collect())) == expected(words)


def test_near_words_share_a_key():
    rng = random.Random(7)
    for _ in range(300):
        word = "".join(rng.choice("abcdeé") for _ in range(rng.randrange(7, 14)))
        k = rng.randrange(len(word))
        other = rng.choice((word[:k] + "x" + word[k:], word[:k] + "y" + word[k + 1 :]))
        keys = signatures([word, other], LEAST // 2)
        assert set(keys[0]) & set(keys[1])
