"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs: runs of up to ``PARAGRAPH_WORDS`` words of one line. Each distinct paragraph digest
goes to one cell in each of three subtables; a cell keeps a signed count, the XOR of its digests and the XOR of
their check digests. Sketches of one width are subtracted cell by cell, which leaves the paragraphs of one side
alone; a cell with a count of 1 or -1 and a fitting check holds exactly one of them, which is taken out of its
other cells (peeling). What does not peel is retried with a larger width.

Everything is rows and aggregates. The cells of a pair stay in the task that holds its texts, since all keys begin
with the columns by which the texts were dealt out, so peeling adds no exchange. Peeling visits one subtable at a
time: a digest lies in one cell of it, so nothing is taken out twice.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakecheck.llm.storage import written
from lakecheck.llm.text import sha256_hex, text_or_empty

PARAGRAPH_WORDS = 16
#: Cells per subtable of the fingerprint that is stored.
BASE_WIDTH = 5
SUBTABLES = 3
SUB_ROUNDS = 12
#: Characters of text per task; the cells of one task are held in memory.
PART_CHARS = 4_000_000
#: Pseudo subtable in which peeling counts what it has found.
FOUND = SUBTABLES
KEY = ["k1", "k2"]


def paragraph_digests(text: Column, words: int = PARAGRAPH_WORDS) -> Column:
    """Distinct 64-bit digests of the paragraphs; empty for a text without words. White space between words does not count beyond their line."""
    pattern = rf"[^\x20\x09-\x0D]+(?:[\x20\x09\x0B-\x0D]+[^\x20\x09-\x0D]+){{0,{words - 1}}}"
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda p: F.xxhash64(p)))


def cell(digest: Column, sub: int, width: Column) -> Column:
    return F.pmod(F.xxhash64(digest, F.lit(sub)), width.cast("long")).cast("int")


def check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit("check"))


def sketch(digests: Column, width: int = BASE_WIDTH) -> Column:
    """The sketch as text: per cell count, digests and checks in hexadecimal, cells apart by a point; first the number of digests."""

    def one(sub: int, at: int) -> Column:
        mine = F.filter(digests, lambda d: cell(d, sub, F.lit(width)) == at)
        folded = F.aggregate(
            mine,
            F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("c")),
            lambda a, d: F.struct((a["n"] + 1).alias("n"), a["d"].bitwiseXOR(d).alias("d"), a["c"].bitwiseXOR(check(d)).alias("c")),
        )
        return F.concat_ws(":", F.hex(folded["n"]), F.hex(folded["d"]), F.hex(folded["c"]))

    cells = [one(sub, at) for sub in range(SUBTABLES) for at in range(width)]
    return F.lower(F.concat_ws(".", F.hex(F.size(digests)), *cells))


# ---- peeling ------------------------------------------------------------------------------------


def _row(sub: Column, pos: Column, n: Column, digest: Column, checked: Column) -> Column:
    return F.struct(sub.alias("sub"), pos.alias("pos"), n.alias("n"), digest.alias("d"), checked.alias("c"))


def _spread(digest: Column, n: Column, width: Column, subs: list[int]) -> list[Column]:
    return [_row(F.lit(s), cell(digest, s, width), n, digest, check(digest)) for s in subs]


def _summed(rows: DataFrame, key: list[str]) -> DataFrame:
    return rows.groupBy(*key, "pair", "width", "sub", "pos").agg(F.sum("n").alias("n"), F.bit_xor("d").alias("d"), F.bit_xor("c").alias("c"))


def subtracted(pairs: DataFrame, key: list[str]) -> DataFrame:
    """Cells of ``left`` minus cells of ``right`` for each entry of ``pairs`` (``array<struct<pair, width, left, right>>``)."""
    each = pairs.select(*key, F.explode("pairs").alias("p")).select(*key, "p.*")
    signed = each.select(
        *key,
        "pair",
        "width",
        F.explode(F.concat(F.transform("left", lambda d: F.struct(d.alias("d"), F.lit(1).alias("n"))), F.transform("right", lambda d: F.struct(d.alias("d"), F.lit(-1).alias("n"))))).alias("x"),
    ).select(*key, "pair", "width", "x.*")
    cells = signed.select(*key, "pair", "width", F.explode(F.array(*_spread(F.col("d"), F.col("n").cast("long"), F.col("width"), list(range(SUBTABLES))))).alias("x"))
    return _summed(cells.select(*key, "pair", "width", "x.*"), key)


def peeled_once(cells: DataFrame, key: list[str], sub: int) -> DataFrame:
    pure = (F.col("sub") == sub) & (F.abs("n") == 1) & (F.col("c") == check(F.col("d")))
    digest, n, width = F.col("d"), F.col("n"), F.col("width")
    zero = F.lit(0).cast("long")
    others = [s for s in range(SUBTABLES) if s != sub]
    taken = F.array(_row(F.lit(FOUND), n.cast("int"), F.lit(1).cast("long"), zero, zero), *_spread(digest, -n, width, others))
    own = F.array(_row(F.col("sub"), F.col("pos"), n, digest, F.col("c")))
    left = cells.where((F.col("sub") == FOUND) | (F.col("n") != 0) | (F.col("d") != 0) | (F.col("c") != 0))
    return _summed(left.select(*key, "pair", "width", F.explode(F.when(pure, taken).otherwise(own)).alias("x")).select(*key, "pair", "width", "x.*"), key)


def differences(pairs: DataFrame, key: list[str] = KEY) -> DataFrame:
    """``key, pair, only_left, only_right, failed`` for the pairs with a difference; pairs without have no row."""
    cells = reduce(lambda df, i: peeled_once(df, key, i % SUBTABLES), range(SUB_ROUNDS), subtracted(pairs, key))
    stuck = (F.col("sub") != FOUND) & ((F.col("n") != 0) | (F.col("d") != 0) | (F.col("c") != 0))
    found = lambda sign: F.coalesce(F.sum(F.when((F.col("sub") == FOUND) & (F.col("pos") == sign), F.col("n"))), F.lit(0))
    return cells.groupBy(*key, "pair").agg(found(1).alias("only_left"), found(-1).alias("only_right"), F.max(F.when(stuck, 1).otherwise(0)).alias("failed"))


def _width(left: str, right: str, factor: float) -> Column:
    return (F.ceil((F.size(left) + F.size(right)) * (factor / SUBTABLES)) + BASE_WIDTH).cast("int")


def _pair(name: str, left: str, right: str, factor: float) -> Column:
    return F.struct(F.lit(name).alias("pair"), _width(left, right, factor).alias("width"), F.col(left).alias("left"), F.col(right).alias("right"))


def likeness(left: Column, right: Column, only_left: Column, only_right: Column) -> Column:
    """Share of common paragraphs: common / all distinct; 1 for two sets without members. Left and right are set sizes."""
    every = left + only_right
    return F.when(every == 0, F.lit(1.0)).otherwise((left - only_left).cast("double") / every)


# ---- next documents -----------------------------------------------------------------------------


def keyed(docs: DataFrame, id_column: str, text_column: str, parts: int) -> DataFrame:
    """``k1, k2, doc_id, text, copies``: equal rows as one with their number; the keys stand for id and text, NULL ids included.

    Texts are dealt out once, in ``parts`` parts, and stay there for all that follows.
    """
    base = docs.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text"))
    base = base.select(F.xxhash64("doc_id", F.col("doc_id").isNull(), "text").alias("k1"), F.hash("text", "doc_id", F.col("doc_id").isNull()).alias("k2"), "doc_id", "text")
    return base.repartition(parts, *KEY).groupBy(*KEY).agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))


def chain(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``k1, k2, n_chars, n1, n2, p1, p2, half``: per document its next and previous one by descending id, as a ring, and what the previous one needs.

    Ids are dealt out by ranges; within a range a window finds the neighbours, and only the first and last row of
    each range meet in one place.
    """
    base = docs.select(F.col(id_column).alias("doc_id"), text_or_empty(text_column).alias("text"))
    ids = base.select(
        F.xxhash64("doc_id", F.col("doc_id").isNull(), "text").alias("k1"),
        F.hash("text", "doc_id", F.col("doc_id").isNull()).alias("k2"),
        "doc_id",
        F.length("text").alias("n_chars"),
    ).distinct()
    order = [F.col("doc_id").desc_nulls_last(), F.col("k1"), F.col("k2")]
    dealt = written(ids.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "ids")
    me = F.struct("k1", "k2", "n_chars")
    w = Window.partitionBy("part").orderBy(*order)
    local = dealt.withColumn("after", F.lead(me).over(w)).withColumn("before", F.lag(me).over(w))
    ends = local.where(F.col("after").isNull() | F.col("before").isNull())
    edges = ends.groupBy("part").agg(
        F.max(F.when(F.col("before").isNull(), me)).alias("head"), F.max(F.when(F.col("after").isNull(), me)).alias("tail")
    )
    ring = Window.orderBy("part")
    whole = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    joints = edges.select(
        "part",
        F.coalesce(F.lead("head").over(ring), F.first("head").over(whole)).alias("next_head"),
        F.coalesce(F.lag("tail").over(ring), F.last("tail").over(whole)).alias("last_tail"),
    )
    joined = local.join(F.broadcast(joints), "part")  # one row per partition of the ids
    after, before = F.coalesce("after", "next_head"), F.coalesce("before", "last_tail")
    return joined.select(
        "k1", "k2", "n_chars", after["k1"].alias("n1"), after["k2"].alias("n2"), before["k1"].alias("p1"), before["k2"].alias("p2"), F.floor(before["n_chars"] / 2).cast("int").alias("half")
    )


def fingerprints_with_edit(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", factor: float = 1.8) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and those of the next document are.

    ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, n_paragraphs``, one
    row per input row. The edited text has the last half (rounded down) of the code points replaced by the first as
    many of the next document by descending id; the last one is followed by the first. NULL texts are empty. A NULL
    id comes last. Rows with one id are ordered by a digest of their text; equal rows are one document. A text
    without words has no paragraphs; two such are alike by 1. An empty table gives no rows.
    """
    links = written(chain(docs, id_column, text_column), "chain")
    parts = int(max(1, -(-(links.agg(F.sum("n_chars")).first()[0] or 0) // PART_CHARS)))
    # the condition always holds; with it all branches ask for the same columns and share one exchange of the texts
    texts = keyed(docs, id_column, text_column, parts).where((F.col("copies") > 0) | F.col("doc_id").isNotNull()).join(links, KEY)
    heads = texts.select(
        F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.expr("substring(text, 1, half)").alias("head"), paragraph_digests(F.col("text")).alias("next_set")
    ).repartition(parts, *KEY)
    both = texts.join(heads, KEY).select(
        *KEY, "doc_id", "copies", "n_chars", paragraph_digests(F.col("text")).alias("own_set"), "next_set",
        F.expr("concat(substring(text, 1, n_chars - floor(n_chars / 2)), head)").alias("edited"),
    )
    sets = both.select(*KEY, "doc_id", "copies", "n_chars", sha256_hex(F.col("edited")).alias("edited_sha256"), "own_set", paragraph_digests(F.col("edited")).alias("edited_set"), "next_set")
    two = [("edited", "own_set", "edited_set"), ("next", "own_set", "next_set")]
    pairs = sets.select(*KEY, F.array(*(_pair(*p, factor) for p in two)).alias("pairs"))
    found = differences(pairs)
    of = lambda pair, field: F.coalesce(F.max(F.when(F.col("pair") == pair, F.col(field))), F.lit(0)).alias(f"{pair}_{field}")
    fields = ("only_left", "only_right", "failed")
    wide = found.groupBy(*KEY).agg(*(of(p, f) for p in ("edited", "next") for f in fields))
    joined = sets.join(wide, KEY, "left").fillna(0, [f"{p}_{f}" for p in ("edited", "next") for f in fields])
    keep = lambda pair, column: F.when(F.col(f"{pair}_failed") == 1, F.col(column))
    done = written(
        joined.select(
            *KEY, "doc_id", "copies", "n_chars", "edited_sha256",
            sketch(F.col("own_set")).alias("fingerprint"), sketch(F.col("edited_set")).alias("edited_fingerprint"),
            F.size("own_set").alias("n_own"), F.size("edited_set").alias("n_edited"), F.size("next_set").alias("n_next"),
            *(f"{p}_{f}" for p in ("edited", "next") for f in fields),
            F.when((F.col("edited_failed") == 1) | (F.col("next_failed") == 1), F.col("own_set")).alias("own_set"),
            keep("edited", "edited_set").alias("edited_set"), keep("next", "next_set").alias("next_set"),
        ),
        "sketches",
    )
    solved = _retried(done, two, factor)
    near = lambda pair: likeness(F.col("n_own"), F.col(f"n_{pair}"), F.col(f"{pair}_only_left"), F.col(f"{pair}_only_right")).alias(f"near_{pair}")
    return solved.withColumn("_copy", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select(
        "doc_id", F.col("n_chars").cast("long").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint", near("edited"), near("next"), F.col("n_own").cast("long").alias("n_paragraphs")
    )


def _retried(done: DataFrame, two: list[tuple[str, str, str]], factor: float) -> DataFrame:
    """Pairs that did not peel, again with wider tables until all have; the others pass through."""
    failed = [F.col(f"{p}_failed") == 1 for p, _, _ in two]
    parts, left = [done.where(~(failed[0] | failed[1]))], done.where(failed[0] | failed[1])
    fields = ("only_left", "only_right", "failed")
    while not left.isEmpty():
        factor *= 2
        again = left.select(*KEY, F.filter(F.array(*(F.when(F.col(f"{p}_failed") == 1, _pair(p, a, b, factor)) for p, a, b in two)), lambda x: x.isNotNull()).alias("pairs")).repartition(*KEY)
        found = differences(again).groupBy(*KEY).agg(*(F.max(F.when(F.col("pair") == p, F.col(f))).alias(f"new_{p}_{f}") for p, _, _ in two for f in fields))
        joined = left.join(found, KEY, "left")
        left = written(joined.select(*(F.coalesce(f"new_{c}", c).alias(c) if f"new_{c}" in joined.columns else F.col(c) for c in done.columns)), "retry")
        parts.append(left.where(~(failed[0] | failed[1])))
        left = left.where(failed[0] | failed[1])
    return reduce(DataFrame.unionByName, parts)
