"""Near duplicates by SetSketch registers over word shingles.

A document's set holds its distinct five-word shingles. A register is the minimum of the set's hash values under
one of ``REGISTERS`` functions, taken as an exponential variable and rounded to a power of ``SPACING``, truncated at
both ends; registers of a union are the maxima of the registers. Documents with equal sets form one class. Classes
that agree in all registers of a band share a bucket; a joint likelihood of the registers of two classes and their
set sizes estimates their similarity, and what may reach the threshold is verified on the full sets.

Pairs within a bucket are not all made: each member is paired with the bucket's hub and with the next member. Pairs
whose estimate passes tie classes to clusters, and inside a cluster the full sets decide. A small cluster is one
group of texts. A large one is first compared with its hub, the class with most estimated partners; what links to
the hub is one component already, and only the rest is compared with blocks of it and with each other. A group
emits no more links than it has members, enough to connect what its full sets connect.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakecheck.llm.arrow import ragged, slices, text_buffer, tidy
from lakecheck.llm.components import components, with_facts
from lakecheck.llm.storage import written
from lakecheck.llm.words import LOWER, mix, powers, word_hashes, word_spans

SHINGLE = 5
PERCENT = 75
REGISTERS = 128
BAND = 4
SPACING = 1.001
#: Pairs whose estimate is this far below the threshold are not verified: over five standard errors of it.
MARGIN = 0.2
BLOCK = 256

_rng = np.random.default_rng(5)
_MUL = (_rng.integers(0, 2**31, REGISTERS, dtype=np.uint32) * 2 + 1).astype(np.uint32)
_ADD = _rng.integers(0, 2**32, REGISTERS, dtype=np.uint32)
_STEP = int(_rng.integers(2**62, 2**63)) | 1


def shingle_sets(texts: pa.Array, size: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text. Words are split at ASCII white space, A-Z in lower case.

    A text of fewer words is one shingle; one without words, or NULL, has the empty set.
    """
    data, offsets = text_buffer(texts)
    data = LOWER[data]
    starts, ends, text = word_spans(data, offsets)
    words = word_hashes(data, starts, ends)
    bounds = np.searchsorted(text, np.arange(len(texts) + 1))
    step = powers(_STEP, size)
    whole = np.zeros(max(len(words) - size + 1, 0), np.uint64)
    for k in range(size):
        whole += words[k : k + len(whole)] * step[k]
    whole = mix(whole)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= size:
            out.append(np.unique(whole[a : b - size + 1]))
        elif b > a:
            out.append(mix(np.array([(words[a:b] * step[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def registers(members: np.ndarray) -> np.ndarray:
    """``REGISTERS`` 16-bit registers of a set that is not empty."""
    low = members.astype(np.uint32)
    best = np.full(REGISTERS, 2**32 - 1, np.uint32)
    for at in range(0, len(low), 1024):
        np.minimum(best, (low[at : at + 1024, None] * _MUL + _ADD).min(axis=0), out=best)
    exponential = -np.log1p(-(best.astype(np.float64) + 0.5) / 2.0**32)
    return np.clip(np.floor(1 - np.log(exponential) / np.log(SPACING)), 0, 65535).astype(np.uint16)


def estimated(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity from registers ``(pairs, REGISTERS)`` and set sizes, on a grid of 1/200.

    With shares ``u, v`` of the sizes, a register of the first set is above that of the second with probability
    ``p(u - v j)`` and below it with ``p(v - u j)``, where ``p(x) = -log_b(1 - x (b - 1) / b)``.
    """
    above, below = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    u = (n_a / (n_a + n_b))[:, None]
    j = np.linspace(0, 1, 201)[None, :] * np.minimum(u / (1 - u), (1 - u) / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (SPACING - 1) / SPACING) / np.log(SPACING)
    up, down = p(u - (1 - u) * j), p((1 - u) - u * j)
    tiny = 1e-12
    like = above * np.log(up + tiny) + below * np.log(down + tiny) + (REGISTERS - above - below) * np.log(np.maximum(1 - up - down, tiny))
    return j[np.arange(len(j)), like.argmax(axis=1)]


def similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common)


# ---- sketches, buckets and clusters -------------------------------------------------------------


@tidy
def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for rows in slices(batch, "text"):
            sets, others = shingle_sets(rows.column("text")), [c for c in rows.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [
                    *(rows.column(c) for c in others),
                    pa.array([_digest(s) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([registers(s).tobytes() if len(s) else None for s in sets], pa.binary()),
                ],
                names=[*others, "node", "size", "registers"],
            )


def _digest(members: np.ndarray) -> bytes | None:
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest() if len(members) else None


def sketches(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **keys: Column) -> DataFrame:
    """``doc_id, node, size, registers``: per row the digest of its set (NULL if empty), the set size and the registers.

    ``keys``, binary columns by name, follow the id.
    """
    base = docs.select(F.col(id_column).alias("doc_id"), *(c.alias(name) for name, c in keys.items()), F.col(text_column).cast("string").alias("text"))
    keyed = "".join(f"{name} binary, " for name in keys)
    return base.mapInArrow(_sketch, f"doc_id {base.schema['doc_id'].dataType.simpleString()}, {keyed}node binary, size long, registers binary")


def candidate_pairs(classes: DataFrame) -> DataFrame:
    """``a, b``: per bucket every member with the hub and with the next member, without repetition."""
    width = 2 * BAND
    bands = F.transform(F.sequence(F.lit(0), F.lit(REGISTERS // BAND - 1)), lambda i: F.xxhash64(i, F.substring(F.col("registers"), i * width + 1, F.lit(width))))
    spread = classes.select("node", F.explode(bands).alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
    members = spread.join(shared.select("bucket", "hub", "n"), "bucket")
    star = members.where("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b"))
    return star.union(_neighbours(members.where("n > 2"))).distinct()


def _neighbours(members: DataFrame) -> DataFrame:
    """Each member with the next one of its bucket, by node; a large bucket is cut by the first byte of the node."""
    lane = F.when(F.col("n") > BLOCK, F.hex(F.substring("node", 1, 1))).otherwise("")
    w = Window.partitionBy("bucket", "lane").orderBy("node")
    nexts = members.withColumn("lane", lane).select("node", F.lead("node").over(w).alias("b"))
    return nexts.where("b is not null").select(F.col("node").alias("a"), "b")


@tidy
def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        regs = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("ra", "rb")]
        sizes = [np.asarray(batch.column(c), float) for c in ("na", "nb")]
        keep = [estimated(*(x[i : i + 512] for x in (*regs, *sizes))) >= PERCENT / 100 - MARGIN for i in range(0, batch.num_rows, 512)]
        yield batch.select(["a", "b"]).filter(pa.array(np.concatenate(keep)))


def likely_pairs(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose estimated similarity may reach the threshold."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("size").alias(f"n{x}"), F.col("registers").alias(f"r{x}"))
    joined = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "ra", "rb", "na", "nb")
    possible = F.lit(100) * F.least("na", "nb") >= PERCENT * F.greatest("na", "nb")
    return joined.where(possible).mapInArrow(_likely, "a binary, b binary")


# ---- verification -------------------------------------------------------------------------------


class _Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def tie(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def group_links(sets: list[np.ndarray], tied: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what the full sets connect; members marked ``tied`` belong together already and are not compared.

    Posting lists of the group's shingles give the exact intersection sizes of a member with all others at once.
    """
    sizes = np.array([len(s) for s in sets])
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    value, posting = flat[order], owner[order]
    new = np.concatenate(([True], value[1:] != value[:-1]))
    begin = np.flatnonzero(new)
    length = np.diff(np.append(begin, len(value)))
    rank = np.empty(len(flat), np.int64)
    rank[order] = np.cumsum(new) - 1
    at = np.concatenate(([0], np.cumsum(sizes)))
    forest, links = _Forest(len(sets)), []
    first_tied = int(np.flatnonzero(tied)[0]) if tied.any() else -1
    for i in np.flatnonzero(tied):
        forest.tie(first_tied, int(i))
    for i in range(len(sets)):
        if tied[i]:
            continue
        mine = rank[at[i] : at[i + 1]]
        mine = mine[length[mine] > 1]
        if not len(mine):
            continue
        common = np.bincount(posting[ragged(begin[mine], length[mine])], minlength=len(sets))
        near = np.flatnonzero(100 * common >= PERCENT * (sizes + sizes[i] - common))
        for j in near[tied[near] | (near < i)]:
            if forest.tie(int(j), i):
                links.append((int(j), i))
    return links


@tidy
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``task, node``; a group ends where the task changes."""
    task, nodes, sets, tied = None, [], [], []

    def close() -> pa.RecordBatch:
        links = group_links(sets, np.array(tied)) if len(sets) > 1 else []
        return pa.RecordBatch.from_arrays([pa.array([nodes[k] for k, _ in links], pa.binary()), pa.array([nodes[k] for _, k in links], pa.binary())], names=["a", "b"])

    for batch in batches:
        for rows in slices(batch, "text"):
            found = shingle_sets(rows.column("text"))
            for key, node, members, known in zip(rows.column("task").to_pylist(), rows.column("node").to_pylist(), found, rows.column("tied").to_pylist()):
                if key != task:
                    if nodes:
                        yield close()
                    task, nodes, sets, tied = key, [], [], []
                if _digest(members) == node and (not nodes or nodes[-1] != node):  # another text under the same id
                    nodes.append(node)
                    sets.append(members)
                    tied.append(known)
    if nodes:
        yield close()


@tidy
def _with_hub(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hub, hub_set = None, None
    for batch in batches:
        for rows in slices(batch, "text"):
            keep = []
            hubs, hub_texts = rows.column("hub").to_pylist(), rows.column("hub_text")
            for i, members in enumerate(shingle_sets(rows.column("text"))):
                if hubs[i] != hub:
                    hub, hub_set = hubs[i], shingle_sets(hub_texts.slice(i, 1))[0]
                keep.append(similar(members, hub_set))
            yield rows.select(["hub", "node"]).filter(pa.array(keep, pa.bool_())).rename_columns(["a", "b"])


def verified_links(likely: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b``: links between classes, enough to connect all that the full sets of a cluster connect.

    ``texts`` (``node, text``) holds a text of each class in ``likely``.
    """
    degree = F.count(F.lit(1))
    met = likely.select(F.col("a").alias("node")).union(likely.select(F.col("b").alias("node"))).groupBy("node").agg(degree.alias("degree"))
    clusters = written(components(likely).join(met, "node"), "met")
    hubs = clusters.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("degree", "node"))["node"].alias("hub"))
    placed = written(with_facts(clusters, hubs).select("node", "label", "hub", "n"), "clusters")
    large = placed.where(F.col("n") > BLOCK)
    with_text = large.where("node <> hub").join(texts, "node")
    hub_texts = large.where("node = hub").select("hub").join(texts.select(F.col("node").alias("hub"), F.col("text").alias("hub_text")), "hub")
    star = written(with_text.join(hub_texts, "hub").select("hub", "node", "text", "hub_text").mapInArrow(_with_hub, "a binary, b binary"), "star")
    tied = placed.join(star.select(F.col("b").alias("node"), F.lit(True).alias("tied")), "node", "left")
    tied = tied.withColumn("tied", (F.col("tied").isNotNull() | (F.col("node") == F.col("hub"))) & (F.col("n") > BLOCK))
    counts = tied.groupBy("label").agg(F.count_if("tied").alias("n_tied"), F.count_if(~F.col("tied")).alias("n_free"))
    rows = with_facts(tied.select("node", "label", "tied"), counts).join(texts, "node")
    blocks = _grouped(rows).repartition("task").sortWithinPartitions("task", "node").mapInArrow(_verify, "a binary, b binary")
    return star.union(blocks)


def _grouped(rows: DataFrame) -> DataFrame:
    """Each row once per group that compares it: free blocks against each other and against the tied blocks."""
    blocks = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    free, mine = blocks("n_free"), F.pmod(F.xxhash64("node"), F.when(F.col("tied"), blocks("n_tied")).otherwise(blocks("n_free"))).cast("int")
    upto = lambda n: F.filter(F.sequence(F.lit(0), n), lambda i: i < n)
    name = lambda kind, i, j: F.concat_ws("-", F.lit(kind), i.cast("string"), j.cast("string"))
    of_tied = F.transform(upto(free), lambda j: name("t", F.col("mine"), j))
    of_free = F.concat(
        F.transform(upto(free), lambda j: name("f", F.least(F.col("mine"), j), F.greatest(F.col("mine"), j))),
        F.transform(upto(blocks("n_tied")), lambda i: name("t", i, F.col("mine"))),
    )
    placed = rows.withColumn("mine", mine)
    return placed.select("node", "tied", "text", "label", F.explode(F.when(F.col("tied"), of_tied).otherwise(of_free)).alias("at")).select(
        F.concat_ws("-", F.hex("label"), "at").alias("task"), "node", "tied", "text"
    )


def _labelled(docs: DataFrame, id_column: str, text_column: str, key: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sketches of all rows, one row per class, and ``node, label`` of the classes that are linked with others."""
    text = F.col(text_column).cast("string")
    text_key = F.coalesce(F.unhex(F.md5(text.cast("binary"))), F.lit(b""))
    keys = {"text_key": text_key} | ({} if key is None else {"key": key})
    rows = written(sketches(docs, id_column, text_column, **keys), "sketches")
    # the row that stands for a class: its id alone would not do, one id may have several texts, and many rows no id
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")).alias("first")
    classes = rows.where("size > 0").groupBy("node").agg(first, F.first("size").alias("size"), F.first("registers").alias("registers"))
    classes = written(classes.select("node", "first.doc_id", "first.text_key", "size", "registers"), "classes")
    likely = written(likely_pairs(candidate_pairs(classes), classes), "likely")
    wanted = likely.select(F.col("a").alias("node")).union(likely.select(F.col("b").alias("node"))).distinct().join(classes.select("node", "doc_id", "text_key"), "node")
    source = docs.select(F.col(id_column).alias("doc_id"), text_key.alias("text_key"), text.alias("text"))
    same = F.col("w.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("w.text_key") == F.col("s.text_key"))
    texts = written(wanted.alias("w").join(source.alias("s"), same).select("node", "text").dropDuplicates(["node"]), "texts")
    return rows, classes, components(written(verified_links(likely, texts), "links"))


def near_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``, one row per input row.

    Two documents are linked if their sets of distinct five-word shingles have a Jaccard similarity of 0.75 or more;
    ``component_id`` is the smallest id that links reach, ``kept`` marks the rows that carry it. NULL and empty texts
    and texts without words have size 0 and are linked with nothing. Rows repeated under one id share its fate; a
    NULL id is never the smallest unless all ids of its component are NULL. An empty table gives no rows.
    """
    rows, classes, labels = _labelled(docs, id_column, text_column)
    linked = classes.select("node", "doc_id").join(labels, "node")
    least = linked.groupBy("label").agg(F.min("doc_id").alias("least"))
    told = with_facts(linked.select("node", "label"), least).select("node", "least")
    answer = classes.select("node", "doc_id").join(told, "node", "left").select("node", F.coalesce("least", "doc_id").alias("component_id"))
    full = rows.where("size > 0").select("doc_id", "size", "node").join(answer, "node").select("doc_id", "size", "component_id")
    empty = rows.where("size = 0").select("doc_id", "size", F.col("doc_id").alias("component_id"))
    return full.union(empty).select("doc_id", F.col("size").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def near_unique(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each group of near duplicates: the one with the smallest id, NULL being the last; columns as in ``docs``.

    Groups are made of rows, as in ``near_groups``, but each row has its own fate: of rows repeated under one id and
    of a component of NULL ids one stays, and an id with two texts is judged by each. Among different rows of one id
    in a group a digest of the row decides. Rows of size 0 are linked with nothing and all stay.
    """
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_column]
    text = F.coalesce(F.md5(F.col(text_column).cast("string").cast("binary")), F.lit(""))
    key = F.unhex(F.md5(F.concat_ws("-", text, F.xxhash64(*others)).cast("binary")))
    rows, _, labels = _labelled(docs, id_column, text_column, key)
    same = rows.where("size > 0").groupBy("node", "doc_id", "key").agg(F.count(F.lit(1)).alias("n"))
    first = same.groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "n")).alias("first"))
    one = first.join(labels, "node", "left").groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("first").alias("first"))
    empty = rows.where("size = 0").select("doc_id", "key", F.lit(1).cast("long").alias("n")).distinct()
    stays = written(one.select("first.doc_id", "first.key", "first.n").union(empty), "stays")
    keyed = docs.withColumn("_key", key)

    def held(by: DataFrame) -> DataFrame:
        s = by.select(F.col("doc_id").alias("_id"), F.col("key").alias("_stays"))
        return keyed.join(s, F.col(id_column).eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_stays")), "left_semi")

    repeated = stays.where("n > 1")
    if repeated.isEmpty():
        return held(stays).drop("_key")
    w = Window.partitionBy(id_column, "_key").orderBy("_key")
    single = held(repeated).withColumn("_at", F.row_number().over(w)).where("_at = 1").drop("_at")
    return held(stays.where("n = 1")).union(single).drop("_key")
