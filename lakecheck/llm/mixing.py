"""Mixing overlapping sources to target weights by a min-cost flow.

Documents are aggregated by membership pattern, the set of sources that hold them. Words flow from patterns to the
quotas of their sources; the first pass over a pattern is free, every further one costs more than the one before
(convex), so nothing is repeated while something unread would do. The flow says how many words each pattern gives:
every document of it that many full passes, and documents in seeded order one more until the rest is reached. The
order is cut by totals of hash buckets and, inside one bucket, by single documents; no pattern is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakecheck.llm.storage import written
from lakecheck.llm.text import text_or_empty, word_count

#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Patterns are planned on the driver; more than this many are refused rather than cut.
MAX_PATTERNS = 100_000
BUCKET_BITS = 12


@dataclass(frozen=True)
class Pattern:
    key: str
    sources: tuple[str | None, ...]
    words: int


def source_order(names: Sequence[str | None]) -> list[str | None]:
    """By code point, NULL last."""
    return sorted(set(names), key=lambda s: (s is None, s or ""))


def fill_targets(sizes: dict, weights: dict, total: float, cap: float = MAX_REPEATS) -> dict:
    """Shares of ``total`` by weight, none above ``cap`` times its size; the excess is reshared by weight among the rest."""
    targets: dict = {}
    open_ = [s for s in sizes if weights[s] > 0]
    left = float(total)
    while open_:
        unit = left / sum(weights[s] for s in open_)
        over = [s for s in open_ if unit * weights[s] > cap * sizes[s]]
        if not over:
            return targets | {s: unit * weights[s] for s in open_} | {s: 0.0 for s in sizes if weights[s] <= 0}
        for s in over:
            targets[s] = float(cap * sizes[s])
            left -= targets[s]
        open_ = [s for s in open_ if s not in targets]
    return targets | {s: 0.0 for s in sizes if s not in targets}


def route(patterns: Sequence[Pattern], quotas: dict, repeats: int = MAX_REPEATS) -> dict[tuple[int, str | None], int]:
    """Words that pattern ``i`` gives to each source: a maximal flow of least cost.

    Arcs: start to pattern once per pass, with the pattern's words as capacity and ``pass - 1`` as cost; pattern to
    its sources without limit; source to end with its quota. Every way through has one arc with a cost, so the
    cheapest flow is a maximal one over first passes, made larger with second passes, and so on. A pattern that shares
    its only source with no other needs no flow.
    """
    holders: dict = {}
    for i, p in enumerate(patterns):
        for s in p.sources:
            holders.setdefault(s, []).append(i)
    alone = {i: p.sources[0] for i, p in enumerate(patterns) if len(p.sources) == 1 and len(holders[p.sources[0]]) == 1}
    out = {(i, s): min(int(round(quotas[s])), repeats * patterns[i].words) for i, s in alone.items()}
    rest = [i for i in range(len(patterns)) if i not in alone]
    out |= _flow({i: patterns[i] for i in rest}, {s: int(round(q)) for s, q in quotas.items()}, repeats) if rest else {}
    return {k: n for k, n in out.items() if n}


def _flow(patterns: dict[int, Pattern], quotas: dict, repeats: int) -> dict[tuple[int, str | None], int]:
    """Blocking flows over levels of equal distance, pass by pass; a pass only adds room to arcs from the start."""
    names = sorted({s for p in patterns.values() for s in p.sources}, key=lambda s: (s is None, s or ""))
    at = {s: 1 + len(patterns) + i for i, s in enumerate(names)}
    end = 1 + len(patterns) + len(names)
    arcs: list[list[int]] = [[] for _ in range(end + 1)]
    to: list[int] = []
    room: list[int] = []

    def arc(a: int, b: int, capacity: int) -> int:
        for u, v, c in ((a, b, capacity), (b, a, 0)):
            arcs[u].append(len(to))
            to.append(v)
            room.append(c)
        return len(to) - 2

    fed, links = [], {}
    for k, (i, p) in enumerate(patterns.items()):
        fed.append((arc(0, 1 + k, 0), p.words))
        for s in p.sources:
            links[i, s] = arc(1 + k, at[s], repeats * p.words)
    for s in names:
        arc(at[s], end, quotas[s])

    def levels() -> list[int]:
        level, queue = [-1] * (end + 1), [0]
        level[0] = 0
        for u in queue:
            for e in arcs[u]:
                if room[e] > 0 and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        return level

    for _ in range(repeats):
        for e, words in fed:
            room[e] += words
        while (level := levels())[end] > 0:
            tried, path, u = [0] * (end + 1), [], 0
            while True:
                if u == end:
                    amount = min(room[e] for e in path)
                    for e in path:
                        room[e] -= amount
                        room[e ^ 1] += amount
                    full = next(k for k, e in enumerate(path) if not room[e])
                    u = to[path[full] ^ 1]
                    del path[full:]
                elif tried[u] < len(arcs[u]):
                    e = arcs[u][tried[u]]
                    if room[e] > 0 and level[to[e]] == level[u] + 1:
                        path.append(e)
                        u = to[e]
                    else:
                        tried[u] += 1
                elif path:  # a dead end: back one step, past the arc that led here
                    u = to[path.pop() ^ 1]
                    tried[u] += 1
                else:
                    break
    return {k: room[e ^ 1] for k, e in links.items()}


def sized(docs: DataFrame, sources: Column, id_column: str, text_column: str, seed: int) -> DataFrame:
    """``doc_id, sources, pattern, size, ticket, bucket`` per row; ``ticket`` is the place of id and text in the seeded order."""
    text = text_or_empty(text_column)
    members = F.array_sort(F.array_distinct(sources))
    rows = docs.select(F.col(id_column).alias("doc_id"), members.alias("sources"), word_count(text).alias("size"), F.xxhash64(F.lit(seed), id_column, text).alias("ticket"))
    return rows.select("doc_id", "sources", F.to_json("sources", {"ignoreNullFields": "false"}).alias("pattern"), "size", "ticket", F.shiftrightunsigned("ticket", 64 - BUCKET_BITS).alias("bucket"))


def mixing_plan(rows: DataFrame, weights: Sequence[float] = WEIGHTS, repeats: int = MAX_REPEATS) -> tuple[DataFrame, DataFrame]:
    """``(plan, sources)``: per pattern ``passes, cut_bucket, cut_ticket``; per source ``source_size, target, routed``.

    Both are as long as there are patterns and sources; more than ``MAX_PATTERNS`` patterns raise ValueError.
    """
    spark = rows.sparkSession
    totals = rows.groupBy("pattern", "sources").agg(F.sum("size").alias("words")).orderBy("pattern").limit(MAX_PATTERNS + 1).collect()
    if len(totals) > MAX_PATTERNS:
        raise ValueError(f"more than {MAX_PATTERNS} membership patterns; give fewer sources")
    patterns = [Pattern(r["pattern"], tuple(r["sources"]), r["words"]) for r in totals]
    names = source_order([s for p in patterns for s in p.sources])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    size = dict.fromkeys(names, 0)
    for p in patterns:
        for s in p.sources:
            size[s] += p.words
    target = fill_targets(size, weight, sum(p.words for p in patterns), repeats)
    flow = route(patterns, target, repeats)
    given, routed = [0] * len(patterns), dict.fromkeys(names, 0)
    for (i, s), words in flow.items():
        given[i] += words
        routed[s] += words
    split = [divmod(g, p.words) if p.words else (0, 0) for g, p in zip(given, patterns)]
    wanted = spark.createDataFrame([(p.key, int(q), int(r)) for p, (q, r) in zip(patterns, split)], "pattern string, passes int, rest long")
    plan = written(_cuts(rows, F.broadcast(wanted)), "mix")  # at most MAX_PATTERNS rows
    sources = spark.createDataFrame([(s, size[s], target[s], routed[s]) for s in names], "source string, source_size long, target double, routed long")
    return plan, sources


def _cuts(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Where in the seeded order the last pass over a pattern stops: the bucket, and the last ticket inside it."""
    so_far = Window.partitionBy("pattern").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = rows.groupBy("pattern", "bucket").agg(F.sum("size").alias("words")).withColumn("reached", F.sum("words").over(so_far))
    cut = (
        buckets.join(wanted, "pattern")
        .where((F.col("reached") >= F.col("rest")) & (F.col("reached") - F.col("words") < F.col("rest")))
        .groupBy("pattern")
        .agg(F.min("bucket").alias("cut_bucket"), F.min(F.col("rest") - F.col("reached") + F.col("words")).alias("need"))
    )
    one = Window.partitionBy("pattern").orderBy("ticket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = (
        rows.join(F.broadcast(cut), "pattern")
        .where(F.col("bucket") == F.col("cut_bucket"))
        .groupBy("pattern", "need", "ticket")
        .agg(F.sum("size").alias("words"))
        .withColumn("reached", F.sum("words").over(one))
        .where(F.col("reached") - F.col("words") / 2 <= F.col("need"))
        .groupBy("pattern")
        .agg(F.max("ticket").alias("cut_ticket"))
    )
    return wanted.join(cut, "pattern", "left").join(inside, "pattern", "left").select("pattern", "passes", "cut_bucket", "cut_ticket")


def copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with ``copies``: how often the mix takes each. The plan has one row per pattern, at most ``MAX_PATTERNS``."""
    early = F.col("bucket") < F.col("cut_bucket")
    last = (F.col("bucket") == F.col("cut_bucket")) & (F.col("ticket") <= F.col("cut_ticket"))
    joined = rows.join(F.broadcast(plan), "pattern", "left")
    more = F.when(F.coalesce(early | last, F.lit(False)), 1).otherwise(0)
    return joined.withColumn("copies", (F.coalesce("passes", F.lit(0)) + more).cast("int")).drop("passes", "cut_bucket", "cut_ticket")


def mixed_sizes(docs: DataFrame, source: str = "source", id_column: str = "doc_id", text_column: str = "text", seed: int = 42) -> DataFrame:
    """``doc_id, source, size, source_size, target, taken``, one row per document.

    Size: words of the text, 0 for NULL. A source, NULL included, takes part by its place in the code-point order.
    ``taken`` is 0 to 3 times the size, and per source within one document of its target. Rows with equal id and
    text have one place in the order and are taken alike. An empty table gives no rows.
    """
    rows = written(sized(docs, F.array(F.col(source)), id_column, text_column, seed), "sizes")
    plan, sources = mixing_plan(rows)
    taken = copies(rows, plan).withColumn("source", F.col("sources")[0]).alias("r")
    told = F.broadcast(sources).alias("s")  # one row per source, at most as many as patterns
    return taken.join(told, F.col("r.source").eqNullSafe(F.col("s.source"))).select(
        "doc_id", "r.source", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )


def mixed_rows(docs: DataFrame, source: str = "source", id_column: str = "doc_id", text_column: str = "text", seed: int = 42) -> DataFrame:
    """``docs``, each row as often as the mix takes it (0 to 3 times); same columns, and the choices of ``mixed_sizes``."""
    small = written(sized(docs, F.array(F.col(source)), id_column, text_column, seed), "sizes")
    plan, _ = mixing_plan(small)
    names = docs.columns
    text = text_or_empty(text_column)
    marked = docs.select(
        F.struct(*names).alias("_doc"),
        F.to_json(F.array(F.col(source)), {"ignoreNullFields": "false"}).alias("pattern"),
        F.xxhash64(F.lit(seed), id_column, text).alias("ticket"),
    ).withColumn("bucket", F.shiftrightunsigned("ticket", 64 - BUCKET_BITS))
    return copies(marked, plan).withColumn("_n", F.explode(F.array_repeat(F.lit(0), F.col("copies")))).select("_doc.*")
