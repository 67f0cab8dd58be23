"""Exact duplicates: sorted digest runs merged as a tree.

Every row gets a digest of its text without white space and falls into one of ``runs`` runs. Round by round
``fan_in`` neighbouring runs are merged by digest, each merge keeping the best row and the number of rows seen,
until one run is left. ``min`` over a struct is a sort aggregate: each task sorts its digests, and the exchange
merges sorted runs. A group that holds a third of all rows is spread over all runs and shrinks to one row per run
before it meets in one place. The answer goes down the same way: to one row per digest and run, then to the rows,
which are joined on digest and run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakecheck.llm.storage import written
from lakecheck.llm.text import WHITE, sha256_hex, text_or_empty

#: Equal texts agree in all of these; the length and a second digest verify the first.
KEY = ["text_sha256", "norm_chars", "check"]


def digests(docs: DataFrame, id_column: str, text_column: str, runs: int) -> DataFrame:
    text = text_or_empty(text_column)
    plain = docs.select(F.col(id_column).alias("doc_id"), F.length(text).alias("chars"), F.regexp_replace(text, WHITE + "+", "").alias("norm"))
    return plain.select(
        "doc_id",
        "chars",
        sha256_hex(F.col("norm")).alias("text_sha256"),
        F.length("norm").alias("norm_chars"),
        F.xxhash64("norm").alias("check"),
        F.monotonically_increasing_id().alias("row"),
    ).withColumn("run", F.pmod(F.xxhash64("row"), F.lit(runs)).cast("int"))


def tree_merge(rows: DataFrame, runs: int, fan_in: int) -> tuple[DataFrame, DataFrame]:
    """First level (one row per digest and run) and last level (one row per digest)."""
    first = level = rows.groupBy(*KEY, "run").agg(
        F.min(F.struct((-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")).alias("best"),
        F.count(F.lit(1)).alias("group_size"),
    )
    left = runs
    while left > 1:
        left = -(-left // fan_in)
        level = (
            level.withColumn("run", F.floor(F.col("run") / fan_in).cast("int"))
            .groupBy(*KEY, "run")
            .agg(F.min("best").alias("best"), F.sum("group_size").alias("group_size"))
        )
    return first, level


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", runs: int = 64, fan_in: int = 8) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are equal without ASCII white space; NULL counts as empty, so NULL, empty and blank
    texts form one group. Of a group stays the row with the most code points, then the smallest id, a NULL id
    last. Of rows repeated with the same id and length exactly one stays. An empty table gives no rows; other
    columns are not read, whatever their names.
    """
    rows = written(digests(docs, id_column, text_column, runs), "digests")
    first, last = tree_merge(rows, runs, fan_in)
    answers = first.select(*KEY, "run").join(last.drop("run"), KEY)
    return rows.join(answers, [*KEY, "run"]).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
    )
