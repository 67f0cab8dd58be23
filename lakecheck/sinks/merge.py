"""Upsert for plain file tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakecheck.operators.keys import dedup_latest
from lakecheck.session import scratch_folder, small_tasks
from lakecheck.sinks.writers import overwrite


def merge_upsert(
    target: DataFrame,
    source: DataFrame,
    keys: list[str],
    update: list[str],
    latest_by: list[str | Column],
    set_values: dict[str, Column] | None = None,
) -> DataFrame:
    """The target after updating matched and inserting unmatched source rows.

    The source is first reduced to its newest row per key. Updates are a left join of the target and
    inserts an anti join of the source, instead of one full outer join: a small source is then broadcast
    and the target is not shuffled, and with a large one a frequent target key can still be split.
    ``set_values`` overrides columns of updated and inserted rows. A NULL key matches nothing.
    """
    return upserted(target, dedup_latest(source, keys, latest_by), keys, update, set_values)


def upserted(target: DataFrame, fresh: DataFrame, keys: list[str], update: list[str], set_values: dict[str, Column] | None = None) -> DataFrame:
    """``merge_upsert`` for a source that has one row per key. It is read twice: write it before if it is costly."""
    set_values = set_values or {}
    incoming = fresh.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in update], F.lit(True).alias("_matched"))

    def after(name: str) -> Column:
        if name in set_values:
            new = set_values[name]
        elif name in update:
            new = F.col(f"_new_{name}")
        else:
            return F.col(name)
        return F.when(F.col("_matched"), new).otherwise(F.col(name)).alias(name)

    kept = target.join(incoming, keys, "left").select(*[after(c) for c in target.columns])

    inserted = fresh.join(target.select(*keys).distinct(), keys, "left_anti")
    types = {f.name: f.dataType for f in target.schema}
    values = {c: set_values.get(c, F.col(c) if c in (*keys, *update) else F.lit(None)) for c in target.columns}
    new_rows = inserted.select(*[v.cast(types[c]).alias(c) for c, v in values.items()])
    return kept.unionByName(new_rows)


def merge_into_path(
    target: DataFrame,
    source: DataFrame,
    path: str,
    keys: list[str],
    update: list[str],
    latest_by: list[str | Column],
    set_values: dict[str, Column] | None = None,
    partition_by: list[str] = (),
) -> DataFrame:
    """Write the merged table to a new path, never to the one being read, and return it.

    The newest source rows are worked out once, and written for the update and the insert to read. The target's rows
    are counted first, which for a file table is what its files tell and its filters need: partitions follow them.
    """
    spark = target.sparkSession
    n = target.count()
    fresh = newest_written(source, keys, latest_by, n)
    with small_tasks(spark, n + fresh.count()):
        overwrite(upserted(target, fresh, keys, update, set_values), path, partition_by)
    return spark.read.parquet(path)


def newest_written(source: DataFrame, keys: list[str], latest_by: list[str | Column], rows: int) -> DataFrame:
    """The newest source row per key, written; partitions for about ``rows`` rows."""
    spark = source.sparkSession
    folder = scratch_folder(spark, "merge-source")
    with small_tasks(spark, rows):
        dedup_latest(source, keys, latest_by).write.parquet(folder)
    return spark.read.parquet(folder)
