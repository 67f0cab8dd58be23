"""Writes. None of them overwrites a path that its own frame reads."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakecheck.sources.audit_files import PIPE_OPTIONS, RUN_FOLDER


def overwrite(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    """Replace the whole target."""
    writer = _sized(df, partition_by).write.mode("overwrite").option("partitionOverwriteMode", "static")
    _partitioned(writer, partition_by).parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Replace only the partitions that ``df`` has rows for."""
    _replacing(df, partition_by).parquet(path)


def append(df: DataFrame, path: str, partition_by: list[str] = ()) -> None:
    _partitioned(_sized(df, partition_by).write.mode("append"), partition_by).parquet(path)


def append_to_table(df: DataFrame, table: str) -> None:
    """Insert by column name, so the order of the frame's columns does not matter."""
    wanted = df.sparkSession.table(table).columns
    df.select(*wanted).write.insertInto(table)


def create_table_as(
    df: DataFrame, table: str, partition_by: list[str] = (), format_: str = "parquet", path: str | None = None
) -> DataFrame:
    writer = _partitioned(_sized(df, partition_by).write.format(format_).mode("errorifexists"), partition_by)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return df.sparkSession.table(table)


@contextmanager
def staging_table(df: DataFrame, table: str, **options) -> Iterator[DataFrame]:
    """A table that exists only inside the block."""
    created = create_table_as(df, table, **options)
    try:
        yield created
    finally:
        df.sparkSession.sql(f"DROP TABLE IF EXISTS {table}")


@contextmanager
def temp_view(df: DataFrame, name: str) -> Iterator[str]:
    df.createOrReplaceTempView(name)
    try:
        yield name
    finally:
        df.sparkSession.catalog.dropTempView(name)


def append_observed(df: DataFrame, path: str, metrics: dict[str, Column], partition_by: list[str] = ()) -> dict:
    """Append, and aggregates over the rows that were written, from the same job.

    ``metrics`` are aggregate expressions by name. They are taken in the last stage, whose tasks count once even where
    one has to run again.
    """
    watched = Observation()
    sized = _sized(df, partition_by).observe(watched, *[c.alias(name) for name, c in metrics.items()])
    _partitioned(sized.write.mode("append"), partition_by).parquet(path)
    return watched.get


def write_audit(df: DataFrame, root: str) -> None:
    """Audit rows, pipe-delimited with header under ``run_date=`` and ``run=``; line breaks become blanks.

    Rows of a run and date replace what an earlier attempt has written of these, so a run that is repeated does not
    double its rows. The folders are switched when the write commits; until then the old rows stay.
    """
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType) and f.name != "run_date"]
    flat = df.withColumns({c: F.regexp_replace(c, r"[\r\n]+", " ") for c in texts})
    keyed = flat.withColumn(RUN_FOLDER, F.col("run_id"))
    _replacing(keyed, ["run_date", RUN_FOLDER]).options(**PIPE_OPTIONS).csv(root)


def write_rule_rows(df: DataFrame, root: str) -> None:
    """Rule results as JSON lines under ``dt=/run_id=``; rows of a day and run replace those of an earlier attempt."""
    dated = df.withColumn("dt", F.to_date("failure_timestamp").cast("string"))
    _replacing(dated, ["dt", "run_id"]).json(root)


def _replacing(df: DataFrame, partition_by: list[str]):
    """A writer that replaces exactly the partition folders that ``df`` has rows for."""
    return _sized(df, partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)


def write_csv_report(df: DataFrame, path: str, order: list[str], single_file: bool = False) -> None:
    """A sorted CSV export in range-sorted part files, or in one file for a caller who knows that it is small."""
    parts = df.repartition(1).sortWithinPartitions(*order) if single_file else df.orderBy(*order)
    parts.write.mode("overwrite").option("header", True).csv(path)


def _sized(df: DataFrame, partition_by: list[str]) -> DataFrame:
    """Bring the rows of a partition folder together before a partitioned write.

    Without it every task would write a file into every folder. Adaptive execution splits a folder that
    holds much of the data and merges small ones, so one frequent value does not end in one task.
    """
    return df.hint("rebalance", *partition_by) if partition_by else df


def _partitioned(writer, partition_by):
    return writer.partitionBy(*partition_by) if partition_by else writer
