"""Daily partials: aggregates per day that are kept, and worked out anew only for days that have new rows.

Rolling checks look at 30 to 60 days of counts and sums, of which one or two have changed since the last run. The
partials lie in one folder per day; a refresh reads the rows of the changed days and replaces exactly their folders.

Distinct counts do not add up over days, sets do. Values get whole numbers, once, and a day keeps the numbers of each
group's values as bitmaps; those of a window are united and counted, exactly and without reading a row again.
"""

from __future__ import annotations

from datetime import date, datetime
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakecheck.functions.exprs import instant, on_day
from lakecheck.session import scratch_folder
from lakecheck.sinks.writers import overwrite_partitions

DAY = "partial_day"


def changed_days(df: DataFrame, day: str, load: str, since: datetime) -> list[date]:
    """The days of rows that were loaded at ``since`` or later; the filter stands on the bare load column.

    The driver gets one value per day. Rows without a day belong to none.
    """
    days = df.where(F.col(load) >= instant(since)).select(F.to_date(F.col(day)).alias("d")).where("d IS NOT NULL").distinct()
    return sorted(r["d"] for r in days.collect())


def refresh_partials(df: DataFrame, root: str, day: str, measures: dict[str, Column], by: list[str] = (), days: list[date] | None = None) -> None:
    """Work out the partials of the given days, or of all, and replace those that are kept of these days.

    The days are filters on the bare day column, so only their rows are read where the files allow it. A day all of
    whose rows have gone keeps its partials. No days, no work.
    """
    if days is not None and not days:
        return
    if DAY in by or DAY in measures:
        raise ValueError(f"{DAY} is the name of the day")
    partials = _dated(df, day, days).groupBy(DAY, *by).agg(*[c.alias(name) for name, c in measures.items()])
    overwrite_partitions(partials, root, [DAY])


def _dated(df: DataFrame, day: str, days: list[date] | None) -> DataFrame:
    rows = df if days is None else df.where(reduce(lambda a, b: a | b, (on_day(df, day, d) for d in days)))
    return rows.withColumn(DAY, F.to_date(F.col(day))).where(F.col(DAY).isNotNull())


def read_partials(spark: SparkSession, root: str, first: date | None = None, last: date | None = None) -> DataFrame:
    """The partials of a span of days, both ends included; other days' folders are not read."""
    kept = spark.read.parquet(root).withColumn(DAY, F.col(DAY).cast("date"))
    if first is not None:
        kept = kept.where(F.col(DAY) >= F.lit(first))
    return kept if last is None else kept.where(F.col(DAY) <= F.lit(last))


def window_totals(partials: DataFrame, day: date, days: int, include_day: bool = False) -> DataFrame:
    """``today_count, total_in_window, days_with_data`` from daily counts (``cnt``), as the check on volumes wants them."""
    last = F.date_sub(F.lit(day), 0 if include_day else 1)
    inside = (F.col(DAY) <= last) & (F.col(DAY) > F.date_sub(last, days))
    zero = F.lit(0).cast("bigint")
    return partials.agg(
        F.coalesce(F.sum(F.when(F.col(DAY) == F.lit(day), F.col("cnt"))), zero).alias("today_count"),
        F.coalesce(F.sum(F.when(inside, F.col("cnt"))), zero).alias("total_in_window"),
        F.count_if(inside & (F.col("cnt") > 0)).alias("days_with_data"),
    )


# ---- distinct counts ---------------------------------------------------------------------------

COLUMN, BUCKET, BITMAP = "counted_column", "bucket", "bitmap"
_VALUE, _ID = "value", "id"


def refresh_distincts(df: DataFrame, root: str, day: str, columns: list[str], by: list[str] = (), days: list[date] | None = None) -> None:
    """Keep, per day and group, which values of ``columns`` occur; those of the given days, or of all, are replaced.

    Values without a number yet get the next free ones. NULL values are not counted, as in ``count(DISTINCT)``.
    """
    if days is not None and not days:
        return
    rows, spark = _dated(df, day, days), df.sparkSession
    found = []
    for column in columns:
        numbers = f"{root}/numbers/{column}"
        _number_new_values(rows.select(F.col(column).alias(_VALUE)), numbers)
        known = spark.read.parquet(numbers)
        met = rows.select(DAY, *by, F.col(column).alias(_VALUE)).where(F.col(_VALUE).isNotNull()).distinct()
        found.append(met.join(known, _VALUE).select(DAY, *by, F.lit(column).alias(COLUMN), F.bitmap_bucket_number(_ID).alias(BUCKET), F.bitmap_bit_position(_ID).alias("_bit")))
    bitmaps = reduce(DataFrame.unionByName, found).groupBy(DAY, *by, COLUMN, BUCKET).agg(F.bitmap_construct_agg("_bit").alias(BITMAP))
    overwrite_partitions(bitmaps, f"{root}/bitmaps", [DAY])


def distinct_counts(spark: SparkSession, root: str, columns: list[str], by: list[str] = (), first: date | None = None, last: date | None = None) -> DataFrame:
    """``by`` and the exact number of distinct values of each column over a span of days, both ends included."""
    kept = read_partials(spark, f"{root}/bitmaps", first, last)
    united = kept.groupBy(*by, COLUMN, BUCKET).agg(F.bitmap_or_agg(BITMAP).alias(BITMAP)).withColumn("_n", F.bitmap_count(BITMAP))
    zero = F.lit(0).cast("bigint")
    return united.groupBy(*by).agg(*[F.coalesce(F.sum(F.when(F.col(COLUMN) == c, F.col("_n"))), zero).alias(c) for c in columns])


def _number_new_values(values: DataFrame, path: str) -> None:
    """Append the values that have no number yet, numbered without gaps from the highest one on.

    The distinct new values are written first, so that the place of a row in its task is fixed; the numbers of a task
    follow those of the tasks before it. Only the counts of tasks are lined up, never the values.
    """
    spark = values.sparkSession
    new, top = values.where(F.col(_VALUE).isNotNull()).distinct(), 0
    try:
        known = spark.read.parquet(path)
        new, top = new.join(known, _VALUE, "left_anti"), known.agg(F.coalesce(F.max(_ID), F.lit(0))).first()[0]
    except AnalysisException as exc:
        if exc.getCondition() != "PATH_NOT_FOUND":
            raise
    place = F.monotonically_increasing_id()
    folder = scratch_folder(spark, "new-values")
    new.select(_VALUE, F.shiftright(place, 33).alias("_task"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")).write.parquet(folder)
    placed = spark.read.parquet(folder)
    counts = placed.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("_task", F.coalesce(before, F.lit(0)).alias("_before"))
    placed.join(offsets, "_task").select(_VALUE, (F.col("_before") + F.col("_at") + top + 1).alias(_ID)).write.mode("append").parquet(path)
