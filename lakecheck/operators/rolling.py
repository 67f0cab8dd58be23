"""Rolling statistics over per-period counts.

Windows run over counts that an aggregate made before, so a partition holds one row per period of a
group, never the raw rows.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakecheck.functions.exprs import between_days, when_status


def period_counts(df: DataFrame, by: list[str], period: str | Column, name: str = "period") -> DataFrame:
    period = F.col(period) if isinstance(period, str) else period
    return df.groupBy(*by, period.alias(name)).agg(F.count(F.lit(1)).alias("cnt"))


def rolling_zscore_rows(
    counts: DataFrame, by: list[str], period: str, value: str = "cnt", rows: int = 60, limit: float = 2.0
) -> DataFrame:
    """z-score against the ``rows`` periods before. No baseline or no spread fails."""
    past = Window.partitionBy(*by).orderBy(period).rowsBetween(-rows, -1)
    x = F.col(value).cast("double")
    mean, spread = F.col("_mean"), F.col("_spread")
    z = F.round((x - mean) / F.nullif(spread, F.lit(0.0)), 3)
    return (
        counts.withColumns({"_mean": F.round(F.avg(x).over(past), 6), "_spread": F.round(F.stddev_samp(x).over(past), 6)})
        .select(
            *by,
            period,
            F.col(value).alias("current_count"),
            F.round(mean, 2).alias("rolling_avg"),
            F.round(spread, 2).alias("rolling_stddev"),
            z.alias("z_score"),
            when_status(F.abs(z) <= limit).alias("status"),
        )
    )


def rolling_zscore_days(
    daily: DataFrame, day: str, value: str, as_of: date, days: int = 30, last: int = 7, digits: int = 0
) -> DataFrame:
    """z-score of each of the last days against the calendar days before it.

    Mean and deviation are rounded before z is formed, the mean from exact decimals. The window has no partition key: ``daily`` holds
    one row per day.
    """
    recent = daily.filter(between_days(daily, day, as_of - timedelta(days=days + last), as_of))
    past = Window.orderBy(F.unix_date(F.col(day))).rangeBetween(-days, -1)
    x = F.col(value).cast("double")
    mean = F.round(F.avg(F.col(value).cast("decimal(24,4)")).over(past), digits).cast("double")
    z = F.when(F.col("stddev") > 0, F.round((x - F.col("mean")) / F.col("stddev"), 2)).otherwise(0.0)
    scored = (
        recent.withColumns({"mean": mean, "stddev": F.round(F.stddev_samp(x).over(past), 2)})
        .filter(F.col(day) >= F.lit(as_of - timedelta(days=last)))
        .filter(F.col("mean").isNotNull())
        .withColumn("z_score", z)
    )
    size = F.abs(F.col("z_score"))
    flag = F.when(size >= 3, "CRITICAL").when(size >= 2, "WARNING").otherwise("NORMAL")
    return scored.select(day, value, "mean", "stddev", "z_score", flag.alias("z_flag"))


def rolling_status(
    metrics: DataFrame, by: list[str], day: str, value: str = "cnt", rows: int = 10, width: float = 2.0
) -> DataFrame:
    """Count and rolling average per metric and day.

    ANOMALY where the count lies more than ``width`` deviations from the average of the rows before;
    NORMAL otherwise, also while there is no deviation to measure by.
    """
    past = Window.partitionBy(*by).orderBy(day).rowsBetween(-rows, -1)
    x = F.col(value).cast("double")
    mean, spread = F.col("_mean"), F.col("_spread")
    return metrics.withColumns(
        {"_mean": F.round(F.avg(x).over(past), 4), "_spread": F.round(F.stddev_samp(x).over(past), 4)}
    ).select(
        *by,
        day,
        F.col(value),
        F.round(mean, 2).alias("rolling_avg"),
        F.when(F.abs(x - mean) > width * spread, "ANOMALY").otherwise("NORMAL").alias("status"),
    )


def moving_average_anomaly(
    counts: DataFrame, by: list[str], period: str, value: str = "cnt", periods: int = 12
) -> DataFrame:
    """Count of a period against the moving average of the periods before, flagged like ``rolling_status``."""
    flagged = rolling_status(counts, by, period, value, periods)
    return flagged.withColumnsRenamed({"rolling_avg": "moving_avg", "status": "anomaly_flag"})


def rolling_deviation(
    counts: DataFrame, by: list[str], period: str, value: str = "cnt", periods: int = 10, limit_pct: float = 10.0
) -> DataFrame:
    """Deviation from the rolling average in percent, flagged Y beyond the limit."""
    past = Window.partitionBy(*by).orderBy(period).rowsBetween(-periods, -1)
    x, mean = F.col(value).cast("double"), F.col("_mean")
    return (
        counts.withColumn("_mean", F.round(F.avg(x).over(past), 4))
        .withColumn("deviation_pct", F.round(F.try_divide(F.abs(x - mean) * 100, mean), 2))
        .select(
            *by,
            period,
            value,
            F.round(mean, 2).alias("rolling_avg"),
            "deviation_pct",
            F.when(F.col("deviation_pct") > limit_pct, "Y").otherwise("N").alias("deviates"),
        )
    )


def delete_reappear(presence: DataFrame, key: str, snapshot: str) -> DataFrame:
    """Keys that vanish for at least one snapshot and come back.

    Snapshots are dates, numbered in a table of one row per date; each key then compares its own consecutive
    snapshot numbers. The presence is read twice, for the dates and for the keys; ``delete_reappear_bits`` reads it
    once, for a span of days that is known.
    """
    if not isinstance(presence.schema[snapshot].dataType, T.DateType):
        raise ValueError(f"{snapshot} must be a date")
    seen = presence.select(key, snapshot).distinct()
    dates = seen.select(snapshot).distinct()
    numbered = dates.withColumn("_no", F.row_number().over(Window.orderBy(snapshot)))
    seen = seen.join(numbered, snapshot)
    own = Window.partitionBy(key).orderBy("_no")
    gaps = seen.withColumns({"_before": F.lag("_no").over(own), "last_seen": F.lag(snapshot).over(own)})
    return gaps.filter(F.col("_no") - F.col("_before") > 1).select(
        key,
        "last_seen",
        F.col(snapshot).alias("reappeared_on"),
        (F.col("_no") - F.col("_before") - 1).cast("bigint").alias("missed_snapshots"),
    )


def delete_reappear_bits(presence: DataFrame, key: str, snapshot: str, first: date, days: int = 384) -> DataFrame:
    """As ``delete_reappear``, for snapshots on the ``days`` days from ``first`` on: one read, one shuffle, no window.

    A key's presence is one bit per day, combined in the tasks that read and kept in ``days / 64`` numbers. The days
    that have a snapshot at all are the bits of all keys together, from the same combined rows. Gaps are read off the
    bits of a key, and how many snapshots fall into one off a table of running counts. A date outside the span is an
    error.
    """
    if not isinstance(presence.schema[snapshot].dataType, T.DateType):
        raise ValueError(f"{snapshot} must be a date")
    offset = F.datediff(F.col(snapshot), F.lit(first))
    outside = F.raise_error(F.concat(F.lit("snapshot outside the span of days: "), F.col(snapshot).cast("string"))).cast("int")
    dated = presence.where(F.col(snapshot).isNotNull()).select(key, F.when((offset >= 0) & (offset < days), offset).otherwise(outside).alias("_day"))
    words = range(-(-days // 64))
    bit, word = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("_day") % 64), F.shiftright("_day", 6)
    none = F.lit(0).cast("bigint")
    seen = dated.groupBy(key).agg(*[F.bit_or(F.when(word == i, bit).otherwise(none)).alias(f"_w{i}") for i in words])

    def on_days(bits: Column) -> Column:
        day = F.sequence(F.lit(0), F.lit(days - 1))
        return F.filter(day, lambda d: F.call_function("shiftright", F.get(bits, F.shiftright(d, 6)), d % 64).bitwiseAND(F.lit(1)) == 1)

    every = seen.agg(F.array(*[F.coalesce(F.bit_or(f"_w{i}"), none) for i in words]).alias("bits")).select(on_days(F.col("bits")).alias("on"))
    # snapshots before each day of the span
    before = every.select(F.transform(F.sequence(F.lit(0), F.lit(days)), lambda d: F.size(F.filter("on", lambda x: x < d)))).scalar()
    own = seen.select(key, on_days(F.array(*[f"_w{i}" for i in words])).alias("_on")).where(F.size("_on") > 1)
    pairs = F.transform(F.slice("_on", F.lit(2), F.size("_on")), lambda d, i: F.struct(F.get("_on", i).alias("last"), d.alias("back")))
    gaps = own.select(key, F.explode(F.filter(pairs, lambda p: p["back"] - p["last"] > 1)).alias("_gap"))
    missed = F.get(before, F.col("_gap.back")) - F.get(before, F.col("_gap.last") + 1)
    return gaps.withColumn("_missed", missed).where("_missed > 0").select(
        key,
        F.date_add(F.lit(first), F.col("_gap.last")).alias("last_seen"),
        F.date_add(F.lit(first), F.col("_gap.back")).alias("reappeared_on"),
        F.col("_missed").cast("bigint").alias("missed_snapshots"),
    )
