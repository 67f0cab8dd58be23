"""Single-table checks.

Every check is a lazy one-row (or one-row-per-item) DataFrame. Checks that look at single rows are
compiled into one conditional aggregate, so ten checks on a table read it once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakecheck.functions.exprs import as_col, between_days, instant, on_day, percent, when_status
from lakecheck.operators.keys import load_slice

# Placeholder dates that stand for "no date".
SENTINEL_DATES = ("0001-01-01", "9999-12-31")
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"


# ---- conditions over a result ------------------------------------------------------------------


def check_condition(
    df: DataFrame, name: str, condition: str, check_type: str, mode: str = "all", order: list[str] | None = None
) -> DataFrame:
    """Test a boolean expression over the columns of ``df`` and ``row_count``.

    By default all rows must meet it; ``mode="first"`` looks at the first row in ``order`` only. An empty
    result passes only where the condition speaks of nothing but ``row_count`` and holds for 0. The
    reported value is the first column the condition names, else the row count.
    """
    if mode == "first" and not order:
        raise ValueError("mode='first' needs an order")
    named = [c for c in df.columns if re.search(rf"\b{re.escape(c)}\b", condition)]
    rows = df.orderBy(*order).limit(1) if mode == "first" else df
    counted = df.agg(F.count(F.lit(1)).alias("row_count"))
    if not named:
        verdict = counted.select("row_count", F.expr(condition).alias("ok"), F.col("row_count").alias("actual"))
    else:
        if re.search(r"\brow_count\b", condition):
            rows = rows.withColumn("row_count", counted.scalar())
        ok = F.coalesce(F.expr(condition), F.lit(False))
        shown = F.col(named[0]).cast("string")
        verdict = rows.select(ok.alias("ok"), shown.alias("shown")).agg(
            F.count(F.lit(1)).alias("row_count"),
            F.coalesce(F.bool_and("ok"), F.lit(False)).alias("ok"),
            # of several rows, report one that breaks the condition
            F.coalesce(F.min(F.when(~F.col("ok"), F.col("shown"))), F.min("shown")).alias("actual"),
        )
    return verdict.select(
        F.lit(name).alias("name"),
        F.lit(check_type).alias("check_type"),
        when_status(F.col("ok")).alias("status"),
        F.concat(
            F.when(F.col("ok"), "holds: ").otherwise("does not hold: "), F.lit(condition)
        ).alias("detail"),
        F.col("actual").cast("string").alias("actual_value"),
    )


def row_count(df: DataFrame, name: str) -> DataFrame:
    """Rows must be there."""
    return check_condition(df.agg(F.count(F.lit(1)).alias("cnt")), name, "cnt > 0", "row_count")


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("cnt")).filter(F.col("cnt") > 1)


def no_rows(df: DataFrame, name: str) -> DataFrame:
    """A listing of violations must be empty."""
    return check_condition(df.select(), name, "row_count == 0", "no_rows")


def duplicate_key_count(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    return check_condition(
        duplicates(df, keys).agg(F.count(F.lit(1)).alias("dup_cnt")), name, "dup_cnt == 0", "duplicates"
    )


def freshness(df: DataFrame, column: str, as_of: datetime, limit_hours: int, name: str) -> DataFrame:
    """Whole hours since the newest load must stay under the limit; an empty table fails."""
    newest = df.agg(F.timestamp_diff("HOUR", F.max(F.col(column)), instant(as_of)).alias("hours_old"))
    return check_condition(newest, name, f"hours_old < {int(limit_hours)}", "freshness")


# ---- violations, one pass ----------------------------------------------------------------------


def violations(df: DataFrame, bad: dict[str, Column], limit_pct: float = 0.0) -> DataFrame:
    """One row per named condition with total rows, violating rows and their share, from a single scan."""
    totals = df.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(f"_{i}") for i, c in enumerate(bad.values())]
    )
    rows = [F.struct(F.lit(n).alias("check_name"), "total", F.col(f"_{i}").alias("violations")) for i, n in enumerate(bad)]
    share = percent(F.col("violations"), F.col("total"), 2)
    return (
        totals.select(F.inline(F.array(*rows)))
        .withColumn("violation_pct", F.coalesce(share, F.lit(0.0)))
        .withColumn("status", when_status(F.col("violation_pct") <= limit_pct if limit_pct else F.col("violations") == 0))
    )


def is_missing(*columns: str) -> Column:
    """Any of the columns is NULL."""
    found = F.lit(False)
    for c in columns:
        found = found | F.col(c).isNull()
    return found


def is_not_iso_date(column: str) -> Column:
    text = F.col(column).cast("string")
    return text.isNull() | ~text.rlike(ISO_DATE)


def is_not_allowed(column: str, codes: list[str]) -> Column:
    return F.col(column).isNull() | ~F.col(column).isin(codes)


def is_not_year(columns: list[str], low: str | Column = "1900", high: str | Column = "2100") -> Column:
    """Years are kept and compared as text. The limits may be columns, such as fields of a parameter row."""
    found = F.lit(False)
    for c in columns:
        found = found | F.col(c).isNull() | (F.col(c) < low) | (F.col(c) > high)
    return found


def null_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return violations(df, {k: F.col(k).isNull() for k in keys})


def null_percent(df: DataFrame, columns: list[str], limit_pct: float) -> DataFrame:
    return violations(df, {c: F.col(c).isNull() for c in columns}, limit_pct)


# ---- shares and windows ------------------------------------------------------------------------


def percent_threshold(df: DataFrame, bad: Column, limit: float = 0.20) -> DataFrame:
    """Share of invalid rows with PASS, FAIL or NO_DATA."""
    totals = df.agg(F.count(F.lit(1)).alias("total"), F.count_if(bad).alias("invalid_count"))
    return totals.select("total", "invalid_count", *_invalid_share(limit))


def date_window(
    df: DataFrame, column: str, as_of: date, back_years: int = 2, ahead_months: int = 6, limit: float = 0.0
) -> DataFrame:
    """Text dates that do not parse, are placeholders, or lie outside the window around ``as_of``."""
    text = F.col(column).cast("string")
    value = text.try_cast("date")
    low, high = F.add_months(F.lit(as_of), -12 * back_years), F.add_months(F.lit(as_of), ahead_months)
    placeholder = F.coalesce(value.isin([F.lit(s).cast("date") for s in SENTINEL_DATES]), F.lit(False))
    outside = F.coalesce((value < low) | (value > high), F.lit(False))
    totals = df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(value.isNull()).alias("unparsable"),
        F.count_if(placeholder).alias("placeholders"),
        F.count_if(outside & ~placeholder).alias("out_of_window"),
        F.count_if(value.isNull() | placeholder | outside).alias("invalid_count"),
    )
    return totals.select(
        "total", "unparsable", "placeholders", "out_of_window", "invalid_count", *_invalid_share(limit)
    )


def _invalid_share(limit: float) -> list[Column]:
    total, invalid = F.col("total"), F.col("invalid_count")
    within = invalid.cast("double") / total.cast("double") <= limit
    return [
        F.when(total == 0, 0.0).otherwise(percent(invalid, total, 2)).alias("invalid_pct"),
        F.when(total == 0, "NO_DATA").when(within, "PASS").otherwise("FAIL").alias("status"),
    ]


def variance_pct(today: Column, baseline: Column, signed: bool = False) -> Column:
    """Deviation from a baseline in percent, unrounded. A zero or missing baseline gives 0 or 100."""
    today, baseline = today.cast("double"), F.coalesce(baseline.cast("double"), F.lit(0.0))
    gap = today - baseline if signed else F.abs(today - baseline)
    return F.when(baseline == 0, F.when(today == 0, 0.0).otherwise(100.0)).otherwise(
        F.try_divide(gap, baseline) * 100
    )


def rolling_average(
    df: DataFrame, column: str, day: date, days: int, tolerance: float = 25.0, warn_only: bool = False
) -> DataFrame:
    """Rows of a day against the mean of the days present in the window before it."""
    per_day = (
        df.filter(between_days(df, column, day - timedelta(days=days), day))
        .groupBy(F.to_date(F.col(column)).alias("d"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    before = F.col("d") < F.lit(day)
    counts = per_day.agg(
        F.coalesce(F.sum(F.when(~before, F.col("n"))), F.lit(0)).alias("today_cnt"),
        F.round(F.avg(F.when(before, F.col("n"))), 2).alias("baseline_cnt"),
    )
    return rolling_average_verdict(counts, tolerance, warn_only)


# column names under which a caller's own query may deliver its counts
TODAY_NAMES = ("today_cnt", "today_count")
BASELINE_NAMES = ("baseline_cnt", "avg_cnt", "rolling_avg_60")


def count_columns(counts: DataFrame) -> tuple[str | None, str | None]:
    """Names of the tested count and of its baseline, None where there is none."""
    today = next((c for c in counts.columns if c in TODAY_NAMES), None)
    return today, next((c for c in counts.columns if c in BASELINE_NAMES or re.fullmatch(r"avg_.*_cnt", c)), None)


def rolling_average_verdict(counts: DataFrame, tolerance: float = 25.0, warn_only: bool = False) -> DataFrame:
    """Status of given counts, row by row; several usual column names are understood.

    A ``variance_pct`` that the counts bring along is the one that is tested. Without it there must be a baseline.
    """
    today, base = count_columns(counts)
    if base is None and "variance_pct" not in counts.columns:
        raise ValueError("no baseline column and no variance_pct")
    given = F.col("variance_pct").cast("double") if "variance_pct" in counts.columns else variance_pct(F.col(today), F.col(base))
    variance = F.round(given, 2)
    return counts.select(
        (F.col(today) if today else F.lit(None)).cast("bigint").alias("today_cnt"),
        (F.col(base) if base else F.lit(None)).cast("double").alias("baseline_cnt"),
        variance.alias("variance_pct"),
        when_status(variance <= float(tolerance), "WARN" if warn_only else "FAIL").alias("status"),
    )


def volume_against_window(
    df: DataFrame,
    day: date,
    load: str = "load_ts",
    update: str | None = None,
    days: int = 60,
    include_day: bool = False,
    limit_pct: float = 15.0,
) -> DataFrame:
    """Rows of a day against the mean over ``days`` calendar days, in which missing days count as 0.

    ``include_day`` lets the window end on the tested day itself. With an update column a row belongs to
    the day it was loaded or updated on, and to the window by its load day, or update day if never loaded.
    """
    last = day if include_day else day - timedelta(days=1)
    first = last - timedelta(days=days - 1)
    tested = on_day(df, load, day)
    inside = between_days(df, load, first, last)
    dated = F.col(load)
    if update:
        tested = tested | on_day(df, update, day)
        inside = inside | (F.col(load).isNull() & between_days(df, update, first, last))
        dated = F.coalesce(F.col(load), F.col(update))
    totals = df.filter(tested | inside).agg(
        F.count_if(tested).alias("today_count"),
        F.count_if(inside).alias("total_in_window"),
        F.count_distinct(F.when(inside, F.to_date(dated))).alias("days_with_data"),
    )
    return _window_verdict(totals, "today_count", "total_in_window", days, limit_pct, ["days_with_data"])


def volume_from_partials(totals: DataFrame, days: int = 60, limit_pct: float = 15.0) -> DataFrame:
    """The same verdict from kept daily counts (``partials.window_totals``), without reading the rows again."""
    return _window_verdict(totals, "today_count", "total_in_window", days, limit_pct, ["days_with_data"])


def amount_against_window(
    df: DataFrame, amount: str, day: date, load: str, transaction: str, days: int = 30, limit_pct: float = 20.0
) -> DataFrame:
    """Amount of a day against the mean of the ``days`` days before; text that is no number counts as 0."""
    first, before = day - timedelta(days=days), day - timedelta(days=1)
    no_load = F.col(load).isNull()

    def falls(lo: date, hi: date) -> Column:
        return between_days(df, load, lo, hi) | (no_load & between_days(df, transaction, lo, hi))

    value = F.col(amount).try_cast("decimal(18,2)")
    zero = F.lit(0).cast("decimal(28,2)")
    totals = df.filter(falls(first, day)).agg(
        F.coalesce(F.sum(F.when(falls(day, day), value)), zero).cast("decimal(28,2)").alias("today_sum"),
        F.coalesce(F.sum(F.when(falls(first, before), value)), zero).cast("decimal(28,2)").alias("prior_sum"),
    )
    return _window_verdict(totals, "today_sum", "prior_sum", days, limit_pct, [])


def _window_verdict(
    totals: DataFrame, today: str, window: str, days: int, limit_pct: float, extra: list[str]
) -> DataFrame:
    mean = F.col(window).cast("double") / F.lit(float(days))
    gap = variance_pct(F.col(today), mean, signed=True)
    return totals.select(
        today,
        window,
        *extra,
        F.round(mean, 4).alias("rolling_avg"),
        F.round(gap, 2).alias("pct_difference"),
        when_status(F.abs(gap) <= limit_pct).alias("status"),
    )


def last_transaction_previous_day(df: DataFrame, load_day: str, ts: str, late_hour: int = 23) -> DataFrame:
    """Per load day: the newest transaction must be of the day before, in its last hour."""
    newest = F.col("max_ts")
    previous = F.to_date(newest) == F.date_sub(F.col("load_day"), 1)
    late = F.hour(newest) >= late_hour
    return (
        df.groupBy(F.to_date(F.col(load_day)).alias("load_day"))
        .agg(F.max(ts).alias("max_ts"), F.min(ts).alias("min_ts"))
        .select(
            "load_day",
            "max_ts",
            "min_ts",
            F.when(previous, "Y").otherwise("N").alias("is_prev_day"),
            F.when(late, "Y").otherwise("N").alias("is_late"),
            when_status(previous & late).alias("status"),
        )
    )


# ---- reconciliation ----------------------------------------------------------------------------


def recon_deviations(counts: DataFrame, source: str, target: str, threshold: float) -> DataFrame:
    """Rows that deviate by the threshold or more; 0 reports every row. A missing side is skipped."""
    gap = F.abs(F.col(source).cast("double") - F.col(target).cast("double"))
    return counts.withColumn("deviation", gap).filter(F.col("deviation") >= threshold)


def recon_verdict(counts: DataFrame, source: str, target: str, threshold: float) -> DataFrame:
    gap = F.abs(F.col(source).cast("double") - F.col(target).cast("double"))
    found = F.count_if(gap >= threshold)
    return counts.agg(
        F.count(F.lit(1)).alias("total_rows"),
        found.alias("deviating_rows"),
        when_status(found == 0).alias("status"),
    )


def recon_ratio(base: DataFrame, staging: DataFrame, least: float = 0.95) -> DataFrame:
    """The base must hold at least a share of what staging holds."""
    counted = staging.agg(F.count(F.lit(1)).alias("staging_cnt")).withColumn(
        "base_cnt", base.agg(F.count(F.lit(1))).scalar()
    )
    return counted.withColumn(
        "status", when_status(F.col("base_cnt") >= F.col("staging_cnt").cast("double") * F.lit(least))
    )


# ---- failure conventions of check queries ------------------------------------------------------


def failing_values(df: DataFrame, pattern: str, fail_value: str) -> DataFrame:
    """Rows holding the fail value in each column whose name contains the pattern."""
    hits = [c for c in df.columns if pattern.lower() in c.lower()]
    if not hits:
        return df.sparkSession.createDataFrame([], "column_name string, failing_rows bigint, status string")
    totals = df.agg(*[F.count_if(F.col(c).cast("string") == fail_value).alias(c) for c in hits])
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(c).alias("failing_rows")) for c in hits]
    return totals.select(F.inline(F.array(*rows))).withColumn("status", when_status(F.col("failing_rows") == 0))


def row_count_rule(df: DataFrame, kind: str) -> DataFrame:
    """``row_count_zero``: fails on no rows. ``row_count_nonzero``: fails on any. ``none``: informational."""
    n = F.count(F.lit(1))
    status = {
        "row_count_zero": when_status(n > 0),
        "row_count_nonzero": when_status(n == 0),
        "none": F.lit("INFO"),
    }[kind]
    return df.agg(F.lit(kind).alias("rule"), n.alias("row_count"), status.alias("status"))


@dataclass(frozen=True)
class RatioCheck:
    name: str
    good: Column
    threshold: float


def pass_ratio(df: DataFrame, checks: list[RatioCheck]) -> DataFrame:
    """Share of good rows per check, all from one scan; a row of unknown outcome is not good."""
    totals = df.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(c.good).alias(f"_{i}") for i, c in enumerate(checks)]
    )
    rows = [
        F.struct(
            F.lit(c.name).alias("check_name"),
            F.col(f"_{i}").alias("good_rows"),
            F.col("total").alias("total_rows"),
            F.lit(float(c.threshold)).alias("threshold"),
        )
        for i, c in enumerate(checks)
    ]
    share = F.try_divide(F.col("good_rows").cast("double"), F.col("total_rows").cast("double"))
    return (
        totals.select(F.inline(F.array(*rows)))
        .withColumn("pass_share", F.round(share, 6))
        .withColumn("status", when_status(share >= F.col("threshold")))
    )


def metric_alerts(metrics: DataFrame, limits: dict[str, tuple[str, float]]) -> DataFrame:
    """Metrics beyond their limit. ``limits`` maps a metric to ("above" or "below", limit)."""
    beyond, limit = F.lit(False), F.lit(None).cast("double")
    for metric, (side, bound) in limits.items():
        this = F.col("metric") == metric
        value = F.col("value").cast("double")
        beyond = beyond | (this & ((value > bound) if side == "above" else (value < bound)))
        limit = F.when(this, F.lit(float(bound))).otherwise(limit)
    return metrics.filter(beyond).select("metric", F.col("value").cast("double").alias("value"), limit.alias("threshold"))


def today_against_mean(df: DataFrame, column: str, day: date, days: int = 10) -> tuple[DataFrame, DataFrame]:
    """Two one-row frames: rows of the day, and the rounded mean of the days present before it."""
    today = load_slice(df, day, column).agg(F.count(F.lit(1)).alias("cnt"))
    window = df.filter(between_days(df, column, day - timedelta(days=days), day - timedelta(days=1)))
    per_day = window.groupBy(F.to_date(as_col(column)).alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return today, per_day.agg(F.round(F.avg("n"), 0).alias("cnt"))
