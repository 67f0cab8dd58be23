"""Checks and comparisons described by configuration: SQL text plus a check type or a comparison rule.

A described check becomes one lazy row (name, check_type, status, detail, actual_value). Several of them
are stacked into one frame and run as one Spark job. A check whose SQL does not resolve is reported as
NOT_EXECUTED and does not stop the others.
"""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakecheck.operators import checks, compare
from lakecheck.sources.sql import bind

# check types whose query works out its own status
STATUS_TYPES = ("percentage_threshold", "date_window_validation")


# statuses of a row that is in order, and those that a result keeps if all its other rows agree on them
GOOD_STATUSES = ("PASS", "OK")
KEPT_STATUSES = ("WARN", "NO_DATA", "NOT_EXECUTED")
COLUMNS = ("name", "check_type", "status", "detail", "actual_value")
# what an audit row says besides, as text
MEASURES = ("query", "failure_reason", "today_count", "baseline_count", "variance_pct", "tolerance", "window_start", "window_end")
# what a described check may do wrong before anything runs
FAULTS = (AnalysisException, ParseException, KeyError, ValueError, TypeError)


def run_suite(
    spark: SparkSession,
    validations: list[dict] = (),
    comparisons: list[dict] = (),
    variables: dict[str, str] | None = None,
) -> DataFrame:
    """All described checks as one frame; ``variables`` fill ``{name}`` places in their SQL."""
    return reduce(DataFrame.unionByName, _rows(spark, validations, comparisons, variables))


def suite_events(
    spark: SparkSession,
    validations: list[dict] = (),
    comparisons: list[dict] = (),
    variables: dict[str, str] | None = None,
) -> dict[str, DataFrame]:
    """All described checks and comparisons by kind of event, each row with the ``MEASURES`` of an audit row.

    A measure that a check does not have is NULL.
    """
    shapes = {}
    for kind, configs, run in (("VALIDATION", validations, _check), ("COMPARISON", comparisons, _comparison)):
        rows = [_measured(run(spark, c, variables), c, variables) for c in configs]
        if rows:
            shapes[kind] = reduce(DataFrame.unionByName, rows)
    return shapes


def _measured(row: DataFrame, config: dict, variables: dict[str, str] | None) -> DataFrame:
    queries = [config[k] if k == "query" else config[k].get("query", "") for k in ("query", "query_a", "query_b") if k in config]
    tolerance = config.get("tolerance")
    own = {
        "query": F.lit("; ".join(queries)),
        "failure_reason": F.when(F.col("status").isin("FAIL", "NOT_EXECUTED"), F.col("detail")),
        "tolerance": F.lit(None if tolerance is None else str(tolerance)),
    }
    more = [(own.get(c, F.col(c) if c in row.columns else F.lit(None))).cast("string").alias(c) for c in MEASURES]
    return row.select(*COLUMNS, *more)


def run_suite_isolated(
    spark: SparkSession,
    validations: list[dict] = (),
    comparisons: list[dict] = (),
    variables: dict[str, str] | None = None,
) -> DataFrame:
    """As ``run_suite``, run at once, so that a check that breaks while it runs is NOT_EXECUTED and harms no other.

    All checks run as one job. Only if that breaks is each one run alone. What reaches the driver is one row per check.
    """
    rows = _rows(spark, validations, comparisons, variables)
    try:
        done = reduce(DataFrame.unionByName, rows).collect()
    except PySparkException:
        done = []
        for row, config in zip(rows, [*validations, *comparisons]):
            try:
                done += row.collect()
            except PySparkException as exc:
                done += _not_executed(spark, config.get("name", ""), _kind(config), exc).collect()
    return spark.createDataFrame(done, rows[0].schema)


def _rows(spark: SparkSession, validations, comparisons, variables) -> list[DataFrame]:
    rows = [run_check(spark, c, variables) for c in validations]
    return rows + [run_comparison(spark, c, variables) for c in comparisons]


def _kind(config: dict) -> str:
    return f"comparison:{config.get('rule', 'match')}" if "query_a" in config else config.get("check_type", "")


def run_check(spark: SparkSession, config: dict, variables: dict[str, str] | None = None) -> DataFrame:
    """One row of ``COLUMNS`` for one check, see ``_check``."""
    return _check(spark, config, variables).select(*COLUMNS)


def run_comparison(spark: SparkSession, config: dict, variables: dict[str, str] | None = None) -> DataFrame:
    """One row of ``COLUMNS`` for one comparison, see ``_comparison``."""
    return _comparison(spark, config, variables).select(*COLUMNS)


def _check(spark: SparkSession, config: dict, variables: dict[str, str] | None) -> DataFrame:
    """One check: ``{"name", "query", "check_type", "condition", ...}``. Every row of its result counts.

    A result that works out its own status passes if all rows do. Rows that agree on WARN or NO_DATA give that
    status; any other row, one with a NULL status too, fails the check. Without rows it is WARN.
    """
    name, kind = config.get("name", ""), _kind(config)
    try:
        df = spark.sql(bind(config["query"], variables or {}))
        order = config.get("order")
        if kind == "rolling_average" and _has_counts(df):
            verdict = checks.rolling_average_verdict(
                df, float(config.get("tolerance", 25)), config.get("warn_only", False)
            )
            largest = {"today_count": F.max("today_cnt"), "baseline_count": F.max("baseline_cnt"), "variance_pct": F.max("variance_pct")}
            return _judged(verdict, name, kind, F.max("variance_pct"), largest)
        if kind == "source_reconciliation":
            verdict = checks.recon_verdict(
                df,
                config.get("source_column", "count_source"),
                config.get("target_column", "count_target"),
                config.get("deviation_threshold", 0),
            )
            deviating = F.any_value("deviating_rows")
            detail = F.concat(deviating.cast("string"), F.lit(" of "), F.any_value("total_rows").cast("string"), F.lit(" rows deviate"))
            return _row(verdict, name, kind, F.any_value("status"), deviating, detail)
        if kind in STATUS_TYPES or (kind == "rolling_average" and "condition" not in config):
            if "status" not in df.columns:
                raise ValueError("the query has no column status")
            rows = df.orderBy(*order).limit(1) if order else df
            return _judged(rows, name, kind, None)
        return checks.check_condition(df, name, config["condition"], kind, "first" if order else "all", order)
    except FAULTS as exc:
        return _not_executed(spark, name, kind, exc)


def _comparison(spark: SparkSession, config: dict, variables: dict[str, str] | None) -> DataFrame:
    """One comparison: ``{"name", "query_a": {"query"}, "query_b": {"query"}, "rule", ...}``."""
    name, rule = config.get("name", ""), config.get("rule", "match")
    kind = f"comparison:{rule}"
    try:
        a, b = (spark.sql(bind(config[side]["query"], variables or {})) for side in ("query_a", "query_b"))
        column = config.get("compare_column") or None
        if rule == "data_diff":
            keys = config.get("key_columns") or column
            if not keys:
                raise ValueError("key_columns is missing")
            diff = compare.data_diff_summary(
                a,
                b,
                [keys] if isinstance(keys, str) else keys,
                config.get("compare_columns", []),
                config.get("case_sensitive", True),
            )
            found = [F.concat(F.lit(f"{c}="), F.any_value(c).cast("string")) for c in ("only_in_a", "only_in_b", "value_mismatches")]
            rows = [F.concat(F.lit(f"{c}="), F.any_value(c).cast("string")) for c in ("rows_a", "rows_b", "duplicates_a", "duplicates_b")]
            return _row(diff, name, kind, F.any_value("status"), F.concat_ws(",", *found), F.concat_ws(",", *rows))
        held = compare.compare(
            a, b, rule, column, float(config.get("tolerance", 0)), config.get("custom_expression"), name
        )
        several = F.when(F.any_value("status") == "NOT_EXECUTED", F.lit("a side has several rows")).otherwise("")
        return _row(held, name, kind, F.any_value("status"), F.concat_ws(" ", _value("a"), _value("b")), several)
    except FAULTS as exc:
        return _not_executed(spark, name, kind, exc)


def _value(side: str) -> Column:
    return F.concat(F.lit(f"{side}="), F.coalesce(F.any_value(f"value_{side}").cast("string"), F.lit("NULL")))


def _has_counts(df: DataFrame) -> bool:
    today, base = checks.count_columns(df)
    return "variance_pct" in df.columns or (today is not None and base is not None)


def _judged(df: DataFrame, name: str, kind: str, actual: Column | None, more: dict[str, Column] | None = None) -> DataFrame:
    """The status of all rows of ``df`` together; by default the smallest status that is not in order is shown."""
    status = F.coalesce(F.upper(F.col("status").cast("string")), F.lit("NULL"))
    bad = F.when(~status.isin(*GOOD_STATUSES), status)
    n, n_bad, least, most = F.count(F.lit(1)), F.count(bad), F.min(bad), F.max(bad)
    verdict = (
        F.when(n == 0, "WARN").when(n_bad == 0, "PASS").when((least == most) & least.isin(*KEPT_STATUSES), least).otherwise("FAIL")
    )
    detail = F.when(n == 0, "no rows").otherwise(F.concat(n_bad.cast("string"), F.lit(" of "), n.cast("string"), F.lit(" rows not in order")))
    shown = F.coalesce(least, F.min(status)) if actual is None else actual
    return _row(df, name, kind, verdict, shown, detail, more)


def _row(
    df: DataFrame, name: str, kind: str, status: Column, actual: Column, detail: Column, more: dict[str, Column] | None = None
) -> DataFrame:
    return df.agg(
        F.lit(name).alias("name"),
        F.lit(kind).alias("check_type"),
        status.alias("status"),
        detail.alias("detail"),
        actual.cast("string").alias("actual_value"),
        *(c.alias(n) for n, c in (more or {}).items()),
    )


def _not_executed(spark: SparkSession, name: str, kind: str, exc) -> DataFrame:
    if isinstance(exc, PySparkException):
        reason = exc.getCondition() or "ANALYSIS_ERROR"
    else:
        reason = f"{exc.args[0]} is missing" if isinstance(exc, KeyError) else str(exc)
    return spark.range(1).select(
        F.lit(name).alias("name"),
        F.lit(kind).alias("check_type"),
        F.lit("NOT_EXECUTED").alias("status"),
        F.lit(reason).alias("detail"),
        F.lit(None).cast("string").alias("actual_value"),
    )
