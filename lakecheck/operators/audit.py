"""Roll-ups over audit records.

Audit tables are partitioned by ``run_date`` (text, ISO), so every range predicate below is on that bare
column and prunes partitions. Each roll-up is one aggregation.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakecheck.functions.exprs import first_match, like_any, number_or_zero, percent, when_status

# ---- fixed values ------------------------------------------------------------------------------
CHECK_EVENTS = ("VALIDATION", "COMPARISON")
EVENT_KINDS = ("VALIDATION", "COMPARISON", "STALE_CHECK", "GLUE_TRIGGER", "SUMMARY_QUERY")
LAYER_ORDER = ("STAGING", "DATALAKE", "BASE", "MASTER", "SUMMARY")
PASS_STATUSES = ("PASS", "OK")
FAIL_STATUSES = ("FAIL", "Stale", "Check with Source", "ABORTED")
WARNING_STATUSES = ("SKIPPED", "Check with Source")
HISTORY_STATUSES = ("FAIL", "ABORTED", "Stale", "Check with Source")
# check type or a word in the name, to the quality dimension
DIMENSIONS = {
    "row_count": "Completeness",
    "no_rows": "Validity",
    "threshold": "Accuracy",
    "freshness": "Freshness",
    "volume": "Volume",
    "uniqueness": "Uniqueness",
}
LAYER_PATTERNS = (
    (("%staging%", "%stg%"), "Staging"),
    (("%datalake%", "%dl%"), "DataLake"),
    (("%base%",), "Base"),
    (("%master%",), "Master"),
)
DIMENSION_PATTERNS = (
    (("%row_count%", "%completeness%"), "Completeness"),
    (("%comparison%", "%accuracy%"), "Accuracy"),
    (("%date%", "%format%", "%validity%"), "Validity"),
    (("%fresh%",), "Freshness"),
    (("%volume%", "%rolling%"), "Volume"),
    (("%no_rows%", "%duplicate%", "%null%", "%unique%"), "Uniqueness"),
)
# ------------------------------------------------------------------------------------------------


def has_status(*statuses: str) -> Column:
    return F.count_if(F.col("status").isin(*statuses))


def total_cost(digits: int = 4, column: str = "cost_usd") -> Column:
    """Cost text summed as exact decimals; blanks are 0."""
    return F.round(F.sum(number_or_zero(column)), digits).cast("double")


def _rows() -> Column:
    return F.count(F.lit(1))


def _any_failed() -> Column:
    """FAIL as soon as one record says so."""
    return F.when(F.bool_or(F.col("overall_status") == "FAIL"), "FAIL").otherwise("PASS")


def _last_date() -> Column:
    """Latest run date as text. Dates are compared as dates: a maximum over text would need a sort aggregate."""
    return F.max(F.col("run_date").try_cast("date")).cast("string")


def of_kind(*kinds: str) -> Column:
    """Events of these kinds, with or without a layer before the kind."""
    return F.col("event_type").rlike(f"^(.+_)?({'|'.join(kinds)})$")


def since(audit: DataFrame, as_of: date, days: int) -> DataFrame:
    return audit.filter(F.col("run_date") >= (as_of - timedelta(days=days)).isoformat())


def of_day(audit: DataFrame, day: date) -> DataFrame:
    return audit.filter(F.col("run_date") == day.isoformat())


def checks_only(audit: DataFrame) -> DataFrame:
    return audit.filter(of_kind(*CHECK_EVENTS))


def latest_run(audit: DataFrame, day: date) -> DataFrame:
    return of_day(audit, day).orderBy("event_timestamp", "run_id")


def failure_history(audit: DataFrame, as_of: date, days: int = 7) -> DataFrame:
    failed = since(audit, as_of, days).filter(F.col("status").isin(*HISTORY_STATUSES))
    return failed.orderBy(F.desc("run_date"), "event_timestamp")


# ---- union of event shapes ---------------------------------------------------------------------


def union_events(shapes: dict[str, DataFrame], layer: str | None = None) -> DataFrame:
    """Stack differently shaped events; a column an event lacks is NULL. The layer prefixes the type."""
    frames = [
        df.withColumn("event_type", F.lit(f"{layer}_{kind}" if layer else kind)) for kind, df in shapes.items()
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


# The columns of an audit row, in the order of the audit table.
AUDIT_COLUMNS = (
    "run_id", "event_timestamp", "event_type", "source_label", "source_bucket", "source_prefix", "subfolder_count", "status",
    "detail", "glue_job_name", "glue_job_run_id", "glue_duration_sec", "validation_name", "check_type", "actual_value", "query",
    "cost_usd", "failure_reason", "today_count", "baseline_count", "variance_pct", "tolerance", "window_start", "window_end",
    "overall_status", "run_date",
)


def audit_rows(shapes: dict[str, DataFrame], run_id: str, as_of: datetime, layer: str | None = None) -> DataFrame:
    """Events of a run as full audit rows, all text; what an event lacks is NULL. One failed event fails the run."""
    named = {k: df.withColumnRenamed("name", "validation_name") if "name" in df.columns else df for k, df in shapes.items()}
    events = union_events(named, layer)
    own = {
        "run_id": F.lit(run_id),
        "event_timestamp": F.lit(as_of.isoformat()),
        "run_date": F.lit(as_of.date().isoformat()),
        "overall_status": events.agg(F.when(F.bool_or(F.col("status") == "FAIL"), "FAIL").otherwise("PASS")).scalar(),
    }
    picked = [own.get(c, F.col(c) if c in events.columns else F.lit(None)).cast("string").alias(c) for c in AUDIT_COLUMNS]
    return events.select(*picked)


def latest_failures(
    rule_rows: DataFrame, since_ts: Column, run_id: str | None = None, suite: str | None = None, limit: int | None = None
) -> DataFrame:
    """Failed rule rows, newest first; the newest ``limit`` of them where a limit is given."""
    kept = (F.col("status") == "FAIL") & (F.col("failure_timestamp") >= since_ts)
    if run_id:
        kept = kept & (F.col("run_id") == run_id)
    if suite:
        kept = kept & (F.col("pipeline_name") == suite)
    newest = rule_rows.filter(kept).orderBy(F.desc("failure_timestamp"), "record_id")
    return newest if limit is None else newest.limit(limit)


# ---- day summary -------------------------------------------------------------------------------


def by_layer(audit: DataFrame, day: date) -> DataFrame:
    return (
        of_day(audit, day)
        .groupBy("event_type")
        .agg(
            _rows().alias("total_checks"),
            has_status("PASS").alias("pass_count"),
            has_status("FAIL").alias("fail_count"),
            has_status("WARN").alias("warn_count"),
            has_status("NOT_EXECUTED").alias("not_exec_count"),
            total_cost().alias("total_cost"),
        )
    )


def by_run(audit: DataFrame, day: date, by: tuple[str, ...] = ("run_id",)) -> DataFrame:
    return (
        of_day(audit, day)
        .groupBy(*by)
        .agg(
            _any_failed().alias("overall_status"),
            _rows().alias("event_count"),
            has_status("PASS").alias("pass_count"),
            has_status("FAIL").alias("fail_count"),
            total_cost().alias("total_cost"),
            F.min("event_timestamp").alias("first_event"),
            F.max("event_timestamp").alias("last_event"),
        )
    )


def by_run_and_type(audit: DataFrame, day: date) -> DataFrame:
    return by_run(audit, day, ("run_id", "event_type"))


def day_totals(audit: DataFrame, day: date) -> DataFrame:
    failed = has_status("FAIL")
    return of_day(audit, day).agg(
        _rows().alias("total"),
        has_status("PASS").alias("passed"),
        failed.alias("failed"),
        has_status("WARN").alias("warned"),
        has_status("NOT_EXECUTED").alias("not_executed"),
        percent(has_status("PASS"), _rows(), 1).alias("pass_rate"),
        total_cost().alias("total_cost"),
        F.count_distinct("run_id").alias("distinct_runs"),
        when_status(failed == 0).alias("overall_status"),
    )


def layer_of(event_type: str = "event_type") -> Column:
    """The part before the event kind; a bare kind is its own layer."""
    pattern = f"^(.+)_({'|'.join(EVENT_KINDS)})$"
    prefix = F.regexp_extract(F.col(event_type), pattern, 1)
    return F.when(prefix == "", F.col(event_type)).otherwise(prefix)


def runs_by_layer(audit: DataFrame, day: date) -> DataFrame:
    """Layers of a day in canonical order, other layers after them by name."""
    runs = by_run_and_type(audit, day).withColumn("layer", layer_of())
    position = F.lit(len(LAYER_ORDER) + 1)
    for i, name in enumerate(LAYER_ORDER, start=1):
        position = F.when(F.col("layer") == name, F.lit(i)).otherwise(position)
    return (
        runs.groupBy("layer")
        .agg(
            _rows().alias("runs"),
            F.sum("event_count").alias("events"),
            when_status(F.bool_and(F.col("overall_status") == "PASS")).alias("layer_status"),
        )
        .withColumn("layer_order", position)
        .orderBy("layer_order", "layer")
    )


# ---- dashboards --------------------------------------------------------------------------------


def daily_validation(audit: DataFrame, as_of: date, days: int = 7) -> DataFrame:
    return (
        checks_only(since(audit, as_of, days))
        .groupBy("run_date")
        .agg(
            has_status("PASS").alias("passed"),
            has_status("FAIL").alias("failed"),
            has_status("WARN").alias("warnings"),
            has_status("NOT_EXECUTED").alias("not_executed"),
            _rows().alias("total"),
        )
    )


def daily_pass_rate(audit: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    return (
        checks_only(since(audit, as_of, days))
        .groupBy("run_date")
        .agg(
            has_status("PASS").alias("passed"),
            has_status("FAIL").alias("failed"),
            _rows().alias("total"),
            percent(has_status("PASS"), _rows()).alias("pass_rate"),
        )
    )


def _labelled(column: str, patterns) -> Column:
    return first_match("Other", *[(like_any(column, *likes), label) for likes, label in patterns])


def _pass_rate_by(audit: DataFrame, as_of: date, days: int, label: Column, name: str) -> DataFrame:
    return (
        checks_only(since(audit, as_of, days))
        .groupBy(label.alias(name))
        .agg(
            _rows().alias("total_checks"),
            has_status("PASS").alias("passed"),
            percent(has_status("PASS"), _rows()).alias("pass_rate"),
        )
    )


def pass_rate_by_layer(audit: DataFrame, as_of: date, days: int = 7) -> DataFrame:
    return _pass_rate_by(audit, as_of, days, _labelled("source_label", LAYER_PATTERNS), "layer")


def quality_dimensions(audit: DataFrame, as_of: date, days: int = 7) -> DataFrame:
    return _pass_rate_by(audit, as_of, days, _labelled("check_type", DIMENSION_PATTERNS), "dimension")


def cost_trend(audit: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    return since(audit, as_of, days).groupBy("run_date").agg(total_cost().alias("daily_cost"))


def top_failing(audit: DataFrame, as_of: date, days: int = 7, k: int = 10) -> DataFrame:
    failed = checks_only(since(audit, as_of, days)).filter(F.col("status").isin("FAIL", "NOT_EXECUTED"))
    return (
        failed.groupBy("validation_name", "check_type")
        .agg(_rows().alias("failure_count"), _last_date().alias("last_failure"))
        .orderBy(F.desc("failure_count"), "validation_name", "check_type")
        .limit(k)
    )


# ---- scorecard ---------------------------------------------------------------------------------


def is_pass() -> Column:
    return F.col("status").isin(*PASS_STATUSES)


def is_fail() -> Column:
    return F.col("status").isin(*FAIL_STATUSES)


def dimension_of(check_type: str = "check_type", name: str = "validation_name") -> Column:
    """By exact check type, else by the first listed word in the name, else Validity; Other if both blank."""
    kind, label = F.lower(F.trim(F.col(check_type))), F.lower(F.trim(F.col(name)))
    kind, label = F.coalesce(kind, F.lit("")), F.coalesce(label, F.lit(""))
    exact = [(kind == word, dimension) for word, dimension in DIMENSIONS.items()]
    named = [(label.contains(word), dimension) for word, dimension in DIMENSIONS.items()]
    return first_match("Other", *exact, *named, ((kind != "") | (label != ""), "Validity"))


def check_id() -> Column:
    """The first of name, source and event type that is not blank."""
    name, source = (F.nullif(F.trim(F.col(c)), F.lit("")) for c in ("validation_name", "source_label"))
    return F.coalesce(name, source, F.col("event_type"))


def scorecard(audit: DataFrame) -> DataFrame:
    return audit.agg(
        _rows().alias("total_checks"),
        F.coalesce(percent(F.count_if(is_pass()), _rows()), F.lit(0.0)).alias("pass_rate"),
        has_status(*WARNING_STATUSES).alias("warnings"),
        F.count_if(is_fail()).alias("failures"),
        has_status("ABORTED").alias("fatal"),
    )


def pass_fail_by(audit: DataFrame, *by: Column | str) -> DataFrame:
    """Passes, failures, total and pass rate by any grouping."""
    return audit.groupBy(*by).agg(
        F.count_if(is_pass()).alias("passes"),
        F.count_if(is_fail()).alias("failures"),
        F.count("status").alias("total"),
        percent(F.count_if(is_pass()), F.count("status")).alias("pass_rate"),
    )


def daily_trend(audit: DataFrame, as_of: date, days: int = 7) -> DataFrame:
    return pass_fail_by(since(audit, as_of, days), "run_date")


def pass_rate_by_source(audit: DataFrame, as_of: date, days: int = 7) -> DataFrame:
    """By source label; where no row has one, by validation name. One aggregation decides and counts."""
    source, name = F.trim(F.col("source_label")), F.trim(F.col("validation_name"))
    levels = since(audit, as_of, days).select(
        "status",
        F.explode(
            F.array(
                F.struct(F.lit(1).alias("level"), source.alias("source")),
                F.struct(F.lit(2).alias("level"), name.alias("source")),
            )
        ).alias("s"),
    )
    counted = (
        levels.filter(F.col("s.source") != "")
        .groupBy("s.level", "s.source")
        .agg(F.count_if(is_pass()).alias("passes"), F.count("status").alias("total"))
    )
    level = counted.agg(F.min("level")).scalar()
    return counted.filter(F.col("level") == level).select(
        "source", "passes", "total", percent(F.col("passes"), F.col("total")).alias("pass_rate")
    )


def weekly(audit: DataFrame) -> DataFrame:
    day = F.to_date("run_date")
    year = F.extract(F.lit("YEAROFWEEK"), day).cast("string")
    week = F.lpad(F.extract(F.lit("WEEK"), day).cast("string"), 2, "0")
    return pass_fail_by(audit, F.concat(year, F.lit("-W"), week).alias("year_week"))


def by_dimension(audit: DataFrame) -> DataFrame:
    return pass_fail_by(audit.withColumn("dimension", dimension_of()).filter(F.col("dimension") != "Other"), "dimension")


def sla_trend(audit: DataFrame, threshold: float = 95.0) -> DataFrame:
    return pass_fail_by(audit, "run_date").select(
        "run_date", "passes", "total", "pass_rate", (F.col("pass_rate") >= threshold).alias("sla_met")
    )


def top_failing_checks(audit: DataFrame, k: int = 15) -> DataFrame:
    return (
        audit.filter(is_fail())
        .groupBy(check_id().alias("check_id"))
        .agg(_rows().alias("failure_count"), _last_date().alias("last_failure"))
        .orderBy(F.desc("failure_count"), "check_id")
        .limit(k)
    )


def run_history(audit: DataFrame) -> DataFrame:
    """Records per run with its overall status, newest run first."""
    return (
        audit.groupBy("run_date", "run_id")
        .agg(
            _rows().alias("records"),
            F.count_if(is_pass()).alias("passes"),
            F.count_if(is_fail()).alias("failures"),
            _any_failed().alias("overall_status"),
        )
        .orderBy(F.desc("run_date"), F.desc("run_id"))
    )


def job_duration_trend(audit: DataFrame) -> DataFrame:
    seconds = F.sum(number_or_zero("glue_duration_sec", "decimal(18,3)"))
    return (
        audit.filter(of_kind("GLUE_TRIGGER"))
        .groupBy("run_date")
        .agg(
            F.round(seconds.cast("double") / 60, 1).alias("total_duration_min"),
            _rows().alias("job_count"),
        )
    )


def day_kpis(audit: DataFrame, day: date) -> DataFrame:
    """Checks of a day by status, pass rate and cost."""
    check = of_kind(*CHECK_EVENTS)
    total, passed = F.count_if(check), F.count_if(check & (F.col("status") == "PASS"))
    cost = F.sum(F.when(check, number_or_zero("cost_usd")))
    return of_day(audit, day).agg(
        total.alias("total_checks"),
        passed.alias("passed"),
        F.count_if(check & (F.col("status") == "FAIL")).alias("failed"),
        F.count_if(check & (F.col("status") == "WARN")).alias("warned"),
        F.count_if(check & (F.col("status") == "NOT_EXECUTED")).alias("not_executed"),
        F.coalesce(percent(passed, total), F.lit(0.0)).alias("pass_rate"),
        F.round(F.coalesce(cost, F.lit(0)), 4).cast("double").alias("total_cost"),
    )


def day_run_ids(audit: DataFrame, day: date) -> DataFrame:
    """The runs of a day, one row each: a list of unknown length stays a table."""
    return of_day(audit, day).filter(F.col("run_id") != "").select("run_id").distinct().orderBy("run_id")


# ---- load runs ---------------------------------------------------------------------------------


def load_cost_history(steps: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    return (
        since(steps, as_of, days)
        .groupBy("run_date", "pipeline_name")
        .agg(
            total_cost(6).alias("total_cost"),
            F.count_distinct("run_id").alias("runs"),
            _rows().alias("total_steps"),
        )
    )


def failed_steps(steps: DataFrame, as_of: date, days: int = 7) -> DataFrame:
    failed = since(steps, as_of, days).filter(F.col("status").isin("FAIL", "ABORTED"))
    return failed.orderBy(F.desc("run_date"), "event_timestamp")


def rollback_history(steps: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    undone = since(steps, as_of, days).filter(F.col("rollback_executed") == "true")
    return undone.orderBy(F.desc("run_date"), "event_timestamp")


def step_duration_trends(steps: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    """Mean and longest duration of passed steps; a blank duration counts as 0."""
    seconds = number_or_zero("duration_sec", "decimal(18,2)")
    return (
        since(steps, as_of, days)
        .filter(F.col("status") == "PASS")
        .groupBy("pipeline_name", "step_name")
        .agg(
            F.round(F.sum(seconds).cast("double") / F.count(seconds), 4).alias("avg_duration"),
            F.max(seconds).cast("double").alias("max_duration"),
            _rows().alias("executions"),
        )
    )


def step_summary(steps: DataFrame) -> DataFrame:
    return steps.agg(
        _rows().alias("total_steps"),
        has_status("PASS").alias("passed"),
        has_status("FAIL").alias("failed"),
        has_status("SKIPPED", "NOT_EXECUTED").alias("skipped"),
        has_status("ABORTED").alias("aborted"),
        F.count_if(F.col("rollback_executed") == "true").alias("rolled_back"),
        F.sum(number_or_zero("duration_sec", "decimal(18,2)")).cast("double").alias("total_seconds"),
        total_cost(6).alias("total_cost"),
    )


def checks_by_category(results: DataFrame) -> DataFrame:
    """Status counts per category; balance first, anomaly second, the rest by name.

    The pass rate leaves informational and broken checks out.
    """
    judged = F.col("passed") + F.col("failed") + F.col("warned")
    order = F.when(F.col("category") == "balance", 0).when(F.col("category") == "anomaly", 1).otherwise(99)
    return (
        results.groupBy("category")
        .agg(
            has_status("PASS").alias("passed"),
            has_status("FAIL").alias("failed"),
            has_status("WARN").alias("warned"),
            has_status("INFO").alias("info"),
            has_status("ERROR").alias("errors"),
        )
        .withColumn("pass_rate", F.coalesce(percent(F.col("passed"), judged), F.lit(0.0)))
        .withColumn("category_order", order)
        .orderBy("category_order", "category")
    )
