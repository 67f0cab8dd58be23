"""Roll-ups over audit records."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakecheck.functions.exprs import instant, scan_cost
from lakecheck.operators import audit
from lakecheck.plans.inputs import EVENTS_DAY, EVENTS_NOW, Inputs
from lakecheck.plans.registry import n_if, passes, pct, query

DAY = f"run_date = '{EVENTS_DAY}'"
CHECKS = "regexp_matches(event_type, '^(.+_)?(VALIDATION|COMPARISON)$')"
COST = "sum(coalesce(TRY_CAST(cost_usd AS DECIMAL(18,6)), 0))"
PASS = "status IN ('PASS', 'OK')"
FAIL = "status IN ('FAIL', 'Stale', 'Check with Source', 'ABORTED')"


def status(name: str) -> str:
    return n_if(f"status = '{name}'")


def cost(digits: int) -> str:
    return f"CAST(round({COST}, {digits}) AS DOUBLE)"


def case_like(column: str, patterns) -> str:
    likes = [" OR ".join(f"{column} LIKE '{p}'" for p in group) for group, _ in patterns]
    return "CASE " + " ".join(f"WHEN {like} THEN '{label}'" for like, (_, label) in zip(likes, patterns)) + " ELSE 'Other' END"


def since(days: int) -> str:
    return f"run_date >= CAST(DATE '{EVENTS_DAY}' - {days} AS VARCHAR)"


ANY_FAILED = "CASE WHEN bool_or(overall_status = 'FAIL') THEN 'FAIL' ELSE 'PASS' END"
RUN = f"""{ANY_FAILED} AS overall_status, count(*) AS event_count, {status('PASS')} AS pass_count,
    {status('FAIL')} AS fail_count, {cost(4)} AS total_cost, min(event_timestamp) AS first_event, max(event_timestamp) AS last_event"""

# ---- listings and top-k ------------------------------------------------------------------------

query(
    "latest_run_summary",
    f"SELECT run_id, event_type, event_timestamp, status, validation_name FROM audit WHERE {DAY}",
)(
    lambda t: audit.latest_run(t.audit, EVENTS_DAY).select(
        "run_id", "event_type", "event_timestamp", "status", "validation_name"
    )
)
query(
    "failure_history_7d",
    f"""SELECT run_date, run_id, event_type, source_label, validation_name, status FROM audit
        WHERE {since(7)} AND status IN ('FAIL', 'ABORTED', 'Stale', 'Check with Source')""",
)(
    lambda t: audit.failure_history(t.audit, EVENTS_DAY).select(
        "run_date", "run_id", "event_type", "source_label", "validation_name", "status"
    )
)
query(
    "topk_failing_checks",
    f"""SELECT validation_name, check_type, count(*) AS failure_count, max(run_date) AS last_failure FROM audit
        WHERE {CHECKS} AND status IN ('FAIL', 'NOT_EXECUTED') AND {since(7)}
        GROUP BY ALL ORDER BY failure_count DESC, validation_name, check_type LIMIT 10""",
)(lambda t: audit.top_failing(t.audit, EVENTS_DAY))
query(
    "topk_failing_checks_dashboard",
    f"""SELECT coalesce(NULLIF(trim(validation_name), ''), NULLIF(trim(source_label), ''), event_type) AS check_id,
        count(*) AS failure_count, max(run_date) AS last_failure FROM audit WHERE {FAIL}
        GROUP BY 1 ORDER BY failure_count DESC, check_id LIMIT 15""",
)(lambda t: audit.top_failing_checks(t.audit))


LATEST = f"""SELECT record_id, rule_name, failure_timestamp FROM failures WHERE classification = 'TRUE_FAILURE'
        AND failure_timestamp >= TIMESTAMP '{EVENTS_NOW}' - INTERVAL 24 HOUR"""


def latest_failures(t: Inputs, limit: int | None = None):
    status_ = F.when(F.col("classification") == "TRUE_FAILURE", "FAIL").otherwise("PASS")
    day_before = instant(EVENTS_NOW.replace(day=EVENTS_NOW.day - 1))
    newest = audit.latest_failures(t.failures.withColumn("status", status_), day_before, limit=limit)
    return newest.select("record_id", "rule_name", "failure_timestamp")


query("latest_failures", LATEST)(latest_failures)
query("latest_failures_top_10", f"{LATEST} ORDER BY failure_timestamp DESC, record_id LIMIT 10")(lambda t: latest_failures(t, 10))


# ---- union of event shapes ---------------------------------------------------------------------


@query(
    "audit_union_events",
    """SELECT run_id, run_date, 'BASE_STALE_CHECK' AS event_type, source_label, NULL AS glue_duration_sec, NULL AS validation_name,
        NULL AS check_type, status, NULL AS cost_usd FROM audit WHERE event_type LIKE '%STALE_CHECK'
       UNION ALL SELECT run_id, run_date, 'BASE_GLUE_TRIGGER', source_label, glue_duration_sec, NULL, NULL, status, NULL
        FROM audit WHERE event_type LIKE '%GLUE_TRIGGER'
       UNION ALL SELECT run_id, run_date, 'BASE_VALIDATION', NULL, NULL, validation_name, check_type, status, cost_usd
        FROM audit WHERE event_type LIKE '%VALIDATION'
       UNION ALL SELECT run_id, run_date, 'BASE_COMPARISON', NULL, NULL, validation_name, 'comparison:' || check_type, status, cost_usd
        FROM audit WHERE event_type LIKE '%COMPARISON'
       UNION ALL SELECT run_id, run_date, 'BASE_SUMMARY_QUERY', NULL, NULL, validation_name, 'summary', status, NULL
        FROM audit WHERE event_type LIKE '%SUMMARY_QUERY'""",
)
def _(t: Inputs):
    def of(kind: str, *columns):
        return t.audit.filter(F.col("event_type").endswith(kind)).select("run_id", "run_date", "status", *columns)

    compared = F.concat(F.lit("comparison:"), "check_type").alias("check_type")
    return audit.union_events(
        {
            "STALE_CHECK": of("STALE_CHECK", "source_label"),
            "GLUE_TRIGGER": of("GLUE_TRIGGER", "source_label", "glue_duration_sec"),
            "VALIDATION": of("VALIDATION", "validation_name", "check_type", "cost_usd"),
            "COMPARISON": of("COMPARISON", "validation_name", compared, "cost_usd"),
            "SUMMARY_QUERY": of("SUMMARY_QUERY", "validation_name", F.lit("summary").alias("check_type")),
        },
        layer="BASE",
    )


# ---- day summary -------------------------------------------------------------------------------

query(
    "audit_by_layer",
    f"""SELECT event_type, count(*) AS total_checks, {status('PASS')} AS pass_count, {status('FAIL')} AS fail_count,
        {status('WARN')} AS warn_count, {status('NOT_EXECUTED')} AS not_exec_count, {cost(4)} AS total_cost
        FROM audit WHERE {DAY} GROUP BY 1""",
)(lambda t: audit.by_layer(t.audit, EVENTS_DAY))
query("audit_by_run", f"SELECT run_id, {RUN} FROM audit WHERE {DAY} GROUP BY 1")(lambda t: audit.by_run(t.audit, EVENTS_DAY))
query("audit_by_run_layer", f"SELECT run_id, event_type, {RUN} FROM audit WHERE {DAY} GROUP BY ALL")(
    lambda t: audit.by_run_and_type(t.audit, EVENTS_DAY)
)
query(
    "audit_day_totals",
    f"""SELECT count(*) AS total, {status('PASS')} AS passed, {status('FAIL')} AS failed, {status('WARN')} AS warned,
        {status('NOT_EXECUTED')} AS not_executed, {pct(status('PASS'), 'count(*)')} AS pass_rate, {cost(4)} AS total_cost,
        count(DISTINCT run_id) AS distinct_runs, {passes(status('FAIL') + ' = 0')} AS overall_status FROM audit WHERE {DAY}""",
)(lambda t: audit.day_totals(t.audit, EVENTS_DAY))
query(
    "audit_runs_by_layer_order",
    f"""WITH r AS (SELECT run_id, event_type, {RUN} FROM audit WHERE {DAY} GROUP BY ALL),
        l AS (SELECT *, regexp_replace(event_type, '_(VALIDATION|COMPARISON|STALE_CHECK|GLUE_TRIGGER|SUMMARY_QUERY)$', '') AS layer FROM r)
        SELECT layer, count(*) AS runs, CAST(sum(event_count) AS BIGINT) AS events,
        {passes("bool_and(overall_status = 'PASS')")} AS layer_status,
        CASE layer WHEN 'STAGING' THEN 1 WHEN 'DATALAKE' THEN 2 WHEN 'BASE' THEN 3 WHEN 'MASTER' THEN 4 WHEN 'SUMMARY' THEN 5 ELSE 6 END AS layer_order
        FROM l GROUP BY layer""",
)(lambda t: audit.runs_by_layer(t.audit, EVENTS_DAY))

# ---- dashboards --------------------------------------------------------------------------------

query(
    "dash_daily_validation_7d",
    f"""SELECT run_date, {status('PASS')} AS passed, {status('FAIL')} AS failed, {status('WARN')} AS warnings,
        {status('NOT_EXECUTED')} AS not_executed, count(*) AS total FROM audit WHERE {CHECKS} AND {since(7)} GROUP BY 1""",
)(lambda t: audit.daily_validation(t.audit, EVENTS_DAY))
query(
    "dash_daily_pass_rate_30d",
    f"""SELECT run_date, {status('PASS')} AS passed, {status('FAIL')} AS failed, count(*) AS total,
        {pct(status('PASS'), 'count(*)')} AS pass_rate FROM audit WHERE {CHECKS} AND {since(30)} GROUP BY 1""",
)(lambda t: audit.daily_pass_rate(t.audit, EVENTS_DAY))
RATE_BY = f"count(*) AS total_checks, {status('PASS')} AS passed, {pct(status('PASS'), 'count(*)')} AS pass_rate"
query(
    "dash_pass_rate_by_layer",
    f"SELECT {case_like('source_label', audit.LAYER_PATTERNS)} AS layer, {RATE_BY} FROM audit WHERE {CHECKS} AND {since(7)} GROUP BY 1",
)(lambda t: audit.pass_rate_by_layer(t.audit, EVENTS_DAY))
query(
    "dash_quality_dimensions",
    f"""SELECT CASE WHEN check_type = 'row_count' THEN 'Completeness' WHEN check_type = 'rolling_average' THEN 'Volume'
        WHEN check_type = 'no_rows' THEN 'Uniqueness' ELSE 'Other' END AS dimension, {RATE_BY}
        FROM audit WHERE {CHECKS} AND {since(7)} GROUP BY 1""",
)(lambda t: audit.quality_dimensions(t.audit, EVENTS_DAY))
query("dash_cost_trend_30d", f"SELECT run_date, {cost(4)} AS daily_cost FROM audit WHERE {since(30)} GROUP BY 1")(
    lambda t: audit.cost_trend(t.audit, EVENTS_DAY)
)

# ---- scorecard ---------------------------------------------------------------------------------

PASS_FAIL = f"""{n_if(PASS)} AS passes, {n_if(FAIL)} AS failures, count(status) AS total, {pct(n_if(PASS), 'count(status)')} AS pass_rate"""
DIMENSION = """CASE WHEN check_type = 'row_count' THEN 'Completeness' WHEN check_type = 'no_rows' THEN 'Validity'
    WHEN check_type = 'threshold' THEN 'Accuracy' WHEN check_type <> '' OR validation_name <> '' THEN 'Validity' ELSE 'Other' END"""

query(
    "dq_classify_dimension",
    f"SELECT run_id, check_type, validation_name, {DIMENSION} AS dimension FROM audit",
)(lambda t: t.audit.select("run_id", "check_type", "validation_name", audit.dimension_of().alias("dimension")))
query(
    "dq_scorecard",
    f"""SELECT count(*) AS total_checks, {pct(n_if(PASS), 'count(*)')} AS pass_rate,
        {n_if("status IN ('SKIPPED', 'Check with Source')")} AS warnings, {n_if(FAIL)} AS failures, {status('ABORTED')} AS fatal FROM audit""",
)(lambda t: audit.scorecard(t.audit))
query("dq_daily_trend", f"SELECT run_date, {PASS_FAIL} FROM audit WHERE {since(7)} GROUP BY 1")(
    lambda t: audit.daily_trend(t.audit, EVENTS_DAY)
)
query(
    "dq_pass_rate_by_source",
    f"""SELECT source_label AS source, {n_if(PASS)} AS passes, count(status) AS total, {pct(n_if(PASS), 'count(status)')} AS pass_rate
        FROM audit WHERE {since(7)} AND trim(source_label) <> '' GROUP BY 1""",
)(lambda t: audit.pass_rate_by_source(t.audit, EVENTS_DAY))
query(
    "agg_weekly_iso",
    f"""SELECT CAST(isoyear(CAST(run_date AS DATE)) AS VARCHAR) || '-W' || lpad(CAST(week(CAST(run_date AS DATE)) AS VARCHAR), 2, '0') AS year_week,
        {PASS_FAIL} FROM audit GROUP BY 1""",
)(lambda t: audit.weekly(t.audit))
query(
    "dq_by_dimension",
    f"WITH d AS (SELECT *, {DIMENSION} AS dimension FROM audit) SELECT dimension, {PASS_FAIL} FROM d WHERE dimension <> 'Other' GROUP BY 1",
)(lambda t: audit.by_dimension(t.audit))
query(
    "dq_sla_trend",
    f"""SELECT run_date, {n_if(PASS)} AS passes, count(status) AS total, {pct(n_if(PASS), 'count(status)')} AS pass_rate,
        {pct(n_if(PASS), 'count(status)')} >= 75 AS sla_met FROM audit GROUP BY 1""",
)(lambda t: audit.sla_trend(t.audit, 75))
query(
    "dq_run_history",
    f"""SELECT run_date, run_id, count(*) AS records, {n_if(PASS)} AS passes, {n_if(FAIL)} AS failures, {ANY_FAILED} AS overall_status
        FROM audit GROUP BY ALL""",
)(lambda t: audit.run_history(t.audit))
query(
    "dq_job_duration_trend",
    """SELECT run_date, round(CAST(sum(coalesce(TRY_CAST(glue_duration_sec AS DECIMAL(18,3)), 0)) AS DOUBLE) / 60, 1) AS total_duration_min,
        count(*) AS job_count FROM audit WHERE regexp_matches(event_type, '^(.+_)?GLUE_TRIGGER$') GROUP BY 1""",
)(lambda t: audit.job_duration_trend(t.audit))


def checked(name: str) -> str:
    return n_if(f"{CHECKS} AND status = '{name}'")


query(
    "tab_day_kpis",
    f"""SELECT {n_if(CHECKS)} AS total_checks, {checked('PASS')} AS passed, {checked('FAIL')} AS failed, {checked('WARN')} AS warned,
        {checked('NOT_EXECUTED')} AS not_executed, coalesce({pct(checked('PASS'), n_if(CHECKS))}, 0) AS pass_rate,
        CAST(round(coalesce({COST} FILTER (WHERE {CHECKS}), 0), 4) AS DOUBLE) AS total_cost FROM audit WHERE {DAY}""",
)(lambda t: audit.day_kpis(t.audit, EVENTS_DAY))
query("tab_day_run_ids", f"SELECT DISTINCT run_id FROM audit WHERE {DAY} AND run_id <> ''")(
    lambda t: audit.day_run_ids(t.audit, EVENTS_DAY)
)

# ---- load runs ---------------------------------------------------------------------------------

STEP = "run_date, run_id, pipeline_name, step_name, step_type, status, rollback_executed"

query(
    "pipe_latest_run",
    f"SELECT {STEP} FROM pipe_audit WHERE {DAY}",
)(lambda t: audit.latest_run(t.pipe_audit, EVENTS_DAY).select(*STEP.split(", ")))
query(
    "pipe_cost_history",
    f"""SELECT run_date, pipeline_name, {cost(6)} AS total_cost, count(DISTINCT run_id) AS runs, count(*) AS total_steps
        FROM pipe_audit WHERE {since(30)} GROUP BY ALL""",
)(lambda t: audit.load_cost_history(t.pipe_audit, EVENTS_DAY))
query("pipe_failed_steps", f"SELECT {STEP} FROM pipe_audit WHERE {since(7)} AND status IN ('FAIL', 'ABORTED')")(
    lambda t: audit.failed_steps(t.pipe_audit, EVENTS_DAY).select(*STEP.split(", "))
)
query("pipe_rollback_history", f"SELECT {STEP} FROM pipe_audit WHERE {since(30)} AND rollback_executed = 'true'")(
    lambda t: audit.rollback_history(t.pipe_audit, EVENTS_DAY).select(*STEP.split(", "))
)
SECONDS = "coalesce(TRY_CAST(duration_sec AS DECIMAL(18,2)), 0)"
query(
    "pipe_step_duration_trends",
    f"""SELECT pipeline_name, step_name, round(CAST(sum({SECONDS}) AS DOUBLE) / count(*), 4) AS avg_duration,
        CAST(max({SECONDS}) AS DOUBLE) AS max_duration, count(*) AS executions
        FROM pipe_audit WHERE {since(30)} AND status = 'PASS' GROUP BY ALL""",
)(lambda t: audit.step_duration_trends(t.pipe_audit, EVENTS_DAY))
query(
    "pipe_step_summary",
    f"""SELECT count(*) AS total_steps, {status('PASS')} AS passed, {status('FAIL')} AS failed,
        {n_if("status IN ('SKIPPED', 'NOT_EXECUTED')")} AS skipped, {status('ABORTED')} AS aborted,
        {n_if("rollback_executed = 'true'")} AS rolled_back, CAST(sum({SECONDS}) AS DOUBLE) AS total_seconds, {cost(6)} AS total_cost
        FROM pipe_audit""",
)(lambda t: audit.step_summary(t.pipe_audit))


@query(
    "scan_cost",
    """SELECT run_id, CAST(sum(CAST(round(CAST(data_scanned_bytes AS DOUBLE) / 1099511627776 * 5, 6) AS DECIMAL(18,6))) AS DOUBLE) AS cost_usd
       FROM pipe_audit GROUP BY 1""",
)
def _(t: Inputs):
    # summed over the attempts of a run
    cost_ = scan_cost("data_scanned_bytes").cast("decimal(18,6)")
    return t.pipe_audit.groupBy("run_id").agg(F.sum(cost_).cast("double").alias("cost_usd"))
