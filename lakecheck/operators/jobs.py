"""Job-run analytics: latest state, cost, deadlines, health.

``runs`` holds job_name, domain, run_id, started_on (UTC), exec_sec, dpu_seconds, state, worker_type,
num_workers, sla ("HH:MM" local), error_message and optionally completed_on. Runs that start after
``as_of`` are ignored.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakecheck.functions.exprs import DEADLINE_ZONE, PRICE_PER_DPU_HOUR, between_days, dpu_cost, instant, local_time, percent
from lakecheck.operators.keys import dedup_latest

# Weights and marks of the health score.
SUCCESS_POINTS, ON_TIME_POINTS = 40, 30
RAN_TODAY_POINTS, RAN_RECENTLY_POINTS = 15, 8
CLEAN_POINTS, RUNNING_POINTS = 15, 10
HEALTHY_FROM, WARNING_FROM = 80, 60
BAD_STATES = ("FAILED", "ERROR", "TIMEOUT")


def until(runs: DataFrame, as_of: datetime) -> DataFrame:
    return runs.filter(F.col("started_on") <= instant(as_of))


def younger_than(as_of: datetime, **age: int) -> Column:
    return F.col("started_on") > instant(as_of - timedelta(**age))


def local_date(ts: str | Column, zone: str = DEADLINE_ZONE) -> Column:
    return F.to_date(local_time(ts, zone))


def with_sla(runs: DataFrame, as_of: datetime, zone: str = DEADLINE_ZONE) -> DataFrame:
    """ON TIME, BREACHED or N/A against the deadline on the local date of the start.

    A running job is measured at ``as_of``; a finished one at its end, or start plus run time. A job whose
    deadline is NULL or no time of day is N/A.
    """
    estimated = F.when(F.col("exec_sec") > 0, F.timestamp_add("SECOND", F.col("exec_sec"), F.col("started_on")))
    ended = F.coalesce(F.col("completed_on"), estimated) if "completed_on" in runs.columns else estimated
    finish = F.when(F.col("state") == "RUNNING", instant(as_of)).otherwise(ended)
    deadline = F.concat_ws(" ", local_date("started_on", zone).cast("string"), F.col("sla"))
    deadline = F.when(F.col("sla").isNotNull(), F.try_to_timestamp(deadline).cast("timestamp_ntz"))
    late = local_time(finish, zone) > deadline
    return runs.withColumn(
        "sla_status", F.when(finish.isNull() | deadline.isNull(), "N/A").when(late, "BREACHED").otherwise("ON TIME")
    )


def cost(runs: DataFrame, price: float = PRICE_PER_DPU_HOUR) -> DataFrame:
    return runs.withColumn("cost_usd", F.round(dpu_cost("dpu_seconds", price), 6))


def latest_status(runs: DataFrame, as_of: datetime, jobs: DataFrame | None = None, zone: str = DEADLINE_ZONE) -> DataFrame:
    """Latest run per job with recency flags. With a ``jobs`` list, a job that never ran is reported too."""
    newest = dedup_latest(until(runs, as_of), ["job_name"], [F.desc("started_on"), F.desc("run_id")])
    newest = with_sla(newest, as_of, zone).select(
        "job_name",
        "domain",
        "run_id",
        F.col("state").alias("status"),
        "started_on",
        "exec_sec",
        "worker_type",
        "num_workers",
        "error_message",
        "sla_status",
        younger_than(as_of, days=1).alias("is_recent"),
        (local_date("started_on", zone) == local_date(instant(as_of), zone)).alias("is_today"),
    )
    if jobs is None:
        return newest
    none = {"status": "NO_RUNS_FOUND", "sla_status": "N/A", "error_message": "No job runs found"}
    return (
        jobs.select("job_name", "domain")
        .join(newest.drop("domain"), "job_name", "left")
        .fillna(none | {"is_recent": False, "is_today": False})
    )


def _spent(within: Column, digits: int = 2, factor: float = 1.0) -> Column:
    """Cost from exact DPU seconds, rounded once."""
    seconds = F.sum(F.when(within, F.coalesce(F.col("dpu_seconds"), F.lit(0))))
    return F.round(dpu_cost(F.coalesce(seconds, F.lit(0))) * F.lit(factor), digits)


def day_stats(runs: DataFrame, as_of: datetime) -> DataFrame:
    """Runs, mean minutes, success share and cost of the last 24 hours, cost of the last 7 days, per job."""
    recent = younger_than(as_of, days=1)
    timed = recent & (F.col("exec_sec") > 0)
    minutes = F.sum(F.when(timed, F.col("exec_sec"))).cast("double") / F.count_if(timed).cast("double") / 60
    window = until(runs, as_of).filter(younger_than(as_of, days=7))
    return window.groupBy("job_name", "domain").agg(
        F.count_if(recent).alias("runs_24h"),
        F.when(F.count_if(timed) > 0, F.round(minutes, 2)).alias("avg_exec_min"),
        percent(F.count_if(recent & (F.col("state") == "SUCCEEDED")), F.count_if(recent), 0).alias("success_rate"),
        _spent(recent).alias("cost_today"),
        _spent(F.lit(True)).alias("cost_7_days"),
    )


def daily_rows(df: DataFrame, column: str, as_of: date, days: int) -> DataFrame:
    """Rows per day for the last ``days`` days up to ``as_of``, zero where there are none. Only these days are read."""
    recent = df.filter(between_days(df, column, as_of - timedelta(days=days - 1), as_of))
    counts = recent.groupBy(F.to_date(F.col(column)).alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return zero_filled_days(counts, "day", as_of, days)


def zero_filled_days(counts: DataFrame, day: str, as_of: date, days: int) -> DataFrame:
    """The last days up to ``as_of``, with zeros where ``counts`` has no row."""
    calendar = counts.sparkSession.range(1).select(
        F.explode(F.sequence(F.lit(as_of - timedelta(days=days - 1)), F.lit(as_of))).alias(day)
    )
    return calendar.join(counts, day, "left").fillna(0)


def last_days(runs: DataFrame, as_of: datetime, as_of_day: date, days: int = 7, zone: str = DEADLINE_ZONE) -> DataFrame:
    """Per local day: runs, cost, deadline and state counts; ``as_of_day`` is the local date of ``as_of``."""
    state, sla = F.col("state"), F.col("sla_status")
    window = until(runs, as_of).filter(younger_than(as_of, days=days))
    daily = (
        with_sla(window, as_of, zone)
        .groupBy(local_date("started_on", zone).alias("run_day"))
        .agg(
            F.count(F.lit(1)).alias("runs"),
            _spent(F.lit(True), 4).alias("cost"),
            F.count_if(sla == "ON TIME").alias("on_time"),
            F.count_if(sla == "BREACHED").alias("breached"),
            F.count_if(state == "SUCCEEDED").alias("succeeded"),
            F.count_if(state == "FAILED").alias("failed"),
        )
    )
    return zero_filled_days(daily, "run_day", as_of_day, days)


def cost_projection(runs: DataFrame, as_of: datetime) -> DataFrame:
    """Seven-day cost per domain, projected to a month and a year, and a TOTAL row from the same rollup."""
    week = until(runs, as_of).filter(younger_than(as_of, days=7))
    minutes = F.round(F.col("exec_sec").cast("decimal(18,3)") / 60, 1).cast("decimal(18,1)")
    spent = dpu_cost(F.sum("dpu_seconds"))
    # distinct worker types by (domain, type) first, so no list grows with the runs
    typed = week.groupBy("domain", "worker_type").agg(
        F.count(F.lit(1)).alias("runs"),
        F.sum("dpu_seconds").alias("dpu_seconds"),
        F.sum(minutes).alias("minutes"),
    )
    is_total = F.grouping("domain") == 1
    return (
        typed.rollup("domain")
        .agg(
            F.when(is_total, "").otherwise(F.array_join(F.array_sort(F.collect_set("worker_type")), ", ")).alias(
                "worker_types"
            ),
            F.sum("minutes").cast("double").alias("total_exec_min"),
            F.sum("runs").alias("run_count"),
            F.round(spent, 2).alias("cost_7d"),
            F.round(spent * 30.0 / 7.0, 2).alias("monthly"),
            F.round(spent * 365.0 / 7.0, 2).alias("yearly"),
            is_total.alias("is_total"),
        )
        .withColumn("domain", F.when(F.col("is_total"), "TOTAL").otherwise(F.col("domain")))
        .drop("is_total")
    )


def health_score(runs: DataFrame, as_of: datetime, zone: str = DEADLINE_ZONE) -> DataFrame:
    """0 to 100 per job from success, deadlines, recency and the latest run; points are whole numbers."""
    week = with_sla(until(runs, as_of).filter(younger_than(as_of, days=7)), as_of, zone)
    history = week.groupBy("job_name").agg(
        F.count(F.lit(1)).alias("runs_7d"),
        F.count_if(F.col("state") == "SUCCEEDED").alias("succeeded"),
        F.count_if(F.col("sla_status") == "ON TIME").alias("on_time"),
    )
    scored = latest_status(runs, as_of, zone=zone).join(history, "job_name", "left").fillna(0, ["runs_7d", "succeeded", "on_time"])

    def share(part: str, points: int) -> Column:
        return F.coalesce(F.floor(F.try_divide(F.col(part) * points, F.col("runs_7d"))), F.lit(0))

    recency = F.when(F.col("is_today"), RAN_TODAY_POINTS).when(F.col("is_recent"), RAN_RECENTLY_POINTS).otherwise(0)
    clean = (F.col("status") == "SUCCEEDED") & (F.coalesce(F.col("error_message"), F.lit("")) == "")
    latest = F.when(clean, CLEAN_POINTS).when(F.col("status") == "RUNNING", RUNNING_POINTS).otherwise(0)
    score = F.least(share("succeeded", SUCCESS_POINTS) + share("on_time", ON_TIME_POINTS) + recency + latest, F.lit(100))
    label = F.when(F.col("health_score") >= HEALTHY_FROM, "Healthy").when(F.col("health_score") >= WARNING_FROM, "Warning")
    return scored.withColumn("health_score", score.cast("bigint")).withColumn("health", label.otherwise("Critical"))


def scorecard(runs: DataFrame, as_of: datetime, zone: str = DEADLINE_ZONE) -> DataFrame:
    """Fleet totals. The mean score is cut to a whole number."""
    scored = health_score(runs, as_of, zone)
    recent, always = younger_than(as_of, days=1), F.lit(True)
    spend = (
        until(runs, as_of)
        .filter(younger_than(as_of, days=7))
        .agg(
            F.count_if(recent).alias("runs_24h"),
            _spent(recent).alias("cost_today"),
            _spent(always).alias("cost_7_days"),
            _spent(always, factor=30.0 / 7.0).alias("projected_monthly"),
        )
    )
    state, sla = F.col("status"), F.col("sla_status")
    fleet = scored.agg(
        F.count(F.lit(1)).alias("total_jobs"),
        F.count_if(F.col("is_recent")).alias("recent_jobs"),
        F.count_if(state == "SUCCEEDED").alias("succeeded"),
        F.count_if(state == "FAILED").alias("failed"),
        F.count_if(state == "RUNNING").alias("running"),
        F.count_if(sla == "ON TIME").alias("sla_on_time"),
        F.count_if(sla == "BREACHED").alias("sla_breached"),
        F.floor(F.try_divide(F.sum("health_score"), F.count(F.lit(1)))).cast("bigint").alias("avg_health_score"),
    )
    # two one-row results side by side
    return fleet.withColumn("_spend", spend.select(F.struct("*")).scalar()).select("*", "_spend.*").drop("_spend")


def attention(runs: DataFrame, as_of: datetime, zone: str = DEADLINE_ZONE) -> DataFrame:
    """Jobs that failed last, breached the deadline or score low, with the list of issues."""
    scored = health_score(runs, as_of, zone)
    breached, bad = F.col("sla_status") == "BREACHED", F.col("status").isin(*BAD_STATES)
    low = F.col("health_score") < WARNING_FROM
    issues = F.concat_ws(
        "; ",
        F.when(breached, F.lit("deadline missed")),
        F.when(bad, F.concat(F.lit("last state "), F.col("status"))),
        F.when(low, F.concat(F.lit("health "), F.col("health_score").cast("string"), F.lit("/100"))),
        F.when(~F.col("is_recent"), F.lit("no run for a day")),
    )
    return scored.filter(breached | bad | low).select(
        "job_name", "domain", issues.alias("issues"), "health_score", "health"
    )
