"""Job runs and landing freshness."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakecheck.operators import freshness, jobs
from lakecheck.plans.inputs import EVENTS_DAY, EVENTS_NOW, Inputs
from lakecheck.plans.registry import n_if, pct, query

NOW = f"TIMESTAMP '{EVENTS_NOW}'"


def local(ts: str) -> str:
    return f"({ts} AT TIME ZONE 'UTC' AT TIME ZONE 'America/Los_Angeles')"


# runs up to now with their deadline status
RUNS = f"""fin AS (SELECT *, CASE WHEN state = 'RUNNING' THEN {NOW} WHEN exec_sec > 0 THEN started_on + to_seconds(exec_sec) END AS finish
        FROM job_runs WHERE started_on <= {NOW}),
    runs AS (SELECT *, CASE WHEN finish IS NULL OR sla IS NULL OR sla = 'bad' THEN 'N/A'
        WHEN {local("finish")} > try_strptime(CAST(CAST({local("started_on")} AS DATE) AS VARCHAR) || ' ' || sla, '%Y-%m-%d %H:%M')
        THEN 'BREACHED' ELSE 'ON TIME' END AS sla_status FROM fin),
    latest AS (SELECT job_name, domain, run_id, state AS status, started_on, exec_sec, worker_type, num_workers, error_message, sla_status,
        started_on > {NOW} - INTERVAL 1 DAY AS is_recent, CAST({local("started_on")} AS DATE) = CAST({local(NOW)} AS DATE) AS is_today
        FROM runs QUALIFY row_number() OVER (PARTITION BY job_name ORDER BY started_on DESC, run_id DESC) = 1),
    week AS (SELECT * FROM runs WHERE started_on > {NOW} - INTERVAL 7 DAY)"""

HEALTH = f"""{RUNS},
    hist AS (SELECT job_name, count(*) AS runs_7d, {n_if("state = 'SUCCEEDED'")} AS succeeded, {n_if("sla_status = 'ON TIME'")} AS on_time
        FROM week GROUP BY 1),
    both_ AS (SELECT l.*, coalesce(runs_7d, 0) AS runs_7d, coalesce(h.succeeded, 0) AS succeeded, coalesce(h.on_time, 0) AS on_time
        FROM latest l LEFT JOIN hist h ON l.job_name = h.job_name),
    points AS (SELECT *, CAST(least(100, coalesce(succeeded * 40 // NULLIF(runs_7d, 0), 0) + coalesce(on_time * 30 // NULLIF(runs_7d, 0), 0)
        + CASE WHEN is_today THEN 15 WHEN is_recent THEN 8 ELSE 0 END
        + CASE WHEN status = 'SUCCEEDED' AND coalesce(error_message, '') = '' THEN 15 WHEN status = 'RUNNING' THEN 10 ELSE 0 END) AS BIGINT) AS health_score
        FROM both_),
    scored AS (SELECT *, CASE WHEN health_score >= 80 THEN 'Healthy' WHEN health_score >= 60 THEN 'Warning' ELSE 'Critical' END AS health
        FROM points)"""


def spent(seconds: str, digits: int, factor: str = "") -> str:
    return f"round(CAST(coalesce({seconds}, 0) AS DOUBLE) / 3600 * 0.44::DOUBLE{factor}, {digits})"


query("jobs_latest_status", f"WITH {RUNS} SELECT * FROM latest")(lambda t: jobs.latest_status(t.job_runs, EVENTS_NOW))

RECENT = f"started_on > {NOW} - INTERVAL 1 DAY"
query(
    "jobs_24h_stats",
    f"""WITH {RUNS} SELECT job_name, domain, {n_if(RECENT)} AS runs_24h,
        round(CAST(sum(exec_sec) FILTER (WHERE {RECENT} AND exec_sec > 0) AS DOUBLE) / {n_if(f"{RECENT} AND exec_sec > 0")} / 60, 2) AS avg_exec_min,
        {pct(n_if(f"{RECENT} AND state = 'SUCCEEDED'"), n_if(RECENT), 0)} AS success_rate,
        {spent(f"sum(dpu_seconds) FILTER (WHERE {RECENT})", 2)} AS cost_today, {spent("sum(dpu_seconds)", 2)} AS cost_7_days
        FROM week GROUP BY ALL""",
)(lambda t: jobs.day_stats(t.job_runs, EVENTS_NOW))

query("jobs_cost", f"SELECT run_id, dpu_seconds, {spent('dpu_seconds', 6)} AS cost_usd FROM job_runs")(
    lambda t: jobs.cost(t.job_runs).select("run_id", "dpu_seconds", "cost_usd")
)
query("jobs_sla", f"WITH {RUNS} SELECT run_id, job_name, started_on, sla, state, sla_status FROM runs")(
    lambda t: jobs.with_sla(jobs.until(t.job_runs, EVENTS_NOW), EVENTS_NOW).select(
        "run_id", "job_name", "started_on", "sla", "state", "sla_status"
    )
)
query(
    "jobs_7d_daily",
    f"""WITH {RUNS},
        days AS (SELECT CAST(unnest(generate_series(DATE '{EVENTS_DAY}' - 6, DATE '{EVENTS_DAY}', INTERVAL 1 DAY)) AS DATE) AS run_day),
        d AS (SELECT CAST({local("started_on")} AS DATE) AS run_day, count(*) AS runs, {spent("sum(dpu_seconds)", 4)} AS cost,
              {n_if("sla_status = 'ON TIME'")} AS on_time, {n_if("sla_status = 'BREACHED'")} AS breached,
              {n_if("state = 'SUCCEEDED'")} AS succeeded, {n_if("state = 'FAILED'")} AS failed FROM week GROUP BY 1)
        SELECT days.run_day, coalesce(runs, 0) AS runs, coalesce(cost, 0) AS cost, coalesce(on_time, 0) AS on_time,
               coalesce(breached, 0) AS breached, coalesce(succeeded, 0) AS succeeded, coalesce(failed, 0) AS failed
        FROM days LEFT JOIN d ON days.run_day = d.run_day""",
)(lambda t: jobs.last_days(t.job_runs, EVENTS_NOW, EVENTS_DAY))
query(
    "jobs_cost_projection",
    f"""WITH {RUNS},
        m AS (SELECT domain, worker_type, dpu_seconds, CAST(round(CAST(exec_sec AS DECIMAL(18,3)) / 60, 1) AS DECIMAL(18,1)) AS minutes FROM week)
        SELECT coalesce(domain, 'TOTAL') AS domain,
               CASE WHEN grouping(domain) = 1 THEN '' ELSE string_agg(DISTINCT worker_type, ', ' ORDER BY worker_type) END AS worker_types,
               CAST(sum(minutes) AS DOUBLE) AS total_exec_min, count(*) AS run_count, {spent("sum(dpu_seconds)", 2)} AS cost_7d,
               {spent("sum(dpu_seconds)", 2, " * 30.0::DOUBLE / 7.0::DOUBLE")} AS monthly,
               {spent("sum(dpu_seconds)", 2, " * 365.0::DOUBLE / 7.0::DOUBLE")} AS yearly
        FROM m GROUP BY ROLLUP (domain)""",
)(lambda t: jobs.cost_projection(t.job_runs, EVENTS_NOW))
query(
    "jobs_health_score",
    f"WITH {HEALTH} SELECT job_name, domain, status, sla_status, runs_7d, succeeded, on_time, health_score, health FROM scored",
)(
    lambda t: jobs.health_score(t.job_runs, EVENTS_NOW).select(
        "job_name", "domain", "status", "sla_status", "runs_7d", "succeeded", "on_time", "health_score", "health"
    )
)
query(
    "jobs_scorecard",
    f"""WITH {HEALTH},
        spend AS (SELECT {n_if(RECENT)} AS runs_24h, {spent(f"sum(dpu_seconds) FILTER (WHERE {RECENT})", 2)} AS cost_today,
                  {spent("sum(dpu_seconds)", 2)} AS cost_7_days, {spent("sum(dpu_seconds)", 2, " * 30.0::DOUBLE / 7.0::DOUBLE")} AS projected_monthly FROM week),
        fleet AS (SELECT count(*) AS total_jobs, {n_if("is_recent")} AS recent_jobs, {n_if("status = 'SUCCEEDED'")} AS succeeded,
                  {n_if("status = 'FAILED'")} AS failed, {n_if("status = 'RUNNING'")} AS running, {n_if("sla_status = 'ON TIME'")} AS sla_on_time,
                  {n_if("sla_status = 'BREACHED'")} AS sla_breached, CAST(sum(health_score) // count(*) AS BIGINT) AS avg_health_score FROM scored)
        SELECT * FROM fleet, spend""",
)(lambda t: jobs.scorecard(t.job_runs, EVENTS_NOW))
query(
    "jobs_attention",
    f"""WITH {HEALTH} SELECT job_name, domain, concat_ws('; ', CASE WHEN sla_status = 'BREACHED' THEN 'deadline missed' END,
        CASE WHEN status IN ('FAILED', 'ERROR', 'TIMEOUT') THEN 'last state ' || status END,
        CASE WHEN health_score < 60 THEN 'health ' || health_score || '/100' END,
        CASE WHEN NOT is_recent THEN 'no run for a day' END) AS issues, health_score, health FROM scored
        WHERE sla_status = 'BREACHED' OR status IN ('FAILED', 'ERROR', 'TIMEOUT') OR health_score < 60""",
)(lambda t: jobs.attention(t.job_runs, EVENTS_NOW))

# ---- freshness ---------------------------------------------------------------------------------


def per_source(limit: int) -> str:
    return f"""sub AS (SELECT source, subfolder, epoch({NOW} - max(modified)) / 3600 AS age FROM listing WHERE modified <= {NOW} GROUP BY ALL),
        src AS (SELECT source, count(subfolder) AS subfolder_count, {n_if(f"subfolder IS NOT NULL AND age > {limit}")} AS stale, min(age) AS age
                FROM sub GROUP BY 1),
        names AS (SELECT DISTINCT source FROM listing UNION SELECT 'empty'),
        s AS (SELECT n.source, coalesce(subfolder_count, 0) AS subfolder_count, coalesce(stale, 0) AS stale_subfolders, age
              FROM names n LEFT JOIN src ON n.source = src.source)"""


def landing(t: Inputs):
    """Files seen by now, and the configured sources, one of them empty."""
    files = t.listing
    names = files.select("source").distinct().unionByName(files.agg(F.lit("empty").alias("source")))
    return files.filter(F.col("modified") <= F.lit(str(EVENTS_NOW)).cast("timestamp_ntz")), names


query(
    "fresh_source_status",
    f"""WITH {per_source(3)} SELECT source, subfolder_count,
        CASE WHEN subfolder_count > 3 THEN subfolder_count ELSE stale_subfolders END AS stale_subfolders, round(age, 1) AS newest_age_hours,
        CASE WHEN subfolder_count > 3 OR stale_subfolders > 0 THEN 'Stale'
             WHEN subfolder_count = 0 AND (age IS NULL OR age > 5) THEN 'Check with Source' ELSE 'OK' END AS status FROM s""",
)(lambda t: freshness.source_status(landing(t)[0], EVENTS_NOW, landing(t)[1]))
query(
    "fresh_folder_summary",
    f"""WITH {per_source(3)} SELECT source, subfolder_count, stale_subfolders, subfolder_count > 3 AS over_limit,
        CASE WHEN subfolder_count > 3 THEN 'FAIL' WHEN stale_subfolders > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM s""",
)(lambda t: freshness.folder_summary(landing(t)[0], EVENTS_NOW, landing(t)[1]))
query(
    "fresh_alerts",
    f"""WITH {per_source(8)} SELECT source, 'folder_count' AS alert, subfolder_count, round(age, 1) AS newest_age_hours FROM s WHERE subfolder_count > 6
        UNION ALL SELECT source, 'stale_files', subfolder_count, round(age, 1) FROM s WHERE age IS NULL OR age > 8""",
)(lambda t: freshness.alerts(landing(t)[0], EVENTS_NOW, landing(t)[1]))
