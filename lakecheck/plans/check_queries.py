"""Single-table checks."""

from __future__ import annotations

from datetime import datetime, time, timedelta

from pyspark.sql import functions as F

from lakecheck.functions.exprs import from_day
from lakecheck.operators import checks, keys, mart, partials, policies
from lakecheck.plans.inputs import EVENTS_DAY, EVENTS_NOW, ORDERS_DAY, Inputs
from lakecheck.plans.registry import n_if, passes, pct, query
from lakecheck.session import scratch_folder

DAY = f"DATE '{ORDERS_DAY}'"


def verdict(name: str, check_type: str, condition: str, ok: str, actual: str, source: str) -> str:
    text = condition.replace("'", "''")
    return f"""SELECT '{name}' AS name, '{check_type}' AS check_type, {passes(ok)} AS status,
        CASE WHEN {ok} THEN 'holds: ' ELSE 'does not hold: ' END || '{text}' AS detail,
        CAST({actual} AS VARCHAR) AS actual_value FROM ({source}) v"""


@query(
    "check_condition",
    verdict("value_spread", "threshold", "hi <= 100 and row_count == 5", "bool_and(hi <= 100) AND count(*) = 5",
            "coalesce(min(CAST(hi AS VARCHAR)) FILTER (WHERE NOT (hi <= 100 AND n = 5)), min(CAST(hi AS VARCHAR)))",
            """SELECT CAST(max(floor(value)) AS BIGINT) AS hi, count(*) OVER () AS n FROM events GROUP BY event_type"""),
)
def _(t: Inputs):
    highest = t.events.groupBy("event_type").agg(F.floor(F.max("value")).cast("bigint").alias("hi"))
    return checks.check_condition(highest, "value_spread", "hi <= 100 and row_count == 5", "threshold")


@query(
    "check_row_count",
    verdict("loaded", "row_count", "cnt > 0", "cnt > 0", "cnt",
            f"SELECT count(*) AS cnt FROM orders_q WHERE CAST(load_ts AS DATE) = {DAY}"),
)
def _(t: Inputs):
    return checks.row_count(keys.load_slice(t.orders_q, ORDERS_DAY), "loaded")


@query(
    "check_no_rows",
    verdict("no_duplicate_lines", "no_rows", "row_count == 0", "n = 0", "n",
            "SELECT count(*) AS n FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) d"),
)
def _(t: Inputs):
    return checks.no_rows(checks.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"]), "no_duplicate_lines")


def violation_rows(bad: dict[str, str], limit: float = 0.0, source: str = "orders_q") -> str:
    parts = [
        f"""SELECT '{name}' AS check_name, count(*) AS total, {n_if(condition)} AS violations,
        coalesce({pct(n_if(condition), 'count(*)', 2)}, 0) AS violation_pct,
        {passes(f"{pct(n_if(condition), 'count(*)', 2)} <= {limit}" if limit else f"{n_if(condition)} = 0")} AS status
        FROM {source}"""
        for name, condition in bad.items()
    ]
    return " UNION ALL ".join(parts)


KEYS = ["order_id", "customer_id", "status_code", "eff_d"]


@query("check_null_keys", violation_rows({k: f"{k} IS NULL" for k in KEYS}))
def _(t: Inputs):
    return checks.null_keys(t.orders_q, KEYS)


@query("check_null_pct", violation_rows({k: f"{k} IS NULL" for k in KEYS}, 2.3))
def _(t: Inputs):
    return checks.null_percent(t.orders_q, KEYS, 2.3)


ISO = "NOT regexp_matches({c}, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$')"


@query("check_date_format", violation_rows({"eff_d": "eff_d IS NULL OR " + ISO.format(c="eff_d")}))
def _(t: Inputs):
    return checks.violations(t.orders_q, {"eff_d": checks.is_not_iso_date("eff_d")})


@query(
    "check_mandatory_fields",
    violation_rows({"mandatory": "customer_id IS NULL OR status_code IS NULL OR eff_d IS NULL"}),
)
def _(t: Inputs):
    return checks.violations(t.orders_q, {"mandatory": checks.is_missing("customer_id", "status_code", "eff_d")})


@query(
    "check_allowed_values",
    violation_rows({"status_code": "status_code IS NULL OR status_code NOT IN ('F', 'O', 'P')"}),
)
def _(t: Inputs):
    return checks.violations(t.orders_q, {"status_code": checks.is_not_allowed("status_code", ["F", "O", "P"])})


@query("check_minmax_year", violation_rows({"join_year": "join_year IS NULL OR join_year < '1900' OR join_year > '2100'"}))
def _(t: Inputs):
    return checks.violations(t.orders_q, {"join_year": checks.is_not_year(["join_year"])})


@query(
    "check_one_pass",
    violation_rows(
        {
            "mandatory": "customer_id IS NULL OR status_code IS NULL",
            "status_code": "status_code IS NULL OR status_code NOT IN ('F', 'O', 'P')",
            "join_year": "join_year IS NULL OR join_year < '1900' OR join_year > '2100'",
            "eff_d": "eff_d IS NULL OR " + ISO.format(c="eff_d"),
        }
    ),
)
def _(t: Inputs):
    return checks.violations(
        t.orders_q,
        {
            "mandatory": checks.is_missing("customer_id", "status_code"),
            "status_code": checks.is_not_allowed("status_code", ["F", "O", "P"]),
            "join_year": checks.is_not_year(["join_year"]),
            "eff_d": checks.is_not_iso_date("eff_d"),
        },
    )


@query(
    "check_freshness",
    verdict("events_fresh", "freshness", "hours_old < 24", "hours_old < 24", "hours_old",
            f"SELECT CAST(trunc(epoch(TIMESTAMP '{EVENTS_NOW}' - max(ts)) / 3600) AS BIGINT) AS hours_old FROM events"),
)
def _(t: Inputs):
    return checks.freshness(t.events, "ts", EVENTS_NOW, 24, "events_fresh")


@query(
    "check_duplicate_keys_count",
    verdict("duplicate_keys", "duplicates", "dup_cnt == 0", "dup_cnt = 0", "dup_cnt",
            f"""SELECT count(*) AS dup_cnt FROM (SELECT 1 FROM orders_q WHERE CAST(load_ts AS DATE) = {DAY}
                GROUP BY status_code, join_year HAVING count(*) > 1) d"""),
)
def _(t: Inputs):
    slice_ = keys.load_slice(t.orders_q, ORDERS_DAY)
    return checks.duplicate_key_count(slice_, ["status_code", "join_year"], "duplicate_keys")


def share(limit: float) -> str:
    return f"""CASE WHEN total = 0 THEN 0.0 ELSE {pct('invalid_count', 'total', 2)} END AS invalid_pct,
        CASE WHEN total = 0 THEN 'NO_DATA' WHEN CAST(invalid_count AS DOUBLE) / total <= {limit} THEN 'PASS' ELSE 'FAIL' END AS status"""


@query(
    "check_pct_threshold",
    f"""WITH c AS (SELECT count(*) AS total, {n_if("status_code IS NULL OR status_code NOT IN ('F', 'O')")} AS invalid_count
        FROM orders_q WHERE CAST(load_ts AS DATE) >= {DAY} - 365) SELECT total, invalid_count, {share(0.20)} FROM c""",
)
def _(t: Inputs):
    year = t.orders_q.filter(from_day(t.orders_q, "load_ts", ORDERS_DAY - timedelta(days=365)))
    return checks.percent_threshold(year, checks.is_not_allowed("status_code", ["F", "O"]), 0.20)


@query(
    "check_date_window",
    f"""WITH p AS (SELECT TRY_CAST(eff_d AS DATE) AS d, {DAY} - INTERVAL 24 MONTH AS lo, {DAY} + INTERVAL 6 MONTH AS hi FROM orders_q),
        f AS (SELECT d IS NULL AS unread, coalesce(d IN (DATE '0001-01-01', DATE '9999-12-31'), false) AS ph,
                     coalesce(d < lo OR d > hi, false) AS outside FROM p),
        c AS (SELECT count(*) AS total, {n_if("unread")} AS unparsable, {n_if("ph")} AS placeholders,
                     {n_if("outside AND NOT ph")} AS out_of_window, {n_if("unread OR ph OR outside")} AS invalid_count FROM f)
        SELECT total, unparsable, placeholders, out_of_window, invalid_count, {share(0.0)} FROM c""",
)
def _(t: Inputs):
    return checks.date_window(t.orders_q, "eff_d", ORDERS_DAY)


def variance(today: str, base: str, signed: bool = False) -> str:
    gap = f"(CAST({today} AS DOUBLE) - CAST({base} AS DOUBLE))"
    gap = gap if signed else f"abs{gap}"
    return f"""CASE WHEN coalesce({base}, 0) = 0 THEN CASE WHEN {today} = 0 THEN 0.0 ELSE 100.0 END
        ELSE {gap} / CAST({base} AS DOUBLE) * 100 END"""


@query(
    "check_rolling_average",
    f"""WITH d AS (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events
                   WHERE CAST(ts AS DATE) BETWEEN DATE '{EVENTS_DAY}' - 14 AND DATE '{EVENTS_DAY}' GROUP BY 1),
        c AS (SELECT CAST(coalesce(sum(n) FILTER (WHERE d = DATE '{EVENTS_DAY}'), 0) AS BIGINT) AS today_cnt,
                     round(avg(n) FILTER (WHERE d < DATE '{EVENTS_DAY}'), 2) AS baseline_cnt FROM d)
        SELECT today_cnt, baseline_cnt, round({variance("today_cnt", "baseline_cnt")}, 2) AS variance_pct,
               {passes("round(" + variance("today_cnt", "baseline_cnt") + ", 2) <= 25", "WARN")} AS status FROM c""",
)
def _(t: Inputs):
    return checks.rolling_average(t.events, "ts", EVENTS_DAY, 14, 25, warn_only=True)


def window_check(today: str, window: str, days: int, limit: float, extra: str = "") -> str:
    mean = f"(CAST({window} AS DOUBLE) / {days})"
    return f"""SELECT {today}, {window}, {extra} round({mean}, 4) AS rolling_avg,
        round({variance(today, mean, True)}, 2) AS pct_difference,
        {passes(f"abs({variance(today, mean, True)}) <= {limit}")} AS status FROM c"""


def volume(day: str, first: str, last: str) -> str:
    tested = f"(CAST(load_ts AS DATE) = {day} OR CAST(update_ts AS DATE) = {day})"
    inside = f"CAST(load_ts AS DATE) BETWEEN {first} AND {last}"
    return f"""WITH c AS (SELECT {n_if(tested)} AS today_count, {n_if(inside)} AS total_in_window,
        count(DISTINCT CAST(load_ts AS DATE)) FILTER (WHERE {inside}) AS days_with_data FROM orders_q)
        {window_check("today_count", "total_in_window", 60, 15, "days_with_data,")}"""


@query("check_volume_60d", volume(DAY, f"{DAY} - 60", f"{DAY} - 1"))
def _(t: Inputs):
    return checks.volume_against_window(t.orders_q, ORDERS_DAY, "load_ts", "update_ts")


VOLUME_WITH_DAY = f"""WITH c AS (SELECT {n_if(f"CAST(load_ts AS DATE) = {DAY}")} AS today_count,
        {n_if(f"CAST(load_ts AS DATE) BETWEEN {DAY} - 59 AND {DAY}")} AS total_in_window,
        count(DISTINCT CAST(load_ts AS DATE)) FILTER (WHERE CAST(load_ts AS DATE) BETWEEN {DAY} - 59 AND {DAY}) AS days_with_data
        FROM orders_q) {window_check("today_count", "total_in_window", 60, 15, "days_with_data,")}"""


@query("check_volume_60d_including_day", VOLUME_WITH_DAY)
def _(t: Inputs):
    return checks.volume_against_window(t.orders_q, ORDERS_DAY, "load_ts", include_day=True)


@query("check_volume_60d_partials", VOLUME_WITH_DAY)
def _(t: Inputs):
    # all days but the last three first, then the days that have rows loaded since
    root = scratch_folder(t.spark, "daily-counts")
    # state is kept for the days of the window
    before = keys.within_days(t.orders_q, "load_ts", ORDERS_DAY - timedelta(days=60), ORDERS_DAY - timedelta(days=3))
    measures = {"cnt": F.count(F.lit(1))}
    partials.refresh_partials(before, root, "load_ts", measures)
    since = datetime.combine(ORDERS_DAY - timedelta(days=2), time.min)
    changed = partials.changed_days(t.orders_q, "load_ts", "load_ts", since)
    partials.refresh_partials(t.orders_q, root, "load_ts", measures, days=changed)
    kept = partials.read_partials(t.spark, root, ORDERS_DAY - timedelta(days=59), ORDERS_DAY)
    return checks.volume_from_partials(partials.window_totals(kept, ORDERS_DAY, 60, include_day=True))


EVENT_DATE = "coalesce(CAST(load_ts AS DATE), CAST(update_ts AS DATE))"
AMOUNT = "TRY_CAST(amount_txt AS DECIMAL(18,2))"


@query(
    "check_amount_anomaly_30d",
    f"""WITH c AS (SELECT CAST(coalesce(sum({AMOUNT}) FILTER (WHERE {EVENT_DATE} = {DAY}), 0) AS DECIMAL(28,2)) AS today_sum,
        CAST(coalesce(sum({AMOUNT}) FILTER (WHERE {EVENT_DATE} BETWEEN {DAY} - 30 AND {DAY} - 1), 0) AS DECIMAL(28,2)) AS prior_sum
        FROM orders_q WHERE status_code = 'O') {window_check("today_sum", "prior_sum", 30, 20)}""",
)
def _(t: Inputs):
    open_ = t.orders_q.filter(F.col("status_code") == "O")
    return checks.amount_against_window(open_, "amount_txt", ORDERS_DAY, "load_ts", "update_ts")


@query(
    "check_last_txn_prev_day",
    f"""WITH a AS (SELECT load_date + 1 AS load_day, max(transaction_ts) AS max_ts, min(transaction_ts) AS min_ts FROM movements GROUP BY 1)
        SELECT load_day, max_ts, min_ts, CASE WHEN CAST(max_ts AS DATE) = load_day - 1 THEN 'Y' ELSE 'N' END AS is_prev_day,
        CASE WHEN hour(max_ts) >= 23 THEN 'Y' ELSE 'N' END AS is_late,
        {passes("CAST(max_ts AS DATE) = load_day - 1 AND hour(max_ts) >= 23")} AS status FROM a""",
)
def _(t: Inputs):
    # movements arrive the day after
    arrived = t.movements.withColumn("arrived_on", F.date_add("load_date", 1))
    return checks.last_transaction_previous_day(arrived, "arrived_on", "transaction_ts")


@query(
    "recon_source_counts",
    """SELECT extract_date, table_name, count_source, count_target,
        CAST(abs(count_source - count_target) AS DOUBLE) AS deviation FROM recon_counts
        WHERE abs(count_source - count_target) >= 1""",
)
def _(t: Inputs):
    return checks.recon_deviations(t.recon_counts, "count_source", "count_target", 1)


@query(
    "recon_source_counts_verdict",
    f"""SELECT count(*) AS total_rows, {n_if("abs(count_source - count_target) >= 5")} AS deviating_rows,
        {passes(n_if("abs(count_source - count_target) >= 5") + " = 0")} AS status FROM recon_counts""",
)
def _(t: Inputs):
    return checks.recon_verdict(t.recon_counts, "count_source", "count_target", 5)


@query(
    "recon_ratio",
    f"""SELECT *, {passes("base_cnt >= staging_cnt * 0.95")} AS status FROM
        (SELECT (SELECT count(*) FROM orders_src) AS staging_cnt, (SELECT count(*) FROM orders_tgt) AS base_cnt) c""",
)
def _(t: Inputs):
    return checks.recon_ratio(t.orders_tgt, t.orders_src)


BALANCES = """SELECT load_date, CASE WHEN count(*) FILTER (WHERE movement_category = 'ADD') >= 60 THEN 'Y' ELSE 'N' END AS add_balanced,
    CASE WHEN count(*) FILTER (WHERE movement_category = 'DEDUCT') >= 1 THEN 'Y' ELSE 'N' END AS deduct_balanced FROM movements GROUP BY 1"""


def balances(t: Inputs):
    def flag(category: str, least: int):
        return F.when(F.count_if(F.col("movement_category") == category) >= least, "Y").otherwise("N")

    return t.movements.groupBy("load_date").agg(
        flag("ADD", 60).alias("add_balanced"), flag("DEDUCT", 1).alias("deduct_balanced")
    )


@query(
    "check_failure_column_value",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, {n_if(f"{c} = 'N'")} AS failing_rows, {passes(n_if(f"{c} = 'N'") + " = 0")} AS status
            FROM ({BALANCES}) b{i}"""
        for i, c in enumerate(["add_balanced", "deduct_balanced"])
    ),
)
def _(t: Inputs):
    return checks.failing_values(balances(t), "BALANCED", "N")


@query(
    "check_failure_row_count",
    """SELECT 'row_count_nonzero' AS rule, count(*) AS row_count, CASE WHEN count(*) = 0 THEN 'PASS' ELSE 'FAIL' END AS status
       FROM orders_q WHERE status_code IS NULL
       UNION ALL SELECT 'row_count_zero', count(*), CASE WHEN count(*) > 0 THEN 'PASS' ELSE 'FAIL' END FROM orders_q
       UNION ALL SELECT 'none', count(*), 'INFO' FROM orders_q""",
)
def _(t: Inputs):
    missing = t.orders_q.filter(F.col("status_code").isNull())
    return (
        checks.row_count_rule(missing, "row_count_nonzero")
        .unionByName(checks.row_count_rule(t.orders_q, "row_count_zero"))
        .unionByName(checks.row_count_rule(t.orders_q, "none"))
    )


def ratio_rows(good: dict[str, tuple[str, float]], source: str) -> str:
    parts = [
        f"""SELECT '{n}' AS check_name, {n_if(c)} AS good_rows, count(*) AS total_rows, CAST({limit} AS DOUBLE) AS threshold,
        round(CAST({n_if(c)} AS DOUBLE) / count(*), 6) AS pass_share,
        {passes(f"CAST({n_if(c)} AS DOUBLE) / count(*) >= {limit}")} AS status FROM {source}"""
        for n, (c, limit) in good.items()
    ]
    return " UNION ALL ".join(parts)


@query(
    "check_pass_ratio",
    ratio_rows(
        {
            "customer_completeness": ("customer_id IS NOT NULL", 0.99),
            "amount_between": ("TRY_CAST(amount_txt AS DECIMAL(18,2)) BETWEEN 0 AND 400000", 0.95),
            "amount_positive": ("TRY_CAST(amount_txt AS DECIMAL(18,2)) > 0", 1.0),
            "date_consistency": (f"CAST(load_ts AS DATE) <= {DAY}", 1.0),
            "known_status": ("status_code IN ('F', 'O', 'P')", 0.95),
        },
        "orders_q",
    ),
)
def _(t: Inputs):
    amount = F.col("amount_txt").try_cast("decimal(18,2)")
    return checks.pass_ratio(
        t.orders_q,
        [
            checks.RatioCheck("customer_completeness", F.col("customer_id").isNotNull(), 0.99),
            checks.RatioCheck("amount_between", amount.between(0, 400000), 0.95),
            checks.RatioCheck("amount_positive", amount > 0, 1.0),
            checks.RatioCheck("date_consistency", F.to_date("load_ts") <= F.lit(ORDERS_DAY), 1.0),
            checks.RatioCheck("known_status", F.expr("status_code in ('F', 'O', 'P')"), 0.95),
        ],
    )


@query(
    "check_join_completeness",
    ratio_rows(
        {"join_completeness": ("customer_id IS NOT NULL", 0.95)},
        "(SELECT c.customer_id FROM lines l LEFT JOIN customers_v c ON l.customer_id = c.customer_id AND c.active) j",
    ),
)
def _(t: Inputs):
    people = mart.active_only(t.customers_v).select("customer_id", F.lit(True).alias("found"))
    joined = t.lines.select("customer_id").join(people, "customer_id", "left")
    return checks.pass_ratio(joined, [checks.RatioCheck("join_completeness", F.col("found").isNotNull(), 0.95)])


@query(
    "metric_alerts",
    f"""WITH m AS (SELECT 'error_rate' AS metric, round(CAST({n_if("state = 'FAILED'")} AS DOUBLE) / count(*), 6) AS value FROM job_runs
        UNION ALL SELECT 'execution_time', CAST(max(exec_sec) AS DOUBLE) FROM job_runs
        UNION ALL SELECT 'data_quality_score', round(CAST({n_if("status = 'PASS'")} AS DOUBLE) / count(*), 6) FROM audit)
        SELECT metric, value, CAST(threshold AS DOUBLE) AS threshold FROM m JOIN (VALUES ('error_rate', 1, 0.05),
        ('execution_time', 1, 3600), ('data_quality_score', -1, 0.9)) l(name, side, threshold) ON metric = name
        WHERE (side = 1 AND value > threshold) OR (side = -1 AND value < threshold)""",
)
def _(t: Inputs):
    def share_of(df, column: str, value: str):
        good = F.count_if(F.col(column) == value).cast("double") / F.count(F.lit(1)).cast("double")
        return F.round(good, 6)

    runs = t.job_runs.agg(
        share_of(t.job_runs, "state", "FAILED").alias("error_rate"),
        F.max("exec_sec").cast("double").alias("execution_time"),
    )
    quality = t.audit.agg(share_of(t.audit, "status", "PASS").alias("data_quality_score"))
    metrics = runs.unpivot([], ["error_rate", "execution_time"], "metric", "value").unionByName(
        quality.unpivot([], ["data_quality_score"], "metric", "value")
    )
    return checks.metric_alerts(
        metrics, {"error_rate": ("above", 0.05), "execution_time": ("above", 3600), "data_quality_score": ("below", 0.9)}
    )


# ---- policy metrics ----------------------------------------------------------------------------

BAD = {
    "RECORD_VOLUME": "true",
    "NULLABILITY_COMBINED": "policy_id IS NULL OR application_id IS NULL",
    "AMOUNT_ANOMALIES_COMBINED": "face_amount < 0 OR face_amount > 400000",
    "PREMIUM_CONSISTENCY": "bill_mode = 'ANNUAL' AND annualized_premium <> modal_premium * 12",
    "DATE_VALIDATIONS_COMBINED": """effective_date > source_file_date OR expiry_date > effective_date + INTERVAL 1200 MONTH
        OR termination_date < effective_date""",
}


def metric_sql(metric: str) -> str:
    if metric == "DUPLICATES_COMBINED":
        daily = """SELECT source_file_date, CAST(sum(CASE WHEN application_id IS NULL THEN 0 ELSE n - 1 END) AS BIGINT) AS cnt
            FROM (SELECT source_file_date, application_id, count(*) AS n FROM policies GROUP BY ALL) g GROUP BY 1"""
    else:
        daily = f"SELECT source_file_date, {n_if(BAD[metric])} AS cnt FROM policies GROUP BY 1"
    return f"""WITH daily AS ({daily}),
        r AS (SELECT *, round(avg(cnt) OVER w, 4) AS m, round(stddev_samp(cnt) OVER w, 4) AS s FROM daily
              WINDOW w AS (ORDER BY source_file_date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING))
        SELECT '{metric}' AS metric, source_file_date, cnt, round(m, 2) AS rolling_avg,
               CASE WHEN abs(cnt - m) > 2 * s THEN 'ANOMALY' ELSE 'NORMAL' END AS status FROM r"""


def _policy(name: str, metric: str):
    query(name, metric_sql(metric))(lambda t: policies.metric_status(t.policies, metrics=(metric,)))


_policy("life_record_volume", "RECORD_VOLUME")
_policy("life_nullability", "NULLABILITY_COMBINED")
_policy("life_amount_anomalies", "AMOUNT_ANOMALIES_COMBINED")
_policy("life_premium_consistency", "PREMIUM_CONSISTENCY")
_policy("life_duplicates", "DUPLICATES_COMBINED")
_policy("life_date_validations", "DATE_VALIDATIONS_COMBINED")


@query(
    "rolling_avg_10d_status",
    " UNION ALL ".join(f"SELECT * FROM ({metric_sql(m)}) q{i}" for i, m in enumerate(policies.METRICS)),
)
def _(t: Inputs):
    return policies.metric_status(t.policies)
