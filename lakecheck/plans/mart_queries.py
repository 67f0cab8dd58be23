"""Filters, derived columns, joins, aggregations and top-k."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import functions as F

from lakecheck.functions import exprs
from lakecheck.operators import checks, compare, jobs, keys, mart, members, outcomes, partials, topn
from lakecheck.plans.inputs import EVENTS_DAY, EVENTS_NOW, ORDERS_DAY, Inputs
from lakecheck.plans.registry import mean, n_if, pct, query
from lakecheck.session import scratch_folder

SINCE = date(1998, 1, 1)

COMPLETED = f"""completed AS (SELECT * FROM lines WHERE status = 'completed' AND order_date >= DATE '{SINCE}'),
    people AS (SELECT * FROM customers_v WHERE active),
    items AS (SELECT * FROM products_v WHERE active)"""
MARGIN = "CAST(price - cost AS DOUBLE) / NULLIF(CAST(price AS DOUBLE), 0) * 100"
FULL = f"""{COMPLETED},
    joined AS (SELECT c.customer_id, customer_name, region, order_id, c.product_id, order_date, quantity, total_amount,
                      product_name, category, price, cost
               FROM completed c JOIN people p ON c.customer_id = p.customer_id
               LEFT JOIN items i ON c.product_id = i.product_id),
    priced AS (SELECT *, CAST({MARGIN} AS DECIMAL(18,6)) AS margin FROM joined),
    metrics AS (SELECT customer_id, customer_name, region, count(order_id) AS total_orders,
                       CAST(sum(quantity) AS BIGINT) AS total_quantity,
                       CAST(sum(total_amount) AS DECIMAL(28,2)) AS total_revenue,
                       {mean("sum(total_amount)", "count(total_amount)", 2, 4)} AS avg_order_value,
                       max(order_date) AS last_order_date,
                       {mean("sum(margin)", "count(margin)", 6, 4)} AS avg_profit_margin
                FROM priced GROUP BY ALL),
    counted AS (SELECT customer_id, category, count(*) AS category_count FROM priced GROUP BY ALL),
    top AS (SELECT customer_id, category AS top_category, category_count FROM counted
            QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY category_count DESC, category NULLS LAST) = 1)"""


def summary(t: Inputs):
    return mart.customer_order_summary(t.customers_v, t.lines, t.products_v, SINCE, ORDERS_DAY)


def completed(t: Inputs):
    return mart.completed_since(t.lines, SINCE)


def full_orders(t: Inputs):
    joined = mart.customer_orders(mart.active_only(t.customers_v), completed(t))
    full = mart.with_products(joined, mart.active_only(t.products_v))
    return full.withColumn("profit_margin_pct", mart.profit_margin())


query(
    "customer_order_summary",
    f"""WITH {FULL}
    SELECT m.*, top_category,
           round(CAST(total_revenue AS DOUBLE) * (1 + avg_profit_margin / 100), 2) AS customer_lifetime_value,
           TIMESTAMP '{ORDERS_DAY} 00:00:00' AS processed_at
    FROM metrics m LEFT JOIN top t ON m.customer_id = t.customer_id""",
)(summary)


# ---- filters and derived columns ---------------------------------------------------------------


@query(
    "filter_active_completed",
    f"WITH {COMPLETED} SELECT c.* FROM completed c JOIN items i ON c.product_id = i.product_id",
)
def _(t: Inputs):
    items = mart.active_only(t.products_v).select("product_id")
    return completed(t).join(items, "product_id", "left_semi")


@query(
    "project_rename",
    "SELECT order_id, customer_id AS buyer_id, order_date AS placed_on, quantity, total_amount AS amount FROM lines",
)
def _(t: Inputs):
    renamed = t.lines.withColumnsRenamed({"customer_id": "buyer_id", "order_date": "placed_on"})
    return renamed.select("order_id", "buyer_id", "placed_on", "quantity", F.col("total_amount").alias("amount"))


@query(
    "derive_profit_margin",
    f"SELECT product_id, category, price, cost, CAST({MARGIN} AS DECIMAL(18,6)) AS profit_margin_pct FROM products_v",
)
def _(t: Inputs):
    return t.products_v.select(
        "product_id", "category", "price", "cost", mart.profit_margin().cast("decimal(18,6)").alias("profit_margin_pct")
    )


@query(
    "derive_clv",
    f"""WITH {FULL} SELECT customer_id,
        round(CAST(total_revenue AS DOUBLE) * (1 + avg_profit_margin / 100), 2) AS customer_lifetime_value FROM metrics""",
)
def _(t: Inputs):
    value = mart.lifetime_value(F.col("total_revenue"), F.col("avg_profit_margin"))
    return mart.customer_metrics(full_orders(t)).select("customer_id", F.round(value, 2).alias("customer_lifetime_value"))


@query(
    "ingest_audit_columns",
    """SELECT order_id, status_code, 'N' AS hourly_processed_ind, 'N' AS daily_processed_ind,
        TIMESTAMP '2024-01-30 10:00:00' AS insert_timestamp, 'loader' AS inserted_by,
        TIMESTAMP '2024-01-30 10:00:00' AS updated_timestamp, 'loader' AS updated_by,
        TIMESTAMP '2024-01-30 18:00:00' AS load_timestamp FROM orders_q""",
)
def _(t: Inputs):
    return keys.with_ingest_columns(t.orders_q.select("order_id", "status_code"), EVENTS_NOW, "loader")


@query(
    "filter_load_slice",
    f"""SELECT order_id, load_ts, update_ts FROM orders_q
        WHERE CAST(load_ts AS DATE) = DATE '{ORDERS_DAY}' OR CAST(update_ts AS DATE) = DATE '{ORDERS_DAY}'""",
)
def _(t: Inputs):
    return keys.load_slice(t.orders_q, ORDERS_DAY, "load_ts", "update_ts").select("order_id", "load_ts", "update_ts")


ORDER_KEY = """concat_ws('^', coalesce(trim(CAST(order_id AS VARCHAR)), ''), coalesce(trim(CAST(customer_id AS VARCHAR)), ''),
    lower(coalesce(trim(status_code), '')), coalesce(CAST(TRY_CAST(eff_d AS DATE) AS VARCHAR), ''))"""


def order_key():
    return exprs.business_key(["order_id", "customer_id", "status_code", "eff_d"], dates=("eff_d",), lower=("status_code",))


@query("normalized_business_key", f"SELECT order_id, {ORDER_KEY} AS business_key FROM orders_q")
def _(t: Inputs):
    return t.orders_q.select("order_id", order_key().alias("business_key"))


@query(
    "filter_audit_multiselect",
    """SELECT run_id, run_date, event_type, status, validation_name FROM audit
       WHERE event_type IN ('VALIDATION', 'BASE_VALIDATION') AND status IN ('FAIL', 'WARN')
         AND lower(run_id) LIKE '%r1%' AND run_date BETWEEN '2024-01-20' AND '2024-01-30'""",
)
def _(t: Inputs):
    picked = keys.audit_selection(
        t.audit, date(2024, 1, 20), EVENTS_DAY, ["VALIDATION", "BASE_VALIDATION"], ["FAIL", "WARN"], "R1"
    )
    return picked.select("run_id", "run_date", "event_type", "status", "validation_name")


@query("mask_pii_hash", "SELECT customer_id, sha256(customer_name) AS customer_name, sha256(region) AS region FROM customers_v")
def _(t: Inputs):
    return keys.mask_columns(t.customers_v.select("customer_id", "customer_name", "region"), ["customer_name", "region"])


@query("retention_filter", f"SELECT * FROM orders WHERE o_orderdate >= DATE '{ORDERS_DAY}' - INTERVAL 5 YEAR")
def _(t: Inputs):
    return keys.retained(t.orders, "o_orderdate", ORDERS_DAY, 5)


@query(
    "source_system_label",
    """SELECT CASE WHEN table_name LIKE 'p%' THEN 'SALES' WHEN table_name LIKE 's%' THEN 'ACCOUNTS' ELSE 'WEB' END AS source_system,
        CAST(sum(count_source) AS BIGINT) AS total_rows FROM recon_counts GROUP BY 1""",
)
def _(t: Inputs):
    return keys.labelled_totals(t.recon_counts, "table_name", "count_source", {"p%": "SALES", "s%": "ACCOUNTS"}, "WEB")


# ---- joins -------------------------------------------------------------------------------------


@query(
    "join_customers_orders",
    f"""WITH {COMPLETED} SELECT c.customer_id, customer_name, region, order_id, product_id, order_date, quantity,
        total_amount, status FROM completed c JOIN people p ON c.customer_id = p.customer_id""",
)
def _(t: Inputs):
    return mart.customer_orders(mart.active_only(t.customers_v), completed(t))


@query("join_products_left", f"WITH {FULL} SELECT * FROM joined")
def _(t: Inputs):
    joined = mart.customer_orders(mart.active_only(t.customers_v), completed(t)).drop("status")
    return mart.with_products(joined, mart.active_only(t.products_v))


@query(
    "join_top_category_back",
    f"WITH {FULL} SELECT m.*, top_category FROM metrics m LEFT JOIN top t ON m.customer_id = t.customer_id",
)
def _(t: Inputs):
    return mart.metrics_with_top_category(t.customers_v, t.lines, t.products_v, SINCE)


def src_key_sql(side: str) -> str:
    return f"concat_ws('^', CAST({side}.k AS VARCHAR), coalesce(trim({side}.status), ''))"


def _src_key():
    return exprs.business_key(["k", "status"])


@query(
    "recon_missing_in_target",
    f"""SELECT count(*) AS cnt FROM orders_src a
        WHERE NOT EXISTS (SELECT 1 FROM orders_tgt b WHERE {src_key_sql("a")} = {src_key_sql("b")})""",
)
def _(t: Inputs):
    return keys.missing_count(t.orders_src, t.orders_tgt, _src_key(), _src_key())


@query(
    "recon_missing_rows",
    """SELECT a.* FROM orders_src a WHERE NOT EXISTS (SELECT 1 FROM orders_tgt b WHERE a.k = b.k AND a.status = b.status)""",
)
def _(t: Inputs):
    return keys.missing_rows(t.orders_src, t.orders_tgt, _src_key(), _src_key())


# a slice of the orders against the whole target
SLICE = "(SELECT * FROM orders_src WHERE amount < 20000)"


def order_slice(t: Inputs):
    return t.orders_src.filter("amount < 20000")


@query(
    "recon_missing_in_target_slice",
    f"""SELECT count(*) AS cnt FROM {SLICE} a
        WHERE NOT EXISTS (SELECT 1 FROM orders_tgt b WHERE {src_key_sql("a")} = {src_key_sql("b")})""",
)
def _(t: Inputs):
    part = order_slice(t)
    return keys.missing_count(part, t.orders_tgt, _src_key(), _src_key(), expected=part.count())


@query(
    "recon_missing_rows_slice",
    f"SELECT a.* FROM {SLICE} a WHERE NOT EXISTS (SELECT 1 FROM orders_tgt b WHERE a.k = b.k AND a.status = b.status)",
)
def _(t: Inputs):
    part = order_slice(t)
    return keys.missing_rows(part, t.orders_tgt, _src_key(), _src_key(), expected=part.count())


@query(
    "cross_join_params",
    f"""WITH params AS (SELECT '1900' AS lo, '2100' AS hi)
        SELECT {n_if("join_year IS NULL OR join_year < lo OR join_year > hi")} AS cnt FROM orders_q CROSS JOIN params""",
)
def _(t: Inputs):
    # a one-row parameter table, read as a scalar subquery
    params = t.spark.createDataFrame([("1900", "2100")], "lo string, hi string")
    limits = params.select(F.struct("lo", "hi")).scalar()
    rows = t.orders_q.withColumn("_limits", limits)
    return rows.agg(F.count_if(checks.is_not_year(["join_year"], F.col("_limits.lo"), F.col("_limits.hi"))).alias("cnt"))


@query(
    "scalar_subquery_latest",
    """SELECT event_id, load_date, movement_category FROM movements m
        WHERE load_date = (SELECT max(load_date) FROM movements x WHERE x.movement_category = m.movement_category)""",
)
def _(t: Inputs):
    latest = keys.latest_rows(t.movements, "load_date", "movement_category")
    return latest.select("event_id", "load_date", "movement_category")


SIMILAR = """WITH matched AS (
    SELECT f.record_id, f.rule_name, f.table_name, o.outcome_id, o.rule_name AS past_rule, o.table_name AS past_table,
           o.classification, o.action, o.resolved_at,
           row_number() OVER (PARTITION BY f.record_id ORDER BY o.resolved_at DESC, o.outcome_id DESC) AS similar_rank
    FROM failures f JOIN outcomes o ON o.rule_name = f.rule_name OR o.table_name = f.table_name)
    SELECT * REPLACE (CAST(similar_rank AS INTEGER) AS similar_rank) FROM matched WHERE similar_rank <= 10"""


def similar(t: Inputs):
    return outcomes.similar_outcomes(t.failures, t.outcomes)


query("or_join_similar", SIMILAR)(similar)
query("fail_similar_outcomes", SIMILAR)(similar)


# ---- aggregations ------------------------------------------------------------------------------


@query("agg_customer_metrics", f"WITH {FULL} SELECT * FROM metrics")
def _(t: Inputs):
    return mart.customer_metrics(full_orders(t))


@query("agg_category_counts", f"WITH {FULL} SELECT * FROM counted")
def _(t: Inputs):
    return mart.category_counts(full_orders(t))


@query(
    "agg_conditional_status",
    f"""SELECT source_label, {n_if("status = 'PASS'")} AS passed, {n_if("status = 'FAIL'")} AS failed,
        {n_if("status = 'WARN'")} AS warned, {n_if("status = 'NOT_EXECUTED'")} AS not_executed
        FROM audit GROUP BY source_label""",
)
def _(t: Inputs):
    names = {"passed": "PASS", "failed": "FAIL", "warned": "WARN", "not_executed": "NOT_EXECUTED"}
    counts = [F.count_if(F.col("status") == status).alias(name) for name, status in names.items()]
    return t.audit.groupBy("source_label").agg(*counts)


@query(
    "agg_distinct_counts",
    """SELECT state_code, count(*) AS total, count(DISTINCT club_id) AS clubs, count(DISTINCT load_date) AS days,
        count(DISTINCT product_code) AS products FROM transactions GROUP BY state_code""",
)
def _(t: Inputs):
    distinct = {"clubs": "club_id", "days": "load_date", "products": "product_code"}
    return members.counts_by(t.transactions, ["state_code"], "total", distinct=distinct)


@query(
    "agg_distinct_composite",
    """SELECT count(DISTINCT CAST(customer_id AS VARCHAR) || '|' || status_code || '|' || join_year) AS cnt FROM orders_q""",
)
def _(t: Inputs):
    return compare.distinct_keys(t.orders_q, ["customer_id", "status_code", "join_year"])


@query(
    "agg_having_duplicates",
    "SELECT l_orderkey, l_linenumber, count(*) AS cnt FROM lineitem GROUP BY ALL HAVING count(*) > 1",
)
def _(t: Inputs):
    return checks.duplicates(t.lineitem, ["l_orderkey", "l_linenumber"])


@query(
    "agg_minmax_by_day",
    """SELECT load_date AS load_day, max(transaction_ts) AS max_ts, min(transaction_ts) AS min_ts
       FROM movements GROUP BY load_date""",
)
def _(t: Inputs):
    return checks.last_transaction_previous_day(t.movements, "load_date", "transaction_ts").select(
        "load_day", "max_ts", "min_ts"
    )


@query(
    "agg_daily_counts_union",
    f"""SELECT 'movements' AS table_name, count(*) AS row_count FROM movements WHERE load_date = DATE '{EVENTS_DAY}'
        UNION ALL SELECT 'events', count(*) FROM events WHERE CAST(ts AS DATE) = DATE '{EVENTS_DAY}'
        UNION ALL SELECT 'orders', count(*) FROM orders WHERE CAST(o_orderdate AS DATE) = DATE '{EVENTS_DAY}'""",
)
def _(t: Inputs):
    tables = {"movements": (t.movements, "load_date"), "events": (t.events, "ts"), "orders": (t.orders, "o_orderdate")}
    return members.day_counts(tables, EVENTS_DAY)


@query(
    "agg_daily_trend_7d",
    f"""SELECT CAST(ts AS DATE) AS load_date, count(*) AS total_rows FROM events
        WHERE CAST(ts AS DATE) BETWEEN DATE '{EVENTS_DAY}' - 7 AND DATE '{EVENTS_DAY}' GROUP BY 1""",
)
def _(t: Inputs):
    return members.daily_counts(t.events, "ts", EVENTS_DAY - timedelta(days=7), EVENTS_DAY)


@query(
    "agg_total_row",
    """SELECT coalesce(domain, 'TOTAL') AS domain, count(*) AS runs, CAST(sum(dpu_seconds) AS BIGINT) AS dpu_seconds
       FROM job_runs GROUP BY ROLLUP (domain)""",
)
def _(t: Inputs):
    totals = t.job_runs.rollup("domain").agg(
        F.count(F.lit(1)).alias("runs"), F.sum("dpu_seconds").alias("dpu_seconds"), F.grouping("domain").alias("_all")
    )
    return totals.withColumn("domain", F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col("domain"))).drop("_all")


@query(
    "agg_zero_filled_days",
    f"""WITH days AS (SELECT CAST(unnest(generate_series(DATE '{EVENTS_DAY}' - 3, DATE '{EVENTS_DAY}' + 3, INTERVAL 1 DAY)) AS DATE) AS day),
        counted AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1)
        SELECT d.day, coalesce(n, 0) AS n FROM days d LEFT JOIN counted c ON d.day = c.day""",
)
def _(t: Inputs):
    # the last of the seven days have no events yet
    return jobs.daily_rows(t.events, "ts", EVENTS_DAY + timedelta(days=3), 7)


# ---- top-k -------------------------------------------------------------------------------------


@query(
    "topn_groups",
    """WITH top AS (SELECT state_code FROM transactions GROUP BY 1 ORDER BY count(*) DESC, state_code LIMIT 5)
       SELECT state_code, load_date, count(*) AS cnt FROM transactions WHERE state_code IN (SELECT state_code FROM top)
       GROUP BY ALL""",
)
def _(t: Inputs):
    series = t.transactions.groupBy("state_code", "load_date").agg(F.count(F.lit(1)).alias("cnt"))
    return topn.top_groups(series, "state_code", "cnt", 5)


@query(
    "topn_others",
    """WITH totals AS (SELECT state_code, CAST(sum(amount) AS DECIMAL(28,2)) AS total FROM transactions GROUP BY 1),
        ranked AS (SELECT *, row_number() OVER (ORDER BY total DESC, state_code) AS rn FROM totals)
        SELECT CASE WHEN rn <= 5 THEN state_code ELSE 'Others' END AS state_code, CAST(sum(total) AS DECIMAL(28,2)) AS total
        FROM ranked GROUP BY 1 HAVING sum(total) > 0 OR min(rn) <= 5""",
)
def _(t: Inputs):
    top = topn.top_with_others(t.transactions, "state_code", "amount", 5)
    return top.select("state_code", exprs.money(F.col("total")).alias("total"))


# ---- member and transaction summaries ----------------------------------------------------------

WINDOW = f"FROM transactions WHERE load_date >= DATE '{ORDERS_DAY}' - 30"


STATEWISE = f"""SELECT state_code, count(*) AS total_members, count(DISTINCT club_id) AS clubs_active,
        count(DISTINCT load_date) AS days_active {WINDOW} GROUP BY state_code"""


@query("sum_statewise_members", STATEWISE)
def _(t: Inputs):
    return members.statewise_members(t.transactions, ORDERS_DAY)


@query("sum_statewise_members_partials", STATEWISE)
def _(t: Inputs):
    # counts and bitmaps of all days but the last ones, then of these; the window slides without rereading a row
    root, first = scratch_folder(t.spark, "members"), ORDERS_DAY - timedelta(days=30)
    yesterday = ORDERS_DAY - timedelta(days=1)
    # state is kept for the days of the window
    before = t.transactions.filter(F.col("load_date").between(F.lit(first), F.lit(yesterday - timedelta(days=1))))
    late = partials.changed_days(t.transactions, "load_date", "load_date", datetime.combine(yesterday, time.min))
    for rows, days in ((before, None), (t.transactions, late)):
        partials.refresh_partials(rows, f"{root}/counts", "load_date", {"n": F.count(F.lit(1))}, ["state_code"], days)
        partials.refresh_distincts(rows, root, "load_date", ["club_id"], ["state_code"], days)
    kept = partials.read_partials(t.spark, f"{root}/counts", first)
    totals = kept.groupBy("state_code").agg(F.sum("n").alias("total_members"), F.count(F.lit(1)).alias("days_active"))
    clubs = partials.distinct_counts(t.spark, root, ["club_id"], ["state_code"], first)
    return totals.join(clubs, "state_code").select("state_code", "total_members", F.col("club_id").alias("clubs_active"), "days_active")


@query(
    "sum_clubwise_members",
    f"""SELECT club_id, count(*) AS total_members, count(DISTINCT state_code) AS states_present,
        count(DISTINCT bill_plan) AS plan_types {WINDOW} GROUP BY club_id""",
)
def _(t: Inputs):
    return members.clubwise_members(t.transactions, ORDERS_DAY)


@query(
    "sum_statewise_transactions",
    f"""SELECT state_code, count(*) AS txn_count, CAST(sum(amount) AS DECIMAL(28,2)) AS total_amount,
        count(DISTINCT product_code) AS products_active {WINDOW} GROUP BY state_code""",
)
def _(t: Inputs):
    return members.statewise_transactions(t.transactions, ORDERS_DAY)


@query(
    "sum_daily_trend_30d",
    f"""SELECT load_date, count(*) AS total_records, CAST(sum(amount) AS DECIMAL(28,2)) AS total_amount,
        count(DISTINCT state_code) AS active_states, count(DISTINCT club_id) AS active_clubs {WINDOW} GROUP BY load_date""",
)
def _(t: Inputs):
    return members.daily_trend(t.transactions, ORDERS_DAY)


# ---- failure analytics -------------------------------------------------------------------------

RATE = "round(coalesce(CAST(row_count_failed AS DOUBLE) / NULLIF(total_row_count, 0), 0), 6)"
LABEL = "CASE WHEN confidence >= 0.85 THEN 'HIGH' WHEN confidence >= 0.60 THEN 'MEDIUM' ELSE 'LOW' END"


@query("fail_rate", f"SELECT record_id, row_count_failed, total_row_count, {RATE} AS failure_rate FROM failures")
def _(t: Inputs):
    return outcomes.with_failure_rate(t.failures).select("record_id", "row_count_failed", "total_row_count", "failure_rate")


@query("fail_confidence_label", f"SELECT record_id, confidence, {LABEL} AS confidence_label FROM failures")
def _(t: Inputs):
    return t.failures.select("record_id", "confidence", outcomes.confidence_label().alias("confidence_label"))


@query(
    "fail_batch_summary",
    f"""WITH rules AS (SELECT rule_name, count(*) AS n FROM failures GROUP BY 1)
        SELECT count(*) AS failures, {n_if("classification = 'TRUE_FAILURE'")} AS true_failures,
        {n_if("classification = 'FALSE_POSITIVE'")} AS false_positives,
        {n_if("classification = 'NEEDS_INVESTIGATION'")} AS needs_investigation,
        (SELECT count(*) FROM rules WHERE n > 1) AS repeated_rules,
        CAST(round((1 - least(CAST(sum(row_count_failed) AS DOUBLE) / sum(total_row_count), 1)) * 100, 0) AS BIGINT) AS quality_score
        FROM failures""",
)
def _(t: Inputs):
    return outcomes.batch_summary(t.failures)


@query(
    "fail_top_issues",
    """SELECT rule_name, table_name, CAST(sum(row_count_failed) AS BIGINT) AS failed_rows, count(*) AS occurrences
       FROM failures GROUP BY ALL ORDER BY failed_rows DESC, rule_name, table_name LIMIT 3""",
)
def _(t: Inputs):
    return outcomes.top_issues(t.failures)


@query(
    "fail_false_positive_patterns",
    f"""SELECT rule_type, table_name, column_name, count(*) AS failures, {n_if("classification = 'FALSE_POSITIVE'")} AS frequency,
        {pct(n_if("classification = 'FALSE_POSITIVE'"), "count(*)", 2)} AS false_positive_pct
        FROM failures GROUP BY ALL HAVING {n_if("classification = 'FALSE_POSITIVE'")} > 0""",
)
def _(t: Inputs):
    return outcomes.false_positive_patterns(t.failures)


JUDGED = f"""count(was_correct) AS judged, {n_if("was_correct")} AS correct,
    {pct(n_if("was_correct"), "count(was_correct)", 2)} AS correct_pct"""


@query("fail_action_effectiveness", f"SELECT action, {JUDGED} FROM outcomes GROUP BY action")
def _(t: Inputs):
    return outcomes.action_effectiveness(t.outcomes)


@query("fail_confidence_calibration", f"SELECT {LABEL} AS confidence_label, {JUDGED} FROM outcomes GROUP BY 1")
def _(t: Inputs):
    return outcomes.confidence_calibration(t.outcomes)


@query(
    "learning_features",
    f"""SELECT record_id, rule_name, table_name, column_name, rule_type, {RATE} AS failure_rate, classification,
        confidence, {LABEL} AS confidence_label FROM failures""",
)
def _(t: Inputs):
    return outcomes.learning_features(t.failures).select("record_id", "features.*", "prediction.*")
