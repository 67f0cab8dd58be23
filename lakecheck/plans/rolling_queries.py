"""Windows over keys and per-period counts."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta

from pyspark.sql import functions as F

from lakecheck.functions.exprs import money
from lakecheck.operators import keys, mart, partials, rolling
from lakecheck.plans.inputs import EVENTS_DAY, ORDERS_DAY, Inputs
from lakecheck.plans.mart_queries import FULL, full_orders
from lakecheck.plans.registry import mean, query
from lakecheck.session import scratch_folder


@query(
    "dedup_latest",
    """SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""",
)
def _(t: Inputs):
    return keys.dedup_latest(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")])


@query("top_category", f"WITH {FULL} SELECT customer_id, top_category AS category, category_count FROM top")
def _(t: Inputs):
    return mart.top_category(mart.category_counts(full_orders(t)))


def z_rows(rows: int) -> str:
    return f"""WITH c AS (SELECT inactive_reason, load_date, count(*) AS cnt FROM movements WHERE inactive_reason IS NOT NULL GROUP BY ALL),
        s AS (SELECT *, round(avg(cnt) OVER w, 6) AS m, round(stddev_samp(cnt) OVER w, 6) AS sd FROM c
              WINDOW w AS (PARTITION BY inactive_reason ORDER BY load_date ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING)),
        z AS (SELECT *, round((cnt - m) / NULLIF(sd, 0), 3) AS z FROM s)
        SELECT inactive_reason, load_date, cnt AS current_count, round(m, 2) AS rolling_avg, round(sd, 2) AS rolling_stddev,
               z AS z_score, CASE WHEN abs(z) <= 2 THEN 'PASS' ELSE 'FAIL' END AS status FROM z"""


@query("rolling_zscore_rows", z_rows(60))
def _(t: Inputs):
    with_reason = t.movements.filter(F.col("inactive_reason").isNotNull())
    counts = rolling.period_counts(with_reason, ["inactive_reason"], "load_date", "load_date")
    return rolling.rolling_zscore_rows(counts, ["inactive_reason"], "load_date")


def z_days(daily: str, value: str, day: str, scale: int) -> str:
    return f"""WITH d AS ({daily}),
        b AS (SELECT d.load_date, any_value(d.{value}) AS {value}, sum(x.{value}) AS total, count(x.{value}) AS n,
                     round(stddev_samp(CAST(x.{value} AS DOUBLE)), 2) AS stddev
              FROM d JOIN d x ON x.load_date >= d.load_date - 30 AND x.load_date < d.load_date
              WHERE d.load_date BETWEEN {day} - 7 AND {day} GROUP BY d.load_date),
        r AS (SELECT load_date, {value}, {mean("total", "n", scale, scale)} AS mean, stddev FROM b),
        z AS (SELECT *, CASE WHEN stddev > 0 THEN round((CAST({value} AS DOUBLE) - mean) / stddev, 2) ELSE 0.0 END AS z_score FROM r)
        SELECT *, CASE WHEN abs(z_score) >= 3 THEN 'CRITICAL' WHEN abs(z_score) >= 2 THEN 'WARNING' ELSE 'NORMAL' END AS z_flag FROM z"""


Z_DAYS = z_days("SELECT load_date, count(*) AS today_count FROM movements GROUP BY 1", "today_count", f"DATE '{EVENTS_DAY}'", 0)


@query("rolling_zscore_30d", Z_DAYS)
def _(t: Inputs):
    recent = keys.within_days(t.movements, "load_date", EVENTS_DAY - timedelta(days=37), EVENTS_DAY)
    daily = recent.groupBy("load_date").agg(F.count(F.lit(1)).alias("today_count"))
    return rolling.rolling_zscore_days(daily, "load_date", "today_count", EVENTS_DAY)


@query("rolling_zscore_30d_partials", Z_DAYS)
def _(t: Inputs):
    # the state of two days ago, brought up to date from the rows of the days since
    root = scratch_folder(t.spark, "daily-counts")
    since = datetime.combine(EVENTS_DAY - timedelta(days=1), time.min)
    measures = {"today_count": F.count(F.lit(1))}
    partials.refresh_partials(t.events.filter(F.col("ts") < F.lit(since)), root, "ts", measures)
    changed = partials.changed_days(t.events, "ts", "ts", since)
    partials.refresh_partials(t.events, root, "ts", measures, days=changed)
    daily = partials.read_partials(t.spark, root, EVENTS_DAY - timedelta(days=37), EVENTS_DAY)
    return rolling.rolling_zscore_days(daily.withColumnRenamed(partials.DAY, "load_date"), "load_date", "today_count", EVENTS_DAY)


@query(
    "rolling_zscore_30d_amount",
    z_days(
        "SELECT load_date, CAST(sum(amount) AS DECIMAL(28,2)) AS today_amount FROM transactions GROUP BY 1",
        "today_amount",
        f"DATE '{ORDERS_DAY}'",
        2,
    ),
)
def _(t: Inputs):
    recent = keys.within_days(t.transactions, "load_date", ORDERS_DAY - timedelta(days=37), ORDERS_DAY)
    daily = recent.groupBy("load_date").agg(money(F.sum("amount")).alias("today_amount"))
    return rolling.rolling_zscore_days(daily, "load_date", "today_amount", ORDERS_DAY, digits=2)


@query(
    "moving_avg_12m_anomaly",
    """WITH c AS (SELECT movement_subcategory, load_date, count(*) AS cnt FROM movements GROUP BY ALL),
        r AS (SELECT *, round(avg(cnt) OVER w, 4) AS m, round(stddev_samp(cnt) OVER w, 4) AS s FROM c
              WINDOW w AS (PARTITION BY movement_subcategory ORDER BY load_date ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
        SELECT movement_subcategory, load_date, cnt, round(m, 2) AS moving_avg,
               CASE WHEN abs(cnt - m) > 2 * s THEN 'ANOMALY' ELSE 'NORMAL' END AS anomaly_flag FROM r""",
)
def _(t: Inputs):
    counts = rolling.period_counts(t.movements, ["movement_subcategory"], "load_date", "load_date")
    return rolling.moving_average_anomaly(counts, ["movement_subcategory"], "load_date")


@query(
    "moving_avg_12m_orders",
    """WITH c AS (SELECT product_code, CAST(date_trunc('month', load_date) AS DATE) AS month, count(*) AS cnt FROM transactions GROUP BY ALL),
        r AS (SELECT *, round(avg(cnt) OVER w, 4) AS m, round(stddev_samp(cnt) OVER w, 4) AS s FROM c
              WINDOW w AS (PARTITION BY product_code ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
        SELECT product_code, month, cnt, round(m, 2) AS moving_avg,
               CASE WHEN abs(cnt - m) > 2 * s THEN 'ANOMALY' ELSE 'NORMAL' END AS anomaly_flag FROM r""",
)
def _(t: Inputs):
    counts = rolling.period_counts(t.transactions, ["product_code"], F.trunc("load_date", "MM"), "month")
    return rolling.moving_average_anomaly(counts, ["product_code"], "month")


@query(
    "rolling_10m_deviation",
    """WITH c AS (SELECT movement_category, load_date, count(*) AS cnt FROM movements
                  WHERE movement_category IN ('ADD', 'DEDUCT') AND product_type = 'CLASSIC' GROUP BY ALL),
        r AS (SELECT *, round(avg(cnt) OVER (PARTITION BY movement_category ORDER BY load_date
              ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 4) AS m FROM c),
        d AS (SELECT *, round(abs(cnt - m) * 100 / NULLIF(m, 0), 2) AS deviation_pct FROM r)
        SELECT movement_category, load_date, cnt, round(m, 2) AS rolling_avg, deviation_pct,
               CASE WHEN deviation_pct > 10 THEN 'Y' ELSE 'N' END AS deviates FROM d""",
)
def _(t: Inputs):
    kept = t.movements.filter(F.col("movement_category").isin("ADD", "DEDUCT") & (F.col("product_type") == "CLASSIC"))
    counts = rolling.period_counts(kept, ["movement_category"], "load_date", "load_date")
    return rolling.rolling_deviation(counts, ["movement_category"], "load_date")


@query(
    "rolling_10m_deviation_decay",
    """WITH c AS (SELECT movement_category, movement_subcategory, CAST(date_trunc('month', load_date) AS DATE) AS month, count(*) AS cnt FROM movements
                  WHERE movement_subcategory IN ('ARREARS', 'CANCEL') AND product_type = 'CLASSIC' GROUP BY ALL),
        r AS (SELECT *, round(avg(cnt) OVER (PARTITION BY movement_category, movement_subcategory ORDER BY month
              ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 4) AS m FROM c),
        d AS (SELECT *, round(abs(cnt - m) * 100 / NULLIF(m, 0), 2) AS deviation_pct FROM r)
        SELECT movement_category, movement_subcategory, month, cnt, round(m, 2) AS rolling_avg, deviation_pct,
               CASE WHEN deviation_pct > 10 THEN 'Y' ELSE 'N' END AS deviates FROM d""",
)
def _(t: Inputs):
    # losses by month
    by = ["movement_category", "movement_subcategory"]
    kept = t.movements.filter(F.col("movement_subcategory").isin("ARREARS", "CANCEL") & (F.col("product_type") == "CLASSIC"))
    return rolling.rolling_deviation(rolling.period_counts(kept, by, F.trunc("load_date", "MM"), "month"), by, "month")


REAPPEAR = """WITH n AS (SELECT snapshot_date, row_number() OVER (ORDER BY snapshot_date) AS no
                   FROM (SELECT DISTINCT snapshot_date FROM presence) d),
        p AS (SELECT k, p.snapshot_date, no, lag(no) OVER w AS before, lag(p.snapshot_date) OVER w AS last_seen
              FROM presence p JOIN n ON p.snapshot_date = n.snapshot_date WINDOW w AS (PARTITION BY k ORDER BY no))
        SELECT k, last_seen, snapshot_date AS reappeared_on, no - before - 1 AS missed_snapshots FROM p WHERE no - before > 1"""


@query("delete_reappear", REAPPEAR)
def _(t: Inputs):
    return rolling.delete_reappear(t.presence, "k", "snapshot_date")


@query("delete_reappear_bits", REAPPEAR)
def _(t: Inputs):
    return rolling.delete_reappear_bits(t.presence, "k", "snapshot_date", date(2024, 1, 1))
