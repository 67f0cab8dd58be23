"""Input views over the driver tables.

The text of every view runs unchanged on Spark SQL and on DuckDB, so an operator and its check read the
same rows. The views give the driver tables the shape of loaded, audited and monitored tables.
"""

from __future__ import annotations

import re
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region",
    "nation",
    "customer",
    "supplier",
    "part",
    "orders",
    "lineitem",
    "events",
    "documents",
    "embeddings",
    "pages",
    "benchmark",
    "labels",
    "conversations",
)

# "today" of the views made from events and of those made from orders
EVENTS_DAY = date(2024, 1, 30)
EVENTS_NOW = datetime(2024, 1, 30, 18, 0)
ORDERS_DAY = date(2001, 7, 31)

VIEWS = {
    "customers_v": """
        SELECT c_custkey AS customer_id, c_name AS customer_name, r_name AS region, c_acctbal >= 0 AS active
        FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
    """,
    "lines": """
        SELECT l_orderkey AS order_id, o_custkey AS customer_id, l_partkey AS product_id, CAST(o_orderdate AS DATE) AS order_date,
               CAST(l_quantity AS BIGINT) AS quantity, CAST(l_extendedprice AS DECIMAL(18,2)) AS total_amount,
               CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'open' ELSE 'pending' END AS status
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
    """,
    "products_v": """
        SELECT p_partkey AS product_id, p_name AS product_name, p_type AS category, p_size <= 45 AS active,
               CAST(p_retailprice AS DECIMAL(18,2)) AS price, CAST(floor(CAST(p_retailprice AS DECIMAL(18,2)) * (50 + p_size) / 100) AS DECIMAL(18,2)) AS cost
        FROM part
    """,
    "orders_q": """
        SELECT o_orderkey AS order_id,
               CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_custkey END AS customer_id,
               CASE WHEN o_orderkey % 97 = 0 THEN o_custkey + 10000000 ELSE o_custkey END AS fk_customer,
               CASE WHEN o_orderkey % 31 = 0 THEN 'X' WHEN o_orderkey % 37 = 0 THEN NULL ELSE o_orderstatus END AS status_code,
               CASE WHEN o_orderkey % 40 = 0 THEN '0001-01-01' WHEN o_orderkey % 41 = 0 THEN 'bad'
                    WHEN o_orderkey % 43 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS eff_d,
               CASE WHEN o_orderkey % 29 = 0 THEN '1850' ELSE CAST(year(o_orderdate) AS STRING) END AS join_year,
               CASE WHEN o_orderkey % 23 = 0 THEN 'n/a' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END AS amount_txt,
               o_orderdate AS load_ts,
               CASE WHEN o_orderkey % 10 = 0 THEN o_orderdate + INTERVAL 1 DAY ELSE NULL END AS update_ts
        FROM orders
    """,
    "orders_src": """
        SELECT o_orderkey AS k, o_orderstatus AS status, o_orderpriority AS priority, CAST(o_totalprice AS DECIMAL(18,2)) AS amount
        FROM orders WHERE o_orderkey % 89 <> 0
    """,
    "orders_tgt": """
        SELECT o_orderkey AS k, CASE WHEN o_orderkey % 101 = 0 THEN lower(o_orderstatus) ELSE o_orderstatus END AS status,
               CASE WHEN o_orderkey % 103 = 0 THEN NULL ELSE o_orderpriority END AS priority,
               CAST(o_totalprice AS DECIMAL(18,2)) AS amount
        FROM orders WHERE o_orderkey % 97 <> 0
    """,
    "movements": """
        SELECT event_id, user_id AS member_id, CAST(ts AS DATE) AS load_date,
               CASE event_type WHEN 'signup' THEN 'ADD' WHEN 'error' THEN 'DEDUCT' ELSE 'INFORCE' END AS movement_category,
               CASE WHEN user_id % 4 = 0 THEN 'NEW' WHEN user_id % 4 = 1 THEN 'ARREARS' WHEN user_id % 4 = 2 THEN 'CANCEL' ELSE 'TRANSFER' END AS movement_subcategory,
               CASE WHEN user_id % 3 = 0 THEN 'CLASSIC' WHEN user_id % 3 = 1 THEN 'PLUS' ELSE 'PREMIER' END AS product_type,
               lpad(CAST(user_id % 15 AS STRING), 3, '0') AS club_code,
               CASE WHEN event_id % 19 = 0 THEN NULL ELSE 'R' || CAST(event_id % 5 AS STRING) END AS inactive_reason,
               ts AS transaction_ts
        FROM events
    """,
    "audit": """
        SELECT 'r' || CAST(event_id % 60 AS STRING) AS run_id, CAST(CAST(ts AS DATE) AS STRING) AS run_date, ts AS event_timestamp,
               CASE WHEN event_id % 60 % 3 = 0 THEN 'BASE_' WHEN event_id % 60 % 3 = 1 THEN 'MASTER_' ELSE '' END ||
               CASE event_type WHEN 'click' THEN 'VALIDATION' WHEN 'view' THEN 'COMPARISON' WHEN 'error' THEN 'STALE_CHECK'
                               WHEN 'signup' THEN 'GLUE_TRIGGER' ELSE 'SUMMARY_QUERY' END AS event_type,
               CASE WHEN event_id % 4 = 0 THEN 'stg_orders' WHEN event_id % 4 = 1 THEN 'orders_base' WHEN event_id % 4 = 2 THEN 'orders_master' ELSE '' END AS source_label,
               CASE WHEN event_id % 7 = 0 THEN 'FAIL' WHEN event_id % 11 = 0 THEN 'WARN' WHEN event_id % 13 = 0 THEN 'NOT_EXECUTED'
                    WHEN event_id % 17 = 0 THEN 'ABORTED' WHEN event_id % 19 = 0 THEN 'SKIPPED' ELSE 'PASS' END AS status,
               CASE WHEN event_id % 6 = 0 THEN '' ELSE 'check_' || CAST(event_id % 25 AS STRING) END AS validation_name,
               CASE WHEN event_id % 5 = 0 THEN 'row_count' WHEN event_id % 5 = 1 THEN 'no_rows' WHEN event_id % 5 = 2 THEN 'threshold'
                    WHEN event_id % 5 = 3 THEN 'rolling_average' ELSE '' END AS check_type,
               CASE WHEN event_id % 8 = 0 THEN '' ELSE CAST(CAST(value / 10000 AS DECIMAL(18,6)) AS STRING) END AS cost_usd,
               CAST(CAST(floor(value) AS BIGINT) AS STRING) AS glue_duration_sec,
               CASE WHEN event_id % 60 % 9 = 0 THEN 'FAIL' ELSE 'PASS' END AS overall_status
        FROM events
    """,
    "pipe_audit": """
        SELECT 'p' || CAST(event_id % 40 AS STRING) AS run_id, CAST(CAST(ts AS DATE) AS STRING) AS run_date, ts AS event_timestamp,
               'pipe_' || CAST(event_id % 40 % 4 AS STRING) AS pipeline_name, 'step_' || CAST(event_id % 6 AS STRING) AS step_name,
               CASE WHEN event_id % 6 = 0 THEN 'merge' WHEN event_id % 6 = 1 THEN 'insert' ELSE 'sql' END AS step_type,
               CASE WHEN event_id % 14 = 0 THEN 'FAIL' WHEN event_id % 33 = 0 THEN 'ABORTED' ELSE 'PASS' END AS status,
               CASE WHEN event_id % 28 = 0 THEN 'true' ELSE 'false' END AS rollback_executed,
               event_id % 5 * 1099511627776 / 8 AS data_scanned_bytes,
               CASE WHEN event_id % 8 = 0 THEN '' ELSE CAST(CAST(value / 10000 AS DECIMAL(18,6)) AS STRING) END AS cost_usd,
               CASE WHEN event_id % 9 = 0 THEN '' ELSE CAST(CAST(value AS DECIMAL(18,2)) AS STRING) END AS duration_sec
        FROM events
    """,
    "job_runs": """
        SELECT 'job' || CAST(user_id % 8 AS STRING) AS job_name, 'domain' || CAST(user_id % 8 % 3 AS STRING) AS domain,
               event_id AS run_id, ts AS started_on, CAST(floor(CAST(value AS DECIMAL(18,2)) * 60) AS BIGINT) AS exec_sec, CAST(floor(CAST(value AS DECIMAL(18,2)) * 300) AS BIGINT) AS dpu_seconds,
               CASE WHEN event_id % 9 = 0 THEN 'FAILED' WHEN event_id % 401 = 0 THEN 'RUNNING' ELSE 'SUCCEEDED' END AS state,
               CASE WHEN event_id % 2 = 0 THEN 'G.1X' ELSE 'G.2X' END AS worker_type, 10 AS num_workers,
               CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 29 = 0 THEN 'bad' ELSE lpad(CAST(9 + user_id % 8 AS STRING), 2, '0') || ':00' END AS sla,
               CASE WHEN event_id % 9 = 0 THEN 'boom' ELSE '' END AS error_message
        FROM events
    """,
    "transactions": """
        SELECT CAST(o_orderdate AS DATE) AS load_date, n_name AS state_code, c_mktsegment AS club_id, o_orderpriority AS bill_plan,
               o_orderstatus AS product_code, CAST(o_totalprice AS DECIMAL(18,2)) AS amount
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    """,
    "presence": """
        SELECT DISTINCT user_id AS k, CAST(ts AS DATE) AS snapshot_date FROM events
    """,
    "policies": """
        SELECT o_orderkey AS policy_id, CASE WHEN o_orderkey % 61 = 0 THEN NULL ELSE o_orderkey % 14000 END AS application_id,
               CAST(o_orderdate AS DATE) AS source_file_date, CASE WHEN o_orderkey % 71 = 0 THEN -1 ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS face_amount,
               CAST(100 + o_orderkey % 7 AS DECIMAL(18,2)) AS modal_premium,
               CAST((100 + o_orderkey % 7) * CASE WHEN o_orderkey % 53 = 0 THEN 11 ELSE 12 END AS DECIMAL(18,2)) AS annualized_premium,
               CASE WHEN o_orderkey % 3 = 0 THEN 'ANNUAL' ELSE 'MONTHLY' END AS bill_mode,
               CAST(o_orderdate AS DATE) AS effective_date,
               CAST(o_orderdate + INTERVAL 365 DAY AS DATE) AS expiry_date,
               CASE WHEN o_orderkey % 47 = 0 THEN CAST(o_orderdate - INTERVAL 5 DAY AS DATE) ELSE NULL END AS termination_date
        FROM orders
    """,
    "failures": """
        SELECT event_id AS record_id, 'rule_' || CAST(event_id % 12 AS STRING) AS rule_name, 'table_' || CAST(event_id % 5 AS STRING) AS table_name,
               CASE WHEN event_id % 4 = 0 THEN 'NOT_NULL' WHEN event_id % 4 = 1 THEN 'RANGE' WHEN event_id % 4 = 2 THEN 'REGEX' ELSE 'UNIQUENESS' END AS rule_type,
               'col_' || CAST(event_id % 3 AS STRING) AS column_name, CAST(floor(value) AS BIGINT) AS row_count_failed, event_id % 7 * 100 AS total_row_count,
               CASE WHEN event_id % 5 = 0 THEN 'FALSE_POSITIVE' WHEN event_id % 5 = 1 THEN 'NEEDS_INVESTIGATION' ELSE 'TRUE_FAILURE' END AS classification,
               CAST(event_id % 100 AS DOUBLE) / 100 AS confidence, ts AS failure_timestamp
        FROM events WHERE event_type = 'error'
    """,
    "outcomes": """
        SELECT event_id AS outcome_id, 'rule_' || CAST(event_id % 12 AS STRING) AS rule_name, 'table_' || CAST(event_id % 5 AS STRING) AS table_name,
               CASE WHEN event_id % 5 = 0 THEN 'FALSE_POSITIVE' ELSE 'TRUE_FAILURE' END AS classification,
               CASE WHEN event_id % 3 = 0 THEN 'RERUN' WHEN event_id % 3 = 1 THEN 'FIX_LOGIC' ELSE 'IGNORE' END AS action,
               event_id % 4 <> 0 AS was_correct, CAST(event_id % 100 AS DOUBLE) / 100 AS confidence, ts AS resolved_at
        FROM events WHERE event_type = 'view'
    """,
    "recon_counts": """
        SELECT CAST(ts AS DATE) AS extract_date, event_type AS table_name, count(*) AS count_source,
               count(CASE WHEN event_id % 200 <> 0 THEN 1 END) AS count_target
        FROM events GROUP BY CAST(ts AS DATE), event_type
    """,
    "listing": """
        SELECT 'src' || CAST(user_id % 5 AS STRING) AS source,
               CASE WHEN user_id % 5 = 4 THEN NULL WHEN user_id % 5 = 0 THEN 'f' || CAST(user_id % 3 AS STRING)
                    WHEN user_id % 5 = 1 THEN 'f' || CAST(user_id % 8 AS STRING)
                    ELSE 'f' || CAST(user_id % 2 AS STRING) END AS subfolder,
               'part-' || CAST(event_id AS STRING) AS path,
               CASE WHEN user_id % 5 = 3 THEN ts - INTERVAL 9 HOUR ELSE ts END AS modified,
               event_id % 1000 AS length
        FROM events
    """,
}


class Inputs:
    """Driver tables and derived views of one data folder, as lazy frames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def path(self, table: str) -> str:
        return f"{self.sf_dir}/{table}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(self.path(name))
        if name in VIEWS:
            files = re.sub(
                rf"\b(FROM|JOIN) ({'|'.join(TABLES)})\b", lambda m: f"{m[1]} parquet.`{self.path(m[2])}`", VIEWS[name]
            )
            return self.spark.sql(files)
        raise AttributeError(name)


def with_views(sql: str) -> str:
    """The text with the views it names placed in front."""
    used = [name for name in VIEWS if re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", sql)]
    if not used:
        return sql
    ctes = ", ".join(f"{name} AS ({VIEWS[name]})" for name in used)
    rest = re.sub(r"^\s*WITH\s+", ", ", sql) if re.match(r"\s*WITH\s", sql) else f" {sql}"
    return f"WITH {ctes}{rest}"
