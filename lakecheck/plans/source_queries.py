"""Reads. Files are written from the given tables to a scratch folder first, then read back."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakecheck.plans.inputs import ORDERS_DAY, Inputs
from lakecheck.plans.registry import query
from lakecheck.session import scratch_folder
from lakecheck.sinks import writers
from lakecheck.sources import audit_files, files, listing, sql

ORDER = """SELECT o_orderkey AS order_key, CAST(o_custkey AS INTEGER) AS cust_key, o_orderstatus AS status, o_orderpriority AS priority"""


def landed(t: Inputs) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("order_key"),
        F.col("o_custkey").cast("int").alias("cust_key"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
    )


query("src_table_scan", "SELECT c_custkey, c_name, c_acctbal FROM customer")(
    lambda t: files.read_table(t.spark, t.path("customer")).select("c_custkey", "c_name", "c_acctbal")
)


@query("src_table_scan_catalog", "SELECT c_custkey, c_name, c_acctbal FROM customer")
def _(t: Inputs):
    path, name = scratch_folder(t.spark, "scan"), f"lakecheck_{uuid.uuid4().hex}"
    wanted = t.customer.select("c_custkey", "c_name", "c_acctbal")
    # the catalog entry goes at the end of the block, the files of an external table stay
    with writers.staging_table(wanted, name, path=path):
        return files.read_table(t.spark, f"{t.spark.catalog.currentDatabase()}.{name}")


@query("src_csv_landing", f"{ORDER} FROM orders")
def _(t: Inputs):
    root = scratch_folder(t.spark, "landing")
    # one subfolder per status, the value kept in the rows as well
    landed(t).withColumn("folder", F.col("status")).write.partitionBy("folder").option("header", True).csv(f"{root}/orders")
    dtype = {"order_key": "bigint", "cust_key": "int", "status": "str", "priority": "str"}
    return files.read_landings(t.spark, [{"landing_table": "orders", "landing_loc": root, "dtype": dtype}])["orders"]


@query(
    "src_schema_from_config",
    """SELECT o_orderkey AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS price, o_totalprice AS approx, CAST(o_orderdate AS DATE) AS day,
       o_orderstatus = 'O' AS is_open FROM orders""",
)
def _(t: Inputs):
    root = scratch_folder(t.spark, "typed")
    price = F.col("o_totalprice")
    typed = t.orders.select(
        F.col("o_orderkey").alias("k"),
        price.cast("decimal(18,2)").alias("price"),
        price.alias("approx"),
        F.to_date("o_orderdate").alias("day"),
        (F.col("o_orderstatus") == "O").alias("is_open"),
    )
    typed.write.option("header", True).csv(f"{root}/orders")
    config = {"k": "bigint", "price": "decimal(18,2)", "approx": "double", "day": "date", "is_open": "boolean"}
    return files.read_landing(t.spark, root, config)


COLUMNS = [
    {"name": "order_key", "type": "BIGINT"},
    {"name": "cust_key", "type": "INT"},
    {"name": "status", "type": "STRING"},
    {"name": "priority", "type": "STRING"},
]


@query(
    "src_external_files",
    f"SELECT o.*, f.fmt FROM ({ORDER} FROM orders) o CROSS JOIN (VALUES ('parquet'), ('orc'), ('json'), ('csv')) f(fmt)",
)
def _(t: Inputs):
    root = scratch_folder(t.spark, "external")
    read = []
    for fmt in files.FORMATS:
        writer = landed(t).write.format(fmt)
        (writer.option("header", True) if fmt == "csv" else writer).save(f"{root}/{fmt}")
        frame = files.read_external(t.spark, f"{root}/{fmt}", fmt.upper(), COLUMNS, skip_header=True)
        read.append(frame.withColumn("fmt", F.lit(fmt)))
    return read[0].unionByName(read[1]).unionByName(read[2]).unionByName(read[3])


@query("src_staged_read", f"SELECT order_key, priority FROM ({ORDER} FROM orders) o WHERE status = 'F'")
def _(t: Inputs):
    root = scratch_folder(t.spark, "staged")
    landed(t).write.parquet(f"{root}/raw")
    text = "SELECT order_key, priority FROM {source} WHERE status = 'F'"
    return files.staged_read(t.spark, f"{root}/raw", "PARQUET", COLUMNS, f"{root}/staged", text)


@query(
    "src_sql_view",
    "SELECT status, count(*) AS n, CAST(sum(quantity) AS BIGINT) AS quantity FROM lines WHERE quantity >= 20 GROUP BY status",
)
def _(t: Inputs):
    text = "SELECT status, count(*) AS n, sum(quantity) AS quantity FROM {lines} WHERE quantity >= :least GROUP BY status"
    return sql.run_sql(t.spark, text, {"lines": t.lines}, args={"least": 20})


@query(
    "src_sql_params",
    f"""SELECT order_id, load_ts, '{ORDERS_DAY}' AS run_date, 'run7' AS run_id FROM orders_q
        WHERE load_ts >= DATE '{ORDERS_DAY}' - 7 AND load_ts < DATE '{ORDERS_DAY}' + 1""",
)
def _(t: Inputs):
    text = """SELECT order_id, load_ts, '{run_date}' AS run_date, '{run_id}' AS run_id FROM {source}
        WHERE load_ts >= timestamp_ntz'{CURRENT_DATE-7}' AND load_ts < timestamp_ntz'{CURRENT_DATE+1}'"""
    return sql.run_sql(t.spark, text, {"source": t.orders_q}, sql.run_variables(ORDERS_DAY, "run7"))


AUDIT = ["run_id", "run_date", "event_type", "source_label", "status", "validation_name", "check_type", "cost_usd"]


@query("src_audit_pipe", f"SELECT {', '.join(AUDIT)} FROM audit")
def _(t: Inputs):
    root = scratch_folder(t.spark, "audit")
    writers.write_audit(t.audit.select(*AUDIT), root)
    return audit_files.read_audit(t.spark, root).select(*AUDIT)


@query(
    "src_audit_pipe_escaped",
    "SELECT run_id, run_date, event_type, status || '|' || check_type AS detail FROM audit",
)
def _(t: Inputs):
    root = scratch_folder(t.spark, "escaped")
    detail = F.concat_ws("\\|", "status", "check_type")
    lines = t.audit.select(F.concat_ws("|", "run_id", "event_type", detail).alias("value"), "run_date")
    header = t.audit.select("run_date").distinct().select(F.lit("run_id|event_type|detail").alias("value"), "run_date")
    lines.unionByName(header).write.partitionBy("run_date").text(root)
    read = audit_files.read_escaped_audit(t.spark, root, ["run_id", "event_type", "detail"])
    return read.withColumn("run_date", F.col("run_date").cast("string"))


@query(
    "src_audit_jsonl",
    """SELECT record_id, rule_name, row_count_failed, total_row_count, CAST(CAST(failure_timestamp AS DATE) AS VARCHAR) AS dt,
       CASE WHEN record_id % 5 = 0 THEN '007' WHEN record_id % 5 = 1 THEN '2024-03-10' ELSE 'run' || CAST(record_id % 5 AS VARCHAR) END AS run_id FROM failures""",
)
def _(t: Inputs):
    root = scratch_folder(t.spark, "rules")
    # run ids that look like a number or a date stay text
    kind = F.col("record_id") % 5
    run = F.when(kind == 0, "007").when(kind == 1, "2024-03-10").otherwise(F.concat(F.lit("run"), kind.cast("string")))
    rows = t.failures.select("record_id", "rule_name", "row_count_failed", "total_row_count", "failure_timestamp", run.alias("run_id"))
    writers.write_rule_rows(rows, root)
    return audit_files.read_rule_rows(t.spark, root, rows.schema).drop("failure_timestamp")


@query(
    "src_file_listing",
    """SELECT 'events' AS source, 'kind=' || event_type AS subfolder, CAST(1 AS BIGINT) AS files,
       CAST(sum(length(CAST(event_id AS VARCHAR)) + 1) AS BIGINT) AS bytes, event_type = max(event_type) OVER () AS newest
       FROM events GROUP BY event_type""",
)
def _(t: Inputs):
    root = scratch_folder(t.spark, "listing")
    # one file of known size per folder; the last kind is written last
    lines = t.events.select(F.col("event_id").cast("string").alias("value"), F.col("event_type").alias("kind")).repartition("kind")
    last = lines.agg(F.max("kind")).scalar()
    for part in (F.col("kind") < last, F.col("kind") == last):
        lines.filter(part).write.mode("append").partitionBy("kind").text(root)
        time.sleep(0.05)
    listed = listing.file_listing(t.spark, root, "events").filter(F.col("path").endswith(".txt"))
    latest = listing.latest_per_subfolder(listed)
    newest = latest.agg(F.max("latest_modified")).scalar()
    return latest.select("source", "subfolder", "files", "bytes", (F.col("latest_modified") == newest).alias("newest"))
