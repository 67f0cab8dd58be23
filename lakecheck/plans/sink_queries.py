"""Writes, read back. Every target is a fresh scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakecheck.functions.exprs import percent
from lakecheck.operators import rolling
from lakecheck.plans.inputs import Inputs
from lakecheck.plans.registry import n_if, pct, query
from lakecheck.plans.rolling_queries import REAPPEAR
from lakecheck.plans.rule_queries import _full, evaluated
from lakecheck.session import scratch_folder
from lakecheck.sinks import compact, merge, versions, writers
from lakecheck.sources import audit_files

ORDER = "o_orderkey AS k, o_orderstatus AS status, CAST(o_totalprice AS DECIMAL(18,2)) AS amount"


def orders(t: Inputs) -> DataFrame:
    return t.orders.select(
        F.col("o_orderkey").alias("k"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
    )


@query("sink_parquet_overwrite", f"SELECT k, status, CAST(amount * 2 AS DECIMAL(18,2)) AS amount FROM (SELECT {ORDER} FROM orders) o")
def _(t: Inputs):
    # each write is a version of its own; readers see the last one that was committed
    root = scratch_folder(t.spark, "overwrite")
    versions.write_version(orders(t), root)
    doubled = versions.read_version(t.spark, root).withColumn("amount", (F.col("amount") * 2).cast("decimal(18,2)"))
    versions.write_version(doubled, root)
    return versions.read_version(t.spark, root)


@query("sink_append_versions", f"SELECT {ORDER} FROM orders")
def _(t: Inputs):
    root = scratch_folder(t.spark, "versions")
    open_ = F.coalesce(F.col("status") == "O", F.lit(False))
    versions.write_version(orders(t).filter(open_), root, ["status"])
    versions.append_version(orders(t).filter(~open_), root, ["status"])
    # a version that is taken back
    versions.append_version(orders(t), root, ["status"])
    versions.restore_version(t.spark, root, 2)
    return versions.read_version(t.spark, root).select("k", "status", "amount")


@query(
    "sink_append_observed",
    f"""SELECT count(*) AS rows_written, {n_if("priority IS NULL")} AS priority_nulls, CAST(min(k) AS BIGINT) AS first_key,
        CAST(sum(amount) AS DECIMAL(28,2)) AS total_amount, {pct(n_if("priority IS NULL"), "count(*)", 2)} AS null_pct FROM orders_tgt""",
)
def _(t: Inputs):
    metrics = {
        "rows_written": F.count(F.lit(1)),
        "priority_nulls": F.count_if(F.col("priority").isNull()),
        "first_key": F.min("k"),
        "total_amount": F.sum("amount").cast("decimal(28,2)"),
    }
    told = writers.append_observed(t.orders_tgt, scratch_folder(t.spark, "observed"), metrics, ["status"])
    row = t.spark.createDataFrame([told], "rows_written bigint, priority_nulls bigint, first_key bigint, total_amount decimal(28,2)")
    return row.withColumn("null_pct", percent(F.col("priority_nulls"), F.col("rows_written"), 2))


@query(
    "sink_dynamic_partition_overwrite",
    f"SELECT k, status, CAST(CASE WHEN status = 'F' THEN amount * 2 ELSE amount END AS DECIMAL(18,2)) AS amount FROM (SELECT {ORDER} FROM orders) o",
)
def _(t: Inputs):
    path = scratch_folder(t.spark, "dynamic")
    writers.overwrite(orders(t), path, ["status"])
    doubled = orders(t).filter("status = 'F'").withColumn("amount", (F.col("amount") * 2).cast("decimal(18,2)"))
    writers.overwrite_partitions(doubled, path, ["status"])
    return t.spark.read.parquet(path)


@query("sink_append", f"SELECT {ORDER} FROM orders")
def _(t: Inputs):
    path = scratch_folder(t.spark, "append")
    open_ = F.coalesce(F.col("status") == "O", F.lit(False))
    for part in (open_, ~open_):
        writers.append(orders(t).filter(part), path)
    return t.spark.read.parquet(path)


@query("sink_ctas", f"SELECT {ORDER} FROM orders")
def _(t: Inputs):
    path = scratch_folder(t.spark, "ctas")
    name = f"lakecheck_{uuid.uuid4().hex}"
    # the catalog entry goes at the end of the block, the files of an external table stay
    closed = F.coalesce(F.col("status") == "F", F.lit(False))
    with writers.staging_table(orders(t).filter(~closed), name, partition_by=["status"], path=path):
        writers.append_to_table(orders(t).filter(closed), name)
    return t.spark.read.parquet(path)


@query("sink_temp_view", "SELECT status, count(*) AS n FROM orders_src GROUP BY status")
def _(t: Inputs):
    with writers.temp_view(t.orders_src, f"lakecheck_{uuid.uuid4().hex}") as name:
        return t.spark.sql(f"SELECT status, count(*) AS n FROM {name} GROUP BY status")


@query(
    "merge_upsert",
    """SELECT coalesce(t.k, s.k) AS k, CASE WHEN s.k IS NULL THEN t.status ELSE s.status END AS status,
        CASE WHEN t.k IS NULL THEN NULL ELSE t.priority END AS priority,
        CASE WHEN s.k IS NULL THEN t.amount ELSE s.amount END AS amount,
        CASE WHEN s.k IS NULL THEN 'old' ELSE 'merged' END AS origin
       FROM orders_tgt t FULL JOIN orders_src s ON t.k = s.k""",
)
def _(t: Inputs):
    newest = t.orders_src.withColumn("version", F.lit(2))
    stale = t.orders_src.withColumns({"version": F.lit(1), "status": F.lit("?")})
    merged = merge.merge_into_path(
        t.orders_tgt.withColumn("origin", F.lit("old")),
        newest.unionByName(stale),
        scratch_folder(t.spark, "merge"),
        keys=["k"],
        update=["status", "amount"],
        latest_by=[F.desc("version"), F.asc("status")],
        set_values={"origin": F.lit("merged")},
    )
    return merged


@query(
    "merge_by_file",
    """SELECT coalesce(t.k, s.k) AS k, CASE WHEN s.k IS NULL THEN t.status ELSE s.status END AS status,
        CASE WHEN t.k IS NULL THEN NULL ELSE t.priority END AS priority,
        CASE WHEN s.k IS NULL THEN t.amount ELSE s.amount END AS amount,
        CASE WHEN s.k IS NULL THEN 'old' ELSE 'merged' END AS origin
       FROM orders_tgt t FULL JOIN (SELECT * FROM orders_src WHERE k <= 5000) s ON t.k = s.k""",
)
def _(t: Inputs):
    # sorted by key, so that a slice of keys lies in few files
    root = scratch_folder(t.spark, "merge-files")
    versions.write_version(t.orders_tgt.withColumn("origin", F.lit("old")).repartitionByRange(16, "k"), root)
    recent = t.orders_src.filter(F.col("k") <= 5000)
    stale = recent.withColumns({"version": F.lit(1), "status": F.lit("?")})
    versions.merge_version(
        t.spark,
        root,
        recent.withColumn("version", F.lit(2)).unionByName(stale),
        keys=["k"],
        update=["status", "amount"],
        latest_by=[F.desc("version"), F.asc("status")],
        set_values={"origin": F.lit("merged")},
    )
    return versions.read_version(t.spark, root)


@query(
    "sink_optimize",
    """SELECT event_id, user_id, value, CASE WHEN event_id % 4 < 3 THEN '00' || CAST(event_id % 4 AS VARCHAR) END AS code FROM events""",
)
def _(t: Inputs):
    root = scratch_folder(t.spark, "small")
    kind = F.col("event_id") % 4
    # partition values with leading zeros, and NULL
    code = F.when(kind < 3, F.concat(F.lit("00"), kind.cast("string")))
    small = t.events.select("event_id", "user_id", "value", code.alias("code")).repartition(20, "event_id")
    small.write.partitionBy("code").parquet(f"{root}/many")
    return compact.compact(t.spark, f"{root}/many", f"{root}/few", ["code"], target_bytes=64 * 1024 * 1024)


@query(
    "sink_audit_pipe",
    """SELECT run_id, run_date, step_name, status, cost_usd, step_name || '|' || 'a\\b "' || status || '" ' || step_type AS detail FROM pipe_audit""",
)
def _(t: Inputs):
    root = scratch_folder(t.spark, "audit")
    detail = F.concat(F.col("step_name"), F.lit('|a\\b "'), F.col("status"), F.lit('"\n'), F.col("step_type"))
    rows = t.pipe_audit.select("run_id", "run_date", "step_name", "status", "cost_usd", detail.alias("detail"))
    writers.write_audit(rows, root)
    return audit_files.read_audit(t.spark, root)


@query(
    "sink_audit_twice",
    """SELECT run_id, run_date, step_name, status, cost_usd FROM pipe_audit""",
)
def _(t: Inputs):
    # a first attempt of every run with other statuses, then all runs, those of some days once more
    root = scratch_folder(t.spark, "audit-twice")
    rows = t.pipe_audit.select("run_id", "run_date", "step_name", "status", "cost_usd")
    writers.write_audit(rows.withColumn("status", F.lit("RUNNING")), root)
    writers.write_audit(rows, root)
    writers.write_audit(rows.filter("run_date < '2024-01-10'"), root)
    return audit_files.read_audit(t.spark, root)


@query("sink_audit_jsonl", f"SELECT *, CAST(CAST(failure_timestamp AS DATE) AS VARCHAR) AS dt FROM ({_full()}) r")
def _(t: Inputs):
    root = scratch_folder(t.spark, "rules")
    rows = evaluated(t)
    # a run that is repeated replaces its rows
    writers.write_rule_rows(rows.withColumn("status", F.lit("RUNNING")), root)
    writers.write_rule_rows(rows, root)
    return audit_files.read_rule_rows(t.spark, root, rows.schema)


@query("sink_csv_report", REAPPEAR)
def _(t: Inputs):
    path = scratch_folder(t.spark, "report")
    report = rolling.delete_reappear(t.presence, "k", "snapshot_date")
    writers.write_csv_report(report, path, ["k", "reappeared_on"])
    return t.spark.read.schema(report.schema).option("header", True).csv(path)
