"""Tables that change as a whole, audit files that can be written again, and metrics of a write."""

import os

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lakecheck import session
from lakecheck.sinks import merge, versions, writers
from lakecheck.sources import audit_files
from tests.conftest import rows


@pytest.fixture
def root(tmp_path):
    return str(tmp_path / "table")


def table(spark, n=100, files=10):
    return spark.range(n).select(F.col("id").alias("k"), F.concat(F.lit("v"), F.col("id")).alias("v"), (F.col("id") % 7).cast("int").alias("other")).repartitionByRange(files, "k")


def failing(spark):
    return spark.range(50).select(F.col("id").alias("k"), F.expr("CAST(IF(id < 40, 'v', raise_error('broken')) AS STRING)").alias("v"), F.lit(0).alias("other"))


def stamps(spark, root, version=None):
    paths = [f.split(":", 1)[1].replace("//", "/") for f in versions.version_files(spark, root, version)]
    return {p: os.stat(p).st_mtime_ns for p in paths}


def test_a_write_replaces_the_table_and_keeps_the_version_before(spark, root):
    assert versions.newest_version(spark, root) is None
    with pytest.raises(ValueError, match="no version"):
        versions.read_version(spark, root)
    assert versions.write_version(table(spark), root) == 1
    # from the table itself
    assert versions.write_version(versions.read_version(spark, root).filter("k < 3").withColumn("v", F.upper("v")), root) == 2
    assert rows(versions.read_version(spark, root)) == [(0, "V0", 0), (1, "V1", 1), (2, "V2", 2)]
    assert rows(versions.read_version(spark, root, 1)) == rows(table(spark))
    assert versions.restore_version(spark, root, 1) == 3 and versions.read_version(spark, root).count() == 100


def test_a_write_that_fails_half_way_leaves_the_table(spark, root):
    versions.write_version(table(spark), root)
    before, files = rows(versions.read_version(spark, root)), stamps(spark, root)
    for attempt in (versions.write_version, versions.append_version):
        with pytest.raises(PySparkException):
            attempt(failing(spark).withColumn("other", F.col("other").cast("int")), root)
        assert versions.newest_version(spark, root) == 1
        assert rows(versions.read_version(spark, root)) == before and stamps(spark, root) == files
    # rubbish of a list that was never committed
    os.makedirs(f"{root}/versions/version=2/_temporary/0")
    assert versions.newest_version(spark, root) == 1
    assert versions.append_version(spark.createDataFrame([(1, "x", -1)], "other int, v string, k bigint"), root) == 2
    assert rows(versions.read_version(spark, root).filter("k < 0")) == [(-1, "x", 1)]


def test_partitioned_empty_and_nested_tables(spark, root):
    df = spark.createDataFrame([(1, "001", [1]), (2, "a b%c/d", []), (3, None, None)], "k int, p string, l array<int>")
    versions.write_version(df.limit(0), root, ["p"])
    assert versions.read_version(spark, root).schema.simpleString() == df.schema.simpleString() and versions.read_version(spark, root).count() == 0
    versions.append_version(df, root, ["p"])
    versions.append_version(df.select("l", "p", "k").withColumn("k", F.col("k") + 10), root, ["p"])
    got = versions.read_version(spark, root)
    assert rows(got.select("k", "p")) == rows(df.select("k", "p").union(df.select(F.col("k") + 10, "p")))
    versions.merge_version(spark, root, df.filter("k = 2").withColumn("l", F.array(F.lit(9))), ["k"], ["l"], [F.lit(1)], partition_by=["p"])
    assert [r["l"] for r in versions.read_version(spark, root).filter("k = 2").collect()] == [[9]]
    assert versions.read_version(spark, root).count() == 6


def merged(spark, root, source, **options):
    return versions.merge_version(spark, root, source, ["k"], ["v"], [F.desc("ts")], **options)


def test_a_merge_rewrites_only_files_with_matches(spark, root):
    versions.write_version(table(spark), root)
    before = stamps(spark, root)
    source = spark.createDataFrame([(5, "five", 2), (5, "old", 1), (6, "six", 1), (500, "new", 1), (None, "none", 1)], "k bigint, v string, ts int")
    want = rows(merge.merge_upsert(versions.read_version(spark, root), source, ["k"], ["v"], [F.desc("ts")], {"other": F.lit(99)}))
    assert merged(spark, root, source, set_values={"other": F.lit(99)}) == 2
    assert rows(versions.read_version(spark, root)) == want
    after = stamps(spark, root)
    kept = before.keys() & after.keys()
    assert len(before) == 10 and len(kept) == 9 and all(before[f] == after[f] for f in kept)
    # again: same rows, and the inserted NULL key matches nothing
    merged(spark, root, source.filter("k is not null"), set_values={"other": F.lit(99)})
    assert rows(versions.read_version(spark, root)) == want


def test_a_merge_without_matches_touches_no_file(spark, root):
    versions.write_version(table(spark), root)
    before = stamps(spark, root)
    merged(spark, root, spark.createDataFrame([(1000, "x", 1)], "k bigint, v string, ts int"))
    assert before.items() <= stamps(spark, root).items() and versions.read_version(spark, root).count() == 101
    assert rows(versions.read_version(spark, root).filter("k = 1000")) == [(1000, "x", None)]


def test_a_merge_reads_its_source_once(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    source = spark.createDataFrame([(i, "s", 1) for i in range(20)], "k bigint, v string, ts int").mapInPandas(watched, "k bigint, v string, ts int")
    merge.merge_into_path(table(spark), source, str(tmp_path / "out"), ["k"], ["v"], [F.desc("ts")])
    assert read.value == 20


SETTINGS = {
    "spark.sql.shuffle.partitions": "1",
    "spark.sql.adaptive.coalescePartitions.enabled": "false",
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.files.maxPartitionBytes": "1g",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
}


@pytest.fixture
def coarse(spark):
    """A session with one shuffle partition."""
    before = {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    yield {key: spark.conf.get(key, None) for key in SETTINGS}
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_partitions_of_a_merge_follow_its_rows(spark, coarse, root, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "SORT_ROWS", 1000, raising=False)
    target = table(spark, 4000)
    source = spark.range(2000, 6000).selectExpr("id AS k", "'new' AS v", "1 AS ts")
    want = [(k, f"v{k}", k % 7) if k < 2000 else (k, "new", k % 7 if k < 4000 else None) for k in range(6000)]
    out = str(tmp_path / "out")
    got = merge.merge_into_path(target, source, out, ["k"], ["v"], [F.desc("ts")])
    versions.write_version(target, root)
    merged(spark, root, source)
    for df in (got, versions.read_version(spark, root)):
        assert sorted(map(tuple, df.collect())) == want
        sizes = [r["n"] for r in df.groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
        assert len(sizes) >= 7 and max(sizes) < 1500
    assert {key: spark.conf.get(key, None) for key in SETTINGS} == coarse


def test_small_tasks_are_finer_only_and_end_with_their_block(spark, coarse):
    with pytest.raises(ZeroDivisionError), session.small_tasks(spark, 10 * session.SORT_ROWS + 1):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "11"
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == f"{session.SORT_BYTES}b"
        assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "4096b"
        1 / 0
    assert {key: spark.conf.get(key, None) for key in SETTINGS} == coarse
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with session.small_tasks(spark, 0):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "1"
    assert spark.conf.get("spark.sql.files.maxPartitionBytes", None) is None


def test_a_failed_staging_table_is_no_table(spark, tmp_path):
    with pytest.raises(PySparkException), writers.staging_table(failing(spark), "lakecheck_failing", path=str(tmp_path / "first")):
        pass
    assert not spark.catalog.tableExists("lakecheck_failing")
    # the files of a failed attempt belong to no table: the next one takes a folder of its own
    with writers.staging_table(table(spark), "lakecheck_failing", path=str(tmp_path / "second")) as made:
        assert made.count() == 100


AUDIT = "run_id string, run_date string, status string, note string"


def test_a_repeated_run_replaces_its_audit_rows(spark, tmp_path):
    root = str(tmp_path / "audit")
    first = spark.createDataFrame([("r1", "2024-01-01", "FAIL", "a"), ("r1", "2024-01-01", "PASS", "b"), ("r2", "2024-01-01", "PASS", "c"), ("007", "2024-01-02", "PASS", None)], AUDIT)
    again = spark.createDataFrame([("r1", "2024-01-01", "PASS", "a|x")], AUDIT)
    for df in (first, again, again):
        writers.write_audit(df, root)
    want = [("007", "2024-01-02", "PASS", None), ("r1", "2024-01-01", "PASS", "a|x"), ("r2", "2024-01-01", "PASS", "c")]
    got = audit_files.read_audit(spark, root)
    assert rows(got, "run_id", "run_date", "status", "note") == want and "run" not in got.columns


def test_a_failed_audit_write_leaves_the_rows_of_the_attempt_before(spark, tmp_path):
    root = str(tmp_path / "audit")
    df = spark.createDataFrame([("r1", "2024-01-01", "PASS", "a")], AUDIT)
    writers.write_audit(df, root)
    with pytest.raises(PySparkException):
        writers.write_audit(df.withColumn("note", F.expr("raise_error('broken')").cast("string")), root)
    assert rows(audit_files.read_audit(spark, root), "run_id", "note") == [("r1", "a")]


def test_a_repeated_run_replaces_its_rule_rows(spark, tmp_path):
    root = str(tmp_path / "rules")
    df = spark.sql("SELECT 'r1' AS run_id, 'n' AS rule_name, 1L AS failed, TIMESTAMP '2024-01-01 05:00:00' AS failure_timestamp")
    other = df.withColumns({"run_id": F.lit("r2"), "failed": F.lit(7).cast("bigint")})
    for part in (df, other, df.withColumn("failed", F.lit(0).cast("bigint"))):
        writers.write_rule_rows(part, root)
    assert rows(audit_files.read_rule_rows(spark, root, df.schema), "run_id", "failed") == [("r1", 0), ("r2", 7)]


@pytest.mark.parametrize("by", [[], ["p"]])
def test_metrics_of_a_write_come_from_its_own_job(spark, tmp_path, by):
    read = spark.sparkContext.accumulator(0)

    def watched(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    source = spark.range(1000).select("id", F.when(F.col("id") % 10 > 0, F.col("id")).alias("v"), (F.col("id") % 3).alias("p"))
    df = source.mapInPandas(watched, source.schema)
    metrics = {"rows": F.count(F.lit(1)), "nulls": F.count_if(F.col("v").isNull()), "largest": F.max("v")}
    got = writers.append_observed(df, str(tmp_path / "t"), metrics, by)
    assert got == {"rows": 1000, "nulls": 100, "largest": 999} and read.value == 1000
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1000
    assert writers.append_observed(df.limit(0), str(tmp_path / "u"), metrics, by) == {"rows": 0, "nulls": 0, "largest": None}
