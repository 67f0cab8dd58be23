import os
from datetime import date, datetime
from types import SimpleNamespace

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lakecheck.operators import keys
from lakecheck.session import scratch_folder
from lakecheck.sinks import compact, merge, writers
from lakecheck.sources import audit_files, files, listing, sql
from tests.conftest import rows


def test_schema_from_config():
    schema = files.schema_from_config({"a": "str", "b": "int", "c": "decimal(10,2)"})
    assert schema.simpleString() == "struct<a:string,b:int,c:decimal(10,2)>"
    with pytest.raises(ValueError, match="blob"):
        files.schema_from_config({"a": "blob"})


def test_landing_tree_reads_every_job_and_skips_other_files(spark, tmp_path):
    for source in ("one", "two"):
        for sub in ("x", "y/z"):
            folder = tmp_path / source / sub
            folder.mkdir(parents=True)
            (folder / "part.csv").write_text("k,v\n1,a\n2,\n")
            (folder / "note.txt").write_text("no data")
    dtype = {"k": "int", "v": "str"}
    got = files.read_landings(
        spark, [{"landing_table": s, "landing_loc": str(tmp_path / s), "dtype": dtype} for s in ("one", "two")]
    )
    assert set(got) == {"one", "two"}
    assert rows(got["one"]) == [(1, "a"), (1, "a"), (2, None), (2, None)]
    stamped = keys.with_ingest_columns(got["two"], datetime(2024, 7, 1, 12), "me").first()
    assert (stamped.insert_timestamp, stamped.load_timestamp) == (datetime(2024, 7, 1, 5), datetime(2024, 7, 1, 12))


def test_variables():
    values = sql.run_variables(date(2024, 3, 1), "r1", {"db": "base_{run_id}", "run_date": "2024-02-28"})
    assert sql.bind("{db}.t {run_date} {CURRENT_DATE-1} {run_date+2} {unknown}", values) == "base_r1.t 2024-02-28 2024-02-29 2024-03-01 {unknown}"
    for bad in ("t; DROP TABLE x --'", "t UNION ALL select 99", "t--x", "a b"):
        with pytest.raises(ValueError):
            sql.bind("{db}", {"db": bad})


def test_values_go_through_arguments(spark):
    df = spark.createDataFrame([("o'neil",), ("x",)], "name string")
    assert sql.run_sql(spark, "SELECT * FROM {people} WHERE name = :n", {"people": df}, args={"n": "o'neil"}).count() == 1


def test_file_listing(spark, tmp_path):
    for name, age in (("a/1", 100), ("a/2", 50), ("b/1", 10)):
        path = tmp_path / "src" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("xx")
        os.utime(path, (1_700_000_000 - age,) * 2)
    (tmp_path / "src" / "top").write_text("xyz")
    got = listing.latest_per_subfolder(listing.file_listing(spark, str(tmp_path / "src"), "s"))
    assert rows(got.filter("subfolder is not null"), "source", "subfolder", "files", "bytes") == [("s", "a", 2, 4), ("s", "b", 1, 2)]
    newest = got.filter("subfolder = 'a'").first()["latest_modified"]
    assert newest == datetime(2023, 11, 14, 22, 12, 30)
    assert got.filter("subfolder is null").first()["bytes"] == 3


def test_audit_round_trip_keeps_pipes_blanks_and_nulls(spark, tmp_path):
    data = [("r", "2024-01-01", "a|b", 'say "x"\\|'), ("r", "2024-01-02", "line\none", ""), ("s", "2024-01-02", None, "\\")]
    df = spark.createDataFrame(data, "run_id string, run_date string, detail string, note string")
    writers.write_audit(df, str(tmp_path / "audit"))
    expected = rows(df.withColumn("detail", F.regexp_replace("detail", "\n", " ")), "run_id", "run_date", "detail", "note")
    assert rows(audit_files.read_audit(spark, str(tmp_path / "audit")), "run_id", "run_date", "detail", "note") == expected


def test_escaped_audit_lines(spark, tmp_path):
    folder = tmp_path / "audit" / "run_date=2024-01-01"
    folder.mkdir(parents=True)
    (folder / "a.csv").write_text("run_id|detail|status\nr1|x\\|y|PASS\nr2||FAIL\n")
    got = audit_files.read_escaped_audit(spark, str(tmp_path / "audit"), ["run_id", "detail", "status"])
    assert rows(got, "run_id", "detail", "status") == [("r1", "x|y", "PASS"), ("r2", "", "FAIL")]


@pytest.fixture
def target(spark):
    return spark.createDataFrame([(1, "a", 10), (2, "b", 20), (None, "n", 0)], "k int, v string, other int")


@pytest.fixture
def source(spark):
    return spark.createDataFrame([(2, "old", 1), (2, "new", 2), (3, "c", 1), (None, "m", 1)], "k int, v string, ts int")


def merged(target, source):
    return merge.merge_upsert(target, source, ["k"], ["v"], [F.desc("ts")], {"other": F.lit(99)})


def test_merge(target, source):
    assert rows(merged(target, source)) == [
        (1, "a", 10),
        (2, "new", 99),
        (3, "c", 99),
        (None, "m", 99),
        (None, "n", 0),
    ]


def test_merge_is_idempotent(target, source):
    some = source.filter("k is not null")
    once = merged(target, some)
    assert rows(merged(once, some)) == rows(once)


def test_merge_writes_to_a_new_path(spark, target, source, tmp_path):
    out = merge.merge_into_path(target, source, str(tmp_path / "v2"), keys=["k"], update=["v"], latest_by=[F.desc("ts")])
    assert rows(out, "k", "v") == [(1, "a"), (2, "new"), (3, "c"), (None, "m"), (None, "n")]


def part_files(root):
    return [f for _, _, names in os.walk(root) for f in names if f.endswith(".parquet")]


def test_compaction_keeps_rows_values_and_order(spark, tmp_path):
    p = F.when(F.col("id") < 1900, "001").when(F.col("id") < 1950, "01")  # and NULL
    df = spark.range(2000).select("id", p.alias("p"))
    many, few, mixed = (str(tmp_path / n) for n in ("many", "few", "mixed"))
    df.repartition(25).write.partitionBy("p").parquet(many)
    out = compact.compact(spark, many, few, ["p"])
    assert rows(out, "id", "p") == rows(df, "id", "p") and dict(out.dtypes)["p"] == "string"
    assert len(part_files(few)) == 3 < len(part_files(many))
    assert {f for f in os.listdir(few) if "=" in f} == {"p=001", "p=01", "p=__HIVE_DEFAULT_PARTITION__"}
    # rows of one input file stay together and in order
    first = spark.read.parquet(few).select("id", F.col("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("i"))
    before = spark.read.parquet(many).select("id", F.col("_metadata.file_path").alias("g"), F.col("_metadata.row_index").alias("j"))
    w = Window.partitionBy("f").orderBy("i")
    jumps = first.join(before, "id").withColumn("before", F.lag(F.struct("g", "j")).over(w))
    assert jumps.where((F.col("before.g") == F.col("g")) & (F.col("before.j") >= F.col("j"))).count() == 0
    # a file that is large enough passes through as it is
    large = max(part_files_with_sizes(many), key=lambda x: x[1])
    compact.compact(spark, many, mixed, ["p"], target_bytes=2 * large[1])
    assert rows(spark.read.schema(out.schema).parquet(mixed), "id", "p") == rows(df, "id", "p")


def part_files_with_sizes(root):
    return [(f, os.path.getsize(os.path.join(d, f))) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")]


def test_whole_files_are_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).write.parquet(path)
    whole = spark.read.parquet(path).where(~compact.is_small("_metadata.file_size", 10))
    assert "Exchange" not in whole._jdf.queryExecution().executedPlan().toString()


def test_compaction_without_partitions(spark, tmp_path):
    spark.range(500).repartition(20).write.parquet(str(tmp_path / "many"))
    out = compact.compact(spark, str(tmp_path / "many"), str(tmp_path / "few"))
    assert len(part_files(tmp_path / "few")) == 1 and out.count() == 500 and out.distinct().count() == 500


def test_dynamic_overwrite_touches_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.overwrite(spark.createDataFrame([(1, "a"), (2, "b")], "v int, p string"), path, ["p"])
    writers.overwrite_partitions(spark.createDataFrame([(3, "b")], "v int, p string"), path, ["p"])
    assert rows(spark.read.parquet(path), "v", "p") == [(1, "a"), (3, "b")]
    writers.overwrite(spark.createDataFrame([(4, "c")], "v int, p string"), path, ["p"])
    assert rows(spark.read.parquet(path), "v", "p") == [(4, "c")]


def test_partitioned_write_makes_few_files_but_splits_a_hot_folder(spark, tmp_path):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.advisoryPartitionSizeInBytes",)}
    df = spark.range(0, 400_000, 1, 16).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 5).cast("string")).alias("p"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    try:
        writers.overwrite(df, str(tmp_path / "t"), ["p"])
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    files_of = {d: len(list((tmp_path / "t" / d).glob("*.parquet"))) for d in os.listdir(tmp_path / "t") if d.startswith("p=")}
    assert files_of["p=hot"] > 1 and sum(files_of.values()) < 16 * len(files_of)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 400_000


def test_staging_table_goes_away_but_never_someone_elses(spark, tmp_path):
    df = spark.range(3)
    with writers.staging_table(df, "lakecheck_staging", path=str(tmp_path / "s")) as table:
        assert table.count() == 3
        with pytest.raises(Exception), writers.staging_table(df, "lakecheck_staging", path=str(tmp_path / "s2")):
            pass
        assert spark.catalog.tableExists("lakecheck_staging")
    assert not spark.catalog.tableExists("lakecheck_staging")


def test_append_to_table_goes_by_name(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "k int, v string")
    with writers.staging_table(df, "lakecheck_append", path=str(tmp_path / "t")) as table:
        writers.append_to_table(df.select("v", "k"), "lakecheck_append")
        assert rows(spark.table(table.sparkSession.catalog.currentDatabase() + ".lakecheck_append")) == [(1, "a"), (1, "a")]


def test_report_is_one_file_where_asked_for(spark, tmp_path):
    df = spark.range(100).repartition(4)
    writers.write_csv_report(df, str(tmp_path / "small"), ["id"], single_file=True)
    writers.write_csv_report(df, str(tmp_path / "large"), ["id"])
    assert len(list((tmp_path / "small").glob("*.csv"))) == 1
    for name in ("small", "large"):
        assert spark.read.option("header", True).csv(str(tmp_path / name)).count() == 100


def test_scratch_folder_lies_in_the_shared_folder():
    def session(shared, master="local[4]"):
        conf = {"spark.checkpoint.dir": shared, "spark.master": master}
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: conf[key] or default))

    first, second = (scratch_folder(session("hdfs://shared/checkpoints/"), "x") for _ in range(2))
    assert first.startswith("hdfs://shared/checkpoints/x-") and first != second
    assert os.path.isdir(scratch_folder(session(None), "x"))
    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            scratch_folder(session(None, master), "x")
