"""Kept daily partials, and presence as bits."""

import os
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lakecheck.operators import checks, partials, rolling
from tests.conftest import rows

START = date(2024, 1, 1)


def measures():
    return {"cnt": F.count(F.lit(1)), "total": F.sum("v"), "largest": F.max("v")}


def events(spark, data):
    """``day`` after the start, value, group, hours until loaded."""
    made = [(datetime(2024, 1, 1, 12) + timedelta(days=d), v, g, datetime(2024, 1, 1, 12) + timedelta(days=d, hours=h)) for d, v, g, h in data]
    return spark.createDataFrame(made, "ts timestamp_ntz, v int, g string, load_ts timestamp_ntz")


def data(seed=4):
    rng = random.Random(seed)
    return [(rng.randrange(20), rng.randrange(50), rng.choice(("a", "b", None)), rng.choice((0, 1, 30))) for _ in range(400)]


def stamps(root):
    return {f"{d}/{f}": os.stat(f"{d}/{f}").st_mtime_ns for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_a_refresh_replaces_the_changed_days_only(spark, tmp_path):
    root, first = str(tmp_path / "daily"), data()
    old = events(spark, first)
    partials.refresh_partials(old, root, "ts", measures(), ["g"])
    before = stamps(root)
    # new rows of two days, one of them long ago
    new = events(spark, [*first, (3, 7, "a", 24 * 17), (3, 99, "c", 24 * 17), (19, 1, None, 2)])
    days = partials.changed_days(new, "ts", "load_ts", datetime(2024, 1, 18, 12) + timedelta(days=2, hours=0))
    assert date(2024, 1, 4) in days
    days = [date(2024, 1, 4), date(2024, 1, 20)]
    partials.refresh_partials(new, root, "ts", measures(), ["g"], days)
    after = stamps(root)
    changed = {f for f in before.keys() | after.keys() if before.get(f) != after.get(f)}
    assert {f.split(f"{partials.DAY}=")[1][:10] for f in changed} == {"2024-01-04", "2024-01-20"}
    whole = str(tmp_path / "whole")
    partials.refresh_partials(new, whole, "ts", measures(), ["g"])
    assert rows(partials.read_partials(spark, root)) == rows(partials.read_partials(spark, whole))
    partials.refresh_partials(new, root, "ts", measures(), ["g"], [])
    assert stamps(root) == after


def test_changed_days_are_those_of_rows_loaded_since(spark):
    df = events(spark, [(0, 1, "a", 0), (5, 1, "a", 0), (2, 1, "a", 24 * 5), (9, 1, "a", 0)])
    assert partials.changed_days(df, "ts", "load_ts", datetime(2024, 1, 6)) == [date(2024, 1, 3), date(2024, 1, 6), date(2024, 1, 10)]
    assert partials.changed_days(df, "ts", "load_ts", datetime(2025, 1, 1)) == []


def test_only_the_wanted_days_are_read(spark, tmp_path):
    table, root = str(tmp_path / "t"), str(tmp_path / "daily")
    events(spark, data()).write.parquet(table)
    df = spark.read.parquet(table)
    partials.refresh_partials(df, root, "ts", measures())
    read = partials.read_partials(spark, root, START + timedelta(days=3), START + timedelta(days=5))
    assert read.count() == 3 and "PartitionFilters: [isnotnull(partial_day" in read._jdf.queryExecution().executedPlan().toString()
    day = partials.on_day(df, "ts", START)
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in df.where(day)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("include", [False, True])
def test_the_volume_check_from_partials(spark, tmp_path, include):
    root, df = str(tmp_path / "daily"), events(spark, data(9))
    partials.refresh_partials(df, root, "ts", {"cnt": F.count(F.lit(1))})
    day = START + timedelta(days=15)
    kept = checks.volume_from_partials(partials.window_totals(partials.read_partials(spark, root), day, 10, include), 10)
    assert rows(kept) == rows(checks.volume_against_window(df, day, "ts", days=10, include_day=include))


def test_distinct_counts_over_windows_are_exact(spark, tmp_path):
    root, first = str(tmp_path / "sets"), data(11)
    old = events(spark, first).withColumn("w", F.concat(F.lit("v"), F.col("v") % 7)).repartition(6)
    partials.refresh_distincts(old, root, "ts", ["v", "w"], ["g"])
    added = [*first, (3, 1000, "a", 0), (3, None, "a", 0), (19, 7, "new", 0), (19, 2000, None, 0)]
    new = events(spark, added).withColumn("w", F.concat(F.lit("v"), F.col("v") % 7)).repartition(5)
    before = stamps(root)
    partials.refresh_distincts(new, root, "ts", ["v", "w"], ["g"], [date(2024, 1, 4), date(2024, 1, 20)])
    numbers = spark.read.parquet(f"{root}/numbers/v")
    assert rows(numbers, "value") == rows(new.where("v is not null").select("v").distinct()) and numbers.select("id").distinct().count() == numbers.count()
    assert numbers.agg(F.max("id")).first()[0] == numbers.count()
    touched = {f for f in stamps(f"{root}/bitmaps") if f not in before}
    assert {f.split(f"{partials.DAY}=")[1][:10] for f in touched} == {"2024-01-04", "2024-01-20"}
    for lo, hi in ((0, 19), (2, 5), (19, 19), (0, 2)):
        lo, hi = START + timedelta(days=lo), START + timedelta(days=hi)
        span = new.where(F.to_date("ts").between(F.lit(lo), F.lit(hi)))
        want = span.groupBy("g").agg(F.count_distinct("v").alias("v"), F.count_distinct("w").alias("w"))
        assert rows(partials.distinct_counts(spark, root, ["v", "w"], ["g"], lo, hi)) == rows(want)
    assert rows(partials.distinct_counts(spark, root, ["v", "w"])) == rows(new.agg(F.count_distinct("v"), F.count_distinct("w")))


def test_more_values_than_one_bitmap_holds(spark, tmp_path):
    df = spark.range(100_000).select(F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("ts"), F.col("id").alias("v"))
    for part in (df, df.withColumn("v", F.col("v") + 50_000).withColumn("ts", F.lit(datetime(2024, 1, 2)).cast("timestamp_ntz"))):
        partials.refresh_distincts(part, str(tmp_path / "sets"), "ts", ["v"])
    assert rows(partials.distinct_counts(spark, str(tmp_path / "sets"), ["v"])) == [(150_000,)]


def presence(spark, seed, n=300, days=150):
    rng = random.Random(seed)
    found = [(rng.choice((None, *range(25))), START + timedelta(days=rng.choice(range(0, days, 3)))) for _ in range(n)]
    return spark.createDataFrame([*found, *found[:40], (3, None)], "k int, d date").repartition(4)


def test_bits_find_the_same_gaps(spark):
    for df in (presence(spark, 1), presence(spark, 2, 60), presence(spark, 3).limit(0)):
        want = rows(rolling.delete_reappear(df, "k", "d"))
        for days in (150, 384):
            got = rolling.delete_reappear_bits(df, "k", "d", START, days)
            assert rows(got) == want and dict(got.dtypes)["missed_snapshots"] == "bigint"


def test_a_snapshot_outside_the_span_is_an_error(spark):
    df = spark.createDataFrame([(1, START), (1, START + timedelta(days=70))], "k int, d date")
    assert rolling.delete_reappear_bits(df, "k", "d", START, 71).count() == 0
    for first, days in ((START, 70), (START + timedelta(days=1), 384)):
        with pytest.raises(PySparkException, match="outside the span"):
            rolling.delete_reappear_bits(df, "k", "d", first, days).collect()


def test_bits_need_one_read_and_no_window(spark, tmp_path):
    path = str(tmp_path / "p")
    presence(spark, 5).write.parquet(path)
    df = rolling.delete_reappear_bits(spark.read.parquet(path), "k", "d", START, 150)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert "Window" not in final and "Join" not in final and final.count("Exchange hashpartitioning") == 1
