from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lakecheck.operators import checks
from tests.conftest import rows

DAY = date(2024, 3, 10)


def stamps(spark, *texts):
    frame = spark.createDataFrame([(t, None) if isinstance(t, str) or t is None else t for t in texts], "l string, u string")
    return frame.select(F.col("l").cast("timestamp_ntz").alias("load_ts"), F.col("u").cast("timestamp_ntz").alias("update_ts"))


def status(df):
    return df.select("status").first()[0]


def test_condition_looks_at_all_rows_unless_told_otherwise(spark):
    df = spark.createDataFrame([(1, 5), (2, 50)], "i int, v int")
    assert status(checks.check_condition(df, "c", "v < 10", "t")) == "FAIL"
    assert status(checks.check_condition(df, "c", "v < 10", "t", mode="first", order=["i"])) == "PASS"
    assert checks.check_condition(df, "c", "v < 10", "t").first()["actual_value"] == "50"
    with pytest.raises(ValueError):
        checks.check_condition(df, "c", "v < 10", "t", mode="first")


def test_empty_result_passes_only_for_a_row_count_of_zero(spark):
    empty = spark.createDataFrame([], "v int")
    assert status(checks.check_condition(empty, "c", "row_count == 0", "t")) == "PASS"
    assert status(checks.check_condition(empty, "c", "v == 0", "t")) == "FAIL"
    assert status(checks.no_rows(empty, "n")) == "PASS"


def test_null_condition_fails(spark):
    df = spark.createDataFrame([(None,)], "v int")
    assert status(checks.check_condition(df, "c", "v > 0", "t")) == "FAIL"


def test_freshness_of_an_empty_table_fails(spark):
    now = datetime(2024, 3, 10, 12)
    assert status(checks.freshness(stamps(spark, "2024-03-10 01:00:00"), "load_ts", now, 24, "f")) == "PASS"
    assert status(checks.freshness(stamps(spark, "2024-03-09 01:00:00"), "load_ts", now, 24, "f")) == "FAIL"
    assert status(checks.freshness(stamps(spark).limit(0), "load_ts", now, 24, "f")) == "FAIL"


def test_violations_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "a int, b string")
    got = rows(checks.violations(empty, {"a": checks.is_missing("a"), "b": checks.is_not_iso_date("b")}))
    assert got == [("a", 0, 0, 0.0, "PASS"), ("b", 0, 0, 0.0, "PASS")]


def test_row_predicates(spark):
    df = spark.createDataFrame(
        [("2024-01-01", "F", "1990"), ("01/02/2024", "X", "1850"), (None, None, None), ("2024-01-01x", "O", "2101")],
        "d string, c string, y string",
    )
    bad = {
        "d": checks.is_not_iso_date("d"),
        "c": checks.is_not_allowed("c", ["F", "O"]),
        "y": checks.is_not_year(["y"]),
    }
    assert rows(checks.violations(df, bad), "check_name", "violations") == [("c", 2), ("d", 3), ("y", 3)]


def test_share_without_data(spark):
    empty = spark.createDataFrame([], "c string")
    assert rows(checks.percent_threshold(empty, F.col("c").isNull())) == [(0, 0, 0.0, "NO_DATA")]
    assert rows(checks.date_window(empty, "c", DAY), "total", "status") == [(0, "NO_DATA")]


def test_date_window_counts_each_reason(spark):
    texts = ["bad", None, "0001-01-01", "9999-12-31", "2020-01-01", "2025-01-01", "2024-01-01"]
    df = spark.createDataFrame([(t,) for t in texts], "d string")
    got = checks.date_window(df, "d", DAY).first()
    assert (got.total, got.unparsable, got.placeholders, got.out_of_window, got.invalid_count) == (7, 2, 2, 2, 6)
    assert got.status == "FAIL"


def test_rolling_average_against_zero_and_missing_baseline(spark):
    def verdict(today, base, **options):
        df = spark.createDataFrame([(today, base)], "today_count long, rolling_avg_60 double")
        return tuple(checks.rolling_average_verdict(df, **options).first())[2:]

    assert verdict(0, 0.0) == (0.0, "PASS")
    assert verdict(5, 0.0) == (100.0, "FAIL")
    assert verdict(5, None, warn_only=True) == (100.0, "WARN")
    assert verdict(75, 100.0, tolerance="25") == (25.0, "PASS")
    assert verdict(74, 100.0) == (26.0, "FAIL")


def test_volume_window_counts_missing_days_and_may_end_on_the_day(spark):
    df = stamps(spark, *["2024-03-10 08:00:00"] * 4, "2024-03-01 00:00:00", "2024-01-10 23:59:59", "2024-01-09 00:00:00")
    before = checks.volume_against_window(df, DAY, "load_ts").first()
    assert (before.today_count, before.total_in_window, before.days_with_data) == (4, 2, 2)
    inside = checks.volume_against_window(df, DAY, "load_ts", include_day=True).first()
    assert (inside.total_in_window, inside.days_with_data) == (5, 2)


def test_volume_window_with_updates(spark):
    df = stamps(spark, ("2024-01-01 00:00:00", "2024-03-10 00:00:00"), (None, "2024-03-09 00:00:00"), ("2024-03-09 00:00:00", None))
    got = checks.volume_against_window(df, DAY, "load_ts", "update_ts").first()
    assert (got.today_count, got.total_in_window, got.days_with_data) == (1, 2, 1)


def test_amount_window_skips_text_that_is_no_number(spark):
    df = stamps(spark, "2024-03-10 01:00:00", "2024-03-09 01:00:00", "2024-02-09 00:00:00", "2024-02-08 23:00:00", (None, "2024-03-09 00:00:00"))
    df = df.withColumn("amount", F.when(F.col("load_ts") < "2024-02-09 00:00:00", "99").otherwise("30.00"))
    df = df.unionByName(df.limit(1).withColumn("amount", F.lit("n/a")))
    got = checks.amount_against_window(df, "amount", DAY, "load_ts", "update_ts").first()
    assert (float(got.today_sum), float(got.prior_sum)) == (30.0, 90.0)
    assert got.pct_difference == 900.0 and got.status == "FAIL"


def test_recon_threshold_zero_flags_every_row_and_null_sides_are_skipped(spark):
    df = spark.createDataFrame([(1, 1), (5, 4), (None, 3)], "s long, t long")
    assert checks.recon_deviations(df, "s", "t", 0).count() == 2
    assert rows(checks.recon_verdict(df, "s", "t", 2)) == [(3, 0, "PASS")]


def test_recon_ratio(spark):
    hundred = spark.range(100)
    assert status(checks.recon_ratio(hundred.limit(95), hundred)) == "PASS"
    assert status(checks.recon_ratio(hundred.limit(94), hundred)) == "FAIL"


def test_failure_conventions(spark):
    df = spark.createDataFrame([("Y", "N", 1), ("Y", "N", 2)], "a_Balanced string, balanced_b string, n int")
    assert rows(checks.failing_values(df, "balanced", "N")) == [("a_Balanced", 0, "PASS"), ("balanced_b", 2, "FAIL")]
    assert checks.failing_values(df, "nothing", "N").count() == 0
    assert status(checks.row_count_rule(df, "row_count_zero")) == "PASS"
    assert status(checks.row_count_rule(df, "row_count_nonzero")) == "FAIL"
    assert status(checks.row_count_rule(df, "none")) == "INFO"


def test_unknown_outcome_is_not_good(spark):
    df = spark.createDataFrame([(1,), (None,)], "v int")
    got = checks.pass_ratio(df, [checks.RatioCheck("positive", F.col("v") > 0, 0.6)]).first()
    assert (got.good_rows, got.total_rows, got.pass_share, got.status) == (1, 2, 0.5, "FAIL")


def test_last_transaction(spark):
    df = spark.createDataFrame(
        [("2024-03-10", "2024-03-09 23:10:00"), ("2024-03-10", "2024-03-09 02:00:00"), ("2024-03-11", "2024-03-10 22:59:59")], "d string, t string"
    ).select(F.to_date("d").alias("d"), F.col("t").cast("timestamp_ntz").alias("t"))
    got = rows(checks.last_transaction_previous_day(df, "d", "t"), "load_day", "is_prev_day", "is_late", "status")
    assert got == [(date(2024, 3, 10), "Y", "Y", "PASS"), (date(2024, 3, 11), "Y", "N", "FAIL")]
