from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from lakecheck.operators import keys, mart, rolling, topn
from tests.conftest import rows

START = date(2024, 1, 1)


def daily(spark, values, group="g"):
    data = [(group, START + timedelta(days=i), v) for i, v in enumerate(values) if v is not None]
    return spark.createDataFrame(data, "g string, d date, cnt long")


def test_no_baseline_and_no_spread_fail(spark):
    got = rows(rolling.rolling_zscore_rows(daily(spark, [5, 5, 5, 9]), ["g"], "d"), "d", "z_score", "status")
    assert [r[1:] for r in got] == [(None, "FAIL")] * 4
    got = rows(rolling.rolling_zscore_rows(daily(spark, [4, 6, 5, 9]), ["g"], "d"), "d", "z_score", "status")
    assert [r[1:] for r in got][2:] == [(0.0, "PASS"), (4.0, "FAIL")]


def test_calendar_window_sees_days_not_rows(spark):
    values = [10] + [None] * 29 + [20, None, 30]
    as_of = START + timedelta(days=32)
    got = rows(rolling.rolling_zscore_days(daily(spark, values), "d", "cnt", as_of), "d", "mean", "z_score", "z_flag")
    assert got == [(date(2024, 1, 31), 10.0, 0.0, "NORMAL"), (date(2024, 2, 2), 20.0, 0.0, "NORMAL")]


def test_rolling_status_flags_only_beyond_two_deviations(spark):
    got = rows(rolling.rolling_status(daily(spark, [10, 12, 10, 12, 40]), ["g"], "d"), "d", "rolling_avg", "status")
    assert [r[2] for r in got] == ["NORMAL"] * 4 + ["ANOMALY"]
    assert got[4][1] == 11.0


def test_deviation_needs_a_baseline(spark):
    got = rows(rolling.rolling_deviation(daily(spark, [0, 5, 100]), ["g"], "d"), "d", "deviation_pct", "deviates")
    assert [r[1:] for r in got] == [(None, "N"), (None, "N"), (3900.0, "Y")]


def test_delete_and_reappear(spark):
    days = [START + timedelta(days=i) for i in (0, 1, 2, 4)]  # day 3 has no snapshot at all
    data = [(1, days[0]), (1, days[2]), (2, days[2]), (2, days[3]), (3, days[0]), (3, days[1]), (3, days[1])]
    df = spark.createDataFrame(data, "k int, d date")
    assert rows(rolling.delete_reappear(df, "k", "d")) == [(1, days[0], days[2], 1)]


def test_latest_row_and_its_tie_break(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "c"), (None, 1, "n")], "k int, t int, v string")
    assert rows(keys.dedup_latest(df, ["k"], [F.desc("t"), F.desc("v")])) == [(1, 2, "c"), (None, 1, "n")]


def test_top_category_ties_go_by_name_and_missing_last(spark):
    df = spark.createDataFrame(
        [(1, "b", 2), (1, "a", 2), (1, None, 2), (2, None, 3), (2, "z", 1)], "customer_id int, category string, category_count long"
    )
    assert rows(mart.top_category(df)) == [(1, "a", 2), (2, None, 3)]


def test_summary_equals_the_step_by_step_form(spark):
    since = date(2023, 1, 1)
    people = spark.createDataFrame([(1, "ann", "EU", True), (2, "bob", "US", False)], "customer_id int, customer_name string, region string, active boolean")
    items = spark.createDataFrame(
        [(1, "p", "toys", "10", "4", True), (2, "q", "food", "0", "1", True), (3, "r", "food", "5", "1", False)],
        "product_id int, product_name string, category string, price string, cost string, active boolean",
    ).withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("price", "cost")})
    orders = spark.createDataFrame(
        [
            (1, 1, 1, date(2023, 5, 1), 2, "20", "completed"),
            (2, 1, 2, date(2023, 6, 1), 1, "7.5", "completed"),
            (3, 1, 3, date(2023, 7, 1), 1, None, "completed"),
            (4, 1, 1, date(2022, 7, 1), 1, "9", "completed"),
            (5, 1, 1, date(2023, 7, 1), 1, "9", "open"),
            (6, 2, 1, date(2023, 7, 1), 1, "9", "completed"),
        ],
        "order_id int, customer_id int, product_id int, order_date date, quantity int, total_amount string, status string",
    ).withColumn("total_amount", F.col("total_amount").cast("decimal(18,2)"))
    full = mart.with_products(
        mart.customer_orders(mart.active_only(people), mart.completed_since(orders, since)), mart.active_only(items)
    ).withColumn("profit_margin_pct", mart.profit_margin())
    steps = mart.with_top_category(mart.customer_metrics(full), mart.top_category(mart.category_counts(full)))
    whole = mart.customer_order_summary(people, orders, items, since, since)
    assert rows(whole, *steps.columns) == rows(steps)
    got = whole.first()
    assert (got.total_orders, got.avg_order_value, got.avg_profit_margin, got.top_category) == (3, 13.75, 60.0, "food")


@pytest.mark.parametrize("n,expected", [(1, [("Others", 6), ("a", 5)]), (3, [("a", 5), ("b", 4), ("c", 2)])])
def test_others_only_where_something_is_left(spark, n, expected):
    df = spark.createDataFrame([("a", 5), ("b", 3), ("b", 1), ("c", 2)], "l string, v long")
    assert rows(topn.top_with_others(df, "l", "v", n)) == expected
