"""Plans that must hold at scale."""

import re
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lakecheck.operators import audit, checks, compare, jobs, keys, mart, members, movement, outcomes, policies, rolling, rules
from lakecheck.operators.rules import Rule
from lakecheck.plans import rule_queries
from lakecheck.plans.inputs import EVENTS_DAY, Inputs
from lakecheck.sinks import merge


@pytest.fixture(scope="module")
def t(spark):
    return Inputs(spark, "/root/testdata/sf0.01")


@pytest.fixture
def no_broadcast(spark):
    """As if every side were large."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scans(df) -> int:
    return len(re.findall(r"FileScan parquet", plan(df)))


def test_all_row_rules_of_a_table_share_one_scan(t):
    many = [Rule(f"r{i}", "RANGE", "li", "l_quantity", min_value=0, max_value=i) for i in range(20)]
    got = rules.evaluate_rules({"li": t.lineitem}, many, "r", datetime(2024, 1, 1))
    assert scans(got) == 1
    assert "ReadSchema: struct<l_quantity:double>" in plan(got)


def test_violations_share_one_scan(t):
    got = checks.violations(t.orders, {c: F.col(c).isNull() for c in t.orders.columns})
    assert scans(got) == 1


def test_policy_metrics_share_one_scan_and_shuffle_once_in_full(t):
    assert scans(policies.daily_metrics(t.policies)) == 1


def test_day_filters_reach_the_reader(t):
    got = plan(keys.load_slice(t.orders, date(2001, 7, 31), "o_orderdate").select("o_orderkey"))
    assert "GreaterThanOrEqual(o_orderdate" in got and "LessThan(o_orderdate" in got


def test_latest_load_filter_reaches_the_reader(t):
    rows = t.events.withColumnRenamed("ts", "load_date")
    got = plan(keys.latest_rows(rows, "load_date").select("event_id"))
    assert "EqualTo(ts,ScalarSubquery" in got


def test_a_frequent_key_is_limited_before_the_shuffle(t):
    got = plan(keys.dedup_latest(t.orders, ["o_custkey"], [F.desc("o_orderdate"), "o_orderkey"]))
    below = got[got.index("Exchange") :]
    assert "WindowGroupLimit" in below


def test_similar_outcomes_limit_groups_before_the_shuffle(t):
    got = plan(outcomes.similar_outcomes(t.failures, t.outcomes))
    assert got.count("WindowGroupLimit") >= 4 and "NestedLoop" not in got and "Cartesian" not in got


def test_difference_is_one_shuffle_without_join(t):
    got = plan(compare.data_diff(t.orders_src, t.orders_tgt, ["k"], ["status"]))
    assert got.count("Exchange") == 1 and "Join" not in got
    assert "partial_" in got


def test_key_rules_of_a_run_share_one_combined_shuffle(t):
    listed = [
        Rule("u", "UNIQUENESS", "li", ("l_orderkey", "l_linenumber")),
        Rule("f", "REFERENTIAL", "li", "l_partkey", ref_table="part", ref_column="p_partkey"),
        Rule("s", "UNIQUENESS", "part", "p_name"),
        Rule("b", "BUSINESS", "li", "l_quantity", condition="l_quantity > 45"),
        Rule("n", "ROW_COUNT", "part", threshold=1),
    ]
    got = plan(rules.evaluate_rules({"li": t.lineitem, "part": t.part}, listed, "r", datetime(2024, 1, 1)))
    assert len(re.findall(r"FileScan parquet", got)) == 2
    assert got.count("Exchange hashpartitioning") == 1 and "Join" in got and "SortMergeJoin" not in got
    # counts are combined in the tasks that read, and nothing is sorted
    below = got[got.index("Exchange hashpartitioning") :]
    assert "partial_count" in below and "SortAggregate" not in below and "Sort [" not in got
    assert "l_extendedprice" not in got


def test_audit_rows_read_each_table_once(t):
    known = {"orders_q": t.orders_q, "customer": t.customer, "lineitem": t.lineitem}
    for listed in (rule_queries.RULES, rule_queries.KEY_RULES):
        got = rules.evaluate_rules(known, listed, "r", datetime(2024, 1, 1))
        assert scans(got) == 3 and plan(got).count("Exchange hashpartitioning") == 1


def test_a_slice_shuffles_few_reference_keys(spark, t, no_broadcast):
    part = t.orders_src.filter("amount < 5000")
    key = F.col("k")
    every, few = (keys.reference_keys(part, t.orders_tgt, key, key, expected) for expected in (None, part.count()))
    assert "bit_or" in plan(few) and "shiftright" in plan(few)
    hits = part.join(t.orders_tgt, "k").count()
    assert hits <= few.count() <= hits + 0.02 * every.count() < every.count() / 2
    got = plan(keys.missing_count(part, t.orders_tgt, key, key, part.count()))
    # the filter stands below the exchange of the reference keys
    assert got.index("Exchange hashpartitioning(_key") < got.rindex("shiftright")


def test_a_filter_that_would_be_too_large_is_left_out(t):
    key = F.col("k")
    assert "shiftright" not in plan(keys.reference_keys(t.orders_src, t.orders_tgt, key, key, 10**9))


def test_segments_shuffle_digests_before_rows(t):
    got = plan(compare.data_diff(t.orders_src, t.orders_tgt, ["k"], ["status"], segments=64))
    digests = got[got.index("BroadcastExchange") :]
    assert "partial_bit_xor" in digests and "SortAggregate" not in digests and "Sort [" not in digests


def test_equal_tables_are_not_read_twice_for_their_rows(t):
    df = compare.data_diff(t.orders_src, t.orders_src, ["k"], ["status", "amount"], segments=64)
    assert df.count() == 0
    assert df.collect() == []
    # once the digests are there, nothing is left to do
    final = plan(df).split("== Initial Plan ==")[0]
    assert "EmptyRelation" in final and "FileScan" not in final and "SortAggregate" not in final


def test_summary_meets_the_customers_after_aggregation(t, no_broadcast):
    got = plan(mart.customer_order_summary(t.customers_v, t.lines, t.products_v, date(1998, 1, 1), date(2001, 7, 31)))
    # reading upwards from the lines: partial aggregate, shuffle, final aggregate, join with customers
    assert got.index("min_by") < got.index("partial_sum(quantity")
    assert "WindowExec" not in got and "Window [" not in got
    assert "CartesianProduct" not in got and "NestedLoop" not in got


def test_small_merge_source_leaves_the_target_unshuffled(t):
    source = t.orders_src.filter(F.col("k") < 10).withColumn("ts", F.lit(1))
    target = t.orders_tgt
    got = merge.merge_upsert(target, source, ["k"], ["status"], [F.desc("ts")])
    assert "BroadcastHashJoin" in plan(got) and "SortMergeJoin" not in plan(got)


def test_no_cross_join_in_movement_checks(t):
    for df in (
        movement.missing_subcategories(t.movements, [("ADD", "NEW")]),
        movement.trend_top_clubs(t.movements),
        movement.net_gain_balance(t.movements),
    ):
        assert "Cartesian" not in plan(df) and "NestedLoop" not in plan(df)


def test_top_failing_checks_need_no_sort_aggregate(t):
    for got in (audit.top_failing(t.audit, EVENTS_DAY), audit.top_failing_checks(t.audit)):
        assert "SortAggregate" not in plan(got)


def test_zero_filled_days_read_only_their_range(t):
    got = plan(jobs.daily_rows(t.events, "ts", EVENTS_DAY, 7))
    assert "GreaterThanOrEqual(ts" in got and "LessThan(ts" in got


def test_reappearance_is_not_forced_into_a_broadcast(t, no_broadcast):
    assert "Broadcast" not in plan(rolling.delete_reappear(t.presence, "k", "snapshot_date"))


def test_distinct_counts_multiply_combined_rows_only(t):
    got = plan(members.statewise_members(t.members, EVENTS_DAY)) if hasattr(t, "members") else ""
    assert not got or got.index("Expand") < got.rindex("HashAggregate")


def test_no_query_leaves_a_cached_frame(spark, t):
    keys.latest_rows(t.movements, "load_date", "movement_category").count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0
