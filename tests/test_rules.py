from datetime import datetime

from lakecheck.operators.rules import Rule, evaluate_rules, evaluate_rules_isolated, run_summary
from tests.conftest import rows

NOW = datetime(2024, 1, 1)
RESULT = ("rule_name", "row_count_failed", "total_row_count", "status", "failed_value")


def evaluate(frames, *rules):
    return evaluate_rules(frames, list(rules), "r", NOW)


def test_total_counts_the_whole_table_not_only_failures(spark):
    df = spark.createDataFrame([(1, "a"), (None, "b"), (None, "c")], "k int, v string")
    assert rows(evaluate({"t": df}, Rule("n", "NOT_NULL", "t", "k")), *RESULT) == [("n", 2, 3, "FAIL", None)]


def test_null_is_no_failure_of_range_and_pattern(spark):
    df = spark.createDataFrame([(1, "ab"), (None, None), (9, "xx")], "k int, v string")
    got = rows(
        evaluate(
            {"t": df},
            Rule("range", "RANGE", "t", "k", min_value=0, max_value=5),
            Rule("find", "REGEX", "t", "v", pattern="b"),
        ),
        *RESULT,
    )
    assert got == [("find", 1, 3, "FAIL", "xx"), ("range", 1, 3, "FAIL", "9")]


def test_uniqueness_counts_surplus_rows_and_groups_nulls(spark):
    df = spark.createDataFrame([(1,), (1,), (1,), (None,), (None,), (2,)], "k int")
    assert rows(evaluate({"t": df}, Rule("u", "UNIQUENESS", "t", "k")), *RESULT) == [("u", 3, 6, "FAIL", "1")]


def test_reference_column_with_null_still_finds_orphans(spark):
    df = spark.createDataFrame([(1,), (7,), (7,), (None,)], "fk int")
    ref = spark.createDataFrame([(1,), (1,), (None,)], "id int")
    rule = Rule("r", "REFERENTIAL", "t", "fk", ref_table="ref", ref_column="id")
    assert rows(evaluate({"t": df, "ref": ref}, rule), *RESULT) == [("r", 2, 4, "FAIL", "7")]


def test_empty_table_fails_a_row_count_rule_and_passes_the_others(spark):
    df = spark.createDataFrame([], "k int")
    got = rows(
        evaluate({"t": df}, Rule("count", "ROW_COUNT", "t", threshold=1), Rule("null", "NOT_NULL", "t", "k"), Rule("unique", "UNIQUENESS", "t", "k")),
        *RESULT,
    )
    assert got == [("count", 1, 0, "FAIL", None), ("null", 0, 0, "PASS", None), ("unique", 0, 0, "PASS", None)]


def test_broken_rules_become_error_rows_and_leave_the_others_alone(spark):
    df = spark.createDataFrame([(1,)], "k int")
    got = evaluate(
        {"t": df},
        Rule("fine", "NOT_NULL", "t", "k"),
        Rule("no column", "NOT_NULL", "t", "gone"),
        Rule("no table", "NOT_NULL", "gone", "k"),
        Rule("syntax", "BUSINESS", "t", condition="k >"),
        Rule("type", "SOMETHING", "t", "k"),
        Rule("operator", "ROW_COUNT", "t", operator="; drop"),
        Rule("bounds", "RANGE", "t", "k"),
    )
    assert rows(got, "rule_name", "status") == [
        ("bounds", "ERROR"),
        ("fine", "PASS"),
        ("no column", "ERROR"),
        ("no table", "ERROR"),
        ("operator", "ERROR"),
        ("syntax", "ERROR"),
        ("type", "ERROR"),
    ]
    assert rows(run_summary(got)) == [(7, 1, 0, 6, 2)]


def test_statuses_add_up(spark):
    df = spark.createDataFrame([(i % 5,) for i in range(50)], "k int")
    rules = [Rule(f"b{i}", "BUSINESS", "t", "k", condition=f"k = {i}") for i in range(8)]
    total, passed, failed, errors, _ = rows(run_summary(evaluate({"t": df}, *rules)))[0]
    assert (total, passed + failed + errors, failed) == (8, 8, 5)


def isolated(frames, *rules):
    return evaluate_rules_isolated(frames, list(rules), "r", NOW)


def by_name(df):
    return {r["rule_name"]: (r["row_count_failed"], r["total_row_count"], r["status"], r["failed_value"]) for r in df.collect()}


def test_row_rules_and_key_rules_of_a_table_agree_with_each_alone(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.5, None), (1, "a", None, "x"), (2, "b", -0.0, "y"), (2, "c", 0.0, "y"), (None, None, float("nan"), ""), (7, "zz", float("nan"), "q")],
        "k int, v string, d double, w string",
    )
    ref = spark.createDataFrame([(1, "y"), (2, None), (2, "q"), (None, "x")], "id bigint, w string")
    listed = [
        Rule("k", "UNIQUENESS", "t", "k"),
        Rule("kv", "UNIQUENESS", "t", ("k", "v")),
        Rule("vk", "UNIQUENESS", "t", ("v", "k")),
        Rule("d", "UNIQUENESS", "t", "d"),
        Rule("vw", "UNIQUENESS", "t", ("v", "w")),
        Rule("fk", "REFERENTIAL", "t", "k", ref_table="ref", ref_column="id"),
        Rule("back", "REFERENTIAL", "ref", "id", ref_table="t", ref_column="k"),
        Rule("text", "REFERENTIAL", "t", "w", ref_table="ref"),
        Rule("self", "REFERENTIAL", "t", "v", ref_table="t", ref_column="w"),
        Rule("mixed", "REFERENTIAL", "t", "d", ref_table="ref", ref_column="id"),
        Rule("unlike", "REFERENTIAL", "ref", "id", ref_table="numbers", ref_column="n"),
        Rule("null", "NOT_NULL", "t", "v"),
        Rule("nulls", "NOT_NULL", "t", ("v", "w")),
        Rule("range", "RANGE", "t", "k", min_value=0, max_value=5),
        Rule("find", "REGEX", "t", "w", pattern="[xy]"),
        Rule("count", "ROW_COUNT", "t", operator=">", threshold=100),
        Rule("business", "BUSINESS", "t", condition="k = 2"),
        Rule("shown", "BUSINESS", "t", "d", condition="d > 0.5"),
        Rule("ref null", "NOT_NULL", "ref", "w"),
        Rule("gone", "UNIQUENESS", "t", "nothing"),
    ]
    frames = {"t": df, "ref": ref, "numbers": spark.createDataFrame([("1",), ("2",)], "n string")}
    together = by_name(evaluate(frames, *listed))
    alone = by_name(evaluate(frames, *listed[9:]))
    for rule in listed[:9]:
        alone |= by_name(evaluate(frames, rule))
    assert together == alone
    assert together["k"] == (2, 6, "FAIL", "1") and together["kv"] == (1, 6, "FAIL", "1^a")
    assert together["d"] == (2, 6, "FAIL", "0.0") and together["fk"] == (1, 6, "FAIL", "7")
    assert together["back"] == (0, 4, "PASS", None) and together["text"] == (1, 6, "FAIL", "")
    assert together["unlike"] == (0, 4, "PASS", None) and together["gone"][2] == "ERROR"
    assert together["count"] == (6, 6, "FAIL", None) and together["shown"] == (3, 6, "FAIL", "1.5")


def test_key_rules_on_empty_tables(spark):
    empty, full = spark.createDataFrame([], "k int"), spark.createDataFrame([(1,), (1,)], "k bigint")
    rule = lambda name, table, ref: Rule(name, "REFERENTIAL", table, "k", ref_table=ref)
    got = by_name(evaluate({"e": empty, "f": full}, rule("e", "e", "f"), rule("f", "f", "e"), Rule("u", "UNIQUENESS", "e", "k"), Rule("n", "ROW_COUNT", "e", threshold=1)))
    assert got == {"e": (0, 0, "PASS", None), "f": (2, 2, "FAIL", "1"), "u": (0, 0, "PASS", None), "n": (1, 0, "FAIL", None)}


def test_decimal_dates_and_booleans_as_keys(spark):
    df = spark.sql("SELECT CAST(i AS DECIMAL(10,2)) AS m, DATE '2024-01-01' + CAST(i % 2 AS INT) AS d, i % 2 = 0 AS b, CAST(CAST(i AS STRING) AS BINARY) AS x FROM VALUES (1), (2), (3), (3) AS t(i)")
    got = by_name(evaluate({"t": df}, *(Rule(c, "UNIQUENESS", "t", c) for c in "mdb"), Rule("x", "UNIQUENESS", "t", ("x", "b"))))
    assert {k: v[:3] for k, v in got.items()} == {"m": (1, 4, "FAIL"), "d": (2, 4, "FAIL"), "b": (2, 4, "FAIL"), "x": (1, 4, "FAIL")}
    assert got["m"][3] == "3.00" and got["d"][3] == "2024-01-02" and got["b"][3] == "false"


def test_limits_that_cannot_be_read_are_errors_of_their_rule_only(spark):
    df = spark.sql("SELECT DATE '2024-01-01' AS d, 5L AS n, 2.5D AS x, 'text' AS v, TIMESTAMP_NTZ '2024-01-01 10:00:00' AS ts")
    got = isolated(
        {"t": df},
        Rule("date", "RANGE", "t", "d", min_value="abc", max_value="2025-01-01"),
        Rule("number", "RANGE", "t", "n", min_value="abc", max_value="9"),
        Rule("double", "RANGE", "t", "x", min_value="1", max_value="two"),
        Rule("sound", "NOT_NULL", "t", "d"),
        Rule("good date", "RANGE", "t", "d", min_value="2023-01-01", max_value="2023-12-31"),
        Rule("good time", "RANGE", "t", "ts", min_value="2024-01-01 09:00:00", max_value="2024-01-01 11:00:00"),
        Rule("good number", "RANGE", "t", "n", min_value="5", max_value="5.5"),
        Rule("text", "RANGE", "t", "v", min_value="a", max_value="z"),
        Rule("pattern", "REGEX", "t", "v", pattern="(x"),
        Rule("other pattern", "REGEX", "t", "v", pattern="t.x"),
    )
    assert rows(got, "rule_name", "status", "error_message") == [
        ("date", "ERROR", "CAST_INVALID_INPUT"),
        ("double", "ERROR", "CAST_INVALID_INPUT"),
        ("good date", "FAIL", None),
        ("good number", "PASS", None),
        ("good time", "PASS", None),
        ("number", "ERROR", "CAST_INVALID_INPUT"),
        ("other pattern", "PASS", None),
        ("pattern", "ERROR", "INVALID_PARAMETER_VALUE.PATTERN"),
        ("sound", "PASS", None),
        ("text", "PASS", None),
    ]


def test_any_rule_that_breaks_while_it_runs_is_told_and_keeps_its_type(spark):
    df = spark.createDataFrame([("1",), ("x",)], "v string")
    numbers = spark.createDataFrame([(1,), (2,)], "n int")
    got = isolated(
        {"t": df, "n": numbers},
        Rule("cast", "BUSINESS", "t", condition="CAST(v AS INT) > 0"),
        Rule("key", "REFERENTIAL", "t", "v", ref_table="n", ref_column="n"),
        Rule("unique", "UNIQUENESS", "t", "v"),
        Rule("other table", "UNIQUENESS", "n", "n"),
    )
    assert rows(got, "rule_name", "rule_type", "status") == [
        ("cast", "BUSINESS", "ERROR"),
        ("key", "REFERENTIAL", "ERROR"),
        ("other table", "UNIQUENESS", "PASS"),
        ("unique", "UNIQUENESS", "PASS"),
    ]
