from lakecheck.operators.rules import Rule
from lakecheck.operators.suite import run_check, run_comparison, run_suite, run_suite_isolated
from tests.conftest import rows


def check(spark, query, kind, **config):
    return run_check(spark, {"name": "c", "query": query, "check_type": kind, **config}).first()


def test_rolling_average_by_counts_by_status_and_without_rows(spark):
    assert check(spark, "SELECT 10 AS today_cnt, 8.0 AS avg_14day_cnt", "rolling_average").status == "PASS"
    late = check(spark, "SELECT 11 AS today_count, 8.0 AS rolling_avg_60", "rolling_average", tolerance="15", warn_only=True)
    assert (late.status, late.actual_value) == ("WARN", "37.5")
    assert check(spark, "SELECT 'FAIL' AS status", "rolling_average").status == "FAIL"
    none = "SELECT 1 AS today_cnt, 1 AS baseline_cnt WHERE false"
    assert check(spark, none, "rolling_average").status == "WARN"


def test_status_queries(spark):
    assert check(spark, "SELECT 'NO_DATA' AS status, 0 AS total", "percentage_threshold").status == "NO_DATA"
    assert check(spark, "SELECT 'PASS' AS status", "date_window_validation").status == "PASS"


def test_conditions(spark):
    assert check(spark, "SELECT 3 AS cnt", "threshold", condition="cnt >= 1 and cnt < 5").status == "PASS"
    two = "SELECT * FROM VALUES (1, 'PASS'), (2, 'FAIL') AS t(d, status)"
    assert check(spark, two, "threshold", condition="status == 'PASS'").status == "FAIL"
    assert check(spark, two, "threshold", condition="status == 'PASS'", order=["d"]).status == "PASS"


def test_reconciliation(spark):
    pairs = "SELECT * FROM VALUES (1, 1), (5, 9) AS t(count_source, dl)"
    got = check(spark, pairs, "source_reconciliation", target_column="dl", deviation_threshold=2)
    assert (got.status, got.actual_value) == ("FAIL", "1")
    assert check(spark, pairs + " WHERE false", "source_reconciliation", target_column="dl").status == "PASS"


def test_broken_sql_does_not_stop_the_suite(spark):
    good = {"name": "good", "query": "SELECT 1 AS cnt", "check_type": "row_count", "condition": "cnt > 0"}
    bad = [{**good, "name": "column", "query": "SELECT gone"}, {**good, "name": "syntax", "query": "SELEC"}, {**good, "name": "condition", "condition": "gone > 0"}]
    pair = {"name": "pair", "rule": "match", "query_a": {"query": "SELECT 1 AS n"}, "query_b": {"query": "SELECT 1 AS n FROM gone"}}
    got = rows(run_suite(spark, [good, *bad], [pair]), "name", "status")
    assert got == [("column", "NOT_EXECUTED"), ("condition", "NOT_EXECUTED"), ("good", "PASS"), ("pair", "NOT_EXECUTED"), ("syntax", "NOT_EXECUTED")]


def test_comparisons(spark):
    pair = {"name": "p", "query_a": {"query": "SELECT 100 AS n"}, "query_b": {"query": "SELECT {n} AS n"}}
    got = run_comparison(spark, {**pair, "rule": "difference_within", "tolerance": "5"}, {"n": "96"}).first()
    assert (got.status, got.check_type, got.actual_value) == ("PASS", "comparison:difference_within", "a=100.0 b=96.0")
    assert run_comparison(spark, {**pair, "rule": "custom", "custom_expression": "a_val == b_val"}, {"n": "1"}).first().status == "FAIL"
    diff = run_comparison(spark, {**pair, "rule": "data_diff", "key_columns": "n"}, {"n": "1"}).first()
    assert (diff.status, diff.actual_value) == ("FAIL", "only_in_a=1,only_in_b=1,value_mismatches=0")


def test_rule_from_config():
    rule = Rule.from_config(
        {"rule_name": "r", "rule_type": "UNIQUENESS", "table": "t", "column": ["a", "b"], "severity": "HIGH", "constraint_description": "unique", "owner": "x"}
    )
    assert rule == Rule("r", "UNIQUENESS", "t", ("a", "b"), severity="HIGH", constraint="unique")
    assert Rule.from_config({"rule_name": "r", "rule_type": "ROW_COUNT", "table": "t", "column": "*"}).columns == ()


def test_every_row_of_a_result_counts(spark):
    one_fails = "SELECT * FROM VALUES ('PASS'), ('FAIL'), ('FAIL'), ('FAIL') AS t(status)"
    got = check(spark, one_fails, "percentage_threshold")
    assert (got.status, got.actual_value, got.detail) == ("FAIL", "FAIL", "3 of 4 rows not in order")
    assert check(spark, "SELECT * FROM VALUES ('PASS'), ('NO_DATA'), ('NO_DATA') AS t(status)", "percentage_threshold").status == "NO_DATA"
    assert check(spark, "SELECT CAST(NULL AS STRING) AS status", "percentage_threshold").status == "FAIL"
    assert check(spark, "SELECT 'PASS' AS status WHERE false", "date_window_validation").status == "WARN"
    days = "SELECT * FROM VALUES (100, 100), (5, 100) AS t(today_cnt, baseline_cnt)"
    assert (check(spark, days, "rolling_average").status, check(spark, days, "rolling_average").actual_value) == ("FAIL", "95.0")


def test_a_given_variance_is_the_one_tested(spark):
    given = "SELECT 10 AS today_cnt, 100 AS baseline_cnt, 5 AS variance_pct"
    assert check(spark, given, "rolling_average").status == "PASS"
    assert check(spark, "SELECT 10 AS today_cnt", "rolling_average", condition="today_cnt > 0").status == "PASS"
    assert check(spark, "SELECT 10 AS today_cnt, 'FAIL' AS status", "rolling_average").status == "FAIL"
    assert check(spark, "SELECT 10 AS today_cnt", "rolling_average").status == "NOT_EXECUTED"


def test_faults_of_a_description_are_not_executed(spark):
    assert check(spark, "SELECT 1 AS cnt", "row_count").detail == "condition is missing"
    assert check(spark, "SELECT 1 AS cnt", "rolling_average", tolerance="much").status == "NOT_EXECUTED"
    sides = {"name": "p", "query_a": {"query": "SELECT * FROM VALUES (1), (2) AS t(n)"}, "query_b": {"query": "SELECT 1 AS n"}}
    got = run_comparison(spark, {**sides, "rule": "match"}).first()
    assert (got.status, got.actual_value) == ("NOT_EXECUTED", "a=NULL b=1.0")
    for rule in ({"rule": "guess"}, {"rule": "data_diff"}, {"rule": "data_diff", "key_columns": "gone"}, {"rule": "custom"}):
        assert run_comparison(spark, {**sides, **rule}).first().status == "NOT_EXECUTED"


def test_a_check_that_breaks_while_it_runs_harms_no_other(spark):
    checks = [
        {"name": "good", "query": "SELECT 1 AS cnt", "check_type": "row_count", "condition": "cnt > 0"},
        {"name": "breaks", "query": "SELECT id / 0 AS cnt FROM range(3)", "check_type": "row_count", "condition": "cnt > 0"},
    ]
    assert rows(run_suite_isolated(spark, checks), "name", "status") == [("breaks", "NOT_EXECUTED"), ("good", "PASS")]
    assert rows(run_suite_isolated(spark, checks[:1]), "name", "status") == [("good", "PASS")]
