from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from lakecheck.operators import audit, freshness, jobs, outcomes
from tests.conftest import rows

NOW = datetime(2024, 3, 11, 2, 0)  # 10 March 19:00 local; clocks went forward that morning
COLUMNS = """job_name string, domain string, run_id long, started string, exec_sec long, dpu_seconds long, state string,
    worker_type string, num_workers int, sla string, error_message string"""


def runs(spark, *data):
    full = [(r[0], "d", i, r[1], r[2], 3600, r[3], "G.1X", 2, r[4], r[5] if len(r) > 5 else "") for i, r in enumerate(data)]
    frame = spark.createDataFrame(full, COLUMNS)
    return frame.withColumn("started_on", F.col("started").cast("timestamp_ntz")).drop("started")


def test_deadline_is_local_and_follows_daylight_saving(spark):
    df = runs(
        spark,
        ("before", "2024-03-09 16:00:00", 3600, "SUCCEEDED", "09:00"),  # ends 09:00 PST: on time
        ("after", "2024-03-10 16:00:00", 3600, "SUCCEEDED", "09:00"),  # ends 10:00 PDT: late
        ("none", "2024-03-10 16:00:00", 0, "FAILED", "09:00"),
        ("running", "2024-03-10 16:00:00", 0, "RUNNING", "18:00"),
    )
    got = rows(jobs.with_sla(df, NOW), "job_name", "sla_status")
    assert got == [("after", "BREACHED"), ("before", "ON TIME"), ("none", "N/A"), ("running", "BREACHED")]


def test_an_end_time_wins_over_the_estimate(spark):
    df = runs(spark, ("a", "2024-03-10 16:00:00", 60, "SUCCEEDED", "09:30"))
    late = df.withColumn("completed_on", F.lit("2024-03-10 17:00:00").cast("timestamp_ntz"))
    assert jobs.with_sla(df, NOW).first()["sla_status"] == "ON TIME"
    assert jobs.with_sla(late, NOW).first()["sla_status"] == "BREACHED"


def test_a_job_without_runs_is_reported(spark):
    df = runs(spark, ("a", "2024-03-10 16:00:00", 60, "SUCCEEDED", "23:00"))
    names = spark.createDataFrame([("a", "d"), ("b", "e")], "job_name string, domain string")
    got = rows(jobs.latest_status(df, NOW, names), "job_name", "domain", "status", "is_recent", "is_today")
    assert got == [("a", "d", "SUCCEEDED", True, True), ("b", "e", "NO_RUNS_FOUND", False, False)]


def test_health_points(spark):
    df = runs(
        spark,
        ("good", "2024-03-10 16:00:00", 60, "SUCCEEDED", "23:00"),
        ("mixed", "2024-03-08 16:00:00", 60, "SUCCEEDED", "23:00"),
        ("mixed", "2024-03-09 01:00:00", 60, "SUCCEEDED", "23:00"),
        ("mixed", "2024-03-09 16:00:00", 60, "FAILED", "23:00", "boom"),
        ("future", "2024-03-12 00:00:00", 60, "FAILED", "23:00"),
    )
    got = rows(jobs.health_score(df, NOW), "job_name", "health_score", "health")
    assert got == [("good", 100, "Healthy"), ("mixed", 26 + 30, "Critical")]
    assert rows(jobs.attention(df, NOW), "job_name") == [("mixed",)]


def test_quiet_days_are_zero(spark):
    df = runs(spark, ("a", "2024-03-10 16:00:00", 60, "SUCCEEDED", "23:00"))
    got = rows(jobs.last_days(df, NOW, date(2024, 3, 10)), "run_day", "runs", "on_time")
    assert len(got) == 7 and got[-1] == (date(2024, 3, 10), 1, 1) and got[0] == (date(2024, 3, 4), 0, 0)


def listing(spark, *files):
    frame = spark.createDataFrame(list(files), "source string, subfolder string, m string")
    return frame.withColumn("modified", F.col("m").cast("timestamp_ntz")).drop("m")


def test_freshness_states(spark):
    files = listing(
        spark,
        ("ok", "a", "2024-03-11 01:00:00"),
        ("old", "a", "2024-03-11 01:00:00"),
        ("old", "b", "2024-03-10 22:00:00"),
        *[("many", f"f{i}", "2024-03-11 01:30:00") for i in range(4)],
        ("flat", None, "2024-03-10 22:00:00"),
        ("flat_old", None, "2024-03-10 17:00:00"),
    )
    names = spark.createDataFrame([("ok",), ("old",), ("many",), ("flat",), ("flat_old",), ("empty",)], "source string")
    got = dict(rows(freshness.source_status(files, NOW, names), "source", "status"))
    assert got == {
        "ok": "OK",
        "old": "Stale",
        "many": "Stale",
        "flat": "OK",
        "flat_old": "Check with Source",
        "empty": "Check with Source",
    }
    folders = dict(rows(freshness.folder_summary(files, NOW, names), "source", "status"))
    assert (folders["ok"], folders["old"], folders["many"], folders["empty"]) == ("PASS", "WARN", "FAIL", "PASS")
    assert rows(freshness.alerts(files, NOW, names), "source", "alert") == [("empty", "stale_files"), ("flat_old", "stale_files")]


AUDIT = """run_id string, run_date string, event_type string, source_label string, status string, validation_name string,
    check_type string, cost_usd string, overall_status string"""


def test_one_failed_record_fails_the_run_and_blank_costs_are_zero(spark):
    df = spark.createDataFrame(
        [("r", "2024-03-10", "VALIDATION", "", "PASS", "v", "", "", "PASS"), ("r", "2024-03-10", "VALIDATION", "", "FAIL", "v", "", "0.5", "FAIL")], AUDIT
    ).withColumn("event_timestamp", F.lit("2024-03-10 00:00:00").cast("timestamp_ntz"))
    got = audit.by_run(df, date(2024, 3, 10)).first()
    assert (got.overall_status, got.event_count, got.total_cost) == ("FAIL", 2, 0.5)
    empty = audit.day_totals(df, date(2024, 3, 9)).first()
    assert (empty.total, empty.pass_rate, empty.overall_status) == (0, None, "PASS")


def test_published_sample_day(spark):
    """47 checks, 39 passed, 3 failed, 2 warned, 3 not executed give 83.0 %."""
    states = ["PASS"] * 39 + ["FAIL"] * 3 + ["WARN"] * 2 + ["NOT_EXECUTED"] * 3
    df = spark.createDataFrame([(f"r{i % 3}", "2024-03-10", "VALIDATION", "", s, "v", "", "0.0003021277", s) for i, s in enumerate(states)], AUDIT)
    got = audit.day_totals(df, date(2024, 3, 10)).first()
    assert (got.total, got.passed, got.failed, got.warned, got.not_executed, got.pass_rate, got.total_cost) == (47, 39, 3, 2, 3, 83.0, 0.0142)


def test_source_rates_fall_back_to_validation_names(spark):
    base = [("r", "2024-03-10", "VALIDATION", " ", "PASS", "v", "", "", "PASS"), ("r", "2024-03-10", "VALIDATION", "", "FAIL", "w", "", "", "PASS")]
    unnamed = spark.createDataFrame(base, AUDIT)
    assert rows(audit.pass_rate_by_source(unnamed, date(2024, 3, 10)), "source", "pass_rate") == [("v", 100.0), ("w", 0.0)]
    named = unnamed.unionByName(spark.createDataFrame([("r", "2024-03-10", "VALIDATION", "src", "PASS", "v", "", "", "PASS")], AUDIT))
    assert rows(audit.pass_rate_by_source(named, date(2024, 3, 10)), "source") == [("src",)]


@pytest.mark.parametrize(
    "check_type,name,expected",
    [("Threshold ", "", "Accuracy"), ("x", "daily_volume", "Volume"), ("", "no_rows row_count", "Completeness"), ("x", "", "Validity"), ("", None, "Other")],
)
def test_quality_dimension(spark, check_type, name, expected):
    df = spark.createDataFrame([(check_type, name)], "check_type string, validation_name string")
    assert df.select(audit.dimension_of()).first()[0] == expected


def test_layer_prefix(spark):
    df = spark.createDataFrame([("BASE_VALIDATION",), ("VALIDATION",), ("MY_BASE_GLUE_TRIGGER",), ("ODD",)], "event_type string")
    assert [r[0] for r in df.select(audit.layer_of()).collect()] == ["BASE", "VALIDATION", "MY_BASE", "ODD"]


def test_similar_outcomes_equal_the_plain_or_join(spark):
    fails = spark.createDataFrame([(i, f"r{i % 4}", f"t{i % 3}" if i % 5 else None) for i in range(40)], "record_id int, rule_name string, table_name string")
    past = spark.range(300).select(
        F.col("id").alias("outcome_id"),
        F.concat(F.lit("r"), F.col("id") % 5).alias("rule_name"),
        F.concat(F.lit("t"), F.col("id") % 7).alias("table_name"),
        F.lit("c").alias("classification"),
        F.lit("a").alias("action"),
        (F.col("id") * 7 % 50).alias("resolved_at"),
    )
    got = rows(outcomes.similar_outcomes(fails, past, 6), "record_id", "outcome_id", "similar_rank")
    expected = []
    history = past.collect()
    for f in fails.collect():
        near = [o for o in history if o.rule_name == f.rule_name or o.table_name == f.table_name]
        near.sort(key=lambda o: (-o.resolved_at, -o.outcome_id))
        expected += [(f.record_id, o.outcome_id, i) for i, o in enumerate(near[:6], start=1)]
    assert got == sorted(expected, key=str)
