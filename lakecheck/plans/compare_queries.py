"""Two-sided comparisons."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakecheck.operators import audit, checks, compare, keys, suite
from lakecheck.plans.inputs import EVENTS_DAY, EVENTS_NOW, ORDERS_DAY, Inputs
from lakecheck.plans.registry import n_if, passes, query
from lakecheck.session import scratch_folder
from lakecheck.sinks import writers
from lakecheck.sources import audit_files

A = "(SELECT count(*) FROM orders_src)"
B = "(SELECT count(*) FROM orders_tgt)"


def counted(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("cnt"))


def scalar_rule(key: str, rule: str, ok: str, a: str = A, b: str = B, frames=None, **options):
    """Register a scalar rule; ``ok`` is the condition on a and b in SQL."""
    sql = f"""SELECT '{key}' AS name, '{rule}' AS rule, a AS value_a, b AS value_b, {passes(ok)} AS status
        FROM (SELECT CAST({a} AS DOUBLE) AS a, CAST({b} AS DOUBLE) AS b) v"""
    frames = frames or (lambda t: (counted(t.orders_src), counted(t.orders_tgt)))
    query(key, sql)(lambda t: compare.compare(*frames(t), rule, name=key, **options))


scalar_rule("cmp_match", "match", "a IS NOT DISTINCT FROM b", column="cnt")
scalar_rule("cmp_difference_within", "difference_within", "abs(a - b) <= 50", tolerance=50)
scalar_rule(
    "cmp_percentage_within",
    "percentage_within",
    "CASE WHEN greatest(abs(a), abs(b)) = 0 THEN 0 ELSE abs(a - b) / greatest(abs(a), abs(b)) * 100 END <= 5",
    tolerance=5,
)
scalar_rule("cmp_a_greater_than_b", "a_greater_than_b", "a > b")
scalar_rule("cmp_a_less_than_b", "a_less_than_b", "a < b")

MISSING = """(SELECT count(*) FROM orders_src s WHERE NOT EXISTS (SELECT 1 FROM orders_tgt t WHERE t.k = s.k))"""


def missing_and_all(t: Inputs):
    return keys.missing_count(t.orders_src, t.orders_tgt, F.col("k"), F.col("k")), counted(t.orders_src)


def all_and_missing(t: Inputs):
    return tuple(reversed(missing_and_all(t)))


scalar_rule("cmp_a_equals_zero", "a_equals_zero", "coalesce(a = 0, false)", MISSING, A, missing_and_all)
scalar_rule("cmp_b_equals_zero", "b_equals_zero", "coalesce(b = 0, false)", A, MISSING, all_and_missing)
scalar_rule("cmp_a_not_zero", "a_not_zero", "coalesce(a <> 0, false)", MISSING, A, missing_and_all)
scalar_rule("cmp_b_not_zero", "b_not_zero", "coalesce(b <> 0, false)", A, MISSING, all_and_missing)
scalar_rule(
    "cmp_custom",
    "custom",
    "abs(a - b) < greatest(a, b) * 0.1 AND least(a, b) > 0",
    expression="abs(a_val - b_val) < max(a_val, b_val) * 0.1 and min(a_val, b_val) > 0",
)

KEY30 = f"CAST(load_ts AS DATE) >= DATE '{ORDERS_DAY}' - 30"


def distinct_sides(t: Inputs):
    recent = t.orders_q.filter(F.col("load_ts") >= F.lit(str(ORDERS_DAY - timedelta(days=30))).cast("timestamp_ntz"))
    return compare.distinct_keys(recent, ["order_id", "customer_id"]), compare.distinct_keys(recent, ["order_id", "fk_customer"])


scalar_rule(
    "cmp_distinct_vs_source",
    "match",
    "a IS NOT DISTINCT FROM b",
    f"(SELECT count(DISTINCT order_id || '|' || customer_id) FROM orders_q WHERE {KEY30})",
    f"(SELECT count(DISTINCT order_id || '|' || fk_customer) FROM orders_q WHERE {KEY30})",
    distinct_sides,
    column="cnt",
)

scalar_rule(
    "cmp_today_vs_10d_avg",
    "percentage_within",
    "CASE WHEN greatest(abs(a), abs(b)) = 0 THEN 0 ELSE abs(a - b) / greatest(abs(a), abs(b)) * 100 END <= 25",
    f"(SELECT count(*) FROM events WHERE CAST(ts AS DATE) = DATE '{EVENTS_DAY}')",
    f"""(SELECT round(avg(n), 0) FROM (SELECT CAST(ts AS DATE) AS d, count(*) AS n FROM events
        WHERE CAST(ts AS DATE) BETWEEN DATE '{EVENTS_DAY}' - 10 AND DATE '{EVENTS_DAY}' - 1 GROUP BY 1) x)""",
    lambda t: checks.today_against_mean(t.events, "ts", EVENTS_DAY),
    tolerance=25,
    column="cnt",
)

# ---- row-level difference ----------------------------------------------------------------------

COLUMNS = ["status", "priority", "amount"]
SEGMENTS = 1 << 16
DIFF = """WITH d AS (
    SELECT coalesce(a.k, b.k) AS k,
           CASE WHEN b.k IS NULL THEN 'only_in_a' WHEN a.k IS NULL THEN 'only_in_b' ELSE 'both' END AS side,
           concat_ws(',', CASE WHEN a.status IS DISTINCT FROM b.status THEN 'status' END,
                          CASE WHEN a.priority IS DISTINCT FROM b.priority THEN 'priority' END,
                          CASE WHEN a.amount IS DISTINCT FROM b.amount THEN 'amount' END) AS names
    FROM orders_src a FULL JOIN orders_tgt b ON a.k = b.k)
    SELECT k, CASE WHEN side = 'both' THEN 'mismatch' ELSE side END AS kind,
           CASE WHEN side = 'both' THEN names ELSE '' END AS diff_columns
    FROM d WHERE side <> 'both' OR names <> ''"""


@query("cmp_data_diff", DIFF)
def _(t: Inputs):
    return compare.data_diff(t.orders_src, t.orders_tgt, ["k"], COLUMNS)


@query("cmp_data_diff_segments", DIFF)
def _(t: Inputs):
    return compare.data_diff(t.orders_src, t.orders_tgt, ["k"], COLUMNS, segments=SEGMENTS)


@query(
    "cmp_data_diff_values",
    " UNION ALL ".join(
        f"""SELECT a.k, '{c}' AS column_name, CAST(a.{c} AS VARCHAR) AS value_a, CAST(b.{c} AS VARCHAR) AS value_b
            FROM orders_src a JOIN orders_tgt b ON a.k = b.k WHERE a.{c} IS DISTINCT FROM b.{c}"""
        for c in COLUMNS
    ),
)
def _(t: Inputs):
    return compare.data_diff_values(t.orders_src, t.orders_tgt, ["k"], COLUMNS)


@query("cmp_data_diff_ignore_case", DIFF.replace("a.status IS DISTINCT FROM b.status", "lower(a.status) IS DISTINCT FROM lower(b.status)"))
def _(t: Inputs):
    return compare.data_diff(t.orders_src, t.orders_tgt, ["k"], COLUMNS, case_sensitive=False)


SUMMARY = f"""WITH x AS (SELECT * FROM ({DIFF.replace("WITH d AS", "WITH d0 AS").replace("FROM d WHERE", "FROM d0 WHERE")}) y)
        SELECT (SELECT count(*) FROM orders_src) AS rows_a, (SELECT count(*) FROM orders_tgt) AS rows_b,
        {n_if("kind = 'only_in_a'")} AS only_in_a, {n_if("kind = 'only_in_b'")} AS only_in_b,
        {n_if("kind = 'mismatch'")} AS value_mismatches, CAST(0 AS BIGINT) AS duplicates_a, CAST(0 AS BIGINT) AS duplicates_b,
        {passes("count(*) = 0")} AS status FROM x"""


@query("cmp_data_diff_summary", SUMMARY)
def _(t: Inputs):
    return compare.data_diff_summary(t.orders_src, t.orders_tgt, ["k"], COLUMNS)


@query("cmp_data_diff_summary_segments", SUMMARY)
def _(t: Inputs):
    return compare.data_diff_summary(t.orders_src, t.orders_tgt, ["k"], COLUMNS, segments=SEGMENTS)


DUPLICATES = f"""WITH a AS (SELECT l_orderkey, l_linenumber, count(*) AS n, min(l_quantity) AS q FROM lineitem GROUP BY ALL),
        b AS (SELECT l_orderkey, l_linenumber, count(*) AS n, min(l_quantity) AS q FROM lineitem WHERE l_tax < 0.08 GROUP BY ALL),
        j AS (SELECT a.n AS na, b.n AS nb, a.q AS qa, b.q AS qb FROM a FULL JOIN b USING (l_orderkey, l_linenumber))
        SELECT CAST(sum(na) AS BIGINT) AS rows_a, CAST(sum(nb) AS BIGINT) AS rows_b, {n_if("nb IS NULL")} AS only_in_a,
        {n_if("na IS NULL")} AS only_in_b, {n_if("qa <> qb")} AS value_mismatches,
        CAST(sum(na - 1) AS BIGINT) AS duplicates_a, CAST(sum(nb - 1) AS BIGINT) AS duplicates_b,
        {passes(n_if("nb IS NULL OR na IS NULL OR qa <> qb") + " = 0")} AS status FROM j"""


@query("cmp_data_diff_duplicates", DUPLICATES)
def _(t: Inputs):
    kept = t.lineitem.filter(F.col("l_tax") < 0.08)
    return compare.data_diff_summary(t.lineitem, kept, ["l_orderkey", "l_linenumber"], ["l_quantity"])


@query("cmp_data_diff_duplicates_segments", DUPLICATES)
def _(t: Inputs):
    kept = t.lineitem.filter(F.col("l_tax") < 0.08)
    return compare.data_diff_summary(t.lineitem, kept, ["l_orderkey", "l_linenumber"], ["l_quantity"], segments=SEGMENTS)


@query("keys_only_in_a", "SELECT k, status FROM orders_src EXCEPT SELECT k, status FROM orders_tgt")
def _(t: Inputs):
    return keys.keys_only_in(t.orders_src, t.orders_tgt, ["k", "status"])


@query("keys_only_in_b", "SELECT k, status FROM orders_tgt EXCEPT SELECT k, status FROM orders_src")
def _(t: Inputs):
    return keys.keys_only_in(t.orders_tgt, t.orders_src, ["k", "status"])


@query("keys_common", "SELECT k, status FROM orders_src INTERSECT SELECT k, status FROM orders_tgt")
def _(t: Inputs):
    return keys.keys_common(t.orders_src, t.orders_tgt, ["k", "status"])


# ---- a described suite -------------------------------------------------------------------------

VALIDATIONS = [
    {"name": "loaded", "check_type": "row_count", "condition": "cnt > 0", "query": "SELECT count(*) AS cnt FROM {orders}"},
    {
        "name": "unique",
        "check_type": "no_rows",
        "condition": "row_count == 0",
        "query": "SELECT order_id FROM {orders} GROUP BY order_id HAVING count(*) > 1",
    },
    {
        "name": "counts",
        "check_type": "source_reconciliation",
        "deviation_threshold": 5,
        "query": "SELECT count_source, count_target FROM {counts}",
    },
    {"name": "broken", "check_type": "row_count", "condition": "cnt > 0", "query": "SELECT gone AS cnt FROM {orders}"},
    {"name": "untested", "check_type": "row_count", "query": "SELECT 1 AS cnt"},
    {
        "name": "each_status",
        "check_type": "percentage_threshold",
        "query": "SELECT status_code, CASE WHEN status_code = 'O' THEN 'PASS' ELSE 'FAIL' END AS status FROM {orders} WHERE status_code IN ('O', 'F', 'P') GROUP BY status_code",
    },
    {"name": "no_status", "check_type": "date_window_validation", "query": "SELECT CAST(NULL AS STRING) AS status"},
    {
        "name": "own_variance",
        "check_type": "rolling_average",
        "query": "SELECT 10 AS today_cnt, 100 AS baseline_cnt, 5 AS variance_pct",
    },
    {"name": "two_days", "check_type": "rolling_average", "query": "SELECT * FROM VALUES (100, 100), (5, 100) AS t(today_cnt, baseline_cnt)"},
    {"name": "no_baseline", "check_type": "rolling_average", "condition": "today_cnt > 0", "query": "SELECT 10 AS today_cnt"},
]
COMPARISONS = [
    {
        "name": "sizes",
        "rule": "percentage_within",
        "tolerance": 5,
        "compare_column": "cnt",
        "query_a": {"query": "SELECT count(*) AS cnt FROM {source}"},
        "query_b": {"query": "SELECT count(*) AS cnt FROM {target}"},
    },
    {"name": "several", "rule": "match", "query_a": {"query": "SELECT k FROM {source}"}, "query_b": {"query": "SELECT 1 AS k"}},
    {"name": "text", "rule": "a_less_than_b", "query_a": {"query": "SELECT 'x' AS k"}, "query_b": {"query": "SELECT 1 AS k"}},
    {"name": "unknown", "rule": "guess", "query_a": {"query": "SELECT 1 AS k"}, "query_b": {"query": "SELECT 1 AS k"}},
    {
        "name": "rows",
        "rule": "data_diff",
        "key_columns": ["k"],
        "compare_columns": COLUMNS,
        "query_a": {"query": "SELECT * FROM {source}"},
        "query_b": {"query": "SELECT * FROM {target}"},
    },
]


# what a suite row says, from the plain results
SUITE = f"""SELECT 'loaded' AS name, 'row_count' AS check_type, {passes("n > 0")} AS status,
        CASE WHEN n > 0 THEN 'holds: ' ELSE 'does not hold: ' END || 'cnt > 0' AS detail, CAST(n AS VARCHAR) AS actual_value
        FROM (SELECT count(*) AS n FROM orders_q) v
    UNION ALL SELECT 'unique', 'no_rows', {passes("n = 0")}, CASE WHEN n = 0 THEN 'holds: ' ELSE 'does not hold: ' END || 'row_count == 0', CAST(n AS VARCHAR)
        FROM (SELECT count(*) AS n FROM (SELECT order_id FROM orders_q GROUP BY order_id HAVING count(*) > 1) g) v
    UNION ALL SELECT 'counts', 'source_reconciliation', {passes("bad = 0")}, bad || ' of ' || n || ' rows deviate', CAST(bad AS VARCHAR)
        FROM (SELECT {n_if("abs(count_source - count_target) >= 5")} AS bad, count(*) AS n FROM recon_counts) v
    UNION ALL SELECT 'broken', 'row_count', 'NOT_EXECUTED', 'UNRESOLVED_COLUMN.WITH_SUGGESTION', NULL
    UNION ALL SELECT 'untested', 'row_count', 'NOT_EXECUTED', 'condition is missing', NULL
    UNION ALL SELECT 'each_status', 'percentage_threshold', {passes("bad = 0")}, bad || ' of ' || n || ' rows not in order', CASE WHEN bad > 0 THEN 'FAIL' ELSE 'PASS' END
        FROM (SELECT {n_if("status_code <> 'O'")} AS bad, count(*) AS n
              FROM (SELECT DISTINCT status_code FROM orders_q WHERE status_code IN ('O', 'F', 'P')) d) v
    UNION ALL SELECT 'no_status', 'date_window_validation', 'FAIL', '1 of 1 rows not in order', 'NULL'
    UNION ALL SELECT 'own_variance', 'rolling_average', 'PASS', '0 of 1 rows not in order', '5.0'
    UNION ALL SELECT 'two_days', 'rolling_average', 'FAIL', '1 of 2 rows not in order', '95.0'
    UNION ALL SELECT 'no_baseline', 'rolling_average', 'PASS', 'holds: today_cnt > 0', '10'
    UNION ALL SELECT 'sizes', 'comparison:percentage_within', {passes("abs(a - b) / greatest(a, b) * 100 <= 5")}, '', 'a=' || a || ' b=' || b
        FROM (SELECT CAST({A} AS DOUBLE) AS a, CAST({B} AS DOUBLE) AS b) v
    UNION ALL SELECT 'several', 'comparison:match', 'NOT_EXECUTED', 'a side has several rows', 'a=NULL b=1.0'
    UNION ALL SELECT 'text', 'comparison:a_less_than_b', 'NOT_EXECUTED', 'no numeric column to compare', NULL
    UNION ALL SELECT 'unknown', 'comparison:guess', 'NOT_EXECUTED', 'unknown comparison rule guess', NULL
    UNION ALL SELECT 'rows', 'comparison:data_diff', {passes("count(*) = 0")},
        'rows_a=' || {A} || ',rows_b=' || {B} || ',duplicates_a=0,duplicates_b=0',
        'only_in_a=' || {n_if("kind = 'only_in_a'")} || ',only_in_b=' || {n_if("kind = 'only_in_b'")} || ',value_mismatches=' || {n_if("kind = 'mismatch'")}
        FROM ({DIFF.replace("WITH d AS", "WITH d1 AS").replace("FROM d WHERE", "FROM d1 WHERE")}) y"""


def suite_names(t: Inputs) -> dict[str, str]:
    views = {"orders": t.orders_q, "counts": t.recon_counts, "source": t.orders_src, "target": t.orders_tgt}
    for name, df in views.items():
        df.createOrReplaceTempView(f"lakecheck_suite_{name}")
    return {name: f"lakecheck_suite_{name}" for name in views}


@query("suite_statuses", SUITE)
def _(t: Inputs):
    return suite.run_suite(t.spark, VALIDATIONS, COMPARISONS, suite_names(t))


ROLLED = {"own_variance": ("10", "100.0", "5.0"), "two_days": ("100", "100.0", "95.0")}


def rolled(i: int) -> str:
    return "CASE name " + " ".join(f"WHEN '{n}' THEN '{v[i]}'" for n, v in ROLLED.items()) + " END"


AUDIT_ROWS = f"""WITH rows AS ({SUITE})
    SELECT 'run1' AS run_id, '{EVENTS_NOW.isoformat()}' AS event_timestamp,
        'BASE_' || CASE WHEN check_type LIKE 'comparison:%' THEN 'COMPARISON' ELSE 'VALIDATION' END AS event_type,
        {", ".join(f"CAST(NULL AS VARCHAR) AS {c}" for c in ("source_label", "source_bucket", "source_prefix", "subfolder_count", "glue_job_name", "glue_job_run_id", "glue_duration_sec", "cost_usd", "window_start", "window_end"))},
        status, NULLIF(detail, '') AS detail, name AS validation_name, check_type, actual_value,
        CASE WHEN status IN ('FAIL', 'NOT_EXECUTED') THEN NULLIF(detail, '') END AS failure_reason,
        {rolled(0)} AS today_count, {rolled(1)} AS baseline_count, {rolled(2)} AS variance_pct,
        CASE WHEN name = 'sizes' THEN '5' END AS tolerance,
        CASE WHEN bool_or(status = 'FAIL') OVER () THEN 'FAIL' ELSE 'PASS' END AS overall_status, '{EVENTS_NOW.date()}' AS run_date
    FROM rows"""


@query("audit_suite_events", AUDIT_ROWS)
def _(t: Inputs):
    shapes = suite.suite_events(t.spark, VALIDATIONS, COMPARISONS, suite_names(t))
    rows = audit.audit_rows(shapes, "run1", EVENTS_NOW, "BASE")
    # through the audit files and back; the text of the queries is left out of the comparison
    root = scratch_folder(t.spark, "events")
    writers.write_audit(rows, root)
    read = audit_files.read_audit(t.spark, root).select(*audit.AUDIT_COLUMNS)
    return read.withColumn("detail", F.nullif("detail", F.lit(""))).withColumn("failure_reason", F.nullif("failure_reason", F.lit(""))).drop("query")
