"""Table rules."""

from __future__ import annotations

from lakecheck.operators import rules
from lakecheck.operators.rules import Rule
from lakecheck.plans.inputs import EVENTS_NOW, Inputs
from lakecheck.plans.registry import n_if, query

RULES = [
    Rule("order_has_customer", "NOT_NULL", "orders_q", "customer_id", severity="HIGH", constraint="customer present"),
    Rule("balance_range", "RANGE", "customer", "c_acctbal", min_value=0, max_value=9000),
    Rule("status_code", "REGEX", "orders_q", "status_code", pattern="^[FOP]$"),
    Rule("line_unique", "UNIQUENESS", "lineitem", ("l_orderkey", "l_linenumber"), severity="CRITICAL"),
    Rule("order_unique", "UNIQUENESS", "orders_q", "order_id"),
    Rule("customer_known", "REFERENTIAL", "orders_q", "fk_customer", ref_table="customer", ref_column="c_custkey"),
    Rule("enough_orders", "ROW_COUNT", "orders_q", operator=">=", threshold=1),
    Rule("too_few_orders", "ROW_COUNT", "orders_q", operator=">=", threshold=10**15),
    Rule("deep_discount", "BUSINESS", "lineitem", "l_linenumber", condition="l_quantity > 45 AND l_discount >= 0.09"),
    Rule("broken", "NOT_NULL", "orders_q", "no_such_column"),
]

# failed count, sample and total of each rule as plain SQL
COUNTS = {
    "order_has_customer": f"SELECT {n_if('customer_id IS NULL')} AS failed, CAST(NULL AS VARCHAR) AS sample, count(*) AS total FROM orders_q",
    "balance_range": f"""SELECT {n_if("c_acctbal NOT BETWEEN 0 AND 9000")} AS failed,
        CAST(min(c_acctbal) FILTER (WHERE c_acctbal NOT BETWEEN 0 AND 9000) AS VARCHAR) AS sample, count(*) AS total FROM customer""",
    "status_code": f"""SELECT {n_if("NOT regexp_matches(status_code, '^[FOP]$')")} AS failed,
        min(status_code) FILTER (WHERE NOT regexp_matches(status_code, '^[FOP]$')) AS sample, count(*) AS total FROM orders_q""",
    "line_unique": """SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS failed, min(v) FILTER (WHERE n > 1) AS sample,
        CAST(sum(n) AS BIGINT) AS total
        FROM (SELECT CAST(l_orderkey AS VARCHAR) || '^' || CAST(l_linenumber AS VARCHAR) AS v, count(*) AS n FROM lineitem GROUP BY 1)""",
    "order_unique": """SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS failed, CAST(min(v) FILTER (WHERE n > 1) AS VARCHAR) AS sample,
        CAST(sum(n) AS BIGINT) AS total FROM (SELECT order_id AS v, count(*) AS n FROM orders_q GROUP BY 1)""",
    "customer_known": f"""SELECT {n_if("fk_customer IS NOT NULL AND c_custkey IS NULL")} AS failed,
        CAST(min(fk_customer) FILTER (WHERE c_custkey IS NULL) AS VARCHAR) AS sample, count(*) AS total
        FROM orders_q LEFT JOIN customer ON fk_customer = c_custkey""",
    "enough_orders": "SELECT CAST(0 AS BIGINT) AS failed, CAST(NULL AS VARCHAR) AS sample, count(*) AS total FROM orders_q",
    "too_few_orders": "SELECT count(*) AS failed, CAST(NULL AS VARCHAR) AS sample, count(*) AS total FROM orders_q",
    "deep_discount": f"""SELECT {n_if("l_quantity > 45 AND l_discount >= 0.09")} AS failed,
        CAST(min(l_linenumber) FILTER (WHERE l_quantity > 45 AND l_discount >= 0.09) AS VARCHAR) AS sample, count(*) AS total FROM lineitem""",
}


def frames(t: Inputs):
    return {"orders_q": t.orders_q, "customer": t.customer, "lineitem": t.lineitem}


def evaluated(t: Inputs, *names: str):
    wanted = [r for r in RULES if not names or r.rule_name in names]
    return rules.evaluate_rules(frames(t), wanted, "run1", EVENTS_NOW, "nightly")


def _short(*names: str) -> str:
    parts = [
        f"""SELECT '{n}' AS rule_name, sample AS failed_value, failed AS row_count_failed, total AS total_row_count,
            CASE WHEN failed = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM ({COUNTS[n]}) x"""
        for n in names
    ]
    return " UNION ALL ".join(parts)


SHORT = ["rule_name", "failed_value", "row_count_failed", "total_row_count", "status"]


def _single(key: str, *names: str):
    query(key, _short(*names))(lambda t: evaluated(t, *names).select(*SHORT))


_single("rule_not_null", "order_has_customer")
_single("rule_range", "balance_range")
_single("rule_regex", "status_code")
_single("rule_uniqueness", "line_unique", "order_unique")
_single("rule_referential", "customer_known")
_single("rule_row_count", "enough_orders", "too_few_orders")
_single("rule_business", "deep_discount")


def _full() -> str:
    parts = []
    for i, r in enumerate(RULES):
        counts = COUNTS.get(r.rule_name, "SELECT CAST(0 AS BIGINT) AS failed, CAST(NULL AS VARCHAR) AS sample, CAST(0 AS BIGINT) AS total")
        error = "'UNRESOLVED_COLUMN.WITH_SUGGESTION'" if r.rule_name == "broken" else "CAST(NULL AS VARCHAR)"
        status = "'ERROR'" if r.rule_name == "broken" else "CASE WHEN failed = 0 THEN 'PASS' ELSE 'FAIL' END"
        parts.append(f"""SELECT md5('run1^{i}^{r.rule_name}') AS record_id, 'run1' AS run_id, 'nightly' AS pipeline_name,
            '' AS database_name, '{r.table}' AS table_name, '{",".join(r.columns)}' AS column_name, '{r.rule_name}' AS rule_name,
            '{r.rule_type}' AS rule_type, '{r.severity}' AS severity, '{r.constraint}' AS expected_constraint,
            sample AS failed_value, failed AS row_count_failed, total AS total_row_count, {status} AS status,
            {error} AS error_message, TIMESTAMP '{EVENTS_NOW}' AS failure_timestamp FROM ({counts}) x""")
    return " UNION ALL ".join(parts)


query("rule_audit_rows", _full())(evaluated)

query(
    "rule_run_summary",
    f"""SELECT count(*) AS total, {n_if("status = 'PASS'")} AS passed, {n_if("status = 'FAIL'")} AS failed,
        {n_if("status = 'ERROR'")} AS errors, 2 AS exit_code FROM ({_full()}) a""",
)(lambda t: rules.run_summary(evaluated(t)))

query(
    "sample_failing_value",
    f"SELECT rule_name, failed_value FROM ({_short('balance_range', 'status_code', 'deep_discount', 'customer_known')}) s",
)(
    lambda t: evaluated(t, "balance_range", "status_code", "deep_discount", "customer_known").select(
        "rule_name", "failed_value"
    )
)

KEY_RULES = [
    Rule("line_unique", "UNIQUENESS", "lineitem", ("l_orderkey", "l_linenumber"), severity="CRITICAL"),
    Rule("order_unique", "UNIQUENESS", "orders_q", "order_id"),
    Rule("customer_once", "UNIQUENESS", "orders_q", "fk_customer"),
    Rule("status_once", "UNIQUENESS", "orders_q", ("customer_id", "status_code")),
    Rule("text_once", "UNIQUENESS", "orders_q", "eff_d"),
    Rule("customer_known", "REFERENTIAL", "orders_q", "fk_customer", ref_table="customer", ref_column="c_custkey"),
    Rule("order_known", "REFERENTIAL", "lineitem", "l_orderkey", ref_table="orders_q", ref_column="order_id"),
    Rule("buyer_known", "REFERENTIAL", "customer", "c_custkey", ref_table="orders_q", ref_column="customer_id"),
    Rule("quantity_is_a_line", "REFERENTIAL", "lineitem", "l_quantity", ref_table="lineitem", ref_column="l_linenumber"),
    Rule("status_code", "REGEX", "orders_q", "status_code", pattern="^[FOP]$"),
    Rule("deep_discount", "BUSINESS", "lineitem", "l_linenumber", condition="l_quantity > 45 AND l_discount >= 0.09"),
    Rule("balance_range", "RANGE", "customer", "c_acctbal", min_value=0, max_value=9000),
    Rule("enough_orders", "ROW_COUNT", "orders_q", operator=">=", threshold=1),
]


def _repeated(table: str, *columns: str) -> str:
    value = columns[0] if len(columns) == 1 else "concat_ws('^', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')" for c in columns) + ")"
    return f"""SELECT CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS failed, CAST(min({value}) FILTER (WHERE n > 1) AS VARCHAR) AS sample,
        CAST(sum(n) AS BIGINT) AS total FROM (SELECT {", ".join(columns)}, count(*) AS n FROM {table} GROUP BY ALL) g"""


def _orphans(table: str, column: str, ref: str, ref_column: str) -> str:
    orphan = f"v IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {ref} r WHERE r.{ref_column} = v)"
    return f"""SELECT {n_if("orphan")} AS failed, CAST(min(v) FILTER (WHERE orphan) AS VARCHAR) AS sample, count(*) AS total
        FROM (SELECT v, {orphan} AS orphan FROM (SELECT {column} AS v FROM {table}) x) y"""


COUNTS |= {
    "customer_once": _repeated("orders_q", "fk_customer"),
    "status_once": _repeated("orders_q", "customer_id", "status_code"),
    "text_once": _repeated("orders_q", "eff_d"),
    "order_known": _orphans("lineitem", "l_orderkey", "orders_q", "order_id"),
    "buyer_known": _orphans("customer", "c_custkey", "orders_q", "customer_id"),
    "quantity_is_a_line": _orphans("lineitem", "l_quantity", "lineitem", "l_linenumber"),
}


@query("rule_keys_one_pass", _short(*(r.rule_name for r in KEY_RULES)))
def _(t: Inputs):
    return rules.evaluate_rules(frames(t), KEY_RULES, "run1", EVENTS_NOW).select(*SHORT)


BREAKING = [
    Rule("text_range", "RANGE", "orders_q", "status_code", min_value=0, max_value=5),
    Rule("bad_pattern", "REGEX", "orders_q", "status_code", pattern="[F"),
    Rule("bad_cast", "BUSINESS", "orders_q", condition="CAST(status_code AS INT) > 0"),
    Rule("no_column", "NOT_NULL", "orders_q", "gone"),
    Rule("no_key", "UNIQUENESS", "orders_q"),
    Rule("no_reference", "REFERENTIAL", "orders_q", "fk_customer", ref_table="gone", ref_column="x"),
    Rule("sound", "NOT_NULL", "orders_q", "customer_id"),
    Rule("other_database", "NOT_NULL", "orders_q", "c_custkey", database="archive"),
    Rule("across_databases", "REFERENTIAL", "orders_q", "fk_customer", ref_table="orders_q", ref_column="c_custkey", ref_database="archive"),
    Rule("no_date", "RANGE", "orders_q", "load_ts", min_value="abc", max_value="2025-01-01"),
    Rule("no_number", "RANGE", "orders_q", "order_id", min_value="1", max_value="many"),
    Rule("date_limits", "RANGE", "orders_q", "load_ts", min_value="1995-01-01", max_value="1998-06-30"),
    Rule("number_limits", "RANGE", "orders_q", "order_id", min_value="10", max_value="2500.5"),
]


def _broken(name: str, message: str) -> str:
    return f"SELECT '{name}' AS rule_name, 'ERROR' AS status, CAST(0 AS BIGINT) AS failed, CAST(0 AS BIGINT) AS total, '{message}' AS error_message"


def _counted(name: str, bad: str, source: str) -> str:
    return f"""SELECT '{name}' AS rule_name, CASE WHEN failed = 0 THEN 'PASS' ELSE 'FAIL' END AS status, failed, total, CAST(NULL AS VARCHAR) AS error_message
        FROM (SELECT {n_if(bad)} AS failed, count(*) AS total FROM {source}) v"""


@query(
    "rule_runtime_errors",
    " UNION ALL ".join(
        [
            _counted("text_range", "status_code IS NOT NULL AND coalesce(TRY_CAST(status_code AS DOUBLE) NOT BETWEEN 0 AND 5, true)", "orders_q"),
            _broken("bad_pattern", "INVALID_PARAMETER_VALUE.PATTERN"),
            _broken("bad_cast", "CAST_INVALID_INPUT"),
            _broken("no_column", "UNRESOLVED_COLUMN.WITH_SUGGESTION"),
            _broken("no_key", "column is missing"),
            _broken("no_reference", "table gone not found"),
            _counted("sound", "customer_id IS NULL", "orders_q"),
            _counted("other_database", "c_custkey IS NULL", "customer"),
            _counted("across_databases", "fk_customer IS NOT NULL AND c_custkey IS NULL", "orders_q LEFT JOIN customer ON fk_customer = c_custkey"),
            _broken("no_date", "CAST_INVALID_INPUT"),
            _broken("no_number", "CAST_INVALID_INPUT"),
            _counted("date_limits", "load_ts NOT BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1998-06-30'", "orders_q"),
            _counted("number_limits", "order_id NOT BETWEEN 10 AND 2500.5", "orders_q"),
        ]
    ),
)
def _(t: Inputs):
    # two databases with one table name
    known = {"orders_q": t.orders_q, "archive.orders_q": t.customer}
    rows = rules.evaluate_rules_isolated(known, BREAKING, "run1", EVENTS_NOW)
    return rows.selectExpr("rule_name", "status", "row_count_failed AS failed", "total_row_count AS total", "error_message")
