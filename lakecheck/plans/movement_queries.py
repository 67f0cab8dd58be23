"""Movement analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakecheck.operators import audit, movement
from lakecheck.plans.inputs import Inputs
from lakecheck.plans.registry import n_if, passes, pct, query

LATEST = "(SELECT max(load_date) FROM movements)"


def latest_of(category: str) -> str:
    return f"""SELECT count(*) AS value FROM movements WHERE movement_category = '{category}'
        AND load_date = (SELECT max(load_date) FROM movements WHERE movement_category = '{category}')"""


query("kpi_total_inforce", latest_of("INFORCE"))(lambda t: movement.count_at_latest(t.movements, "INFORCE"))
query("kpi_adds_current", latest_of("ADD"))(lambda t: movement.count_at_latest(t.movements, "ADD"))
query("kpi_deducts_current", latest_of("DEDUCT"))(lambda t: movement.count_at_latest(t.movements, "DEDUCT"))

ADDS, DEDUCTS, INFORCE = (n_if(f"movement_category = '{c}'") for c in ("ADD", "DEDUCT", "INFORCE"))

query("kpi_net_gain_current", f"SELECT {ADDS} - {DEDUCTS} AS value FROM movements WHERE load_date = {LATEST}")(
    lambda t: movement.net_gain_at_latest(t.movements)
)
query(
    "kpi_inforce_by_product",
    """SELECT product_type, count(*) AS value FROM movements WHERE movement_category = 'INFORCE'
       AND load_date = (SELECT max(load_date) FROM movements WHERE movement_category = 'INFORCE') GROUP BY 1""",
)(lambda t: movement.inforce_by_product(t.movements))
query(
    "kpi_retention_rate",
    f"""SELECT round((1 - CAST({DEDUCTS} AS DOUBLE) / NULLIF({INFORCE}, 0)) * 100, 2) AS value
        FROM movements WHERE load_date = {LATEST}""",
)(lambda t: movement.retention_rate(t.movements))

query(
    "trend_inforce_by_product",
    """SELECT load_date, product_type, count(*) AS member_count FROM movements WHERE movement_category = 'INFORCE' GROUP BY ALL""",
)(lambda t: movement.trend_inforce_by_product(t.movements))
query(
    "trend_add_vs_deduct",
    f"""SELECT load_date, {ADDS} AS add_cnt, {DEDUCTS} AS deduct_cnt FROM movements
        WHERE movement_category IN ('ADD', 'DEDUCT') GROUP BY 1""",
)(lambda t: movement.trend_add_deduct(t.movements))
query("trend_net_gain", f"SELECT load_date, {ADDS} - {DEDUCTS} AS net_gain FROM movements GROUP BY 1")(
    lambda t: movement.trend_net_gain(t.movements)
)
query(
    "trend_top10_clubs",
    """WITH top AS (SELECT club_code FROM movements WHERE movement_category = 'INFORCE' GROUP BY 1 ORDER BY count(*) DESC, club_code LIMIT 10)
       SELECT club_code, load_date, count(*) AS member_count FROM movements
       WHERE movement_category = 'INFORCE' AND club_code IN (SELECT club_code FROM top) GROUP BY ALL""",
)(lambda t: movement.trend_top_clubs(t.movements))

query(
    "mv_net_gain_balance",
    f"""WITH n AS (SELECT club_code, product_type, load_date, {INFORCE} AS inforce, {ADDS} - {DEDUCTS} AS net_movement
                   FROM movements GROUP BY ALL),
        c AS (SELECT *, inforce - lag(inforce) OVER (PARTITION BY club_code, product_type ORDER BY load_date) AS inforce_change FROM n)
        SELECT club_code, product_type, load_date, inforce, inforce_change, net_movement,
               CASE WHEN inforce_change IS NULL OR inforce_change = net_movement THEN 'Y' ELSE 'N' END AS balanced FROM c""",
)(lambda t: movement.net_gain_balance(t.movements))
query(
    "mv_interstate_balance",
    f"""SELECT load_date, {ADDS} AS add_transfers, {DEDUCTS} AS deduct_transfers,
        CASE WHEN {ADDS} = {DEDUCTS} THEN 'Y' ELSE 'N' END AS interstate_transfer_balance
        FROM movements WHERE movement_subcategory = 'TRANSFER' GROUP BY 1""",
)(lambda t: movement.interstate_balance(t.movements))
query(
    "mv_summary",
    """SELECT movement_category, movement_subcategory, count(*) AS cnt FROM movements WHERE product_type = 'CLASSIC' GROUP BY ALL""",
)(lambda t: movement.summary(t.movements, "CLASSIC"))

EXPECTED = [(c, s) for c in ("ADD", "DEDUCT") for s in ("NEW", "ARREARS", "CANCEL", "TRANSFER", "REINSTATE")]
query(
    "mv_subcategory_completeness",
    f"""WITH e AS (SELECT * FROM (VALUES {", ".join(f"('{c}', '{s}')" for c, s in EXPECTED)}) v(movement_category, movement_subcategory)),
        d AS (SELECT DISTINCT load_date FROM movements)
        SELECT load_date, movement_category, movement_subcategory FROM d CROSS JOIN e
        EXCEPT SELECT load_date, movement_category, movement_subcategory FROM movements""",
)(lambda t: movement.missing_subcategories(t.movements, EXPECTED))
query(
    "mv_count_range",
    f"""SELECT load_date, count(*) AS cnt, {passes("count(*) BETWEEN 55 AND 75")} AS status FROM movements
        WHERE movement_category = 'ADD' GROUP BY 1""",
)(lambda t: movement.count_range(t.movements, "ADD", 55, 75))


def deviation(category: str, by: str) -> str:
    return f"""WITH c AS (SELECT {by}, load_date, count(*) AS cnt FROM movements WHERE movement_category = '{category}' GROUP BY ALL),
        s AS (SELECT {by}, max(load_date) AS load_date, arg_max(cnt, load_date) AS latest_cnt, round(avg(cnt), 4) AS mean_cnt,
                     round(stddev_samp(cnt), 4) AS stddev_cnt FROM c GROUP BY {by})
        SELECT *, CASE WHEN abs(latest_cnt - mean_cnt) > 2 * stddev_cnt THEN 'Y' ELSE 'N' END AS outlier FROM s"""


query("mv_statewise_stddev", deviation("ADD", "club_code"))(lambda t: movement.club_deviation(t.movements, "ADD"))

BY_SUB = ("club_code", "movement_subcategory")
query(
    "mv_statewise_sub_stddev",
    " UNION ALL ".join(
        f"SELECT '{c}' AS movement_category, * FROM ({deviation(c, ', '.join(BY_SUB))}) s{i}" for i, c in enumerate(("ADD", "DEDUCT"))
    ),
)(
    lambda t: movement.club_deviation(t.movements, "ADD", BY_SUB)
    .withColumn("movement_category", F.lit("ADD"))
    .unionByName(movement.club_deviation(t.movements, "DEDUCT", BY_SUB).withColumn("movement_category", F.lit("DEDUCT")))
)
query(
    "mv_inactive_reason",
    f"""SELECT load_date, count(*) AS inactive_rows, {n_if("inactive_reason IS NULL")} AS missing_reason,
        {passes(n_if("inactive_reason IS NULL") + " = 0")} AS status FROM movements WHERE movement_category = 'DEDUCT' GROUP BY 1""",
)(lambda t: movement.inactive_reason(t.movements))

FOUR = [("ADD", "NEW"), ("ADD", "ARREARS"), ("DEDUCT", "CANCEL"), ("DEDUCT", "ARREARS")]


def seasonal(pairs: list[tuple[str, str]], extra: str = "") -> str:
    wanted = " OR ".join(f"(movement_category = '{c}' AND movement_subcategory = '{s}')" for c, s in pairs)
    groups = f"movement_category, movement_subcategory{extra}"
    return f"""WITH c AS (SELECT load_date, {groups}, count(*) AS cnt FROM movements WHERE {wanted} GROUP BY ALL),
        p AS (SELECT *, CAST(dayofweek(load_date) + 1 AS INTEGER) AS position FROM c),
        s AS (SELECT *, round(avg(cnt) OVER w, 4) AS mean_cnt, round(stddev_samp(cnt) OVER w, 4) AS stddev_cnt FROM p
              WINDOW w AS (PARTITION BY {groups}, position))
        SELECT *, CASE WHEN abs(cnt - mean_cnt) > 2 * stddev_cnt THEN 'Y' ELSE 'N' END AS outlier FROM s"""


query("mv_seasonality", seasonal(FOUR))(lambda t: movement.seasonality(t.movements, FOUR, F.dayofweek("load_date")))
query("mv_statewise_decay", seasonal(FOUR[:2], ", club_code"))(
    lambda t: movement.seasonality(t.movements, FOUR[:2], F.dayofweek("load_date"), ("club_code",))
)


def categorised(t: Inputs):
    kinds = {"row_count": "balance", "no_rows": "completeness", "threshold": "anomaly", "rolling_average": "statistical"}
    label = F.lit("other")
    for kind, category in kinds.items():
        label = F.when(F.col("check_type") == kind, category).otherwise(label)
    return t.audit.select(label.alias("category"), "status")


@query(
    "checks_by_category",
    f"""WITH r AS (SELECT CASE check_type WHEN 'row_count' THEN 'balance' WHEN 'no_rows' THEN 'completeness'
        WHEN 'threshold' THEN 'anomaly' WHEN 'rolling_average' THEN 'statistical' ELSE 'other' END AS category, status FROM audit)
        SELECT category, {n_if("status = 'PASS'")} AS passed, {n_if("status = 'FAIL'")} AS failed, {n_if("status = 'WARN'")} AS warned,
        {n_if("status = 'INFO'")} AS info, {n_if("status = 'ERROR'")} AS errors,
        coalesce({pct(n_if("status = 'PASS'"), n_if("status IN ('PASS', 'FAIL', 'WARN')"))}, 0) AS pass_rate,
        CASE category WHEN 'balance' THEN 0 WHEN 'anomaly' THEN 1 ELSE 99 END AS category_order FROM r GROUP BY category""",
)
def _(t: Inputs):
    return audit.checks_by_category(categorised(t))
