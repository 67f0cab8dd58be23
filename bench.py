"""Times the headline queries and prints one JSON line.

Reads ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on ``local[$BENCH_CPUS]``. Every query runs to the
end into a sink that drops the rows. Each is run twice, and the second time counts: the first one loads
classes and compiles code.
"""

from __future__ import annotations

import json
import os
import time
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from lakecheck import build_session
from lakecheck.operators import rules
from lakecheck.operators.rules import Rule
from lakecheck.plans import QUERIES
from lakecheck.plans.inputs import Inputs

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "customer_order_summary",
    "agg_customer_metrics",
    "join_products_left",
    "dedup_latest",
    "delete_reappear",
    "recon_missing_in_target",
    "cmp_data_diff",
    "cmp_data_diff_summary",
    "merge_upsert",
    "rule_audit_rows",
    "rule_uniqueness",
    "rule_referential",
    "check_one_pass",
    "check_volume_60d",
    "check_date_window",
    "rolling_avg_10d_status",
    "rolling_zscore_30d",
    "fail_similar_outcomes",
    "jobs_health_score",
    "sum_statewise_transactions",
    "sink_optimize",
    "src_csv_landing",
    "sum_statewise_members",
    "topk_failing_checks",
    "join_top_category_back",
    "rule_keys_one_pass",
    "cmp_data_diff_segments",
    "merge_by_file",
]
DASHBOARD = [
    "audit_by_layer",
    "audit_by_run",
    "audit_by_run_layer",
    "audit_day_totals",
    "dash_daily_validation_7d",
    "dash_daily_pass_rate_30d",
    "dash_pass_rate_by_layer",
    "dash_quality_dimensions",
    "dash_cost_trend_30d",
    "topk_failing_checks",
    "dq_scorecard",
    "dq_by_dimension",
    "dq_sla_trend",
]
RULES = [
    Rule(f"{c}_{kind.lower()}", kind, "lineitem", c, min_value=0, max_value=40)
    for c in ("l_quantity", "l_discount", "l_tax", "l_extendedprice", "l_linenumber")
    for kind in ("NOT_NULL", "RANGE")
] + [
    Rule(f"business_{i}", "BUSINESS", "lineitem", "l_linenumber", condition=f"l_quantity > {40 + i} and l_discount > 0.05")
    for i in range(10)
]


def drain(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def twenty_rules(spark: SparkSession, one_pass: bool) -> None:
    frames = {"lineitem": Inputs(spark, SF_DIR).lineitem}
    for batch in [RULES] if one_pass else [[r] for r in RULES]:
        drain(rules.evaluate_rules(frames, batch, "bench", datetime(2024, 1, 1)))


def timed(run) -> float:
    run()
    start = time.perf_counter()
    run()
    return round(time.perf_counter() - start, 3)


def main() -> None:
    spark = build_session(
        "lakecheck-bench",
        f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": CPUS,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
            "spark.log.level": "ERROR",
            # no call-site capture per column expression while plans are built
            "spark.python.sql.dataFrameDebugging.enabled": "false",
        },
    )
    for _ in range(3):  # the session itself is cold at first
        drain(QUERIES[HEADLINE[0]](spark, SF_DIR))
    seconds = {name: timed(lambda name=name: drain(QUERIES[name](spark, SF_DIR))) for name in HEADLINE}
    seconds["twenty_rules_one_pass"] = timed(lambda: twenty_rules(spark, True))
    seconds["twenty_rules_twenty_passes"] = timed(lambda: twenty_rules(spark, False))
    seconds["audit_dashboard"] = timed(lambda: [drain(QUERIES[name](spark, SF_DIR)) for name in DASHBOARD])
    counted = {k: v for k, v in seconds.items() if k != "twenty_rules_twenty_passes"}
    print(
        json.dumps(
            {
                "metric": "total wall time of the headline queries",
                "value": round(sum(counted.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
