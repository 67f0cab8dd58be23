from lakecheck.plans import (
    audit_queries,
    check_queries,
    compare_queries,
    job_queries,
    mart_queries,
    movement_queries,
    rolling_queries,
    rule_queries,
    sink_queries,
    source_queries,
)
from lakecheck.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
