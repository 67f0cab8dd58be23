from lakecheck.operators import (
    audit,
    checks,
    compare,
    freshness,
    jobs,
    keys,
    mart,
    members,
    movement,
    outcomes,
    partials,
    policies,
    rolling,
    rules,
    suite,
    topn,
)

__all__ = [
    "audit",
    "checks",
    "compare",
    "freshness",
    "jobs",
    "keys",
    "mart",
    "members",
    "movement",
    "outcomes",
    "partials",
    "policies",
    "rolling",
    "rules",
    "suite",
    "topn",
]
