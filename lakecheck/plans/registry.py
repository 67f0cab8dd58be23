"""Named queries, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakecheck.plans.inputs import Inputs, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register ``build(inputs)`` under a name; ``sql`` is its plain equivalent on the same tables."""

    def add(build: Callable[[Inputs], DataFrame]) -> Callable:
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = lambda spark, sf_dir: build(Inputs(spark, sf_dir))
        if sql:
            ORACLES[name] = with_views(sql)
        return build

    return add


# ---- pieces of the equivalent SQL --------------------------------------------------------------


def n_if(condition: str) -> str:
    return f"count(*) FILTER (WHERE {condition})"


def pct(part: str, whole: str, digits: int = 1) -> str:
    return f"round(CAST({part} AS DOUBLE) * 100 / NULLIF({whole}, 0), {digits})"


def passes(condition: str, otherwise: str = "FAIL") -> str:
    return f"CASE WHEN {condition} THEN 'PASS' ELSE '{otherwise}' END"


def mean(total: str, count: str, scale: int, digits: int) -> str:
    """Exact half-up mean of a decimal sum that is not negative: whole-number arithmetic, one last division."""
    units = f"CAST({total} * {10**scale} AS HUGEINT)"
    step = 10 ** (scale - digits) if scale >= digits else 1
    units = units if scale >= digits else f"{units} * {10 ** (digits - scale)}"
    return f"CAST((2 * {units} + {step} * {count}) // NULLIF(2 * {step} * {count}, 0) AS DOUBLE) / {10**digits}"
