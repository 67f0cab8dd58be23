"""Top groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def top_groups(df: DataFrame, group: str, value: str, n: int) -> DataFrame:
    """Rows of the ``n`` groups with the largest total; ties by name. Only ``n`` keys are broadcast."""
    totals = df.groupBy(group).agg(F.sum(value).alias("_total"))
    top = totals.orderBy(F.desc("_total"), group).limit(n).select(group)
    return df.join(F.broadcast(top), group, "left_semi")


def top_with_others(df: DataFrame, label: str, value: str, n: int, others: str = "Others") -> DataFrame:
    """Totals of the ``n`` largest labels and, where anything is left, one row for the rest."""
    totals = df.groupBy(label).agg(F.sum(value).alias("total"))
    top = totals.orderBy(F.desc("total"), label).limit(n)
    rest = (
        totals.join(F.broadcast(top.select(label)), label, "left_anti")
        .agg(F.sum("total").alias("total"))
        .filter(F.col("total") > 0)
        .select(F.lit(others).alias(label), "total")
    )
    return top.unionByName(rest)
