"""Landing freshness from a file listing.

A listing has one row per file: source, subfolder (NULL for a file right under the source), modified.
Everything is reduced to one row per subfolder, then to one row per source.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakecheck.functions.exprs import hours_between, instant


def subfolder_ages(listing: DataFrame, as_of: datetime) -> DataFrame:
    """Newest file per source and subfolder, with its age in hours."""
    newest = listing.groupBy("source", "subfolder").agg(
        F.max("modified").alias("latest_modified"), F.count(F.lit(1)).alias("files")
    )
    age = hours_between(F.col("latest_modified").cast("timestamp_ntz"), instant(as_of))
    return newest.withColumn("age_hours", age)


def _per_source(listing: DataFrame, sources: DataFrame | None, as_of: datetime, limit_hours: float) -> DataFrame:
    inside = F.col("subfolder").isNotNull()
    per_source = (
        subfolder_ages(listing, as_of)
        .groupBy("source")
        .agg(
            F.count_if(inside).alias("subfolder_count"),
            F.count_if(inside & (F.col("age_hours") > limit_hours)).alias("stale_subfolders"),
            F.min("age_hours").alias("newest_age_hours"),
        )
    )
    if sources is None:
        return per_source
    # a configured source without files has no listing row
    return sources.select("source").join(per_source, "source", "left").fillna(0, ["subfolder_count", "stale_subfolders"])


def source_status(
    listing: DataFrame,
    as_of: datetime,
    sources: DataFrame | None = None,
    max_subfolders: int = 3,
    subfolder_hours: float = 3,
    no_subfolder_hours: float = 5,
) -> DataFrame:
    """OK, Stale, or Check with Source."""
    per_source = _per_source(listing, sources, as_of, subfolder_hours)
    n, age = F.col("subfolder_count"), F.col("newest_age_hours")
    status = (
        F.when(n > max_subfolders, "Stale")
        .when(F.col("stale_subfolders") > 0, "Stale")
        .when((n == 0) & (age.isNull() | (age > no_subfolder_hours)), "Check with Source")
        .otherwise("OK")
    )
    # over the folder limit, all subfolders are due
    stale = F.when(n > max_subfolders, n).otherwise(F.col("stale_subfolders"))
    return per_source.select("source", n, stale.alias("stale_subfolders"), _shown(age), status.alias("status"))


def folder_summary(
    listing: DataFrame,
    as_of: datetime,
    sources: DataFrame | None = None,
    max_subfolders: int = 3,
    max_age_hours: float = 3,
) -> DataFrame:
    """FAIL for too many subfolders, WARN for an old one, else PASS."""
    per_source = _per_source(listing, sources, as_of, max_age_hours)
    n, old = F.col("subfolder_count"), F.col("stale_subfolders")
    over = n > max_subfolders
    status = F.when(over, "FAIL").when(old > 0, "WARN").otherwise("PASS")
    return per_source.select("source", n, old, over.alias("over_limit"), status.alias("status"))


def alerts(
    listing: DataFrame,
    as_of: datetime,
    sources: DataFrame | None = None,
    max_subfolders: int = 6,
    stale_hours: float = 8,
) -> DataFrame:
    """One row per alert; a source without files is stale."""
    per_source = _per_source(listing, sources, as_of, stale_hours)
    n, age = F.col("subfolder_count"), F.col("newest_age_hours")
    found = F.array_compact(
        F.array(F.when(n > max_subfolders, "folder_count"), F.when(age.isNull() | (age > stale_hours), "stale_files"))
    )
    return per_source.select("source", F.explode(found).alias("alert"), n, _shown(age))


def _shown(age: Column) -> Column:
    return F.round(age, 1).alias("newest_age_hours")
