"""Six daily quality metrics of a policy table, from one scan, and their rolling status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakecheck.operators.rolling import rolling_status

METRICS = (
    "RECORD_VOLUME",
    "NULLABILITY_COMBINED",
    "AMOUNT_ANOMALIES_COMBINED",
    "PREMIUM_CONSISTENCY",
    "DUPLICATES_COMBINED",
    "DATE_VALIDATIONS_COMBINED",
)


def amount_anomaly(max_amount: float) -> Column:
    return (F.col("face_amount") < 0) | (F.col("face_amount") > F.lit(max_amount))


def premium_mismatch() -> Column:
    yearly = F.col("modal_premium") * 12
    return (F.col("bill_mode") == "ANNUAL") & (F.col("annualized_premium") != yearly)


def date_conflict(max_years: int) -> Column:
    """Effective after the file date, expiry too far out, or termination before the start."""
    return (
        (F.col("effective_date") > F.col("source_file_date"))
        | (F.col("expiry_date") > F.add_months(F.col("effective_date"), 12 * max_years))
        | (F.col("termination_date") < F.col("effective_date"))
    )


def daily_metrics(
    policies: DataFrame, max_amount: float = 400000, max_years: int = 100, metrics: tuple[str, ...] = METRICS
) -> DataFrame:
    """(metric, source_file_date, cnt) for the wanted metrics; what no metric needs is not worked out.

    The table is read and shuffled once: by date and application, where repeats show, then by date.
    """
    per_application = policies.groupBy("source_file_date", "application_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("policy_id").isNull() | F.col("application_id").isNull()).alias("nulls"),
        F.count_if(amount_anomaly(max_amount)).alias("amounts"),
        F.count_if(premium_mismatch()).alias("premiums"),
        F.count_if(date_conflict(max_years)).alias("dates"),
    )
    repeats = F.when(F.col("application_id").isNotNull(), F.col("n") - 1).otherwise(0)
    measures = {
        "RECORD_VOLUME": F.sum("n"),
        "NULLABILITY_COMBINED": F.sum("nulls"),
        "AMOUNT_ANOMALIES_COMBINED": F.sum("amounts"),
        "PREMIUM_CONSISTENCY": F.sum("premiums"),
        "DUPLICATES_COMBINED": F.sum(repeats),
        "DATE_VALIDATIONS_COMBINED": F.sum("dates"),
    }
    per_date = per_application.groupBy("source_file_date").agg(*[measures[name].alias(name) for name in metrics])
    return per_date.unpivot(["source_file_date"], list(metrics), "metric", "cnt").select(
        "metric", "source_file_date", "cnt"
    )


def metric_status(policies: DataFrame, rows: int = 10, **limits) -> DataFrame:
    return rolling_status(daily_metrics(policies, **limits), ["metric"], "source_file_date", "cnt", rows)
