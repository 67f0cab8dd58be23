"""Failure analytics over failed rules and resolved outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakecheck.functions.exprs import percent
from lakecheck.operators.rules import failure_rate

# Confidence marks.
HIGH_FROM, MEDIUM_FROM = 0.85, 0.60


def confidence_label(confidence: str = "confidence") -> Column:
    return (
        F.when(F.col(confidence) >= HIGH_FROM, "HIGH").when(F.col(confidence) >= MEDIUM_FROM, "MEDIUM").otherwise("LOW")
    )


def with_failure_rate(failures: DataFrame) -> DataFrame:
    return failures.withColumn("failure_rate", failure_rate())


def similar_outcomes(failures: DataFrame, outcomes: DataFrame, k: int = 10) -> DataFrame:
    """Up to ``k`` newest outcomes of the same rule or the same table for each failure.

    The newest ``k`` of the union lie within the newest ``k`` of the rule and the newest ``k`` of the
    table. So each rule and each table is cut to ``k`` outcomes first (Spark limits them per map task),
    and matched once per distinct (rule, table) pair; rule or table groups are never paired row by row.
    """
    newest = [F.desc("resolved_at"), F.desc("outcome_id")]
    past = outcomes.select(
        "outcome_id", "rule_name", "table_name", "classification", "action", "resolved_at"
    ).withColumnsRenamed({"rule_name": "past_rule", "table_name": "past_table"})

    def newest_by(column: str) -> DataFrame:
        ranked = past.withColumn("_rn", F.row_number().over(Window.partitionBy(column).orderBy(*newest)))
        return ranked.filter(F.col("_rn") <= k).drop("_rn")

    pairs = failures.select(F.col("rule_name").alias("_rule"), F.col("table_name").alias("_table")).distinct()
    by_rule = pairs.join(newest_by("past_rule"), F.col("_rule") == F.col("past_rule"))
    by_table = pairs.join(newest_by("past_table"), F.col("_table") == F.col("past_table"))
    own = Window.partitionBy("_rule", "_table").orderBy(*newest)
    ranked = by_rule.union(by_table).distinct().withColumn("similar_rank", F.row_number().over(own))
    chosen = ranked.filter(F.col("similar_rank") <= k)
    # a failure may lack the rule or the table and still match by the other
    same = F.col("rule_name").eqNullSafe(F.col("_rule")) & F.col("table_name").eqNullSafe(F.col("_table"))
    return failures.select("record_id", "rule_name", "table_name").join(chosen, same).drop("_rule", "_table")


def batch_summary(failures: DataFrame) -> DataFrame:
    """Counts by classification, rules that repeat, and a score: the share of rows that did not fail.

    Counts are first reduced to one row per rule.
    """
    kinds = {
        "true_failures": "TRUE_FAILURE",
        "false_positives": "FALSE_POSITIVE",
        "needs_investigation": "NEEDS_INVESTIGATION",
    }
    per_rule = failures.groupBy("rule_name").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("row_count_failed").alias("failed_rows"),
        F.sum("total_row_count").alias("all_rows"),
        *[F.count_if(F.col("classification") == kind).alias(name) for name, kind in kinds.items()],
    )
    failed = F.try_divide(F.sum("failed_rows").cast("double"), F.sum("all_rows").cast("double"))
    score = F.round((1 - F.least(F.coalesce(failed, F.lit(0.0)), F.lit(1.0))) * 100, 0)
    return per_rule.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("failures"),
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in kinds],
        F.count_if(F.col("n") > 1).alias("repeated_rules"),
        score.cast("bigint").alias("quality_score"),
    )


def top_issues(failures: DataFrame, k: int = 3) -> DataFrame:
    return (
        failures.groupBy("rule_name", "table_name")
        .agg(F.sum("row_count_failed").alias("failed_rows"), F.count(F.lit(1)).alias("occurrences"))
        .orderBy(F.desc("failed_rows"), "rule_name", "table_name")
        .limit(k)
    )


def false_positive_patterns(failures: DataFrame) -> DataFrame:
    wrong = F.count_if(F.col("classification") == "FALSE_POSITIVE")
    return (
        failures.groupBy("rule_type", "table_name", "column_name")
        .agg(
            F.count(F.lit(1)).alias("failures"),
            wrong.alias("frequency"),
            percent(wrong, F.count(F.lit(1)), 2).alias("false_positive_pct"),
        )
        .filter(F.col("frequency") > 0)
    )


def action_effectiveness(outcomes: DataFrame) -> DataFrame:
    """Share of outcomes judged right, by action; outcomes without feedback are left out."""
    return outcomes.groupBy("action").agg(*_judged())


def confidence_calibration(outcomes: DataFrame) -> DataFrame:
    return outcomes.groupBy(confidence_label().alias("confidence_label")).agg(*_judged())


def _judged() -> list[Column]:
    right, judged = F.count_if(F.col("was_correct")), F.count("was_correct")
    return [judged.alias("judged"), right.alias("correct"), percent(right, judged, 2).alias("correct_pct")]


def learning_features(failures: DataFrame) -> DataFrame:
    """Features and prediction of each failure as two structs."""
    rated = with_failure_rate(failures)
    features = ["rule_name", "table_name", "column_name", "rule_type", "failure_rate"]
    return rated.select(
        "record_id",
        F.struct(*features).alias("features"),
        F.struct("classification", "confidence", confidence_label().alias("confidence_label")).alias("prediction"),
    )
