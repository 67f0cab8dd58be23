"""Member and transaction summaries over a date window."""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakecheck.functions.exprs import between_days, from_day, money, on_day


def last_days(df: DataFrame, as_of: date, days: int = 30, column: str = "load_date") -> DataFrame:
    """Rows from ``as_of - days`` on, open at the end."""
    return df.filter(from_day(df, column, as_of - timedelta(days=days)))


def counts_by(
    df: DataFrame,
    by: list[str],
    count: str = "total",
    amount: dict[str, str] | None = None,
    distinct: dict[str, str] | None = None,
) -> DataFrame:
    """Row count, exact sums and exact distinct counts by group.

    With distinct counts, rows are first combined by group and counted values, so that what the distinct counts
    multiply is one row per combination.
    """
    amount, distinct = amount or {}, distinct or {}
    if not distinct:
        return df.groupBy(*by).agg(F.count(F.lit(1)).alias(count), *(money(F.sum(c)).alias(name) for name, c in amount.items()))
    values = [c for c in dict.fromkeys(distinct.values()) if c not in by]
    sums = [F.sum(c).alias(f"_{name}") for name, c in amount.items()]
    combined = df.groupBy(*by, *values).agg(F.count(F.lit(1)).alias("_rows"), *sums)
    measures: list[Column] = [F.sum("_rows").alias(count)]
    measures += [money(F.sum(f"_{name}")).alias(name) for name in amount]
    measures += [F.count_distinct(column).alias(name) for name, column in distinct.items()]
    return combined.groupBy(*by).agg(*measures)


def statewise_members(df: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    distinct = {"clubs_active": "club_id", "days_active": "load_date"}
    return counts_by(last_days(df, as_of, days), ["state_code"], "total_members", distinct=distinct)


def clubwise_members(df: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    distinct = {"states_present": "state_code", "plan_types": "bill_plan"}
    return counts_by(last_days(df, as_of, days), ["club_id"], "total_members", distinct=distinct)


def statewise_transactions(df: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    return counts_by(
        last_days(df, as_of, days), ["state_code"], "txn_count", {"total_amount": "amount"}, {"products_active": "product_code"}
    )


def daily_trend(df: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    distinct = {"active_states": "state_code", "active_clubs": "club_id"}
    return counts_by(last_days(df, as_of, days), ["load_date"], "total_records", {"total_amount": "amount"}, distinct)


def day_counts(tables: dict[str, tuple[DataFrame, str]], day: date) -> DataFrame:
    """Rows of a day per table, one aggregate each; ``tables`` maps a name to its frame and date column."""
    counts = [
        df.filter(on_day(df, column, day)).agg(F.count(F.lit(1)).alias("row_count")).withColumn("table_name", F.lit(name))
        for name, (df, column) in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts).select("table_name", "row_count")


def daily_counts(df: DataFrame, column: str, first: date, last: date) -> DataFrame:
    days = df.filter(between_days(df, column, first, last))
    return days.groupBy(F.to_date(F.col(column)).alias("load_date")).agg(F.count(F.lit(1)).alias("total_rows"))
