"""Membership-movement analytics.

``movements`` holds load_date, movement_category (INFORCE, ADD, DEDUCT), movement_subcategory,
product_type, club_code, member_id and inactive_reason. Everything starts from counts per load date and
group, made by one map-side combined aggregation; statistics run on those counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakecheck.functions.exprs import when_status
from lakecheck.operators.keys import latest_rows
from lakecheck.operators.topn import top_groups

# The movement categories.
CATEGORIES = ("INFORCE", "ADD", "DEDUCT")


def is_category(*names: str) -> Column:
    return F.col("movement_category").isin(*names)


def counts(movements: DataFrame, *by: str) -> DataFrame:
    return movements.groupBy("load_date", *by).agg(F.count(F.lit(1)).alias("cnt"))


def _net(movements: DataFrame, *by: str) -> DataFrame:
    return movements.groupBy("load_date", *by).agg(
        F.count_if(is_category("INFORCE")).alias("inforce"),
        F.count_if(is_category("ADD")).alias("adds"),
        F.count_if(is_category("DEDUCT")).alias("deducts"),
    )


# ---- indicators --------------------------------------------------------------------------------


def count_at_latest(movements: DataFrame, category: str) -> DataFrame:
    """Rows of a category at its own latest load date.

    The latest date is a scalar subquery on the bare column, so of a history partitioned by load date only
    the last partition is read for the count.
    """
    return latest_rows(movements.filter(is_category(category)), "load_date").agg(F.count(F.lit(1)).alias("value"))


def net_gain_at_latest(movements: DataFrame) -> DataFrame:
    adds, deducts = F.count_if(is_category("ADD")), F.count_if(is_category("DEDUCT"))
    return latest_rows(movements, "load_date").agg((adds - deducts).alias("value"))


def inforce_by_product(movements: DataFrame) -> DataFrame:
    """All products at once."""
    latest = latest_rows(movements.filter(is_category("INFORCE")), "load_date")
    return latest.groupBy("product_type").agg(F.count(F.lit(1)).alias("value"))


def retention_rate(movements: DataFrame) -> DataFrame:
    lost = F.try_divide(
        F.count_if(is_category("DEDUCT")).cast("double"), F.count_if(is_category("INFORCE")).cast("double")
    )
    return latest_rows(movements, "load_date").agg(F.round((1 - lost) * 100, 2).alias("value"))


# ---- trends ------------------------------------------------------------------------------------


def trend_inforce_by_product(movements: DataFrame) -> DataFrame:
    return counts(movements.filter(is_category("INFORCE")), "product_type").withColumnRenamed("cnt", "member_count")


def trend_add_deduct(movements: DataFrame) -> DataFrame:
    """One column per category, zeros where a date lacks one."""
    return (
        counts(movements.filter(is_category("ADD", "DEDUCT")), "movement_category")
        .groupBy("load_date")
        .pivot("movement_category", ["ADD", "DEDUCT"])
        .agg(F.sum("cnt"))
        .fillna(0)
        .withColumnsRenamed({"ADD": "add_cnt", "DEDUCT": "deduct_cnt"})
    )


def trend_net_gain(movements: DataFrame) -> DataFrame:
    return _net(movements).select("load_date", (F.col("adds") - F.col("deducts")).alias("net_gain"))


def trend_top_clubs(movements: DataFrame, n: int = 10) -> DataFrame:
    per_date = counts(movements.filter(is_category("INFORCE")), "club_code")
    return top_groups(per_date, "club_code", "cnt", n).withColumnRenamed("cnt", "member_count")


# ---- checks ------------------------------------------------------------------------------------


def net_gain_balance(movements: DataFrame) -> DataFrame:
    """Change of the inforce count since the load before, against ADD minus DEDUCT, per club and product.

    Our definition. The first load of a group has nothing to compare with and counts as balanced.
    """
    own = Window.partitionBy("club_code", "product_type").orderBy("load_date")
    before = F.lag("inforce").over(own)
    change, moved = F.col("inforce_change"), F.col("adds") - F.col("deducts")
    return (
        _net(movements, "club_code", "product_type")
        .withColumn("inforce_change", F.col("inforce") - before)
        .select(
            "club_code",
            "product_type",
            "load_date",
            "inforce",
            "inforce_change",
            moved.alias("net_movement"),
            F.when(change.isNull() | (change == moved), "Y").otherwise("N").alias("balanced"),
        )
    )


def interstate_balance(movements: DataFrame) -> DataFrame:
    """Transfers in against transfers out per load date. Our definition."""
    return (
        _net(movements.filter(F.col("movement_subcategory") == "TRANSFER"))
        .select(
            "load_date",
            F.col("adds").alias("add_transfers"),
            F.col("deducts").alias("deduct_transfers"),
            F.when(F.col("adds") == F.col("deducts"), "Y").otherwise("N").alias("interstate_transfer_balance"),
        )
    )


def summary(movements: DataFrame, product: str) -> DataFrame:
    kept = movements.filter(F.col("product_type") == product)
    return kept.groupBy("movement_category", "movement_subcategory").agg(F.count(F.lit(1)).alias("cnt"))


def missing_subcategories(movements: DataFrame, expected: list[tuple[str, str]]) -> DataFrame:
    """Expected (category, subcategory) pairs that a load date lacks. Our definition."""
    present = counts(movements, "movement_category", "movement_subcategory")
    pairs = F.array(
        *[
            F.struct(F.lit(c).alias("movement_category"), F.lit(s).alias("movement_subcategory"))
            for c, s in expected
        ]
    )
    wanted = present.select("load_date").distinct().select("load_date", F.inline(pairs))
    return wanted.join(present, ["load_date", "movement_category", "movement_subcategory"], "left_anti")


def count_range(movements: DataFrame, category: str, low: int, high: int) -> DataFrame:
    """Count of a category per load date within expected bounds. Our definition."""
    return counts(movements.filter(is_category(category))).withColumn(
        "status", when_status(F.col("cnt").between(low, high))
    )


def club_deviation(movements: DataFrame, category: str, by: tuple[str, ...] = ("club_code",), width: float = 2.0) -> DataFrame:
    """Latest count of each group against mean and deviation of all its load dates. Our definition."""
    x = F.col("cnt").cast("double")
    per_group = (
        counts(movements.filter(is_category(category)), *by)
        .groupBy(*by)
        .agg(
            F.max("load_date").alias("load_date"),
            F.max_by("cnt", "load_date").alias("latest_cnt"),
            F.round(F.avg(x), 4).alias("mean_cnt"),
            F.round(F.stddev_samp(x), 4).alias("stddev_cnt"),
        )
    )
    return per_group.withColumn("outlier", _outlier("latest_cnt", width))


def _outlier(value: str, width: float) -> Column:
    gap = F.abs(F.col(value) - F.col("mean_cnt"))
    return F.when(gap > width * F.col("stddev_cnt"), "Y").otherwise("N")


def inactive_reason(movements: DataFrame, category: str = "DEDUCT") -> DataFrame:
    """Inactive rows without a reason per load date. Our definition."""
    missing = F.count_if(F.col("inactive_reason").isNull())
    return (
        movements.filter(is_category(category))
        .groupBy("load_date")
        .agg(
            F.count(F.lit(1)).alias("inactive_rows"),
            missing.alias("missing_reason"),
            when_status(missing == 0).alias("status"),
        )
    )


def seasonality(
    movements: DataFrame,
    pairs: list[tuple[str, str]],
    position: Column | None = None,
    by: tuple[str, ...] = (),
    width: float = 2.0,
) -> DataFrame:
    """Count per period against mean and deviation at the same position of the cycle. Our definition.

    The position defaults to the month of the year; daily loads may pass the day of the week.
    """
    position = F.month("load_date") if position is None else position
    wanted = F.lit(False)
    for category, sub in pairs:
        wanted = wanted | (is_category(category) & (F.col("movement_subcategory") == sub))
    groups = ("movement_category", "movement_subcategory", *by)
    same = Window.partitionBy(*groups, "position")
    x = F.col("cnt").cast("double")
    return (
        counts(movements.filter(wanted), *groups)
        .withColumn("position", position.cast("int"))
        .withColumns(
            {"mean_cnt": F.round(F.avg(x).over(same), 4), "stddev_cnt": F.round(F.stddev_samp(x).over(same), 4)}
        )
        .withColumn("outlier", _outlier("cnt", width))
    )

