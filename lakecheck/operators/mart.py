"""Customer-order summary: filter, two joins, margin, per-customer metrics and top category."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakecheck.functions.exprs import instant

# Sums run over exact decimals, so a result does not depend on how tasks split the rows.
MARGIN_TYPE = "decimal(18,6)"
MARGIN_TOTAL = "decimal(28,6)"
MONEY_TYPE = "decimal(28,2)"


def active_only(df: DataFrame, flag: str = "active") -> DataFrame:
    return df.filter(F.col(flag))


def completed_since(orders: DataFrame, since: date, status: str = "completed") -> DataFrame:
    return orders.filter((F.col("status") == status) & (F.col("order_date") >= F.lit(since)))


def customer_orders(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Inner join; only the columns the summary needs."""
    return orders.join(customers, "customer_id", "inner").select(
        "customer_id",
        "customer_name",
        "region",
        "order_id",
        "product_id",
        "order_date",
        "quantity",
        "total_amount",
        "status",
    )


def with_products(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Left join, so an order line of an unknown or inactive product stays, with NULL product columns."""
    wanted = products.select("product_id", "product_name", "category", "price", "cost")
    return orders.join(wanted, "product_id", "left")


def profit_margin(price: str = "price", cost: str = "cost") -> Column:
    """Percent of the price that is not cost; NULL where the price is 0 or unknown."""
    p, c = F.col(price), F.col(cost)
    return F.try_divide((p - c).cast("double"), p.cast("double")) * 100


def lifetime_value(revenue: Column, margin: Column) -> Column:
    return revenue.cast("double") * (1 + margin / 100)


def customer_metrics(full_orders: DataFrame, by: tuple[str, ...] = ("customer_id", "customer_name", "region")) -> DataFrame:
    revenue = F.sum("total_amount").cast(MONEY_TYPE)
    margin = F.col("profit_margin_pct").cast(MARGIN_TYPE)
    return full_orders.groupBy(*by).agg(
        F.count("order_id").alias("total_orders"),
        F.sum("quantity").alias("total_quantity"),
        revenue.alias("total_revenue"),
        _mean(revenue, F.count("total_amount"), 4).alias("avg_order_value"),
        F.max("order_date").alias("last_order_date"),
        _mean(F.sum(margin).cast(MARGIN_TOTAL), F.count(margin), 4).alias("avg_profit_margin"),
    )


def category_counts(full_orders: DataFrame) -> DataFrame:
    return full_orders.groupBy("customer_id", "category").agg(F.count(F.lit(1)).alias("category_count"))


def top_category(counts: DataFrame) -> DataFrame:
    """The most frequent category of each customer; ties by name, a missing category last."""
    rank = F.struct(-F.col("category_count"), F.col("category").isNull(), F.col("category"))
    return counts.groupBy("customer_id").agg(
        F.min_by("category", rank).alias("category"), F.max("category_count").alias("category_count")
    )


def with_top_category(summary: DataFrame, top: DataFrame) -> DataFrame:
    return summary.join(top.select("customer_id", "category"), "customer_id", "left").withColumnRenamed(
        "category", "top_category"
    )


def customer_order_summary(
    customers: DataFrame, orders: DataFrame, products: DataFrame, since: date, as_of: datetime | date
) -> DataFrame:
    """The whole summary in two aggregations."""
    summary = metrics_with_top_category(customers, orders, products, since)
    return summary.withColumn(
        "customer_lifetime_value", F.round(lifetime_value(F.col("total_revenue"), F.col("avg_profit_margin")), 2)
    ).withColumn("processed_at", instant(as_of))


def metrics_with_top_category(customers: DataFrame, orders: DataFrame, products: DataFrame, since: date) -> DataFrame:
    """The metrics of each customer with the most frequent category beside them.

    Order lines are first reduced to one row per (customer, category) with partial sums, so a customer
    who owns a large share of the lines is combined on the map side and never meets the customer join
    row by row. Metrics and top category then come from the same second aggregation, which saves a
    second pass over the joined lines, the ranking window and the join back. The margin depends on the
    product alone and is worked out once per product.
    """
    items = active_only(products).select("product_id", "category", profit_margin().cast(MARGIN_TYPE).alias("margin"))
    lines = completed_since(orders, since).join(items, "product_id", "left")
    partial = lines.groupBy("customer_id", "category").agg(
        F.count(F.lit(1)).alias("lines"),
        F.count("order_id").alias("orders"),
        F.sum("quantity").alias("quantity"),
        F.sum("total_amount").alias("amount"),
        F.count("total_amount").alias("amounts"),
        F.max("order_date").alias("last_order_date"),
        F.sum("margin").alias("margin"),
        F.count("margin").alias("margins"),
    )
    rank = F.struct(-F.col("lines"), F.col("category").isNull(), F.col("category"))
    people = active_only(customers).select("customer_id", "customer_name", "region")
    revenue = F.sum("amount").cast(MONEY_TYPE)
    return (
        partial.join(people, "customer_id", "inner")
        .groupBy("customer_id", "customer_name", "region")
        .agg(
            F.sum("orders").alias("total_orders"),
            F.sum("quantity").alias("total_quantity"),
            revenue.alias("total_revenue"),
            _mean(revenue, F.sum("amounts"), 4).alias("avg_order_value"),
            F.max("last_order_date").alias("last_order_date"),
            _mean(F.sum("margin").cast(MARGIN_TOTAL), F.sum("margins"), 4).alias("avg_profit_margin"),
            F.min_by("category", rank).alias("top_category"),
        )
    )


def _mean(total: Column, count: Column, digits: int) -> Column:
    """Decimal division, so that ties round half up.

    The total must leave digits for the fraction: decimal(38,s) / bigint would keep only six.
    """
    return F.round(F.try_divide(total, count), digits).cast("double")
