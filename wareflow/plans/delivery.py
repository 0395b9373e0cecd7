"""Time from order to shipment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wareflow.functions.numbers import ratio, rounded
from wareflow.functions.present import in_order, text_or
from wareflow.functions.rules import (
    DELAY_BLANK,
    DELAY_OTHER,
    DELAY_RULES,
    EARLY,
    LATE,
    NOT_SHIPPED,
    ON_TIME,
    Rules,
    keyword_label,
)
from wareflow.functions.text import distinct_list, least_spelling, name_list
from wareflow.operators.rollups import order_places

DAYS_TO_SHIP = "datediff(shippedDate, orderDate)"


def delivery_performance(orders: DataFrame, early_days: int = 5) -> DataFrame:
    """Orders and average days to ship by delivery bucket; 'NA' where nothing shipped."""
    spare = F.datediff("requiredDate", "shippedDate")
    bucket = (
        F.when(F.col("shippedDate").isNull(), NOT_SHIPPED)
        .when(spare >= early_days, EARLY)
        .when(spare < 0, LATE)
        .otherwise(ON_TIME)
    )
    spent = F.expr(DAYS_TO_SHIP)
    days = rounded(ratio(F.sum(spent), F.count(spent)), 0).cast("bigint")
    return orders.groupBy(bucket.alias("delivery_performance")).agg(
        F.count(F.lit(1)).alias("total_orders"),
        text_or(days, "NA").alias("avg_days_to_ship"),
    )


def _shipped(orders: DataFrame, exclude: DataFrame | Sequence[int] = ()) -> DataFrame:
    shipped = orders.filter(F.col("shippedDate").isNotNull())
    if isinstance(exclude, DataFrame):
        return shipped.join(exclude.select("orderNumber"), "orderNumber", "left_anti")
    return shipped.filter(~F.col("orderNumber").isin(*exclude)) if exclude else shipped


def shipping_by_country(
    orders: DataFrame,
    customers: DataFrame,
    lines: DataFrame,
    products: DataFrame,
    warehouses: DataFrame,
    exclude: DataFrame | Sequence[int] = (),
    corrected: bool = False,
) -> DataFrame:
    """Per country: shipped order lines, average days to ship and the warehouses involved.

    As written the count and the average are over lines, so a long order weighs more: line
    counts and days add up over (country, warehouse). ``corrected`` counts every order once, so
    an order's rows meet before they are counted. Either way lines shrink to (order, warehouse)
    first. ``exclude`` is a list or a table of order numbers.
    """
    placed = (
        _shipped(orders, exclude)
        .select("orderNumber", "customerNumber", F.expr(DAYS_TO_SHIP).cast("bigint").alias("days"))
        .join(order_places(lines, products, warehouses, "warehouseName"), "orderNumber")
        .join(customers.select("customerNumber", "country"), "customerNumber")
    )
    if corrected:
        places = placed.groupBy("orderNumber", "country", "days").agg(F.array_distinct(F.collect_list("warehouseName")).alias("places"))
        placed = places.select("country", "days", F.posexplode("places").alias("pos", "warehouseName"))
        # an order's own figures count at its first warehouse only
        weight = F.when(F.col("pos") == 0, 1).otherwise(0).cast("bigint")
    else:
        weight = F.col("n_lines")
    return (
        placed.groupBy("country", "warehouseName")
        .agg(least_spelling("country").alias("shown"), F.sum(weight).alias("n"), F.sum(weight * F.col("days")).alias("days"))
        .groupBy("country")
        .agg(
            F.min("shown").alias("shown"),
            F.sum("n").alias("number_of_orders"),
            F.sum("days").alias("days"),
            distinct_list("warehouseName", ",").alias("warehouses_affected"),
        )
        .select(
            "number_of_orders",
            rounded(ratio(F.col("days"), F.col("number_of_orders")), 0)
            .cast("bigint")
            .alias("avg_days_to_ship"),
            F.col("shown").alias("country"),
            "warehouses_affected",
        )
        .orderBy(F.desc("avg_days_to_ship"), "country")
    )


def slowest_orders(
    orders: DataFrame,
    customers: DataFrame,
    lines: DataFrame,
    products: DataFrame,
    warehouses: DataFrame,
    rules: Rules = DELAY_RULES,
    blank: str = DELAY_BLANK,
    other: str = DELAY_OTHER,
    ordered: bool = True,
) -> DataFrame:
    """Shipped orders, slowest first: days to ship, warehouses and what the comment says."""
    footprint = (
        order_places(lines, products, warehouses, "warehouseName")
        .groupBy("orderNumber")
        .agg(name_list("warehouseName").alias("affected_warehouses"))
    )
    rows = (
        _shipped(orders)
        .select(
            "orderNumber",
            "customerNumber",
            "orderDate",
            "shippedDate",
            F.expr(DAYS_TO_SHIP).alias("ship_days"),
            keyword_label("comments", rules, blank, other).alias("reason"),
        )
        .join(footprint, "orderNumber")
        .join(customers.select("customerNumber", "country"), "customerNumber")
        .select(
            F.col("orderNumber").alias("order_number"),
            F.col("orderDate").alias("order_date"),
            F.col("shippedDate").alias("shipped_date"),
            "country",
            "ship_days",
            "affected_warehouses",
            "reason",
        )
    )
    return in_order(rows, ordered, F.desc("ship_days"), "order_number")


def slowest_order_number(orders: DataFrame) -> DataFrame:
    """One row: the number of the order that took longest; ties to the smaller."""
    latest = F.desc(F.expr(DAYS_TO_SHIP))
    return _shipped(orders).orderBy(latest, "orderNumber").limit(1).select("orderNumber")
