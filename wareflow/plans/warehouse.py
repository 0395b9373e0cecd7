"""Warehouse capacity, diversity, baseline and closures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wareflow.functions.numbers import percent, ratio, rounded
from wareflow.functions.text import distinct_list
from wareflow.operators.rollups import lines_of, product_sales, stock_by, with_status
from wareflow.operators.stock import NOT_SOLD_REVENUE
from wareflow.operators.whatif import reallocate


def warehouse_capacity_rank(products: DataFrame, warehouses: DataFrame) -> DataFrame:
    """Capacity that the stock and the occupied percentage imply, and the slots still free."""
    stock = F.col("stock")
    occupied = F.col("warehousePctCap").cast("decimal(10,2)")
    capacity = ratio(stock * 100, occupied)
    order = F.when(occupied > 0, capacity).otherwise(0)
    return (
        warehouses.join(stock_by(products, "warehouseCode"), "warehouseCode")
        .select(
            F.col("warehouseCode").alias("warehouse_code"),
            F.col("warehouseName").alias("warehouse_name"),
            occupied.cast("double").alias("occupied_pct"),
            stock.alias("current_item_count"),
            rounded(capacity, 0).alias("theoretical_capacity"),
            rounded(capacity - stock, 0).alias("remaining_empty_slots"),
            F.dense_rank().over(Window.orderBy(F.desc(order))).alias("capacity_rank"),
        )
        .orderBy("capacity_rank", "warehouse_code")
    )


def warehouse_diversity(products: DataFrame, warehouses: DataFrame) -> DataFrame:
    """Products, product lines and share of the catalogue per warehouse. Products of an
    unknown warehouse form a group without a name."""
    names = warehouses.select(
        "warehouseCode", F.col("warehouseCode").alias("warehouse_code"), "warehouseName"
    )
    every = Window.partitionBy()  # over warehouses only
    return (
        products.join(names, "warehouseCode", "left")
        .groupBy("warehouse_code", F.col("warehouseName").alias("warehouse_name"))
        .agg(
            F.count(F.lit(1)).alias("unique_items_sold"),
            distinct_list("productLine").alias("product_lines_sold"),
        )
        .withColumn(
            "pct_of_catalog",
            percent(F.col("unique_items_sold"), F.sum("unique_items_sold").over(every), 1),
        )
        .orderBy("unique_items_sold", "warehouse_code")
    )


def warehouse_baseline(
    products: DataFrame,
    warehouses: DataFrame,
    lines: DataFrame,
    orders: DataFrame,
    drop: Sequence[str] = NOT_SOLD_REVENUE,
) -> DataFrame:
    """Every warehouse with its lines, stock, tied capital, revenue and occupied percentage."""
    sold = product_sales(lines_of(lines, with_status(orders, drop=drop)))
    earned = (
        products.select("productCode", "warehouseCode")
        .join(sold, "productCode")
        .groupBy("warehouseCode")
        .agg(F.sum("revenue").alias("revenue"))
    )
    held = products.groupBy("warehouseCode").agg(
        F.sum("quantityInStock").alias("stock"),
        F.sum(F.col("quantityInStock") * F.col("buyPrice")).alias("capital"),
        distinct_list("productLine").alias("product_lines"),
    )
    return (
        warehouses.join(held, "warehouseCode", "left")
        .join(earned, "warehouseCode", "left")
        .select(
            F.col("warehouseCode").alias("warehouse_code"),
            F.col("warehouseName").alias("warehouse_name"),
            F.coalesce("product_lines", F.lit("None")).alias("product_lines"),
            F.coalesce("stock", F.lit(0)).alias("current_stock"),
            F.coalesce("capital", F.lit(0)).alias("tied_capital"),
            F.coalesce("revenue", F.lit(0)).alias("historical_revenue"),
            F.col("warehousePctCap").cast("double").alias("occupied_capacity_pct"),
        )
        .orderBy("warehouse_code")
    )


def whatif_closure(
    products: DataFrame,
    warehouses: DataFrame,
    lines: DataFrame,
    orders: DataFrame,
    moves: Mapping[str, str],
    closed: Sequence[str],
    retention: Mapping[str, float] | None = None,
    statuses: Sequence[str] = ("Shipped",),
) -> DataFrame:
    """The warehouses left after a closure, with the revenue of orders in ``statuses``."""
    sales = product_sales(lines_of(lines, with_status(orders, keep=statuses)))
    return reallocate(products, warehouses, sales, moves, closed, retention)
