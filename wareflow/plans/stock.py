"""Stock health, what to reduce and what to restock."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wareflow.functions.numbers import exact, percent
from wareflow.functions.present import in_order
from wareflow.functions.text import contains_any
from wareflow.operators.rollups import (
    lines_of,
    located_products,
    product_sales,
    stock_by,
    with_status,
)
from wareflow.operators.stock import (
    ITEM_SCALE,
    NOT_SOLD_REVENUE,
    NOT_SOLD_STOCK,
    WAREHOUSE_SCALE,
    HealthScale,
    stock_position,
)

ITEM = {
    "warehouse_name": "warehouseName",
    "product_code": "productCode",
    "product_name": "productName",
    "product_line": "productLine",
    "total_units_sold": "units",
    "current_stock": "quantityInStock",
    "stock_health": "health",
}


def _item_columns():
    return [F.col(source).alias(name) for name, source in ITEM.items()]


def stock_health(
    products: DataFrame,
    warehouses: DataFrame,
    lines: DataFrame,
    orders: DataFrame,
    drop: Sequence[str] = NOT_SOLD_STOCK,
    scale: HealthScale = ITEM_SCALE,
    corrected: bool = False,
    ordered: bool = True,
) -> DataFrame:
    """Every product with its health class and the capital its stock ties up. As written a
    product without any counted line is left out; ``corrected`` keeps unsold products."""
    rows = (
        stock_position(products, warehouses, lines, orders, drop, corrected, scale)
        .select(
            *_item_columns(),
            (F.col("quantityInStock") * F.col("buyPrice")).alias("capital_tied_up"),
        )
    )
    return in_order(rows, ordered, "total_units_sold", "product_code")


def warehouse_health_pct(
    products: DataFrame,
    warehouses: DataFrame,
    lines: DataFrame,
    scale: HealthScale = WAREHOUSE_SCALE,
) -> DataFrame:
    """Per warehouse: number of products and the percentage of them in each health class."""
    items = stock_position(products, warehouses, lines, scale=scale)
    total = F.count(F.lit(1))
    share = {
        "severe_understock_pct": scale.restock,
        "normal_balance_pct": scale.balanced,
        "severe_overstock_pct": scale.overstock,
        "dead_sales_pct": scale.dead,
    }
    return (
        items.groupBy("warehouseCode", F.col("warehouseName").alias("warehouse_name"))
        .agg(
            total.alias("total_products"),
            *[
                percent(F.count_if(F.col("health") == name), total).alias(out)
                for out, name in share.items()
            ],
        )
        .drop("warehouseCode")
        .orderBy("warehouse_name")
    )


def warehouse_movement_rank(
    products: DataFrame,
    warehouses: DataFrame,
    lines: DataFrame,
    orders: DataFrame,
    drop: Sequence[str] = NOT_SOLD_REVENUE,
    corrected: bool = False,
) -> DataFrame:
    """Per warehouse: units sold against stock, revenue, and the rank by each.

    As written the stock of a product counts once per line sold; that is stock times line
    count, taken at product grain. ``corrected`` counts the stock of every product once.
    """
    sold = product_sales(lines_of(lines, with_status(orders, drop=drop)))
    rows = located_products(products, warehouses).join(sold, "productCode")
    moved = rows.groupBy("warehouseCode", "warehouseName").agg(
        F.sum("units").alias("units"),
        F.sum(F.col("quantityInStock").cast("bigint") * F.col("n_lines")).alias("stock"),
        F.sum("revenue").alias("revenue"),
    )
    if corrected:
        held = stock_by(products, "warehouseCode").select("warehouseCode", "stock")
        moved = moved.drop("stock").join(held, "warehouseCode")
    every = Window.partitionBy()  # over warehouses only
    return (
        moved.withColumn("movement_pct", percent(F.col("units"), F.col("stock")))
        .select(
            F.col("warehouseCode").alias("warehouse_code"),
            F.col("warehouseName").alias("warehouse_name"),
            F.col("units").alias("units_sold"),
            F.col("stock").alias("current_stock"),
            "movement_pct",
            F.col("revenue").alias("total_revenue"),
            F.dense_rank().over(every.orderBy(F.desc("movement_pct"))).alias("movement_rank"),
            F.dense_rank().over(every.orderBy(F.desc("revenue"))).alias("revenue_rank"),
        )
        .orderBy("movement_rank", "warehouse_code")
    )


def stock_reduction_plan(
    products: DataFrame,
    warehouses: DataFrame,
    lines: DataFrame,
    orders: DataFrame,
    rate: float = 0.20,
    places: Sequence[str] = ("East", "West"),
    drop: Sequence[str] = NOT_SOLD_STOCK,
    scale: HealthScale = ITEM_SCALE,
    ordered: bool = True,
) -> DataFrame:
    """Overstocked and dead products of some warehouses: units to cut and stock that remains.

    Dead stock goes entirely, otherwise ``rate`` of the stock, rounded down. The warehouse
    filter is applied before the sales are joined.
    """
    chosen = warehouses.filter(contains_any("warehouseName", places))
    items = stock_position(products, chosen, lines, orders, drop, True, scale)
    stock = F.col("quantityInStock")
    cut = F.when(F.col("units") == 0, stock).otherwise(F.floor(stock * exact(rate)))
    rows = (
        items.filter(F.col("health").isin(scale.overstock, scale.dead))
        .withColumn("cut", cut.cast("bigint"))
        .select(
            *_item_columns(),
            F.col("cut").alias("target_reduction_units"),
            (stock - F.col("cut")).alias("remaining_stock"),
        )
    )
    return in_order(rows, ordered, "total_units_sold", F.desc("current_stock"), "product_code")


def overstock_candidates(*tables: DataFrame, **options) -> DataFrame:
    """The reduction plan without the stock that remains."""
    return stock_reduction_plan(*tables, **options).drop("remaining_stock")


def restock_plan(
    products: DataFrame,
    warehouses: DataFrame,
    lines: DataFrame,
    orders: DataFrame,
    target: float = 2,
    drop: Sequence[str] = NOT_SOLD_STOCK,
    scale: HealthScale = ITEM_SCALE,
    ordered: bool = True,
) -> DataFrame:
    """Understocked products: stock to aim for, units to buy and what they cost."""
    items = stock_position(products, warehouses, lines, orders, drop, True, scale)
    aim = F.ceil(F.col("units") * exact(target)).cast("bigint")
    missing = F.greatest(F.col("aim") - F.col("quantityInStock"), F.lit(0))
    rows = (
        items.filter(F.col("health") == scale.restock)
        .withColumn("aim", aim)
        .withColumn("missing", missing)
        .select(
            *_item_columns(),
            F.col("aim").alias("healthy_target_stock"),
            F.col("missing").alias("required_restock_units"),
            (F.col("missing") * F.col("buyPrice")).alias("procurement_cost"),
        )
    )
    return in_order(rows, ordered, F.desc("required_restock_units"), "product_code")
