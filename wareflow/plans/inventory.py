"""Stock against sales, by product line and by product."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wareflow.functions.numbers import percent, ratio, rounded, sample_deviation, std_error, steady
from wareflow.functions.present import in_order, text_or
from wareflow.operators.ranks import dense_rank_desc
from wareflow.operators.rollups import (
    first_of_order,
    lines_of,
    located_products,
    product_sales,
    revenue,
    stock_by,
    with_status,
)
from wareflow.operators.shares import top_bottom


def line_stock_vs_sales(
    lines: DataFrame,
    orders: DataFrame,
    products: DataFrame,
    warehouses: DataFrame,
    statuses: Sequence[str] = ("Shipped",),
) -> DataFrame:
    """Per warehouse and product line: stock and capital against units, revenue and price
    spread of the orders in ``statuses``."""
    group = ["warehouseCode", "warehouseName", "productLine"]
    place = located_products(products, warehouses).select("productCode", *group)
    price = F.col("priceEach")
    by_product = (
        lines_of(lines, with_status(orders, keep=statuses))
        .groupBy("productCode")
        .agg(
            F.sum("quantityOrdered").alias("units"),
            F.sum(revenue()).alias("revenue"),
            F.count(price).alias("n"),
            F.sum(price).alias("prices"),
            F.sum(price * price).alias("squares"),
        )
    )
    # The deviation of a group follows from the exact sums of its products.
    sums = [F.sum(c).alias(c) for c in ("units", "revenue", "n", "prices", "squares")]
    sold = (
        by_product.join(place, "productCode")
        .groupBy(*group)
        .agg(*sums, F.count(F.lit(1)).alias("unique_products"))
        .withColumn("deviation", sample_deviation(F.col("n"), F.col("prices"), F.col("squares")))
    )
    held = stock_by(products, "warehouseCode", "productLine").drop("n_products")
    every = Window.partitionBy()  # over (warehouse, product line) groups only
    units, stock = F.col("units"), F.col("stock")
    return (
        sold.join(held, ["warehouseCode", "productLine"])
        .select(
            F.col("warehouseName").alias("warehouse_name"),
            F.col("productLine").alias("product_line"),
            stock.alias("units_stock"),
            units.alias("units_sold"),
            "unique_products",
            percent(units, F.sum("units").over(every)).alias("pct_of_total_sales"),
            percent(units, stock + units, 1).alias("sold_to_stock_ratio"),
            F.col("capital").alias("tied_capital"),
            F.col("revenue").alias("total_revenue"),
            F.coalesce(rounded(ratio(F.col("revenue"), units), 2), F.lit(0)).alias(
                "average_revenue_per_unit"
            ),
            F.coalesce(rounded(steady(F.col("deviation")), 2), F.lit(0)).alias("price_stddev"),
            F.coalesce(rounded(steady(std_error(F.col("deviation"), F.col("n"))), 2), F.lit(0)).alias(
                "std_error"
            ),
        )
        .orderBy(F.desc("pct_of_total_sales"), "warehouse_name", "product_line")
    )


def product_revenue(
    products: DataFrame,
    warehouses: DataFrame,
    lines: DataFrame,
    orders: DataFrame | None = None,
    corrected: bool = False,
    drop: Sequence[str] = ("Cancelled",),
    ordered: bool = True,
) -> DataFrame:
    """Every product with units, orders, revenue and revenue per unit, smallest revenue first.

    As written the status test does not remove lines, so the orders are not needed at all;
    ``corrected`` counts only lines of orders outside ``drop``.
    """
    if corrected:
        lines = lines_of(lines, with_status(orders, drop=drop))
    sold = lines.withColumn("first", first_of_order()).groupBy("productCode").agg(
        F.sum("quantityOrdered").alias("units"),
        F.count_if("first").alias("n_orders"),
        F.sum(revenue()).alias("revenue"),
    )
    per_unit = rounded(ratio(F.col("revenue"), F.col("units")), 2)
    rows = (
        located_products(products, warehouses)
        .join(sold, "productCode", "left")
        .select(
            F.col("productCode").alias("product_code"),
            F.col("productName").alias("product_name"),
            F.col("warehouseName").alias("warehouse_name"),
            F.coalesce("units", F.lit(0)).alias("total_units_sold"),
            F.col("quantityInStock").alias("in_stock_units"),
            F.coalesce("n_orders", F.lit(0)).alias("total_sales_transactions"),
            F.coalesce("revenue", F.lit(0)).alias("total_revenue"),
            F.coalesce(per_unit, F.lit(0)).alias("average_revenue_per_unit"),
        )
    )
    return in_order(rows, ordered, "total_revenue", "product_code")


def product_rank(products: DataFrame, warehouses: DataFrame, lines: DataFrame, ranges: int = 64) -> DataFrame:
    """Every product with its warehouse, units, revenue and DENSE_RANK by revenue among all products.

    Ranks are made by ranges of revenue, so any number of products is ranked without bringing them to one task.
    """
    sold = product_sales(lines).drop("n_lines")
    rows = located_products(products, warehouses, "left").join(sold, "productCode", "left")
    rows = rows.select(
        F.col("productCode").alias("product_code"),
        F.col("productName").alias("product_name"),
        F.col("warehouseName").alias("warehouse_name"),
        F.coalesce("units", F.lit(0)).alias("total_units_sold"),
        F.coalesce("revenue", F.lit(0)).alias("total_revenue"),
    )
    return dense_rank_desc(rows, "total_revenue", "revenue_rank", ranges)


def top_bottom_products(
    products: DataFrame,
    warehouses: DataFrame,
    lines: DataFrame,
    orders: DataFrame | None = None,
    drop: Sequence[str] = (),
    n: int = 5,
) -> DataFrame:
    """The ``n`` least and ``n`` most sold products with their price range. Lines of every
    order count unless ``orders`` and statuses to ``drop`` are given."""
    if orders is not None:
        lines = lines_of(lines, with_status(orders, drop=drop))
    sold = lines.groupBy("productCode").agg(
        F.sum("quantityOrdered").alias("units"),
        F.sum(revenue()).alias("revenue"),
        F.min("priceEach").alias("low"),
        F.max("priceEach").alias("high"),
    )
    rows = (
        located_products(products, warehouses, "left")
        .join(sold, "productCode", "left")
        .select(
            F.col("warehouseName").alias("warehouse_name"),
            F.col("productCode").alias("product_code"),
            F.col("productName").alias("product_name"),
            F.col("productLine").alias("product_line"),
            text_or(F.col("low"), "NaN").alias("lowest_price_sold"),
            text_or(F.col("high"), "NaN").alias("highest_price_sold"),
            F.coalesce("units", F.lit(0)).alias("total_units_sold"),
            F.col("quantityInStock").alias("in_stock_units"),
            F.coalesce("revenue", F.lit(0)).alias("total_revenue"),
        )
    )
    return top_bottom(
        rows, "total_units_sold", n, "product_code", ("LEAST SOLD", "MOST SOLD")
    ).orderBy(F.desc("sales_rank"), F.desc("total_units_sold"), "product_code")
