"""Order lines reduced to the grain a report needs, before they meet other tables.

Lines are by far the largest table. The roll-ups here are plain ``groupBy`` aggregates, so
each task combines its own rows first: an order, product or customer that holds a large part
of all lines leaves every map task as one row. A roll-up by order number also leaves its
output hashed the way the join with the orders needs it, so the lines move once.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wareflow.functions.text import text_in


def revenue() -> Column:
    """Exact decimal value of a line."""
    return F.col("quantityOrdered") * F.col("priceEach")


def with_status(orders: DataFrame, keep: Iterable[str] = (), drop: Iterable[str] = ()) -> DataFrame:
    """Orders whose status is in ``keep`` (if given) and not in ``drop``. A NULL status
    passes neither test."""
    if keep:
        orders = orders.filter(text_in("status", keep))
    if drop:
        orders = orders.filter(~text_in("status", drop))
    return orders


def lines_of(lines: DataFrame, orders: DataFrame, *order_cols: str) -> DataFrame:
    """Lines of the given orders. Every use aggregates by another key than the order number
    afterwards, so adaptive execution is free to split an order that holds many lines."""
    return lines.join(orders.select("orderNumber", *order_cols), "orderNumber")


def first_of_order() -> Column:
    """True on one of the lines that an order has of a product, so that counting them by product counts distinct orders.

    There are nearly as many such pairs as lines. A distinct count beside other sums holds each pair with its
    sums in two hash tables; here rows are sorted by pair, which holds less of them and spills.
    """
    pair = Window.partitionBy("productCode", "orderNumber").orderBy("orderNumber")
    return F.col("orderNumber").isNotNull() & (F.row_number().over(pair) == 1)


def order_revenue(lines: DataFrame) -> DataFrame:
    return lines.groupBy("orderNumber").agg(F.sum(revenue()).alias("revenue"))


def product_sales(lines: DataFrame) -> DataFrame:
    """Per product: units, revenue and number of lines."""
    return lines.groupBy("productCode").agg(
        F.sum("quantityOrdered").alias("units"),
        F.sum(revenue()).alias("revenue"),
        F.count(F.lit(1)).alias("n_lines"),
    )


def customer_territory(customers: DataFrame, employees: DataFrame, offices: DataFrame) -> DataFrame:
    """Customer -> office and territory of the sales rep. Customers without a rep drop out."""
    return (
        customers.select("customerNumber", "salesRepEmployeeNumber")
        .join(
            employees.select("employeeNumber", "officeCode"),
            F.col("salesRepEmployeeNumber") == F.col("employeeNumber"),
        )
        .join(offices.select("officeCode", "territory"), "officeCode")
        .select("customerNumber", "officeCode", "territory")
    )


def order_territory(
    orders: DataFrame, customers: DataFrame, employees: DataFrame, offices: DataFrame
) -> DataFrame:
    """Order -> territory."""
    homes = customer_territory(customers, employees, offices).select("customerNumber", "territory")
    return orders.select("orderNumber", "customerNumber").join(homes, "customerNumber").select(
        "orderNumber", "territory"
    )


def located_products(products: DataFrame, warehouses: DataFrame, how: str = "inner") -> DataFrame:
    """Products with the name of their warehouse. ``warehouses`` is a handful of rows."""
    return products.join(
        warehouses.select("warehouseCode", "warehouseName"), "warehouseCode", how
    )


def order_places(
    lines: DataFrame,
    products: DataFrame,
    warehouses: DataFrame,
    *by: str,
    how: str = "inner",
) -> DataFrame:
    """Lines and units of each order by some of productLine and warehouseName.

    Sums of numbers only, so each task hashes its lines whatever their number; names are
    collected later, from what is left.
    """
    place = located_products(products, warehouses, how).select("productCode", *by)
    return (
        lines.join(place, "productCode", how)
        .groupBy("orderNumber", *by)
        .agg(F.count(F.lit(1)).alias("n_lines"), F.sum("quantityOrdered").alias("units"))
    )


def order_units(
    lines: DataFrame, products: DataFrame, warehouses: DataFrame, *sums: Column
) -> DataFrame:
    """Sums over the lines of each order, which may use the name of their warehouse."""
    place = located_products(products, warehouses).select("productCode", "warehouseName")
    return lines.join(place, "productCode").groupBy("orderNumber").agg(*sums)


def stock_by(products: DataFrame, *by: str) -> DataFrame:
    """Stock, tied capital and number of products per group of products."""
    return products.groupBy(*by).agg(
        F.sum("quantityInStock").alias("stock"),
        F.sum(F.col("quantityInStock") * F.col("buyPrice")).alias("capital"),
        F.count(F.lit(1)).alias("n_products"),
    )


def left_join_spread(
    left: DataFrame, right: DataFrame, left_key: str, right_key: str, spread: Sequence[str]
) -> DataFrame:
    """Left join on a nullable key without gathering the NULL rows in one task.

    Rows without a key match nothing, yet an equi-join would hash them all to the same
    place. A second join key spreads them: the hash of the key on both sides, and the hash
    of ``spread`` on left rows without a key. It is derived from the data on both sides
    because a constant would be folded away and no longer take part in the shuffle.
    """
    def hashed(*cols: str) -> Column:
        return F.xxhash64(*[F.col(c).cast("string") for c in cols])

    place = F.when(F.col(left_key).isNull(), hashed(*spread)).otherwise(hashed(left_key))
    left = left.withColumn("_left_place", place)
    right = right.withColumn("_right_place", hashed(right_key))
    same = (F.col(left_key) == F.col(right_key)) & (F.col("_left_place") == F.col("_right_place"))
    return left.join(right, same, "left").drop("_left_place", "_right_place")
