"""Stock against units sold, per product."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareflow.functions.numbers import exact
from wareflow.functions.text import text_in
from wareflow.operators.rollups import lines_of, located_products, with_status


@dataclass(frozen=True)
class HealthScale:
    """Class thresholds, in multiples of the units sold, and the four class names."""

    # Thresholds and class names.
    over: float = 3
    under: float = 1
    dead: str = "Absolute Dead (0 Sales)"
    overstock: str = "Severely Overstock"
    restock: str = "Restock needed"
    balanced: str = "Balanced"

    def classify(self, stock: Column, units: Column) -> Column:
        units = F.coalesce(units, F.lit(0))
        return (
            F.when(units == 0, self.dead)
            .when(stock > units * exact(self.over), self.overstock)
            .when(stock < units * exact(self.under), self.restock)
            .otherwise(self.balanced)
        )


# Status sets as the reports use them. 'In progress' occurs in no data, so
# orders in process count as sold in the reports that use the first set.
NOT_SOLD_STOCK = ("Cancelled", "On Hold", "In progress")
NOT_SOLD_REVENUE = ("On Hold", "Cancelled", "In Process")

ITEM_SCALE = HealthScale()
WAREHOUSE_SCALE = HealthScale(
    under=0.7,
    dead="Absolute Dead",
    overstock="Severe Overstock",
    restock="Severe Understock",
    balanced="Normal Balance",
)


def sold_units(
    products: DataFrame,
    lines: DataFrame,
    orders: DataFrame | None = None,
    drop: Sequence[str] = (),
    keep_unsold: bool = True,
) -> DataFrame:
    """Products with the ``units`` sold (NULL when there are none).

    Without ``orders`` every line counts and every product stays. With them, lines of orders
    in a ``drop`` status do not count. ``keep_unsold=False`` keeps only products with a
    counted line; ``True`` also keeps those without any line. A product whose lines were all
    dropped is in neither result.
    """
    if orders is None:
        units = lines.groupBy("productCode").agg(F.sum("quantityOrdered").alias("units"))
        return products.join(units, "productCode", "left" if keep_unsold else "inner")
    if not keep_unsold:
        sold = lines_of(lines, with_status(orders, drop=drop))
        units = sold.groupBy("productCode").agg(F.sum("quantityOrdered").alias("units"))
        return products.join(units, "productCode")
    # a line whose order or status is unknown counts
    counts = F.coalesce(~text_in("status", drop), F.lit(True))
    units = (
        lines.join(orders.select("orderNumber", "status"), "orderNumber", "left")
        .groupBy("productCode")
        .agg(
            F.sum(F.when(counts, F.col("quantityOrdered"))).alias("units"),
            F.count_if(counts).alias("counted_lines"),
        )
    )
    return (
        products.join(units, "productCode", "left")
        .filter(F.col("counted_lines").isNull() | (F.col("counted_lines") > 0))
        .drop("counted_lines")
    )


def stock_position(
    products: DataFrame,
    warehouses: DataFrame,
    lines: DataFrame,
    orders: DataFrame | None = None,
    drop: Sequence[str] = (),
    keep_unsold: bool = True,
    scale: HealthScale = ITEM_SCALE,
) -> DataFrame:
    """Product grain: warehouse, stock, units sold (0 when unsold) and health class."""
    position = sold_units(
        located_products(products, warehouses), lines, orders, drop, keep_unsold
    )
    return position.withColumn(
        "health", scale.classify(F.col("quantityInStock"), F.col("units"))
    ).withColumn("units", F.coalesce("units", F.lit(0)))
