"""Sales and prices by territory."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wareflow.functions.numbers import percent, rounded, steady
from wareflow.functions.present import in_order
from wareflow.operators.rollups import (
    customer_territory,
    lines_of,
    order_revenue,
    order_territory,
    order_units,
    revenue,
)
from wareflow.operators.shares import (
    pivot_stats,
    pivot_sums,
    rounded_cols,
    share_and_rank,
    spread_of,
)

TERRITORIES = ("NA", "EMEA", "APAC")


def office_territories(offices: DataFrame) -> DataFrame:
    return offices.select("officeCode", "city", "country", "territory").orderBy(
        "territory", "country", "officeCode"
    )


def territory_sales_share(
    lines: DataFrame, orders: DataFrame, customers: DataFrame, employees: DataFrame, offices: DataFrame
) -> DataFrame:
    """Per territory: offices with sales, revenue, revenue of all, share in whole percent.

    Revenue climbs from order to customer to office, one aggregate per step, so neither a
    large order nor a large customer meets a join as raw rows.
    """
    by_customer = (
        order_revenue(lines)
        .join(orders.select("orderNumber", "customerNumber"), "orderNumber")
        .groupBy("customerNumber")
        .agg(F.sum("revenue").alias("revenue"))
    )
    by_office = (
        by_customer.join(customer_territory(customers, employees, offices), "customerNumber")
        .groupBy("territory", "officeCode")
        .agg(F.sum("revenue").alias("revenue"))
    )
    every = Window.partitionBy()  # over territories only
    return (
        by_office.groupBy("territory")
        .agg(
            F.count(F.lit(1)).alias("offices_in_region"),
            F.sum("revenue").alias("region_sales"),
        )
        .withColumn("grand_total_sales", F.sum("region_sales").over(every))
        .withColumn(
            "market_share_pct", percent(F.col("region_sales"), F.col("grand_total_sales"), 0)
        )
    )


def territory_line_rank(
    lines: DataFrame,
    orders: DataFrame,
    customers: DataFrame,
    employees: DataFrame,
    offices: DataFrame,
    products: DataFrame,
) -> DataFrame:
    """Revenue of each product line in each territory, its percentage and rank there.

    Lines take the territory of their order and shrink to (product, territory) before they
    meet the products.
    """
    homes = order_territory(orders, customers, employees, offices)
    sold = (
        lines_of(lines, homes, "territory")
        .groupBy("productCode", "territory")
        .agg(F.sum(revenue()).alias("product_sales"))
        .join(products.select("productCode", "productLine"), "productCode")
    )
    ranked = share_and_rank(sold, ["territory", "productLine"], ["territory"], "product_sales")
    return ranked.select(
        "territory",
        F.col("productLine").alias("product_line"),
        "product_sales",
        F.col("pct").alias("sales_pct"),
        F.col("rank").alias("region_rank"),
    ).orderBy("territory", "region_rank", "product_line")


def regional_price_gap(
    lines: DataFrame,
    orders: DataFrame,
    customers: DataFrame,
    employees: DataFrame,
    offices: DataFrame,
    products: DataFrame,
    territories: Sequence[str] = TERRITORIES,
    corrected: bool = False,
    ordered: bool = True,
) -> DataFrame:
    """Per product: average price, deviation and standard error in each territory, and the
    widest difference between territory averages. ``corrected`` leaves that difference NULL
    for a product sold in fewer than two of the territories."""
    homes = order_territory(orders, customers, employees, offices)
    priced = lines_of(lines, homes, "territory")
    stats = pivot_stats(priced, ["productCode"], "territory", territories, "priceEach")
    names = [t.lower() for t in territories]
    gap = spread_of([f"avg_{t}" for t in names], as_written=not corrected)
    rows = (
        stats.join(products.select("productCode", "productName", "productLine"), "productCode")
        .select(
            F.col("productCode").alias("product_code"),
            F.col("productName").alias("product_name"),
            F.col("productLine").alias("product_line"),
            *rounded_cols({f"avg_price_{t}": f"avg_{t}" for t in names}),
            *[rounded(steady(F.col(f"std_{t}")), 2).alias(f"std_dev_{t}") for t in names],
            *[rounded(steady(F.col(f"err_{t}")), 2).alias(f"std_error_{t}") for t in names],
            rounded(gap, 2).alias("max_price_difference"),
        )
    )
    return in_order(rows, ordered, F.desc("max_price_difference"), "product_code")


def warehouse_to_territory(
    lines: DataFrame,
    orders: DataFrame,
    customers: DataFrame,
    employees: DataFrame,
    offices: DataFrame,
    products: DataFrame,
    warehouses: DataFrame,
    names: Sequence[str] = ("North", "East", "West", "South"),
) -> DataFrame:
    """Units of shipped orders per territory, one column per warehouse, and the orders.

    Lines shrink to one row per order with the warehouse columns already in place; counting
    orders is then counting rows, without a distinct.
    """
    columns = {f"from_{n.lower()}": n for n in names}
    units = order_units(
        lines,
        products,
        warehouses,
        *pivot_sums("warehouseName", columns, "quantityOrdered"),
        F.sum("quantityOrdered").alias("units"),
    )
    shipped = orders.filter(F.col("shippedDate").isNotNull())
    homes = order_territory(shipped, customers, employees, offices)
    return (
        units.join(homes, "orderNumber")
        .groupBy(F.col("territory").alias("destination_region"))
        .agg(
            F.count(F.lit(1)).alias("total_orders_shipped"),
            *[F.sum(c).alias(c) for c in columns],
            F.sum("units").alias("grand_total_units"),
        )
        .orderBy(F.desc("grand_total_units"), "destination_region")
    )
