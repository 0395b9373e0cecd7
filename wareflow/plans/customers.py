"""Customer activity, order status and comments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wareflow.functions.numbers import percent
from wareflow.functions.present import in_order
from wareflow.functions.rules import (
    CLIENT_DIFFICULT,
    CLIENT_INACTIVE,
    CLIENT_NORMAL,
    EXCEPTION_BLANK,
    EXCEPTION_OTHER,
    EXCEPTION_RULES,
    FRICTION_ALLOW,
    FRICTION_PROBLEM,
    NO_REP,
    REGION_OTHER,
    REGIONS,
    Rules,
    friction_flag,
    keyword_label,
    region_of,
)
from wareflow.functions.text import fold, least_spelling, name_list, text_in
from wareflow.operators.rollups import left_join_spread, order_places
from wareflow.operators.shares import share_of_total
from wareflow.sources.rollups import distinct_estimate, distinct_sketch


def orders_per_customer(orders: DataFrame) -> DataFrame:
    """Order numbers are unique, so counting rows counts orders."""
    return orders.groupBy("customerNumber").agg(F.count(F.lit(1)).alias("n_orders"))


def inactive_customers(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """One row: customers without any order, and their percentage of all customers."""
    active = orders_per_customer(orders)
    seen = customers.select("customerNumber").join(active, "customerNumber", "left")
    return seen.agg(
        F.count_if(F.col("n_orders").isNull()).alias("inactive_customers"),
        F.count(F.lit(1)).alias("n"),
    ).select(
        "inactive_customers", percent(F.col("inactive_customers"), F.col("n")).alias("inactive_pct")
    )


def active_countries(
    customers: DataFrame,
    orders: DataFrame,
    regions: Mapping[str, Sequence[str]] = REGIONS,
    other: str = REGION_OTHER,
) -> DataFrame:
    """Customers with orders, and their orders, per country and its region."""
    return (
        customers.select("customerNumber", "country")
        .join(orders_per_customer(orders), "customerNumber")
        .groupBy(region_of("country", regions, other).alias("region"), "country")
        .agg(
            least_spelling("country").alias("shown"),
            F.count(F.lit(1)).alias("active_customers"),
            F.sum("n_orders").alias("total_orders"),
        )
        .select("region", F.col("shown").alias("country"), "active_customers", "total_orders")
        .orderBy(F.desc("region"), F.desc("total_orders"), "country")
    )


def customer_friction(
    customers: DataFrame,
    orders: DataFrame,
    employees: DataFrame,
    allow: str = FRICTION_ALLOW,
    problem: str = FRICTION_PROBLEM,
    ordered: bool = True,
) -> DataFrame:
    """Per customer: orders, flagged orders, status class and number of distinct comments.

    Comments are read whole where they are scanned and leave as a flag and a digest. The
    comments themselves are in ``customer_comments``, one row each: a single text of all
    comments of one customer has no bound.
    """
    per_customer = (
        orders.select(
            "customerNumber",
            friction_flag("comments", allow, problem).alias("flag"),
            F.sha2(fold("comments"), 256).alias("digest"),
        )
        .groupBy("customerNumber")
        .agg(
            F.count(F.lit(1)).alias("n_orders"),
            F.sum("flag").alias("flags"),
            F.count_distinct("digest").alias("distinct_comments"),
        )
    )
    reps = employees.select(
        "employeeNumber", F.concat("firstName", F.lit(" "), "lastName").alias("rep_name")
    )
    rolled = customers.select(
        "customerNumber", "customerName", "country", "salesRepEmployeeNumber"
    ).join(per_customer, "customerNumber", "left")
    n_orders, flags = (F.coalesce(c, F.lit(0)) for c in ("n_orders", "flags"))
    rows = (
        left_join_spread(
            rolled, reps, "salesRepEmployeeNumber", "employeeNumber", ["customerNumber"]
        )
        .select(
            "country",
            F.col("customerNumber").alias("customer_number"),
            F.col("customerName").alias("customer_name"),
            F.coalesce("rep_name", F.lit(NO_REP)).alias("sales_representative"),
            n_orders.alias("total_orders"),
            F.when(n_orders == 0, CLIENT_INACTIVE)
            .when(flags > 0, CLIENT_DIFFICULT)
            .otherwise(CLIENT_NORMAL)
            .alias("client_status"),
            F.concat_ws(" of ", flags.cast("string"), n_orders.cast("string")).alias(
                "friction_ratio"
            ),
            F.coalesce("distinct_comments", F.lit(0)).alias("distinct_comments"),
        )
    )
    return in_order(rows, ordered, F.desc("client_status"), "country", F.desc("total_orders"), "customer_number")


def customer_comments(orders: DataFrame) -> DataFrame:
    """Every distinct comment of every customer, whole, with the orders that carry it. Comments
    that differ in case or trailing blanks are one, shown in its least spelling."""
    return (
        orders.filter(F.col("comments").isNotNull())
        .groupBy(F.col("customerNumber").alias("customer_number"), fold("comments"))
        .agg(F.min(F.rtrim("comments")).alias("comments"), F.count(F.lit(1)).alias("n_orders"))
        .select("customer_number", "comments", "n_orders")
    )


def order_status_share(orders: DataFrame) -> DataFrame:
    shares = share_of_total(orders, [F.col("status").alias("order_status")])
    return shares.select(
        "order_status", F.col("n").alias("total_orders"), F.col("pct").alias("pct_of_total")
    ).orderBy(F.desc("total_orders"), "order_status")


def order_exceptions(
    orders: DataFrame,
    lines: DataFrame,
    products: DataFrame,
    warehouses: DataFrame,
    customers: DataFrame,
    statuses: Sequence[str] = ("Disputed", "Cancelled", "Resolved"),
    cancelled: Sequence[str] = ("Cancelled",),
    rules: Rules = EXCEPTION_RULES,
    blank: str = EXCEPTION_BLANK,
    other: str = EXCEPTION_OTHER,
    ordered: bool = True,
) -> DataFrame:
    """Each order in one of ``statuses``: its product lines and warehouses, the units lost to
    cancellation, and the reason its comment gives. Orders without lines stay."""
    chosen = orders.filter(text_in("status", statuses))
    wanted = lines.join(chosen.select("orderNumber"), "orderNumber", "left_semi")
    footprint = (
        order_places(wanted, products, warehouses, "productLine", "warehouseName", how="left")
        .groupBy("orderNumber")
        .agg(
            name_list("productLine").alias("affected_product_lines"),
            name_list("warehouseName").alias("affected_warehouses"),
            F.sum("units").alias("units"),
        )
    )
    rows = (
        chosen.select(
            "orderNumber",
            "customerNumber",
            "status",
            keyword_label("comments", rules, blank, other).alias("reason"),
        )
        .join(footprint, "orderNumber", "left")
        .join(customers.select("customerNumber", "country"), "customerNumber", "left")
        .select(
            F.col("orderNumber").alias("order_number"),
            F.col("customerNumber").alias("customer_number"),
            "country",
            "affected_product_lines",
            "affected_warehouses",
            F.when(text_in("status", cancelled), F.coalesce("units", F.lit(0)))
            .otherwise(0)
            .alias("total_items_cancelled"),
            "status",
            "reason",
        )
    )
    return in_order(rows, ordered, "reason", "order_number")


def _products_of(
    lines: DataFrame, products: DataFrame, wanted: DataFrame | Sequence[int]
) -> DataFrame:
    """(product, order) pairs of the wanted orders, with the number of lines."""
    if isinstance(wanted, DataFrame):
        kept = lines.join(wanted.select("orderNumber"), "orderNumber", "left_semi")
    else:
        kept = lines.filter(F.col("orderNumber").isin(*wanted))
    return (
        kept.groupBy("productCode", "orderNumber")
        .agg(F.count(F.lit(1)).alias("n"))
        .join(products.select("productCode", "productName"), "productCode")
    )


def products_in_orders(
    lines: DataFrame, products: DataFrame, wanted: DataFrame | Sequence[int], approximate: bool = False
) -> DataFrame:
    """Products on the ``wanted`` orders (a list or a table of order numbers): on how many lines,
    and on how many of the orders. Which ones is in ``products_and_orders``: a list of the orders of
    one product has no bound. ``approximate`` counts orders by sketches (within about 1 %), which leave each task as a few
    kilobytes for each product instead of as all its order numbers."""
    orders = distinct_estimate(distinct_sketch("orderNumber")) if approximate else F.count_distinct("orderNumber")
    return (
        _products_of(lines, products, wanted)
        .groupBy("productName")
        .agg(
            least_spelling("productName").alias("product_name"),
            F.sum("n").alias("times_disputed"),
            orders.alias("orders_involved"),
        )
        .drop("productName")
        .orderBy(F.desc("times_disputed"), "product_name")
    )


def products_and_orders(
    lines: DataFrame, products: DataFrame, wanted: DataFrame | Sequence[int]
) -> DataFrame:
    """Each product with each of the ``wanted`` orders that has it, and on how many lines."""
    return (
        _products_of(lines, products, wanted)
        .groupBy("productName", F.col("orderNumber").alias("order_number"))
        .agg(least_spelling("productName").alias("product_name"), F.sum("n").alias("times_disputed"))
        .select("product_name", "order_number", "times_disputed")
    )


def keyword_classes(
    df: DataFrame, key: str, col: str, rules: Rules, blank: str, other: str
) -> DataFrame:
    """The class of each text under any rule set."""
    return df.select(key, keyword_label(col, rules, blank, other).alias("keyword_class"))
