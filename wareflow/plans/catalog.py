"""Every report over the supplied tables, by name.

Reports at the grain of a dimension come in display order; those at product, customer or
order grain come unordered, since whoever writes them out needs no total order.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, DecimalType, StringType, StructType

from wareflow.functions import present, rules
from wareflow.functions.numbers import ratio, rounded, sample_deviation, steady
from wareflow.operators import clean, quality
from wareflow.operators.rollups import lines_of, product_sales, with_status
from wareflow.operators.whatif import reallocate, reallocate_scenarios
from wareflow.session import missing_settings
from wareflow.plans import customers, delivery, inventory, stock, territory, warehouse
from wareflow.sources import ingest, rollups, supplied, versions
from wareflow.sources.schemas import FOREIGN_KEYS, PRIMARY_KEYS, STATUSES, TABLES, TEXT_DATES
from wareflow.sources.scratch import new_path
from wareflow.sources.supplied import Supplied

CLOSE_SOUTH = {"moves": {"SMALL": "a", "LARGE": "c"}, "closed": ["d"]}
CLOSE_WEST = {"moves": {"MEDIUM": "b"}, "closed": ["c"]}
KEPT = {"b": 0.81, "c": 0.81}

# Region of each supplied country; NATION_0 is left out on purpose.
COUNTRY_REGIONS = {
    "NA": [f"NATION_{i}" for i in range(25) if i % 5 == 1],
    "APAC": [f"NATION_{i}" for i in range(25) if i % 5 == 2],
    "EMEA": [f"NATION_{i}" for i in range(1, 25) if i % 5 in (0, 3, 4)],
}

def model_tables(t: Supplied) -> dict[str, DataFrame]:
    """All tables of the data model by their names in the schema."""
    return {n: t.lines() if n == "orderdetails" else getattr(t, n)() for n in TABLES}


# --- cleaning and quality -------------------------------------------------------------

def normalize_dates(t: Supplied, whole_row: bool = False) -> DataFrame:
    return clean.normalize_dates(
        t.orders_with_text_dates(), ["orderDate", "requiredDate", "shippedDate"], whole_row=whole_row
    )


def normalize_dates_update(t: Supplied) -> DataFrame:
    """The same dates, as an update of a stored table of orders that rewrites only folders with such rows."""
    base = new_path(t.spark, "orders")
    versions.create(t.orders_with_text_dates().withColumn("batch", F.expr("orderNumber % 8")), base, "batch")
    versions.update(t.spark, base, *clean.text_date_update(TEXT_DATES))
    return versions.read(t.spark, base).drop("batch")


def ingest_reasons(t: Supplied) -> DataFrame:
    """Orders exported as text with the dates that people typed, and read back with declared types: what doesn't fit, by reason."""
    path = new_path(t.spark, "export")
    t.orders_with_text_dates().write.option("header", True).option("nullValue", "NULL").csv(path)
    schema = StructType.fromDDL("orderNumber BIGINT, orderDate DATE, requiredDate DATE, shippedDate DATE")
    checked, _ = ingest.read_csv_checked(t.spark, path, schema, PRIMARY_KEYS["orders"])
    return ingest.by_reason(checked)


def monthly_sales(t: Supplied) -> DataFrame:
    """Sales by product and month, from a stored roll-up to which the lines came in three batches."""
    base = new_path(t.spark, "sales")
    for batch in range(3):
        part = t.lines().where(F.expr(f"pmod(orderNumber, 3) = {batch}"))
        rollups.append(rollups.summary(part, t.orders()), base, str(batch))
    found = rollups.merged(t.spark, base, ["productCode", "month"])
    mean = rounded(ratio(F.col("price_sum"), F.col("n_lines")), 2)
    deviation = rounded(steady(sample_deviation(F.col("n_lines"), F.col("price_sum"), F.col("price_squares"))), 2)
    return found.select("productCode", "month", "n_lines", "units", "revenue", "price_low", "price_high", mean.alias("price_mean"), deviation.alias("price_deviation"))


def duplicate_keys(t: Supplied) -> DataFrame:
    return quality.duplicate_keys(
        {
            "Product Code": (t.products(), ["productCode"]),
            "Order Number": (t.orders(), ["orderNumber"]),
            "Order Line": (t.lines(), ["orderNumber", "orderLineNumber"]),
        }
    )


def key_audit(t: Supplied) -> DataFrame:
    return quality.key_audit({n: (df, PRIMARY_KEYS[n]) for n, df in model_tables(t).items()})


def orphan_audit(t: Supplied) -> DataFrame:
    tables = model_tables(t)
    return quality.orphan_audit(
        [
            (f"{child}.{col}", tables[child], col, tables[parent], parent_col)
            for child, col, parent, parent_col in FOREIGN_KEYS
        ]
    )


# --- groups of tables that several reports take ---------------------------------------

def sales_chain(t: Supplied) -> tuple[DataFrame, ...]:
    return t.lines(), t.orders(), t.customers(), t.employees(), t.offices()


def goods(t: Supplied) -> tuple[DataFrame, ...]:
    return t.products(), t.warehouses(), t.lines()


def goods_and_orders(t: Supplied) -> tuple[DataFrame, ...]:
    return *goods(t), t.orders()


def shipping(t: Supplied, comments: bool = False) -> tuple[DataFrame, ...]:
    return t.orders(comments), t.customers(), t.lines(), t.products(), t.warehouses()


def shipping_by_country_excl(t: Supplied) -> DataFrame:
    orders, *others = shipping(t)
    return delivery.shipping_by_country(orders, *others, exclude=delivery.slowest_order_number(orders))


def disputed(t: Supplied) -> DataFrame:
    return with_status(t.orders(), keep=["Disputed"])


def reallocate_any(t: Supplied) -> DataFrame:
    """Two lines swap homes, one source is cut back, nothing closes."""
    sales = product_sales(lines_of(t.lines(), with_status(t.orders(), keep=["Shipped"])))
    moves = {"ECONOMY": "c", "MEDIUM": "b"}
    return reallocate(t.products(), t.warehouses(), sales, moves, retention={"d": 0.9})


#: Scenario, product line, where it goes; scenario, closed warehouse; scenario, warehouse, fraction kept.
MOVES = "('south', 'SMALL', 'a'), ('south', 'LARGE', 'c'), ('west', 'MEDIUM', 'b'), ('west reduced', 'MEDIUM', 'b'), ('swap', 'ECONOMY', 'c'), ('swap', 'MEDIUM', 'b')"
CLOSED = "('south', 'd'), ('west', 'c'), ('west reduced', 'c')"
RETAINED = "('west reduced', 'b', 0.81), ('west reduced', 'c', 0.81), ('swap', 'd', 0.9)"


def reallocate_scenarios_at_once(t: Supplied) -> DataFrame:
    """The what-ifs of this catalog as tables, in one pass over the products."""
    sales = product_sales(lines_of(t.lines(), with_status(t.orders(), keep=["Shipped"])))
    moves = t.spark.sql(f"SELECT * FROM VALUES {MOVES} AS m(scenario, productLine, warehouseCode)")
    closed = t.spark.sql(f"SELECT * FROM VALUES {CLOSED} AS c(scenario, warehouseCode)")
    retained = t.spark.sql(f"SELECT * FROM VALUES {RETAINED} AS r(scenario, warehouseCode, kept)")
    return reallocate_scenarios(t.products(), t.warehouses(), sales, moves, closed, retained)


def warehouse_baseline_shown(t: Supplied) -> DataFrame:
    return present.report(
        warehouse.warehouse_baseline(*goods_and_orders(t)),
        money=["tied_capital", "historical_revenue"],
        counts=["current_stock"],
        percents=["occupied_capacity_pct"],
    )


def whatif_shown(t: Supplied) -> DataFrame:
    return present.report(
        warehouse.whatif_closure(*goods_and_orders(t), **CLOSE_WEST, retention=KEPT),
        money=["simulated_capital", "simulated_revenue"],
        counts=["simulated_stock"],
        percents=["simulated_capacity_pct"],
    )


REPORTS: dict[str, Callable[[Supplied], DataFrame]] = {
    # cleaning and quality
    "normalize_dates": normalize_dates,
    "normalize_dates_whole_row": lambda t: normalize_dates(t, whole_row=True),
    "normalize_dates_update": normalize_dates_update,
    "ingest_reasons": ingest_reasons,
    "duplicate_keys": duplicate_keys,
    "null_audit_payments": lambda t: quality.null_audit(
        t.payments(),
        {
            "customerNumber": "missing_customers",
            "checkNumber": "missing_check_number",
            "amount": "missing_amount",
        },
    ),
    "null_audit_orders": lambda t: quality.null_audit(
        t.orders(),
        {
            "orderDate": "missing_order_date",
            "requiredDate": "missing_required_date",
        },
    ),
    "null_audit_customers": lambda t: quality.null_audit(
        t.customers(),
        {
            "salesRepEmployeeNumber": "missing_sales_rep",
            "city": "missing_city",
            "customerNumber": "missing_customer",
            "country": "missing_country",
        },
    ),
    "office_territories": lambda t: territory.office_territories(t.offices(cleaned=False)),
    "territory_override": lambda t: territory.office_territories(t.offices()),
    "key_audit": key_audit,
    "orphan_audit": orphan_audit,
    # territories
    "territory_sales_share": lambda t: territory.territory_sales_share(*sales_chain(t)),
    "territory_line_rank": lambda t: territory.territory_line_rank(*sales_chain(t), t.products()),
    "regional_price_gap": lambda t: territory.regional_price_gap(
        *sales_chain(t), t.products(), ordered=False
    ),
    "regional_price_gap_corrected": lambda t: territory.regional_price_gap(
        *sales_chain(t), t.products(), corrected=True, ordered=False
    ),
    "warehouse_to_territory": lambda t: territory.warehouse_to_territory(
        *sales_chain(t), t.products(), t.warehouses()
    ),
    # customers, status, comments
    "inactive_customers": lambda t: customers.inactive_customers(t.customers(), t.orders()),
    "active_countries": lambda t: customers.active_countries(
        t.customers(), t.orders(), COUNTRY_REGIONS
    ),
    "customer_friction": lambda t: customers.customer_friction(
        t.customers(), t.orders(comments=True), t.employees(), ordered=False
    ),
    "customer_comments": lambda t: customers.customer_comments(t.orders(comments=True)),
    "order_status_share": lambda t: customers.order_status_share(t.orders()),
    "folded_status_share": lambda t: customers.order_status_share(
        clean.fold_text(t.orders_as_typed(), {"status": STATUSES})
    ),
    "order_exceptions": lambda t: customers.order_exceptions(
        t.orders(comments=True),
        t.lines(),
        t.products(),
        t.warehouses(),
        t.customers(),
        ordered=False,
    ),
    "disputed_products": lambda t: customers.products_in_orders(
        t.lines(), t.products(), disputed(t)
    ),
    "disputed_product_orders": lambda t: customers.products_and_orders(
        t.lines(), t.products(), disputed(t)
    ),
    "keyword_classify": lambda t: customers.keyword_classes(
        t.scan("documents"), "doc_id", "text", *supplied.REASONS
    ),
    "keyword_classify_exceptions": lambda t: customers.keyword_classes(
        t.orders(comments=True), "orderNumber", "comments",
        rules.EXCEPTION_RULES, rules.EXCEPTION_BLANK, rules.EXCEPTION_OTHER,
    ),
    "keyword_classify_delays": lambda t: customers.keyword_classes(
        t.orders(comments=True), "orderNumber", "comments",
        rules.DELAY_RULES, rules.DELAY_BLANK, rules.DELAY_OTHER,
    ),
    "keyword_friction_flags": lambda t: t.orders(comments=True).select(
        "orderNumber",
        rules.friction_flag("comments", rules.FRICTION_ALLOW, rules.FRICTION_PROBLEM).alias("flag"),
    ),
    # delivery
    "delivery_performance": lambda t: delivery.delivery_performance(t.orders()),
    "shipping_by_country": lambda t: delivery.shipping_by_country(*shipping(t)),
    "shipping_by_country_corrected": lambda t: delivery.shipping_by_country(
        *shipping(t), corrected=True
    ),
    "shipping_by_country_excl": shipping_by_country_excl,
    "slowest_orders": lambda t: delivery.slowest_orders(
        *shipping(t, comments=True), ordered=False
    ),
    # inventory and stock
    "line_stock_vs_sales": lambda t: inventory.line_stock_vs_sales(
        t.lines(), t.orders(), t.products(), t.warehouses()
    ),
    "product_revenue": lambda t: inventory.product_revenue(*goods(t), ordered=False),
    "product_revenue_corrected": lambda t: inventory.product_revenue(
        *goods_and_orders(t), corrected=True, ordered=False
    ),
    "monthly_sales": monthly_sales,
    "product_rank": lambda t: inventory.product_rank(*goods(t)),
    "top_bottom_products": lambda t: inventory.top_bottom_products(*goods(t)),
    "top_bottom_products_corrected": lambda t: inventory.top_bottom_products(
        *goods_and_orders(t), drop=["Cancelled"]
    ),
    "stock_health": lambda t: stock.stock_health(*goods_and_orders(t), ordered=False),
    "stock_health_corrected": lambda t: stock.stock_health(
        *goods_and_orders(t), corrected=True, ordered=False
    ),
    "warehouse_health_pct": lambda t: stock.warehouse_health_pct(*goods(t)),
    "warehouse_movement_rank": lambda t: stock.warehouse_movement_rank(*goods_and_orders(t)),
    "warehouse_movement_rank_corrected": lambda t: stock.warehouse_movement_rank(
        *goods_and_orders(t), corrected=True
    ),
    "stock_reduction_plan": lambda t: stock.stock_reduction_plan(*goods_and_orders(t), ordered=False),
    "overstock_candidates": lambda t: stock.overstock_candidates(
        *goods_and_orders(t), ordered=False
    ),
    "restock_plan": lambda t: stock.restock_plan(*goods_and_orders(t), ordered=False),
    # warehouses
    "warehouse_capacity_rank": lambda t: warehouse.warehouse_capacity_rank(
        t.products(), t.warehouses()
    ),
    "warehouse_diversity": lambda t: warehouse.warehouse_diversity(t.products(), t.warehouses()),
    "warehouse_baseline": lambda t: warehouse.warehouse_baseline(*goods_and_orders(t)),
    "warehouse_baseline_shown": warehouse_baseline_shown,
    "whatif_close_south": lambda t: warehouse.whatif_closure(*goods_and_orders(t), **CLOSE_SOUTH),
    "whatif_close_west": lambda t: warehouse.whatif_closure(*goods_and_orders(t), **CLOSE_WEST),
    "whatif_close_west_reduced": lambda t: warehouse.whatif_closure(
        *goods_and_orders(t), **CLOSE_WEST, retention=KEPT
    ),
    "whatif_close_west_reduced_shown": whatif_shown,
    "reallocate": reallocate_any,
    "reallocate_scenarios": reallocate_scenarios_at_once,
}


def plain_types(df: DataFrame) -> DataFrame:
    """Decimals as doubles, dates as ISO text and texts without a collation, for comparison with another engine."""
    kinds = {DecimalType: "double", DateType: "string", StringType: "string"}
    return df.select(
        *[
            F.col(f.name).cast(kinds[type(f.dataType)]).alias(f.name)
            if type(f.dataType) in kinds and f.dataType != StringType()
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def run(name: str, spark: SparkSession, base: str) -> DataFrame:
    """A report in the caller's session, which stays as it is; see wareflow.session."""
    if missing := missing_settings(spark):
        warnings.warn(f"hot keys are split only with {', '.join(missing)}", stacklevel=2)
    return plain_types(REPORTS[name](Supplied(spark, base)))
