"""What a change of product locations does to stock, capital, revenue and capacity."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wareflow.functions.numbers import exact, ratio, rounded
from wareflow.functions.text import distinct_list


def _choose(col: Column, pairs: Mapping[str, object], default: Column, value) -> Column:
    """``pairs`` as a literal CASE on ``col``: scenarios name a few lines or warehouses."""
    chain = default
    for key, out in pairs.items():
        chain = F.when(col == key, value(out)).otherwise(chain)
    return chain


def reallocate(
    products: DataFrame,
    warehouses: DataFrame,
    sales: DataFrame,
    moves: Mapping[str, str],
    closed: Iterable[str] = (),
    retention: Mapping[str, float] | None = None,
    receiver_tag: str = " (Consolidated)",
    unassigned: str = "Unassigned",
) -> DataFrame:
    """Warehouses after the product lines in ``moves`` (line -> warehouse code) have moved.

    ``sales`` is revenue per product. ``retention`` (code of the warehouse a product comes
    from -> fraction kept) cuts stock and capital, not revenue. Capacity scales a receiver's
    own percentage by new over old stock; other warehouses keep theirs. The products are
    read once, whatever the number of moves.

    No stock is lost: what stays in a closed warehouse, or lies in one that ``warehouses`` doesn't
    have, is in a row of its own code named ``unassigned``, without a capacity. A move to an unknown
    warehouse fails.
    """
    old = F.col("warehouseCode")
    kept = _choose(old, retention or {}, exact(1), exact)
    stock = F.col("quantityInStock")
    # (from, to, line) grain: a few rows, the only thing the products are aggregated to
    flows = (
        products.join(sales.select("productCode", "revenue"), "productCode", "left")
        .groupBy(
            old.alias("from_code"),
            _choose(F.col("productLine"), moves, old, F.lit).alias("warehouseCode"),
            "productLine",
        )
        .agg(
            F.sum(stock).alias("old_stock"),
            F.sum(stock * kept).alias("stock"),
            F.sum(stock * F.col("buyPrice") * kept).alias("capital"),
            F.sum("revenue").alias("revenue"),
        )
    )
    before = flows.groupBy(F.col("from_code").alias("warehouseCode")).agg(
        F.sum("old_stock").alias("old_stock")
    )
    after = flows.groupBy("warehouseCode").agg(
        F.sum("stock").alias("stock"),
        F.sum("capital").alias("capital"),
        F.sum("revenue").alias("revenue"),
        distinct_list("productLine").alias("product_lines"),
    )
    pct = F.col("warehousePctCap").cast("decimal(10,4)")
    receiver = F.col("warehouse_code").isin(*set(moves.values()))
    scaled = ratio(F.col("stock"), F.col("old_stock")) * pct
    open_now = ~F.col("w.warehouseCode").isin(*closed)
    known = F.col("w.warehouseCode").isNotNull()
    rows = (
        warehouses.alias("w")
        .join(after.alias("a"), F.col("w.warehouseCode") == F.col("a.warehouseCode"), "full")
        .select(
            F.coalesce("w.warehouseCode", "a.warehouseCode").alias("warehouse_code"),
            F.when(known & open_now, F.col("warehouseName")).alias("name"),
            F.when(known & open_now, pct).alias("warehousePctCap"),
            known.alias("known"),
            (known & open_now).alias("open"),
            "stock",
            "capital",
            "revenue",
            "product_lines",
        )
        .filter(F.col("open") | (F.col("stock") > 0) | (F.col("revenue") > 0))
        .join(before.withColumnRenamed("warehouseCode", "warehouse_code"), "warehouse_code", "left")
    )
    unknown = F.raise_error(F.concat(F.lit("moves name an unknown warehouse: "), F.col("warehouse_code")))
    named = F.when(receiver & ~F.col("known"), unknown.cast("string")).when(
        F.col("open"), F.concat("name", F.when(receiver, receiver_tag).otherwise(""))
    )
    return rows.select(
        "warehouse_code",
        F.coalesce(named, F.lit(unassigned)).alias("simulated_warehouse"),
        "product_lines",
        F.coalesce("stock", F.lit(0)).alias("simulated_stock"),
        F.coalesce("capital", F.lit(0)).alias("simulated_capital"),
        F.coalesce("revenue", F.lit(0)).alias("simulated_revenue"),
        rounded(F.when(receiver, scaled).otherwise(pct), 4).alias("simulated_capacity_pct"),
    )


def reallocate_scenarios(
    products: DataFrame,
    warehouses: DataFrame,
    sales: DataFrame,
    moves: DataFrame,
    closed: DataFrame,
    retention: DataFrame,
    receiver_tag: str = " (Consolidated)",
    unassigned: str = "Unassigned",
) -> DataFrame:
    """``reallocate`` for any number of scenarios at once, with a ``scenario`` column in front.

    ``moves`` has scenario, productLine and warehouseCode (where the line goes), ``closed`` scenario and
    warehouseCode, ``retention`` scenario, warehouseCode and kept (a fraction); a scenario is one that any of them names. The
    tables are as large as the scenarios are many. The products are read and aggregated once, to one row
    for each line and warehouse, and only those rows are seen by each scenario. Two moves of one line in a
    scenario, or two fractions for one warehouse, are an error, as is a move to an unknown warehouse.
    """
    code = F.col("warehouseCode")
    grain = (
        products.join(sales.select("productCode", "revenue"), "productCode", "left")
        .groupBy(code.alias("from_code"), "productLine")
        .agg(
            F.sum("quantityInStock").alias("old_stock"),
            F.sum(F.col("quantityInStock") * F.col("buyPrice")).alias("capital"),
            F.sum("revenue").alias("revenue"),
        )
    )
    named = moves.select("scenario").union(closed.select("scenario")).union(retention.select("scenario"))
    every = named.agg(F.collect_set("scenario")).scalar()
    twice = F.raise_error(F.concat(F.lit("more than one value for "), F.col("key"), F.lit(" in scenario "), F.col("scenario")))

    def one_each(table: DataFrame, key: str, value: str, name: str) -> DataFrame:
        rows = table.groupBy("scenario", F.col(key).alias("key")).agg(F.min(value).alias(name), F.count(F.lit(1)).alias("n"))
        checked = F.when(F.col("n") > 1, twice.cast(rows.schema[name].dataType)).otherwise(F.col(name))
        return rows.select("scenario", F.col("key").alias(f"{name}_key"), checked.alias(name))

    to = one_each(moves, "productLine", "warehouseCode", "to_code")
    kept = one_each(retention.withColumn("kept", F.col("kept").cast("decimal(10,6)")), "warehouseCode", "kept", "kept")
    flows = grain.withColumn("scenario", F.explode(every))
    flows = flows.join(to.withColumnRenamed("scenario", "s"), (F.col("scenario") == F.col("s")) & (F.col("productLine") == F.col("to_code_key")), "left").drop("s")
    flows = flows.join(kept.withColumnRenamed("scenario", "s"), (F.col("scenario") == F.col("s")) & (F.col("from_code") == F.col("kept_key")), "left").drop("s")
    share = F.coalesce("kept", exact(1))
    after = flows.groupBy("scenario", F.coalesce("to_code", "from_code").alias("target")).agg(
        F.sum(F.col("old_stock") * share).alias("stock"),
        F.sum(F.col("capital") * share).alias("capital"),
        F.sum("revenue").alias("revenue"),
        distinct_list("productLine").alias("product_lines"),
    )
    before = grain.groupBy(F.col("from_code").alias("warehouse_code")).agg(F.sum("old_stock").alias("old_stock"))
    places = warehouses.select(code.alias("w_code"), "warehouseName", F.col("warehousePctCap").cast("decimal(10,4)").alias("pct"))
    places = places.withColumn("w_scenario", F.explode(every))
    receivers = moves.select(F.col("scenario").alias("r_scenario"), code.alias("r_code")).distinct()
    shut = closed.select(F.col("scenario").alias("c_scenario"), code.alias("c_code")).distinct()
    known, open_now, receiver = F.col("w_code").isNotNull(), F.col("c_code").isNull(), F.col("r_code").isNotNull()
    rows = (
        places.join(after, (F.col("w_scenario") == F.col("scenario")) & (F.col("w_code") == F.col("target")), "full")
        .withColumns({"scenario": F.coalesce("w_scenario", "scenario"), "warehouse_code": F.coalesce("w_code", "target")})
        .join(shut, (F.col("scenario") == F.col("c_scenario")) & (F.col("warehouse_code") == F.col("c_code")), "left")
        .join(receivers, (F.col("scenario") == F.col("r_scenario")) & (F.col("warehouse_code") == F.col("r_code")), "left")
        .filter((known & open_now) | (F.col("stock") > 0) | (F.col("revenue") > 0))
        .join(before, "warehouse_code", "left")
    )
    unknown = F.raise_error(F.concat(F.lit("moves name an unknown warehouse: "), F.col("warehouse_code"))).cast("string")
    label = F.when(receiver & ~known, unknown).when(known & open_now, F.concat("warehouseName", F.when(receiver, receiver_tag).otherwise("")))
    pct = F.when(known & open_now, F.col("pct"))
    return rows.select(
        "scenario",
        "warehouse_code",
        F.coalesce(label, F.lit(unassigned)).alias("simulated_warehouse"),
        "product_lines",
        F.coalesce("stock", F.lit(0)).alias("simulated_stock"),
        F.coalesce("capital", F.lit(0)).alias("simulated_capital"),
        F.coalesce("revenue", F.lit(0)).alias("simulated_revenue"),
        rounded(F.when(receiver, ratio(F.col("stock"), F.col("old_stock")) * pct).otherwise(pct), 4).alias("simulated_capacity_pct"),
    )
