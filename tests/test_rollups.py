"""Stored roll-ups, sketches and lines by month give what the lines themselves give."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from wareflow.functions.numbers import sample_deviation
from wareflow.operators.rollups import product_sales, with_status
from wareflow.plans import customers
from wareflow.sources import rollups, sinks
from wareflow.sources.supplied import Supplied


@pytest.fixture(scope="module")
def tables(spark):
    t = Supplied(spark, SMALL)
    return t.lines(), t.orders(), t.products()


def test_two_appends_equal_all_lines_at_once(spark, tables, tmp_path):
    lines, orders, _ = tables
    base = f"{tmp_path}/sales"
    for batch in range(3):
        rollups.append(rollups.summary(lines.where(f"pmod(orderNumber, 3) = {batch}"), orders), base, f"b{batch}")
    by_product = rollups.merged(spark, base, ["productCode"])
    once = rollups.summary(lines, orders, ["productCode"])
    exact = ["productCode", *(m for m in rollups.MERGE if m != "customers")]
    assert sorted(map(tuple, by_product.select(exact).collect())) == sorted(map(tuple, once.select(exact).collect()))
    sales = product_sales(lines.join(orders.select("orderNumber"), "orderNumber"))
    same = ["productCode", "units", "revenue", "n_lines"]
    assert sorted(map(tuple, by_product.select(same).collect())) == sorted(map(tuple, sales.select(same).collect()))
    n, total, squares = (F.col(c) for c in ("n_lines", "price_sum", "price_squares"))
    spread = by_product.select("productCode", sample_deviation(n, total, squares).alias("d")).where("d IS NOT NULL")
    direct = lines.join(orders.select("orderNumber"), "orderNumber").groupBy("productCode").agg(F.stddev_samp(F.col("priceEach").cast("double")).alias("e"))
    assert spread.join(direct, "productCode").where("abs(d - e) > 0.0001").count() == 0
    plan = by_product._jdf.queryExecution().executedPlan().toString()
    assert "lineitem" not in plan


def test_a_batch_counts_once(spark, tables, tmp_path):
    lines, orders, _ = tables
    rollups.append(rollups.summary(lines.limit(5), orders), f"{tmp_path}/x", "a")
    with pytest.raises(Exception, match="exist"):
        rollups.append(rollups.summary(lines.limit(5), orders), f"{tmp_path}/x", "a")


@pytest.mark.parametrize("n", [0, 1, 100, 5_000, 200_000])
def test_merged_sketches_equal_one_and_are_close(spark, n):
    df = spark.range(n).select((F.col("id") % 4).alias("part"), F.concat(F.lit("v"), F.col("id")).alias("v"))
    df = df.union(df).union(spark.createDataFrame([(0, None)], "part LONG, v STRING"))
    parts = df.groupBy("part").agg(rollups.distinct_sketch("v").alias("s"))
    merged = parts.agg(rollups.distinct_estimate(F.hll_union_agg("s"))).first()[0]
    once = df.agg(rollups.distinct_estimate(rollups.distinct_sketch("v"))).first()[0]
    assert abs(merged - n) <= max(1, 0.03 * n) and abs(once - n) <= max(1, 0.03 * n) and abs(merged - once) <= max(1, 0.02 * n)


def test_exact_counts_stay_the_default(spark, tables):
    lines, orders, products = tables
    wanted = with_status(orders, keep=["Disputed", "Shipped"])
    exact = {r.product_name: r.orders_involved for r in customers.products_in_orders(lines, products, wanted).collect()}
    close = {r.product_name: r.orders_involved for r in customers.products_in_orders(lines, products, wanted, approximate=True).collect()}
    assert exact.keys() == close.keys() and all(abs(exact[k] - close[k]) <= 1 + 0.03 * exact[k] for k in exact)
    plan = customers.products_in_orders(lines, products, wanted)._jdf.queryExecution().executedPlan().toString()
    assert "hll" not in plan


def test_filtered_orders_prune_the_folders_of_lines(spark, tables, tmp_path):
    lines, orders, _ = tables
    path = f"{tmp_path}/lines"
    sinks.write_lines_by_month(lines, orders, path)
    sinks.write_table(sinks.orders_with_month(orders), f"{tmp_path}/orders")
    stored, dated = spark.read.parquet(path), spark.read.parquet(f"{tmp_path}/orders")
    assert stored.count() == lines.count()
    some = dated.where("orderDate BETWEEN DATE'1995-03-01' AND DATE'1995-03-31'")
    joined = stored.join(some.select("orderNumber", "order_month"), ["orderNumber", "order_month"])
    got = joined.agg(F.count("*"), F.sum("quantityOrdered")).collect()
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    direct = lines.join(orders.where("orderDate BETWEEN DATE'1995-03-01' AND DATE'1995-03-31'").select("orderNumber"), "orderNumber")
    assert got == direct.agg(F.count("*"), F.sum("quantityOrdered")).collect() and got[0][0] > 0
    named = stored.select("orderNumber", "order_month", F.col("_metadata.file_path").alias("f")).join(some.select("orderNumber", "order_month"), ["orderNumber", "order_month"])
    assert {r.f.rsplit("/", 2)[1] for r in named.select("f").distinct().collect()} == {"order_month=1995-03"}
    assert len({f.rsplit("/", 2)[1] for f in stored.inputFiles()}) > 12
    assert Decimal(got[0][1]) > 0
