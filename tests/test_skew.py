"""One order, product, customer or rep holding a third of all rows."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import by
from wareflow.operators.rollups import left_join_spread, lines_of, product_sales
from wareflow.plans import customers, inventory, territory

ROWS = 60_000


@pytest.fixture(scope="module")
def skewed(spark):
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "32KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.shuffle.partitions": "8",
    }
    old = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    i = F.col("id")
    hot = i % 3 == 0
    lines = spark.range(0, ROWS, 1, 8).select(
        F.when(hot, 1).otherwise(i % 5000).cast("int").alias("orderNumber"),
        F.when(i % 3 == 1, 7).otherwise(i % 400).cast("int").alias("productCode"),
        (i % 9 + 1).cast("int").alias("quantityOrdered"),
        (i % 100 + 1).cast("decimal(10,2)").alias("priceEach"),
    )
    orders = spark.range(0, 5000, 1, 4).select(
        i.cast("int").alias("orderNumber"),
        F.when(hot, 1).otherwise(i % 300).cast("int").alias("customerNumber"),
        F.when(i % 10 == 9, "Cancelled").otherwise("Shipped").alias("status"),
        F.when(hot, F.concat(F.lit("damaged "), i % 50)).alias("comments"),
    )
    people = spark.range(0, 300, 1, 2).select(
        i.cast("int").alias("customerNumber"),
        i.cast("string").alias("customerName"),
        F.lit("USA").alias("country"),
        F.when(hot, None).otherwise(i % 7).cast("int").alias("salesRepEmployeeNumber"),
    )
    reps = spark.range(0, 7, 1, 1).select(
        i.cast("int").alias("employeeNumber"),
        F.lit("R").alias("firstName"),
        i.cast("string").alias("lastName"),
        (i % 3).cast("string").alias("officeCode"),
    )
    offices = spark.sql("SELECT * FROM VALUES ('0', 'NA'), ('1', 'EMEA'), ('2', 'APAC') AS o(officeCode, territory)")
    products = spark.range(0, 400, 1, 2).select(
        i.cast("int").alias("productCode"),
        i.cast("string").alias("productName"),
        (i % 4).cast("string").alias("productLine"),
        F.lit(100).alias("quantityInStock"),
        F.lit("a").alias("warehouseCode"),
    )
    warehouses = spark.sql("SELECT 'a' AS warehouseCode, 'North' AS warehouseName, '72' AS warehousePctCap")
    yield {
        "lines": lines, "orders": orders, "customers": people, "employees": reps,
        "offices": offices, "products": products, "warehouses": warehouses,
    }
    for key, value in old.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_join_of_a_hot_order_is_split(skewed):
    sold = product_sales(lines_of(skewed["lines"], skewed["orders"], "status"))
    assert "skew=true" in final_plan(sold)
    assert sold.agg(F.sum("n_lines")).first()[0] == ROWS


def test_join_is_split_even_where_the_next_step_wants_its_partitioning(skewed):
    df = inventory.product_revenue(
        skewed["products"], skewed["warehouses"], skewed["lines"], skewed["orders"], corrected=True, ordered=False
    )
    assert "skew=true" in final_plan(df)
    got = by(df, "product_code")
    kept = skewed["lines"].filter((F.col("orderNumber") % 10 != 9)).toPandas()
    for code, group in kept.groupby("productCode"):
        assert got[code]["total_units_sold"] == group.quantityOrdered.sum()
        assert got[code]["total_sales_transactions"] == group.orderNumber.nunique()


def test_roll_up_by_order_moves_one_row_per_task_and_order(skewed):
    homes = [skewed[k] for k in ("orders", "customers", "employees", "offices")]
    shares = territory.territory_sales_share(skewed["lines"], *homes)
    lines = skewed["lines"].toPandas()
    total = (lines.quantityOrdered * lines.priceEach.astype(float)).groupby(lines.orderNumber).sum()
    orders = skewed["orders"].toPandas().set_index("orderNumber").customerNumber
    rep = {n: n % 7 for n in range(300) if n % 3}
    want = {}
    for order, value in total.items():
        if orders[order] in rep:
            area = ("NA", "EMEA", "APAC")[rep[orders[order]] % 3]
            want[area] = want.get(area, 0) + value
    got = {r.territory: float(r.region_sales) for r in shares.collect()}
    assert got == pytest.approx(want)


def test_customers_without_rep_and_a_hot_customer(skewed):
    df = customers.customer_friction(skewed["customers"], skewed["orders"], skewed["employees"])
    got = by(df, "customer_number")
    assert len(got) == 300
    assert got[0]["sales_representative"] == "No Rep Assigned"
    hot = skewed["orders"].filter("customerNumber = 1")
    assert got[1]["total_orders"] == hot.count()
    assert got[1]["distinct_comments"] == hot.select("comments").distinct().count() - 1


def test_null_keys_do_not_meet_in_one_task(skewed):
    reps = skewed["employees"].select("employeeNumber", "lastName")
    joined = left_join_spread(
        skewed["customers"], reps, "salesRepEmployeeNumber", "employeeNumber", ["customerNumber"]
    )
    placed = joined.select("salesRepEmployeeNumber", F.spark_partition_id().alias("place"))
    joined.sparkSession.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = placed.collect()
    joined.sparkSession.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    alone = [r.place for r in rows if r.salesRepEmployeeNumber is None]
    assert len(alone) == 100
    assert len(set(alone)) >= 4
