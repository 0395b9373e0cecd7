"""What one task holds of the lines doesn't grow with their number."""

import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tests.conftest import by, frame
from wareflow.operators.rollups import first_of_order, lines_of
from wareflow.plans import inventory
from wareflow.session import FIRST_PARTITIONS, LEAST_PARTITIONS, TASK_READ, TASK_SHARE, prepare

LINES = [
    # order, product, units; order 1 has P1 three times, order 5 is cancelled
    (1, "P1", 1), (1, "P1", 1), (1, "P1", 2), (2, "P1", 4), (1, "P2", 8), (5, "P2", 16), (5, "P2", 32),
    (None, "P1", 64), (None, "P1", 128), (None, "P3", 256), (1, None, 512), (9, "P3", 1024), (9, "P3", 2048),
]


@pytest.fixture
def tables(spark, model):
    lines = frame(spark, "orderdetails", [
        {"orderNumber": n, "productCode": p, "quantityOrdered": q, "priceEach": Decimal("2.00")} for n, p, q in LINES])
    return model["products"], model["warehouses"], lines, model["orders"]


def test_orders_are_counted_once_where_lines_come_twice_or_have_no_order(tables):
    got = by(inventory.product_revenue(*tables), "product_code")
    found = {k: (got[k]["total_units_sold"], got[k]["total_sales_transactions"]) for k in ("P1", "P2", "P3", "P4")}
    assert found == {"P1": (200, 2), "P2": (56, 2), "P3": (3328, 1), "P4": (0, 0)}
    got = by(inventory.product_revenue(*tables, corrected=True), "product_code")
    found = {k: (got[k]["total_units_sold"], got[k]["total_sales_transactions"]) for k in ("P1", "P2", "P3", "P4")}
    assert found == {"P1": (8, 2), "P2": (8, 1), "P3": (0, 0), "P4": (0, 0)}
    assert got["P1"]["total_revenue"] == Decimal("16.00")


@pytest.mark.parametrize("corrected", [False, True])
def test_no_hash_table_of_orders_and_products(tables, corrected):
    text = inventory.product_revenue(*tables, corrected=corrected)._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Aggregate\(keys=\[([^\]]*)\]", text)
    assert keys and not [k for k in keys if "orderNumber" in k]


def test_task_sizes_are_set_where_the_session_sets_none(spark):
    bare = spark.newSession()
    bare.conf.set("spark.sql.shuffle.partitions", "12")
    prepare(bare)
    assert bare.conf.get(TASK_READ) == TASK_SHARE and bare.conf.get(FIRST_PARTITIONS) == LEAST_PARTITIONS
    bare.conf.set("spark.sql.shuffle.partitions", "600")  # more than the least: nothing is to be raised
    assert prepare(bare).conf.get(FIRST_PARTITIONS, None) is None
    own = spark.newSession()
    own.conf.set(TASK_READ, "8m")
    own.conf.set(FIRST_PARTITIONS, "40")
    prepare(own)
    assert own.conf.get(TASK_READ) == "8m" and own.conf.get(FIRST_PARTITIONS) == "40"


def test_a_task_holds_its_share_of_the_lines_whatever_the_shuffle_partitions(spark):
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", "2")
    own.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    own.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    own.conf.set(TASK_READ, "1MB")
    prepare(own)
    rows = 400_000
    lines = own.range(rows).selectExpr(
        "xxhash64(id) % 100000 AS orderNumber", "xxhash64(id, 1) % 5000 AS productCode", "xxhash64(id, 2) % 1000000 AS quantityOrdered")
    orders = own.range(-100_000, 100_000).selectExpr("id AS orderNumber")
    marked = lines_of(lines, orders).withColumn("first", first_of_order())
    sums = F.count("*").alias("n"), F.sum("quantityOrdered"), F.count_if("first")
    by_task = marked.groupBy(F.spark_partition_id().alias("task")).agg(*sums).collect()
    assert sum(r.n for r in by_task) == rows and max(r.n for r in by_task) < rows // 4
