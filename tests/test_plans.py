"""Plans as they are when nothing fits a broadcast, the way they are at scale."""

import re

import pytest

import __spark_entry__ as entry
from tests.conftest import SMALL
from wareflow.plans.catalog import REPORTS
from wareflow.session import FILTERED_SCAN
from wareflow.operators.rollups import with_status
from wareflow.sources import readers, sinks
from wareflow.sources.supplied import Supplied


@pytest.fixture(scope="module")
def plan(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")

    def text(name):
        return entry.queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()

    yield text
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("name", list(REPORTS))
def test_no_cross_join_no_forced_broadcast_no_python(plan, name):
    text = plan(name)
    for operator in ("CartesianProduct", "NestedLoopJoin", "BroadcastExchange", "Python", "Pandas"):
        assert operator not in text


def ancestors_of_scans(text):
    """For every file scan in a plan, the operators above it, outermost first."""
    stack = []
    for line in text.splitlines():
        start = re.search(r"[A-Z]", line)
        if not start:
            continue
        stack = [(d, op) for d, op in stack if d < start.start()]
        stack.append((start.start(), line[start.start() :]))
        if stack[-1][1].startswith("FileScan"):
            yield [op for _, op in stack]


@pytest.mark.parametrize("name", list(REPORTS))
def test_one_task_only_sees_grouped_rows(plan, name):
    """Rows of a file reach a single-partition exchange through an aggregate only."""
    for path in ancestors_of_scans(plan(name)):
        for i, operator in enumerate(path):
            if operator.startswith("Exchange SinglePartition"):
                assert any("Aggregate" in below for below in path[i + 1 :]), path


#: Entries about several tables or keys, each with a scan of its own.
AUDITS = ("duplicate_keys", "key_audit", "orphan_audit")


#: Entries whose second scan adaptive execution replaces by the exchange of the first.
SHARED = ("top_bottom_products", "top_bottom_products_corrected", "product_rank")


@pytest.mark.parametrize("name", SHARED)
def test_both_ends_share_one_scan(spark, name):
    df = REPORTS[name](Supplied(spark, SMALL))
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in REPORTS if n not in AUDITS + SHARED])
def test_lines_are_scanned_once_at_most(plan, name):
    assert len(re.findall(r"FileScan.*lineitem\.parquet", plan(name))) <= 1


@pytest.mark.parametrize("name", list(REPORTS))
def test_raw_lines_are_hashed(plan, name):
    """The first aggregate over the lines keeps numbers only: no sets, no sort."""
    for path in ancestors_of_scans(plan(name)):
        if "lineitem.parquet" in path[-1]:
            aggregates = [op for op in path if "Aggregate" in op]
            assert not aggregates or aggregates[-1].startswith("HashAggregate"), aggregates[-1]


def test_lines_meet_the_wanted_orders_below_the_aggregate(plan):
    for name in ("order_exceptions", "disputed_products"):
        (path,) = [p for p in ancestors_of_scans(plan(name)) if "lineitem.parquet" in p[-1]]
        joins = [i for i, op in enumerate(path) if "LeftSemi" in op]
        assert joins and joins[-1] > max(i for i, op in enumerate(path) if "Aggregate" in op)


@pytest.mark.parametrize("name", ["order_exceptions", "disputed_products", "disputed_product_orders"])
def test_wanted_orders_filter_the_lines_before_they_are_shuffled(spark, plan, name):
    old = spark.conf.get(FILTERED_SCAN)
    spark.conf.set(FILTERED_SCAN, "0")
    try:
        (path,) = [p for p in ancestors_of_scans(plan(name)) if "lineitem.parquet" in p[-1]]
    finally:
        spark.conf.set(FILTERED_SCAN, old)
    shuffles = [i for i, op in enumerate(path) if op.startswith("Exchange")]
    filters = [i for i, op in enumerate(path) if "might_contain" in op]
    assert filters and max(filters) > max(shuffles)


def test_ranks_of_all_products_are_made_by_ranges(plan):
    """What reaches a single task above the ranks are one row for each range, or partial quantiles."""
    single = [p for p in ancestors_of_scans(plan("product_rank")) if any(op.startswith("Exchange SinglePartition") for op in p)]
    assert single
    for path in single:
        at = max(i for i, op in enumerate(path) if op.startswith("Exchange SinglePartition"))
        below = next(op for op in path[at + 1 :] if "Aggregate" in op)
        assert "partial_percentile_approx" in below or "count(1)" in below


def test_stock_against_sales_moves_raw_lines_once(plan):
    (path,) = [p for p in ancestors_of_scans(plan("line_stock_vs_sales")) if "lineitem.parquet" in p[-1]]
    below = path[max(i for i, op in enumerate(path) if "Aggregate" in op) :]
    assert sum(op.startswith("Exchange") for op in below) == 1


def test_status_filter_reaches_the_scan_of_a_stored_table(spark, model, tmp_path):
    sinks.write_table(model["orders"], f"{tmp_path}/orders")
    stored = readers.read_parquet(spark, str(tmp_path), "orders")
    text = with_status(stored, keep=["Shipped"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(status,Shipped\)", text)


def test_lines_are_read_by_the_columns_needed(plan):
    (schema,) = set(re.findall(r"lineitem\.parquet.*?ReadSchema: (struct<[^>]*>)", plan("stock_health")))
    assert schema == "struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double>"


def test_event_types_reach_the_scan(plan):
    assert "EqualTo(event_type,purchase)" in plan("null_audit_payments")


def test_roll_up_and_join_share_one_shuffle_of_the_lines(plan):
    text = plan("territory_sales_share")
    keyed = re.findall(r"Exchange hashpartitioning\((\w+)#", text)
    assert keyed.count("orderNumber") == 2  # the lines once, the orders once


def test_full_result_of_the_top_n_is_never_sorted(plan):
    assert plan("top_bottom_products").count("TakeOrderedAndProject") == 2
