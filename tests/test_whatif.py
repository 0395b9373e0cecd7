"""Stock is conserved whatever moves, closes or is unknown."""

from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.conftest import frame
from wareflow.operators.whatif import reallocate, reallocate_scenarios

LINES = ["Cars", "Boats", "Trams"]
CODES = ["a", "b", "c", "d", "y", None]


def tables(spark, homes):
    products = [
        {"productCode": f"P{i}", "productLine": LINES[i % 3], "warehouseCode": code, "quantityInStock": 3 * i + 1, "buyPrice": Decimal("2.00")}
        for i, code in enumerate(homes)
    ]
    places = [{"warehouseCode": c, "warehouseName": c.upper(), "warehousePctCap": "50"} for c in "abcd"]
    sales = spark.createDataFrame([(f"P{i}", Decimal(i)) for i in range(len(homes))], "productCode STRING, revenue DECIMAL(10,2)")
    return frame(spark, "products", products), frame(spark, "warehouses", places), sales, sum(p["quantityInStock"] for p in products)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    homes=st.lists(st.sampled_from(CODES), min_size=1, max_size=9),
    moves=st.dictionaries(st.sampled_from(LINES), st.sampled_from("abcd"), max_size=3),
    closed=st.sets(st.sampled_from("abcd"), max_size=2),
)
def test_stock_and_revenue_are_conserved(spark, homes, moves, closed):
    products, warehouses, sales, total = tables(spark, homes)
    rows = reallocate(products, warehouses, sales, moves, closed).collect()
    assert sum(r.simulated_stock for r in rows) == total
    assert sum(r.simulated_capital for r in rows) == 2 * total
    assert sum(r.simulated_revenue for r in rows) == sum(range(len(homes)))
    for r in rows:
        lost = r.warehouse_code is None or r.warehouse_code == "y" or r.warehouse_code in closed
        assert (r.simulated_warehouse == "Unassigned") == lost
        assert not lost or r.simulated_capacity_pct is None


def test_what_is_not_moved_out_of_a_closed_warehouse_has_a_row(spark):
    products, warehouses, sales, _ = tables(spark, ["d", "d", "a"])
    rows = {r.warehouse_code: r for r in reallocate(products, warehouses, sales, {"Boats": "a"}, ["d"]).collect()}
    assert rows["d"].simulated_warehouse == "Unassigned" and rows["d"].simulated_stock == 1
    assert rows["a"].simulated_warehouse == "A (Consolidated)" and rows["a"].simulated_stock == 11


def test_a_move_to_an_unknown_warehouse_fails(spark):
    products, warehouses, sales, _ = tables(spark, ["a", "b"])
    with pytest.raises(Exception, match="unknown warehouse"):
        reallocate(products, warehouses, sales, {"Cars": "q"}).collect()


def test_scenarios_at_once_equal_single_ones(spark):
    products, warehouses, sales, total = tables(spark, ["a", "b", "c", "d", "y", None, "b", "c", "a"])
    scenarios = {
        "one": ({"Cars": "b"}, ["a"], {}),
        "two": ({"Boats": "a", "Trams": "c"}, ["d", "b"], {"b": 0.5, "y": 0.25}),
        "three": ({}, ["c"], {}),
        "four": ({"Cars": "d"}, [], {"a": 0.9}),
    }
    moves = spark.createDataFrame([(s, line, to) for s, (m, _, _) in scenarios.items() for line, to in m.items()], "scenario STRING, productLine STRING, warehouseCode STRING")
    closed = spark.createDataFrame([(s, c) for s, (_, shut, _) in scenarios.items() for c in shut], "scenario STRING, warehouseCode STRING")
    kept = spark.createDataFrame([(s, c, Decimal(str(x))) for s, (_, _, k) in scenarios.items() for c, x in k.items()], "scenario STRING, warehouseCode STRING, kept DECIMAL(4,2)")
    got = reallocate_scenarios(products, warehouses, sales, moves, closed, kept).collect()
    show = lambda r: (r.warehouse_code, r.simulated_warehouse, r.product_lines, *(None if x is None else round(float(x), 4) for x in (r.simulated_stock, r.simulated_capital, r.simulated_revenue, r.simulated_capacity_pct)))
    for name, (move, shut, keep) in scenarios.items():
        single = reallocate(products, warehouses, sales, move, shut, keep).collect()
        own = [r for r in got if r.scenario == name]
        assert sorted(map(show, own), key=repr) == sorted(map(show, single), key=repr), name
        if not keep:
            assert sum(r.simulated_stock for r in own) == total
    plan = reallocate_scenarios(products, warehouses, sales, moves, closed, kept)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan


@pytest.mark.parametrize(("line", "to", "error"), [("Cars", "q", "unknown warehouse: q"), ("Boats", "a", "more than one value for Boats in scenario s")])
def test_moves_that_make_no_sense_fail(spark, line, to, error):
    products, warehouses, sales, _ = tables(spark, ["a", "b", "c"])
    moves = spark.createDataFrame([("s", "Boats", "b"), ("s", line, to)], "scenario STRING, productLine STRING, warehouseCode STRING")
    none = spark.createDataFrame([], "scenario STRING, warehouseCode STRING, kept DECIMAL(4,2)")
    with pytest.raises(Exception, match=error):
        reallocate_scenarios(products, warehouses, sales, moves, none, none).collect()
