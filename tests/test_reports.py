from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from tests.conftest import by
from wareflow.operators import clean
from wareflow.operators.rollups import left_join_spread
from wareflow.operators.stock import HealthScale
from wareflow.plans import customers, delivery, inventory, stock, territory, warehouse


@pytest.fixture(scope="module")
def m(model):
    model = dict(model)
    model["offices"] = clean.override(model["offices"], "territory", [("country", "Japan", "APAC")])
    return model


def chain(m):
    return m["lines"], m["orders"], m["customers"], m["employees"], m["offices"]


def goods(m):
    return m["products"], m["warehouses"], m["lines"], m["orders"]


def shipping(m):
    return m["orders"], m["customers"], m["lines"], m["products"], m["warehouses"]


# --- territories ---

def test_sales_share(m):
    got = by(territory.territory_sales_share(*chain(m)), "territory")
    # customer 10: 600 + 300 + 150 + 480 + 140; customer 11: 440 + 29.97; customer 12: 9.99
    assert {k: v["region_sales"] for k, v in got.items()} == {
        "EMEA": D("1670.00"), "APAC": D("469.97"), "NA": D("9.99")}
    assert got["EMEA"]["grand_total_sales"] == D("2149.96")
    assert sum(v["market_share_pct"] for v in got.values()) == 100
    assert all(v["offices_in_region"] == 1 for v in got.values())


def test_line_rank_has_no_gaps_and_shares_add_up(m):
    rows = territory.territory_line_rank(*chain(m), m["products"]).collect()
    emea = [r for r in rows if r.territory == "EMEA"]
    assert [(r.product_line, r.region_rank) for r in emea] == [("Cars", 1), ("Boats", 2), ("Bikes", 3)]
    assert abs(sum(r.sales_pct for r in emea) - 100) < D("0.02")


def test_price_gap_sentinels_and_corrected(m):
    args = (*chain(m), m["products"])
    rows = territory.regional_price_gap(*args).collect()
    assert rows[0].max_price_difference == max(r.max_price_difference for r in rows)
    written = by(territory.regional_price_gap(*args), "product_code")
    assert written["P7"]["max_price_difference"] == 0  # 9.99 in two territories
    assert written["P2"]["max_price_difference"] == 0 and written["P2"]["std_dev_emea"] is None
    assert written["P1"]["avg_price_emea"] == 11 and written["P1"]["std_error_emea"] == 1
    fixed = by(territory.regional_price_gap(*args, corrected=True), "product_code")
    assert fixed["P2"]["max_price_difference"] is None and fixed["P7"]["max_price_difference"] == 0


def test_unmapped_territory_gets_sentinel_gap(model):
    raw = by(territory.regional_price_gap(*chain(model), model["products"]), "product_code")
    assert raw["P4"]["max_price_difference"] == D("-999999.00")  # sold through Japan only


def test_warehouse_to_territory_columns_add_up(m):
    got = by(territory.warehouse_to_territory(*chain(m), m["products"], m["warehouses"]), "destination_region")
    assert {k: v["total_orders_shipped"] for k, v in got.items()} == {"EMEA": 2, "APAC": 1, "NA": 1}
    for v in got.values():
        assert sum(v[f"from_{w}"] for w in ("north", "east", "west", "south")) == v["grand_total_units"]
    assert got["APAC"]["from_north"] == 0 and got["APAC"]["from_west"] == 100


# --- customers ---

def test_inactive_customers(m):
    row = customers.inactive_customers(m["customers"], m["orders"]).first()
    assert (row.inactive_customers, row.inactive_pct) == (1, D("25.00"))


def test_active_countries_fold_trailing_blanks(m):
    got = by(customers.active_countries(m["customers"], m["orders"]), "country")
    assert got["Norway"] == {"region": "EMEA", "country": "Norway", "active_customers": 2, "total_orders": 5}
    assert "USA" not in got


def test_friction(m):
    got = by(customers.customer_friction(m["customers"], m["orders"], m["employees"]), "customer_number")
    assert got[10]["client_status"] == "Difficult Client" and got[10]["friction_ratio"] == "1 of 3"
    assert got[11]["friction_ratio"] == "0 of 2" and got[11]["distinct_comments"] == 2
    assert got[13]["client_status"] == "Inactive (Zero Orders)"
    assert got[13]["sales_representative"] == "No Rep Assigned" and got[13]["friction_ratio"] == "0 of 0"
    assert got[12]["sales_representative"] == "Gus Rep"


def test_customer_comments_are_whole_and_distinct(spark):
    orders = spark.createDataFrame(
        [(1, "x" * 5000), (1, "x" * 5000), (1, "y"), (2, None)], "customerNumber INT, comments STRING")
    got = {(r.customer_number, len(r.comments)): r.n_orders for r in customers.customer_comments(orders).collect()}
    assert got == {(1, 5000): 2, (1, 1): 1}


def test_status_share_adds_up(m):
    rows = customers.order_status_share(m["orders"]).collect()
    assert sum(r.total_orders for r in rows) == 7
    assert abs(sum(r.pct_of_total for r in rows) - 100) < D("0.05")
    assert "Disputed" in {r.order_status for r in rows}


def test_order_exceptions(m):
    got = by(customers.order_exceptions(m["orders"], m["lines"], m["products"], m["warehouses"], m["customers"]), "order_number")
    assert set(got) == {4, 5, 7}
    assert got[4]["reason"] == "Budgeting Issues" and got[4]["total_items_cancelled"] == 0
    assert got[5]["reason"] == "Shipping issues" and got[5]["total_items_cancelled"] == 20
    assert got[7]["affected_warehouses"] is None and got[7]["reason"] == "No Reason Provided"


def test_products_in_orders(m):
    wanted = m["orders"].filter("orderNumber in (1, 2)")
    got = by(customers.products_in_orders(m["lines"], m["products"], wanted), "product_name")
    assert got["name P1"]["times_disputed"] == 2 and got["name P1"]["orders_involved"] == 2
    assert by(customers.products_in_orders(m["lines"], m["products"], [1, 2]), "product_name") == got
    pairs = customers.products_and_orders(m["lines"], m["products"], [1, 2]).filter("product_name = 'name P1'")
    assert sorted(r.order_number for r in pairs.collect()) == [1, 2]


# --- delivery ---

def test_delivery_buckets_at_their_limits(m):
    got = by(delivery.delivery_performance(m["orders"]), "delivery_performance")
    assert {k: v["total_orders"] for k, v in got.items()} == {"Early": 1, "On time": 2, "Late": 1, "Not shipped": 3}
    assert got["Not shipped"]["avg_days_to_ship"] == "NA" and got["Early"]["avg_days_to_ship"] == "14"
    four = by(delivery.delivery_performance(m["orders"], early_days=4), "delivery_performance")
    assert four["Early"]["total_orders"] == 2


def test_shipping_by_country_weighs_lines_or_orders(m):
    written = by(delivery.shipping_by_country(*shipping(m)), "country")
    # order 1: 3 lines in 14 days; order 2: 1 line in 15; order 3: 1 line in 19
    assert written["Norway"]["number_of_orders"] == 5 and written["Norway"]["avg_days_to_ship"] == 15
    assert written["Norway"]["warehouses_affected"] == "East,West"
    fixed = by(delivery.shipping_by_country(*shipping(m), corrected=True), "country")
    assert fixed["Norway"]["number_of_orders"] == 3 and fixed["Norway"]["avg_days_to_ship"] == 16
    without = by(delivery.shipping_by_country(*shipping(m), exclude=[4]), "country")
    assert set(without) == {"Norway"}


def test_slowest_orders(m):
    rows = delivery.slowest_orders(*shipping(m)).collect()
    assert [(r.order_number, r.ship_days) for r in rows] == [(4, 20), (3, 19), (2, 15), (1, 14)]
    assert [r.reason for r in rows] == ["Previously on hold", "Previously disputed", "No comment", "No comment"]
    assert delivery.slowest_order_number(m["orders"]).first().orderNumber == 4


# --- inventory and stock ---

def test_line_stock_vs_sales(m):
    got = by(inventory.line_stock_vs_sales(m["lines"], m["orders"], m["products"], m["warehouses"]), "product_line")
    assert got["Cars"]["units_stock"] == 601 and got["Cars"]["units_sold"] == 200
    assert got["Cars"]["unique_products"] == 2 and got["Cars"]["total_revenue"] == D("1380.00")
    assert got["Boats"]["units_sold"] == 200  # the lower-case status counts as shipped
    assert got["Cars"]["pct_of_total_sales"] == 50 and set(got) == {"Cars", "Boats"}


def test_product_revenue_as_written_and_corrected(m):
    p, w, lines, orders = goods(m)
    written = by(inventory.product_revenue(p, w, lines), "product_code")
    assert written["P6"]["total_units_sold"] == 20 and written["P5"]["total_revenue"] == 0
    assert written["P1"]["average_revenue_per_unit"] == D("10.80")
    fixed = by(inventory.product_revenue(p, w, lines, orders, corrected=True), "product_code")
    assert fixed["P6"]["total_units_sold"] == 0 and fixed["P1"] == written["P1"]


def test_top_bottom_breaks_ties_by_code(m):
    rows = inventory.top_bottom_products(*goods(m)[:3], n=2).collect()
    assert [(r.sales_rank, r.product_code) for r in rows] == [
        ("MOST SOLD", "P1"), ("MOST SOLD", "P2"), ("LEAST SOLD", "P7"), ("LEAST SOLD", "P5")]
    assert rows[-1].lowest_price_sold == "NaN" and rows[0].highest_price_sold == "12.00"


def test_health_limits_and_unsold(m):
    written = by(stock.stock_health(*goods(m)), "product_code")
    assert {k: v["stock_health"] for k, v in written.items()} == {
        "P1": "Balanced", "P2": "Severely Overstock", "P3": "Balanced", "P4": "Restock needed",
        "P7": "Severely Overstock"}
    kept = by(stock.stock_health(*goods(m), corrected=True), "product_code")
    assert kept["P5"]["stock_health"] == "Absolute Dead (0 Sales)" and "P6" not in kept
    assert kept["P5"]["capital_tied_up"] == D("210.00")


def test_line_of_unknown_order_counts_where_unsold_products_do(spark, m):
    extra = m["lines"].limit(1).withColumns(
        {"orderNumber": F.lit(99), "productCode": F.lit("P5"), "quantityOrdered": F.lit(7)})
    p, w, lines, orders = goods(m)
    lines = lines.unionByName(extra)
    assert by(stock.stock_health(p, w, lines, orders, corrected=True), "product_code")["P5"]["total_units_sold"] == 7
    assert "P5" not in by(stock.stock_health(p, w, lines, orders), "product_code")


def test_health_percentages_add_up(m):
    for v in by(stock.warehouse_health_pct(*goods(m)[:3]), "warehouse_name").values():
        parts = [v[c] for c in ("severe_understock_pct", "normal_balance_pct", "severe_overstock_pct", "dead_sales_pct")]
        assert sum(parts) == 100
    scale = HealthScale(under=2)
    got = by(stock.warehouse_health_pct(*goods(m)[:3], scale=scale), "warehouse_name")
    assert got["West"]["severe_understock_pct"] == 100


def test_movement_counts_stock_per_line_or_once(m):
    written = by(stock.warehouse_movement_rank(*goods(m)), "warehouse_name")
    assert written["East"]["current_stock"] == 2 * 300 + 301
    fixed = by(stock.warehouse_movement_rank(*goods(m), corrected=True), "warehouse_name")
    assert fixed["East"]["current_stock"] == 601 and "North" not in fixed
    assert sorted(v["movement_rank"] for v in written.values()) == [1, 2, 3]


def test_reduction_plan(m):
    rows = stock.stock_reduction_plan(*goods(m)).collect()
    assert [(r.product_code, r.target_reduction_units, r.remaining_stock) for r in rows] == [("P2", 60, 241)]
    everywhere = by(stock.stock_reduction_plan(*goods(m), places=("o", "W")), "product_code")
    assert everywhere["P5"]["target_reduction_units"] == 70 and everywhere["P5"]["remaining_stock"] == 0
    for v in everywhere.values():
        assert v["target_reduction_units"] + v["remaining_stock"] == v["current_stock"]
    assert "remaining_stock" not in stock.overstock_candidates(*goods(m)).columns


def test_restock_plan(m):
    (row,) = stock.restock_plan(*goods(m)).collect()
    assert (row.product_code, row.healthy_target_stock, row.required_restock_units) == ("P4", 200, 101)
    assert row.procurement_cost == D("404.00")


# --- warehouses ---

def test_capacity_and_diversity(m):
    got = by(warehouse.warehouse_capacity_rank(m["products"], m["warehouses"]), "warehouse_code")
    assert got["b"]["theoretical_capacity"] == 897 and got["b"]["remaining_empty_slots"] == 296
    assert [got[w]["capacity_rank"] for w in "bcad"] == [1, 2, 3, 4]
    rows = by(warehouse.warehouse_diversity(m["products"], m["warehouses"]), "warehouse_code")
    assert rows["b"]["pct_of_catalog"] == D("28.6") and rows["d"]["product_lines_sold"] == "Trams"


def test_baseline_keeps_empty_warehouses(m):
    p = m["products"].filter("warehouseCode <> 'd'")
    got = by(warehouse.warehouse_baseline(p, *goods(m)[1:]), "warehouse_code")
    assert got["d"]["product_lines"] == "None" and got["d"]["current_stock"] == 0
    assert got["a"]["historical_revenue"] == 0  # its only order was cancelled


def test_closure_moves_stock_and_scales_capacity(m):
    got = by(warehouse.whatif_closure(*goods(m), {"Boats": "b"}, ["c"]), "warehouse_code")
    assert set(got) == {"a", "b", "d"}
    assert got["b"]["simulated_stock"] == 800 and got["b"]["product_lines"] == "Boats, Cars"
    assert got["b"]["simulated_warehouse"] == "East (Consolidated)"
    assert got["b"]["simulated_capacity_pct"] == D("89.1847")
    assert got["a"]["simulated_capacity_pct"] == 72
    cut = by(warehouse.whatif_closure(*goods(m), {"Boats": "b"}, ["c"], {"b": 0.5, "c": 0.5}), "warehouse_code")
    assert cut["b"]["simulated_stock"] == 400
    assert cut["b"]["simulated_revenue"] == got["b"]["simulated_revenue"]


def test_reallocation_conserves_stock_and_scales_by_all_old_stock(m):
    got = by(warehouse.whatif_closure(*goods(m), {"Boats": "b", "Cars": "c"}, []), "warehouse_code")
    assert sum(v["simulated_stock"] for v in got.values()) == 927
    assert got["b"]["simulated_capacity_pct"] == D("22.1847")  # 199 of 601, 67 %


def test_spread_join_equals_left_join(spark):
    left = spark.createDataFrame([(1, 5), (2, None), (3, None), (4, 9)], "id INT, k INT")
    right = spark.createDataFrame([(5, "five"), (0, "zero")], "r INT, name STRING")
    got = by(left_join_spread(left, right, "k", "r", ["id"]), "id")
    assert {i: v["name"] for i, v in got.items()} == {1: "five", 2: None, 3: None, 4: None}
