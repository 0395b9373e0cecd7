"""The supplied rows reach every case that a report tells apart."""

import time

import pytest
from py4j.clientserver import ClientServerConnection

from tests.conftest import SMALL
from wareflow.functions import rules
from wareflow.functions.text import plain
from wareflow.operators.stock import ITEM_SCALE, WAREHOUSE_SCALE
from wareflow.plans.catalog import REPORTS
from wareflow.sources.supplied import Supplied

BASE = SMALL.replace("0.001", "0.01")


@pytest.fixture(scope="module")
def values(spark):
    def of(name, column):
        return {r[0] for r in REPORTS[name](Supplied(spark, BASE)).select(column).distinct().collect()}

    return of


@pytest.mark.parametrize(
    "name, column, wanted",
    [
        ("keyword_classify_exceptions", "keyword_class", {n for _, n in rules.EXCEPTION_RULES} | {rules.EXCEPTION_BLANK, rules.EXCEPTION_OTHER}),
        ("keyword_classify_delays", "keyword_class", {n for _, n in rules.DELAY_RULES} | {rules.DELAY_BLANK, rules.DELAY_OTHER}),
        ("keyword_friction_flags", "flag", {0, 1}),
        ("customer_friction", "client_status", {rules.CLIENT_INACTIVE, rules.CLIENT_DIFFICULT, rules.CLIENT_NORMAL}),
        ("delivery_performance", "delivery_performance", {rules.NOT_SHIPPED, rules.EARLY, rules.LATE, rules.ON_TIME}),
        ("active_countries", "region", {"NA", "APAC", "EMEA", rules.REGION_OTHER}),
        ("order_status_share", "order_status", {"Shipped", "Cancelled", "In Process", "Resolved", "On Hold", "Disputed"}),
        ("stock_health_corrected", "stock_health", {ITEM_SCALE.dead, ITEM_SCALE.overstock, ITEM_SCALE.restock, ITEM_SCALE.balanced}),
    ],
)
def test_every_class_occurs(values, name, column, wanted):
    assert values(name, column) == wanted


def test_audits_find_something(spark):
    rows = REPORTS["orphan_audit"](Supplied(spark, BASE)).collect()
    assert len(rows) == 9 and all(r.orphan_rows > 0 for r in rows)
    shares = REPORTS["warehouse_health_pct"](Supplied(spark, BASE)).collect()
    assert all(r.dead_sales_pct > 0 for r in shares) and WAREHOUSE_SCALE.dead
    assert REPORTS["inactive_customers"](Supplied(spark, BASE)).first().inactive_customers > 0
    names = {r.simulated_warehouse for r in REPORTS["whatif_close_west"](Supplied(spark, BASE)).collect()}
    assert "Unassigned" in names


def test_spellings_are_folded(spark):
    t = Supplied(spark, SMALL)
    typed = {r.status for r in t.orders_as_typed().select("status").distinct().collect()}
    assert {"SHIPPED", "shipped  ", "Shipped"} <= typed
    assert t.products().select("productLine").distinct().count() == 7  # six lines and the unlisted one


def test_texts_without_a_list_are_collated(spark):
    t = Supplied(spark, SMALL)
    free = t.customers().filter("country = 'FREEport '")
    assert {r[0] for r in free.select(plain("country")).distinct().collect()} == {"Freeport", "FREEPORT", "freeport"}
    names = t.products().groupBy("productName").count().count()
    spelled = t.products().select(plain("productName")).distinct().count()
    assert names < spelled
    shown = {r.country for r in REPORTS["active_countries"](t).collect()}
    assert "FREEPORT" in shown and not {"Freeport", "freeport"} & shown


@pytest.mark.parametrize("name", ["territory_line_rank", "regional_price_gap", "orphan_audit", "customer_friction"])
def test_a_report_is_described_in_few_calls(spark, monkeypatch, name):
    """Each call to the JVM costs some tenths of a millisecond; tables are described as SQL text."""
    REPORTS[name](Supplied(spark, SMALL))
    calls = []
    send = ClientServerConnection.send_command
    monkeypatch.setattr(ClientServerConnection, "send_command", lambda self, *a: calls.append(a) or send(self, *a))
    t = time.process_time()
    REPORTS[name](Supplied(spark, SMALL))
    assert 100 < len(calls) < 4500 and time.process_time() - t < 5


def test_lines_of_some_products_are_cancelled_throughout(spark):
    written = REPORTS["stock_health"](Supplied(spark, BASE)).count()
    corrected = REPORTS["stock_health_corrected"](Supplied(spark, BASE)).count()
    located = Supplied(spark, BASE).products().filter("warehouseCode IN ('a', 'b', 'c', 'd')").count()
    assert written < corrected < located
