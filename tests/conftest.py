from __future__ import annotations

import sys
from datetime import date
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from wareflow.session import local_session, prepare  # noqa: E402
from wareflow.operators.clean import fold_text  # noqa: E402
from wareflow.sources.schemas import CANONICAL, schema_of  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    warehouse = tmp_path_factory.mktemp("warehouse")
    session = local_session(
        "tests",
        cpus=4,
        **{
            "spark.sql.warehouse.dir": str(warehouse),
            "spark.driver.host": "127.0.0.1",
            "spark.driver.bindAddress": "127.0.0.1",
        },
    )
    yield prepare(session)
    session.stop()


def d(text):
    return date.fromisoformat(text) if text else None


def frame(spark, table, rows):
    """Rows of a model table given as dicts, read as `load` reads them; columns left out are NULL."""
    schema = schema_of(table)
    raw = spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)
    return fold_text(raw, CANONICAL.get(table))


@pytest.fixture(scope="session")
def model(spark):
    """A few rows per table, with the cases the reports must get right."""
    places = [("a", "North", "72"), ("b", "East", "67"), ("c", "West", "50"), ("d", "South", "75")]
    products = [
        # code, line, stock, warehouse, cost
        ("P1", "Cars", 300, "b", "10.00"),  # exactly 3 x its 100 units
        ("P2", "Cars", 301, "b", "2.50"),  # just over 3 x 100
        ("P3", "Boats", 100, "c", "1.00"),  # exactly 1 x 100
        ("P4", "Boats", 99, "c", "4.00"),  # just under 1 x 100
        ("P5", "Bikes", 70, "a", "3.00"),  # never ordered
        ("P6", "Bikes", 50, "a", "6.00"),  # on a cancelled order only
        ("P7", "Trams", 7, "d", "5.55"),
    ]
    orders = [
        # no, ordered, required, shipped, status, comment, customer
        (1, "2004-01-01", "2004-01-20", "2004-01-15", "Shipped", None, 10),  # 5 early
        (2, "2004-01-01", "2004-01-20", "2004-01-16", "Shipped", "  ", 10),  # 4 early
        (3, "2004-01-01", "2004-01-20", "2004-01-20", "shipped", "Nice COLOR", 11),  # on the day
        (4, "2004-01-01", "2004-01-20", "2004-01-21", "Resolved", "wrong offer", 12),  # late
        (5, "2004-02-01", "2004-02-20", None, "Cancelled", "mistake; items missing", 10),
        (6, "2004-02-01", "2004-02-20", None, "On hold", "Credit Cleared, no sales", 11),
        (7, "2004-02-01", "2004-02-20", None, "Disputed ", None, 12),  # no lines
    ]
    lines = [
        (1, "P1", 60, "10.00"), (2, "P1", 40, "12.00"), (1, "P2", 100, "3.00"),
        (1, "P3", 100, "1.50"), (3, "P4", 100, "4.40"), (5, "P6", 20, "7.00"),
        (4, "P7", 1, "9.99"), (6, "P7", 3, "9.99"),
    ]
    customers = [
        (10, "Ada", "Norway", 1), (11, "Bo", "Norway  ", 2), (12, "Cy", "Japan", 3),
        (13, "Di", "USA", None),  # neither rep nor orders
    ]
    offices = [("1", "Paris", "France", "EMEA"), ("2", "Tokyo", "Japan", "Japan"),
               ("3", "Boston", "USA", "NA")]
    return {
        "warehouses": frame(spark, "warehouses", [
            dict(zip(("warehouseCode", "warehouseName", "warehousePctCap"), r)) for r in places]),
        "products": frame(spark, "products", [
            {"productCode": c, "productName": f"name {c}", "productLine": line,
             "quantityInStock": stock, "warehouseCode": w, "buyPrice": Decimal(cost)}
            for c, line, stock, w, cost in products]),
        "orders": frame(spark, "orders", [
            {"orderNumber": n, "orderDate": d(a), "requiredDate": d(b), "shippedDate": d(s),
             "status": st, "comments": c, "customerNumber": cu}
            for n, a, b, s, st, c, cu in orders]),
        "lines": frame(spark, "orderdetails", [
            {"orderNumber": n, "productCode": p, "quantityOrdered": q, "priceEach": Decimal(x)}
            for n, p, q, x in lines]),
        "customers": frame(spark, "customers", [
            {"customerNumber": n, "customerName": name, "country": c, "salesRepEmployeeNumber": r}
            for n, name, c, r in customers]),
        "employees": frame(spark, "employees", [
            {"employeeNumber": n, "firstName": f, "lastName": "Rep", "officeCode": o}
            for n, f, o in [(1, "Eve", "1"), (2, "Flo", "2"), (3, "Gus", "3")]]),
        "offices": frame(spark, "offices", [
            dict(zip(("officeCode", "city", "country", "territory"), r)) for r in offices]),
    }


def by(df, key):
    """Rows as dicts, by the value of one column."""
    return {r[key]: r.asDict() for r in df.collect()}
