"""The data model: nine tables with declared types, their keys and their references."""

from __future__ import annotations

from pyspark.sql.types import StructType

from wareflow.functions.rules import REGIONS

# Column names and types of the nine tables.
TABLES: dict[str, str] = {
    "customers": (
        "customerNumber BIGINT, customerName STRING, contactLastName STRING, contactFirstName STRING, "
        "phone STRING, addressLine1 STRING, addressLine2 STRING, city STRING, state STRING, "
        "postalCode STRING, country STRING, salesRepEmployeeNumber BIGINT, creditLimit DECIMAL(10,2)"
    ),
    "employees": (
        "employeeNumber BIGINT, lastName STRING, firstName STRING, extension STRING, email STRING, "
        "officeCode STRING, reportsTo BIGINT, jobTitle STRING"
    ),
    "offices": (
        "officeCode STRING, city STRING, phone STRING, addressLine1 STRING, addressLine2 STRING, "
        "state STRING, country STRING, postalCode STRING, territory STRING"
    ),
    "orderdetails": (
        "orderNumber BIGINT, productCode STRING, quantityOrdered INT, priceEach DECIMAL(10,2), "
        "orderLineNumber INT"
    ),
    "orders": (
        "orderNumber BIGINT, orderDate DATE, requiredDate DATE, shippedDate DATE, status STRING, "
        "comments STRING, customerNumber BIGINT"
    ),
    "payments": "customerNumber BIGINT, checkNumber STRING, paymentDate DATE, amount DECIMAL(10,2)",
    "productlines": "productLine STRING, textDescription STRING",
    "products": (
        "productCode STRING, productName STRING, productLine STRING, productScale STRING, "
        "productVendor STRING, productDescription STRING, quantityInStock INT, "
        "warehouseCode STRING, buyPrice DECIMAL(10,2), MSRP DECIMAL(10,2)"
    ),
    "warehouses": "warehouseCode STRING, warehouseName STRING, warehousePctCap STRING",
}

PRIMARY_KEYS: dict[str, tuple[str, ...]] = {
    "customers": ("customerNumber",),
    "employees": ("employeeNumber",),
    "offices": ("officeCode",),
    "orderdetails": ("orderNumber", "productCode"),
    "orders": ("orderNumber",),
    "payments": ("customerNumber", "checkNumber"),
    "productlines": ("productLine",),
    "products": ("productCode",),
    "warehouses": ("warehouseCode",),
}

# child table, child column, parent table, parent column
FOREIGN_KEYS: tuple[tuple[str, str, str, str], ...] = (
    ("customers", "salesRepEmployeeNumber", "employees", "employeeNumber"),
    ("employees", "reportsTo", "employees", "employeeNumber"),
    ("employees", "officeCode", "offices", "officeCode"),
    ("orderdetails", "orderNumber", "orders", "orderNumber"),
    ("orderdetails", "productCode", "products", "productCode"),
    ("orders", "customerNumber", "customers", "customerNumber"),
    ("payments", "customerNumber", "customers", "customerNumber"),
    ("products", "productLine", "productlines", "productLine"),
    ("products", "warehouseCode", "warehouses", "warehouseCode"),
)

# Tables that grow with the business; the others are dimensions.
FACTS = ("orderdetails", "orders", "payments")

# The spelling of known values; other text only loses its trailing blanks.
STATUSES = ("Shipped", "Cancelled", "In Process", "Resolved", "On Hold", "Disputed")
COUNTRIES = tuple(country for countries in REGIONS.values() for country in countries)
LINES = (
    "Classic Cars", "Motorcycles", "Planes", "Ships", "Trains", "Trucks and Buses", "Vintage Cars",
)
TERRITORIES = ("NA", "EMEA", "APAC", "Japan")
CODES = ("a", "b", "c", "d")
NAMES = ("North", "East", "West", "South")

# Text columns that are compared, by table.
CANONICAL: dict[str, dict[str, tuple[str, ...]]] = {
    "customers": {"country": COUNTRIES},
    "offices": {"country": COUNTRIES, "territory": TERRITORIES},
    "orders": {"status": STATUSES},
    "productlines": {"productLine": LINES},
    "products": {"productLine": LINES, "warehouseCode": CODES},
    "warehouses": {"warehouseCode": CODES, "warehouseName": NAMES},
}

# Text columns that are compared although not all their values are listed, by table.
COLLATED: dict[str, tuple[str, ...]] = {
    "customers": ("country",),
    "offices": ("country",),
    "products": ("productName",),
}

# The imported variant of orders, before its dates are normalised.
TEXT_DATES = ("orderDate", "requiredDate", "shippedDate")


def schema_of(table: str, text_dates: bool = False) -> StructType:
    """Declared schema of a table; with ``text_dates`` the three order dates are text."""
    ddl = TABLES[table]
    if text_dates and table == "orders":
        for name in TEXT_DATES:
            ddl = ddl.replace(f"{name} DATE", f"{name} STRING")
    return StructType.fromDDL(ddl)
