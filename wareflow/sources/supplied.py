"""The supplied star-schema tables seen as the retail data model.

Each method returns one table of the model as a lazy DataFrame over the Parquet files, so
filters and column selection reach the scan, and what a report does not read is not computed.
Every row of a file is a row of the model; keys decide which of the cases that reports tell apart a
row is: unsold products, idle customers, dangling references, comments of every kind. Statuses,
countries, lines, codes and product names come as people type them and are folded as they are read, or
collated where their values are not listed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wareflow.operators.clean import fold_text, override
from wareflow.sources.schemas import NAMES, STATUSES

#: Columns of the supplied tables that are read; no footer is needed to know them.
COLUMNS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_type STRING, p_size INT, p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_extendedprice DOUBLE",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE",
    "documents": "doc_id BIGINT, text STRING",
}
JAPAN = "NATION_2"  # the country whose office starts in a territory of its own

# product line -> warehouse
HOME = {
    "STANDARD": "a", "PROMO": "a", "ECONOMY": "b", "MEDIUM": "c", "SMALL": "d", "LARGE": "d",
}


COUNTRIES = tuple(f"NATION_{i}" for i in range(25))
SPELLING = {"status": STATUSES, "country": COUNTRIES, "productLine": tuple(HOME), "warehouseCode": tuple("abcdz"), "warehouseName": NAMES}

# Rules for the supplied documents, beside the defaults in functions.rules.
REASONS = (
    (("license", "Reason A"), ("mail|token", "Reason B"), ("ertion|onre", "Reason C")),
    "No reason",
    "Other reason",
)

# Comments by order number modulo their count: every rule, two rules at once, blank and missing.
COMMENTS = (
    None,
    "  ",
    "The SALES manager called",
    "Wrong offer: credit and scale",
    "Wrong color, a defect",
    "Customer in dispute, on Hold",
    "DAMAGED on arrival, parts missing",
    "Ordered by mistake",
    "was on hold  ",
    "Budget Approved after a complaint",
    "Cautious optimism; credit cleared",
    "Please cancel, they don't want it",
    "fine, thank you",
    "FINE, thank you  ",
)
FREEPORT = "Freeport"  # a country of some customers that no list knows
COLLATED = ("country", "productName")
UNKNOWN = 1_000_000_000  # added to a key, it refers to nothing

# Every 50th order is cancelled whatever its letter: some products are on such orders only.
STATUS = """CASE
    WHEN o_orderkey % 50 = 0 THEN 'Cancelled'
    WHEN o_orderstatus = 'F' THEN 'Shipped'
    WHEN o_orderstatus = 'O' THEN IF(o_orderpriority = '5-LOW', 'On Hold', 'In Process')
    ELSE CASE o_orderpriority
        WHEN '1-URGENT' THEN 'Disputed'
        WHEN '2-HIGH' THEN 'Cancelled'
        WHEN '3-MEDIUM' THEN 'Resolved'
        ELSE 'Shipped' END
    END"""

# Lines of some products are booked on the product before: parts 7, 27, ... are never sold, parts
# 13, 33, ... only on cancelled orders. Some lines name no known product, some no known order.
PRODUCT = f"""CASE
    WHEN l_orderkey % 101 = 5 THEN l_partkey + {UNKNOWN}
    WHEN l_partkey % 20 = 7 OR (l_partkey % 20 = 13 AND l_orderkey % 50 <> 0) THEN l_partkey - 1
    ELSE l_partkey END"""

# Orders of every tenth customer are booked on the customer before; some name no known customer.
BUYER = f"""CASE
    WHEN o_orderkey % 97 = 3 THEN o_custkey + {UNKNOWN}
    WHEN o_custkey % 10 = 7 THEN o_custkey - 1
    ELSE o_custkey END"""


def typed(expression: str, key: str) -> str:
    """Text as people type it: by key in upper case, in lower case with blanks after it, or as is."""
    return f"CASE {key} % 3 WHEN 0 THEN upper({expression}) WHEN 1 THEN concat(lower({expression}), '  ') ELSE {expression} END"


def _money(col: str, precision: int) -> str:
    """A double that holds whole cents, as an exact decimal. Goes through the integer number
    of cents; casting a double to a decimal prints and parses every value."""
    cents = f"CAST(CAST(RINT({col} * 100) AS BIGINT) AS DECIMAL({precision}, 0))"
    return f"CAST({cents} * 0.01BD AS DECIMAL({precision}, 2))"


def _map(pairs: dict[str, str], key: str) -> str:
    return "MAP(" + ", ".join(f"'{k}', '{v}'" for k, v in pairs.items()) + f")[{key}]"


class Supplied:
    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base

    def scan(self, name: str) -> DataFrame:
        return self.spark.read.schema(COLUMNS[name]).parquet(f"{self.base}/{name}.parquet")

    def folded(self, df: DataFrame, *columns: str) -> DataFrame:
        return fold_text(df, SPELLING, COLLATED, columns)

    def warehouses(self) -> DataFrame:
        return self.folded(
            self.spark.sql(
                "SELECT * FROM VALUES ('a', 'North', '72'), ('b', 'EAST', '67'), "
                "('C ', 'West  ', '50'), ('d', 'south', '75') "
                "AS w(warehouseCode, warehouseName, warehousePctCap)"
            ),
            "warehouseCode",
            "warehouseName",
        )

    def products(self) -> DataFrame:
        """Some are of a line that no table lists, some lie in an unknown warehouse or in none."""
        home = f"CASE WHEN p_partkey % 41 = 3 THEN 'z' WHEN p_partkey % 41 <> 4 THEN {_map(HOME, 'p_type')} END"
        line = "IF(p_partkey % 43 = 5, 'Unlisted', p_type)"
        return self.folded(
            self.scan("part").selectExpr(
                "p_partkey AS productCode",
                f"{typed('p_name', 'p_partkey')} AS productName",
                f"IF(p_partkey % 43 = 5, {line}, {typed('p_type', 'p_partkey')}) AS productLine",
                "p_size * 80 AS quantityInStock",
                f"{typed(home, 'p_partkey')} AS warehouseCode",
                f"{_money('p_retailprice', 10)} AS buyPrice",
            ),
            "productName",
            "productLine",
            "warehouseCode",
        )

    def productlines(self) -> DataFrame:
        return self.scan("part").selectExpr("p_type AS productLine").distinct()

    def offices(self, cleaned: bool = True) -> DataFrame:
        region = self.scan("region").withColumnRenamed("r_regionkey", "n_regionkey")
        raw = self.scan("nation").join(region, "n_regionkey").selectExpr(
            "CAST(n_nationkey AS STRING) AS officeCode",
            "n_name AS city",
            f"{typed('n_name', 'n_nationkey')} AS country",
            f"CASE WHEN n_name = '{JAPAN}' THEN 'Japan' WHEN r_name = 'AMERICA' THEN 'NA' "
            "WHEN r_name = 'ASIA' THEN 'APAC' ELSE 'EMEA' END AS territory",
        )
        folded = self.folded(raw, "country")
        return override(folded, "territory", [("country", JAPAN, "APAC")]) if cleaned else folded

    def employees(self) -> DataFrame:
        """Some have no first name, some an office or a superior that doesn't exist."""
        return self.scan("supplier").selectExpr(
            "s_suppkey AS employeeNumber",
            "split_part(s_name, '#', 2) AS lastName",
            "IF(s_suppkey % 29 = 4, NULL, split_part(s_name, '#', 1)) AS firstName",
            "IF(s_suppkey % 23 = 6, 'X', CAST(s_nationkey AS STRING)) AS officeCode",
            f"CASE WHEN s_suppkey % 31 = 9 THEN s_suppkey + {UNKNOWN} WHEN s_suppkey > 0 THEN s_suppkey DIV 10 END AS reportsTo",
        )

    def customers(self) -> DataFrame:
        reps = self.scan("supplier").selectExpr("count(*) AS reps").scalar()
        nation = self.scan("nation").selectExpr("n_nationkey AS c_nationkey", "n_name")
        country = f"IF(c_custkey % 29 = 11, '{FREEPORT}', n_name)"
        rep = f"CASE WHEN c_custkey % 37 = 5 THEN c_custkey + {UNKNOWN} WHEN c_acctbal >= 0 THEN c_custkey % reps END"
        return self.folded(
            self.scan("customer")
            .withColumn("reps", reps)
            .join(nation, "c_nationkey", "left")
            .selectExpr(
                "c_custkey AS customerNumber",
                "c_name AS customerName",
                "n_name AS city",
                f"{typed(country, 'c_custkey')} AS country",
                f"{rep} AS salesRepEmployeeNumber",
            ),
            "country",
        )

    def orders_as_typed(self) -> DataFrame:
        """Orders with status, required date and shipped date, by arithmetic on their own row."""
        return self.scan("orders").selectExpr(
            "o_orderkey AS orderNumber",
            f"{BUYER} AS customerNumber",
            "CAST(o_orderdate AS DATE) AS orderDate",
            "date_add(CAST(o_orderdate AS DATE), 30) AS requiredDate",
            "IF(o_orderkey % 9 = 4, NULL, date_add(CAST(o_orderdate AS DATE), CAST((o_orderkey * 7 + o_custkey) % 40 AS INT))) AS shippedDate",
            f"{typed(STATUS, 'o_orderkey')} AS status",
        )

    def orders(self, comments: bool = False) -> DataFrame:
        """Orders in canonical form.

        Comments cost a join with the documents, so they come on request: an order's remark is
        followed by the document of its number, if there is one.
        """
        orders = self.folded(self.orders_as_typed(), "status")
        if not comments:
            return orders
        remarks = ", ".join("NULL" if c is None else "'" + c.replace("'", "\\'") + "'" for c in COMMENTS)
        remark = f"element_at(array({remarks}), CAST(orderNumber % {len(COMMENTS)} AS INT) + 1)"
        notes = self.scan("documents").selectExpr("doc_id AS orderNumber", "text")
        return orders.join(notes, "orderNumber", "left").selectExpr(
            *orders.columns, f"IF(text IS NULL, {remark}, concat({remark}, '\n', text)) AS comments"
        )

    def orders_with_text_dates(self) -> DataFrame:
        """Dates as an import leaves them: formats mixed, one-digit days, blanks, not dates at all."""
        ordered = "CAST(o_orderdate AS DATE)"
        required = f"date_add({ordered}, 30)"
        return self.scan("orders").selectExpr(
            "o_orderkey AS orderNumber",
            "date_format(o_orderdate, IF(o_orderkey % 2 = 0, 'dd-MM-yyyy', 'yyyy-MM-dd')) AS orderDate",
            "CASE WHEN o_orderkey % 7 = 0 THEN 'unknown' "
            f"WHEN o_orderkey % 3 = 0 THEN date_format({required}, 'd-M-yyyy') "
            f"ELSE date_format({required}, 'yyyy-MM-dd') END AS requiredDate",
            f"CASE WHEN o_orderkey % 5 = 0 THEN NULL WHEN o_orderkey % 5 = 1 THEN concat(date_format({ordered}, 'yyyy-M-d'), ' ') "
            f"ELSE date_format({ordered}, 'dd-MM-yyyy') END AS shippedDate",
        )

    def lines(self) -> DataFrame:
        return self.scan("lineitem").selectExpr(
            f"IF(l_orderkey % 103 = 8, l_orderkey + {UNKNOWN}, l_orderkey) AS orderNumber",
            f"{PRODUCT} AS productCode",
            "CAST(l_quantity AS INT) AS quantityOrdered",
            f"{_money('l_extendedprice', 12)} AS priceEach",
            "l_linenumber AS orderLineNumber",
        )

    def payments(self) -> DataFrame:
        return self.scan("events").filter("event_type = 'purchase'").selectExpr(
            f"IF(user_id % 19 = 8, user_id + {UNKNOWN}, user_id) AS customerNumber",
            "CAST(event_id AS STRING) AS checkNumber",
            "CAST(ts AS DATE) AS paymentDate",
            "CAST(value AS DECIMAL(10, 2)) AS amount",
        )
