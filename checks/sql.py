"""What each report must return, as plain SQL over the supplied tables.

Written independently of the Spark code: lines are joined first and aggregated once, in one
piece, where the Spark plans reduce them step by step.
"""

from __future__ import annotations

_BINDING = """
wh(code, name, pct) AS (
  VALUES ('a', 'North', 72.0::DOUBLE), ('b', 'East', 67.0), ('c', 'West', 50.0), ('d', 'South', 75.0)),
prod AS (
  SELECT p_partkey AS code, CASE p_partkey % 3 WHEN 0 THEN upper(p_name) WHEN 1 THEN lower(p_name) ELSE p_name END AS name, CASE WHEN p_partkey % 43 = 5 THEN 'Unlisted' ELSE p_type END AS line,
         p_size * 80 AS stock,
         CASE WHEN p_partkey % 41 = 3 THEN 'z' WHEN p_partkey % 41 = 4 THEN NULL
              WHEN p_type IN ('STANDARD', 'PROMO') THEN 'a' WHEN p_type = 'ECONOMY' THEN 'b'
              WHEN p_type = 'MEDIUM' THEN 'c' WHEN p_type IN ('SMALL', 'LARGE') THEN 'd' END AS wcode,
         CAST(p_retailprice AS DECIMAL(10,2)) AS cost
  FROM part),
office_raw AS (
  SELECT CAST(n_nationkey AS VARCHAR) AS code, n_name AS country,
         CASE WHEN n_name = 'NATION_2' THEN 'Japan' WHEN r_name = 'AMERICA' THEN 'NA'
              WHEN r_name = 'ASIA' THEN 'APAC' ELSE 'EMEA' END AS terr
  FROM nation JOIN region ON n_regionkey = r_regionkey),
office AS (
  SELECT code, country, CASE WHEN country = 'NATION_2' THEN 'APAC' ELSE terr END AS terr
  FROM office_raw),
emp AS (
  SELECT s_suppkey AS id, CASE WHEN s_suppkey % 23 = 6 THEN 'X' ELSE CAST(s_nationkey AS VARCHAR) END AS ocode,
         CASE WHEN s_suppkey % 29 <> 4 THEN replace(s_name, '#', ' ') END AS name,
         CASE WHEN s_suppkey % 31 = 9 THEN s_suppkey + 1000000000 WHEN s_suppkey > 0 THEN s_suppkey // 10 END AS boss
  FROM supplier),
cust AS (
  SELECT c_custkey AS id, c_name AS name,
         CASE WHEN c_custkey % 29 <> 11 THEN n_name WHEN c_custkey % 3 = 0 THEN 'FREEPORT'
              WHEN c_custkey % 3 = 1 THEN 'freeport' ELSE 'Freeport' END AS country,
         CASE WHEN c_custkey % 37 = 5 THEN c_custkey + 1000000000
              WHEN c_acctbal >= 0 THEN c_custkey % (SELECT count(*) FROM supplier) END AS rep
  FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey),
lin AS (
  SELECT CASE WHEN l_orderkey % 103 = 8 THEN l_orderkey + 1000000000 ELSE l_orderkey END AS ono,
         CASE WHEN l_orderkey % 101 = 5 THEN l_partkey + 1000000000
              WHEN l_partkey % 20 = 7 THEN l_partkey - 1
              WHEN l_partkey % 20 = 13 AND l_orderkey % 50 <> 0 THEN l_partkey - 1 ELSE l_partkey END AS pcode,
         l_linenumber AS pos, CAST(l_quantity AS INTEGER) AS qty,
         CAST(l_extendedprice AS DECIMAL(12,2)) AS price,
         CAST(CAST(l_quantity AS INTEGER) * CAST(l_extendedprice AS DECIMAL(12,2)) AS DECIMAL(18,2)) AS rev
  FROM lineitem),
remark(k, said) AS (
  VALUES (0, NULL), (1, '  '), (2, 'The SALES manager called'), (3, 'Wrong offer: credit and scale'),
         (4, 'Wrong color, a defect'), (5, 'Customer in dispute, on Hold'),
         (6, 'DAMAGED on arrival, parts missing'), (7, 'Ordered by mistake'), (8, 'was on hold  '),
         (9, 'Budget Approved after a complaint'), (10, 'Cautious optimism; credit cleared'),
         (11, 'Please cancel, they don''t want it'), (12, 'fine, thank you'), (13, 'FINE, thank you  ')),
ord AS (
  SELECT o_orderkey AS no,
         CASE WHEN o_orderkey % 97 = 3 THEN o_custkey + 1000000000
              WHEN o_custkey % 10 = 7 THEN o_custkey - 1 ELSE o_custkey END AS cno,
         CAST(o_orderdate AS DATE) AS placed,
         CAST(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY AS DATE) AS due,
         CASE WHEN o_orderkey % 9 <> 4 THEN CAST(o_orderdate AS DATE) + CAST((o_orderkey * 7 + o_custkey) % 40 AS INTEGER) END AS shipped,
         CASE WHEN text IS NULL THEN said ELSE said || chr(10) || text END AS note,
         CASE WHEN o_orderkey % 50 = 0 THEN 'Cancelled' ELSE CASE o_orderstatus
           WHEN 'F' THEN 'Shipped'
           WHEN 'O' THEN CASE o_orderpriority WHEN '5-LOW' THEN 'On Hold' ELSE 'In Process' END
           ELSE CASE o_orderpriority WHEN '1-URGENT' THEN 'Disputed' WHEN '2-HIGH' THEN 'Cancelled'
                                     WHEN '3-MEDIUM' THEN 'Resolved' ELSE 'Shipped' END
         END END AS status
  FROM orders JOIN remark ON k = o_orderkey % 14 LEFT JOIN documents ON doc_id = o_orderkey),
pay AS (
  SELECT CASE WHEN user_id % 19 = 8 THEN user_id + 1000000000 ELSE user_id END AS cno, CAST(event_id AS VARCHAR) AS doc, CAST(value AS DECIMAL(10,2)) AS amount
  FROM events WHERE event_type = 'purchase'),
place AS (SELECT prod.*, wh.name AS wname, wh.pct FROM prod JOIN wh ON wcode = wh.code),
spot AS (SELECT prod.*, wh.name AS wname FROM prod LEFT JOIN wh ON wcode = wh.code),
home AS (
  SELECT cust.id AS cno, office.code AS ocode, terr
  FROM cust JOIN emp ON rep = emp.id JOIN office ON ocode = office.code)
"""


def _q(body: str, **parts: str) -> str:
    for name, text in parts.items():
        body = body.replace("{" + name + "}", text)
    return f"WITH {_BINDING.strip()}\n{body.strip()}"


def _r(expr: str, digits: int = 2) -> str:
    """Roots: rounded from DECIMAL(24,6), since their last bits depend on the order of sums."""
    return f"CAST(round(CAST({expr} AS DECIMAL(24,6)), {digits}) AS DOUBLE)"


def _quot(num: str, den: str, digits: int = 2, times: int = 1) -> str:
    """num * times / den of counts or money, rounded half up in whole numbers; den is positive."""
    n, d = (f"CAST(CAST({x} AS DECIMAL(28,2)) * 100 AS HUGEINT)" for x in (num, den))
    return f"CAST((2 * {n} * {times * 10**digits} + nullif({d}, 0)) // (2 * nullif({d}, 0)) AS DOUBLE) / {10**digits}"


def _pct(num: str, den: str, digits: int = 2) -> str:
    return _quot(num, den, digits, 100)


_EXCEPTION = """CASE WHEN regexp_matches(note, '(?i)sales|budget|credit|offer') THEN 'Budgeting Issues'
  WHEN regexp_matches(note, '(?i)wrong|defect|complaint|color|scale|dispute') THEN 'Product Quality Issue'
  WHEN regexp_matches(note, '(?i)damag|missing') THEN 'Shipping issues'
  WHEN regexp_matches(note, '(?i)mistake') THEN 'Mistaken order'
  WHEN note IS NULL OR trim(note) = '' THEN 'No Reason Provided' ELSE 'Other Reasons' END"""
_DELAY = """CASE WHEN regexp_matches(note, '(?i)budget|credit|offer|hold') THEN 'Previously on hold'
  WHEN regexp_matches(note, '(?i)complaint|color|scale|dispute') THEN 'Previously disputed'
  WHEN regexp_matches(note, '(?i)damag|missing') THEN 'Shipping issues'
  WHEN regexp_matches(note, '(?i)mistake') THEN 'Mistaken order'
  WHEN regexp_matches(note, '(?i)on hold') THEN 'Previously on hold'
  WHEN note IS NULL OR trim(note) = '' THEN 'No comment' ELSE 'Irrelevant comments' END"""
_FRICTION = """CASE
  WHEN regexp_matches(note, '(?i)cautious optimism|budget approved|credit cleared') THEN 0
  WHEN regexp_matches(note, '(?i)sales|budget|credit|cautions|damag|missing|mistake|cancel|don') THEN 1
  ELSE 0 END"""

ORACLE: dict[str, str] = {}

# --- cleaning and quality -------------------------------------------------------------

_TEXT_DATES = """, txt AS (
  SELECT o_orderkey AS k,
         CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d-%m-%Y')
              ELSE strftime(o_orderdate, '%Y-%m-%d') END AS a,
         CASE WHEN o_orderkey % 7 = 0 THEN 'unknown'
              WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate + INTERVAL 30 DAY, '%-d-%-m-%Y')
              ELSE strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') END AS b,
         CASE WHEN o_orderkey % 5 = 0 THEN NULL
              WHEN o_orderkey % 5 = 1 THEN strftime(o_orderdate, '%Y-%-m-%-d') || ' '
              ELSE strftime(o_orderdate, '%d-%m-%Y') END AS c
  FROM orders)"""


def _date(col: str, fmt: str) -> str:
    return f"strftime(try_strptime(trim({col}), '{fmt}'), '%Y-%m-%d')"


_ISO, _DMY = "%Y-%m-%d", "%d-%m-%Y"
_OFF_ISO = "({0} IS NOT NULL AND NOT regexp_full_match(trim({0}), '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}}'))"
_DATE_COLUMNS = (("a", "orderDate"), ("b", "requiredDate"), ("c", "shippedDate"))
ORACLE["normalize_dates"] = _q('{pre} SELECT k AS "orderNumber", {cols} FROM txt', pre=_TEXT_DATES, cols=", ".join(
    f'coalesce({_date(c, _ISO)}, {_date(c, _DMY)}) AS "{name}"' for c, name in _DATE_COLUMNS))
ORACLE["normalize_dates_whole_row"] = _q('{pre} SELECT k AS "orderNumber", {cols} FROM txt', pre=_TEXT_DATES, cols=", ".join(
    f'CASE WHEN {" OR ".join(_OFF_ISO.format(x) for x, _ in _DATE_COLUMNS)} THEN {_date(c, _DMY)} ELSE {_date(c, _ISO)} END AS "{name}"'
    for c, name in _DATE_COLUMNS))
ORACLE["normalize_dates_update"] = ORACLE["normalize_dates"]
_NO_DATE = "NOT regexp_full_match({0}, '[0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}} ?')"
ORACLE["ingest_reasons"] = _q("{pre} SELECT * FROM ({rows}) AS r WHERE n_rows > 0", pre=_TEXT_DATES, rows=" UNION ALL ".join(
    f"SELECT '{name} is not date' AS reason, count(*) AS n_rows FROM txt WHERE {c} IS NOT NULL AND {_NO_DATE.format(c)}" for c, name in _DATE_COLUMNS))
ORACLE["duplicate_keys"] = _q("""
, keyed AS (
  SELECT 'Product Code' AS t, CAST(code AS VARCHAR) AS k FROM prod
  UNION ALL SELECT 'Order Number', CAST(no AS VARCHAR) FROM ord
  UNION ALL SELECT 'Order Line', ono || '|' || pos FROM lin)
SELECT t AS duplicate_type, k AS identifier, count(*) AS duplicate_count
FROM keyed GROUP BY t, k HAVING count(*) > 1""")
ORACLE["null_audit_payments"] = _q("""
SELECT count(*) AS total_rows, count(*) - count(cno) AS missing_customers,
       count(*) - count(doc) AS missing_check_number, count(*) - count(amount) AS missing_amount
FROM pay""")
ORACLE["null_audit_orders"] = _q("""
SELECT count(*) AS total_rows, count(*) - count(placed) AS missing_order_date,
       count(*) - count(due) AS missing_required_date
FROM ord""")
ORACLE["null_audit_customers"] = _q("""
SELECT count(*) AS total_rows, count(*) - count(rep) AS missing_sales_rep,
       count(*) - count(country) AS missing_city, count(*) - count(id) AS missing_customer,
       count(*) - count(country) AS missing_country
FROM cust""")
for _name, _from in (("office_territories", "office_raw"), ("territory_override", "office")):
    ORACLE[_name] = _q(f"""
SELECT code AS "officeCode", country AS city, country, terr AS territory FROM {_from}""")

_KEYS = {
    "customers": "SELECT id AS k FROM cust",
    "employees": "SELECT id FROM emp",
    "offices": "SELECT code FROM office",
    "orderdetails": "SELECT ono || '|' || pcode FROM lin",
    "orders": "SELECT no FROM ord",
    "payments": "SELECT cno || '|' || doc FROM pay",
    "productlines": "SELECT DISTINCT p_type FROM part",
    "products": "SELECT code FROM prod",
    "warehouses": "SELECT code FROM wh",
}
ORACLE["key_audit"] = _q(
    ", k AS (" + " UNION ALL ".join(
        f"SELECT '{t}' AS t, CAST(k AS VARCHAR) AS k FROM ({sql}) AS s(k)" for t, sql in _KEYS.items()
    ) + """), g AS (SELECT t, k, count(*) AS n FROM k GROUP BY t, k)
SELECT t AS table_name, CAST(sum(n) AS BIGINT) AS total_rows, count(*) AS distinct_keys,
       count(*) FILTER (WHERE n > 1) AS duplicate_keys,
       CAST(coalesce(sum(n) FILTER (WHERE k IS NULL), 0) AS BIGINT) AS null_key_rows
FROM g GROUP BY t""")

_REFS = [
    ("customers.salesRepEmployeeNumber", "SELECT rep FROM cust", "SELECT id FROM emp"),
    ("employees.reportsTo", "SELECT boss FROM emp", "SELECT id FROM emp"),
    ("employees.officeCode", "SELECT ocode FROM emp", "SELECT code FROM office"),
    ("orderdetails.orderNumber", "SELECT ono FROM lin", "SELECT no FROM ord"),
    ("orderdetails.productCode", "SELECT pcode FROM lin", "SELECT code FROM prod"),
    ("orders.customerNumber", "SELECT cno FROM ord", "SELECT id FROM cust"),
    ("payments.customerNumber", "SELECT cno FROM pay", "SELECT id FROM cust"),
    ("products.productLine", "SELECT line FROM prod", "SELECT p_type FROM part"),
    ("products.warehouseCode", "SELECT wcode FROM prod", "SELECT code FROM wh"),
]
ORACLE["orphan_audit"] = _q("\nUNION ALL ".join(
    f"SELECT '{name}' AS reference, count(*) AS orphan_rows, count(DISTINCT v) AS orphan_values "
    f"FROM ({child}) AS c(v) WHERE v IS NOT NULL AND NOT EXISTS "
    f"(SELECT 1 FROM ({parent}) AS p(x) WHERE x = v)"
    for name, child, parent in _REFS))

# --- territories ----------------------------------------------------------------------

ORACLE["territory_sales_share"] = _q("""
, s AS (
  SELECT terr, count(DISTINCT ocode) AS offices, sum(rev) AS sales
  FROM lin JOIN ord ON no = ono JOIN home USING (cno) GROUP BY terr)
SELECT terr AS territory, offices AS offices_in_region, CAST(sales AS DOUBLE) AS region_sales,
       CAST(sum(sales) OVER () AS DOUBLE) AS grand_total_sales,
       {share} AS market_share_pct
FROM s""", share=_pct("sales", "sum(sales) OVER ()", 0))
ORACLE["territory_line_rank"] = _q("""
, s AS (
  SELECT terr, line, sum(rev) AS sales
  FROM lin JOIN ord ON no = ono JOIN home USING (cno) JOIN prod ON pcode = prod.code
  GROUP BY terr, line)
SELECT terr AS territory, line AS product_line, CAST(sales AS DOUBLE) AS product_sales,
       {share} AS sales_pct,
       dense_rank() OVER (PARTITION BY terr ORDER BY sales DESC) AS region_rank
FROM s""", share=_pct("sales", "sum(sales) OVER (PARTITION BY terr)"))


def _price_gap(gap: str) -> str:
    names = ("na", "emea", "apac")
    per = ", ".join(
        f"avg(CAST(price AS DOUBLE)) FILTER (WHERE terr = '{t.upper()}') AS a_{t}, "
        f"sum(price) FILTER (WHERE terr = '{t.upper()}') AS p_{t}, "
        f"stddev_samp(CAST(price AS DOUBLE)) FILTER (WHERE terr = '{t.upper()}') AS s_{t}, "
        f"count(*) FILTER (WHERE terr = '{t.upper()}') AS n_{t}" for t in names)
    out = ", ".join(
        f"{_quot(f'p_{t}', f'n_{t}')} AS avg_price_{t}, {_r(f's_{t}')} AS std_dev_{t}, "
        f"{_r(f's_{t} / nullif(sqrt(n_{t}), 0)')} AS std_error_{t}" for t in names)
    return _q(f"""
, s AS (
  SELECT pcode, {per}
  FROM lin JOIN ord ON no = ono JOIN home USING (cno) GROUP BY pcode)
SELECT pcode AS product_code, name AS product_name, line AS product_line, {out},
       {_r(gap)} AS max_price_difference
FROM s JOIN prod ON code = pcode""")


ORACLE["regional_price_gap"] = _price_gap(
    "greatest(coalesce(a_na, 0), coalesce(a_emea, 0), coalesce(a_apac, 0))"
    " - least(coalesce(a_na, 999999), coalesce(a_emea, 999999), coalesce(a_apac, 999999))")
ORACLE["regional_price_gap_corrected"] = _price_gap(
    "CASE WHEN (n_na > 0)::INT + (n_emea > 0)::INT + (n_apac > 0)::INT >= 2 THEN "
    "list_max(list_filter([a_na, a_emea, a_apac], lambda x: x IS NOT NULL))"
    " - list_min(list_filter([a_na, a_emea, a_apac], lambda x: x IS NOT NULL)) END")
ORACLE["warehouse_to_territory"] = _q("""
SELECT terr AS destination_region, count(DISTINCT no) AS total_orders_shipped,
       CAST(coalesce(sum(qty) FILTER (WHERE wname = 'North'), 0) AS BIGINT) AS from_north,
       CAST(coalesce(sum(qty) FILTER (WHERE wname = 'East'), 0) AS BIGINT) AS from_east,
       CAST(coalesce(sum(qty) FILTER (WHERE wname = 'West'), 0) AS BIGINT) AS from_west,
       CAST(coalesce(sum(qty) FILTER (WHERE wname = 'South'), 0) AS BIGINT) AS from_south,
       CAST(sum(qty) AS BIGINT) AS grand_total_units
FROM lin JOIN place ON pcode = code JOIN ord ON no = ono JOIN home USING (cno)
WHERE shipped IS NOT NULL GROUP BY terr""")

# --- customers, status, comments ------------------------------------------------------

ORACLE["inactive_customers"] = _q(f"""
SELECT count(*) FILTER (WHERE no IS NULL) AS inactive_customers,
       {_pct("count(*) FILTER (WHERE no IS NULL)", "count(DISTINCT id)")} AS inactive_pct
FROM cust LEFT JOIN ord ON cno = id""")
ORACLE["active_countries"] = _q("""
SELECT CASE WHEN country = 'NATION_0' OR r_name IS NULL THEN 'Other/Unknown' WHEN r_name = 'AMERICA' THEN 'NA'
            WHEN r_name = 'ASIA' THEN 'APAC' ELSE 'EMEA' END AS region,
       min(country) AS country, count(DISTINCT id) AS active_customers, count(DISTINCT no) AS total_orders
FROM cust JOIN ord ON cno = id LEFT JOIN nation ON n_name = country LEFT JOIN region ON r_regionkey = n_regionkey
GROUP BY 1, lower(country)""")
ORACLE["customer_friction"] = _q("""
, f AS (SELECT cno, lower(rtrim(note, ' ')) AS note, no, {flag} AS flag FROM ord)
SELECT country, cust.id AS customer_number, cust.name AS customer_name,
       coalesce(emp.name, 'No Rep Assigned') AS sales_representative,
       count(DISTINCT no) AS total_orders,
       CASE WHEN count(no) = 0 THEN 'Inactive (Zero Orders)' WHEN sum(flag) > 0 THEN 'Difficult Client'
            ELSE 'Good / Normal Client' END AS client_status,
       CAST(coalesce(sum(flag), 0) AS BIGINT) || ' of ' || count(DISTINCT no) AS friction_ratio,
       count(DISTINCT note) AS distinct_comments
FROM cust LEFT JOIN f ON cno = cust.id LEFT JOIN emp ON emp.id = rep
GROUP BY country, cust.id, cust.name, emp.name""", flag=_FRICTION)
ORACLE["customer_comments"] = _q("""
SELECT cno AS customer_number, min(rtrim(note, ' ')) AS comments, count(*) AS n_orders
FROM ord WHERE note IS NOT NULL GROUP BY cno, lower(rtrim(note, ' '))""")
ORACLE["order_status_share"] = _q("""
SELECT status AS order_status, count(*) AS total_orders,
       {share} AS pct_of_total FROM ord GROUP BY status""",
    share=_pct("count(*)", "(SELECT count(*) FROM ord)"))
ORACLE["folded_status_share"] = ORACLE["order_status_share"]
ORACLE["order_exceptions"] = _q("""
SELECT no AS order_number, cno AS customer_number, country,
       string_agg(DISTINCT line, ', ' ORDER BY line) AS affected_product_lines,
       string_agg(DISTINCT wname, ', ' ORDER BY wname) AS affected_warehouses,
       CAST(CASE WHEN status = 'Cancelled' THEN coalesce(sum(qty), 0) ELSE 0 END AS BIGINT)
         AS total_items_cancelled,
       status, {reason} AS reason
FROM ord LEFT JOIN lin ON ono = no LEFT JOIN spot ON pcode = code LEFT JOIN cust ON cust.id = cno
WHERE status IN ('Disputed', 'Cancelled', 'Resolved')
GROUP BY no, cno, country, status, note""", reason=_EXCEPTION)
ORACLE["disputed_products"] = _q("""
SELECT min(name) AS product_name, count(*) AS times_disputed, count(DISTINCT ono) AS orders_involved
FROM lin JOIN prod ON code = pcode JOIN ord ON no = ono WHERE status = 'Disputed' GROUP BY lower(name)""")
ORACLE["disputed_product_orders"] = _q("""
SELECT min(name) AS product_name, ono AS order_number, count(*) AS times_disputed
FROM lin JOIN prod ON code = pcode JOIN ord ON no = ono WHERE status = 'Disputed' GROUP BY lower(name), ono""")
ORACLE["keyword_classify"] = """
SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)license') THEN 'Reason A'
  WHEN regexp_matches(text, '(?i)mail|token') THEN 'Reason B'
  WHEN regexp_matches(text, '(?i)ertion|onre') THEN 'Reason C'
  WHEN text IS NULL OR trim(text) = '' THEN 'No reason' ELSE 'Other reason' END AS keyword_class FROM documents"""
for _name, _label in (("exceptions", _EXCEPTION), ("delays", _DELAY)):
    ORACLE[f"keyword_classify_{_name}"] = _q(
        'SELECT no AS "orderNumber", {label} AS keyword_class FROM ord', label=_label)
ORACLE["keyword_friction_flags"] = _q('SELECT no AS "orderNumber", {flag} AS flag FROM ord', flag=_FRICTION)

# --- delivery -------------------------------------------------------------------------

ORACLE["delivery_performance"] = _q("""
SELECT CASE WHEN shipped IS NULL THEN 'Not shipped' WHEN due - shipped >= 5 THEN 'Early'
            WHEN due < shipped THEN 'Late' ELSE 'On time' END AS delivery_performance,
       count(*) AS total_orders,
       coalesce(CAST(CAST({days} AS BIGINT) AS VARCHAR), 'NA') AS avg_days_to_ship
FROM ord GROUP BY 1""", days=_quot("sum(shipped - placed)", "count(shipped)", 0))

_BY_COUNTRY = """
SELECT {count} AS number_of_orders, CAST({days} AS BIGINT) AS avg_days_to_ship, min(country) AS country,
       string_agg(DISTINCT wname, ',' ORDER BY wname) AS warehouses_affected
FROM ord JOIN cust ON cust.id = cno JOIN lin ON ono = no JOIN place ON pcode = code
WHERE shipped IS NOT NULL AND {extra} GROUP BY lower(country)"""
_LINE_DAYS = _quot("sum(shipped - placed)", "count(*)", 0)
ORACLE["shipping_by_country"] = _q(_BY_COUNTRY, count="count(*)", days=_LINE_DAYS, extra="true")
ORACLE["shipping_by_country_excl"] = _q(
    _BY_COUNTRY, count="count(*)", days=_LINE_DAYS,
    extra="no <> (SELECT no FROM ord WHERE shipped IS NOT NULL ORDER BY shipped - placed DESC, no LIMIT 1)")
ORACLE["shipping_by_country_corrected"] = _q("""
, o AS (
  SELECT DISTINCT no, country, shipped - placed AS days
  FROM ord JOIN cust ON cust.id = cno JOIN lin ON ono = no JOIN place ON pcode = code
  WHERE shipped IS NOT NULL),
a AS (SELECT min(country) AS country, count(*) AS n, {days} AS d FROM o GROUP BY lower(country))
SELECT n AS number_of_orders, CAST(d AS BIGINT) AS avg_days_to_ship, country, warehouses_affected
FROM a JOIN (
  SELECT min(country) AS country, string_agg(DISTINCT wname, ',' ORDER BY wname) AS warehouses_affected
  FROM ord JOIN cust ON cust.id = cno JOIN lin ON ono = no JOIN place ON pcode = code
  WHERE shipped IS NOT NULL GROUP BY lower(country)) USING (country)""", days=_quot("sum(days)", "count(*)", 0))
ORACLE["slowest_orders"] = _q("""
SELECT no AS order_number, CAST(placed AS VARCHAR) AS order_date, CAST(shipped AS VARCHAR) AS shipped_date,
       country, CAST(shipped - placed AS INTEGER) AS ship_days,
       string_agg(DISTINCT wname, ', ' ORDER BY wname) AS affected_warehouses, {reason} AS reason
FROM ord JOIN lin ON ono = no JOIN cust ON cust.id = cno JOIN place ON pcode = code
WHERE shipped IS NOT NULL GROUP BY no, placed, shipped, country, note""", reason=_DELAY)

# --- inventory and stock --------------------------------------------------------------

ORACLE["line_stock_vs_sales"] = _q("""
, s AS (
  SELECT wcode, wname, line, sum(qty) AS units, count(DISTINCT pcode) AS np, sum(rev) AS rev,
         stddev_samp(CAST(price AS DOUBLE)) AS dev, count(*) AS n
  FROM lin JOIN place ON pcode = code JOIN ord ON no = ono WHERE status = 'Shipped'
  GROUP BY wcode, wname, line),
h AS (SELECT wcode, line, sum(stock) AS stock, sum(stock * cost) AS cap FROM prod GROUP BY wcode, line)
SELECT wname AS warehouse_name, line AS product_line, CAST(stock AS BIGINT) AS units_stock,
       CAST(units AS BIGINT) AS units_sold, np AS unique_products,
       {share} AS pct_of_total_sales, {sold} AS sold_to_stock_ratio,
       CAST(cap AS DOUBLE) AS tied_capital, CAST(rev AS DOUBLE) AS total_revenue,
       coalesce({unit}, 0) AS average_revenue_per_unit, coalesce({dev}, 0) AS price_stddev,
       coalesce({err}, 0) AS std_error
FROM s JOIN h USING (wcode, line)""",
    share=_pct("units", "sum(units) OVER ()"), sold=_pct("units", "(stock + units)", 1),
    unit=_quot("rev", "units"), dev=_r("dev"),
    err=_r("dev / nullif(sqrt(n), 0)"))


def _product_revenue(lines: str) -> str:
    return _q("""
SELECT code AS product_code, name AS product_name, wname AS warehouse_name,
       CAST(coalesce(sum(qty), 0) AS BIGINT) AS total_units_sold, stock AS in_stock_units,
       count(DISTINCT ono) AS total_sales_transactions,
       CAST(coalesce(sum(rev), 0) AS DOUBLE) AS total_revenue,
       coalesce({unit}, 0) AS average_revenue_per_unit
FROM place LEFT JOIN {lines} ON pcode = code
GROUP BY code, name, wname, stock""", lines=lines,
        unit=_quot("sum(rev)", "sum(qty)"))


_KEPT_LINES = "(SELECT lin.* FROM lin JOIN ord ON no = ono WHERE status <> 'Cancelled') AS kept"
ORACLE["product_revenue"] = _product_revenue("lin")
ORACLE["product_revenue_corrected"] = _product_revenue(_KEPT_LINES)


ORACLE["product_rank"] = _q("""
, s AS (SELECT pcode, sum(qty) AS units, sum(rev) AS rev FROM lin GROUP BY pcode)
SELECT code AS product_code, name AS product_name, wname AS warehouse_name, CAST(coalesce(units, 0) AS BIGINT) AS total_units_sold,
       CAST(coalesce(rev, 0) AS DOUBLE) AS total_revenue, dense_rank() OVER (ORDER BY coalesce(rev, 0) DESC) AS revenue_rank
FROM spot LEFT JOIN s ON pcode = code""")


ORACLE["monthly_sales"] = _q("""
SELECT pcode AS "productCode", strftime(placed, '%Y-%m') AS month, count(*) AS n_lines, CAST(sum(qty) AS BIGINT) AS units,
       CAST(sum(rev) AS DOUBLE) AS revenue, CAST(min(price) AS DOUBLE) AS price_low, CAST(max(price) AS DOUBLE) AS price_high,
       {mean} AS price_mean, {dev} AS price_deviation
FROM lin JOIN ord ON no = ono GROUP BY ALL""", mean=_quot("sum(price)", "count(*)"), dev=_r("stddev_samp(CAST(price AS DOUBLE))"))


def _top_bottom(lines: str) -> str:
    return _q("""
, s AS (
  SELECT wname, code, name, line, stock, min(price) AS lo, max(price) AS hi,
         coalesce(sum(qty), 0) AS units, coalesce(sum(rev), 0) AS rev
  FROM spot LEFT JOIN {lines} ON pcode = code GROUP BY wname, code, name, line, stock),
r AS (
  SELECT *, row_number() OVER (ORDER BY units, code) AS up,
         row_number() OVER (ORDER BY units DESC, code) AS down FROM s)
SELECT tag AS sales_rank, wname AS warehouse_name, code AS product_code, name AS product_name,
       line AS product_line, coalesce(CAST(lo AS VARCHAR), 'NaN') AS lowest_price_sold,
       coalesce(CAST(hi AS VARCHAR), 'NaN') AS highest_price_sold,
       CAST(units AS BIGINT) AS total_units_sold, stock AS in_stock_units,
       CAST(rev AS DOUBLE) AS total_revenue
FROM r, (VALUES ('LEAST SOLD'), ('MOST SOLD')) AS t(tag)
WHERE (tag = 'LEAST SOLD' AND up <= 5) OR (tag = 'MOST SOLD' AND down <= 5)""", lines=lines)


ORACLE["top_bottom_products"] = _top_bottom("lin")
ORACLE["top_bottom_products_corrected"] = _top_bottom(_KEPT_LINES)

_ITEM = """wname AS warehouse_name, code AS product_code, name AS product_name, line AS product_line,
       CAST(units AS BIGINT) AS total_units_sold, stock AS current_stock, health AS stock_health"""


def _items(lines: str, keep: str) -> str:
    """Products joined to their lines and orders; ``keep`` is the row test after the join."""
    return f"""
, s AS (
  SELECT wcode, wname, code, name, line, stock, cost, coalesce(sum(qty), 0) AS units
  FROM place LEFT JOIN {lines} AS x ON pcode = code LEFT JOIN ord ON no = ono
  WHERE {keep} GROUP BY wcode, wname, code, name, line, stock, cost),
h AS (
  SELECT *, CASE WHEN units = 0 THEN 'Absolute Dead (0 Sales)' WHEN stock > units * 3 THEN 'Severely Overstock'
                 WHEN stock < units THEN 'Restock needed' ELSE 'Balanced' END AS health FROM s)"""


_SOLD = "status NOT IN ('Cancelled', 'On Hold', 'In progress')"
_SOLD_OR_NONE = f"({_SOLD} OR status IS NULL)"

for _name, _lines, _keep in (("stock_health", "lin", _SOLD), ("stock_health_corrected", "lin", _SOLD_OR_NONE)):
    ORACLE[_name] = _q("{items} SELECT {cols}, CAST(stock * cost AS DOUBLE) AS capital_tied_up FROM h",
                       items=_items(_lines, _keep), cols=_ITEM)

for _name, _lines in (("warehouse_health_pct", "lin"),):
    ORACLE[_name] = _q(f"""
, s AS (
  SELECT wcode, wname, code, stock, coalesce(sum(qty), 0) AS units
  FROM place LEFT JOIN {_lines} AS x ON pcode = code GROUP BY wcode, wname, code, stock),
h AS (
  SELECT *, CASE WHEN units = 0 THEN 'dead' WHEN stock > units * 3 THEN 'over'
                 WHEN stock < units * 0.7 THEN 'under' ELSE 'normal' END AS health FROM s)
SELECT wname AS warehouse_name, count(*) AS total_products, """ + ", ".join(
        f"{_pct(f'''count(*) FILTER (WHERE health = '{c}')''', 'count(*)')} AS {out}" for c, out in (
            ("under", "severe_understock_pct"), ("normal", "normal_balance_pct"),
            ("over", "severe_overstock_pct"), ("dead", "dead_sales_pct"))) + """
FROM h GROUP BY wcode, wname""")


def _movement(stock: str) -> str:
    return _q("""
, s AS (
  SELECT wcode, wname, sum(qty) AS units, {stock} AS stock, sum(rev) AS rev
  FROM place JOIN lin ON pcode = code JOIN ord ON no = ono
  WHERE status NOT IN ('On Hold', 'Cancelled', 'In Process') GROUP BY wcode, wname),
m AS (SELECT *, {pct} AS pct FROM s)
SELECT wcode AS warehouse_code, wname AS warehouse_name, CAST(units AS BIGINT) AS units_sold,
       CAST(stock AS BIGINT) AS current_stock, pct AS movement_pct, CAST(rev AS DOUBLE) AS total_revenue,
       dense_rank() OVER (ORDER BY pct DESC) AS movement_rank,
       dense_rank() OVER (ORDER BY rev DESC) AS revenue_rank
FROM m""", stock=stock, pct=_pct("units", "stock"))


ORACLE["warehouse_movement_rank"] = _movement("sum(stock)")
ORACLE["warehouse_movement_rank_corrected"] = _movement(
    "(SELECT sum(prod.stock) FROM prod WHERE prod.wcode = place.wcode)")

_CUT = "CASE WHEN units = 0 THEN stock ELSE floor(stock * 0.20) END"
for _suffix, _lines in (("", "lin"),):
    _base = _items(_lines, f"(wname LIKE '%East%' OR wname LIKE '%West%') AND {_SOLD_OR_NONE}")
    _pick = "FROM h WHERE health IN ('Severely Overstock', 'Absolute Dead (0 Sales)')"
    ORACLE[f"stock_reduction_plan{_suffix}"] = _q(
        f"{_base} SELECT {_ITEM}, CAST({_CUT} AS BIGINT) AS target_reduction_units, "
        f"CAST(stock - {_CUT} AS BIGINT) AS remaining_stock {_pick}")
    ORACLE[f"overstock_candidates{_suffix}"] = _q(
        f"{_base} SELECT {_ITEM}, CAST({_CUT} AS BIGINT) AS target_reduction_units {_pick}")
ORACLE["restock_plan"] = _q(
    f"""{_items("lin", _SOLD_OR_NONE)}
SELECT {_ITEM}, CAST(units * 2 AS BIGINT) AS healthy_target_stock,
       CAST(units * 2 - stock AS BIGINT) AS required_restock_units,
       CAST(CAST(units * 2 - stock AS BIGINT) * cost AS DOUBLE) AS procurement_cost
FROM h WHERE health = 'Restock needed'""")

# --- warehouses -----------------------------------------------------------------------

ORACLE["warehouse_capacity_rank"] = _q("""
, s AS (
  SELECT wcode, wname, pct, CAST(sum(stock) AS DOUBLE) AS stock FROM place GROUP BY wcode, wname, pct)
SELECT wcode AS warehouse_code, wname AS warehouse_name, pct AS occupied_pct,
       CAST(stock AS BIGINT) AS current_item_count, {cap} AS theoretical_capacity,
       {free} AS remaining_empty_slots,
       dense_rank() OVER (ORDER BY stock / (pct / 100) DESC) AS capacity_rank
FROM s""", cap=_quot("stock * 100", "pct", 0), free=_quot("stock * 100 - stock * pct", "pct", 0))
ORACLE["warehouse_diversity"] = _q("""
SELECT wh.code AS warehouse_code, wh.name AS warehouse_name, count(DISTINCT prod.code) AS unique_items_sold,
       string_agg(DISTINCT line, ', ' ORDER BY line) AS product_lines_sold,
       {share} AS pct_of_catalog
FROM prod LEFT JOIN wh ON wcode = wh.code GROUP BY wh.code, wh.name""",
    share=_pct("count(*)", "(SELECT count(*) FROM prod)", 1))

_BASELINE = """
SELECT wh.code AS warehouse_code, wh.name AS warehouse_name, coalesce(lines, 'None') AS product_lines,
       {stock} AS current_stock, {cap} AS tied_capital, {rev} AS historical_revenue,
       {pct} AS occupied_capacity_pct
FROM wh
LEFT JOIN (SELECT wcode, sum(stock) AS stock, sum(stock * cost) AS cap,
                  string_agg(DISTINCT line, ', ' ORDER BY line) AS lines FROM prod GROUP BY wcode) AS i
  ON i.wcode = wh.code
LEFT JOIN (SELECT wcode, sum(rev) AS rev FROM lin JOIN prod ON code = pcode JOIN ord ON no = ono
           WHERE status NOT IN ('On Hold', 'Cancelled', 'In Process') GROUP BY wcode) AS r
  ON r.wcode = wh.code"""
ORACLE["warehouse_baseline"] = _q(
    _BASELINE, stock="CAST(coalesce(stock, 0) AS BIGINT)", cap="CAST(coalesce(cap, 0) AS DOUBLE)",
    rev="CAST(coalesce(rev, 0) AS DOUBLE)", pct="pct")
ORACLE["warehouse_baseline_shown"] = _q(
    _BASELINE, stock="format('{:,}', CAST(coalesce(stock, 0) AS BIGINT))",
    cap="format('{:,.2f}', CAST(coalesce(cap, 0) AS DOUBLE))",
    rev="format('{:,.2f}', CAST(coalesce(rev, 0) AS DOUBLE))",
    pct="format('{:.1f}%', pct)")


def _closure(moves: dict[str, str], closed: str = "", kept: dict[str, str] | None = None) -> str:
    """One subselect per figure, as sums over the products a warehouse ends up with; what ends up
    in no open warehouse is unassigned."""
    to = " ".join(f"WHEN line = '{line}' THEN '{w}'" for line, w in moves.items())
    keep = " ".join(f"WHEN '{w}' THEN {x}" for w, x in (kept or {"-": "1.0"}).items())
    receivers = ", ".join(f"'{w}'" for w in sorted(set(moves.values())))
    scaled = _quot("g.stock * pct", "(SELECT sum(prod.stock) FROM prod WHERE wcode = wh.code)", 4)
    return _q(f"""
, sold AS (
  SELECT pcode, sum(rev) AS rev FROM lin JOIN ord ON no = ono WHERE status = 'Shipped' GROUP BY pcode),
n AS (
  SELECT CASE {to} ELSE wcode END AS target, line, stock * CASE wcode {keep} ELSE 1.0 END AS stock,
         stock * cost * CASE wcode {keep} ELSE 1.0 END AS cap, rev
  FROM prod LEFT JOIN sold ON pcode = code),
g AS (
  SELECT target, sum(stock) AS stock, sum(cap) AS cap, sum(rev) AS rev,
         string_agg(DISTINCT line, ', ' ORDER BY line) AS lines FROM n GROUP BY target)
SELECT code AS warehouse_code,
       name || CASE WHEN code IN ({receivers}) THEN ' (Consolidated)' ELSE '' END AS simulated_warehouse,
       lines AS product_lines, CAST(coalesce(stock, 0) AS DOUBLE) AS simulated_stock,
       CAST(coalesce(cap, 0) AS DOUBLE) AS simulated_capital, CAST(coalesce(rev, 0) AS DOUBLE) AS simulated_revenue,
       CASE WHEN code IN ({receivers}) THEN {scaled} ELSE pct END AS simulated_capacity_pct
FROM wh LEFT JOIN g ON target = code WHERE code <> '{closed}'
UNION ALL
SELECT target, 'Unassigned', lines, CAST(stock AS DOUBLE), CAST(cap AS DOUBLE), CAST(coalesce(rev, 0) AS DOUBLE), NULL
FROM g WHERE (target IS NULL OR target = '{closed}' OR target NOT IN (SELECT code FROM wh)) AND (stock > 0 OR rev > 0)""")


ORACLE["whatif_close_south"] = _closure({"SMALL": "a", "LARGE": "c"}, "d")
ORACLE["whatif_close_west"] = _closure({"MEDIUM": "b"}, "c")
ORACLE["whatif_close_west_reduced"] = _closure({"MEDIUM": "b"}, "c", {"b": "0.81", "c": "0.81"})
ORACLE["whatif_close_west_reduced_shown"] = f"""
SELECT warehouse_code, simulated_warehouse, product_lines,
       format('{{:,.0f}}', simulated_stock) AS simulated_stock,
       format('{{:,.2f}}', simulated_capital) AS simulated_capital,
       format('{{:,.2f}}', simulated_revenue) AS simulated_revenue,
       format('{{:.1f}}%', simulated_capacity_pct) AS simulated_capacity_pct
FROM ({ORACLE["whatif_close_west_reduced"]}) AS r"""
ORACLE["reallocate"] = _closure({"ECONOMY": "c", "MEDIUM": "b"}, kept={"d": "0.9"})
ORACLE["reallocate_scenarios"] = " UNION ALL ".join(
    f"SELECT '{scenario}' AS scenario, * FROM ({ORACLE[name]}) AS s"
    for scenario, name in (("south", "whatif_close_south"), ("west", "whatif_close_west"), ("west reduced", "whatif_close_west_reduced"), ("swap", "reallocate")))
