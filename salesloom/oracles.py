"""Plain SQL for every report, written for DuckDB over the star-schema tables.

Independent of the Spark code: built-in windows, no pre-aggregation, no buckets.
Figures are rounded on decimals, as in the reports, so that both engines agree.
"""

from __future__ import annotations


def _r(expr: str, places: int) -> str:
    return f"CAST(ROUND(CAST({expr} AS DECIMAL(28,8)), {places}) AS DOUBLE)"


def _d(expr: str) -> str:
    return f"CAST({expr} AS DOUBLE)"


def _ratio(num: str, den: str) -> str:
    return f"({_d(num)} / NULLIF({_d(den)}, 0))"


def _pct(num: str, den: str, places: int) -> str:
    return _r(f"{_ratio(num, den)} * 100", places)


_LINES = """
li AS (
  SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS ship,
         CAST(l_quantity AS BIGINT) AS qty,
         CAST(l_discount AS DECIMAL(5,4)) AS disc,
         CAST(l_extendedprice AS DECIMAL(18,2)) AS gross,
         CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(5,4))) AS net,
         CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_tax AS DECIMAL(5,4)) AS freight
  FROM lineitem
)"""

_ORDERS = """
o AS (
  SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS odate, o_orderpriority AS shipper,
         CASE WHEN o_orderstatus <> 'O' THEN s.last_ship END AS shipped,
         CAST(o_orderdate AS DATE) + 60 AS required, s.freight
  FROM orders LEFT JOIN (
    SELECT l_orderkey, MAX(ship) AS last_ship, SUM(freight) AS freight FROM li GROUP BY 1
  ) s ON o_orderkey = l_orderkey
)"""

_PARTS = """
p AS (
  SELECT p_partkey, p_name || ' #' || CAST(p_partkey AS VARCHAR) AS name, p_type AS category,
         CAST(p_retailprice AS DECIMAL(18,2)) AS price,
         CAST(p_size - 1 AS BIGINT) AS stock,
         CAST(CASE WHEN p_partkey % 3 = 0 THEN 0 ELSE (p_partkey % 10) * 10 END AS BIGINT) AS on_order,
         CAST((p_partkey % 7) * 5 AS BIGINT) AS reorder,
         CAST(CASE WHEN p_type = 'PROMO' THEN 1 ELSE 0 END AS BIGINT) AS discontinued
  FROM part
)"""

_PART_SUPPLIER = """
ps AS (
  SELECT l_partkey, l_suppkey FROM (
    SELECT l_partkey, l_suppkey,
           ROW_NUMBER() OVER (PARTITION BY l_partkey ORDER BY CAST(l_shipdate AS DATE), l_suppkey) AS n
    FROM lineitem
  ) WHERE n = 1
)"""

_COVERAGE = """
cov AS (
  SELECT DISTINCT l_suppkey, n_nationkey, r_regionkey, r_name
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
),
hired AS (SELECT l_suppkey, MIN(CAST(l_shipdate AS DATE)) AS hire FROM lineitem GROUP BY 1)"""

_TENURES = """
ten AS (
  SELECT agent.*, hire, CAST((SELECT MAX(CAST(o_orderdate AS DATE)) FROM orders) - hire AS BIGINT) AS tenure
  FROM agent LEFT JOIN (SELECT l_suppkey, MIN(ship) AS hire FROM li GROUP BY 1) AS h ON s_suppkey = l_suppkey)"""

_STATUS = """CASE WHEN stock = 0 THEN 'OUT OF STOCK'
       WHEN stock < reorder AND on_order = 0 THEN 'CRITICAL — No Reorder Placed'
       WHEN stock < reorder THEN 'BELOW REORDER — Order Pending'
       WHEN stock < reorder * 1.5 THEN 'LOW — Monitor Closely'
       ELSE 'OK' END"""

_SIZE = """CASE WHEN qty <= 20 THEN 'Small  (≤20 units)'
       WHEN qty <= 50 THEN 'Medium (21-50 units)' ELSE 'Large  (>50 units)' END"""

_AGENTS = f"""
agent AS (
  SELECT s_suppkey, s_name, n_name AS title,
         CAST(COUNT(DISTINCT l_orderkey) AS BIGINT) AS orders,
         CAST(SUM(qty) AS BIGINT) AS units,
         ROUND(SUM(net), 2) AS revenue,
         ROUND(CAST({_ratio("SUM(disc)", "COUNT(*)")} * 100 AS DECIMAL(28,8)), 2) AS disc_pct,
         ROUND(CAST({_ratio("SUM(net)", "COUNT(DISTINCT l_orderkey)")} AS DECIMAL(28,8)), 2) AS per_order
  FROM li JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  GROUP BY ALL
)"""

_CUSTOMERS = """
cust AS (
  SELECT c_custkey, c_name, n_name AS country,
         CAST(COUNT(DISTINCT o_orderkey) AS BIGINT) AS orders,
         ROUND(SUM(net), 2) AS revenue, SUM(net) AS net,
         MIN(CAST(o_orderdate AS DATE)) AS first_order, MAX(CAST(o_orderdate AS DATE)) AS last_order
  FROM customer JOIN nation ON c_nationkey = n_nationkey
  JOIN orders ON c_custkey = o_custkey JOIN li ON o_orderkey = l_orderkey
  GROUP BY c_custkey, c_name, n_name
)"""

_PRODUCTS = """
prod AS (
  SELECT p_partkey, name, category, price, discontinued,
         ROUND(SUM(net), 2) AS revenue, CAST(SUM(qty) AS BIGINT) AS units
  FROM p JOIN li ON p_partkey = l_partkey
  GROUP BY p_partkey, name, category, price, discontinued
)"""

_TOTAL = "t AS (SELECT SUM(net) AS total FROM li)"

_RUNNING = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in ctes) + "\n"


def _money_text(expr: str) -> str:
    return f"'$' || format('{{:,}}', CAST(ROUND({expr}, 0) AS BIGINT))"


def _count_text(expr: str) -> str:
    return f"format('{{:,}}', CAST({expr} AS BIGINT))"


def _pct_text(num: str, den: str) -> str:
    pct = f"ROUND(CAST({_ratio(num, den)} * 100 AS DECIMAL(28,8)), 1)"
    return f"CAST(CAST({pct} AS DECIMAL(18,1)) AS VARCHAR) || '%'"


def _kpi() -> str:
    def share(num: str, den: str) -> str:
        return f"{_count_text(num)} || ' (' || {_pct_text(num, den)} || ')'"

    def row(name: str, text: str, number: str, source: str) -> str:
        return f"SELECT '{name}' AS KPI, {text} AS Value, CAST({number} AS DOUBLE) AS Number FROM {source}"

    lost = "SUM(gross) - SUM(net)"
    late = "COUNT(*) FILTER (WHERE shipped > required)"
    shipped = "COUNT(shipped)"
    disc = "COUNT(*) FILTER (WHERE disc > 0)"
    rows = [
        row("Net Revenue (after discounts)", _money_text("SUM(net)"), "ROUND(SUM(net), 0)", "li"),
        row("Gross Revenue (before discounts)", _money_text("SUM(gross)"), "ROUND(SUM(gross), 0)", "li"),
        row("Revenue Lost to Discounts", _money_text(lost), f"ROUND({lost}, 0)", "li"),
        row("Discount Cost %", _pct_text(lost, "SUM(gross)"), _pct(lost, "SUM(gross)", 1), "li"),
    ]
    counts = [
        ("Total Orders", "COUNT(DISTINCT o_orderkey)", "o"),
        ("Total Order Lines", "COUNT(*)", "li"),
        ("Active Customers", "COUNT(DISTINCT o_custkey)", "o"),
        ("Active Products", "COUNT(*) FILTER (WHERE discontinued = 0)", "p"),
        ("Discontinued Products", "COUNT(*) FILTER (WHERE discontinued = 1)", "p"),
        ("Suppliers", "COUNT(*)", "supplier"),
        ("Unshipped Orders", "COUNT(*) FILTER (WHERE shipped IS NULL)", "o"),
        (
            "Products Below Reorder Level (active)",
            "COUNT(*) FILTER (WHERE discontinued = 0 AND stock <= reorder)",
            "p",
        ),
        (
            "Products Out of Stock (active)",
            "COUNT(*) FILTER (WHERE discontinued = 0 AND stock = 0)",
            "p",
        ),
    ]
    rows += [row(name, _count_text(expr), expr, source) for name, expr, source in counts]
    rows += [
        row("Order Lines with Discounts", share(disc, "COUNT(*)"), disc, "li"),
        row("Late Orders (of shipped)", share(late, shipped), late, "o"),
    ]
    return _with(_LINES, _ORDERS, _PARTS) + "\nUNION ALL\n".join(rows)


def _pivot() -> str:
    cells = ",\n".join(
        f"{_r(f'SUM(CASE WHEN n_name = {chr(39)}NATION_{i}{chr(39)} THEN net END)', 2)} AS NATION_{i}"
        for i in range(25)
    )
    return (
        _with(_LINES)
        + f"""SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS Month, {cells}
FROM li JOIN orders ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
GROUP BY 1"""
    )


def _pivot_blocks(width: int = 10) -> str:
    cells = ",\n".join(f"MAX(CASE WHEN place = {i} THEN revenue END) AS C{i}" for i in range(width))
    return (
        _with(
            _LINES,
            f"""label AS (
  SELECT s_suppkey, ROW_NUMBER() OVER (ORDER BY s_name) - 1 AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey),
sale AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, n // {width} AS block, n % {width} AS place,
         {_r("SUM(net)", 2)} AS revenue
  FROM li JOIN orders ON l_orderkey = o_orderkey JOIN label ON l_suppkey = s_suppkey GROUP BY ALL)""",
        )
        + f"SELECT month AS Month, block AS Block, {cells} FROM sale GROUP BY month, block"
    )


def _top_share(entity: str, source: str, key: str) -> str:
    return f"""
SELECT '{entity}' AS Entity, n AS TopN, {_d("SUM(revenue)")} AS Revenue,
       {_pct("SUM(revenue)", "ANY_VALUE(total)", 1)} AS SharePct
FROM (SELECT revenue, ROW_NUMBER() OVER (ORDER BY revenue DESC, {key}) AS rn FROM {source}) x
JOIN (SELECT CAST(UNNEST([3, 5, 10]) AS BIGINT) AS n) k ON rn <= n CROSS JOIN t
GROUP BY n"""


def _audit() -> str:
    """Each check by itself: a grouped count for a key, an anti join for a reference."""
    keys = {
        "region": ["r_regionkey"], "nation": ["n_nationkey"], "customer": ["c_custkey"], "supplier": ["s_suppkey"],
        "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": ["l_orderkey", "l_linenumber"],
    }
    references = [
        ("nation", "n_regionkey", "region"), ("customer", "c_nationkey", "nation"), ("supplier", "s_nationkey", "nation"),
        ("orders", "o_custkey", "customer"), ("lineitem", "l_orderkey", "orders"), ("lineitem", "l_partkey", "part"),
        ("lineitem", "l_suppkey", "supplier"),
    ]
    parts = []
    for table, columns in keys.items():
        cols, null = ", ".join(columns), " OR ".join(f"{c} IS NULL" for c in columns)
        twice = f"(SELECT COUNT(*) AS n FROM {table} WHERE NOT ({null}) GROUP BY {cols} HAVING COUNT(*) > 1)"
        parts.append(
            f"SELECT 'key' AS Kind, '{table}({cols})' AS Relation, (SELECT COUNT(*) FROM {table}) AS CheckedRows,"
            f" (SELECT COUNT(*) FROM {table} WHERE {null}) AS NullRows,"
            f" (SELECT CAST(COALESCE(SUM(n), 0) AS BIGINT) FROM {twice}) AS FaultyRows, (SELECT COUNT(*) FROM {twice}) AS FaultyKeys"
        )
    for table, column, to in references:
        lost = f"{table} WHERE {column} IS NOT NULL AND {column} NOT IN (SELECT {keys[to][0]} FROM {to} WHERE {keys[to][0]} IS NOT NULL)"
        parts.append(
            f"SELECT 'reference', '{table}({column}) -> {to}', (SELECT COUNT(*) FROM {table}),"
            f" (SELECT COUNT(*) FROM {table} WHERE {column} IS NULL),"
            f" (SELECT COUNT(*) FROM {lost}), (SELECT COUNT(DISTINCT {column}) FROM {lost})"
        )
    return "\nUNION ALL ".join(parts)


ORACLES: dict[str, str] = {
    "kpi_snapshot": _kpi(),
    "q1_category_yoy": _with(
        _LINES,
        """
cy AS (
  SELECT p_type AS category, CAST(YEAR(o_orderdate) AS BIGINT) AS y, ROUND(SUM(net), 2) AS revenue
  FROM li JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2
),
g AS (SELECT *, LAG(revenue) OVER (PARTITION BY category ORDER BY y) AS prev FROM cy)""",
    )
    + f"""SELECT category AS CategoryName, y AS OrderYear, {_d("revenue")} AS Revenue,
  {_d("prev")} AS PrevYearRevenue, {_pct("(revenue - prev)", "prev", 1)} AS YoY_Growth_Pct,
  CAST(RANK() OVER (PARTITION BY y ORDER BY revenue DESC) AS BIGINT) AS RankWithinYear
FROM g""",
    "q2_product_pareto": _with(_LINES, _PARTS, _PRODUCTS, _TOTAL)
    + f"""SELECT category AS CategoryName, name AS ProductName, {_d("price")} AS UnitPrice,
  {_d("revenue")} AS Revenue, units AS TotalUnitsSold,
  {_pct("revenue", "total", 2)} AS PctOfTotalRevenue,
  CAST(RANK() OVER (ORDER BY revenue DESC) AS BIGINT) AS GlobalRank,
  CAST(RANK() OVER (PARTITION BY category ORDER BY revenue DESC) AS BIGINT) AS RankInCategory,
  discontinued AS Discontinued,
  {_pct(f"SUM(revenue) OVER (ORDER BY revenue DESC, p_partkey {_RUNNING})", "total", 1)}
    AS CumulativeRevenuePct
FROM prod CROSS JOIN t""",
    "q3_discount_depth": _with(
        _LINES,
        """
b AS (
  SELECT *, CASE WHEN disc = 0 THEN '0% (No Discount)' WHEN disc <= 0.05 THEN '1-5%'
    WHEN disc <= 0.10 THEN '6-10%' WHEN disc <= 0.15 THEN '11-15%'
    WHEN disc <= 0.20 THEN '16-20%' ELSE '21-25%' END AS bucket
  FROM li
)""",
    )
    + f"""SELECT bucket AS DiscountBucket, COUNT(*) AS OrderLines,
  {_r("SUM(net)", 2)} AS NetRevenue, {_r("SUM(gross)", 2)} AS GrossRevenue,
  {_r("SUM(gross) - SUM(net)", 2)} AS RevenueForgone,
  {_r(_ratio("SUM(qty)", "COUNT(*)"), 1)} AS AvgQuantity,
  {_pct("SUM(disc)", "COUNT(*)", 1)} AS AvgDiscountPct,
  {_pct("COUNT(*)", "SUM(COUNT(*)) OVER ()", 1)} AS PctOfAllLines
FROM b GROUP BY bucket""",
    "q4_quarterly_trend": _with(
        _LINES,
        """
q AS (
  SELECT CAST(YEAR(o_orderdate) AS BIGINT) AS y, CAST(QUARTER(o_orderdate) AS BIGINT) AS q,
         CAST(COUNT(DISTINCT o_orderkey) AS BIGINT) AS orders, SUM(net) AS revenue, COUNT(*) AS n
  FROM li JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2
),
g AS (SELECT *, LAG(revenue) OVER (ORDER BY y, q) AS prev FROM q)""",
    )
    + f"""SELECT y AS OrderYear, q AS Quarter, 'Q' || q || ' ' || y AS YearQuarter,
  orders AS OrderCount, {_r("revenue", 2)} AS Revenue,
  {_r(_ratio("revenue", "n"), 2)} AS AvgLineRevenue,
  {_pct("(revenue - prev)", "prev", 1)} AS QoQ_Growth_Pct
FROM g""",
    "q5_agent_scorecard": _with(
        _LINES,
        _AGENTS,
        f"""
s AS (
  SELECT *, MAX(revenue) OVER () AS top,
    quantile_cont({_d("revenue")}, 0.75) OVER () AS hi,
    quantile_cont({_d("revenue")}, 0.25) OVER () AS lo,
    {_ratio("SUM(revenue) OVER ()", "COUNT(*) OVER ()")} AS mean
  FROM agent
)""",
    )
    + f"""SELECT s_name AS EmployeeName, title AS Title, orders AS TotalOrders, units AS TotalUnitsSold,
  {_d("revenue")} AS TotalRevenue, {_d("disc_pct")} AS AvgDiscountPct,
  {_d("per_order")} AS RevenuePerOrder,
  CAST(RANK() OVER (ORDER BY revenue DESC) AS BIGINT) AS RevenueRank,
  CAST(RANK() OVER (ORDER BY disc_pct DESC) AS BIGINT) AS DiscountRank,
  CAST(RANK() OVER (ORDER BY per_order DESC) AS BIGINT) AS EfficiencyRank,
  CASE WHEN revenue = top THEN 'Top Performer' WHEN {_d("revenue")} >= hi THEN 'High Performer'
       WHEN {_d("revenue")} <= lo THEN 'Needs Coaching' ELSE 'Average' END AS PerformanceTier,
  CASE WHEN disc_pct > 5.0 AND {_d("revenue")} < mean THEN 'REVIEW: High Discount + Low Revenue'
       WHEN disc_pct > 5.0 THEN 'Monitor: High Discount Usage' ELSE 'OK' END AS DiscountFlag
FROM s""",
    "q6_territory_coverage": _with(
        _COVERAGE,
        """
er AS (
  SELECT cov.l_suppkey, s_name, n.n_name AS title, r_regionkey, r_name, hire, COUNT(*) AS terr
  FROM cov JOIN hired ON cov.l_suppkey = hired.l_suppkey
  JOIN supplier ON s_suppkey = cov.l_suppkey JOIN nation n ON s_nationkey = n.n_nationkey
  GROUP BY ALL
)""",
    )
    + """SELECT l_suppkey AS EmployeeID, s_name AS EmployeeName, title AS Title, terr AS TerritoryCount,
  r_name AS PrimaryRegion, CAST(RANK() OVER (ORDER BY terr DESC) AS BIGINT) AS TerritoryRank,
  FIRST_VALUE(hire) OVER (PARTITION BY r_regionkey ORDER BY hire) AS EarliestHireInRegion
FROM er""",
    "q7_region_founder": _with(_COVERAGE)
    + """SELECT DISTINCT r_name AS RegionDescription,
  FIRST_VALUE(s_name) OVER w AS FoundingEmployee, FIRST_VALUE(n.n_name) OVER w AS Title,
  FIRST_VALUE(hire) OVER w AS HireDate
FROM cov JOIN hired ON cov.l_suppkey = hired.l_suppkey
JOIN supplier ON s_suppkey = cov.l_suppkey JOIN nation n ON s_nationkey = n.n_nationkey
WINDOW w AS (PARTITION BY r_regionkey ORDER BY hire, s_suppkey)""",
    "q8_customer_pareto": _with(_LINES, _CUSTOMERS, _TOTAL)
    + f"""SELECT c_custkey AS CustomerID, c_name AS CompanyName, country AS Country,
  orders AS TotalOrders, {_d("revenue")} AS Revenue, first_order AS FirstOrder,
  last_order AS LastOrder, CAST(last_order - first_order AS BIGINT) AS CustomerLifespanDays,
  {_r(_ratio("revenue", "orders"), 2)} AS RevenuePerOrder,
  {_pct("revenue", "total", 2)} AS PctOfTotalRevenue,
  CAST(RANK() OVER (ORDER BY revenue DESC) AS BIGINT) AS RevenueRank,
  {_pct(f"SUM(revenue) OVER (ORDER BY revenue DESC, c_custkey {_RUNNING})", "total", 1)}
    AS CumulativePct,
  CAST(NTILE(5) OVER (ORDER BY revenue DESC, c_custkey) AS BIGINT) AS RevenueQuintile
FROM cust CROSS JOIN t""",
    "q9_rfm_segments": _with(
        _LINES,
        _CUSTOMERS,
        """
rec AS (
  SELECT *, CAST((SELECT MAX(CAST(o_orderdate AS DATE)) FROM orders) - last_order AS BIGINT) AS recency
  FROM cust
),
sc AS (
  SELECT *, CAST(NTILE(5) OVER (ORDER BY recency, c_custkey) AS BIGINT) AS r,
    CAST(NTILE(5) OVER (ORDER BY orders DESC, c_custkey) AS BIGINT) AS f,
    CAST(NTILE(5) OVER (ORDER BY revenue DESC, c_custkey) AS BIGINT) AS m
  FROM rec
)""",
    )
    + f"""SELECT c_custkey AS CustomerID, c_name AS CompanyName, country AS Country,
  recency AS DaysSinceLastOrder, orders AS Frequency, {_d("revenue")} AS Monetary,
  r AS R_Score, f AS F_Score, m AS M_Score, r + f + m AS RFM_Total,
  CASE WHEN r + f + m <= 5 THEN 'Champion' WHEN r + f + m <= 8 THEN 'Loyal'
       WHEN r <= 2 AND f >= 4 THEN 'At Risk' WHEN r + f + m <= 11 THEN 'Potential'
       ELSE 'Needs Attention' END AS CustomerSegment
FROM sc""",
    "q10_country_quality": _with(
        _LINES,
        _CUSTOMERS,
        """
ct AS (
  SELECT country, COUNT(*) AS customers, CAST(SUM(orders) AS BIGINT) AS orders,
         ROUND(SUM(net), 2) AS revenue
  FROM cust GROUP BY country
)""",
    )
    + f"""SELECT country AS Country, customers AS Customers, orders AS Orders, {_d("revenue")} AS Revenue,
  {_r(_ratio("revenue", "customers"), 2)} AS RevenuePerCustomer,
  {_r(_ratio("revenue", "orders"), 2)} AS RevenuePerOrder,
  CAST(RANK() OVER (ORDER BY revenue DESC) AS BIGINT) AS RevenueRank,
  CAST(RANK() OVER (ORDER BY {_ratio("revenue", "customers")} DESC) AS BIGINT) AS QualityRank,
  {_pct("revenue", "SUM(revenue) OVER ()", 1)} AS PctOfTotal,
  {_pct(f"SUM(revenue) OVER (ORDER BY revenue DESC, country {_RUNNING})", "SUM(revenue) OVER ()", 1)}
    AS CumulativePct
FROM ct""",
    "q11_stock_risk": _with(_PARTS, _PART_SUPPLIER)
    + f"""SELECT s_name AS Supplier, n_name AS SupplierCountry, name AS ProductName,
  category AS CategoryName, {_d("price")} AS UnitPrice, stock AS UnitsInStock,
  on_order AS UnitsOnOrder, reorder AS ReorderLevel, stock - reorder AS StockSurplusOrDeficit,
  {_STATUS} AS StockStatus, CUME_DIST() OVER (ORDER BY stock) AS StockCumDist,
  PERCENT_RANK() OVER (ORDER BY stock) AS StockPercentile
FROM p JOIN ps ON p_partkey = l_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey
WHERE discontinued = 0""",
    "q12_supplier_portfolio": _with(
        _PARTS,
        _PART_SUPPLIER,
        f"""
sp AS (
  SELECT s_suppkey, s_name, n_name, COUNT(*) AS total,
    COUNT(*) FILTER (WHERE discontinued = 0) AS active,
    COUNT(*) FILTER (WHERE discontinued = 1) AS gone,
    {_r(_ratio("SUM(price)", "COUNT(price)"), 2)} AS avg_price,
    CAST(SUM(stock) AS BIGINT) AS stock, CAST(SUM(on_order) AS BIGINT) AS on_order
  FROM p JOIN ps ON p_partkey = l_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
  GROUP BY s_suppkey, s_name, n_name
)""",
    )
    + f"""SELECT s_name AS CompanyName, n_name AS Country, s_name AS ContactName,
  total AS TotalProducts, active AS ActiveProducts, gone AS DiscontinuedProducts,
  avg_price AS AvgUnitPrice, stock AS TotalUnitsInStock, on_order AS TotalUnitsOnOrder,
  CAST(RANK() OVER (ORDER BY stock DESC) AS BIGINT) AS StockRank,
  CAST(RANK() OVER (ORDER BY total DESC) AS BIGINT) AS PortfolioSizeRank,
  {_pct("gone", "total", 0)} AS DiscontinuedRatePct,
  CAST(SUM(stock) OVER (PARTITION BY n_name) AS BIGINT) AS TotalStockByCountry
FROM sp""",
    "q13_carrier_sla": _with(
        _LINES,
        _ORDERS,
        f"""
c AS (
  SELECT shipper, COUNT(*) AS n, COUNT(shipped) AS shipped_n,
    COUNT(*) FILTER (WHERE shipped IS NULL) AS unshipped,
    COUNT(*) FILTER (WHERE shipped <= required) AS on_time,
    COUNT(*) FILTER (WHERE shipped > required) AS late,
    {_ratio("SUM(shipped - odate)", "COUNT(shipped)")} AS speed,
    CAST(MIN(shipped - odate) AS BIGINT) AS lo, CAST(MAX(shipped - odate) AS BIGINT) AS hi,
    {_ratio("SUM(freight)", "COUNT(freight)")} AS freight
  FROM o GROUP BY shipper
)""",
    )
    + f"""SELECT shipper AS Shipper, n AS TotalOrders, shipped_n AS ShippedOrders,
  unshipped AS UnshippedOrders, on_time AS OnTimeOrders, late AS LateOrders,
  {_pct("on_time", "shipped_n", 1)} AS OnTimePct, {_r("speed", 2)} AS AvgDaysToShip,
  lo AS MinDaysToShip, hi AS MaxDaysToShip, {_r("freight", 2)} AS AvgFreightCharge,
  CAST(RANK() OVER (ORDER BY speed NULLS FIRST) AS BIGINT) AS SpeedRank
FROM c""",
    "q14_order_size_delivery": _with(
        _LINES,
        _ORDERS,
        """
tot AS (
  SELECT l_orderkey, CAST(SUM(qty) AS BIGINT) AS qty, ROUND(SUM(net), 2) AS revenue,
         COUNT(DISTINCT l_partkey) AS products
  FROM li GROUP BY l_orderkey
)""",
    )
    + f"""SELECT o_orderkey AS OrderID, c_name AS CompanyName, n_name AS Country, shipper AS Shipper,
  qty AS TotalQuantity, {_d("revenue")} AS OrderRevenue, products AS UniqueProducts,
  {_d("freight")} AS Freight, {_pct("freight", "revenue", 1)} AS FreightPct,
  {_SIZE} AS OrderSizeCategory,
  CAST(NTILE(4) OVER (ORDER BY revenue, o_orderkey) AS BIGINT) AS RevenueQuartile,
  CAST(shipped - odate AS BIGINT) AS DaysToShip,
  CASE WHEN shipped IS NULL THEN 'Not Yet Shipped' WHEN shipped <= required THEN 'On Time'
       ELSE 'Late' END AS DeliveryStatus
FROM o JOIN tot ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey""",
    "x1_month_agent_pivot": _pivot(),
    "x2_median_order_value": _with(
        _LINES, "v AS (SELECT ROUND(SUM(net), 2) AS value FROM li GROUP BY l_orderkey)"
    )
    + f"""SELECT COUNT(*) AS Orders, {_r(_ratio("SUM(value)", "COUNT(*)"), 2)} AS MeanOrderValue,
  {_d("MAX(value)")} AS MaxOrderValue,
  {_r(f"quantile_cont({_d('value')}, 0.25)", 2)} AS LowerQuartile,
  {_r(f"quantile_cont({_d('value')}, 0.5)", 2)} AS MedianOrderValue,
  {_r(f"quantile_cont({_d('value')}, 0.75)", 2)} AS UpperQuartile
FROM v""",
    "x3_dense_rank_lead": _with(
        _LINES,
        """
cq AS (
  SELECT p_type AS category, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS q,
         ROUND(SUM(net), 2) AS revenue
  FROM li JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2
)""",
    )
    + f"""SELECT category AS CategoryName, q AS QuarterStart, {_d("revenue")} AS Revenue,
  {_d("LEAD(revenue) OVER (PARTITION BY category ORDER BY q)")} AS NextQuarterRevenue,
  CAST(DENSE_RANK() OVER (PARTITION BY q ORDER BY revenue DESC) AS BIGINT) AS DenseRankInQuarter
FROM cq""",
    "x3_product_dense_rank": _with(_LINES, _PARTS, _PRODUCTS)
    + """SELECT category AS CategoryName, name AS ProductName, units AS TotalUnitsSold,
  CAST(DENSE_RANK() OVER (PARTITION BY category ORDER BY units DESC) AS BIGINT)
    AS DenseRankInCategory,
  CAST(DENSE_RANK() OVER (ORDER BY units DESC) AS BIGINT) AS DenseRank
FROM prod""",
    "x4_top_n_share": _with(_LINES, _PARTS, _PRODUCTS, _CUSTOMERS, _TOTAL)
    + _top_share("Product", "prod", "p_partkey")
    + "\nUNION ALL\n"
    + _top_share("Customer", "cust", "c_custkey"),
    "x5_reorder_gap": f"""
WITH g AS (
  SELECT CAST(o_orderdate AS DATE) - LAG(CAST(o_orderdate AS DATE))
    OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS gap
  FROM orders
)
SELECT COUNT(gap) AS Gaps, {_r(_ratio("SUM(gap)", "COUNT(gap)"), 2)} AS MeanGapDays,
  CAST(MAX(gap) AS BIGINT) AS MaxGapDays,
  quantile_cont({_d("gap")}, 0.25) AS LowerQuartileDays,
  quantile_cont({_d("gap")}, 0.5) AS MedianGapDays,
  quantile_cont({_d("gap")}, 0.75) AS UpperQuartileDays
FROM g""",
    "x6_one_time_customers": f"""
WITH n AS (
  SELECT c_custkey, (SELECT COUNT(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer
)
SELECT COUNT(*) AS Customers, COUNT(*) FILTER (WHERE n > 0) AS OrderingCustomers,
  COUNT(*) FILTER (WHERE n = 0) AS NeverOrdered, COUNT(*) FILTER (WHERE n = 1) AS OneTimeCustomers,
  {_pct("COUNT(*) FILTER (WHERE n = 1)", "COUNT(*) FILTER (WHERE n > 0)", 1)} AS OneTimePct
FROM n""",
    "x7_monthly_run_rate": _with(
        _LINES,
        f"""
y AS (
  SELECT CAST(YEAR(o_orderdate) AS BIGINT) AS y,
         COUNT(DISTINCT date_trunc('month', o_orderdate)) AS months, SUM(net) AS revenue
  FROM li JOIN orders ON l_orderkey = o_orderkey GROUP BY 1
),
a AS (SELECT *, ROUND(CAST({_ratio("revenue", "months")} AS DECIMAL(28,8)), 2) AS mean FROM y),
g AS (SELECT *, LAG(mean) OVER (ORDER BY y) AS prev FROM a)""",
    )
    + f"""SELECT y AS OrderYear, months AS Months, {_r("revenue", 2)} AS Revenue,
  {_d("mean")} AS AvgMonthlyRevenue, {_d("prev")} AS PrevAvgMonthlyRevenue,
  {_pct("(mean - prev)", "prev", 1)} AS ChangePct
FROM g""",
    "x8_recent_demand": _with(
        _LINES,
        _PARTS,
        """
d AS (
  SELECT l_partkey, CAST(SUM(qty) AS BIGINT) AS units
  FROM li JOIN orders ON l_orderkey = o_orderkey
  WHERE CAST(o_orderdate AS DATE)
    > (SELECT MAX(CAST(o_orderdate AS DATE)) - INTERVAL 3 MONTH FROM orders)
  GROUP BY l_partkey
)""",
    )
    + f"""SELECT name AS ProductName, {_STATUS} AS StockStatus, stock AS UnitsInStock,
  on_order AS UnitsOnOrder, reorder AS ReorderLevel, COALESCE(units, 0) AS RecentUnits
FROM p LEFT JOIN d ON p_partkey = l_partkey
WHERE discontinued = 0 AND {_STATUS} <> 'OK'""",
    "x9_late_rate_by_size": _with(
        _LINES,
        _ORDERS,
        f"""
s AS (
  SELECT {_SIZE} AS size, shipped, required, o.freight AS freight, revenue
  FROM o JOIN (SELECT l_orderkey, SUM(qty) AS qty, ROUND(SUM(net), 2) AS revenue FROM li GROUP BY 1) x
    ON o_orderkey = l_orderkey
)""",
    )
    + f"""SELECT size AS OrderSizeCategory, COUNT(*) AS Orders, COUNT(shipped) AS ShippedOrders,
  COUNT(*) FILTER (WHERE shipped > required) AS LateOrders,
  COUNT(*) FILTER (WHERE freight > revenue * 0.2) AS HighFreightOrders,
  {_pct("COUNT(*) FILTER (WHERE shipped > required)", "COUNT(shipped)", 1)} AS LatePct
FROM s GROUP BY size""",
    "x1_monthly_sales": _with(_LINES)
    + f"""SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS Month, CAST(s_suppkey AS BIGINT) AS EmployeeID,
  s_name AS EmployeeName, {_r("SUM(net)", 2)} AS Revenue
FROM li JOIN orders ON l_orderkey = o_orderkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
GROUP BY 1, 2, 3""",
    "x11_discounted_lines": _with(_LINES)
    + f"""SELECT CASE WHEN disc > 0 THEN 'Discounted' ELSE 'Undiscounted' END AS LineKind, COUNT(*) AS Lines,
  {_pct("COUNT(*)", "SUM(COUNT(*)) OVER ()", 1)} AS SharePct,
  {_r(_ratio("SUM(qty)", "COUNT(qty)"), 2)} AS AvgQuantity, {_r("MAX(disc) * 100", 2)} AS MaxDiscountPct
FROM li GROUP BY 1""",
    "x12_discount_revenue": _with(
        _LINES,
        _AGENTS,
        """ranked AS (
  SELECT *, RANK() OVER (ORDER BY disc_pct) + (COUNT(*) OVER (PARTITION BY disc_pct) - 1) / 2.0 AS disc_rank,
         RANK() OVER (ORDER BY revenue) + (COUNT(*) OVER (PARTITION BY revenue) - 1) / 2.0 AS rev_rank
  FROM agent)""",
    )
    + f"""SELECT COUNT(*) AS Employees, ROUND(CORR({_d("disc_pct")}, {_d("revenue")}), 3) AS Correlation,
  ROUND(CORR({_d("disc_rank")}, {_d("rev_rank")}), 3) AS RankCorrelation
FROM ranked""",
    "x10_revenue_per_territory": _with(
        _LINES,
        _AGENTS,
        _COVERAGE,
        "terr AS (SELECT l_suppkey, COUNT(*) AS n FROM cov GROUP BY 1)",
    )
    + f"""SELECT s_name AS EmployeeName, {_d("revenue")} AS TotalRevenue, n AS Territories,
  {_r(_ratio("revenue", "n"), 2)} AS RevenuePerTerritory
FROM agent JOIN terr ON s_suppkey = l_suppkey""",
    "x13_group_quantiles": _with(
        _LINES,
        """v AS (
  SELECT n_name AS country, YEAR(CAST(o_orderdate AS DATE)) AS yr, CAST(ROUND(SUM(net), 2) AS DOUBLE) AS amount
  FROM orders JOIN li ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY o_orderkey, n_name, yr)""",
    )
    + f"""SELECT country AS Country, yr AS OrderYear, COUNT(*) AS Orders,
  {_r("QUANTILE_CONT(amount, 0.25)", 2)} AS LowerQuartile,
  {_r("QUANTILE_CONT(amount, 0.5)", 2)} AS MedianOrderValue,
  {_r("QUANTILE_CONT(amount, 0.75)", 2)} AS UpperQuartile
FROM v GROUP BY country, yr""",
    "x14_pareto_cut": _with(
        _LINES,
        _PARTS,
        _PRODUCTS,
        _CUSTOMERS,
        _TOTAL,
        f"""earner AS (
  SELECT 'Product' AS entity, p_partkey AS k, revenue FROM prod WHERE revenue > 0
  UNION ALL SELECT 'Customer', c_custkey, revenue FROM cust WHERE revenue > 0),
run AS (
  SELECT *, ROW_NUMBER() OVER best AS n, SUM(revenue) OVER (best {_RUNNING}) AS running,
         COUNT(*) OVER (PARTITION BY entity) AS members
  FROM earner WINDOW best AS (PARTITION BY entity ORDER BY revenue DESC, k)),
goal AS (SELECT entity, pct, total * pct / 100 AS amount, total FROM t, (SELECT DISTINCT entity FROM earner), (VALUES (50), (80), (95)) g(pct))""",
    )
    + f"""SELECT r.entity AS Entity, CAST(pct AS DOUBLE) AS TargetPct, n AS Members, members AS AllMembers,
  {_pct("n", "members", 1)} AS MembersPct, {_r("running", 2)} AS Revenue, {_pct("running", "total", 1)} AS SharePct,
  {_d("revenue")} AS SmallestRevenue, CAST(k AS VARCHAR) AS LastKey
FROM goal JOIN run r ON r.entity = goal.entity AND running >= amount AND running - revenue < amount""",
    "x15_customer_quarters": _with(
        _LINES,
        """s AS (
  SELECT o_custkey, DATE_TRUNC('quarter', CAST(o_orderdate AS DATE))::DATE AS q, COUNT(DISTINCT o_orderkey) AS orders,
         ROUND(SUM(net), 2) AS revenue
  FROM orders JOIN li ON o_orderkey = l_orderkey WHERE o_custkey IS NOT NULL AND o_orderdate IS NOT NULL GROUP BY ALL),
spine AS (
  SELECT o_custkey, UNNEST(GENERATE_SERIES(MIN(q), MAX(q), INTERVAL 3 MONTH))::DATE AS q FROM s GROUP BY o_custkey),
f AS (
  SELECT o_custkey, q, COALESCE(orders, 0) AS orders, COALESCE(revenue, 0) AS revenue FROM spine LEFT JOIN s USING (o_custkey, q)),
g AS (
  SELECT *, LAG(revenue) OVER line AS prev, SUM(revenue) OVER line AS so_far
  FROM f WINDOW line AS (PARTITION BY o_custkey ORDER BY q))""",
    )
    + f"""SELECT CAST(o_custkey AS VARCHAR) AS CustomerID, q AS QuarterStart, orders AS Orders, {_d("revenue")} AS Revenue,
  {_d("prev")} AS PrevQuarterRevenue, {_pct("revenue - prev", "prev", 1)} AS QoQ_Growth_Pct, {_d("so_far")} AS RevenueSoFar
FROM g""",
    "x15_filled_category_years": _with(
        _LINES,
        """s AS (
  SELECT p_type AS category, YEAR(CAST(o_orderdate AS DATE)) AS yr, ROUND(SUM(net), 2) AS revenue
  FROM li JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey GROUP BY ALL),
spine AS (SELECT category, UNNEST(GENERATE_SERIES(MIN(yr), MAX(yr))) AS yr FROM s GROUP BY category),
f AS (SELECT category, yr, COALESCE(revenue, 0) AS revenue FROM spine LEFT JOIN s USING (category, yr)),
g AS (SELECT *, LAG(revenue) OVER (PARTITION BY category ORDER BY yr) AS prev FROM f)""",
    )
    + f"""SELECT category AS CategoryName, CAST(yr AS BIGINT) AS OrderYear, {_d("revenue")} AS Revenue, {_d("prev")} AS PrevYearRevenue,
  {_pct("revenue - prev", "prev", 1)} AS YoY_Growth_Pct, RANK() OVER (PARTITION BY yr ORDER BY revenue DESC) AS RankWithinYear
FROM g""",
    "x16_period_sketches": _with(
        _LINES,
        """v AS (
  SELECT n_name AS country, YEAR(CAST(o_orderdate AS DATE)) AS yr, o_custkey, CAST(ROUND(SUM(net), 2) AS DOUBLE) AS amount
  FROM orders JOIN li ON o_orderkey = l_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE o_orderdate IS NOT NULL GROUP BY o_orderkey, n_name, yr, o_custkey)""",
    )
    + f"""SELECT country AS Country, yr AS OrderYear, COUNT(*) AS Orders, COUNT(DISTINCT o_custkey) AS Customers,
  {_r("QUANTILE_CONT(amount, 0.5)", 2)} AS MedianOrderValue, TRUE AS CustomersAgree, TRUE AS MedianAgrees
FROM v GROUP BY country, yr""",
    "x18_reference_audit": _audit(),
    "x19_import_outcomes": """
WITH e AS (
  SELECT o_orderkey, CASE o_orderkey % 50 WHEN 1 THEN 'OrderDate is no date' WHEN 2 THEN 'OrderID is no bigint'
    ELSE 'accepted' END AS outcome FROM orders)
SELECT outcome AS Outcome, COUNT(*) AS Records, CAST(SUM(CASE o_orderkey % 50 WHEN 3 THEN 2 ELSE 1 END) AS BIGINT) AS Lines,
  MAX(CASE outcome WHEN 'accepted' THEN o_orderkey END) AS GreatestID
FROM e GROUP BY outcome""",
    "x20_pivot_blocks": _pivot_blocks(),
    "x21_tenure_revenue": _with(_LINES, _AGENTS, _TENURES)
    + f"""SELECT s_suppkey AS EmployeeID, s_name AS EmployeeName, hire AS HireDate, tenure AS TenureDays, {_d("revenue")} AS TotalRevenue,
  RANK() OVER (ORDER BY tenure DESC) AS TenureRank, RANK() OVER (ORDER BY revenue DESC) AS RevenueRank
FROM ten""",
    "x22_tenure_correlation": _with(
        _LINES,
        _AGENTS,
        _TENURES,
        """ranked AS (
  SELECT *, RANK() OVER (ORDER BY tenure) + (COUNT(*) OVER (PARTITION BY tenure) - 1) / 2.0 AS tenure_rank,
         RANK() OVER (ORDER BY revenue) + (COUNT(*) OVER (PARTITION BY revenue) - 1) / 2.0 AS rev_rank
  FROM ten)""",
    )
    + f"""SELECT COUNT(*) AS Employees, ROUND(CORR({_d("tenure")}, {_d("revenue")}), 3) AS Correlation,
  ROUND(CORR({_d("tenure_rank")}, {_d("rev_rank")}), 3) AS RankCorrelation
FROM ranked""",
    "x23_country_against_mean": _with(
        _LINES,
        _CUSTOMERS,
        """
ct AS (
  SELECT country, COUNT(*) AS customers, CAST(SUM(orders) AS BIGINT) AS orders,
         ROUND(SUM(net), 2) AS revenue
  FROM cust GROUP BY country
)""",
    )
    + f"""SELECT country AS Country, customers AS Customers, orders AS Orders, {_d("revenue")} AS Revenue,
  {_r(_ratio("revenue", "customers"), 2)} AS RevenuePerCustomer,
  {_r(_ratio("revenue", "orders"), 2)} AS RevenuePerOrder,
  CAST(RANK() OVER (ORDER BY revenue DESC) AS BIGINT) AS RevenueRank,
  CAST(RANK() OVER (ORDER BY {_ratio("revenue", "customers")} DESC) AS BIGINT) AS QualityRank,
  {_pct("revenue", "SUM(revenue) OVER ()", 1)} AS PctOfTotal,
  {_pct(f"SUM(revenue) OVER (ORDER BY revenue DESC, country {_RUNNING})", "SUM(revenue) OVER ()", 1)}
    AS CumulativePct,
  {_r(_ratio("SUM(revenue) OVER ()", "SUM(customers) OVER ()"), 2)} AS OverallRevenuePerCustomer,
  {_pct(_ratio("revenue", "customers"), _ratio("SUM(revenue) OVER ()", "SUM(customers) OVER ()"), 1)} AS PctOfOverall
FROM ct""",
}
ORACLES["x17_refreshed_trend"] = ORACLES["q4_quarterly_trend"]
ORACLES["x24_stored_trend"] = ORACLES["q4_quarterly_trend"]
