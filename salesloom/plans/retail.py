"""The retail model the reports are written on.

``Retail`` is the set of frames a report may ask for; a subclass says where they
come from. Nothing is read until a report's result is. Columns:

lines       OrderID, ProductID, Quantity, DiscountBp, NetU, GrossU
orders      OrderID, CustomerID, OrderDate and the source's own columns
customers   CustomerID, CompanyName, Country
products    ProductID, ProductName, CategoryName, UnitPrice, UnitsInStock, UnitsOnOrder,
            ReorderLevel, Discontinued
suppliers   SupplierID, CompanyName, Country, ContactName
employees   EmployeeID, EmployeeName, Title
coverage    EmployeeID, TerritoryID, RegionID, Region

``*U`` are amounts in millionths (see ``functions.money``), ``DiscountBp`` is the
discount in basis points.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable, Mapping, Sequence
from datetime import date, datetime, time, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from salesloom.functions.firsts import earliest
from salesloom.functions.money import fine_gross, fine_net, gross, money, net, whole
from salesloom.operators.materialize import materialize
from salesloom.sources.loaders import load_csv_tables, load_parquet


class Retail(ABC):
    """Frames of one data set and the aggregates several reports share."""

    #: the stored tables of orders and of lines, each with its order key
    FACTS: tuple[tuple[str, str], tuple[str, str]]
    tables: Mapping[str, DataFrame]
    #: the same data in parts that share no order; totals by order are then those of each part
    parts: Sequence[Retail] = ()

    def replaced(self, tables: Mapping[str, DataFrame]) -> Retail:
        """The same source with some of its tables taken from elsewhere."""
        return type(self)({**self.tables, **tables})

    @abstractmethod
    def lines(self) -> DataFrame: ...

    @abstractmethod
    def orders(self, stored: DataFrame | None = None) -> DataFrame:
        """All orders, or those among the rows ``stored`` of the stored table."""

    @abstractmethod
    def customers(self) -> DataFrame: ...

    @abstractmethod
    def products(self) -> DataFrame: ...

    @abstractmethod
    def listed_products(self) -> DataFrame:
        """Every product with its stock columns, of a known category or not."""

    @abstractmethod
    def supplier_keys(self) -> DataFrame:
        """SupplierID of every supplier, of a known country or not."""

    @abstractmethod
    def product_suppliers(self) -> DataFrame:
        """ProductID, SupplierID: one row per product."""

    @abstractmethod
    def suppliers(self) -> DataFrame: ...

    @abstractmethod
    def employees(self) -> DataFrame: ...

    @abstractmethod
    def titles(self) -> DataFrame:
        """Title: the titles an employee can have, one row each."""

    @abstractmethod
    def hire_dates(self) -> DataFrame:
        """EmployeeID, HireDate."""

    @abstractmethod
    def coverage(self) -> DataFrame: ...

    @abstractmethod
    def region_count(self) -> int: ...

    @abstractmethod
    def employee_totals(self) -> DataFrame:
        """EmployeeID, TotalOrders, TotalUnitsSold, NetU, DiscountBp (summed), Rated (lines with a discount given)."""

    def orders_after(self, day: date) -> DataFrame:
        """Orders dated later than ``day``, or none if it is null; the bound is a literal on the stored column."""
        stored, column = self._dated_orders()
        # the first instant of the next day: dates later than a day, whatever their time
        bound = F.lit(None if day is None else datetime.combine(day + timedelta(days=1), time())).cast("timestamp_ntz")
        return self.orders(stored.filter(F.col(column) >= bound))

    @abstractmethod
    def _dated_orders(self) -> tuple[DataFrame, str]:
        """The stored orders and their date column."""

    @abstractmethod
    def employee_sales(self) -> DataFrame:
        """EmployeeID, OrderDate, NetU: any number of rows per employee and day."""

    @abstractmethod
    def name_shipper(self, frame: DataFrame) -> DataFrame:
        """Add Shipper (the name) to a frame that has ShipperID."""

    @abstractmethod
    def _delivery(self, book: DataFrame) -> DataFrame:
        """Add ShipperID, ShippedDate, RequiredDate, Freight to orders joined with their totals."""

    def _line_measures(self) -> dict[str, tuple[Column, Callable[[str], Column]]]:
        """Extra per-order aggregates a source needs for its delivery columns, and what combines them."""
        return {}

    def order_totals(self, products: bool = False) -> DataFrame:
        """One row per order that has lines.

        Sums are combined before the shuffle, so an order with any number of lines
        costs a handful of rows. With ``products`` one scan is summed by (order, product)
        first and by order then: the pairs of a huge order stay spread out, and the second
        step counts them.
        """
        if self.parts:
            return reduce(DataFrame.unionByName, (part.order_totals(products) for part in self.parts))
        measures = {
            "Units": (F.sum("Quantity"), F.sum),
            "NetU": (F.sum("NetU"), F.sum),
            "GrossU": (F.sum("GrossU"), F.sum),
            "Lines": (F.count("*"), F.sum),
            "PricedLines": (F.count("NetU"), F.sum),
            "DiscountedLines": (F.count_if(F.col("DiscountBp") > 0), F.sum),
            **self._line_measures(),
        }
        keys = ["OrderID", "ProductID"] if products else ["OrderID"]
        totals = self.lines().groupBy(*keys).agg(*(first.alias(n) for n, (first, _) in measures.items()))
        if not products:
            return totals
        types = dict(totals.dtypes)
        return totals.groupBy("OrderID").agg(
            *(again(n).cast(types[n]).alias(n) for n, (_, again) in measures.items()),
            F.count("ProductID").alias("Products"),
        )

    def order_book(self, how: str, products: bool = False) -> DataFrame:
        """Orders joined with their line totals, both unique on OrderID.

        ``inner``: orders with lines; ``left``: every order; ``right``: every line,
        with an order or not; ``outer``: both. ``Booked`` is null on lines without an order.
        """
        totals = self.order_totals(products)
        book = self.orders().withColumn("Booked", F.lit(True)).join(totals, "OrderID", how)
        return self._delivery(book)

    def customer_base(self) -> DataFrame:
        """Written table, one row per customer with lines (or null), plus ``Known``.

        The row of lines without a known customer is kept: the sum of NetU over the
        table is the revenue of all lines, with no second pass over them.
        """
        by_customer = (
            self.order_book("right")
            .groupBy("CustomerID")
            .agg(
                F.count("*").alias("Orders"),
                F.sum("NetU").alias("NetU"),
                F.min("OrderDate").alias("FirstOrder"),
                F.max("OrderDate").alias("LastOrder"),
            )
        )
        customers = self.customers().withColumn("Known", F.lit(True))
        joined = by_customer.join(customers, "CustomerID", "left")
        return materialize(
            joined.withColumn("Known", F.coalesce("Known", F.lit(False))).withColumn(
                "Revenue", F.round(money(F.col("NetU")), 2).cast("decimal(28,2)")
            )
        )

    def product_base(self) -> DataFrame:
        """Written table, one row per product sold; unknown products are kept as above."""
        sold = self.lines().groupBy("ProductID").agg(
            F.sum("NetU").alias("NetU"), F.sum("Quantity").alias("Units")
        )
        products = self.products().withColumn("Known", F.lit(True))
        joined = sold.join(products, "ProductID", "left")
        return materialize(
            joined.withColumn("Known", F.coalesce("Known", F.lit(False))).withColumn(
                "Revenue", F.round(money(F.col("NetU")), 2).cast("decimal(28,2)")
            )
        )


class CsvRetail(Retail):
    """The eleven retail tables in their own schema (``sources.schemas``)."""

    FACTS = (("orders", "OrderID"), ("order_details", "OrderID"))

    def __init__(self, tables: Mapping[str, DataFrame]):
        self.tables = tables

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> CsvRetail:
        return cls(load_csv_tables(spark, folder))

    def lines(self) -> DataFrame:
        price = F.col("UnitPrice") * F.col("Quantity").cast("decimal(12,0)")
        bp = whole(F.col("Discount"), 10_000)
        return self.tables["order_details"].select(
            "OrderID",
            "ProductID",
            F.col("Quantity").cast("bigint").alias("Quantity"),
            bp.alias("DiscountBp"),
            fine_net(price, F.col("Discount")).alias("NetU"),
            fine_gross(price).alias("GrossU"),
        )

    def _dated_orders(self) -> tuple[DataFrame, str]:
        return self.tables["orders"], "OrderDate"

    def orders(self, stored: DataFrame | None = None) -> DataFrame:
        return (self.tables["orders"] if stored is None else stored).select(
            "OrderID",
            "CustomerID",
            "EmployeeID",
            F.to_date("OrderDate").alias("OrderDate"),
            F.to_date("RequiredDate").alias("RequiredDate"),
            F.to_date("ShippedDate").alias("ShippedDate"),
            F.col("ShipVia").alias("ShipperID"),
            "Freight",
        )

    def _delivery(self, book: DataFrame) -> DataFrame:
        return book

    def customers(self) -> DataFrame:
        return self.tables["customers"].select("CustomerID", "CompanyName", "Country")

    def listed_products(self) -> DataFrame:
        return self.tables["products"].select(
            "ProductID",
            "ProductName",
            "CategoryID",
            "UnitPrice",
            *(
                F.col(c).cast("bigint").alias(c)
                for c in ("UnitsInStock", "UnitsOnOrder", "ReorderLevel", "Discontinued")
            ),
        )

    def products(self) -> DataFrame:
        categories = self.tables["categories"].select("CategoryID", "CategoryName")
        return self.listed_products().join(categories, "CategoryID").drop("CategoryID")

    def product_suppliers(self) -> DataFrame:
        return self.tables["products"].select("ProductID", "SupplierID")

    def supplier_keys(self) -> DataFrame:
        return self.tables["suppliers"].select("SupplierID")

    def suppliers(self) -> DataFrame:
        return self.tables["suppliers"].select("SupplierID", "CompanyName", "Country", "ContactName")

    def employees(self) -> DataFrame:
        return self.tables["employees"].select(
            "EmployeeID", F.concat("FirstName", F.lit(" "), "LastName").alias("EmployeeName"), "Title"
        )

    def titles(self) -> DataFrame:
        return self.tables["employees"].select("Title").distinct()

    def hire_dates(self) -> DataFrame:
        return self.tables["employees"].select("EmployeeID", F.to_date("HireDate").alias("HireDate"))

    def coverage(self) -> DataFrame:
        return (
            self.tables["employee_territories"]
            .join(self.tables["territories"], "TerritoryID")
            .join(self.tables["region"], "RegionID")
            .select(
                "EmployeeID", "TerritoryID", "RegionID", F.col("RegionDescription").alias("Region")
            )
        )

    def region_count(self) -> int:
        return self.tables["region"].count()

    def employee_totals(self) -> DataFrame:
        totals = self.lines().groupBy("OrderID").agg(
            F.sum("Quantity").alias("Units"),
            F.sum("NetU").alias("NetU"),
            F.sum("DiscountBp").alias("DiscountBp"),
            F.count("DiscountBp").alias("Rated"),
        )
        return (
            self.orders()
            .select("OrderID", "EmployeeID")
            .join(totals, "OrderID")
            .groupBy("EmployeeID")
            .agg(
                F.count("*").alias("TotalOrders"),
                F.sum("Units").alias("TotalUnitsSold"),
                F.sum("NetU").alias("NetU"),
                F.sum("DiscountBp").alias("DiscountBp"),
                F.sum("Rated").alias("Rated"),
            )
        )

    def employee_sales(self) -> DataFrame:
        return self.order_book("inner").select("EmployeeID", "OrderDate", "NetU")

    def name_shipper(self, frame: DataFrame) -> DataFrame:
        shippers = self.tables["shippers"]
        return frame.join(
            shippers.select("ShipperID", F.col("CompanyName").alias("Shipper")), "ShipperID"
        )


class StarRetail(Retail):
    """The model over the seven-table order/line star schema.

    That schema has no employees, shippers, stock or required dates; they are
    derived from the columns it has, by rules plain SQL can repeat:

    * an employee is the supplier of the line; title is the supplier's nation, hire date the
      first ship date; territories are the nations of the customers sold to;
    * a shipper is the order priority; an order is shipped on its last ship date unless its
      status is open, and required 60 days after its date; freight is the tax on the lines;
    * stock columns are arithmetic on the part's size and key; PROMO parts are discontinued;
      a part's supplier is the one that shipped it first (the lowest key on a tie).
    """

    FACTS = (("orders", "o_orderkey"), ("lineitem", "l_orderkey"))
    TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]

    def __init__(self, tables: Mapping[str, DataFrame]):
        self.tables = tables

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> StarRetail:
        return cls(load_parquet(spark, folder, cls.TABLES))

    def lines(self) -> DataFrame:
        cents = whole(F.col("l_extendedprice"), 100)
        bp = whole(F.col("l_discount"), 10_000)
        return self.tables["lineitem"].select(
            F.col("l_orderkey").alias("OrderID"),
            F.col("l_partkey").alias("ProductID"),
            F.col("l_suppkey").alias("EmployeeID"),
            F.col("l_quantity").cast("bigint").alias("Quantity"),
            bp.alias("DiscountBp"),
            net(cents, bp).alias("NetU"),
            gross(cents).alias("GrossU"),
            (cents * whole(F.col("l_tax"), 10_000)).cast("decimal(18,0)").alias("FreightU"),
            F.to_date("l_shipdate").alias("ShipDate"),
        )

    def _line_measures(self) -> dict[str, tuple[Column, Callable[[str], Column]]]:
        return {"FreightU": (F.sum("FreightU"), F.sum), "LastShip": (F.max("ShipDate"), F.max)}

    def _dated_orders(self) -> tuple[DataFrame, str]:
        return self.tables["orders"], "o_orderdate"

    def orders(self, stored: DataFrame | None = None) -> DataFrame:
        return (self.tables["orders"] if stored is None else stored).select(
            F.col("o_orderkey").alias("OrderID"),
            F.col("o_custkey").alias("CustomerID"),
            F.to_date("o_orderdate").alias("OrderDate"),
            F.col("o_orderpriority").alias("ShipperID"),
            (F.col("o_orderstatus") == "O").alias("Open"),
        )

    def _delivery(self, book: DataFrame) -> DataFrame:
        return book.withColumns(
            {
                "ShippedDate": F.when(~F.col("Open"), F.col("LastShip")),
                "RequiredDate": F.date_add("OrderDate", 60),
                "Freight": money(F.col("FreightU")),
            }
        ).drop("Open", "LastShip", "FreightU")

    def _nations(self) -> DataFrame:
        return self.tables["nation"].select(
            F.col("n_nationkey").alias("NationID"),
            F.col("n_name").alias("Country"),
            F.col("n_regionkey").alias("RegionID"),
        )

    def customers(self) -> DataFrame:
        return (
            self.tables["customer"]
            .select(
                F.col("c_custkey").alias("CustomerID"),
                F.col("c_name").alias("CompanyName"),
                F.col("c_nationkey").alias("NationID"),
            )
            .join(self._nations(), "NationID")
            .select("CustomerID", "CompanyName", "Country")
        )

    def products(self) -> DataFrame:
        key = F.col("p_partkey")
        return self.tables["part"].select(
            key.alias("ProductID"),
            F.concat("p_name", F.lit(" #"), key.cast("string")).alias("ProductName"),
            F.col("p_type").alias("CategoryName"),
            F.col("p_retailprice").cast("decimal(18,2)").alias("UnitPrice"),
            (F.col("p_size") - 1).cast("bigint").alias("UnitsInStock"),
            F.when(key % 3 == 0, F.lit(0)).otherwise((key % 10) * 10).cast("bigint").alias("UnitsOnOrder"),
            ((key % 7) * 5).cast("bigint").alias("ReorderLevel"),
            (F.col("p_type") == "PROMO").cast("bigint").alias("Discontinued"),
        )

    def product_suppliers(self) -> DataFrame:
        shipped = self.tables["lineitem"].select(
            F.col("l_partkey").alias("ProductID"),
            F.to_date("l_shipdate").alias("ShipDate"),
            F.col("l_suppkey").alias("SupplierID"),
        )
        return earliest(shipped, ["ProductID"], "ShipDate", "SupplierID").select("ProductID", "SupplierID")

    def listed_products(self) -> DataFrame:
        return self.products()

    def supplier_keys(self) -> DataFrame:
        return self.tables["supplier"].select(F.col("s_suppkey").alias("SupplierID"))

    def suppliers(self) -> DataFrame:
        return (
            self.tables["supplier"]
            .select(
                F.col("s_suppkey").alias("SupplierID"),
                F.col("s_name").alias("CompanyName"),
                F.col("s_nationkey").alias("NationID"),
            )
            .join(self._nations(), "NationID")
            .select(
                "SupplierID",
                "CompanyName",
                "Country",
                F.col("CompanyName").alias("ContactName"),
            )
        )

    def employees(self) -> DataFrame:
        return self.suppliers().select(
            F.col("SupplierID").alias("EmployeeID"),
            F.col("CompanyName").alias("EmployeeName"),
            F.col("Country").alias("Title"),
        )

    def titles(self) -> DataFrame:
        return self.tables["nation"].select(F.col("n_name").alias("Title"))

    def hire_dates(self) -> DataFrame:
        return self.lines().groupBy("EmployeeID").agg(F.min("ShipDate").alias("HireDate"))

    def coverage(self) -> DataFrame:
        """Pairs are made distinct before every join, so a hot order or customer shrinks early."""
        sold = (
            self.tables["lineitem"]
            .select(F.col("l_suppkey").alias("EmployeeID"), F.col("l_orderkey").alias("OrderID"))
            .distinct()
        )
        buyers = (
            sold.join(self.orders().select("OrderID", "CustomerID"), "OrderID")
            .select("EmployeeID", "CustomerID")
            .distinct()
        )
        nations = self.tables["customer"].select(
            F.col("c_custkey").alias("CustomerID"), F.col("c_nationkey").alias("NationID")
        )
        regions = self.tables["region"].select(
            F.col("r_regionkey").alias("RegionID"), F.col("r_name").alias("Region")
        )
        return (
            buyers.join(nations, "CustomerID")
            .select("EmployeeID", "NationID")
            .distinct()
            .join(self._nations(), "NationID")
            .join(regions, "RegionID")
            .select("EmployeeID", F.col("NationID").alias("TerritoryID"), "RegionID", "Region")
        )

    def region_count(self) -> int:
        return self.tables["region"].count()

    def employee_totals(self) -> DataFrame:
        """One scan, summed by (employee, order) first and by employee then, which counts the orders; lines without
        an employee are no one's."""
        pairs = (
            self.lines()
            .groupBy("EmployeeID", "OrderID")
            .agg(
                F.sum("Quantity").alias("Units"),
                F.sum("NetU").alias("NetU"),
                F.sum("DiscountBp").alias("DiscountBp"),
                F.count("DiscountBp").alias("Rated"),
            )
        )
        return (
            pairs.where("EmployeeID IS NOT NULL")
            .groupBy("EmployeeID")
            .agg(
                F.sum("Units").alias("TotalUnitsSold"),
                F.sum("NetU").cast("decimal(38,0)").alias("NetU"),
                F.sum("DiscountBp").alias("DiscountBp"),
                F.sum("Rated").alias("Rated"),
                F.count("*").alias("TotalOrders"),
            )
        )

    def employee_sales(self) -> DataFrame:
        dates = self.orders().select("OrderID", "OrderDate")
        return (
            self.lines()
            .select("EmployeeID", "OrderID", "NetU")
            .join(dates, "OrderID")
            .drop("OrderID")
        )

    def name_shipper(self, frame: DataFrame) -> DataFrame:
        return frame.withColumn("Shipper", F.col("ShipperID"))
