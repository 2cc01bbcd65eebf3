"""Are the keys of a load unique, and does every reference lead to a row? All relations at once.

Every key and every reference becomes a row (domain, key, check). One shuffle brings the rows of a key together, summed in tasks before, so
a key that a third of all rows refer to is one row for each task; what comes out of it is summed per check.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from salesloom.plans.retail import Retail, StarRetail


@dataclass(frozen=True)
class Keys:
    """``columns`` identify a row of ``table``."""

    table: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class Reference:
    """``columns`` of ``table`` name a row of ``to``, by its key."""

    table: str
    columns: tuple[str, ...]
    to: str


STAR_CHECKS: tuple[Keys | Reference, ...] = (
    Keys("region", ("r_regionkey",)),
    Keys("nation", ("n_nationkey",)),
    Keys("customer", ("c_custkey",)),
    Keys("supplier", ("s_suppkey",)),
    Keys("part", ("p_partkey",)),
    Keys("orders", ("o_orderkey",)),
    Keys("lineitem", ("l_orderkey", "l_linenumber")),
    Reference("nation", ("n_regionkey",), "region"),
    Reference("customer", ("c_nationkey",), "nation"),
    Reference("supplier", ("s_nationkey",), "nation"),
    Reference("orders", ("o_custkey",), "customer"),
    Reference("lineitem", ("l_orderkey",), "orders"),
    Reference("lineitem", ("l_partkey",), "part"),
    Reference("lineitem", ("l_suppkey",), "supplier"),
)

CSV_CHECKS: tuple[Keys | Reference, ...] = (
    Keys("categories", ("CategoryID",)),
    Keys("customers", ("CustomerID",)),
    Keys("employees", ("EmployeeID",)),
    Keys("employee_territories", ("EmployeeID", "TerritoryID")),
    Keys("order_details", ("OrderID", "ProductID")),
    Keys("orders", ("OrderID",)),
    Keys("products", ("ProductID",)),
    Keys("region", ("RegionID",)),
    Keys("shippers", ("ShipperID",)),
    Keys("suppliers", ("SupplierID",)),
    Keys("territories", ("TerritoryID",)),
    Reference("employee_territories", ("EmployeeID",), "employees"),
    Reference("employee_territories", ("TerritoryID",), "territories"),
    Reference("order_details", ("OrderID",), "orders"),
    Reference("order_details", ("ProductID",), "products"),
    Reference("orders", ("CustomerID",), "customers"),
    Reference("orders", ("EmployeeID",), "employees"),
    Reference("orders", ("ShipVia",), "shippers"),
    Reference("products", ("CategoryID",), "categories"),
    Reference("products", ("SupplierID",), "suppliers"),
    Reference("territories", ("RegionID",), "region"),
)


def _name(check: Keys | Reference) -> str:
    own = f"{check.table}({', '.join(check.columns)})"
    return f"{own} -> {check.to}" if isinstance(check, Reference) else own


def _key(columns: Sequence[str]) -> Column:
    """One text for a key, null if any part is; parts are led by their length, so that no two keys have one text."""
    parts = [F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")) for c in columns]
    return F.concat(*parts)


def audit(tables: Mapping[str, DataFrame], checks: Sequence[Keys | Reference]) -> DataFrame:
    """Kind (key or reference), Relation, CheckedRows, NullRows, FaultyRows and FaultyKeys of every check, in their order.

    Faulty are the rows of a key that occurs more than once, and references to a key that no row has. A key or reference with a null
    part is counted as null and is not faulty. A reference is checked against the ``Keys`` of the table it leads to. Every table is read once; an
    empty one has a row of zeros.
    """
    known = {c.table: i for i, c in enumerate(checks) if isinstance(c, Keys)}
    parts = []
    for table in dict.fromkeys(c.table for c in checks):
        rows = F.array(
            *(
                F.struct(
                    F.lit(known[c.to] if isinstance(c, Reference) else i).alias("domain"),
                    F.lit(i).alias("check"),
                    _key(c.columns).alias("key"),
                )
                for i, c in enumerate(checks)
                if c.table == table
            )
        )
        parts.append(tables[table].select(F.inline(rows)))
    pairs = parts[0]
    for more in parts[1:]:
        pairs = pairs.unionByName(more)
    # the one shuffle: how often each check has a key, for all checks of its domain
    met = pairs.groupBy("domain", "key").agg(*(F.count_if(F.col("check") == i).alias(f"n{i}") for i in range(len(checks))))
    counts = F.array(*(F.struct(F.lit(i).alias("check"), F.col(f"n{i}").alias("n")) for i in range(len(checks))))
    there = F.exists(counts, lambda c: (c["check"] == F.col("domain")) & (c["n"] > 0))
    each = met.select("domain", F.col("key").isNull().alias("null"), there.alias("there"), F.inline(F.filter(counts, lambda c: c["n"] > 0)))
    faulty = ~F.col("null") & F.when(F.col("check") == F.col("domain"), F.col("n") > 1).otherwise(~F.col("there"))
    figures = each.groupBy("check").agg(
        F.sum("n").alias("CheckedRows"),
        F.coalesce(F.sum(F.when(F.col("null"), F.col("n"))), F.lit(0)).alias("NullRows"),
        F.coalesce(F.sum(F.when(faulty, F.col("n"))), F.lit(0)).alias("FaultyRows"),
        F.count_if(faulty).alias("FaultyKeys"),
    )
    spark = pairs.sparkSession
    named = spark.createDataFrame(
        [(i, "reference" if isinstance(c, Reference) else "key", _name(c)) for i, c in enumerate(checks)],
        "check int, Kind string, Relation string",
    )
    zeros = {c: 0 for c in ("CheckedRows", "NullRows", "FaultyRows", "FaultyKeys")}
    full = named.join(figures, "check", "left").fillna(zeros).orderBy("check")
    return full.select("Kind", "Relation", *zeros)


def reference_audit(retail: Retail) -> DataFrame:
    """`audit` of the tables a retail model is read from."""
    return audit(retail.tables, STAR_CHECKS if isinstance(retail, StarRetail) else CSV_CHECKS)
