"""Orders written to CSV and imported again, some with faults: what an import takes and what it sets aside."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from salesloom.operators.materialize import scratch_dir
from salesloom.plans.retail import Retail
from salesloom.sources.imports import import_csv

#: Of every so many order ids one gets a date that is none, one an id that is none, and one a note over two lines.
EVERY = 50


def import_outcomes(retail: Retail) -> DataFrame:
    """Records and lines per outcome of an import of all orders, and the greatest order id of those accepted.

    The export has a fault in every order whose id leaves 1 or 2 modulo EVERY, and a quoted line break where it leaves 3.
    """
    orders = retail.orders()
    spark = orders.sparkSession
    place = F.col("OrderID") % EVERY
    text = F.col("OrderID").cast("string")
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    orders.select(
        F.when(place == 2, F.concat(F.lit("#"), text)).otherwise(text).alias("OrderID"),
        F.when(place == 1, "unknown").otherwise(F.col("OrderDate").cast("string")).alias("OrderDate"),
        F.when(place == 3, 'first "part",\nsecond').otherwise("-").alias("Note"),
    ).write.csv(path, header=True, escape='"', nullValue="NULL")
    found = import_csv(spark, path, "OrderID bigint, OrderDate date, Note string")
    two_lines = F.col("Note").contains("\n")
    accepted = found.accepted.select(
        F.lit("accepted").alias("Outcome"), F.when(two_lines, 2).otherwise(1).cast("long").alias("Lines"), F.col("OrderID").cast("bigint")
    )
    rejected = found.rejected.select(
        F.substring_index("Reason", ":", 1).alias("Outcome"), "Lines", F.lit(None).cast("bigint").alias("OrderID")
    )
    return (
        accepted.unionByName(rejected)
        .groupBy("Outcome")
        .agg(F.count("*").alias("Records"), F.sum("Lines").alias("Lines"), F.max("OrderID").alias("GreatestID"))
        .orderBy("Outcome")
    )
