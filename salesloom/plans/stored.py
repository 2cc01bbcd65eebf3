"""Orders and lines stored by order, so that what meets on the order key meets without a shuffle.

Both tables are bucketed and sorted by their order key, in the same number of buckets. Totals by order, their count of
products and the join of orders with totals then read bucket by bucket: no plan above the scans moves a row until it
groups by something else. Orders of more than ``most_lines`` lines are stored beside the buckets, unbucketed, because a
bucket is read by one task; their totals are summed before their shuffle, and the totals (a row per order, no lines) of such a
store meet the orders in a shuffle.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salesloom.operators.materialize import fresh_path
from salesloom.plans.reports.revenue import quarterly_trend
from salesloom.plans.retail import Retail

ROWS_PER_BUCKET = 500_000
MIN_BUCKETS = 8
MOST_LINES = 100_000  # a fifth of a bucket
_ABOUT = "buckets int, crowded boolean"


def _table(folder: str, name: str) -> str:
    return f"by_order_{hashlib.md5(folder.encode()).hexdigest()[:16]}_{name}"


def _by_key(frame: DataFrame, key: str, folder: str, name: str, buckets: int) -> None:
    # the shuffle deals rows as the buckets do, so each task writes one file
    laid = frame.repartition(buckets, F.col(key))
    writer = laid.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", f"{folder}/{name}")
    writer.saveAsTable(_table(folder, name))


def store(retail: Retail, folder: str, buckets: int | None = None, most_lines: int = MOST_LINES) -> None:
    """Write the orders and lines of ``retail`` to ``folder``, which must not hold a store yet.

    Null keys and repeated rows are kept; lines without an order count as one order. The row that describes the
    store is written last: without it there is no store to open. Nothing but two counts reaches the driver.
    """
    (orders, order_key), (lines, line_key) = retail.FACTS
    facts = retail.tables[lines]
    sizes = facts.groupBy(F.col(line_key).alias("order")).agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    buckets = buckets or max(MIN_BUCKETS, (total["rows"] or 0) // ROWS_PER_BUCKET)
    crowded = (total["most"] or 0) > most_lines
    if crowded:
        large = sizes.where(F.col("n") > most_lines).select("order")
        met = F.col(line_key).eqNullSafe(F.col("order"))
        facts.join(large, met, "left_semi").write.parquet(f"{folder}/crowded")
        facts = facts.join(large, met, "left_anti")
    _by_key(retail.tables[orders], order_key, folder, "orders", buckets)
    _by_key(facts, line_key, folder, "lines", buckets)
    spark = facts.sparkSession
    spark.createDataFrame([(buckets, crowded)], _ABOUT).write.parquet(f"{folder}/about")


def _opened(spark: SparkSession, frame: DataFrame, key: str, folder: str, name: str, buckets: int) -> DataFrame:
    """The stored table with its buckets; a session that did not write it has to be told of them."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {_table(folder, name)} ({columns}) USING parquet "
        f"CLUSTERED BY (`{key}`) SORTED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{folder}/{name}'"
    )
    return spark.table(_table(folder, name))


def open_stored(retail: Retail, folder: str) -> Retail:
    """``retail`` with its orders and lines read from the store in ``folder``."""
    (orders, order_key), (lines, line_key) = retail.FACTS
    spark = retail.tables[orders].sparkSession
    about = spark.read.schema(_ABOUT).parquet(f"{folder}/about").first()
    booked = _opened(spark, retail.tables[orders], order_key, folder, "orders", about["buckets"])
    sold = _opened(spark, retail.tables[lines], line_key, folder, "lines", about["buckets"])
    if not about["crowded"]:
        return retail.replaced({orders: booked, lines: sold})
    crowded = spark.read.schema(retail.tables[lines].schema).parquet(f"{folder}/crowded")
    whole = retail.replaced({orders: booked, lines: sold.unionByName(crowded)})
    whole.parts = [retail.replaced({orders: booked, lines: part}) for part in (sold, crowded)]
    return whole


def stored_trend(retail: Retail, buckets: int | None = None, most_lines: int = MOST_LINES) -> DataFrame:
    """The quarterly trend, read from a store that is written first."""
    folder = fresh_path(retail.tables[retail.FACTS[0][0]].sparkSession)
    store(retail, folder, buckets, most_lines)
    return quarterly_trend(open_stored(retail, folder))
