"""CSV import that sets bad records aside instead of ending the load: file, line and reason of each.

Lines are read and numbered where they lie, so a file of any size is split over tasks. A record runs over several lines
while a quote is open; whether one is open where a line begins follows from the quotes before it, which are counted per
split and added up over the splits of a file (one row each). Only lines of such records are grouped.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesloom.operators.materialize import materialize
from salesloom.sources.loaders import csv_header
from salesloom.sources.schemas import CSV_TABLES

MOST_LINES = 1000
ACCEPTED, REJECTED, BLANK, HEADER = "accepted", "rejected", "blank", "header"


@dataclass(frozen=True)
class Imported:
    """A load that has been gone through: its good rows, its bad records, and how many there were of each.

    ``accepted`` has the columns of the schema. ``rejected`` has File, Line (the first, from 1), Lines, Reason, Record (the text
    as it stood). ``counts`` has File, Lines, Records, Headers, Blank, Accepted and Rejected; the last four add up to Records.
    """

    accepted: DataFrame
    rejected: DataFrame
    counts: DataFrame


def import_csv(
    spark: SparkSession, path: str, schema: str | T.StructType, null_value: str = "NULL", most_lines: int = MOST_LINES
) -> Imported:
    """Read one exported CSV table, a file or a folder of files with the same header.

    As `load_csv`, columns are found by name, ``null_value`` is null and text is trimmed. A record is rejected if it has
    another number of fields than the header or a value that its column's type cannot hold. Line breaks inside quotes are part of
    the value, as "\\n". If a quote stays open for more than ``most_lines`` lines, or to the end of the file, the line that opens it and the
    one that closes it are rejected, and the lines between are records of their own. Blank lines are counted and otherwise ignored. A header without one of the
    columns is an error. An empty folder gives empty tables.
    """
    wanted = {f.name: f.dataType for f in (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)}
    header = csv_header(spark, path, wanted)
    stored = [T.StructField(name if name in wanted else f"_other{i}", wanted.get(name, T.StringType())) for i, name in enumerate(header)]
    typed = T.StructType([*stored, T.StructField("_bad", T.StringType())])
    texts = T.StructType([*(T.StructField(f.name, T.StringType()) for f in stored), T.StructField("_bad", T.StringType())])

    def parsed(shape: T.StructType) -> Column:
        options = {"escape": '"', "nullValue": null_value, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "maxCharsPerColumn": "-1"}
        return F.from_csv("record", _ddl(shape), options)

    record = F.col("record")
    kind = (
        F.when((F.col("line") == 1) & ~F.col("open"), HEADER)
        .when(~F.col("open") & (F.trim(record) == ""), BLANK)
        .when(F.col("open") | F.col("row._bad").isNotNull(), REJECTED)
        .otherwise(ACCEPTED)
    )
    # a field that was there as text and is not there with its type
    misfits = [
        F.when(F.col(f"text.`{f.name}`").isNotNull() & F.col(f"row.`{f.name}`").isNull(), F.concat(F.lit(f"{f.name} is no {f.dataType.simpleString()}: "), f"text.`{f.name}`"))
        for f in stored
        if not isinstance(f.dataType, T.StringType)
    ]
    fields = F.when(F.col("text._bad").isNotNull(), F.lit(f"not {len(stored)} fields"))
    reason = F.coalesce(F.when(F.col("open"), F.lit("quote not closed")), fields, *misfits, F.lit("not readable"))
    judged = materialize(
        _records(spark, path, most_lines)
        .select("*", parsed(typed).alias("row"), parsed(texts).alias("text"))
        .withColumn("kind", kind)
        .select("file", "line", "lines", "kind", "row", F.when(F.col("kind") == REJECTED, reason).alias("reason"), F.when(F.col("kind") == REJECTED, record).alias("record"))
    )
    accepted = judged.where(F.col("kind") == ACCEPTED).select(
        *(
            (F.trim(f"row.`{name}`") if isinstance(kind, T.StringType) else F.col(f"row.`{name}`")).alias(name)
            for name, kind in wanted.items()
        )
    )
    rejected = judged.where(F.col("kind") == REJECTED).select(
        F.col("file").alias("File"), F.col("line").alias("Line"), F.col("lines").alias("Lines"), F.col("reason").alias("Reason"), F.col("record").alias("Record")
    )
    counts = judged.groupBy(F.col("file").alias("File")).agg(
        F.sum("lines").alias("Lines"),
        F.count("*").alias("Records"),
        *(F.count_if(F.col("kind") == k).alias(n) for n, k in (("Headers", HEADER), ("Blank", BLANK), ("Accepted", ACCEPTED), ("Rejected", REJECTED))),
    )
    return Imported(accepted, rejected, counts)


def import_csv_tables(spark: SparkSession, folder: str, names: list[str] | None = None) -> dict[str, Imported]:
    """The exported tables in ``folder``, all eleven unless ``names`` says which."""
    return {name: import_csv(spark, f"{folder}/{CSV_TABLES[name][0]}", CSV_TABLES[name][1]) for name in names or CSV_TABLES}


def _ddl(shape: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in shape)


def _records(spark: SparkSession, path: str, most_lines: int) -> DataFrame:
    """file, line (the first, from 1), lines, record, open (it has one end of a quote that is not closed in time)."""
    # written once: the numbers of a second scan would differ if it were split otherwise
    lines = materialize(
        spark.read.text(path).select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.monotonically_increasing_id().alias("id"),
            F.col("value").alias("record"),
            ((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2).alias("odd"),
        )
    )
    earlier = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)
    splits = lines.groupBy("file", "split").agg(F.count("*").alias("n"), F.sum("odd").alias("odds")).select(
        "file",
        "split",
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("lines_before"),
        F.coalesce(F.sum("odds").over(earlier), F.lit(0)).alias("odd_before"),
    )
    inside = W.partitionBy("file", "split").orderBy("id")  # a split's lines
    numbered = lines.join(splits, ["file", "split"]).select(
        "file",
        (F.col("lines_before") + F.row_number().over(inside)).alias("line"),
        "record",
        "odd",
        (F.col("odd_before") + F.sum("odd").over(inside)).alias("seen"),
    )
    # a line under an open quote, and the one that opens it, have the number of the quote's line
    opened = F.col("seen") - F.when((F.col("odd") == 1) & (F.col("seen") % 2 == 0), 1).otherwise(0)
    told = materialize(numbered.withColumn("quote", F.when(opened % 2 == 1, opened)).drop("seen"))
    single = told.where(F.col("quote").isNull()).select("file", "line", F.lit(1).cast("long").alias("lines"), "record", F.lit(False).alias("open"))
    spanning = told.where(F.col("quote").isNotNull())
    sizes = spanning.groupBy("file", "quote").agg(F.count("*").alias("lines"), F.sum("odd").alias("odds"))
    whole = (F.col("lines") <= most_lines) & (F.col("odds") == 2)
    sized = spanning.join(sizes, ["file", "quote"])
    joined = (
        sized.where(whole)
        .groupBy("file", "quote")
        .agg(F.array_sort(F.collect_list(F.struct("line", "record"))).alias("parts"))  # most_lines at most
        .select(
            "file",
            F.col("parts")[0]["line"].alias("line"),
            F.size("parts").cast("long").alias("lines"),
            F.array_join(F.col("parts")["record"], "\n").alias("record"),
            F.lit(False).alias("open"),
        )
    )
    apart = sized.where(~whole).select("file", "line", F.lit(1).cast("long").alias("lines"), "record", (F.col("odd") == 1).alias("open"))
    return single.unionByName(joined).unionByName(apart)
