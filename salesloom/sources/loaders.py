"""Load tables. Every schema is explicit, so no file is read to guess types."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from salesloom.sources.schemas import CSV_TABLES


def csv_header(spark: SparkSession, path: str, wanted: Iterable[str]) -> list[str]:
    """The names in the header line, the only one that is read for this; an error if one of ``wanted`` is not there once."""
    # names twice in it get their number from Spark
    columns = spark.read.options(header=True, encoding="UTF-8", escape='"').csv(path).columns
    header = [name.strip("\ufeff ") for name in columns]
    missing = [name for name in wanted if name not in header]
    if missing:
        raise ValueError(f"{path}: the header lacks, or names twice, {', '.join(missing)}")
    return header


def load_csv(
    spark: SparkSession, path: str, schema: str | T.StructType, null_value: str = "NULL"
) -> DataFrame:
    """One exported CSV table: header line, quoted text, ``NULL`` for missing, padded text trimmed.

    Columns are found by their name in the header, in any order and however padded; further columns are ignored. A
    column of ``schema`` that the header lacks or names twice is an error, and so is a line shorter or longer than the
    header. The files of a folder must share one header. ``imports.import_csv`` sets such lines aside and goes on.
    """
    reader = spark.read.options(
        header=True, encoding="UTF-8", escape='"', nullValue=null_value, multiLine=False, mode="FAILFAST"
    )
    wanted = {f.name: f.dataType for f in (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema)}
    header = csv_header(spark, path, wanted)
    stored = T.StructType(
        [T.StructField(name if name in wanted else f"_other{i}", wanted.get(name, T.StringType())) for i, name in enumerate(header)]
    )
    frame = reader.schema(stored).csv(path).select(*wanted)
    return frame.select(
        *(
            F.trim(f.name).alias(f.name) if isinstance(f.dataType, T.StringType) else F.col(f.name)
            for f in frame.schema
        )
    )


def load_csv_tables(
    spark: SparkSession, folder: str, names: list[str] | None = None
) -> dict[str, DataFrame]:
    """The exported tables in ``folder``, all eleven unless ``names`` says which."""
    out = {}
    for name in names or CSV_TABLES:
        file, schema = CSV_TABLES[name]
        out[name] = load_csv(spark, f"{folder}/{file}", schema)
    return out


class ParquetTables(Mapping[str, DataFrame]):
    """Parquet tables ``folder``/<name>.parquet, opened when first asked for.

    Opening a table reads a footer; a report pays for the tables it uses only.
    """

    def __init__(self, spark: SparkSession, folder: str, names: Sequence[str]):
        self._spark, self._folder, self._names = spark, folder, tuple(names)
        self._open: dict[str, DataFrame] = {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._names:
            raise KeyError(name)
        if name not in self._open:
            self._open[name] = self._spark.read.parquet(f"{self._folder}/{name}.parquet")
        return self._open[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._names)

    def __len__(self) -> int:
        return len(self._names)


def load_parquet(spark: SparkSession, folder: str, names: Sequence[str]) -> ParquetTables:
    return ParquetTables(spark, folder, names)


def register_views(tables: Mapping[str, DataFrame]) -> None:
    """Make the tables available to ``spark.sql`` under their names."""
    for name, frame in tables.items():
        frame.createOrReplaceTempView(name)
