"""Written tables that grow from round to round."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from salesloom.operators.materialize import scratch_dir


def bulky(frame: DataFrame) -> DataFrame:
    """Like `materialize`, for rows that carry text: compressed more tightly."""
    spark = frame.sparkSession
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


class Appended:
    """Rows added in rounds and read back as one table: the plan stays as small as for one round."""

    def __init__(self, spark: SparkSession, schema: str):
        self._spark, self._schema = spark, schema
        self._path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
        self.add(spark.createDataFrame([], schema))

    def add(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self._path)

    def rows(self) -> DataFrame:
        return self._spark.read.schema(self._schema).parquet(self._path)


class Workspace:
    """Written tables that are dropped together once nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"

    def table(self, frame: DataFrame) -> DataFrame:
        path = f"{self._path}/{uuid.uuid4().hex}"
        frame.write.parquet(path)
        return self._spark.read.schema(frame.schema).parquet(path)

    def drop(self) -> None:
        folder = self._spark._jvm.org.apache.hadoop.fs.Path(self._path)
        folder.getFileSystem(self._spark._jsc.hadoopConfiguration()).delete(folder, True)
