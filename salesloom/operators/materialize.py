"""Cut a plan: write a frame once and go on from the written table."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session may go without: it gets a temporary folder. On a
    cluster such a folder would exist on one machine only, so that is an error.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return f"{shared.rstrip('/')}/{spark.sparkContext.applicationId}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="salesloom-")
    return _LOCAL_SCRATCH[app]


def fresh_path(spark: SparkSession) -> str:
    """A folder in the scratch folder that no one uses yet."""
    return f"{scratch_dir(spark)}/{uuid.uuid4().hex}"


def materialize(frame: DataFrame) -> DataFrame:
    """Write ``frame`` to Parquet in the scratch folder and return the table.

    Runs one job. Used where a frame is read several times (cut points, bucket
    statistics, result): the expensive joins below it run once, later reads take
    only the columns they need, and a lost executor costs a re-read, not a
    recomputation. The tables live as long as checkpoints would: until the
    application's scratch folder is dropped.
    """
    spark = frame.sparkSession
    path = fresh_path(spark)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
