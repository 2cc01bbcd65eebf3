"""Sums per key that are kept and brought up to date by batches.

The state of a ledger is a table of keys and sums, written anew under a version for each batch. A version counts once its entry in
the log is there, which names the batch; the entry is written last, so a run that is broken off leaves the old version in
force. A batch whose name is in the log is not applied again. Corrections are rows with the opposite sign.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOG = "version int, batch string, source int"


class Ledger:
    """``keys`` and ``sums`` of a state kept under ``path``, with ``rows`` (the number of rows behind a key) beside the sums.

    One writer at a time; readers may go on reading the version they opened.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], sums: Sequence[str]):
        self._spark, self._path, self._keys, self._sums = spark, path.rstrip("/"), list(keys), [*sums, "rows"]

    def _log(self) -> DataFrame:
        try:
            return self._spark.read.schema(_LOG).parquet(f"{self._path}/log")
        except AnalysisException as error:  # a ledger without any batch has no folder yet
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self._spark.createDataFrame([], _LOG)

    def version(self) -> int:
        """The version in force, 0 without any batch."""
        return self._log().agg(F.max("version")).first()[0] or 0

    def state(self, version: int | None = None) -> DataFrame | None:
        """Keys and sums, in a version or as they are; keys whose rows are all taken back are gone. None without any batch."""
        known = self._log().where(F.lit(version is None) | (F.col("version") == F.lit(version)))
        newest = known.orderBy(F.desc("version")).limit(1).collect()
        if not newest:
            return None
        # the folder is named by the batch as well: one that a broken run left is never taken for a whole one
        return self._spark.read.parquet(self._folder(newest[0]["version"], newest[0]["source"]))

    def _folder(self, version: int, source: int) -> str:
        return f"{self._path}/state/version={version:08d}-{source}"

    def apply(self, batch: str, changes: DataFrame) -> int:
        """Adds ``changes`` (keys, sums and ``sign``, 1 or -1 for each row) as the batch of that name, and returns the version that has
        it. A batch that was applied before changes nothing.

        Null sums count as nothing. The changes are summed before they meet the state, so a batch costs its own rows and
        one pass over the keys.
        """
        log = self._log()
        done = log.where(F.col("batch") == batch).agg(F.max("version")).first()[0]
        if done:
            return done
        signed = changes.withColumn("rows", F.lit(1).cast("bigint"))
        amounts = {c: (F.col(c) * F.col("sign")).alias(c) for c in self._sums}
        added = signed.select(*self._keys, *amounts.values())
        before = self.state()
        kinds = dict(before.dtypes if before is not None else self._summed(added).dtypes)
        whole = self._summed(added)
        if before is not None:
            both = before.unionByName(whole.select(*(F.col(c).cast(kinds[c]).alias(c) for c in before.columns)))
            whole = self._summed(both)
        version = self.version() + 1
        source = self._spark.range(1).select((F.rand() * 2**30).cast("int")).first()[0]
        kept = whole.where("rows <> 0").select(*self._keys, *(F.col(c).cast(kinds[c]).alias(c) for c in self._sums))
        kept.write.parquet(self._folder(version, source))
        entry = self._spark.createDataFrame([(version, batch, source)], _LOG)
        entry.coalesce(1).write.mode("append").parquet(f"{self._path}/log")
        return version

    def _summed(self, rows: DataFrame) -> DataFrame:
        return rows.groupBy(*self._keys).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in self._sums))
