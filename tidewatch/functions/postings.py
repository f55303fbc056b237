"""Tables stored by key, so that a lookup opens the folders of its keys and nothing else."""
from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _bucket(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


class Postings(NamedTuple):
    """Where rows with ``key`` lie: a folder a hash bucket, files sorted by (key, order)."""
    folder: str
    schema: str
    key: str
    buckets: int

    def rows(self, keys: DataFrame) -> DataFrame:
        """Stored rows whose key is in the one column of ``keys``. Only bucket numbers pass the driver."""
        wanted = keys.toDF("_key").filter("_key IS NOT NULL").distinct()
        found = sorted(r[0] for r in wanted.select(_bucket("_key", self.buckets)).distinct().collect())
        return self._read(keys.sparkSession, found).join(wanted, F.col(self.key) == F.col("_key"), "left_semi")

    def rows_of(self, spark: SparkSession, keys: list[str]) -> DataFrame:
        """The same for a bounded list of keys, which reaches the files' statistics too."""
        kept = sorted({k for k in keys if k is not None})
        found = spark.createDataFrame([(k,) for k in kept], "_key string").select(_bucket("_key", self.buckets)).distinct().collect()
        return self._read(spark, sorted(r[0] for r in found)).filter(F.col(self.key).isin(kept))

    def _read(self, spark: SparkSession, found: list[int]) -> DataFrame:
        stored = spark.read.schema(f"{self.schema}, bucket int").option("basePath", self.folder).parquet(self.folder)
        return stored.filter(F.col("bucket").isin(found)).drop("bucket")


def store_postings(rows: DataFrame, key: str, order: list[str], folder: str, buckets: int = 256) -> Postings:
    """``rows`` written below ``folder``, a folder a bucket of ``key``; rows without a key are left out.

    Rows are dealt by ranges of (bucket, key, order): a task writes few buckets, and a key that holds a third of all rows is
    written by as many tasks as its share.
    """
    sorted_by = ["bucket", key, *order]
    dealt = rows.filter(F.col(key).isNotNull()).withColumn("bucket", _bucket(key, buckets)).repartitionByRange(*sorted_by).sortWithinPartitions(*sorted_by)
    dealt.write.partitionBy("bucket").parquet(folder)
    return Postings(folder, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), key, buckets)
