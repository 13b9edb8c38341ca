"""Tables stored by hash bucket, changed where they are touched.

A table that takes many small changes (URLs, hosts, content) is kept as Parquet
under ``bucket=<n>/``, the bucket a hash of its key.  A transition of the
frontier is a function of a table and a request frame; ``BucketedTable.update``
applies it to the buckets of the requested keys alone: the others are neither
read nor written.

A changed bucket is written to the shared folder first and then moved into its
place with dynamic partition overwrite, so the table is never read and
overwritten by one job, and a lost executor leaves the old files.  One writer at
a time; claims across processes need a transactional table format.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


class BucketedTable:
    """A table at ``path`` in ``buckets`` hash buckets of the column ``key``."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.buckets = spark, path, key, buckets

    def bucket(self, key: Column | None = None) -> Column:
        return F.pmod(F.xxhash64(F.col(self.key) if key is None else key), F.lit(self.buckets)).cast("int")

    def write(self, rows: DataFrame) -> None:
        """Replace the buckets that ``rows`` has rows of."""
        rows = rows.withColumn("bucket", self.bucket())
        (rows.repartition(self.buckets, "bucket").write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(self.path))

    def rows(self, keys: DataFrame | None = None) -> DataFrame:
        """The table; with ``keys`` (a frame with the key column) the buckets
        that these keys lie in."""
        out = self.spark.read.parquet(self.path)
        if keys is not None:
            out = out.where(F.col("bucket").isin(self.touched(keys)))
        return out.drop("bucket")

    def touched(self, keys: DataFrame) -> list[int]:
        """Numbers of the keys' buckets, at most as many as there are."""
        return sorted(r[0] for r in keys.select(self.bucket()).distinct().collect())

    def update(self, keys: DataFrame, transition: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Apply ``transition`` to the rows in the buckets of ``keys``.  Returns
        what it returned for them, with ``applied`` if it gives that."""
        from ..session import cut_lineage
        new = cut_lineage(transition(self.rows(keys)))
        self.write(new.drop("applied"))
        return new
