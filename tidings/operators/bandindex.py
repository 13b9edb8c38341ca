"""A stored index of content: fingerprints by band and urls, in hash buckets.

The near-duplicate lookup against stored content needs the stored fingerprints
by band.  Here they are kept that way: ``KeyTable`` is a Parquet table in hash
buckets of one key, sorted by it, to which every ingest appends its own rows and
nothing else.  A lookup shuffles the incoming rows to the buckets; the stored
side is read where it lies, without an exchange, and only in the buckets (and
row groups) that a bounded list of incoming keys touches.

A band that many fingerprints share can be split: with ``salts`` above one, a
stored fingerprint lies in one of so many sub-bands by its hash, and an incoming
row looks into all of them.  ``salts`` is chosen when the index is made.

Rows carry the number of the batch that brought them.  A batch looks only at
rows of lower numbers, so a batch that is run again after a failure gives the
same result, and its rows, appended twice, count once.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import simhash as SH

BUCKETS = 32
PRUNE_KEYS = 2_000  # keys of a lookup that are handed to the scan as a list


class KeyTable:
    """``columns`` and ``batch`` in ``buckets`` hash buckets of ``key``, at
    ``path`` in the shared folder.  A later session opens it by the same
    arguments."""

    def __init__(self, spark: SparkSession, path: str, key: str, columns: str, buckets: int = BUCKETS):
        self.spark, self.path, self.key, self.columns, self.buckets = spark, path, key, columns, buckets
        self.name = "tidings_" + hashlib.md5(path.encode()).hexdigest()
        place = path.replace("\\", "\\\\").replace("'", "\\'")
        spark.sql(f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}, batch BIGINT) USING parquet "
                  f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{place}'")
        spark.catalog.refreshTable(self.name)

    def append(self, rows: DataFrame, batch: int = 0) -> None:
        """One file per bucket that gets rows."""
        rows = rows.withColumn("batch", F.lit(batch).cast("bigint")).select(*self.spark.table(self.name).columns)
        rows.repartition(self.buckets, self.key).write.insertInto(self.name)

    def rows(self, keys: DataFrame | None = None, before: int | None = None, most: int = PRUNE_KEYS) -> DataFrame:
        """The stored rows; with ``keys``, a frame of one column, those in the
        buckets of these keys, if they are at most ``most``."""
        out = self.spark.table(self.name)
        if before is not None:
            out = out.where(F.col("batch") < before)
        if keys is not None:
            some = [r[0] for r in keys.distinct().limit(most + 1).collect()]
            if len(some) <= most:
                out = out.where(F.col(self.key).isin(some))
        return out

    def compacted(self, path: str) -> KeyTable:
        """The same rows, each once (as of its first batch), in one file per
        bucket at another path."""
        new = KeyTable(self.spark, path, self.key, self.columns, self.buckets)
        names = [c for c in self.spark.table(self.name).columns if c != "batch"]
        once = self.spark.table(self.name).groupBy(*names).agg(F.min("batch").alias("batch")).select(*names, "batch")
        once.repartition(self.buckets, self.key).write.insertInto(new.name)
        return new

    def drop(self) -> None:
        """Forget the table's name; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def slots(simhash: Column, salts: int, all_salts: bool) -> Column:
    """Numbers of the (band, salt) pairs that a fingerprint lies in, or that
    it has to look into."""
    salt = (lambda b: F.sequence(b * salts, b * salts + (salts - 1))) if all_salts else (
        lambda b: F.array(b * salts + F.pmod(F.xxhash64(simhash), F.lit(salts)).cast("int")))
    keys = F.array(*[F.lit(k << K.SIMHASH_BAND_BITS) + SH.band(simhash, k) for k in range(K.SIMHASH_BANDS)])
    return F.flatten(F.transform(keys, salt))


class ContentIndex:
    """Stored content as the ingest looks at it: ``bands`` and ``urls``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS, salts: int = 1):
        self.salts = salts
        self.bands = KeyTable(spark, f"{path.rstrip('/')}/bands", "slot", "slot INT, simhash BIGINT", buckets)
        self.urls = KeyTable(spark, f"{path.rstrip('/')}/urls", "url", "url STRING", buckets)

    def add(self, rows: DataFrame, batch: int = 0) -> None:
        """Rows ``(url, simhash)`` of stored content."""
        once = rows.where("simhash IS NOT NULL").select("simhash").distinct()
        self.bands.append(once.select(F.explode(slots(F.col("simhash"), self.salts, False)).alias("slot"), "simhash"), batch)
        self.urls.append(rows.where("url IS NOT NULL").select("url").distinct(), batch)

    def near_dup_urls(self, incoming: DataFrame, threshold: float = K.SIMILARITY_THRESHOLD, before: int | None = None) -> DataFrame:
        """J3 + J4 against the index: incoming rows (``id``, ``url``,
        ``simhash``) with a stored fingerprint that shares a band and is similar
        (> threshold)."""
        inc = incoming.select("id", "url", "simhash", F.explode(slots(F.col("simhash"), self.salts, True)).alias("slot"))
        stored = self.bands.rows(inc.select("slot"), before).select(F.col("slot").alias("at"), F.col("simhash").alias("ex_hash"))
        similar = (inc["slot"] == stored["at"]) & (SH.similarity(inc["simhash"], stored["ex_hash"]) > F.lit(float(threshold)))
        return inc.join(stored.hint("merge"), similar, "left_semi").select("id", "url").distinct()

    def unknown_urls(self, incoming: DataFrame, before: int | None = None) -> DataFrame:
        """Incoming rows whose url is not stored."""
        stored = self.urls.rows(incoming.select("url"), before).select("url")
        return incoming.join(stored.hint("merge"), "url", "left_anti")

    def drop(self) -> None:
        self.bands.drop()
        self.urls.drop()
