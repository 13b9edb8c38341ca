"""Shared helpers of the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_package

__all__ = ["cut_lineage", "crc_mod", "doc_text", "prepare", "read_table", "text_bytes", "trimmed", "trimmed_groups"]

ship_package()


def prepare(spark: SparkSession, rows: int = 1000) -> None:
    """Bound what one Arrow batch holds, so that long texts don't pile up in a
    Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def doc_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone (null text: empty); other columns, whatever
    their names, never reach an operator."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n`` (null id: as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def text_bytes(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts: one narrow aggregate, used to size partitions."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def give_back() -> None:
    """Give a Python worker's free memory back to the system: workers live on
    between tasks and stages, and what an idle one holds is missing elsewhere."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def trimmed(run):
    """``run``, a function over a partition's Arrow batches, which at its end
    gives free memory back."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def trimmed_groups(run):
    """The same for a function of a cogroup, after each group."""

    def wrapped(key, left, right):
        try:
            return run(key, left, right)
        finally:
            give_back()

    return wrapped
