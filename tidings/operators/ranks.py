"""Positions within groups, without a task that holds a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STARTS_BROADCAST = 100_000  # rows of (range, group), some 50 bytes each


def positions(rows: DataFrame, keys: list[str], order: list[str | Column], name: str = "pos") -> DataFrame:
    """``rows`` with ``name``: the 1-based position of each row among those of
    equal ``keys`` (a null key is a value), by ``order``.

    The rows are range-partitioned by (keys, order) and sorted, so a group that
    holds most rows covers many ranges.  A row's position is its place in the
    range, less the place at which its group begins there, plus the group's
    rows in earlier ranges: one count per range and group."""
    from ..session import cut_lineage
    by = [*keys, *order]
    sorted_rows = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = cut_lineage(sorted_rows.withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_range", F.shiftright("_at", 33)).withColumn("_at", F.col("_at").bitwiseAND((1 << 33) - 1))
    group = [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]
    counts = placed.groupBy("_range", *group).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    names = [f"_key{i}" for i in range(len(keys))]
    earlier = Window.partitionBy(*names).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = cut_lineage(counts.select(F.col("_range").alias("_in"), *names, (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_start")))
    if starts.limit(STARTS_BROADCAST + 1).count() <= STARTS_BROADCAST:
        starts = F.broadcast(starts)
    same = F.col("_range") == F.col("_in")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return placed.join(starts, same).withColumn(name, F.col("_at") + F.col("_start")).drop("_at", "_range", "_in", "_start", *names)
