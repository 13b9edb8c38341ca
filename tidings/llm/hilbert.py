"""Hilbert-curve sharding.

Metadata dimensions are quantised to a few bits each, a row's cell gets its
index on the Hilbert curve, rows are put in the order of that index, and the
order is cut into runs of nearly equal bytes.  Cells that are close on the
curve are close in every dimension, so each shard spans small ranges of all of
them and min/max statistics prune files on any of them.

Rows of equal texts take the metadata of their first row, hence lie next to
each other.  A group is kept in one shard; only one that alone exceeds what a shard's
size may deviate, ``whole`` of a shard's bytes (a third of all rows, say), is
cut between rows.

Scale: only narrow rows are shuffled.  Positions come from a range partitioning
on (index, text, row) -- a hot cell or a hot text is split over many ranges --
with one sum per range; no window spans more than a range.  What is broadcast
is one row per range or per shard.

Defined cases: a null text has 16 bytes and the checksum of no bytes; null
metadata sort first; repeated rows are separate rows; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, read_table

SHARDS, BITS, WHOLE = 40, 4, 0.1


def curve_states(n: int) -> tuple[list[int], list[int]]:
    """Transition tables of the n-dimensional Hilbert curve: for state
    ``entry * n + direction`` and corner ``bits`` (at ``state * 2**n + bits``)
    the corner's rank on the curve and the state inside that corner."""
    size, mask = 1 << n, (1 << n) - 1
    right = lambda b, k: (b >> k % n | b << (n - k % n)) & mask
    gray = lambda w: w ^ w >> 1
    rank_of = {gray(w): w for w in range(size)}
    entry = lambda w: 0 if w == 0 else gray(2 * ((w - 1) // 2))

    def ones(w: int) -> int:
        return 0 if not w & 1 else 1 + ones(w >> 1)

    def turn(w: int) -> int:
        return 0 if w == 0 else ones(w - 1 if w % 2 == 0 else w) % n

    ranks, states = [], []
    for state in range(size * n):
        e, d = divmod(state, n)
        for bits in range(size):
            w = rank_of[right(bits ^ e, d + 1)]
            ranks.append(w)
            states.append((e ^ right(entry(w), n - (d + 1) % n)) * n + (d + turn(w) + 1) % n)
    return ranks, states


def hilbert_index(coordinates: list[Column], bits: int) -> Column:
    """Index on the curve of a point whose coordinates are ``bits`` wide."""
    n = len(coordinates)
    ranks, states = (F.array(*[F.lit(x) for x in xs]) for xs in curve_states(n))
    point = F.array(*[c.cast("int") for c in coordinates])

    def step(at: Column, i: Column) -> Column:
        corner = F.aggregate(F.transform(point, lambda x, j: F.call_function("shiftright", x, i).bitwiseAND(1) * F.pow(F.lit(2), j).cast("int")), F.lit(0), lambda a, b: a + b)
        k = at["state"] * (1 << n) + corner + 1
        return F.struct((at["index"] * (1 << n) + F.element_at(ranks, k)).alias("index"), F.element_at(states, k).alias("state"))

    levels = F.array(*[F.lit(i) for i in range(bits - 1, -1, -1)])
    start = F.struct(F.lit(0).cast("long").alias("index"), F.lit(0).alias("state"))
    return F.aggregate(levels, start, step, lambda at: at["index"])


def ordered_number(c: Column) -> Column:
    """A long that orders strings by their first seven bytes (null: -1), for
    callers that want numbers; ``shard`` compares whole strings."""
    head = F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, 7)), 14, "0")
    return F.coalesce(F.conv(head, 16, 10).cast("long"), F.lit(-1).cast("long"))


def quantised(c: Column, cuts: list) -> Column:
    """Number of cut points not above the value (null: none)."""
    if not cuts:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(x) if isinstance(x, str) else F.lit(x).cast("long") for x in cuts]), lambda x: x <= c))


def string_cuts(rows: DataFrame, name: str, parts: int) -> list[str]:
    """The values of a string column at which the ``i / parts`` quantiles of the
    rows lie, in order of whole values: distinct values with their counts are
    sorted by range, with one sum per range (null is before all others, and no
    cut point)."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = rows.groupBy(F.col(name).alias("value")).agg(F.count("*").alias("n"))
    runs = cut_lineage(values.repartitionByRange(ranges, "value").withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over one row per range
    sums = runs.groupBy("range").agg(F.sum("n").alias("s"))
    total = sums.agg(F.sum("s")).first()[0] or 1
    inside = Window.partitionBy("range").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = runs.join(F.broadcast(sums.select("range", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("start"))), "range").withColumn("end", F.col("start") + F.sum("n").over(inside))
    quantile = lambda c: F.least(F.floor(c * parts / total), F.lit(parts - 1))
    cuts = at.where(F.col("value").isNotNull() & (quantile(F.col("end")) > quantile(F.col("end") - F.col("n"))))
    return sorted((r["value"] for r in cuts.select("value").collect()), key=lambda x: x.encode())


def shard(docs: DataFrame, dimensions: dict[str, Column] | None = None, shards: int = SHARDS, bits: int = BITS,
          whole: float = WHOLE) -> DataFrame:
    """Rows ``(doc_id, size, text_crc32, law, shard, slot, grown_shard, cell)``
    in runs of the Hilbert order; ``dimensions`` are expressions over ``docs``
    that give longs or strings."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.octet_length(text).cast("long") + 16
    dimensions = dimensions or {"lang": F.col("lang").cast("string"), "source": F.col("source").cast("string"), "size": size}
    names = [f"dim{i}" for i in range(len(dimensions))]
    rows = cut_lineage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.md5(text).alias("text_key"),
                                   *[c.alias(n) for n, c in zip(names, dimensions.values(), strict=True)]))
    points = [i / (1 << bits) for i in range(1, 1 << bits)]
    strings = {n for n in names if rows.schema[n].dataType.simpleString() == "string"}
    stats = rows.agg(F.sum("size").alias("total"), *[F.percentile_approx(n, points, 10_000).alias(n) for n in names if n not in strings]).first()
    total = stats["total"] or 1
    cuts = {n: string_cuts(rows, n, 1 << bits) if n in strings else sorted(set(stats[n] or [])) for n in names}
    rows = rows.withColumns({n: quantised(F.col(n), cuts[n]) for n in names})
    cell = hilbert_index([F.col("first")[n] for n in names], bits)
    groups = rows.groupBy("text_key").agg(F.min(F.struct("doc_id", *names)).alias("first"), F.sum("size").alias("group_bytes"))
    small = F.col("group_bytes") <= int(whole * total / shards)
    spread = F.when(small, F.lit(0).cast("long")).otherwise(F.xxhash64("doc_id"))
    placed = cut_lineage(rows.drop(*names).join(groups, "text_key").select("doc_id", "size", "text_crc32", "text_key", cell.alias("cell"), spread.alias("spread"), F.when(small, F.col("group_bytes")).alias("kept_bytes")))

    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["cell", "text_key", "spread", "doc_id"]
    runs = cut_lineage(placed.repartitionByRange(ranges, *order[:3]).withColumn("range", F.spark_partition_id()))
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over one row per range
    starts = runs.groupBy("range").agg(F.sum("size").alias("s"), F.count("*").alias("n")).select("range", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("bytes0"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows0"))
    inside = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = runs.join(F.broadcast(starts), "range")
    at = at.withColumn("end", F.col("bytes0") + F.sum("size").over(inside)).withColumn("position", F.col("rows0") + F.count("*").over(inside) - 1)
    group_start = F.min(F.col("end") - F.col("size")).over(Window.partitionBy("range", "text_key"))
    middle = F.when(F.col("kept_bytes").isNotNull(), group_start + F.col("kept_bytes") / 2).otherwise(F.col("end") - F.col("size") / 2)
    cut = cut_lineage(at.select("doc_id", "size", "text_crc32", "cell", "position", F.least(F.floor(middle * shards / total), F.lit(shards - 1)).cast("int").alias("shard")))
    heads = cut.groupBy("shard").agg(F.min("position").alias("head"))
    return cut.join(F.broadcast(heads), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("position") - F.col("head")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "cell")


def op5_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes along the curve."""
    return shard(read_table(spark, sf_dir, "documents"))
