"""Groups of near copies within one batch: connected components over links.

Fingerprints are linked if they share a band and are similar.  Only distinct
fingerprints are compared.  In a band's bucket the links found are at most one
less than its members: a task compares blocks of ``BLOCK`` members with each
other and keeps a spanning forest, never all pairs.  A bucket of one block is one
group of rows; a larger one is dealt out by pairs of blocks.

The components come from alternating star steps over the links (large star,
small star), each a written table, until nothing changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import simhash as SH

BLOCK = 2048
LINKS = "a long, b long"


def band_links(fingerprints: DataFrame, threshold: float = K.SIMILARITY_THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``(a, b)``, a < b: links that connect, within each band's bucket, what
    is connected there by similarity above ``threshold``."""
    from ..session import cut_lineage
    once = fingerprints.where("simhash IS NOT NULL").select("simhash").distinct()
    members = cut_lineage(once.select("simhash", F.posexplode(SH.bands(F.col("simhash"))).alias("band_no", "band")))
    sizes = members.groupBy("band_no", "band").agg(F.count("*").alias("n")).where("n > 1")
    blocks = sizes.select("band_no", "band", F.ceil(F.col("n") / block).cast("int").alias("blocks"))
    dealt = members.join(blocks, ["band_no", "band"]).withColumn("own", F.pmod(F.xxhash64("simhash"), F.col("blocks")).cast("int"))
    # each member meets its own block, and as one side every other block
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    rows = dealt.select("band_no", "band", "own", "simhash", F.explode(pairs).alias("pair")).select("band_no", "band", "pair.i", "pair.j", "own", "simhash")

    def run(table):
        import numpy as np
        import pyarrow as pa

        own = table.column("own").to_numpy()
        h = table.column("simhash").to_numpy().view(np.uint64)
        left = np.flatnonzero(own == table.column("i")[0].as_py())
        right = np.flatnonzero(own == table.column("j")[0].as_py())
        label = np.arange(len(h))  # of the members joined so far
        links = []
        for x in left:
            near = right[(1.0 - np.bitwise_count(h[right] ^ h[x]) / 64.0 > threshold) & (label[right] != label[x])]
            while len(near):
                links.append((int(h[x].view(np.int64)), int(h[near[0]].view(np.int64))))
                label[label == label[near[0]]] = label[x]
                near = near[label[near] != label[x]]
        return pa.table({"a": pa.array([min(p) for p in links], pa.int64()), "b": pa.array([max(p) for p in links], pa.int64())})

    return cut_lineage(rows.groupBy("band_no", "band", "i", "j").applyInArrow(run, LINKS).distinct())


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of all nodes of ``links`` (a, b), the root being the
    least of its component."""
    from ..session import cut_lineage

    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        met = both.join(least, "u")
        if large:
            out = met.where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))
        else:
            out = met.select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        return out.where("a <> b").distinct()

    edges = cut_lineage(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    while True:
        new = cut_lineage(star(star(edges, True), False))
        # a forest of stars: no node is both a root and below one
        if new.join(new.select(F.col("b").alias("a")), "a", "left_semi").isEmpty() and new.groupBy("b").count().where("count > 1").isEmpty():
            return new.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(new.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
        edges = new


def near_copy_groups(rows: DataFrame, threshold: float = K.SIMILARITY_THRESHOLD, block: int = BLOCK) -> DataFrame:
    """``(id, url, group_id)``: rows (``id``, ``url``, ``simhash``) of one batch
    that are linked, directly or through others, get the least id among them;
    rows of equal fingerprints belong together."""
    roots = components(band_links(rows, threshold, block)).select(F.col("node").alias("simhash"), "root")
    own = rows.select("id", "url", "simhash").join(roots, "simhash", "left").withColumn("root", F.coalesce("root", "simhash"))
    least = own.groupBy("root").agg(F.min("id").alias("group_id"))
    return own.join(least.withColumnRenamed("root", "_root"), F.col("root").eqNullSafe(F.col("_root"))).select("id", "url", F.when(F.col("simhash").isNull(), F.col("id")).otherwise(F.col("group_id")).alias("group_id"))
