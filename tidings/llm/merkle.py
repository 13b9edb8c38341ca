"""Merkle manifest of a dataset with incremental witnesses.

Each row's leaf is a hash of its fields.  The leaves of a ``lang``, in order of
``doc_id``, are the leaves of a binary tree; the trees' roots, in order of
``lang``, those of one more, whose root stands for the dataset.  A witness is the
list of siblings that lead from a leaf to a root.

``Appender`` takes nodes one after the other.  It holds the open subtrees, one a
height at most, as a binary counter does; a subtree keeps the partial witnesses
of its leaves.  When the sibling of an open subtree is complete, the two become
one: either one's root is added to the witnesses of the other's leaves.

Leaves are numbered within their tree and cut into aligned blocks of ``2 **
BLOCK_BITS``.  A task streams through the sorted leaves of its blocks; each gives
its leaves' partial witnesses and one root.  The roots are the nodes of the next
round, further appends to the same tree, until a tree has one node.  Last,
every round's witnesses are extended by those of the block's root, from the top
down.  The trees' roots go through the same rounds.

Scale: leaves are numbered by a range partitioning on (lang, doc_id, leaf) with
one count per range and tree, and shuffled once more by block, as rows of some
150 bytes; texts are read once and never shuffled.  A block's memory is its
nodes times ``BLOCK_BITS`` digests.  There is a round per ``BLOCK_BITS`` doublings
of the largest tree.

Defined cases: null fields have a leaf of their own (``-``); a null id comes
first and is never tampered with; rows of equal ids follow each other in order
of their leaves; a null lang is a tree of its own, the first; the witness of a
single leaf is empty; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, read_table

BLOCK_BITS = 10
SMALL_ROWS = 100_000


def leaf(n_chars: Column) -> Column:
    """Digest of a row's fields, binary."""
    fields = [F.col("doc_id").cast("string"), F.col("source").cast("string"), F.col("lang").cast("string"), n_chars.cast("string"), F.col("text")]
    parts = [F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in fields]
    return F.unhex(F.sha2(F.concat(*parts), 256))


def small(df: DataFrame) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``SMALL_ROWS`` rows."""
    return F.broadcast(df) if df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else df


def parent(*children: bytes) -> bytes:
    """Digest of the hex digits of one or two digests."""
    from hashlib import sha256

    return sha256("".join(c.hex() for c in children).encode()).digest()


class Appender:
    """An open binary tree: nodes are appended in order, and every leaf's
    witness grows as the subtrees around it become complete."""

    def __init__(self):
        self.open: list[tuple[int, bytes, list[bytearray]]] = []  # (height, root, witnesses), highest first
        self.witnesses: list[bytearray] = []

    @staticmethod
    def _join(left, right):
        height, a, of_a = left
        _, b, of_b = right
        for w in of_a:
            w += b
        for w in of_b:
            w += a
        return height + 1, parent(a, b), of_a + of_b

    def append(self, digest: bytes) -> None:
        witness = bytearray()
        self.witnesses.append(witness)
        tree = (0, digest, [witness])
        while self.open and self.open[-1][0] == tree[0]:
            tree = self._join(self.open.pop(), tree)
        self.open.append(tree)

    def close(self, height: int | None = None) -> bytes:
        """The root: of the height given, or where one node remains.  A node
        without a sibling goes up alone."""
        while len(self.open) > 1 or (height is not None and self.open[0][0] < height):
            h, root, witnesses = self.open.pop()
            if self.open and self.open[-1][0] == h:
                tree = self._join(self.open.pop(), (h, root, witnesses))
            else:
                tree = (h + 1, parent(root), witnesses)
            self.open.append(tree)
        return self.open[0][1]


def fold(digest: bytes, witness: bytes, position: int, count: int) -> bytes:
    """The root that a leaf and its siblings give, in a tree of ``count``."""
    at = 0
    while count > 1:
        if position % 2:
            digest, at = parent(witness[at:at + 32], digest), at + 32
        elif position + 1 < count:
            digest, at = parent(digest, witness[at:at + 32]), at + 32
        else:
            digest = parent(digest)
        position, count = position // 2, (count + 1) // 2
    return digest


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` (a null ``tree`` counts as a value) with ``position``, from 0 in
    their tree, and ``nodes``, the tree's size; sorted by ``order`` inside it."""
    sorted_rows = rows.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order)
    placed = cut_lineage(sorted_rows.withColumn("id", F.monotonically_increasing_id()))
    placed = placed.withColumn("range", F.shiftright("id", 33)).withColumn("id", F.col("id").bitwiseAND((1 << 33) - 1))
    counts = placed.groupBy("range", F.col(tree).alias("of")).agg(F.count("*").alias("n"), F.min("id").alias("first"))
    before = F.sum("n").over(Window.partitionBy("of").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("range", "of", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("start"), F.sum("n").over(Window.partitionBy("of")).alias("nodes"))
    starts = cut_lineage(starts).withColumnRenamed("range", "in")
    met = placed.join(small(starts), (F.col("range") == F.col("in")) & F.col(tree).eqNullSafe(F.col("of")))
    return met.withColumn("position", F.col("id") + F.col("start")).drop("id", "range", "in", "of", "start")


def round_of(nodes: DataFrame, bits: int) -> DataFrame:
    """One round over ``(tree, position, nodes, digest)``: each node's partial
    witness ``(tree, position, witness)``, and for each block a row without a
    witness, ``position`` the block's and ``digest`` its root."""

    def run(batches):
        import pyarrow as pa

        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

        def closed(key, appender, size, first):
            root = appender.close(None if size <= 1 << bits else bits)
            rows = [(key[0], first + i, size, None, bytes(w)) for i, w in enumerate(appender.witnesses)]
            rows.append((*key, size, root, None))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["tree", "position", "nodes", "digest", "witness"])

        key = None
        for batch in batches:
            for tree, position, size, digest in zip(*(batch.column(c).to_pylist() for c in ("tree", "position", "nodes", "digest")), strict=True):
                if key != (tree, position >> bits):
                    if key is not None:
                        yield closed(key, appender, of, first)
                    key, appender, of, first = (tree, position >> bits), Appender(), size, position
                appender.append(digest)
        if key is not None:
            yield closed(key, appender, of, first)

    blocks = nodes.select("tree", "position", "nodes", "digest").repartition("tree", F.shiftright("position", bits)).sortWithinPartitions("tree", "position")
    return cut_lineage(blocks.mapInArrow(run, "tree long, position long, nodes long, digest binary, witness binary"))


def witnesses(leaves: DataFrame, bits: int = BLOCK_BITS) -> tuple[DataFrame, DataFrame]:
    """All leaves ``(tree, position, witness)`` with their whole witnesses, and
    the roots ``(tree, root)``; ``leaves`` has ``(tree, position, nodes,
    digest)``."""
    rounds, nodes, roots = [], leaves, []
    most = leaves.agg(F.max("nodes")).first()[0] or 0
    while True:
        done = round_of(nodes, bits)
        rounds.append(done.where(F.col("digest").isNull()).select("tree", "position", "witness"))
        last = F.col("nodes") <= 1 << bits
        found = done.where(F.col("digest").isNotNull())
        roots.append(found.where(last).select("tree", F.col("digest").alias("root")))
        if most <= 1 << bits:
            break
        most = -(-most // (1 << bits))
        nodes = found.where(~last).withColumn("nodes", F.ceil(F.col("nodes") / (1 << bits)).cast("long"))
    whole = rounds.pop()
    while rounds:
        above = small(whole.select("tree", F.col("position").alias("block"), F.col("witness").alias("rest")))
        lower = rounds.pop().withColumn("block", F.shiftright("position", bits))
        whole = lower.join(above, ["tree", "block"], "left").select("tree", "position", F.concat("witness", F.coalesce("rest", F.lit(b""))).alias("witness"))
    every = roots[0]
    for more in roots[1:]:
        every = every.unionByName(more)
    return whole, every


def manifest(docs: DataFrame, tampered: Column | None = None, bits: int = BLOCK_BITS) -> DataFrame:
    """Per row ``(doc_id, lang, leaf, subroot, root, witness, folded_root)``,
    digests in binary: the witness up to the root, and the root to which the
    leaf folds (that of the row with one more in ``n_chars``, where ``tampered``
    holds)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", F.col("n_chars").cast("long").alias("n_chars"), "text")
    changed = leaf(F.col("n_chars").cast("decimal(20,0)") + 1)
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), leaf(F.col("n_chars")).alias("leaf"),
                       (F.when(tampered, changed) if tampered is not None else F.lit(None).cast("binary")).alias("changed"))
    rows = numbered(cut_lineage(rows), "lang", ["doc_id", "leaf"])
    langs = numbered(rows.groupBy("lang").agg(F.max("nodes").alias("leaves")).withColumn("all", F.lit(0)), "all", ["lang"])
    langs = cut_lineage(langs.select("lang", "leaves", F.col("position").alias("tree"), F.col("nodes").alias("trees")))
    known = small(langs.select(F.col("lang").alias("of"), "tree", "trees"))
    rows = cut_lineage(rows.join(known, F.col("lang").eqNullSafe(F.col("of"))).drop("of"))
    inner, subroots = witnesses(rows.select("tree", "position", "nodes", F.col("leaf").alias("digest")), bits)
    subroots = cut_lineage(subroots)
    top = subroots.join(langs.select("tree", "trees"), "tree").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("position"), F.col("trees").alias("nodes"), F.col("root").alias("digest"))
    outer, root = witnesses(top, bits)
    above = outer.select(F.col("position").alias("tree"), F.col("witness").alias("rest")).join(subroots.withColumnRenamed("root", "subroot"), "tree")
    above = cut_lineage(above.withColumn("root", root.select("root").scalar()))
    met = rows.join(inner, ["tree", "position"]).join(small(above), "tree")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("leaf", "changed", "position", "nodes", "witness", "tree", "trees", "rest")]
            folded = [fold(fold(changed or leaf, witness, position, nodes), rest, tree, trees) for leaf, changed, position, nodes, witness, tree, trees, rest in zip(*columns, strict=True)]
            whole = [w + r for w, r in zip(columns[4], columns[7], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "lang", "leaf", "subroot", "root")), pa.array(whole, pa.binary()), pa.array(folded, pa.binary())],
                                             ["doc_id", "lang", "leaf", "subroot", "root", "witness", "folded_root"])

    return met.select("doc_id", "lang", "leaf", "changed", "position", "nodes", "witness", "tree", "trees", "rest", "subroot", "root").mapInArrow(
        run, "doc_id long, lang string, leaf binary, subroot binary, root binary, witness binary, folded_root binary")


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Witnesses of all documents, checked against the root after a change of
    every seventh checksum's ``n_chars``."""
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    found = manifest(read_table(spark, sf_dir, "documents"), tampered)
    text = lambda c: F.lower(F.hex(c))
    return found.select("doc_id", text("leaf").alias("leaf"), text("subroot").alias("subroot"), text("root").alias("root"),
                        F.sha2(text("witness").cast("binary"), 256).alias("proof_sha256"), text("folded_root").alias("folded_root"), (F.col("folded_root") == F.col("root")).alias("verified"))


SQL = """
WITH RECURSIVE steps(byte, k, c) AS (
  SELECT b, 0, b FROM range(256) r(b)
  UNION ALL
  SELECT byte, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM steps WHERE k < 8
), bytes AS (SELECT byte, c AS value FROM steps WHERE k = 8
), crc(id, digits, k, c) AS (
  SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR), 0, CAST(4294967295 AS BIGINT) FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT id, digits, k + 1, xor(c // 256, value) FROM crc JOIN bytes ON byte = xor(c, ascii(substr(digits, k + 1, 1))) % 256 WHERE k < length(digits)
), tampered AS (SELECT id FROM crc WHERE k = length(digits) AND xor(c, 4294967295) % 7 = 0
), fields AS (
  SELECT doc_id, lang, n_chars IS NOT NULL AND doc_id IN (SELECT id FROM tampered) AS changed,
    coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
    coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS chars, strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1) AS more,
    coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents
), hashed AS (
  SELECT doc_id, sha256(head || chars || tail) AS leaf, sha256(head || CASE WHEN changed THEN more ELSE chars END || tail) AS given, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree
  FROM fields
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM hashed
), nodes(tree, l, pos, h) AS (
  SELECT tree, 0, pos, leaf FROM leaves
  UNION ALL
  SELECT tree, l + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos))
  FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM nodes) WHERE n > 1 GROUP BY tree, l, pos // 2
), subroots AS (SELECT tree, max(l) AS height, arg_max(h, l) AS subroot FROM nodes GROUP BY tree
), above(l, pos, h) AS (
  SELECT 0, tree, subroot FROM subroots
  UNION ALL
  SELECT l + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM (SELECT *, count(*) OVER () AS n FROM above) WHERE n > 1 GROUP BY l, pos // 2
), top AS (SELECT max(l) AS height, arg_max(h, l) AS root FROM above
), folded(tree, place, pos, l, h, proof) AS (
  SELECT tree, pos, pos, 0, given, '' FROM leaves
  UNION ALL
  SELECT f.tree, f.place, f.pos // 2, f.l + 1,
         sha256(CASE WHEN s.h IS NULL THEN f.h WHEN f.pos % 2 = 1 THEN s.h || f.h ELSE f.h || s.h END), f.proof || coalesce(s.h, '')
  FROM folded f JOIN subroots r ON r.tree = f.tree AND f.l < r.height
  LEFT JOIN nodes s ON s.tree = f.tree AND s.l = f.l AND s.pos = xor(f.pos, 1)
), whole(tree, place, pos, l, h, proof) AS (
  SELECT f.tree, f.place, f.tree, 0, f.h, f.proof FROM folded f JOIN subroots r ON r.tree = f.tree AND f.l = r.height
  UNION ALL
  SELECT f.tree, f.place, f.pos // 2, f.l + 1,
         sha256(CASE WHEN s.h IS NULL THEN f.h WHEN f.pos % 2 = 1 THEN s.h || f.h ELSE f.h || s.h END), f.proof || coalesce(s.h, '')
  FROM whole f JOIN top t ON f.l < t.height
  LEFT JOIN above s ON s.l = f.l AND s.pos = xor(f.pos, 1)
)
SELECT doc_id, leaf, subroot, root, sha256(w.proof) AS proof_sha256, w.h AS folded_root, w.h = root AS verified
FROM leaves d JOIN subroots USING (tree) JOIN top ON true JOIN whole w ON w.tree = d.tree AND w.place = d.pos AND w.l = top.height
"""
