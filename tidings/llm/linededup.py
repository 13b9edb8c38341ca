"""Line deduplication by sorted hashes.

A line's key is the line stripped and lower-cased (A-Z).  Every document sends,
for each distinct key that is long enough, the key's 128-bit hash, the
document and the numbers of the lines that have it; never the text.  These rows
are range-partitioned and sorted by (hash, document descending, text), so a
stream over a range meets a key's documents one after the other, the one that
keeps the line first, and needs to remember two of them: the lines of the
second are let go or dropped when a third document is met or the key ends.

A key that lies on a range's edge (a frequent line covers many whole ranges)
can't be decided inside it.  The stream marks its rows as open and adds one row
per such key with what the range knows of it: documents, first and last.  These
rows, at most two a range besides keys with ``HOLD`` lines under one id, are
summed and joined back to the open rows.

The numbers of the dropped lines are gathered per document into a keep bitmap,
deflated.  ``line_bitmaps`` returns these, ``apply_bitmaps`` the texts that they
leave.  Two lines are taken as equal by the 128 bits alone.

Scale: rows of some 50 bytes a line are shuffled once, bitmaps and texts once for
the join (bitmaps are broadcast where Spark finds them small).  Ranges are cut
on hash, document and text together, so no key has to be in one task.

Defined cases: a document is an id; rows of equal ids count once, and all of
them keep a line if that id is the largest; a null id is the smallest; a null
or empty text has one empty line; lines under ``chars`` code points stay; a
text may lose all lines and is empty then; repeated rows get equal results;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, doc_text, read_table

CHARS, DOCUMENTS = 20, 3
HOLD = 100_000
NO_ID = -1 << 63
BLANK = b" \t\n\x0b\x0c\r"
DROP, OPEN, EDGE = 0, 1, 2

PLACES = "h1 long, h2 long, doc long, version long, n_lines int, places binary"
MARKS = "kind int, h1 long, h2 long, doc long, version long, n_lines int, places binary, docs long, last long, part int"


def keyed(docs: DataFrame) -> DataFrame:
    """``doc_text`` with the id and text hash by which rows are told apart."""
    rows = doc_text(docs)
    return rows.select("doc_id", "text", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), F.xxhash64("text").alias("version"))


def line_keys(text: str, chars: int) -> tuple[int, dict[bytes, list[int]]]:
    """Number of lines, and the keys of at least ``chars`` code points with the
    numbers of their lines."""
    lower = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    found: dict[bytes, list[int]] = {}
    lines = text.encode("utf-8", "surrogatepass").translate(lower).split(b"\n")
    for i, line in enumerate(lines):
        key = line.strip(BLANK)
        if len(key) >= chars and (len(key) >= 4 * chars or key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= chars):
            found.setdefault(key, []).append(i)
    return len(lines), found


def line_places(docs: DataFrame, chars: int = CHARS) -> DataFrame:
    """One row per document and distinct key."""

    def run(batches):
        import struct
        from array import array

        import pyarrow as pa
        import xxhash

        schema = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64()), ("version", pa.int64()), ("n_lines", pa.int32()), ("places", pa.binary())])
        out = []
        for batch in batches:
            for doc, version, text in zip(*(batch.column(c).to_pylist() for c in ("doc", "version", "text")), strict=True):
                n, found = line_keys(text, chars)
                for key, at in found.items():
                    out.append((*struct.unpack("<qq", xxhash.xxh3_128_digest(key)), doc, version, n, array("I", at).tobytes()))
                    if len(out) == 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                        out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return keyed(docs).select("doc", "version", "text").mapInArrow(run, PLACES)


def stream_marks(rows, documents: int = DOCUMENTS, hold: int = HOLD):
    """Marks of one range's sorted rows ``(h1, h2, doc, version, n_lines,
    places)``, as tuples of ``MARKS`` without the range's number."""
    key, opening, docs, first, last, held, over = None, True, 0, 0, 0, [], False

    def ended(final):
        if key is not None and (opening or over or final):
            yield (EDGE, *key, first, None, None, None, docs, last)
        if final:
            yield from ((OPEN, *key, *row, None, None) for row in held)

    for h1, h2, *row in rows:
        doc = row[0]
        if key != (h1, h2):
            yield from ended(False)
            opening = key is None
            key, docs, first, last, held, over = (h1, h2), 1, doc, doc, [], False
        elif doc != last:
            docs, last = docs + 1, doc
            if docs == documents:
                yield from ((DROP, *key, *x, None, None) for x in held)
                held = []
        if opening or (over and 1 < docs < documents):
            yield (OPEN, *key, *row, None, None)
        elif docs > 1 and docs >= documents:
            yield (DROP, *key, *row, None, None)
        elif docs > 1:
            held.append(row)
            if len(held) > hold:
                yield from ((OPEN, *key, *x, None, None) for x in held)
                held, over = [], True
    if key is not None:
        yield from ended(True)


def line_bitmaps(docs: DataFrame, chars: int = CHARS, documents: int = DOCUMENTS, hold: int = HOLD) -> DataFrame:
    """``(doc, version, n_lines, n_dropped, keep)`` of the documents that lose
    lines; ``keep`` is a deflated bitmap, the first line in the highest bit."""
    places = cut_lineage(line_places(docs, chars))
    order = [F.col("h1"), F.col("h2"), F.desc("doc"), F.col("version")]

    def run(batches):
        from itertools import islice

        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        types = [pa.int32(), *[pa.int64()] * 4, pa.int32(), pa.binary(), pa.int64(), pa.int64()]
        names = [x.split()[0] for x in MARKS.split(", ")]
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        marks = stream_marks(rows, documents, hold)
        while some := list(islice(marks, 20_000)):
            columns = [pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(some), pa.int32())], names)

    marks = cut_lineage(places.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, MARKS))
    # a key's ranges in order; a document cut by a range's edge counts once
    along = Window.partitionBy("h1", "h2").orderBy("part")
    edges = marks.where(F.col("kind") == EDGE).withColumn("again", F.coalesce((F.lag("last").over(along) == F.col("doc")).cast("long"), F.lit(0)))
    totals = edges.groupBy("h1", "h2").agg((F.sum("docs") - F.sum("again")).alias("total"), F.max("doc").alias("keeper"))
    opened = marks.where(F.col("kind") == OPEN).join(totals, ["h1", "h2"]).where((F.col("total") >= documents) & (F.col("doc") < F.col("keeper")))
    wanted = ["doc", "version", "n_lines", "places"]
    dropped = marks.where(F.col("kind") == DROP).select(wanted).unionByName(opened.select(wanted))
    gathered = dropped.groupBy("doc", "version").agg(F.max("n_lines").alias("n_lines"), F.collect_set("places").alias("places"))

    def bitmaps(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n_dropped, keep = [], []
            for n, places in zip(batch.column("n_lines").to_pylist(), batch.column("places").to_pylist(), strict=True):
                bits = np.ones(n, np.uint8)
                bits[np.frombuffer(b"".join(places), np.uint32)] = 0
                n_dropped.append(n - int(bits.sum()))
                keep.append(zlib.compress(np.packbits(bits).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("version"), batch.column("n_lines"), pa.array(n_dropped, pa.int32()), pa.array(keep, pa.binary())], ["doc", "version", "n_lines", "n_dropped", "keep"])

    return gathered.mapInArrow(bitmaps, "doc long, version long, n_lines int, n_dropped int, keep binary")


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``(doc_id, n_lines, n_dropped, text)``: the documents as the bitmaps
    leave them."""

    def run(batches):
        import zlib
        from itertools import compress

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            for text, dropped, keep in zip(*(batch.column(c).to_pylist() for c in ("text", "n_dropped", "keep")), strict=True):
                n = text.count("\n") + 1
                if keep is not None:
                    text = "\n".join(compress(text.split("\n"), np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8), count=n)))
                n_lines.append(n)
                n_dropped.append(dropped or 0)
                kept.append(text)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_lines", "n_dropped", "text"])

    met = keyed(docs).join(bitmaps.select("doc", "version", "n_dropped", "keep"), ["doc", "version"], "left")
    return met.select("doc_id", "text", "n_dropped", "keep").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, text string")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that a document of larger id keeps."""
    docs = read_table(spark, sf_dir, "documents")
    return apply_bitmaps(docs, line_bitmaps(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = """
WITH lines AS (
  SELECT doc_id, line, n, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS n
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), spread AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT doc_id, n, line, coalesce(doc_id < keeper, false) AS dropped FROM lines LEFT JOIN spread USING (k)
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CAST(dropped AS INT)) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
