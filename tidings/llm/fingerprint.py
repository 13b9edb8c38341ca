"""Prefix polynomial hashes as document fingerprints.

A text's code points are hashed into modular prefix arrays.  From two of its
entries the hash of any span follows, so that spans are compared without
reading them, and the longest common extension of two positions is found by
binary search on its length.

A fingerprint is ``<code points>:<hash of the text>:<sketch>``.  The hash is of
the whole text under two moduli (62 bits).  The sketch holds, for ``BINS``
ranges of hash values, 16 bits of the least hash among the spans of ``SPAN``
code points that fall in the range (empty ranges borrow from the next filled
one by a fixed probe order).  Equal texts have equal fingerprints; the share of
agreeing sketch entries estimates the Jaccard similarity of the texts' spans.

Scale: a document meets its successor by one range-partitioned shuffle of the
texts; ranges follow the ids' quantiles, and the first document of a range is
also sent to the range before it.  A long text is hashed in blocks.

Defined cases: a null text is empty; the likeness of two empty texts is 1, of
an empty and another 0; documents of one id follow each other by text; a null
id comes first; with one document alone the successor is the document itself;
an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_text, read_table

MOD_A, BASE_A = 2147483647, 1103515245
MOD_B, BASE_B = 2147483629, 1664525 * 577
SPAN, BINS, BIN_BITS = 16, 128, 7
BLOCK = 1 << 20


class PrefixHash:
    """Modular prefix arrays of a sequence of code points.

    ``prefix[i]`` is the sum of ``(c[j] + 1) * base**j`` for j < i.  A span's
    sum is brought to a common power by ``base**-start``, so equal spans have
    equal hashes wherever they stand."""

    def __init__(self, points, tables: "Powers"):
        import numpy as np

        self.n, self.tables, self.prefix = len(points), tables, []
        tables.grow(self.n + 1)
        c = points.astype(np.uint64) + np.uint64(1)
        for mod, up, _ in tables.kinds:
            sums = np.zeros(self.n + 1, np.uint64)
            carry = 0
            for i in range(0, self.n, BLOCK):  # a block's sum of values below 2**31 fits
                part = np.cumsum(c[i:i + BLOCK] * up[i:i + BLOCK][: len(c[i:i + BLOCK])] % np.uint64(mod)) + np.uint64(carry)
                sums[i + 1:i + 1 + len(part)] = part % np.uint64(mod)
                carry = int(sums[i + len(part)])
            self.prefix.append(sums)

    def spans(self, starts, length):
        """Hashes (62 bits) of the spans of ``length`` from each of ``starts``."""
        import numpy as np

        out = []
        for sums, (mod, _, down) in zip(self.prefix, self.tables.kinds, strict=True):
            m = np.uint64(mod)
            out.append((sums[starts + length] + m - sums[starts]) % m * down[starts] % m)
        return out[0] << np.uint64(31) | out[1]

    def span(self, start: int, length: int) -> int:
        import numpy as np

        return int(self.spans(np.array([start]), length)[0])

    def extension(self, i: int, other: "PrefixHash", j: int) -> int:
        """Length of the longest common extension of position ``i`` here and
        ``j`` in ``other``, by binary search."""
        low, high = 0, min(self.n - i, other.n - j)
        while low < high:
            mid = (low + high + 1) // 2
            if self.span(i, mid) == other.span(j, mid):
                low = mid
            else:
                high = mid - 1
        return low


class Powers:
    """Powers of the bases and of their inverses, grown on demand."""

    def __init__(self):
        import numpy as np

        self.kinds = [(m, np.array([1], np.uint64), np.array([1], np.uint64)) for m in (MOD_A, MOD_B)]
        self.bases = ((BASE_A % MOD_A, pow(BASE_A, -1, MOD_A)), (BASE_B % MOD_B, pow(BASE_B, -1, MOD_B)))

    def grow(self, n: int) -> None:
        import numpy as np

        if len(self.kinds[0][1]) >= n:
            return
        kinds = []
        for (mod, up, down), (base, inverse) in zip(self.kinds, self.bases, strict=True):
            while len(up) < n:
                up = np.concatenate([up, up * np.uint64(pow(base, len(up), mod)) % np.uint64(mod)])
                down = np.concatenate([down, down * np.uint64(pow(inverse, len(down), mod)) % np.uint64(mod)])
            kinds.append((mod, up, down))
        self.kinds = kinds


def mix(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def sketch(hashes):
    """16 bits of the least hash in each of BINS ranges, empty ranges filled."""
    import numpy as np

    h = mix(hashes)
    least = np.full(BINS, np.iinfo(np.uint64).max, np.uint64)
    h.sort()
    ranges = (h >> np.uint64(64 - BIN_BITS)).astype(np.int64)
    at = np.flatnonzero(np.r_[True, ranges[1:] != ranges[:-1]])
    least[ranges[at]] = h[at]
    filled = np.zeros(BINS, bool)
    filled[ranges[at]] = True
    out = (least >> np.uint64(16) & np.uint64(0xFFFF)).astype(np.int64)
    for b in np.flatnonzero(~filled).tolist():
        k = b
        while not filled[k]:  # an odd step meets every range
            k = (k + 2 * b + 1) % BINS
        out[b] = out[k] + b * 40503 & 0xFFFF
    return out


def fingerprint(text: str, tables: "Powers | None" = None) -> str:
    """The fingerprint of a text; an empty text has an empty sketch."""
    import numpy as np

    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    tables = tables or Powers()
    h = PrefixHash(points, tables)
    if not h.n:
        return "0:0:"
    span = min(SPAN, h.n)
    if h.n <= BLOCK:
        s = sketch(h.spans(np.arange(h.n - span + 1), span))
    else:
        hs = [np.sort(np.unique(h.spans(np.arange(i, min(i + BLOCK, h.n - span + 1)), span))) for i in range(0, h.n - span + 1, BLOCK)]
        s = sketch(np.concatenate(hs))
    return f"{h.n}:{h.span(0, h.n):x}:{s.astype('>u2').tobytes().hex()}"


def likeness(a: str, b: str) -> float:
    """Estimated similarity of two texts, from their fingerprints alone."""
    import numpy as np

    if a == b:
        return 1.0
    x, y = (np.frombuffer(bytes.fromhex(s.rsplit(":", 1)[1]), ">u2") for s in (a, b))
    if not len(x) or not len(y):
        return 0.0
    return float(np.mean(x == y))


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of the next
    document (or all of that)."""
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_successors(docs: DataFrame, ranges: int) -> DataFrame:
    """Rows ``(part, extra, k, doc_id, text)``: all documents by range of ids,
    and each range's first document once more as the ``extra`` last row of the
    range before (cyclically).  ``ranges`` bounds what reaches the driver."""
    spark = docs.sparkSession
    k = F.coalesce("doc_id", F.lit(-1 << 63))
    ids = docs.select(k.alias("k"))
    cuts = ids.agg(F.percentile_approx("k", [i / ranges for i in range(1, ranges)], 10 * ranges)).first()[0] or [0]
    bounds = F.array(*[F.lit(c).cast("long") for c in sorted(set(cuts))])
    part = F.size(F.filter(bounds, lambda c: c <= F.col("k")))
    firsts = sorted(map(tuple, ids.groupBy(part.alias("part")).agg(F.min("k")).collect()))
    before = spark.createDataFrame([(p, first, firsts[i - 1][0]) for i, (p, first) in enumerate(firsts)], "part int, first long, before int")
    rows = docs.withColumn("k", k).withColumn("part", part).join(F.broadcast(before), "part")
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("extra"))
    copy = F.struct(F.col("before").alias("part"), F.lit(True).alias("extra"))
    to = F.when(F.col("k") == F.col("first"), F.array(own, copy)).otherwise(F.array(own))
    return rows.select(F.explode(to).alias("to"), "k", "doc_id", "text").select("to.part", "to.extra", "k", "doc_id", "text")


def fingerprint_documents(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """Each document's fingerprint, its edited text's, and the likeness of the
    document to that text and to the next document."""
    spark = docs.sparkSession
    ranges = min(4096, max(2, ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))))

    def run(batches):
        import hashlib

        import pyarrow as pa

        tables, names = Powers(), [x.split()[0] for x in SCHEMA.split(", ")]
        last, done = None, None  # last: (part, doc_id, text, fingerprint); done: part whose extra row was met

        def row(here, text, mark):
            _, doc, own, own_mark = here
            new = edited(own, text)
            new_mark = fingerprint(new, tables)
            return (doc, len(own), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own_mark, new_mark, likeness(own_mark, new_mark), likeness(own_mark, mark))

        for batch in batches:
            found = []
            for part, extra, doc, text in zip(*(batch.column(c).to_pylist() for c in ("part", "extra", "doc_id", "text")), strict=True):
                if extra and done == part:
                    continue
                mark = fingerprint(text, tables)
                if last is not None:
                    found.append(row(last, text, mark))
                last = None if extra else (part, doc, text, mark)
                done = part if extra else done
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) if i else pa.array(c, pa.int64()) for i, c in enumerate(zip(*found, strict=True))], names)

    rows = with_successors(doc_text(docs), ranges).repartitionById(ranges, "part").sortWithinPartitions("part", "extra", "k", "text")
    return rows.mapInArrow(run, SCHEMA)


def op6_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return fingerprint_documents(read_table(spark, sf_dir, "documents"))
