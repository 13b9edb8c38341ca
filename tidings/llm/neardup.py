"""Near-duplicate documents by improved consistent weighted sampling.

A document is the weighted set of its five-word shingles; a shingle weighs its
count in the document times the mean inverse document frequency of its words
over all documents.  (Frequencies of words rather than of whole shingles: in a
large group of near copies a shared shingle is frequent and an edited one rare,
so shingle frequencies would push the group's own members apart.)  Improved
consistent weighted sampling draws ``BANDS * ROWS`` samples whose chance to
agree is the weighted Jaccard similarity.  Documents that agree on a whole band
are candidates; candidates are verified on their texts, and links of similarity
``THRESHOLD`` or more join them to groups.

Equal texts are one class from the start and only its first document goes on.
In each bucket the member with the most company is compared to all others
first; what that leaves in different groups is then compared across groups,
inside tasks that hold two blocks of a bucket each, so only links come out and
no pair is ever a row.  Only pairs that cannot be similar are left out: the
smaller total weight must be ``THRESHOLD`` of the larger, and the similarities
to the bucket's first member may differ by at most 1 - ``THRESHOLD`` (the
distance is a metric).  All others that meet in a bucket are verified, unless
links have already joined them.

Scale: word frequencies go to a table of fixed size (``BUCKETS`` hashed
counts); signatures are made in one pass; buckets, degrees and components are
narrow aggregates with map-side combining; a comparison's first document is
sent to blocks of ``BLOCK`` partners, so a group of any size is spread.

Defined cases: a null text is empty; a document without words is alone but for
equal texts; one of under five words is one shingle; repeated rows and copies
are in one class; a null id sorts first; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, doc_text, read_table, trimmed

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 14, 4
BROADCAST_NODES = 500_000  # of 40 bytes each
BUCKETS = 1 << 18
GROUP, BLOCK, AT_ONCE = 500, 200, 64
NO_ID = -1 << 63
WORD = re.compile(r"\w+")


def document_frequencies(docs: DataFrame):
    """Number of documents, and an array of ``BUCKETS`` counts: in how many
    documents a word of that hash occurs."""
    import numpy as np

    def run(batches):
        from collections import Counter

        import pyarrow as pa
        import xxhash

        n = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            seen: Counter = Counter()
            for text in batch.column(0).to_pylist():
                seen.update(set(WORD.findall(text.lower())))
            at = np.fromiter((xxhash.xxh64_intdigest(w) % BUCKETS for w in seen), np.int64, len(seen))
            np.add.at(n, at, np.fromiter(seen.values(), np.int64, len(seen)))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at])], ["bucket", "n"])

    counts = docs.select("text").mapInArrow(trimmed(run), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    return docs.count(), out


class Shingles:
    """Weighted shingle sets of texts."""

    def __init__(self, documents: int, frequencies):
        import numpy as np

        self.idf = (np.log((documents + 1) / (np.minimum(frequencies, documents) + 1)) + 0.1).astype(np.float32)

    def of(self, texts: list[str]):
        """(sorted shingle hashes, weights) of each text."""
        import numpy as np
        import xxhash

        ids: dict[str, int] = {}
        split = []
        for t in texts:
            words = WORD.findall(t.lower())
            for w in words:
                if w not in ids:
                    ids[w] = len(ids)
            split.append(np.fromiter(map(ids.__getitem__, words), np.int64, len(words)))
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in ids), np.uint64, len(ids))
        weights = self.idf[(hashes % np.uint64(BUCKETS)).astype(np.int64)]
        factors = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)
        for at in split:
            if not len(at):
                yield np.zeros(0, np.uint64), np.zeros(0, np.float32)
                continue
            n = min(SHINGLE, len(at))
            h, w = hashes[at], weights[at].astype(np.float64)
            m = len(at) - n + 1
            s, v = np.zeros(m, np.uint64), np.zeros(m)
            for k in range(n):
                s += h[k:k + m] * factors[k]
                v += w[k:k + m]
            s ^= s >> np.uint64(29)
            s *= np.uint64(0xBF58476D1CE4E5B9)
            s ^= s >> np.uint64(32)
            unique, first, count = np.unique(s, return_index=True, return_counts=True)
            yield unique, (count * v[first] / n).astype(np.float32)


class Sampler:
    """Improved consistent weighted sampling (Ioffe 2010).  A shingle's random
    numbers come from its hash: two gamma variables by quantile tables, one
    uniform."""

    def __init__(self, samples: int = BANDS * ROWS, seed: int = 7):
        import numpy as np

        r = np.random.RandomState(seed)
        self.seeds = r.randint(1, 1 << 32, samples, np.int64).astype(np.uint32)
        grid = np.linspace(0, 40, 400_001)
        cdf = 1 - (1 + grid) * np.exp(-grid)  # gamma with shape 2
        self.gamma = np.interp((np.arange(2048) + 0.5) / 2048, cdf, grid).astype(np.float32)
        self.log_gamma = np.log(self.gamma)

    def __call__(self, shingles, weights):
        """A 64-bit value for each sample: the chosen shingle and its level."""
        import numpy as np

        k = len(self.seeds)
        best, chosen = np.full(k, np.inf, np.float32), np.zeros(k, np.uint64)
        log_w = np.log(weights)
        low, each = np.uint32(2047), np.arange(k)
        for i in range(0, len(shingles), 512):
            s = shingles[i:i + 512]
            u = (s >> np.uint64(32)).astype(np.uint32)[:, None] ^ self.seeds
            u *= np.uint32(0x85EBCA6B)
            u ^= u >> np.uint32(15)
            u *= np.uint32(0xC2B2AE35)
            u ^= u >> np.uint32(16)
            r = self.gamma.take(u & low)
            beta = (u >> np.uint32(22)).astype(np.float32)
            beta *= np.float32(2.0**-10)
            t = log_w[i:i + 512, None] / r
            t += beta
            np.floor(t, out=t)
            beta -= t
            beta -= np.float32(1)
            beta *= r
            beta += self.log_gamma.take((u >> np.uint32(11)) & low)  # the cost: ln c - r (t - beta + 1)
            at = beta.argmin(0)
            least = beta[at, each]
            value = s[at] + t[at, each].astype(np.int64).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
            better = least < best
            best[better], chosen[better] = least[better], value[better]
        return chosen


def similarity(a, b) -> float:
    """Weighted Jaccard similarity of two (sorted hashes, weights)."""
    import numpy as np

    if not len(a[0]) or not len(b[0]):
        return 0.0
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0]
    common = float(np.minimum(a[1][same], b[1][at[same]]).sum(dtype=np.float64))
    return common / (float(a[1].sum(dtype=np.float64)) + float(b[1].sum(dtype=np.float64)) - common)


def similarities_to(a, total: float, others: list, totals):
    """Weighted Jaccard similarity of ``a`` to each of the others."""
    import numpy as np

    keys, weights = np.concatenate([o[0] for o in others]), np.concatenate([o[1] for o in others])
    at = np.searchsorted(a[0], keys)
    at[at == len(a[0])] = 0
    common = np.where(a[0][at] == keys, np.minimum(a[1][at], weights), 0).astype(np.float64)
    common = np.add.reduceat(common, np.cumsum([0, *[len(o[0]) for o in others[:-1]]]))
    return common / (total + totals - common)


def signatures(docs: DataFrame, shingles: Shingles) -> DataFrame:
    """``(doc_id, node, bands, total)``: ``node`` is the text's md5, ``bands`` a
    hash per band (null without words), ``total`` the sum of the weights."""
    sampler = Sampler()

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        tag = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x165667B19E3779F9)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            nodes, bands, totals = [], [], []
            for text, (s, w) in zip(texts, shingles.of(texts), strict=True):
                nodes.append(hashlib.md5(text.encode("utf-8", "surrogatepass")).hexdigest())
                totals.append(float(w.sum(dtype=np.float64)))
                if not len(s):
                    bands.append(None)
                    continue
                chosen = sampler(s, w).reshape(BANDS, ROWS)
                h = tag.copy()
                for j in range(ROWS):
                    h = (h ^ chosen[:, j]) * np.uint64(0xBF58476D1CE4E5B9)
                    h ^= h >> np.uint64(31)
                bands.append(h.astype(np.int64))
            yield pa.RecordBatch.from_arrays([ids, pa.array(nodes, pa.string()), pa.array(bands, pa.list_(pa.int64())), pa.array(totals)], ["doc_id", "node", "bands", "total"])

    return docs.mapInArrow(trimmed(run), "doc_id long, node string, bands array<long>, total double")


def comparable(a: str, b: str, threshold: float):
    """Whether two total weights allow a similarity of the threshold."""
    return F.least(a, b) >= F.greatest(a, b) * (threshold - 1e-6)


def similarities(pairs: DataFrame, texts: DataFrame, shingles: Shingles) -> DataFrame:
    """``(a, b, similarity)`` of the pairs."""
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    partners = pairs.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks").cast("long")).alias("block"))
    firsts = blocks.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks").cast("long") - 1)).alias("block"))
    first = firsts.join(texts.withColumnRenamed("node", "a"), "a").select("a", "block", F.lit("").alias("b"), "text")
    other = partners.join(texts.withColumnRenamed("node", "b"), "b").select("a", "block", "b", "text")

    def run(batches):
        import pyarrow as pa

        key, own = None, None
        for batch in batches:
            out = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("a", "block", "b")), shingles.of(batch.column("text").to_pylist()), strict=True)
            for a, block, b, weighted in rows:
                if not b:
                    key, own = (a, block), weighted
                elif key == (a, block):
                    out.append((a, b, similarity(own, weighted)))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))], ["a", "b", "similarity"])

    return first.unionByName(other).repartition("a", "block").sortWithinPartitions("a", "block", "b").mapInArrow(trimmed(run), "a string, b string, similarity double")


def across(members: DataFrame, texts: DataFrame, shingles: Shingles, threshold: float = THRESHOLD) -> DataFrame:
    """Links ``(a, b, similarity)`` between the groups that meet in a bucket.

    A bucket's members are dealt into blocks of about ``GROUP``, and each pair of
    blocks is one piece of work, so a task holds two blocks.  It looks at a pair
    in the first bucket the two share only, and not at pairs that cannot be
    similar (see above); members that a link has joined are not compared any
    more."""
    block = F.pmod(F.xxhash64("node"), F.col("blocks").cast("long")).cast("int")
    dealt = members.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("bucket", "band", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), (F.col("block") > F.col("other")).alias("second"),
                         "node", "label", "total", "near", "bands").join(texts, "node")

    def links(rows):
        """Of one pair of blocks: (band, low, high, rows of the rest)."""
        import numpy as np

        band, low, high, members = rows
        second = np.array([m[0] for m in members])
        total = np.array([m[3] for m in members])
        near = np.array([np.nan if m[4] is None else m[4] for m in members])
        bands = np.array([m[5] for m in members], np.int64)
        kinds = {x: i for i, x in enumerate(dict.fromkeys(m[2] for m in members))}
        root = np.arange(len(kinds))
        label = np.array([kinds[m[2]] for m in members])
        weighted: dict[int, tuple] = {}

        def of(k):
            if k not in weighted:
                weighted[k] = next(shingles.of([members[k][6]]))
            return weighted[k]

        for i in range(len(members) - 1):
            j = np.arange(i + 1, len(members))
            keep = root[label[j]] != root[label[i]]
            if low != high:
                keep &= second[j] != second[i]
            keep &= np.minimum(total[j], total[i]) >= np.maximum(total[j], total[i]) * (threshold - 1e-6)
            keep &= ~(np.abs(near[j] - near[i]) > 1 - threshold + 1e-6)
            j = j[keep]
            j = j[~(bands[j, :band] == bands[i, :band]).any(1)]
            for at in range(0, len(j), AT_ONCE):
                part = j[at:at + AT_ONCE]
                part = part[root[label[part]] != root[label[i]]]
                if not len(part):
                    continue
                close = similarities_to(of(i), total[i], [of(k) for k in part.tolist()], total[part]) >= threshold - 1e-9
                for k in part[close].tolist():
                    if root[label[k]] != root[label[i]] and (s := similarity(of(i), of(k))) >= threshold:
                        root[root == root[label[k]]] = root[label[i]]
                        yield members[i][1], members[k][1], s

    def run(batches):
        import pyarrow as pa

        key, group = None, []
        names = ("bucket", "low", "high", "band", "second", "node", "label", "total", "near", "bands", "text")

        def done():
            out = list(links((group[0][3], key[1], key[2], [g[4:] for g in group]))) if group else []
            return pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.string(), pa.float64()))], ["a", "b", "similarity"])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if row[:3] != key:
                    yield done()
                    key, group = row[:3], []
                group.append(row)
        yield done()

    return dealt.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "node").mapInArrow(trimmed(run), "a string, b string, similarity double")


def components(edges: DataFrame) -> DataFrame:
    """``(node, label)`` for the nodes of the edges: the least node that can be
    reached, by least labels of neighbours and labels' labels."""
    both = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut_lineage(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), F.col("label").alias("other")), "b").groupBy("a").agg(F.min("other").alias("other"))
        step = cut_lineage(labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("before"), F.least("label", "other").alias("label")))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = cut_lineage(step.join(jump, "label").select("node", "before", F.col("further").alias("label")))
        labels = after.select("node", "label")
        if after.where("before <> label").limit(1).count() == 0:
            return labels


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: ``doc_id``, ``node`` (its text's md5), ``class_id``
    (least id of its equal texts), ``group_id`` (least id of its group) and
    ``first`` (whether its text is the one that stays)."""
    docs = doc_text(docs)
    shingles = Shingles(*document_frequencies(docs))
    signed = cut_lineage(signatures(docs, shingles))
    order = F.coalesce("doc_id", F.lit(NO_ID))
    classes = cut_lineage(signed.groupBy("node").agg(F.min("doc_id").alias("class_id"), F.min(F.struct(order.alias("id"), "bands", "total")).alias("s")).select("node", "class_id", "s.*"))
    cast = classes.where("bands IS NOT NULL").select("node", F.posexplode("bands").alias("band", "bucket"))
    sizes = cut_lineage(cast.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
    shared = cut_lineage(cast.join(sizes, "bucket"))
    company = shared.groupBy("node").agg(F.sum("size").alias("company"))
    members = cut_lineage(shared.join(company.join(classes.select("node", "bands", "total"), "node"), "node"))  # bucket, band, size, node, company, bands, total

    nodes = cut_lineage(company.join(classes, "node").select("node", "id"))
    few = nodes.count() <= BROADCAST_NODES
    texts = docs.select(F.md5("text").alias("node"), order.alias("id"), "text").join(F.broadcast(nodes) if few else nodes, ["node", "id"], "left_semi")
    texts = cut_lineage(texts.drop("id").dropDuplicates(["node"]))

    def compared(found: DataFrame) -> DataFrame:
        """Similarities of distinct pairs (p, node), each in one order."""
        pairs = found.groupBy(F.least("p", "node").alias("low"), F.greatest("p", "node").alias("high")).agg(F.min("p").alias("a"))
        pairs = pairs.select("a", F.when(F.col("a") == F.col("low"), F.col("high")).otherwise(F.col("low")).alias("b"))
        return cut_lineage(similarities(pairs, texts, shingles))

    # first: every bucket's best connected member against all others
    chosen = members.groupBy("bucket").agg(F.max(F.struct("company", "node", "total")).alias("p")).select("bucket", F.col("p.node").alias("p"), F.col("p.total").alias("p_total"))
    chosen = cut_lineage(chosen)
    star = members.join(chosen, "bucket").where((F.col("node") != F.col("p")) & comparable("total", "p_total", threshold)).select("p", "node")
    tested = compared(star)
    links = tested.where(F.col("similarity") >= threshold)
    labels = components(links)
    either = tested.unionByName(tested.select(F.col("b").alias("a"), F.col("a").alias("b"), "similarity")).select(F.col("a").alias("p"), F.col("b").alias("node"), F.col("similarity").alias("near"))
    around = members.join(chosen.select("bucket", "p"), "bucket").join(either, ["p", "node"], "left")
    around = cut_lineage(around.withColumn("near", F.when(F.col("node") == F.col("p"), 1.0).otherwise(F.col("near"))).drop("p"))

    labelled = around.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    split = labelled.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.ceil(F.count("*") / GROUP).cast("int").alias("blocks")).where("x <> y").drop("x", "y")
    open_ = cut_lineage(labelled.join(split, "bucket"))
    if open_.limit(1).count():
        links = links.unionByName(cut_lineage(across(open_, texts, shingles, threshold)))
        labels = components(links)
    group = classes.select("node", "class_id", "id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = group.groupBy("label").agg(F.min(F.struct("id", "node", "class_id")).alias("least"))
    group = group.join(least, "label").select("node", "class_id", F.col("least.class_id").alias("group_id"), (F.col("node") == F.col("least.node")).alias("first_text"))
    rows = signed.select("doc_id", "node").join(group, "node")
    return rows.select("doc_id", "node", "class_id", "group_id", (F.col("first_text") & F.col("doc_id").eqNullSafe(F.col("class_id"))).alias("first"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes and near-duplicate groups of all documents."""
    return near_duplicates(read_table(spark, sf_dir, "documents")).drop("node")
