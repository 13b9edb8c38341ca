"""Ranked lexical search by range maxima over posting lists.

``build_index`` writes segments: the posting lists (document, occurrences) of the
queries' terms over a bounded number of postings, documents in order of ids.
With the corpus counts known, a posting's impact is its part of a document's
score, a whole number.  A segment in memory gets a sparse table per posting list,
which answers where the largest impact between two places of the list is, in
two look-ups.

A query starts with the interval of all the segment's documents.  The largest
impacts of its terms in an interval, summed, bound every score inside.  The
intervals of the highest bounds are taken first and split at the document that
holds the largest of these impacts: it is scored, and what lies before and
after it become intervals of their own.  An interval goes when its bound, or
with an equal bound its first document, can't come before the k-th result.

The search runs twice.  The first, short run scores a bounded number of split
documents per query and segment; the k-th best of these over all segments
comes before or is the true k-th result, so the second run, which is complete,
starts from it everywhere.

Scale: texts are read once per block of ``QUERY_BYTES`` of queries, which is what
a task gets by broadcast; postings of other terms are not kept.  A segment has
at most ``POSTINGS`` postings (a document more), and a task one segment at a time.
What is sent on is ``k`` rows a query and segment at most; nothing is grouped by
term, so a term in every document is no hot key.

Defined cases: a null or empty text, or one without terms, is no document and
no query; rows of equal ids are documents of their own, as are queries; a null
id comes first; a query whose terms no document has gets no rows; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut_lineage, doc_text, read_table

TOP = 20
POSTINGS = 1 << 19
QUERY_BYTES = 4 << 20
WAVE, PROBES = 32, 64
NO_ID = -1 << 63

INDEX = "documents long, words long, docs binary, lengths binary, terms array<int>, counts array<int>, places binary, times binary"


def term_table() -> bytes:
    """What becomes of a byte: letters and digits, A-Z lower-cased, bytes of
    other code points; all else stands between terms."""
    return bytes(ord(chr(b).lower()) if b < 128 and chr(b).isalnum() else b if b >= 128 else 32 for b in range(256))


def text_terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(term_table()).split(b" ")


class Segment:
    """Posting lists one after the other, sorted by (term, document), with
    impacts and the sparse tables over them."""

    def __init__(self, docs, slots, counts, places, impacts):
        import numpy as np

        self.docs, self.impacts = docs, impacts
        ends = np.cumsum(counts)
        self.list_of = {t: i for i, t in enumerate(slots)}
        self.starts, self.ends = ends - counts, ends
        self.keys = np.repeat(np.arange(len(counts), dtype=np.int64), counts) * (len(docs) + 1) + places
        self.places = places
        levels, best = [np.arange(len(places), dtype=np.int32)], np.arange(len(places), dtype=np.int32)
        for j in range(int(max(counts, default=1)).bit_length() - 1):
            right = np.minimum(np.arange(len(places)) + (1 << j), len(places) - 1)
            best = np.where(impacts[best[right]] > impacts[best], best[right], best).astype(np.int32)
            levels.append(best)
        self.tables = np.stack(levels)

    def largest(self, low, high):
        """Where the (first) largest impact in ``[low, high)`` is, elementwise,
        and that impact; 0 where the range is empty."""
        import numpy as np

        empty = high <= low
        length = np.where(empty, 1, high - low)
        level = np.frexp(length)[1] - 1  # floor of the binary logarithm
        low = np.minimum(low, len(self.impacts) - 1)
        left, right = self.tables[level, low], self.tables[level, np.where(empty, low, high - (1 << level))]
        at = np.where(self.impacts[right] > self.impacts[left], right, left)
        return at, np.where(empty, 0, self.impacts[at])

    def search(self, query: dict[int, int], k: int, floor=None, probes: int | None = None):
        """The best ``(score, document's place)`` of at most ``k`` documents for
        ``query``, a dict from terms to how often they count.  ``floor``, a pair
        (score, id): nothing after it is wanted.  ``probes``: split at most so
        many documents."""
        import heapq

        import numpy as np

        known = [(self.list_of[t], q) for t, q in query.items() if t in self.list_of]
        if not known:
            return []
        lists, times = (np.array(x, np.int64) for x in zip(*known, strict=True))
        base = lists * (len(self.docs) + 1)
        found: list[tuple[int, int]] = []  # a heap of (score, -place): the worst first
        floor_score, floor_doc = floor or (1, None)

        def bounded(low, high, first):
            """Intervals with bounds and split documents, those that can't
            matter left out."""
            at, impact = self.largest(low, high)
            impact *= times
            bound = impact.sum(axis=1)
            stay = bound >= worst[0]
            stay &= (bound > worst[0]) | (first <= worst[1])
            if not stay.all():
                low, high, first, at, impact, bound = (x[stay] for x in (low, high, first, at, impact, bound))
            split = self.places[at[np.arange(len(at)), impact.argmax(axis=1)]] if len(at) else first
            return low, high, first, split, bound

        last = len(self.docs) if floor_doc is None else int(np.searchsorted(self.docs, floor_doc, side="right")) - 1
        worst = (floor_score, last)  # a document must have more, or as much at this place or before
        open_ = bounded(self.starts[lists][None, :], self.ends[lists][None, :], np.zeros(1, np.int64))
        done = 0
        while len(open_[0]) and (probes is None or done < probes):
            low, high, first, split, bound = open_
            if len(bound) > WAVE:
                order = np.argsort(-bound, kind="stable")
                now, later = order[:WAVE], order[WAVE:]
            else:
                now, later = np.arange(len(bound)), np.arange(0)
            low_, high_, first_, split_ = low[now], high[now], first[now], split[now]
            at = np.searchsorted(self.keys, base[None, :] + split_[:, None])
            hit = (at < high_) & (self.places[np.minimum(at, len(self.places) - 1)] == split_[:, None])
            scores = (np.where(hit, self.impacts[np.minimum(at, len(self.places) - 1)], 0) * times).sum(axis=1)
            done += len(now)
            for score, place in zip(scores.tolist(), split_.tolist(), strict=True):
                if score > worst[0] or (score == worst[0] and place <= worst[1]):
                    heapq.heappush(found, (score, -place))
                    if len(found) > k:
                        heapq.heappop(found)
                    if len(found) == k:
                        worst = max(worst, (found[0][0], -found[0][1]), key=lambda w: (w[0], -w[1]))
            new = bounded(np.concatenate([low_, at + hit]), np.concatenate([at, high_]), np.concatenate([first_, split_ + 1]))
            stay = (bound[later] > worst[0]) | ((bound[later] == worst[0]) & (first[later] <= worst[1]))
            later = later[stay]
            open_ = tuple(np.concatenate([x[later], y]) for x, y in zip(open_, new, strict=True))
        return [(score, -place) for score, place in found]


def build_index(docs: DataFrame, vocabulary: dict[bytes, int], postings: int = POSTINGS) -> DataFrame:
    """Segments of the documents' postings of the terms in ``vocabulary``, a
    table written in the shared folder."""

    def run(batches):
        from collections import Counter

        import numpy as np
        import pyarrow as pa

        def segment(documents, words, held):
            held.sort(key=lambda x: x[0])
            sizes = np.array([len(x[2]) for x in held], np.int64)
            terms = np.concatenate([x[2] for x in held] or [np.zeros(0, np.int32)])
            times = np.concatenate([x[3] for x in held] or [np.zeros(0, np.int32)])
            places = np.repeat(np.arange(len(held), dtype=np.int32), sizes)
            order = np.argsort(terms, kind="stable")
            slots, counts = np.unique(terms, return_counts=True)
            row = [documents, words, np.array([x[0] for x in held], np.int64).tobytes(), np.array([x[1] for x in held], np.int64).tobytes(),
                   slots.tolist(), counts.tolist(), places[order].tobytes(), times[order].tobytes()]
            types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], [x.split()[0] for x in INDEX.split(", ")])

        number = vocabulary.get
        documents, words, held, size = 0, 0, [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = Counter(text_terms(text))
                n = found.total() - found.pop(b"", 0)
                if not n:
                    continue
                documents, words = documents + 1, words + n
                known = [(t, c) for w, c in found.items() if (t := number(w)) is not None]
                if known:
                    t, c = zip(*known, strict=True)
                    held.append((doc, n, np.array(t, np.int32), np.array(c, np.int32)))
                    size += len(known)
                if size >= postings:
                    yield segment(documents, words, held)
                    documents, words, held, size = 0, 0, [], 0
        if documents:
            yield segment(documents, words, held)

    rows = doc_text(docs).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), "text")
    return cut_lineage(rows.mapInArrow(run, INDEX))


def corpus_counts(index: DataFrame) -> tuple[int, int, dict[int, int]]:
    """Documents, words, and each term's documents."""
    total = index.agg(F.sum("documents"), F.sum("words")).first()
    pairs = index.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("n"))
    return total[0] or 0, total[1] or 0, {r["terms"]: r["n"] for r in pairs.collect()}


def searched(index: DataFrame, queries: list[dict[int, int]], counts, k: int, floors: dict[int, tuple[int, int]], probes: int | None) -> DataFrame:
    """Each segment's ``(query, doc, score)``; see ``Segment.search``."""
    documents, words, df = counts

    def run(batches):
        import math

        import numpy as np
        import pyarrow as pa

        weights = {t: math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for t, n in df.items()}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i] for c in ("docs", "lengths", "terms", "counts", "places", "times")}
                ids, lengths = (np.frombuffer(row[c].as_buffer(), np.int64) for c in ("docs", "lengths"))
                places, times = (np.frombuffer(row[c].as_buffer(), np.int32) for c in ("places", "times"))
                slots, sizes = row["terms"].as_py(), np.array(row["counts"].as_py(), np.int64)
                if not slots:
                    continue
                norm = 75 + 25 * lengths * documents // words
                weight = np.repeat(np.array([weights[t] for t in slots], np.int64), sizes)
                times = times.astype(np.int64)
                segment = Segment(ids, slots, sizes, places, weight * (1_000_000_000 * times // (1000 * times + 12 * norm[places])))
                out = [(q, int(ids[at]), score) for q, query in enumerate(queries) for score, at in segment.search(query, k, floors.get(q), probes)]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["query", "doc", "score"])

    return index.mapInArrow(run, "query int, doc long, score long")


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best of each query's rows."""
    order = Window.partitionBy("query").orderBy(F.desc("score"), "doc")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def best_documents(docs: DataFrame, queries: DataFrame, item: Column, k: int = TOP, query_bytes: int = QUERY_BYTES, postings: int = POSTINGS, probes: int = PROBES) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``k`` best documents for each row
    of ``queries`` (``text``, named by ``item``)."""
    spark = docs.sparkSession
    asked = cut_lineage(queries.select(item.cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")))
    blocks = -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // query_bytes)
    results = [spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")]
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # about query_bytes
        vocabulary: dict[bytes, int] = {}
        items, terms = [], []
        for row in rows:
            query: dict[int, int] = {}
            for word in filter(None, text_terms(row["text"])):
                t = vocabulary.setdefault(word, len(vocabulary))
                query[t] = query.get(t, 0) + 1
            items.append(row["item_id"])
            terms.append(query)
        if not vocabulary:
            continue
        index = build_index(docs, vocabulary, postings)
        counts = corpus_counts(index)
        probe = ranked(searched(index, terms, counts, k, {}, probes), k).where(F.col("rank") == k)
        floors = {r["query"]: (r["score"], r["doc"]) for r in probe.collect()}
        found = cut_lineage(ranked(searched(index, terms, counts, k, floors, None), k))
        names = spark.createDataFrame(list(enumerate(items)), "query int, item_id long")
        results.append(found.join(F.broadcast(names), "query").select("item_id", "rank", F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "score"))
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best of all documents for every benchmark item."""
    return best_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), F.col("item_id"))


SQL = """
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS w
  FROM documents
), asked AS (
  SELECT item_id, w, count(*) AS q
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                               '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark)
  GROUP BY ALL
), lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id
), corpus AS (SELECT count(*) AS documents, CAST(sum(n) AS BIGINT) AS total FROM lengths
), postings AS (SELECT doc_id, w, count(*) AS tf FROM words SEMI JOIN asked USING (w) GROUP BY ALL
), weights AS (
  SELECT w, CAST(floor(1000 * ln((2 * documents + 2) / (2 * df + 1))) AS BIGINT) AS weight
  FROM (SELECT w, count(*) AS df FROM postings GROUP BY w), corpus
), impacts AS (
  SELECT p.doc_id, w, weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * documents) // total))) AS impact
  FROM postings p JOIN weights USING (w) JOIN lengths USING (doc_id), corpus
), scores AS (
  SELECT item_id, doc_id, CAST(sum(q * impact) AS BIGINT) AS score FROM asked JOIN impacts USING (w) GROUP BY ALL
), placed AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score
  FROM scores WHERE score > 0
)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= 20
"""
