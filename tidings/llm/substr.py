"""Removal of repeated passages by prefix-partitioned suffix sorting.

A window of ``WINDOW`` words is removed where its words also start in a
document of a smaller id.  Only suffixes that can begin a repeat are kept: of
the nine five-word prefixes inside a window the one of least hash is its
anchor, so equal windows have equal anchors at the same place.  Anchors are
split by key range into groups that fit in memory.  A window also holds the
anchor's four neighbours on one side (the left ones if it begins that far
before it, else the right ones); whether such nine words occur in more than one
document is found first, from their hashes alone.  The words around the anchors
for which they do are then sent to the anchor's group, which
sorts the suffixes that start in each window and takes the longest common prefix
of neighbours up to ``WINDOW`` words.  Those that share so many are below one
node of the suffix tree at that depth, and the least document among them says
who keeps the passage.  No deeper node is formed: only equal windows decide what
is removed, and runs of removed windows are the longer repeats.

Words are compared by 32 bits of their hashes, thirteen in a row, anchors and
their neighbours by 64; words themselves are not compared.

(Prefixes are chosen by their hash and split by key ranges, not lengthened one
word at a time: a chunk of documents sends each distinct passage once, so a
frequent prefix has no more suffixes in its group than there are chunks times
distinct contexts, and needs no longer prefix to fit.)

Of equal texts only the first goes to the trees; the others lose all words, if
there are enough for a window.

Scale: see ``chunks``; the texts are shuffled once, those with an anchor that
repeats once more.  Everything else is arrays of eight to sixteen bytes an
anchor, and 100 bytes for one that repeats.

Defined cases: a null or empty text has no words; a null id is the smallest;
documents of equal ids don't remove each other's words; a text of fewer than
``WINDOW`` words keeps them; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from itertools import compress

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import chunks, cuts, mixed, with_chunks, word_numbers
from .common import cut_lineage, doc_text, read_table, text_bytes

WINDOW, ANCHOR = 13, 5
SHARD_BYTES = 32 << 20
BLOCK_WORDS = 1 << 15
NO_ID = -1 << 63

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def hashed_words(texts: list[str]):
    """The words' hashes, one text after the other, and each text's number of words."""
    number, sizes, hashes = word_numbers(texts, lower=False)
    return hashes[number], sizes


def block_anchors(hashes, sizes, window: int, anchor: int):
    """The arrays of ``Anchors`` for a block of texts."""
    import numpy as np

    factors = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93], np.uint64)
    n = max(len(hashes) - window + 1, 0)
    windows = np.flatnonzero(np.repeat(np.cumsum(sizes), sizes)[:n] - np.arange(n) >= window)  # those that end in their text
    if not len(windows):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64), none
    grams = np.zeros(len(hashes) - anchor + 1, np.uint64)
    for k in range(anchor):
        grams += hashes[k:k + len(grams)] * factors[k % 5] * np.uint64(2 * (k // 5) + 1)
    grams = mixed(grams)
    reach = window - anchor
    places = np.uint64((1 << reach.bit_length()) - 1)
    least, cover = grams & ~places, 1  # a hash's low bits make room for its place in the window
    while cover <= reach:  # the least of so many prefixes from here on
        step = min(cover, reach + 1 - cover)
        least = np.minimum(least[:-step], least[step:] + np.uint64(step))
        cover += step
    at = (least[windows] & places).astype(np.int64) + windows
    new = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    first, last, at = windows[new], windows[np.r_[new[1:], len(windows)] - 1], at[new]
    more = reach // 2
    left, right = np.flatnonzero(at - first >= more), np.flatnonzero(at - last < more)
    sides = []
    for which, shift, tag in ((left, -more, 1), (right, 0, 2)):
        total, begin = np.full(len(which), tag, np.uint64), at[which] + shift
        for k in range(anchor + more):
            total = (total ^ hashes[begin + k]) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(32)
        sides.append(mixed(total))
    return at, first, last, grams[at], np.concatenate(sides), np.concatenate([left, right])


class Anchors:
    """The anchors of texts whose words stand one text after the other:
    positions, hashes, and the first and last window (by its start) that each
    one stands for; ``text`` is the number of its text, and text n has the
    anchors from ``starts[n]`` to ``starts[n + 1]``.  ``looked`` are the hashes
    of the anchors with their neighbours on a side, ``owner`` the anchors they
    belong to.

    Arrays hold many texts, so that a short one costs no calls of its own, in
    blocks that fit in a processor's cache."""

    def __init__(self, hashes, sizes, window: int, anchor: int):
        import numpy as np

        ends = np.cumsum(sizes)
        total = np.r_[0, ends]
        found, base, begin = [[np.zeros(0, t)] for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.int64)], 0, 0
        while begin < len(sizes):
            end = max(begin + 1, int(np.searchsorted(total, total[begin] + BLOCK_WORDS, "right")) - 1)
            at, first, last, keys, looked, owner = block_anchors(hashes[total[begin]:total[end]], sizes[begin:end], window, anchor)
            for all_, x in zip(found, (at + total[begin], first + total[begin], last + total[begin], keys, looked, owner + base), strict=True):
                all_.append(x)
            base, begin = base + len(at), end
        self.at, self.first, self.last, self.keys, self.looked, self.owner = map(np.concatenate, found)
        self.text = np.searchsorted(ends, self.at, "right")
        self.starts = np.searchsorted(self.text, np.arange(len(sizes) + 1))


def split_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split()


def key_of(doc) -> int:
    return NO_ID if doc is None else doc


class Chunk:
    """Anchors of a chunk's texts, and its distinct ``looked`` hashes with
    whether more than one document of the chunk has them; ``entry`` says which
    of them each looked hash is."""

    def __init__(self, rows, window: int, anchor: int):
        import numpy as np

        hashes, self.sizes = hashed_words([t for _, t in rows])
        self.anchors = a = Anchors(hashes, self.sizes, window, anchor)
        docs = np.array([key_of(d) for d, _ in rows], np.int64)[a.text[a.owner]]
        order = np.argsort(a.looked)
        keys, docs = a.looked[order], docs[order]
        new = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
        starts = np.flatnonzero(new)
        self.entry = np.empty(len(keys), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.keys = keys[starts]
        self.several = np.minimum.reduceat(docs, starts) != np.maximum.reduceat(docs, starts) if len(starts) else np.zeros(0, bool)
        self.check = int(self.keys.sum(dtype=np.uint64) >> np.uint64(1)) if len(keys) else 0


def anchor_rows(docs: DataFrame, shards: int, window: int, anchor: int) -> DataFrame:
    """``(shard, chunk, chk, keys, several)``: a chunk's distinct hashes there."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for number, rows in chunks(batches):
            c = Chunk(rows, window, anchor)
            bounds = cuts(c.keys, shards)
            live = [s for s in range(shards) if bounds[s] < bounds[s + 1]]
            yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array([number] * len(live), pa.int64()), pa.array([c.check] * len(live), pa.int64()),
                                              pa.array([c.keys[bounds[s]:bounds[s + 1]].tobytes() for s in live], pa.binary()), pa.array([np.packbits(c.several[bounds[s]:bounds[s + 1]]).tobytes() for s in live], pa.binary())], ["shard", "chunk", "chk", "keys", "several"])

    return docs.mapInArrow(run, "shard int, chunk long, chk long, keys binary, several binary")


def repeated_anchors(rows: DataFrame) -> DataFrame:
    """``(chunk, shard, chk, bits)``: which of the chunk's hashes occur in more
    than one document."""

    def run(table):
        import numpy as np
        import pyarrow as pa

        keys = [np.frombuffer(b, np.uint64) for b in table.column("keys").to_pylist()]
        several = [np.unpackbits(np.frombuffer(b, np.uint8), count=len(k)).astype(bool) for b, k in zip(table.column("several").to_pylist(), keys, strict=True)]
        both, flags = np.concatenate(keys), np.concatenate(several)
        order = np.argsort(both, kind="stable")
        same = both[order]
        new = np.r_[True, same[1:] != same[:-1]]
        run_of = np.cumsum(new) - 1
        size = np.bincount(run_of)
        many = size > 1
        many |= np.bincount(run_of, flags[order]) > 0
        out = np.empty(len(both), bool)
        out[order] = many[run_of]
        bits, at = [], 0
        for k in keys:
            bits.append(np.packbits(out[at:at + len(k)]).tobytes())
            at += len(k)
        return pa.table({"chunk": table.column("chunk"), "shard": table.column("shard"), "chk": table.column("chk"), "bits": pa.array(bits, pa.binary())})

    return rows.groupBy("shard").applyInArrow(run, "chunk long, shard int, chk long, bits binary")


def in_order(table) -> list[tuple[int, str]]:
    rows = sorted(zip(table.column("place").to_pylist(), table.column("doc_id").to_pylist(), table.column("text").to_pylist(), strict=True), key=lambda r: r[0])
    return [(d, t) for _, d, t in rows]


def sha(words: list[bytes]) -> str:
    import hashlib

    return hashlib.sha256(b" ".join(words)).hexdigest()


def answered(table, keys_by_shard, check: int, width: int = 1):
    """The shards' bits in the order of the chunk's keys."""
    import numpy as np

    got = {s: (k, b) for s, k, b in zip(table.column("shard").to_pylist(), table.column("chk").to_pylist(), table.column("bits").to_pylist(), strict=True)}
    out = []
    for s, n in keys_by_shard:
        if not n:
            continue
        if s not in got or got[s][0] != check:
            raise RuntimeError("a chunk changed between two reads of the documents")
        out.append(np.unpackbits(np.frombuffer(got[s][1], np.uint8), count=n * width).astype(bool))
    return np.concatenate(out) if out else np.zeros(0, bool)


def suspects(docs: DataFrame, answers: DataFrame, shards: int, window: int, anchor: int) -> DataFrame:
    """Every document: its result, or, where an anchor repeats, its text and
    the numbers of those anchors."""

    def run(key, left, right):
        import numpy as np
        import pyarrow as pa

        rows = in_order(left)
        c = Chunk(rows, window, anchor)
        bounds = cuts(c.keys, shards)
        repeated = answered(right, [(s, int(bounds[s + 1] - bounds[s])) for s in range(shards)], c.check)
        a = c.anchors
        hit = np.zeros(len(a.at), bool)
        hit[a.owner[repeated[c.entry]]] = True
        hit = np.flatnonzero(hit)
        edges = np.searchsorted(a.text[hit], np.arange(len(rows) + 1)).tolist()
        numbers = (hit - a.starts[a.text[hit]]).astype(np.int32)
        out = []
        for n, ((doc, text), size) in enumerate(zip(rows, c.sizes.tolist(), strict=True)):
            found = numbers[edges[n]:edges[n + 1]]
            out.append((doc, size, None, None, text, found.tobytes(), len(found)) if len(found) else (doc, size, 0, sha(split_words(text)), None, None, 0))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int32())
        names = ("doc_id", "n_words", "n_removed", "kept_sha256", "text", "found", "n_found")
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names)

    return with_chunks(docs).groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, RESULT + ", text string, found binary, n_found int")


class Contexts:
    """The distinct suffix contexts of a chunk of suspects: for each anchor that
    repeats, the words from ``window - anchor`` before it to ``window - 1``
    after, the windows it stands for, and the least document.  ``owner`` and
    ``text`` are the numbers of each one's anchor and text, ``entry`` which of
    the distinct contexts it has."""

    def __init__(self, rows, window: int, anchor: int):
        """rows: (doc_id, text, found)"""
        import numpy as np

        reach = window - anchor
        hashes, self.sizes = hashed_words([t for _, t, _ in rows])
        self.anchors = a = Anchors(hashes, self.sizes, window, anchor)
        found = [np.frombuffer(f, np.int32) for _, _, f in rows]
        self.text = np.repeat(np.arange(len(rows)), [len(f) for f in found])
        self.owner = np.concatenate([np.zeros(0, np.int64), *found]) + a.starts[self.text]
        at, keys = a.at[self.owner], a.keys[self.owner]
        docs = np.array([key_of(d) for d, _, _ in rows], np.int64)[self.text]
        low, high = at - a.last[self.owner], at - a.first[self.owner]  # places of the anchor in its last and first window
        spans = np.stack([low, high], 1).astype(np.uint8)
        short = (hashes >> np.uint64(20)).astype(np.uint32)
        around, digest = np.zeros((len(at), reach + window), np.uint32), np.zeros(len(at), np.uint64)
        for j in range(reach + window):
            inside = (j >= reach - high) & (j < reach - low + window)  # else a word of no window
            around[inside, j] = short[at[inside] + (j - reach)]
            digest = mixed(digest ^ around[:, j])
        for j in range(2):
            digest = mixed(digest ^ spans[:, j])
        order = np.lexsort((docs, digest, keys))
        keys, digest, around, spans, docs = keys[order], digest[order], around[order], spans[order], docs[order]
        new = np.r_[True, (keys[1:] != keys[:-1]) | (digest[1:] != digest[:-1])] if len(keys) else np.zeros(0, bool)
        heads = np.flatnonzero(new)
        self.entry, self.docs, self.owner, self.text = np.cumsum(new) - 1, docs, self.owner[order], self.text[order]
        self.keys, self.around, self.spans, self.least = keys[heads], around[heads], spans[heads], docs[heads]
        self.check = int(mixed(self.keys ^ digest[heads]).sum(dtype=np.uint64) >> np.uint64(1)) if len(heads) else 0


def suspect_chunks(batches):
    from pyspark import TaskContext

    number, rows, held = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "found")), strict=True):
            rows.append(row)
            held += len(row[1]) + len(row[2])
            if held >= 8 << 20:
                yield number, rows
                number, rows, held = number + 1, [], 0
    if rows:
        yield number, rows


def context_rows(first: DataFrame, shards: int, window: int, anchor: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for number, rows in suspect_chunks(batches):
            c = Contexts(rows, window, anchor)
            bounds = cuts(c.keys, shards)
            live = [s for s in range(shards) if bounds[s] < bounds[s + 1]]
            part = lambda x, s: x[bounds[s]:bounds[s + 1]].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(live, pa.int32()), pa.array([number] * len(live), pa.int64()), pa.array([c.check] * len(live), pa.int64()),
                                              *[pa.array([part(x, s) for s in live], pa.binary()) for x in (c.keys, c.around, c.spans, c.least)]], ["shard", "chunk", "chk", "keys", "around", "spans", "least"])

    return first.select("doc_id", "text", "found").mapInArrow(run, "shard int, chunk long, chk long, keys binary, around binary, spans binary, least binary")


def suffix_nodes(words, groups, docs, depth: int):
    """For each suffix (a row of ``words``, in the tree of its group): the least
    document below its deepest node of at least ``depth`` words.

    Suffixes are sorted; two neighbours are below one such node if their longest
    common prefix is as long."""
    import numpy as np

    order = np.lexsort((*[words[:, j] for j in range(depth - 1, -1, -1)], groups))
    w, g = words[order], groups[order]
    differ = w[1:, :depth] != w[:-1, :depth]
    common = np.where(differ.any(1), differ.argmax(1), depth)
    common[g[1:] != g[:-1]] = 0
    heads = np.flatnonzero(np.r_[True, common < depth])
    least = np.minimum.reduceat(docs[order], heads)
    out = np.empty(len(docs), np.int64)
    out[order] = np.repeat(least, np.diff(np.r_[heads, len(docs)]))
    return out


def node_answers(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """``(chunk, shard, chk, bits)``: for each context and place of its anchor,
    whether the window also starts in a document before the context's least."""
    reach = window - anchor

    def run(table):
        import numpy as np
        import pyarrow as pa

        col = lambda n, t: [np.frombuffer(b, t) for b in table.column(n).to_pylist()]
        keys = col("keys", np.uint64)
        sizes = [len(k) for k in keys]
        keys, around = np.concatenate(keys), np.concatenate(col("around", np.uint32)).reshape(-1, reach + window)
        spans, docs = np.concatenate(col("spans", np.uint8)).reshape(-1, 2), np.concatenate(col("least", np.int64))
        bits = np.zeros((len(keys), reach + 1), bool)
        for place in range(reach + 1):  # a tree of the suffixes that start so far before the anchor
            has = np.flatnonzero((spans[:, 0] <= place) & (place <= spans[:, 1]))
            if len(has):
                least = suffix_nodes(around[has, reach - place:reach - place + window], keys[has], docs[has], window)
                bits[has, place] = least < docs[has]
        out, at = [], 0
        for n in sizes:
            out.append(np.packbits(bits[at:at + n].ravel()).tobytes())
            at += n
        return pa.table({"chunk": table.column("chunk"), "shard": table.column("shard"), "chk": table.column("chk"), "bits": pa.array(out, pa.binary())})

    return rows.groupBy("shard").applyInArrow(run, "chunk long, shard int, chk long, bits binary")


def with_suspect_chunks(first: DataFrame) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for number, rows in suspect_chunks(batches):
            for i in range(0, len(rows), 500):
                part = rows[i:i + 500]
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(part), pa.int64()), pa.array(range(i, i + len(part)), pa.int32()), pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.string()), pa.array([r[2] for r in part], pa.binary())], ["chunk", "place", "doc_id", "text", "found"])

    return first.select("doc_id", "text", "found").mapInArrow(run, "chunk long, place int, doc_id long, text string, found binary")


def removed(first: DataFrame, answers: DataFrame, shards: int, window: int, anchor: int, keep_text: bool) -> DataFrame:
    reach = window - anchor

    def run(key, left, right):
        import numpy as np
        import pyarrow as pa

        rows = sorted(zip(*(left.column(n).to_pylist() for n in ("place", "doc_id", "text", "found")), strict=True), key=lambda r: r[0])
        rows = [r[1:] for r in rows]
        c = Contexts(rows, window, anchor)
        bounds = cuts(c.keys, shards)
        bits = answered(right, [(s, int(bounds[s + 1] - bounds[s])) for s in range(shards)], c.check, reach + 1).reshape(-1, reach + 1)
        a = c.anchors
        earlier = c.least[c.entry] < c.docs  # an equal context of this chunk is in an earlier document
        at, first, last = a.at[c.owner], a.first[c.owner], a.last[c.owner]
        starts = [np.zeros(0, np.int64)]
        for place in range(reach + 1):
            start = at - place
            starts.append(start[(first <= start) & (start <= last) & (bits[c.entry, place] | earlier)])
        starts, n_words = np.concatenate(starts), int(c.sizes.sum())
        covered = np.bincount(starts, minlength=n_words + 1) - np.bincount(starts + window, minlength=n_words + 1)
        gone = np.cumsum(covered)[:-1] > 0
        out, begin = [], 0
        for (doc, text, _), size in zip(rows, c.sizes.tolist(), strict=True):
            mine = gone[begin:begin + size]
            begin += size
            kept = list(compress(split_words(text), (~mine).tolist()))
            out.append((doc, size, size - len(kept), sha(kept)) + ((b" ".join(kept).decode("utf-8", "surrogatepass"),) if keep_text else ()))
        kinds = [pa.int64()] * 3 + [pa.string()] * (1 + keep_text)
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * keep_text
        return pa.table([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names)

    return with_suspect_chunks(first).groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, RESULT + ", kept string" * keep_text)


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` of every document."""
    docs = doc_text(docs)
    shards = max(1, -(-text_bytes(docs) // shard_bytes))
    answers = repeated_anchors(anchor_rows(docs, shards, window, anchor))
    looked = cut_lineage(suspects(docs, answers, shards, window, anchor))
    clean = looked.where("text IS NULL").select("doc_id", "n_words", "n_removed", "kept_sha256")
    held = looked.where("text IS NOT NULL").withColumn("text_key", F.md5("text"))
    order = F.coalesce("doc_id", F.lit(NO_ID))
    firsts = cut_lineage(held.groupBy("text_key").agg(F.min(order).alias("first")))
    marked = held.select("doc_id", "n_words", "text_key").join(firsts, "text_key")
    copies = marked.where(order > F.col("first")).select("doc_id", "n_words", F.col("n_words").alias("n_removed"), F.sha2(F.lit(""), 256).alias("kept_sha256"))
    first = held.withColumn("first", order).join(firsts, ["text_key", "first"], "left_semi").select("doc_id", "text", "found", "n_found")
    first = cut_lineage(first)
    shards2 = max(1, -(-(first.agg(F.sum("n_found")).first()[0] or 0) // 200_000))
    answers2 = node_answers(context_rows(first, shards2, window, anchor), window, anchor)
    return clean.unionByName(copies).unionByName(removed(first, answers2, shards2, window, anchor, False))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the 13-word windows that an earlier one has."""
    return remove_repeats(read_table(spark, sf_dir, "documents"))


SQL = """
WITH split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM split)
), firsts AS (SELECT k, min(doc_id) AS keeper FROM windows GROUP BY k
), hit AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS place FROM windows JOIN firsts USING (k) WHERE keeper < doc_id
), placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM split
), kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text FROM placed ANTI JOIN hit USING (doc_id, place) GROUP BY doc_id
)
SELECT s.doc_id, CAST(len(s.words) AS BIGINT) AS n_words, CAST(len(s.words) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM split s LEFT JOIN kept k ON k.doc_id = s.doc_id
"""
