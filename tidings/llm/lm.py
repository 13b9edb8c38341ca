"""Language-model scores from Elias-Fano n-gram tries.

Words, their successors and (order three) the words after each pair are counted
over the training documents, and each shard of the contexts (by hash range of
the first word) keeps its part as a trie of two or three levels.  A level has
its contexts in order, with their counts; a monotone pointer says where a
context's successors begin.  The successors, each context's in order, are made
relative to their context and form one monotone sequence, kept in Elias-Fano
code (low bytes as they are, high parts as a unary bit vector with sampled
zeros), and beside it their counts in 8-bit codes.  The contexts of the third
level are the pairs of the second, by number.  A level lies in one
memory-mapped file.  The queries of all chunks that ask a shard are put in
order once, each distinct one once; the stretch of keys that they span is
decoded a part at a time and searched for many of them (pointers are not used
for that).

Smoothing: interpolated, each level with three discounts from the counts of
counts of all shards.  Shards answer with counts, and with how many successors
of count one, two, and three or more a context has; so the discounts, which are
known once all shards are built, are applied where the chunk is scored.  The
triples back off to the pairs, these to the additive unigram that is also the
base score.

Scale: a chunk of documents sends each shard the distinct pairs and triples it
has there, once, with their training counts, and gets codes back; that serves
for training and for scoring, so no model is ever held whole, and what is moved
grows with the corpus.  A shard has what ``SHARD_BYTES`` of text give it, and a task
streams through its shards' sorted rows.  A context of more than ``HOT`` of all tokens is split
over shards by its successors; every slice gets its total.  The triples of one
pair stay with it, at most one entry per chunk and word.  See ``chunks`` for
the chunks.

Defined cases: a null or empty text is its end token; a null id counts as empty
text in the hash that holds rows out; repeated documents are counted and scored
each; without training rows every token has the same probability; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import chunks, with_chunks, word_numbers
from .common import crc_mod, cut_lineage, doc_text, read_table, text_bytes, trimmed, trimmed_groups

CHUNK_BYTES, SHARD_BYTES = 8 << 20, 4 << 20
HOT, HOT_SAMPLE = 0.01, 4
ADDED = 0.1
FOLDS, ORDER = 10, 3
SUCCESSOR_BITS = 40
CODE_RANGE = 8.0  # decades of probability that the codes span
START, END = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB  # hashes that stand for the ends of a text

RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class EliasFano:
    """A non-decreasing sequence below ``universe``: whole low bytes, and high
    parts in unary with the place of every 64th zero."""

    SAMPLE = 64

    def __init__(self, n: int, low_bytes: int, low, words, zeros):
        self.n, self.low_bytes, self.low, self.words, self.zeros = n, low_bytes, low, words, zeros

    @staticmethod
    def encode(values, universe: int) -> "EliasFano":
        import numpy as np

        n = len(values)
        low_bytes = max(0, -(-((max(universe, 1) // max(n, 1)).bit_length() - 1) // 8))
        shift = np.uint64(8 * low_bytes)
        high = (values >> shift).astype(np.int64) if low_bytes < 8 else np.zeros(n, np.int64)
        buckets = (universe >> (8 * low_bytes)) + 2
        bits = np.zeros(-(-(n + buckets) // 64) * 64, np.uint8)
        bits[high + np.arange(n)] = 1
        words = np.packbits(bits, bitorder="little").view(np.uint64)
        zeros = np.flatnonzero(bits[:n + buckets] == 0)[::EliasFano.SAMPLE].astype(np.uint64)
        low = np.ascontiguousarray(values.view(np.uint8).reshape(n, 8)[:, :low_bytes])
        return EliasFano(n, low_bytes, low, words, zeros)

    def arrays(self):
        return self.low, self.words, self.zeros

    def zero(self, k):
        """Place of the k-th zero (from 0) of the unary part."""
        import numpy as np

        k = k.astype(np.int64)
        place = self.zeros[k // self.SAMPLE].astype(np.int64)
        rest = k % self.SAMPLE  # zeros to pass from that place on
        word = place >> 6
        current = ~self.words[word] >> (place & 63).astype(np.uint64) << (place & 63).astype(np.uint64)
        have = np.bitwise_count(current).astype(np.int64)
        while (more := np.flatnonzero(rest >= have)).size:
            rest[more] -= have[more]
            word[more] += 1
            current[more] = ~self.words[word[more]]
            have[more] = np.bitwise_count(current[more])
        at = np.zeros(len(k), np.int64)
        for width in (32, 16, 8, 4, 2, 1):  # halve the word that holds it
            mask = np.uint64((1 << width) - 1)
            count = np.bitwise_count(current & mask).astype(np.int64)
            up = rest >= count
            rest = np.where(up, rest - count, rest)
            at += np.where(up, width, 0)
            current = np.where(up, current >> np.uint64(width), current)
        return word * 64 + at

    def get(self, i):
        """Low part of the entries ``i``."""
        import numpy as np

        low = self.low[i]
        out = np.zeros((len(low), 8), np.uint8)
        out[:, :self.low_bytes] = low
        return out.view(np.uint64).ravel()

    def successor(self, x):
        """Index of the first entry not below each ``x`` in x's bucket (or the
        bucket's end), and whether it equals x."""
        import numpy as np

        shift = np.uint64(8 * self.low_bytes)
        high = (x >> shift).astype(np.int64) if self.low_bytes < 8 else np.zeros(len(x), np.int64)
        low = x & np.uint64((1 << 8 * self.low_bytes) - 1)
        start = np.where(high > 0, self.zero(np.maximum(high - 1, 0)) - high + 1, 0)
        stop = end = self.zero(high) - high
        start, stop = start.copy(), stop.copy()
        while (live := np.flatnonzero(start < stop)).size:
            mid = (start[live] + stop[live]) // 2
            less = self.get(mid) < low[live]
            start[live] = np.where(less, mid + 1, start[live])
            stop[live] = np.where(less, stop[live], mid)
        inside = np.flatnonzero(start < end)
        same = np.zeros(len(x), bool)
        same[inside] = self.get(start[inside]) == low[inside]
        return start, same


    def decoded(self, start: int, stop: int):
        """The entries whose high part is from ``start`` to ``stop`` - 1, and
        the number of the first of them."""
        import numpy as np

        first = int(self.zero(np.array([start - 1]))[0]) + 1 if start else 0
        end = int(self.zero(np.array([stop - 1]))[0])
        bits = np.unpackbits(self.words[first >> 6:(end >> 6) + 1].view(np.uint8), bitorder="little")[first & 63:end - (first >> 6 << 6)]
        ones = np.flatnonzero(bits)
        n, at = len(ones), first - start
        return (ones - np.arange(n) + start).astype(np.uint64) << np.uint64(8 * self.low_bytes) | self.get(slice(at, at + n)), at

    def successor_of_sorted(self, x, step: int = 1 << 18):
        """``successor`` for sorted ``x``."""
        import numpy as np

        at, same = np.zeros(len(x), np.int64), np.zeros(len(x), bool)
        shift = np.uint64(8 * self.low_bytes)
        for i in range(0, len(x), step):
            part = x[i:i + step]
            entries, before = self.decoded(int(part[0] >> shift), int(part[-1] >> shift) + 1)
            found = np.searchsorted(entries, part)
            at[i:i + step] = found + before
            if len(entries):
                same[i:i + step] = entries[np.minimum(found, len(entries) - 1)] == part
        return at, same


def stored(arrays):
    """The arrays, written to one temporary file and mapped back from it; the
    file goes as soon as it is mapped."""
    import mmap
    import tempfile

    import numpy as np

    with tempfile.TemporaryFile() as f:
        places = []
        for a in arrays:
            f.seek(-(-f.tell() // 8) * 8)
            places.append((f.tell(), a.dtype, a.shape))
            f.write(np.ascontiguousarray(a).tobytes())
        f.write(b"\0" * 8)
        f.flush()
        mapped = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    return [np.frombuffer(mapped, t, int(np.prod(shape)), at).reshape(shape) for at, t, shape in places]


def discounts(counts) -> list[float]:
    """Discounts of counts one, two, and three or more, from the counts of
    counts (Chen and Goodman), which can be given as a tuple of four."""
    n = counts if isinstance(counts, tuple) else [int((counts == k).sum()) for k in range(1, 5)]
    if not n[0]:
        return [0.5, 0.5, 0.5]
    y = n[0] / (n[0] + 2 * n[1])
    out = []
    for k in (1, 2, 3):
        d = k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else 0.75 * k
        out.append(min(max(d, 0.1), k - 0.02))
    return out


class Trie:
    """Contexts (sorted) and their successors (``keys`` = context number << 40 |
    successor, sorted, with training counts).  ``codes`` are those of the
    probabilities less the trie's own discounts, or what ``coded`` makes of the
    counts; ``tally`` is each context's number of successors of count one, two,
    and three or more."""

    def __init__(self, contexts, totals, keys, counts, coded=None):
        import numpy as np

        seen = counts > 0
        keys, counts = keys[seen], counts[seen]
        of = (keys >> np.uint64(SUCCESSOR_BITS)).astype(np.int64)
        d = np.array([0.0, *discounts(counts)])
        cut = d[np.minimum(counts, 3)]
        safe = np.maximum(totals, 1)
        backoff = np.bincount(of, cut, len(contexts)) / safe
        if coded:
            codes = coded(counts)
        else:
            p = (counts - cut) / safe[of]
            codes = np.clip(np.rint((np.log10(np.maximum(p, 1e-30)) / CODE_RANGE + 1) * 254), 0, 254).astype(np.uint8) + 1
        tally = np.bincount(of * 3 + np.minimum(counts, 3) - 1, minlength=3 * len(contexts)).reshape(-1, 3).astype(np.uint32)
        pointers = EliasFano.encode(np.searchsorted(keys, np.arange(len(contexts) + 1, dtype=np.uint64) << np.uint64(SUCCESSOR_BITS)).astype(np.uint64), len(keys) + 1)
        successors = EliasFano.encode(keys, max(len(contexts), 1) << SUCCESSOR_BITS)
        parts = stored([contexts, totals, backoff.astype(np.float32), codes, tally, *pointers.arrays(), *successors.arrays()])
        self.contexts, self.totals, self.backoff, self.codes, self.tally = parts[:5]
        self.pointers = EliasFano(pointers.n, pointers.low_bytes, *parts[5:8])
        self.successors = EliasFano(successors.n, successors.low_bytes, *parts[8:11])

    def pointer(self, i):
        """Where the successors of context ``i`` begin."""
        import numpy as np

        lows = self.pointers.get(i).astype(np.int64)
        # the high part of entry i is its one's place less i; found by halving over zeros
        low, high = np.zeros(len(i), np.int64), np.full(len(i), (self.successors.n + 1 >> 8 * self.pointers.low_bytes) + 1, np.int64)
        while (low < high).any():
            mid = (low + high) // 2
            after = self.pointers.zero(mid) - mid > i  # entries of high part up to mid
            high, low = np.where(after, mid, high), np.where(after, low, np.minimum(mid + 1, high))
        return (low << 8 * self.pointers.low_bytes) + lows

    def children(self, context: int) -> tuple[int, int]:
        import numpy as np

        a, b = self.pointer(np.array([context, context + 1]))
        return int(a), int(b)

    def code(self, context, successor):
        """Code of each (context number, 40-bit successor), in order; 0 if
        unseen."""
        import numpy as np

        return self.code_of(context.astype(np.uint64) << np.uint64(SUCCESSOR_BITS) | successor)

    def code_of(self, keys):
        """``code`` of sorted keys."""
        import numpy as np

        if not self.successors.n:
            return np.zeros(len(keys), np.uint8)
        at, same = self.successors.successor_of_sorted(keys)
        return np.where(same, self.codes[np.minimum(at, self.successors.n - 1)], 0).astype(np.uint8)


def decoded():
    """Probability of each code."""
    import numpy as np

    out = 10 ** ((np.arange(256) - 1) / 254 * CODE_RANGE - CODE_RANGE)
    out[0] = 0
    return out


EXACT, STEP = 64, 0.036  # counts up to EXACT have codes of their own, larger ones share STEP decades


def count_codes(counts):
    import numpy as np

    large = EXACT + np.rint(np.log10(np.maximum(counts, 1) / EXACT) / STEP)
    return np.where(counts <= EXACT, counts, np.clip(large, EXACT + 1, 255)).astype(np.uint8)


def coded_counts():
    """Count of each code."""
    import numpy as np

    code = np.arange(256.0)
    return np.where(code <= EXACT, code, EXACT * 10 ** ((code - EXACT) * STEP))


def interpolated(codes, totals, tally, of, lower, d):
    """Probabilities of successors with these count codes, each in context
    ``of``: the discounted share, and the lower order for what was taken off."""
    import numpy as np

    counts, cut = coded_counts()[codes], np.array([0.0, *d])
    safe = np.maximum(totals, 1)
    backoff = np.where(totals > 0, tally @ cut[1:] / safe, 1.0)
    return (counts - cut[np.minimum(codes, 3)]) / safe[of] + backoff[of] * lower


def is_held_out(doc, folds: int = FOLDS) -> bool:
    return zlib.crc32(b"" if doc is None else str(doc).encode()) % folds == 0


class Pairs:
    """The distinct (context, word) pairs of a chunk's texts in the order in
    which the shards get them; of order three, also the distinct words that
    follow each pair, in the order of the pairs."""

    def __init__(self, rows, shards: int, hot: dict[int, int], folds: int, order: int = 2):
        import numpy as np

        words, sizes, hashes = word_numbers([t for _, t in rows])
        self.lengths = sizes.astype(np.int64) + 1
        self.held = np.array([is_held_out(d, folds) for d, _ in rows], bool)
        ends = np.cumsum(self.lengths)
        n = int(ends[-1]) if len(rows) else 0
        self.kinds, number = np.unique(np.r_[hashes, np.uint64(END), np.uint64(START)], return_inverse=True)
        number = number.astype(np.int32)  # a chunk has far fewer than 2 ** 31 tokens
        self.token = np.full(n, number[-2])
        inside = np.ones(n, bool)
        inside[ends - 1] = False
        self.token[inside] = number[words]
        before = np.r_[number[-1], self.token[:-1]] if n else self.token
        before[ends[:-1]] = number[-1]
        trained = np.repeat(~self.held, self.lengths)
        pair = before * np.int64(len(self.kinds)) + self.token
        distinct, self.pair = np.unique(pair, return_inverse=True)
        self.pair = self.pair.astype(np.int32)
        counts = np.bincount(self.pair, trained, len(distinct)).astype(np.int32)
        context, follows = (distinct // max(len(self.kinds), 1)).astype(np.int32), (distinct % max(len(self.kinds), 1)).astype(np.int32)
        totals = np.bincount(before, trained, len(self.kinds)).astype(np.int64)
        self.check = int(distinct.sum() & 0x7FFFFFFFFFFFFFFF) ^ n if n else 0
        del pair, distinct, before, number, words, inside
        shard = self.home(self.kinds, shards).astype(np.int32)[context]
        for h, slices in hot.items():
            i = int(np.searchsorted(self.kinds, np.uint64(h)))
            if i < len(self.kinds) and self.kinds[i] == np.uint64(h):
                mine = np.flatnonzero(context == i)
                part = (self.kinds[follows[mine]] >> np.uint64(13)) % np.uint64(slices)
                shard[mine] = (shard[mine] + part.astype(np.int64)) % shards
        sent = np.argsort(shard, kind="stable").astype(np.int32)
        self.place = np.empty(len(sent), np.int32)
        self.place[sent] = np.arange(len(sent), dtype=np.int32)
        self.context, self.follows, self.counts, shard = context[sent], follows[sent], counts[sent], shard[sent]
        del context, follows, counts, sent
        self.later = np.ones(n, bool)  # tokens with two before them, a text's start included
        self.later[np.r_[0, ends[:-1]] if n else ends] = order < 3
        self.later &= order > 2
        at = np.flatnonzero(self.later)
        self.parent = self.place[self.pair[at - 1]]
        triple, self.triple = np.unique(self.parent * np.int64(max(len(self.kinds), 1)) + self.token[at], return_inverse=True)
        self.triple = self.triple.astype(np.int32)
        self.third = (triple % max(len(self.kinds), 1)).astype(np.int32)
        self.third_counts = np.bincount(self.triple, trained[at], len(triple)).astype(np.int32)
        self.below = np.bincount(triple // max(len(self.kinds), 1), minlength=len(self.place)).astype(np.int32)  # words after each pair
        del triple, at
        self.first_below = np.r_[0, np.cumsum(self.below, dtype=np.int64)]
        bounds = np.searchsorted(shard, np.arange(shards + 1))
        self.parts = []  # (shard, from, to, contexts, successors of each)
        spread: dict[int, list[int]] = {}
        for h, slices in hot.items():
            i = int(np.searchsorted(self.kinds, np.uint64(h)))
            if i < len(self.kinds) and self.kinds[i] == np.uint64(h):
                first = int(self.home(self.kinds[i:i + 1], shards)[0])
                for k in range(slices):
                    spread.setdefault((first + k) % shards, []).append(i)
        for s in range(shards):
            a, b = int(bounds[s]), int(bounds[s + 1])
            if a == b and s not in spread:
                continue
            own, size = np.unique(self.context[a:b], return_counts=True)
            more = np.setdiff1d(np.array(spread.get(s, []), np.int64), own)
            own, size = np.concatenate([own, more]), np.concatenate([size, np.zeros(len(more), np.int64)])
            self.parts.append((s, a, b, own, size))
        self.totals = totals

    @staticmethod
    def home(hashes, shards: int):
        import numpy as np

        return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def hot_words(docs: DataFrame, shards: int, share: float = HOT) -> dict[int, int]:
    """Contexts of at least ``share`` of all tokens (so at most 1 / share), and
    the slices each is cut into.  This only places the work, and results don't
    depend on it: one chunk in ``HOT_SAMPLE`` is looked at (by its number's
    hash), and chunks name words of a twentieth of the share."""

    if shards == 1:
        return {}

    def run(batches):
        from collections import Counter

        import pyarrow as pa
        import xxhash

        for number, rows in chunks(batches, CHUNK_BYTES):
            if zlib.crc32(str(number).encode()) % HOT_SAMPLE:
                continue
            seen: Counter = Counter()
            for _, text in rows:
                seen.update(text.encode("utf-8", "surrogatepass").lower().split())
            total = sum(seen.values()) + len(rows)
            found = [(xxhash.xxh64_intdigest(w), n) for w, n in seen.items() if n * 20 >= total * share]
            found += [(START, len(rows))]
            signed = [h - (1 << 64) if h >> 63 else h for h, _ in found]
            yield pa.RecordBatch.from_arrays([pa.array([0, *signed], pa.int64()), pa.array([total, *[n for _, n in found]], pa.int64()), pa.array([True] + [False] * len(found))], ["h", "n", "total"])

    sums = docs.select("doc_id", "text").mapInArrow(trimmed(run), "h long, n long, total boolean").groupBy("h", "total").agg(F.sum("n").alias("n"))
    sums = cut_lineage(sums)
    total = sums.where("total").agg(F.sum("n")).first()[0] or 0
    found = sums.where(~F.col("total") & (F.col("n") >= total * share)).orderBy("h").collect()
    return {r["h"] % (1 << 64): min(shards, 1 + -(-2 * r["n"] * shards // total)) for r in found}


REQUEST = "shard int, chunk long, chk long, contexts binary, totals binary, sizes binary, low binary, high binary, counts binary, many binary, below binary, low3 binary, high3 binary, counts3 binary, many3 binary"


def requests(docs: DataFrame, shards: int, hot: dict[int, int], folds: int, order: int = 2) -> DataFrame:
    """What each chunk sends each shard: contexts with their training totals and
    numbers of successors; the successors' 40 bits and training counts (one
    byte, 255 for those listed in ``many``); of order three the number of words
    that follow each pair, and these words as the successors."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for number, rows in chunks(batches, CHUNK_BYTES):
            p = Pairs(rows, shards, hot, folds, order)

            def listed(kind, n):
                word = p.kinds[kind] >> np.uint64(64 - SUCCESSOR_BITS)
                return word.astype(np.uint32).tobytes(), (word >> np.uint64(32)).astype(np.uint8).tobytes(), np.minimum(n, 255).astype(np.uint8).tobytes(), n[n >= 255].astype(np.uint32).tobytes()

            kinds = [pa.int32(), pa.int64(), pa.int64()] + [pa.binary()] * 12
            out = []
            for s, a, b, own, size in p.parts:
                x, y = p.first_below[a], p.first_below[b]
                o = (s, number, p.check, p.kinds[own].tobytes(), p.totals[own].astype(np.uint32).tobytes(), size.astype(np.uint32).tobytes(), *listed(p.follows[a:b], p.counts[a:b]),
                     p.below[a:b].astype(np.uint32).tobytes(), *listed(p.third[x:y], p.third_counts[x:y]))
                out.append(o)
                if len(out) == 200 or s == p.parts[-1][0]:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], [x.split()[0] for x in REQUEST.split(", ")])
                    out = []

    return docs.mapInArrow(trimmed(run), REQUEST)


ANSWER = "chunk long, shard int, chk long, totals binary, tally binary, codes binary, small3 binary, large3 binary, codes3 binary, kinds long, words long, cc array<long>, cc3 array<long>"


def gathered(keys, counts):
    """Distinct keys, sorted, the sums of their counts, and each key's place
    among them."""
    import numpy as np

    order = np.argsort(keys, kind="stable")
    same = keys[order]
    new = np.r_[True, same[1:] != same[:-1]] if len(same) else np.zeros(0, bool)
    heads = np.flatnonzero(new)
    same = same[heads]
    sums = np.add.reduceat(counts[order], heads, dtype=np.int64) if len(heads) else np.zeros(0, np.int64)
    place = np.empty(len(keys), np.int32)
    place[order] = np.cumsum(new, dtype=np.int32) - 1
    return same, sums, place


def packed(totals, tally) -> tuple[bytes, bytes]:
    """Totals and tallies of contexts, a byte for each number and those of 255
    and more apart."""
    import numpy as np

    numbers = np.column_stack([totals, tally]).astype(np.uint32).ravel()
    return np.minimum(numbers, 255).astype(np.uint8).tobytes(), numbers[numbers >= 255].tobytes()


def unpacked(small: bytes, large: bytes):
    import numpy as np

    numbers = np.frombuffer(small, np.uint8).astype(np.int64)
    numbers[numbers == 255] = np.frombuffer(large, np.uint32)
    numbers = numbers.reshape(-1, 4)
    return numbers[:, 0], numbers[:, 1:]


def shard_answers(table, shards: int):
    """Builds a shard's trie from the rows of all chunks (``REQUEST``) and
    answers them, a record batch (``ANSWER``) each."""
    import numpy as np
    import pyarrow as pa

    col = lambda n, t: [np.frombuffer(b.as_buffer(), t) for b in table.column(n)]

    def listed(third=""):
        counts = []
        for n, many in zip(col("counts" + third, np.uint8), col("many" + third, np.uint32), strict=True):
            n = n.astype(np.uint32)
            n[n == 255] = many
            counts.append(n)
        words = np.concatenate(col("low" + third, np.uint32)).astype(np.uint64)
        words |= np.concatenate(col("high" + third, np.uint8)).astype(np.uint64) << np.uint64(32)
        return words, np.concatenate(counts)

    def trained(keys, sums):
        """Those with training counts, and every key's number among them (of
        the others: how many they are)."""
        seen = sums > 0
        number = np.cumsum(seen, dtype=np.int32) - 1
        number[~seen] = np.count_nonzero(seen)
        return keys[seen], sums[seen], number

    asked, sizes, below = col("contexts", np.uint64), col("sizes", np.uint32), col("below", np.uint32)
    contexts, number = np.unique(np.concatenate(asked), return_inverse=True)
    totals = np.bincount(number, np.concatenate(col("totals", np.uint32)), len(contexts)).astype(np.int64)
    successor, counts = listed()
    successor |= np.repeat(number.astype(np.uint64) << np.uint64(SUCCESSOR_BITS), np.concatenate(sizes))
    keys, sums, place = gathered(successor, counts)
    del successor, counts
    pairs, pair_counts, of = trained(keys, sums)
    trie = Trie(contexts, totals, pairs, pair_counts, count_codes)
    pair, codes = of[place], trie.code_of(keys)[place]
    del keys, sums, place, of
    third, counts = listed("3")
    third |= np.repeat(pair.astype(np.uint64) << np.uint64(SUCCESSOR_BITS), np.concatenate(below))
    keys, sums, place = gathered(third, counts)
    del third, counts
    triples, triple_counts, _ = trained(keys, sums)
    lower = Trie(np.r_[pairs, np.uint64(0)], np.r_[pair_counts, 0].astype(np.int64), triples, triple_counts, count_codes)
    codes3 = lower.code_of(keys)[place]
    del keys, sums, place
    cc, cc3 = ([int((n == k).sum()) for k in range(1, 5)] for n in (pair_counts, triple_counts))
    at_home = (Pairs.home(contexts, shards) == table.column("shard")[0].as_py()) & (totals > 0) & (contexts != np.uint64(START))
    out, a, c, e = [], 0, 0, 0
    for i, (own, size, under) in enumerate(zip(asked, sizes, below, strict=True)):
        mine = number[c:c + len(own)]
        n, m = int(size.sum()), int(under.sum())
        at = pair[a:a + n] if len(under) and m else pair[:0]
        out.append((trie.totals[mine].tobytes(), trie.tally[mine].tobytes(), codes[a:a + n].tobytes(), *packed(lower.totals[at], lower.tally[at]), codes3[e:e + m].tobytes(),
                    int(at_home.sum()) if i == 0 else 0, int(totals[at_home].sum()) if i == 0 else 0, cc if i == 0 else [0] * 4, cc3 if i == 0 else [0] * 4))
        a, c, e = a + n, c + len(own), e + m
    types = [pa.binary()] * 6 + [pa.int64()] * 2 + [pa.list_(pa.int64())] * 2
    names = [x.split()[0] for x in ANSWER.split(", ")]
    keys = [table.column(c).combine_chunks() for c in names[:3]]
    for i, o in enumerate(out):
        yield pa.RecordBatch.from_arrays([*(k[i:i + 1] for k in keys), *[pa.array([v], t) for v, t in zip(o, types, strict=True)]], names)


def answers(sent: DataFrame, shards: int) -> DataFrame:
    """Builds each shard's trie and answers its chunks: totals and tallies of
    their contexts, count codes of their pairs, and the same of their pairs as
    contexts and the words after them.  ``kinds`` and ``words`` have, once a
    shard, the number of distinct training words at home there and of their
    occurrences; ``cc`` and ``cc3`` its counts of counts one to four."""

    def run(batches):
        """A shard's rows follow each other, in batches of any size."""
        import pyarrow as pa

        held, own = [], None
        for batch in batches:
            shard, at = batch.column("shard").to_pylist(), 0
            for i in range(1, len(shard) + 1):
                if i < len(shard) and shard[i] == shard[at]:
                    continue
                if own is not None and shard[at] != own:
                    yield from shard_answers(pa.Table.from_batches(held), shards)
                    held = []
                own = shard[at]
                held.append(batch.slice(at, i - at))
                at = i
        if held:
            yield from shard_answers(pa.Table.from_batches(held), shards)

    return sent.repartition(shards, "shard").sortWithinPartitions("shard", "chunk").mapInArrow(trimmed(run), ANSWER)


def scores(docs: DataFrame, answered: DataFrame, shards: int, hot: dict[int, int], folds: int, train_docs: int, train_tokens: int, distinct: int, cut2: list[float], cut3: list[float], order: int = 2) -> DataFrame:
    """``cut2`` and ``cut3`` are the discounts of pairs and of triples."""

    def run(key, left, right):
        import numpy as np
        import pyarrow as pa

        rows = sorted(zip(left.column("place").to_pylist(), left.column("doc_id").to_pylist(), left.column("text").to_pylist(), strict=True), key=lambda r: r[0])
        rows = [r[1:] for r in rows]
        p = Pairs(rows, shards, hot, folds, order)
        got = {r["shard"]: r for r in right.to_pylist()}
        totals, tally, codes = np.zeros(len(p.kinds), np.int64), np.zeros((len(p.kinds), 3)), np.zeros(len(p.context), np.uint8)
        totals3, tally3, codes3 = np.zeros(len(p.context), np.int64), np.zeros((len(p.context), 3), np.uint32), np.zeros(len(p.third), np.uint8)
        for s, a, b, own, size in p.parts:
            if s not in got or got[s]["chk"] != p.check:
                raise RuntimeError("a chunk changed between two reads of the documents")
            totals[own] = np.frombuffer(got[s]["totals"], np.int64)
            tally[own] += np.frombuffer(got[s]["tally"], np.uint32).reshape(-1, 3)
            codes[a:b] = np.frombuffer(got[s]["codes"], np.uint8)
            x, y = p.first_below[a], p.first_below[b]
            if y > x:
                totals3[a:b], tally3[a:b] = unpacked(got[s]["small3"], got[s]["large3"])
                codes3[x:y] = np.frombuffer(got[s]["codes3"], np.uint8)
        count = totals.copy()
        count[p.kinds == np.uint64(END)] = train_docs
        unigram = (count + ADDED) / (train_tokens + ADDED * (distinct + 1))
        chance = interpolated(codes, totals, tally, p.context, unigram[p.follows], cut2)[p.place][p.pair]
        chance[p.later] = interpolated(codes3[p.triple], totals3, tally3, p.parent, chance[p.later], cut3)
        log_pair, log_one = np.log10(chance), np.log10(unigram)[p.token]
        known = count[p.token] > 0
        starts = np.r_[0, np.cumsum(p.lengths)[:-1]]
        add = lambda x: np.add.reduceat(x, starts)
        return pa.table([pa.array([d for d, _ in rows], pa.int64()), pa.array(p.held), pa.array(p.lengths), pa.array(add(known.astype(np.int64))), pa.array(np.full(len(rows), train_tokens, np.int64)), pa.array(add(log_one)), pa.array(add(log_pair))], [x.split()[0] for x in RESULT.split(", ")])

    return with_chunks(docs, CHUNK_BYTES).groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(trimmed_groups(run), RESULT)


def train_and_score(docs: DataFrame, folds: int = FOLDS, shard_bytes: int = SHARD_BYTES, order: int = 2) -> DataFrame:
    """Scores every document by the model, of ``order`` two or three, of those
    that are not held out."""
    docs = doc_text(docs)
    shards = max(1, -(-text_bytes(docs) // shard_bytes))
    hot = hot_words(docs, shards)
    answered = cut_lineage(answers(requests(docs, shards, hot, folds, order), shards))
    sums = answered.agg(F.sum("kinds"), F.sum("words"), *[F.sum(F.col(c)[k]) for c in ("cc", "cc3") for k in range(4)]).first()
    distinct, words, *cc = (x or 0 for x in sums)
    train_docs = docs.where(crc_mod(F.col("doc_id"), folds) != 0).count()
    cuts = discounts(tuple(cc[:4])), discounts(tuple(cc[4:]))
    return scores(docs, answered.drop("cc", "cc3"), shards, hot, folds, train_docs, words + train_docs, distinct + (train_docs > 0), *cuts, order)


def op1_ngram_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probabilities of all documents."""
    return train_and_score(read_table(spark, sf_dir, "documents"), order=ORDER)
