"""Cost-balanced packing of documents into token sequences.

Every document is tokenised and cut into full sequences plus a rest.  The
rests of a group of documents (a bounded number of tokens of one partition)
are then dealt out in descending length: each goes to the sequence of least
estimated cost (linear plus quadratic, as attention costs) that still has room
for it.  A rest that fits nowhere whole is cut over the room that is left.
The sequences of a group hold exactly its tokens -- full ones, and for the
last tokens some whose length is a power of two -- so nothing is padded.

Scale: one pass over the documents, no shuffle, nothing gathered; a task holds
one group (``group_tokens``) and one long document's ids at a time.  Sequence
ids carry the partition's number, so they never clash and a retried task gives
the same ones.

Defined cases: a null or empty text is its end token alone; equal documents are
packed like any others; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession

from .common import doc_text, read_table, trimmed

SEQUENCE = 4096
GROUP_TOKENS = 1 << 22
END_ID = 2
#: Estimated cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n.
LINEAR, QUADRATIC = 1.0, 1.0 / 2048
CACHE_WORDS = 600_000

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, piece_cost double, sequence_length long")


def piece_cost(n, linear: float = LINEAR, quadratic: float = QUADRATIC):
    return linear * n + quadratic * n * n


class WordEncoder:
    """Ids of texts under a tokenizer that drops white space, word by word with
    a cache.  Words end at a blank or line feed, so a word's ids don't depend
    on its neighbours, and a run of letters followed by ASCII punctuation has
    the ids of either part.  Small Latin letters need no normalising and a word
    of them ends in one word-final token, so many such words are encoded as one
    text and cut apart at those."""

    RUN = 1000
    PUNCTUATION = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
    PLAIN = "^[a-z\u00df-\u00f6\u00f8-\u00ff]+$"

    def __init__(self, tokenizer: str, cache_words: int = CACHE_WORDS):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        import public_tokenizers
        from tokenizers import Tokenizer, pre_tokenizers

        self.cache_words = cache_words
        path = tokenizer if "/" in tokenizer else public_tokenizers.path(tokenizer)
        self.tokenizer = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.tokenizer.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        self.final[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.cores: dict[str, bytes] = {}
        self.others: dict[str, bytes] = {"": b""}

    def whole(self, words: list[str]) -> list[bytes]:
        """Ids of any words."""
        import numpy as np

        known = self.others
        new = [w for w in dict.fromkeys(words) if w not in known]
        for w, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
            known[w] = np.array(e.ids, "<u4").tobytes()
        return [known[w] for w in words]

    def letters(self, words: list[str]) -> list[bytes]:
        """Ids of different words of small Latin letters."""
        import numpy as np

        found = list(map(self.cores.get, words))
        at = [i for i, x in enumerate(found) if x is None]
        for i in range(0, len(at), self.RUN):
            part = at[i:i + self.RUN]
            run = [words[k] for k in part]
            ids = np.array(self.plain.encode(" ".join(run), add_special_tokens=False).ids, "<u4")
            raw, cuts = ids.tobytes(), (4 * np.flatnonzero(self.final[ids]) + 4).tolist()
            for k, w, x, y in zip(part, run, [0, *cuts], cuts, strict=False):
                self.cores[w] = found[k] = raw[x:y]
        return found

    def unique(self, words) -> list[bytes]:
        """Ids of the different words of a batch (an Arrow array)."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        cores = pc.ascii_rtrim(pc.ascii_lower(words), characters=self.PUNCTUATION)
        plain = pc.match_substring_regex(cores, pattern=self.PLAIN).to_numpy(zero_copy_only=False)
        tail = pc.subtract(pc.binary_length(words), pc.binary_length(cores)).to_numpy()
        coded = cores.filter(pa.array(plain)).dictionary_encode()
        ids = self.letters(coded.dictionary.to_pylist())
        out: list = [None] * len(words)
        for i, k in zip(np.flatnonzero(plain).tolist(), coded.indices.to_numpy().tolist(), strict=True):
            out[i] = ids[k]
        ended = np.flatnonzero(plain & (tail > 0))
        ends = [w[-n:] for w, n in zip(words.take(pa.array(ended)).to_pylist(), tail[ended].tolist(), strict=True)]
        for i, x in zip(ended.tolist(), self.whole(ends), strict=True):
            out[i] += x
        rest = np.flatnonzero(~plain)
        for i, x in zip(rest.tolist(), self.whole(words.take(pa.array(rest)).to_pylist()), strict=True):
            out[i] = x
        return out

    def encode(self, texts) -> list[bytes]:
        """Little-endian 32-bit ids of each text.  A batch's words are numbered
        by Arrow, each different one is looked up once, and the ids are put
        together by numbers."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(texts):
            return []
        if len(self.cores) + len(self.others) > self.cache_words:
            self.clear()
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        found = self.unique(coded.dictionary)
        pool = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), np.int64, len(found)) // 4
        start = np.cumsum(size) - size
        number = coded.indices.to_numpy()
        own = size[number]
        ends = np.cumsum(own)
        ids = pool[np.repeat(start[number] - (ends - own), own) + np.arange(ends[-1])]
        bounds = np.r_[0, ends][parts.offsets.to_numpy() - parts.offsets[0].as_py()].tolist()
        return [ids[a:b].tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]


def assign(lengths: list[int], sequence: int = SEQUENCE, linear: float = LINEAR,
           quadratic: float = QUADRATIC) -> tuple[list[tuple[int, int, int, int, int]], list[int]]:
    """Deals out items of at most ``sequence`` tokens.

    Returns the pieces ``(item, start, length, sequence, offset)`` and the
    length of each sequence: as many full ones as the tokens fill, then powers
    of two for the rest."""
    import numpy as np

    total = sum(lengths)
    sizes = [sequence] * (total // sequence) + [1 << b for b in range(sequence.bit_length(), -1, -1) if total % sequence >> b & 1]
    room, cost, used = np.array(sizes, np.int64), np.zeros(len(sizes)), [0] * len(sizes)
    pieces, left = [], []

    def put(item: int, start: int, n: int, at: int) -> None:
        pieces.append((item, start, n, at, used[at]))
        used[at] += n
        room[at] -= n
        cost[at] += piece_cost(n, linear, quadratic)

    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[item]
        fits = np.flatnonzero(room >= n)
        if len(fits):
            put(item, 0, n, int(fits[cost[fits].argmin()]))
        else:
            left.append(item)
    for item in left:
        start = 0
        while start < lengths[item]:
            open_ = np.flatnonzero(room)
            at = int(open_[cost[open_].argmin()])
            n = min(int(room[at]), lengths[item] - start)
            put(item, start, n, at)
            start += n
    return pieces, sizes


def pack(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = END_ID, sequence: int = SEQUENCE,
         group_tokens: int = GROUP_TOKENS, linear: float = LINEAR, quadratic: float = QUADRATIC,
         keep_ids: bool = False, cache_words: int = CACHE_WORDS) -> DataFrame:
    """One row per piece of a document in a sequence (see ``SCHEMA``).  With
    ``keep_ids`` the piece's ids follow as little-endian 32-bit words.  A task
    remembers the ids of about ``cache_words`` words at a time."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        encoder, end = WordEncoder(tokenizer, cache_words), end_id.to_bytes(4, "little")
        group, tokens, next_id = [], 0, TaskContext.get().partitionId() << 40

        def rows(found):
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "piece_cost", "sequence_length"] + ["ids"] * keep_ids
            kinds = [pa.int64()] * 7 + [pa.float64(), pa.int64()] + [pa.binary()] * keep_ids
            columns = list(zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        def flush():
            nonlocal next_id, group, tokens
            found = []

            def piece(doc, ids, start, n, at, offset, size):
                cut = ids[4 * start:4 * (start + n)]
                found.append((doc, start, n, zlib.crc32(cut), len(ids) // 4, at, offset, piece_cost(n, linear, quadratic), size) + (cut,) * keep_ids)

            rests = []
            for doc, ids in group:
                n = len(ids) // 4
                for start in range(0, n - sequence + 1, sequence):
                    piece(doc, ids, start, sequence, next_id, 0, sequence)
                    next_id += 1
                rests.append(n // sequence * sequence)
            live = [i for i, (_, ids) in enumerate(group) if len(ids) // 4 > rests[i]]
            pieces, sizes = assign([len(group[i][1]) // 4 - rests[i] for i in live], sequence, linear, quadratic)
            for item, start, n, at, offset in pieces:
                doc, ids = group[live[item]]
                piece(doc, ids, rests[live[item]] + start, n, next_id + at, offset, sizes[at])
            next_id += len(sizes)
            group, tokens = [], 0
            return rows(found)

        for batch in batches:
            for doc, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1)), strict=True):
                group.append((doc, ids + end))
                tokens += len(ids) // 4 + 1
                if tokens >= group_tokens:
                    yield flush()
        if group:
            yield flush()
        encoder.clear()

    return doc_text(docs).mapInArrow(trimmed(run), SCHEMA + ", ids binary" * keep_ids)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return pack(read_table(spark, sf_dir, "documents"))
