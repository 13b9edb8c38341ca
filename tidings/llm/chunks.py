"""Documents in chunks of bounded size, and arrays that chunks exchange with
hash-split shards.

Per-token work that must meet across documents (counts of n-grams, repeats) is
done on arrays: a chunk sends each shard one array of what it has there,
distinct and sorted, and gets one array back.  A key that is frequent costs one
entry per chunk, so no shard grows with a hot key's rows.

Chunks are numbered by partition and order of rows, so ``docs`` must read the
same rows in the same partitions each time, as a scan of files does.  Both
sides carry a checksum of the chunk, and a mismatch stops the job.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

CHUNK_BYTES = 8 << 20


def chunks(batches, size: int = CHUNK_BYTES) -> Iterator[tuple[int, list[tuple[int, str]]]]:
    """(chunk, [(doc_id, text), ...]) of a partition's Arrow batches."""
    from pyspark import TaskContext

    number, rows, held = TaskContext.get().partitionId() << 32, [], 0
    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            rows.append((doc, text))
            held += len(text)
            if held >= size:
                yield number, rows
                number, rows, held = number + 1, [], 0
    if rows:
        yield number, rows


def with_chunks(docs: DataFrame, size: int = CHUNK_BYTES) -> DataFrame:
    """``(chunk, place, doc_id, text)`` of the same chunks."""

    def run(batches):
        import pyarrow as pa

        for number, rows in chunks(batches, size):
            for i in range(0, len(rows), 500):
                part = rows[i:i + 500]
                yield pa.RecordBatch.from_arrays([pa.array([number] * len(part), pa.int64()), pa.array(range(i, i + len(part)), pa.int32()), pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.string())], ["chunk", "place", "doc_id", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, "chunk long, place int, doc_id long, text string")


def word_numbers(texts, lower: bool = True):
    """Words (lower-cased A-Z, or unchanged) of all texts, numbered by Arrow:
    the number of each word one text after the other, how many each text has,
    and the 64-bit hash of every number's word."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    texts = pa.array(texts, pa.large_string())
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = parts.flatten().dictionary_encode()
    number, ends = coded.indices.to_numpy().astype(np.int64), parts.offsets.to_numpy()
    words = coded.dictionary.to_pylist()
    real = np.ones(len(number), bool)
    if "" in words:  # before and after white space at a text's ends
        real = number != words.index("")
    sizes = np.diff(np.r_[0, np.cumsum(real)][ends - ends[0]])
    hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in words), np.uint64, len(words))
    return number[real], sizes, hashes


def mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def cuts(sorted_keys, shards: int):
    """Bounds of the shards in an array of sorted 64-bit keys: shard s has the
    s-th part of the key range."""
    import numpy as np

    bounds = (np.arange(1, shards, dtype=object) * (1 << 64) // shards).astype(np.uint64)
    return np.r_[0, np.searchsorted(sorted_keys, bounds), len(sorted_keys)]
