import hashlib
import random
import time

import pytest

from tidings.llm.substr import Chunk, remove_repeats


def brute(docs, k=13):
    first, split = {}, [((-1 << 63 if d is None else d), d, (t or "").encode().split()) for d, t in docs]
    for key, _, w in split:
        for i in range(len(w) - k + 1):
            win = tuple(w[i:i + k])
            first[win] = min(first.get(win, key), key)
    out = []
    for key, d, w in split:
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i:i + k])] < key:
                gone |= set(range(i, i + k))
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def case(words, odd_rows):
    r = random.Random(9)
    docs = list(odd_rows)
    shared = [words(n, 700 + n) for n in (12, 13, 14, 20, 60, 200)]
    for i in range(150):
        parts = [words(r.randint(0, 40), 2000 + i), r.choice(shared), words(r.randint(0, 30), 3000 + i), r.choice(shared)[r.randint(0, 40):], " a b" * r.choice([0, 0, 30])]
        docs.append((100 + i, "\n".join(parts)))
    docs += [(400 + i, docs[20][1]) for i in range(40)] + [(399, "x " * 200), (398, "x " * 13), (397, "x " * 12), (60, "x " * 14)]
    base = words(120, 42).split()
    for i in range(40):  # near copies
        w = list(base)
        w[r.randrange(120)] = "changed"
        docs.append((500 + i, " ".join(w)))
    r.shuffle(docs)
    return docs


@pytest.mark.parametrize("size", [1 << 30, 3000])
def test_against_brute_force(make_docs, case, size, tmp_path, spark):
    path = str(tmp_path / "d.parquet")
    make_docs(case, 5).write.parquet(path)
    got = sorted((tuple(r) for r in remove_repeats(spark.read.parquet(path), shard_bytes=size).collect()), key=repr)
    assert got == brute(case)


def test_empty(make_docs, spark, tmp_path):
    path = str(tmp_path / "d.parquet")
    make_docs([]).write.parquet(path)
    assert remove_repeats(spark.read.parquet(path)).count() == 0


def test_short_texts_cost_no_calls_of_their_own(words):
    """As many words in 2,000 texts take about the time of one text."""
    text = words(80_000, 3).split()
    one, many = [(1, " ".join(text))], [(i, " ".join(text[40 * i:40 * i + 40])) for i in range(2000)]

    def seconds(rows):
        took = []
        for _ in range(5):
            began = time.process_time()
            Chunk(rows, 13, 5)
            took.append(time.process_time() - began)
        return min(took)

    assert seconds(many) < 4 * seconds(one)


def test_anchors_of_texts_side_by_side(words):
    """A text has the same anchors alone and among others, across blocks."""
    import numpy as np

    texts = ["", words(12, 1), words(13, 2), words(40_000, 3), " \n", words(14, 4), "x " * 50, words(300, 5), words(3, 6)] * 2
    c = Chunk(list(enumerate(texts)), 13, 5).anchors
    begin = 0
    for n, text in enumerate(texts):
        alone = Chunk([(n, text)], 13, 5).anchors
        mine = slice(c.starts[n], c.starts[n + 1])
        for x, y in ((c.at, alone.at), (c.first, alone.first), (c.last, alone.last)):
            assert np.array_equal(x[mine] - begin, y)
        assert np.array_equal(c.keys[mine], alone.keys)
        looked = c.text[c.owner] == n
        assert sorted(zip((c.owner[looked] - c.starts[n]).tolist(), c.looked[looked].tolist())) == sorted(zip(alone.owner.tolist(), alone.looked.tolist()))
        begin += len(text.split())
    assert begin == 2 * len(" ".join(texts[:9]).split())
