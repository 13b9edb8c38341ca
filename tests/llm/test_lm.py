import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tidings.llm import lm
from tidings.llm.lm import EliasFano, Trie, discounts, train_and_score


@pytest.mark.parametrize("n,universe", [(0, 5), (1, 1 << 50), (300, 301), (1000, 40), (2000, 1 << 44), (700, 90_000)])
def test_elias_fano(n, universe):
    r = np.random.RandomState(n)
    values = np.sort(r.randint(0, universe, n).astype(np.uint64))
    ef = EliasFano.encode(values, universe)
    probe = np.unique(np.concatenate([values, r.randint(0, universe, 500).astype(np.uint64)]))
    at, same = ef.successor(probe)
    assert (same == np.isin(probe, values)).all()
    again, hit = ef.successor_of_sorted(probe, 97)
    assert (again == np.searchsorted(values, probe)).all() and (hit == same).all()
    if n:
        assert (at[same] == np.searchsorted(values, probe[same])).all()


def test_trie_pointers_and_codes():
    r = random.Random(1)
    pairs = sorted({(r.randrange(50), r.randrange(1 << 40)) for _ in range(3000)})
    keys = np.array([c << 40 | w for c, w in pairs], np.uint64)
    counts = np.array([r.choice([0, 1, 1, 1, 2, 3, 7]) for _ in pairs])
    totals = np.bincount([c for c, _ in pairs], counts, 51).astype(np.int64)
    trie = Trie(np.arange(51, dtype=np.uint64) * np.uint64(977), totals, keys, counts)
    seen = Counter(c for (c, _), n in zip(pairs, counts) if n)
    at = 0
    for c in range(51):
        assert trie.children(c) == (at, at + seen[c])
        at += seen[c]
    d = [0.0, *discounts(counts[counts > 0])]
    got = lm.decoded()[trie.code(keys >> np.uint64(40), keys & np.uint64((1 << 40) - 1))]
    want = np.array([max(n - d[min(n, 3)], 0) / totals[c] if n else 0 for (c, _), n in zip(pairs, counts)])
    assert (np.abs(np.log10(got[counts > 0] / want[counts > 0])) <= 8 / 254 / 2 + 1e-6).all() and not got[counts == 0].any()
    back = [sum(d[min(n, 3)] for (x, _), n in zip(pairs, counts) if x == c and n) / max(totals[c], 1) for c in range(51)]
    assert np.allclose(trie.backoff, back, atol=1e-6)


def brute(docs, folds):
    split = [(i, zlib.crc32(b"" if i is None else str(i).encode()) % folds == 0, re.findall(rb"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode()) + [b" end"]) for i, t in docs]
    one, pair, context = Counter(), Counter(), Counter()
    for _, held, w in split:
        if not held:
            one.update(w)
            pair.update(zip([b" start", *w], w))
            context.update([b" start", *w[:-1]])
    n, v = sum(one.values()), len(one)
    d = [0.0, *lm.discounts(np.array(list(pair.values()) or [0]))]
    back = defaultdict(float)
    for (a, _), c in pair.items():
        back[a] += d[min(c, 3)]
    out = []
    for i, held, w in split:
        base = score = 0
        for a, b in zip([b" start", *w], w):
            p1 = (one[b] + 0.1) / (n + 0.1 * (v + 1))
            base += math.log10(p1)
            c = pair[a, b]
            score += math.log10(p1 if not context[a] else (c - d[min(c, 3)]) / context[a] + back[a] / context[a] * p1)
        out.append((i, held, len(w), sum(one[b] > 0 for b in w), n, base, score))
    return out


@pytest.fixture
def case(words, odd_rows):
    docs = list(odd_rows) + [(100 + i, words(60, i % 25) + " The THE the of " + words(30, 500 + i)) for i in range(120)]
    return docs + [(300, "the " * 500), (301, "</s> <s> the")]


@pytest.mark.parametrize("size,hot", [(1 << 30, 0.01), (2000, 0.01), (3000, 0.0005)])
def test_against_brute_force(spark, make_docs, case, tmp_path, size, hot, monkeypatch):
    monkeypatch.setattr(lm.hot_words, "__defaults__", (hot,))
    monkeypatch.setattr(lm, "HOT_SAMPLE", 1)
    if size < 1 << 30:  # shards estimate their own discounts; fixed ones show the rest
        monkeypatch.setattr(lm, "discounts", lambda counts: [0.6, 1.1, 1.4])
    path = str(tmp_path / "d.parquet")
    make_docs(case, 4).write.parquet(path)
    got = sorted((tuple(r) for r in train_and_score(spark.read.parquet(path), 5, size).collect()), key=lambda r: (str(r[0]), r[2], r[5]))
    want = sorted(brute(case, 5), key=lambda r: (str(r[0]), r[2], r[5]))
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], abs=1e-6)
        assert abs(g[6] - w[6]) <= 0.016 * w[2]


@pytest.mark.parametrize("size", [1500, 2000, 6000])
def test_discounts_of_all_shards(spark, make_docs, case, tmp_path, size):
    """Scores don't depend on the number of shards: no constant is changed."""
    path = str(tmp_path / "d.parquet")
    make_docs(case, 4).write.parquet(path)
    rows = {s: sorted(((r.doc_id, r.n_tokens, r.score) for r in train_and_score(spark.read.parquet(path), 5, s).collect()), key=lambda r: (str(r[0]), r[1], r[2])) for s in (size, 1 << 30)}
    assert len(rows[size]) == len(case)
    for a, b in zip(rows[size], rows[1 << 30]):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-6)


def brute_three(docs, folds):
    split = [(i, zlib.crc32(b"" if i is None else str(i).encode()) % folds == 0, re.findall(rb"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode()) + [b" end"]) for i, t in docs]
    counts = [Counter(), Counter(), Counter()]
    for _, held, w in split:
        if not held:
            t = [b" start", *w]
            counts[0].update((x,) for x in w)
            counts[1].update(zip(t, w))
            counts[2].update(zip(t, w, w[1:]))
    n, v = sum(counts[0].values()), len(counts[0])
    d = [[0.0, *lm.discounts(np.array(list(c.values()) or [0]))] for c in counts]
    total, taken = Counter(), defaultdict(float)
    for k in (1, 2):
        for g, c in counts[k].items():
            total[g[:-1]] += c
            taken[g[:-1]] += d[k][min(c, 3)]

    def chance(g):
        if len(g) == 1:
            return (counts[0][g] + 0.1) / (n + 0.1 * (v + 1))
        lower, of, c = chance(g[1:]), g[:-1], counts[len(g) - 1][g]
        return lower if not total[of] else (c - d[len(g) - 1][min(c, 3)] + taken[of] * lower) / total[of]

    out = []
    for i, held, w in split:
        t = [b" start", *w]
        out.append((i, held, len(w), sum(math.log10(chance(tuple(t[max(0, k - 1):k + 2]))) for k in range(len(w)))))
    return out


@pytest.mark.parametrize("size", [1 << 30, 2000])
def test_three_levels_and_corpus_discounts(spark, make_docs, case, tmp_path, size):
    """With several shards too, as op1 runs it: no constant is changed."""
    path = str(tmp_path / "d.parquet")
    make_docs(case, 4).write.parquet(path)
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.score) for r in train_and_score(spark.read.parquet(path), 5, size, 3).collect()), key=lambda r: (str(r[0]), r[2], r[3]))
    want = sorted(brute_three(case, 5), key=lambda r: (str(r[0]), r[2], r[3]))
    assert [g[:3] for g in got] == [w[:3] for w in want]
    for g, w in zip(got, want):
        assert abs(g[3] - w[3]) <= 0.019 * w[2]


def test_held_out_gain(spark, make_docs, tmp_path):
    r = random.Random(4)
    chain = {w: [r.randrange(80) for _ in range(3)] for w in range(80)}
    docs = []
    for i in range(400):
        w, out = r.randrange(80), []
        for _ in range(100):
            out.append(f"w{w}")
            w = r.choice(chain[w])
        docs.append((i, " ".join(out)))
    path = str(tmp_path / "d.parquet")
    make_docs(docs).write.parquet(path)
    held = [x for x in train_and_score(spark.read.parquet(path)).collect() if x.held_out]
    assert held and all(x.score > 0.5 * x.base_score for x in held)


def test_no_training_rows_and_empty(spark, make_docs, tmp_path):
    a, b = str(tmp_path / "a.parquet"), str(tmp_path / "b.parquet")
    make_docs([(None, "a b c")]).write.parquet(a)
    make_docs([]).write.parquet(b)
    r = train_and_score(spark.read.parquet(a)).collect()[0]
    assert r.held_out and r.n_known == 0 and r.train_tokens == 0 and r.score == pytest.approx(r.base_score)
    assert train_and_score(spark.read.parquet(b)).count() == 0


def test_a_shard_decodes_its_keys_once(spark, make_docs, words, tmp_path, monkeypatch):
    """However many chunks ask it: a second pass over its keys for every chunk
    makes the work grow with the square of the corpus."""
    import pyarrow as pa

    path = str(tmp_path / "d.parquet")
    make_docs([(i, words(80, i)) for i in range(200)], 1).repartition(25).write.parquet(path)
    sent = lm.requests(lm.doc_text(spark.read.parquet(path)), 1, {}, 5, 3).toArrow()
    assert len(sent) > 5  # a chunk a partition
    entries, decoded = [0], lm.EliasFano.decoded

    def counted(self, start, stop):
        out = decoded(self, start, stop)
        entries[0] += len(out[0])
        return out

    monkeypatch.setattr(lm.EliasFano, "decoded", counted)
    answered = pa.Table.from_batches(lm.shard_answers(sent, 1))
    assert answered.column("chunk").to_pylist() == sent.column("chunk").to_pylist()
    assert 0 < entries[0] <= sum(len(b.as_py()) for k in ("counts", "counts3") for b in sent.column(k))
