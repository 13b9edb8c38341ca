import random

import numpy as np
import pytest

from tidings.llm import neardup
from tidings.llm.neardup import BUCKETS, Sampler, Shingles, components, near_duplicates, similarity


def weighted(texts):
    import xxhash
    n = np.zeros(BUCKETS, np.int64)
    for t in texts:
        for w in set(neardup.WORD.findall(t.lower())):
            n[xxhash.xxh64_intdigest(w) % BUCKETS] += 1
    return list(Shingles(len(texts), n).of(texts))


def edit(text, share, seed):
    r = random.Random(seed)
    w = text.split()
    at = r.randrange(len(w))
    w[at:at + max(1, int(share * len(w)))] = [f"new{seed}x{i}" for i in range(max(1, int(share * len(w))))]
    return " ".join(w)


def test_similarity_against_dictionaries(words):
    texts = [words(60, 1), edit(words(60, 1), 0.2, 3), words(4, 5), "a a a a a a a b"]
    sets = [dict(zip(s.tolist(), w.tolist())) for s, w in weighted(texts)]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            want = sum(min(a.get(k, 0), b.get(k, 0)) for k in a.keys() | b.keys()) / sum(max(a.get(k, 0), b.get(k, 0)) for k in a.keys() | b.keys())
            assert similarity(weighted(texts)[i], weighted(texts)[j]) == pytest.approx(want, abs=1e-5)


def test_samples_agree_as_often_as_the_similarity(words):
    base = words(300, 7)
    sampler = Sampler(2000)
    for share in (0.05, 0.2, 0.5):
        a, b = weighted([base, edit(base, share, 1)])
        assert (sampler(*a) == sampler(*b)).mean() == pytest.approx(similarity(a, b), abs=0.05)


def test_components(spark):
    r = random.Random(1)
    edges = [(f"n{a:03}", f"n{b:03}") for a, b in ((r.randrange(150), r.randrange(150)) for _ in range(110)) if a != b] + [(f"p{i:03}", f"p{i + 1:03}") for i in range(60)]
    home = {x: x for e in edges for x in e}
    def find(x):
        while home[x] != x:
            x = home[x]
        return x
    for a, b in edges:
        a, b = find(a), find(b)
        home[max(a, b)] = min(a, b)
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for x in home}


def brute(docs):
    """Groups by links of every pair of different texts."""
    texts = sorted({t or "" for _, t in docs})
    every = [t or "" for _, t in docs]
    sets = dict(zip(every, weighted(every)))
    home = {t: t for t in texts}
    def find(x):
        while home[x] != x:
            x = home[x]
        return x
    links = {t: 0 for t in texts}
    for i, a in enumerate(texts):
        for b in texts[:i]:
            if similarity(sets[a], sets[b]) >= 0.8:
                links[a] += 1
                links[b] += 1
                home[find(a)] = find(b)
    key = lambda d: -1 << 63 if d is None else d
    first = {}
    for d, t in docs:
        g = find(t or "")
        first[g] = min(first.get(g, (key(d), d)), (key(d), d), key=lambda x: x[0])
    return {(d, t or ""): first[find(t or "")][1] for d, t in docs}


@pytest.fixture(scope="module")
def case(words, odd_rows):
    r = random.Random(3)
    docs = list(odd_rows)
    for g in range(12):
        base = words(r.randint(60, 200), 900 + g)
        docs += [(1000 + 20 * g + i, edit(base, r.choice([0.01, 0.03, 0.3]), 50 * g + i) if i else base) for i in range(r.randint(1, 8))]
    hub = words(200, 999)  # copies are nearer to the base than to each other
    docs += [(2000, hub)] + [(2001 + i, edit(hub, 0.07, 7000 + i)) for i in range(120)]
    docs += [(3000 + i, words(100, 77)) for i in range(60)] + [(3100, words(100, 77).upper()), (3200, "four words are here"), (3201, "Four words, are here!"), (3202, "three words are")]
    return docs


def test_groups_against_brute_force(make_docs, case):
    rows = near_duplicates(make_docs(case)).collect()
    import hashlib
    want = {(d, hashlib.md5(t.encode()).hexdigest()): g for (d, t), g in brute(case).items()}
    assert {(r.doc_id, r.node): r.group_id for r in rows} == want
    assert len(rows) == len(case)
    equal = {}
    for d, t in case:
        equal.setdefault(hashlib.md5((t or "").encode()).hexdigest(), []).append(d)
    for r in rows:
        ids = [x for x in equal[r.node] if x is not None]
        assert r.class_id == (min(ids) if ids else None)


def test_large_buckets_in_blocks(make_docs, case, monkeypatch):
    """With buckets and partners cut into small blocks the groups are the same."""
    monkeypatch.setattr(neardup, "GROUP", 3)
    monkeypatch.setattr(neardup, "BLOCK", 7)
    part = [d for d in case if d[0] is not None and (d[0] < 1100 or 2000 <= d[0] < 2040)]
    rows = near_duplicates(make_docs(part)).collect()
    got = {(r.doc_id, r.group_id) for r in rows}
    assert got == {(d, g) for (d, _), g in brute(part).items()}


def test_pairs_that_meet_are_verified(spark, words):
    """Whatever share of the samples agrees; only a bucket shared in an earlier
    band leaves a pair to that bucket."""
    base = words(300, 5)
    texts = [base, edit(base, 0.02, 1)]
    shingles = Shingles(2, np.ones(BUCKETS, np.int64))
    assert similarity(*shingles.of(texts)) >= 0.8
    text = spark.createDataFrame([("a", texts[0]), ("b", texts[1])], "node string, text string")
    totals = [float(w.sum(dtype=np.float64)) for _, w in shingles.of(texts)]

    def links(band, bands):
        rows = [(99, band, 1, node, node, t, None, h, [1] * 30 + [x] * 26) for node, t, h, x in zip("ab", totals, bands, (1, 2))]
        rows = spark.createDataFrame(rows, "bucket long, band int, blocks int, node string, label string, total double, near double, bands array<long>, sample array<tinyint>")
        return {(r.a, r.b) for r in neardup.across(rows, text, shingles).collect()}

    apart = [[100 * k + i for i in range(14)] for k in (1, 2)]
    for b in apart:
        b[3] = 99
    assert links(3, apart) == {("a", "b")}
    for b in apart:
        b[1] = 7
    assert links(3, apart) == set()


def test_empty(make_docs):
    assert near_duplicates(make_docs([])).count() == 0
    assert [r.first for r in near_duplicates(make_docs([(1, ""), (2, None)])).collect()].count(True) == 1
