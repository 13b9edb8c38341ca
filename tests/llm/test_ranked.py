import math
import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from tidings.llm import ranked

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    """Rows (item, rank, id, score) by scoring every document."""
    known = [(i, terms(t)) for i, t in docs if terms(t)]
    n, total = len(known), sum(len(t) for _, t in known)
    df = {}
    for _, t in known:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    weight = {w: math.floor(1000 * math.log((2 * n + 2) / (2 * c + 1))) for w, c in df.items()}
    out = []
    for item, text in items:
        scores = []
        for i, t in known:
            m = 100 - 25 + 25 * len(t) * n // total
            s = sum(weight.get(w, 0) * (1_000_000_000 * t.count(w) // (1000 * t.count(w) + 12 * m)) for w in terms(text))
            if s > 0:
                scores.append((-s, ranked.NO_ID if i is None else i))
        out += [(item, r + 1, None if i == ranked.NO_ID else i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def got(docs, queries, **k):
    return sorted((tuple(r) for r in ranked.best_documents(docs, queries, F.col("item_id"), **k).collect()), key=str)


def items_frame(spark, items):
    return spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, score string")


def pool(words, n, seed=3):
    r = random.Random(seed)
    vocabulary = sorted(set(words(400, 1).split()))
    prose = lambda m: " ".join(r.choice(vocabulary[:40] if r.random() < 0.6 else vocabulary) for _ in range(m))
    docs = [(i, prose(r.randint(1, 60))) for i in range(n)]
    docs += [(n + i, docs[i % 7][1]) for i in range(n // 3)]  # equal texts, equal scores
    return docs, [(i, prose(r.randint(1, 25))) for i in range(12)]


@pytest.mark.parametrize("postings,probes", [(1, 1), (60, 3), (1 << 19, 64)])
def test_equals_scoring_all(spark, make_docs, words, odd_rows, postings, probes):
    docs, items = pool(words, 90)
    docs += [(i + 1000 if i is not None else None, t) for i, t in odd_rows]
    items += [(50, None), (51, ""), (52, "..."), (53, "nobodyhasthis"), (54, items[0][1] + " " + items[0][1].upper()), (None, items[1][1]), (2, items[3][1]), (2, odd_rows[4][1]), (55, "é́ß 漢字")]
    assert got(make_docs(docs, 4), items_frame(spark, items), postings=postings, probes=probes, k=5) == brute(docs, items, 5)


def test_queries_in_blocks(spark, make_docs, words):
    docs, items = pool(words, 50, 9)
    assert got(make_docs(docs), items_frame(spark, items), query_bytes=200, k=3) == brute(docs, items, 3)


def test_common_term_and_large_group_of_copies(spark, make_docs, words):
    docs = [(i, "every document has this " + (words(3, i) if i % 3 else "same")) for i in range(300)]
    items = [(1, "this"), (2, "same every"), (3, "has " + words(3, 7))]
    assert got(make_docs(docs, 5), items_frame(spark, items), postings=100, probes=2, k=20) == brute(docs, items, 20)


def test_empty_tables(spark, make_docs, words):
    assert got(make_docs([], 1), items_frame(spark, [(1, "a b")])) == []
    assert got(make_docs([(1, "a b")]), items_frame(spark, [])) == []
    assert got(make_docs([(1, None), (2, "")]), items_frame(spark, [(1, "a b")])) == []


def segment(seed, n_docs=200, n_terms=12):
    r = random.Random(seed)
    lists = [sorted(r.sample(range(n_docs), r.randint(1, n_docs // 2))) for _ in range(n_terms)]
    places = np.array([d for x in lists for d in x], np.int32)
    impacts = np.array([r.choice([0, 5, 5, r.randint(1, 1000)]) for _ in places], np.int64)
    return ranked.Segment(np.arange(n_docs) * 10, list(range(n_terms)), np.array([len(x) for x in lists]), places, impacts)


def test_largest_is_the_first_maximum():
    s = segment(1)
    low, high = [], []
    for a, b in zip(s.starts, s.ends, strict=True):
        for _ in range(50):
            x, y = sorted(random.Random(int(a) + len(low)).choices(range(int(a), int(b) + 1), k=2))
            low.append(x), high.append(y)
    at, most = s.largest(np.array(low), np.array(high))
    for x, y, i, m in zip(low, high, at, most, strict=True):
        part = s.impacts[x:y]
        assert m == (part.max() if len(part) else 0)
        assert not len(part) or i == x + int(part.argmax())


def test_search_splits_few_documents_and_obeys_the_floor():
    for seed in range(20):
        s = segment(seed)
        query = {t: 1 + t % 2 for t in range(0, 12, 2)}
        scores = np.zeros(200, np.int64)
        for t, q in query.items():
            a, b = s.starts[t], s.ends[t]
            np.add.at(scores, s.places[a:b], s.impacts[a:b] * q)
        best = sorted(((int(x), i) for i, x in enumerate(scores) if x > 0), key=lambda x: (-x[0], x[1]))
        assert sorted(s.search(query, 10), key=lambda x: (-x[0], x[1])) == best[:10]
        floor = best[6]
        assert sorted(s.search(query, 10, (floor[0], floor[1] * 10)), key=lambda x: (-x[0], x[1])) == best[:7]
        assert set(s.search(query, 10, None, 4)) <= set(best)
