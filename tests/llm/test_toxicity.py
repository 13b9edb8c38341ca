import random
import zlib

import numpy as np
import pytest

from tidings.llm import toxicity
from tidings.llm.toxicity import Logistic, evidence_tables, fit, score


@pytest.fixture(scope="module")
def case(words):
    r = random.Random(6)
    docs, labels = [], []
    for i in range(900):
        w = words(r.randint(5, 150), i).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(r.randint(2, 6)):
                w.insert(r.randrange(len(w) + 1), r.choice(["Vilest", "vilescum", "scumbag,", "vileon", "rotter"]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark, make_docs, case):
    docs, labels = case
    table = make_docs(docs + [(2000, None), (2001, ""), (None, "vilest scum"), (5, docs[5][1])])
    marks = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    scorer = fit(table, marks)
    rows = {r.doc_id: r for r in score(table, scorer).collect()}
    held = [(rows[i]["__toxicity"], t) for i, t in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    right = sum((s >= 0.5) == bool(t) for s, t in held) / len(held)
    assert right > 0.95
    assert rows[2000]["__toxicity"] == rows[2001]["__toxicity"] < 0.5 and 0 <= min(s for s, _ in held) <= max(s for s, _ in held) <= 1


def brute(counts, order, d):
    """Kneser-Ney by dictionaries: class counts over shared continuation counts."""
    own = [{}, {}]
    for w, *c in counts:
        s = f"^{w}$"
        for j in range(1, len(s)):
            g = s[max(0, j - order + 1):j + 1]
            for k in (0, 1):
                own[k][g] = own[k].get(g, 0) + c[k]
    grams = set(own[0]) | set(own[1])
    shared, level = {}, {g for g in grams if len(g) == order}
    for n in range(order - 1, 0, -1):
        here = {}
        for g in level:
            here[g[1:]] = here.get(g[1:], 0) + 1
        for g in grams:
            if len(g) == n and g[0] == "^":
                here[g] = here.get(g, 0) + own[0].get(g, 0) + own[1].get(g, 0)
        shared.update(here)
        level = set(here)

    def low(g):
        same = [v for x, v in shared.items() if len(x) == len(g) and x[:-1] == g[:-1]]
        if len(g) == 1:
            return shared[g] / sum(same)
        return (shared[g] - d + d * len(same) * low(g[1:])) / sum(same)

    def p(k, g):
        after = [v for x, v in own[k].items() if x[:-1] == g[:-1] and v]
        if not after:
            return low(g[1:])
        return (max(own[k].get(g, 0) - d, 0) + d * len(after) * low(g[1:])) / sum(after)

    return {g: np.log(p(1, g) / p(0, g)) for g in grams}


def test_tables_against_dictionaries(spark):
    counts = [("abba", 3, 0), ("abca", 1, 2), ("bad", 0, 5), ("b", 2, 2), ("cab", 4, 1), ("abbey", 0, 1)]
    grams, past = evidence_tables(spark.createDataFrame(counts, "word string, c0 long, c1 long"), 4, 0.8)
    got = {r.g: r.value for r in grams.collect()}
    want = brute(counts, 4, 0.8)
    assert got.keys() == want.keys() and all(got[g] == pytest.approx(want[g]) for g in want)
    evidence = {r.h: r.value for r in past.collect()}
    assert evidence["^b"] == pytest.approx(np.log(0.8 * 2 / 7) - np.log(0.8 * 1 / 2))


def test_evidence_sums_letters(spark):
    counts = [("abba", 3, 0), ("abca", 1, 2), ("bad", 0, 5)]
    tables = [dict(map(tuple, t.collect())) for t in evidence_tables(spark.createDataFrame(counts, "word string, c0 long, c1 long"), 4, 0.8)]
    arrays = []
    for t in tables:
        keys = toxicity.keys_of(list(t), 4)
        arrays.append((np.sort(keys), np.array(list(t.values()))[np.argsort(keys)]))
    e = toxicity.Evidence(*arrays, 4)
    e.learn(["abba", "bax", "zz", "abcab"])
    for w, got in e.known.items():
        s, want = f"^{w}$", 0.0
        for j in range(1, len(s)):
            g = s[max(0, j - 3):j + 1]
            want += tables[0].get(g, tables[1].get(g[:-1], 0.0))
        assert got == pytest.approx(want)


def test_logistic():
    r = np.random.RandomState(0)
    x = r.randn(500, 2)
    y = (x[:, 0] + 0.1 * r.randn(500) > 1).astype(float)
    assert ((Logistic(x, y)(x) >= 0.5) == y).mean() > 0.95


def test_one_class_and_empty(spark, make_docs, case):
    docs = make_docs(case[0][:20])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["__toxicity"] for r in score(docs, fit(docs, none)).collect()} == {0.0}
    ones = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, toxic int")
    assert {r["__toxicity"] for r in score(docs, fit(docs, ones)).collect()} == {1.0}
    assert score(make_docs([]), fit(make_docs([]), ones)).count() == 0
