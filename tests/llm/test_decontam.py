import random
import re

import pytest

from tidings.llm import decontam
from tidings.llm.decontam import build_index, contamination, phrase_matches, phrases, proximity_matches, ranked_terms

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    wins = {}
    for item, text in items:
        w = words_of(text)
        n = min(len(w), 10)
        for i in range(max(len(w) - 9, 1) if w else 0):
            wins.setdefault(tuple(w[i:i + n]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, found = words_of(text), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i:i + n])) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[k]
        out.append((doc, len(w), len(hit), len(found), sorted(map(str, found))))
    return sorted(out, key=repr)


@pytest.fixture
def case(words, odd_rows):
    r = random.Random(2)
    items = [(i, words(25, 1000 + i)) for i in range(12)] + [(20, "one two three"), (21, "the"), (22, None), (23, "!!"), (24, words(25, 1003)), (25, "of of of of of of of of of of of of")]
    docs = list(odd_rows)
    for i in range(60):
        w = words(r.randint(5, 80), 50 + i).split()
        at, src = r.randrange(len(w)), words(25, 1000 + i % 14).split()
        a = r.randrange(12)
        docs.append((100 + i, " ".join(w[:at] + src[a:a + r.randint(8, 14)] + w[at:]).upper() + ("\n One, two; THREE the é" if i % 3 == 0 else "")))
    docs += [(300, "of " * 40), (301, "of " * 9), (302, "The")]
    return docs, items


@pytest.mark.parametrize("limit", [100_000, 0])
def test_against_brute_force(spark, make_docs, case, limit, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", limit)
    monkeypatch.setattr(decontam, "BROADCAST_DOCUMENTS", limit)
    monkeypatch.setattr(decontam.small, "__defaults__", (limit,))
    docs, items = case
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, phrase int")
    got = contamination(make_docs(docs), bench).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.item_ids) for r in got), key=repr) == brute(docs, items)


def test_proximity(spark, make_docs):
    docs = make_docs([(1, "x delta beta alpha gamma y"), (2, "alpha " + "z " * 30 + "beta gamma delta"), (3, "alpha beta gamma delta")])
    found = phrases(spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string"))
    index = build_index(docs, found.selectExpr("explode(terms) AS word").distinct())
    ranked = ranked_terms(found, index)
    assert {r.doc for r in phrase_matches(index, ranked).collect()} == {3}
    assert {r.doc for r in proximity_matches(index, ranked, slack=4, share=1).collect()} == {1, 3}


def test_proximity_without_the_rarest_term(spark, make_docs):
    """A passage of nine of ten terms is found when the tenth, the rarest, was
    replaced, and when no document has it."""
    one, two = ([f"{x}{i}" for i in range(10)] for x in "pq")
    filler = " ".join(one[1:3] + one[4:] + two[1:])
    docs = make_docs([(1, "x " + " ".join(one[:3] + ["new"] + one[4:])), (2, " ".join(one)), (3, " ".join(["other", *two[1:]]) + " y")] + [(10 + i, " ".join(f"{w} " + "z " * 30 for w in filler.split())) for i in range(3)])
    found = phrases(spark.createDataFrame([(1, " ".join(one)), (2, " ".join(two))], "item_id long, text string"))
    index = build_index(docs, found.selectExpr("explode(terms) AS word").distinct())
    ranked = ranked_terms(found, index)
    assert {r.doc for r in phrase_matches(index, ranked).collect()} == {2}
    assert {(r.doc, r.near) for r in proximity_matches(index, ranked).collect()} == {(1, 9), (2, 10), (3, 9)}
    assert {r.doc for r in proximity_matches(index, ranked, share=1).collect()} == {2}


def test_empty(spark, make_docs, case):
    bench = spark.createDataFrame(case[1], "item_id long, text string")
    assert contamination(make_docs([]), bench).count() == 0
    assert {r.n_hit for r in contamination(make_docs(case[0]), bench.limit(0)).collect()} == {0}
