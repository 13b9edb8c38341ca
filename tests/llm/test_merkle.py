import hashlib
import random

import pytest

from pyspark.sql import functions as F

from tidings.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def siblings(tree, i):
    found = []
    for level in tree[:-1]:
        found += level[i ^ 1:(i ^ 1) + 1]
        i //= 2
    return found


def leaf(doc_id, source, lang, n_chars, text):
    return h(*("-" if x is None else f"{len(str(x).encode())}:{x}" for x in (doc_id, source, lang, n_chars, text)))


def brute(rows):
    """Rows (doc_id, lang, leaf, subroot, root, witness) by plain lists."""
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        mine = sorted(((r[0] is not None, r[0] or 0, leaf(*r), r[0]) for r in rows if r[2] == lang))
        trees.append((lang, mine, levels([x[2] for x in mine])))
    top = levels([t[2][-1][0] for t in trees])
    return sorted((str(x[3]), str(lang), x[2], tree[-1][0], top[-1][0], "".join(siblings(tree, i) + siblings(top, k)))
                  for k, (lang, mine, tree) in enumerate(trees) for i, x in enumerate(mine))


def make(spark, rows, partitions=4):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, tree int").repartition(partitions)


def some(n, seed=0, langs=("en", "fr", None, "é", "Z", "")):
    r = random.Random(seed)
    return [(None if r.random() < 0.02 else r.randint(0, 2 * n), r.choice(["s", None, "ü:"]), r.choice(langs), r.choice([None, r.randint(0, 99), 2**63 - 1]), r.choice([None, "", "a:b", "漢字" * r.randint(0, 50)])) for _ in range(n)]


def found(df):
    return sorted((str(r["doc_id"]), str(r["lang"]), *(bytes(r[c]).hex() for c in ("leaf", "subroot", "root", "witness"))) for r in df.collect())


@pytest.mark.parametrize("bits", [1, 2, 3, 10])
def test_equals_plain_lists(spark, bits):
    rows = some(83, bits)
    rows += rows[:5]  # repeated rows
    got = merkle.manifest(make(spark, rows), bits=bits)
    assert found(got) == brute(rows)
    assert all(r["folded_root"] == r["root"] for r in got.collect())


def test_one_tree_of_every_small_size(spark):
    for n in (1, 2, 3, 5, 8, 9):
        rows = [(i, "s", "en", i, "t") for i in range(n)]
        assert found(merkle.manifest(make(spark, rows, 2), bits=1)) == brute(rows)


def test_many_trees_and_a_hot_one(spark):
    rows = [(i, "s", "en", i, "t") for i in range(150)] + [(i, "s", f"l{i}", i, "t") for i in range(70)]
    assert found(merkle.manifest(make(spark, rows), bits=2)) == brute(rows)


def test_tampering_shows_in_its_rows_only(spark):
    rows = [r for r in some(60, 5)]
    changed = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False)) & F.col("n_chars").isNotNull()
    for r in merkle.manifest(make(spark, rows), changed, bits=2).join(make(spark, rows).select("doc_id", "n_chars").distinct(), "doc_id").collect():
        if r["doc_id"] % 3:
            assert r["folded_root"] == r["root"]
    ids = {r[0] for r in rows if r[0] is not None and r[0] % 3 == 0 and all(x[3] is not None for x in rows if x[0] == r[0])}
    got = merkle.manifest(make(spark, rows), changed, bits=2).collect()
    assert ids and all((r["folded_root"] == r["root"]) == (r["doc_id"] not in ids) for r in got if r["doc_id"] in ids or r["doc_id"] is None or r["doc_id"] % 3)


def test_appender_extends_witnesses():
    digests = [hashlib.sha256(bytes([i])).digest() for i in range(37)]
    for n in range(1, 38):
        tree = levels([d.hex() for d in digests[:n]])
        a = merkle.Appender()
        for i, d in enumerate(digests[:n]):
            a.append(d)
            assert len(a.open) == bin(i + 1).count("1")  # one open subtree for each bit
        assert a.close().hex() == tree[-1][0]
        for i, w in enumerate(a.witnesses):
            assert bytes(w).hex() == "".join(siblings(tree, i))
            assert merkle.fold(digests[i], bytes(w), i, n).hex() == tree[-1][0]
            assert merkle.fold(digests[i - 1], bytes(w), i, n).hex() != tree[-1][0] or n == 1 or digests[i - 1] == digests[i]


def test_empty(spark):
    assert merkle.manifest(make(spark, [], 1)).collect() == []
