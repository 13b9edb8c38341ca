"""SimHash and near-duplicate detection against brute force."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from tidings.operators import dedup

TOKEN = re.compile(r"[^\W_]+|_", re.UNICODE)


def py_simhash(text):
    toks = [t for t in re.findall(r"[^\W_]+", text.lower())]
    counts = [0] * 64
    for t in toks:
        h = int(hashlib.md5(t.encode()).hexdigest()[:16], 16)
        for i in range(64):
            counts[i] += 1 if (h >> i) & 1 else -1
    v = sum(1 << i for i in range(64) if counts[i] > 0)
    return v - (1 << 64) if v >= 1 << 63 else v


def test_simhash_matches_python(spark, sf_small):
    docs = spark.read.parquet(f"{sf_small}/documents.parquet").select("doc_id", "text")
    fp = dict(dedup.doc_simhash(docs, "doc_id", "text").collect())
    sample = docs.orderBy("doc_id").collect()
    for r in sample:
        assert fp[r["doc_id"]] == py_simhash(r["text"]), r["doc_id"]


def test_empty_text_is_zero(spark):
    df = spark.createDataFrame([(1, ""), (2, "!!! ...")], "id long, text string")
    assert dict(dedup.doc_simhash(df).collect()) == {1: 0, 2: 0}


def test_bands_unsigned(spark):
    df = spark.createDataFrame([(1, -1), (2, 0x0001000200030004)], "id long, simhash long")
    rows = {r["id"]: r for r in dedup.with_bands(df).collect()}
    assert [rows[1][f"simhash_{k}"] for k in range(1, 5)] == [65535] * 4
    assert [rows[2][f"simhash_{k}"] for k in range(1, 5)] == [4, 3, 2, 1]


def _brute(incoming, existing, threshold=0.6):
    out = set()
    for iid, url, h in incoming:
        for e in existing:
            share = any(((h >> (16 * k)) & 0xFFFF) == ((e >> (16 * k)) & 0xFFFF) for k in range(4))
            if share and 1 - bin((h ^ e) & ((1 << 64) - 1)).count("1") / 64 > threshold:
                out.add(iid)
                break
    return out


def test_near_dup_semi_join_matches_brute_force(spark):
    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(30)]

    def signed(v):
        return v - (1 << 64) if v >= 1 << 63 else v

    existing = [signed(b) for b in base]
    incoming = []
    for i in range(120):
        b = rng.choice(base)
        flips = rng.choice([0, 3, 10, 24, 25, 26, 30, 64])
        v = b
        for bit in rng.sample(range(64), min(flips, 64)):
            v ^= 1 << bit
        incoming.append((i, f"u{i}", signed(v if flips < 64 else rng.getrandbits(64))))
    inc = spark.createDataFrame(incoming, "id long, url string, simhash long")
    ex = spark.createDataFrame([(e,) for e in existing], "simhash long")
    got = {r["id"] for r in dedup.near_dup_urls(inc, ex).collect()}
    assert got == _brute(incoming, existing)
    # every bucket "hot": salted sub-buckets give the same answer
    salted = {r["id"] for r in dedup.near_dup_urls(inc, ex, hot_bucket_rows=1).collect()}
    assert salted == got
    kept = {r["id"] for r in dedup.dedup_content(inc, dedup.near_dup_urls(inc, ex)).collect()}
    assert kept == {i for i, _, _ in incoming} - got


def test_candidates_count_without_pairs(spark):
    ex = spark.createDataFrame([(5,), (5,), (5 | (1 << 40),)], "simhash long")
    inc = spark.createDataFrame([(1, "a", 5)], "id long, url string, simhash long")
    r = dedup.near_dup_candidates(inc, ex.withColumn("url", F.lit("e"))).first()
    # bands 0,1,3 shared by all three rows, band 2 by the two exact copies
    assert (r["band_hits"], r["exact_hits"]) == (11, 2)


def test_simhash_text_round_trip(spark):
    from tidings.functions import simhash as SH
    vals = [0, 1, -1, 2 ** 63 - 1, -(2 ** 63), 123456789]
    df = spark.createDataFrame([(v,) for v in vals], "h long")
    rows = df.select("h", SH.unsigned_text(F.col("h")).alias("t")).select(
        "h", "t", SH.from_text(F.col("t")).alias("back")).collect()
    for r in rows:
        assert r["t"] == str(r["h"] % (1 << 64)) and r["back"] == r["h"]
    odd = spark.createDataFrame([("abc",), ("",), ("-5",)], "t string").select(SH.from_text(F.col("t")).alias("v"))
    assert [r["v"] for r in odd.collect()] == [None, None, -5]


def test_groups_within_a_batch_equal_brute_force(spark):
    from tidings.operators.groups import near_copy_groups
    rng = random.Random(12)
    base = [rng.getrandbits(64) for _ in range(8)] + [0, (1 << 64) - 1]
    rows = []
    for i in range(220):
        v = rng.choice(base)
        for b in rng.sample(range(64), rng.choice([0, 0, 4, 14, 22, 30])):
            v ^= 1 << b
        rows.append((i, f"u{i}", v))
    rows += [(300 + i, "again", rows[i][2]) for i in range(5)]
    group = {v: v for _, _, v in rows}

    def root(v):
        while group[v] != v:
            v = group[v]
        return v

    values = sorted(group)
    for x in values:
        for y in values:
            share = any((x >> 16 * k) & 0xFFFF == (y >> 16 * k) & 0xFFFF for k in range(4))
            if share and 1 - bin(x ^ y).count("1") / 64 > 0.6:
                group[root(x)] = root(y)
    least = {}
    for i, _, v in rows:
        least[root(v)] = min(i, least.get(root(v), i))
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    df = spark.createDataFrame([(i, u, signed(v)) for i, u, v in rows] + [(400, "none", None), (401, "none", None)], "id long, url string, simhash long")
    want = {i: least[root(v)] for i, _, v in rows} | {400: 400, 401: 401}
    assert len(set(want.values())) > 3
    for block in (3, 1000):
        assert {r["id"]: r["group_id"] for r in near_copy_groups(df, block=block).collect()} == want


def test_components_of_chains_and_stars(spark):
    from tidings.operators.groups import components
    rng = random.Random(1)
    chain = list(range(100, 160))
    rng.shuffle(chain)
    edges = list(zip(chain, chain[1:])) + [(5, x) for x in range(6, 60)] + [(200, 201), (201, 200), (300, 300)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: 100 for x in chain} | {x: 5 for x in range(5, 60)} | {200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
