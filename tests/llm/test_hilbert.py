import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from tidings.llm.hilbert import hilbert_index, ordered_number, shard, string_cuts


def test_curve_visits_neighbours(spark):
    for n, bits in ((2, 3), (3, 3), (4, 2)):
        names = [f"c{i}" for i in range(n)]
        cells = spark.range(1 << n * bits).select(*[F.expr(f"cast(shiftright(id, {bits * i}) & {(1 << bits) - 1} as int)").alias(c) for i, c in enumerate(names)])
        rows = sorted((r["h"], *[r[c] for c in names]) for r in cells.select("*", hilbert_index([F.col(c) for c in names], bits).alias("h")).collect())
        assert [r[0] for r in rows] == list(range(1 << n * bits))
        assert all(sum(abs(a - b) for a, b in zip(x[1:], y[1:])) == 1 for x, y in zip(rows, rows[1:]))


def test_ordered_number(spark):
    got = spark.createDataFrame([("",), ("a",), ("ab",), ("b",), ("é",), (None,)], "x string").select("x", ordered_number(F.col("x")).alias("n")).collect()
    assert [r.x for r in sorted(got, key=lambda r: r.n)] == [None, "", "a", "ab", "b", "é"]


def check(rows, docs, shards):
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in docs)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r["size"], r.text_crc32) for r in rows) == want
    slots, sizes, last = defaultdict(list), defaultdict(int), defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r.slot)
        sizes[r["shard"]] += r["size"]
        last[r["shard"]].append(r.cell)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    at = -1
    for s in sorted(last):  # runs of the curve
        assert min(last[s]) >= at
        at = max(last[s])
    return sizes


def test_shards(make_docs, odd_rows, words):
    check(shard(make_docs(odd_rows)).collect(), odd_rows, 40)
    many = [(i, words(20 + i % 50, i)) for i in range(1200)] + [(2000 + i, words(60, 1)) for i in range(600)]  # a third are copies
    sizes = check(shard(make_docs(many), shards=8).collect(), many, 8)
    mean = sum(sizes.values()) / 8
    assert len(sizes) == 8 and max(sizes.values()) < 1.03 * mean and min(sizes.values()) > 0.97 * mean


def test_small_groups_stay_together(make_docs, words):
    docs = [(i, words(30, i // 3)) for i in range(3000)]
    rows = shard(make_docs(docs), shards=8).collect()
    home = defaultdict(set)
    for r in rows:
        home[r.text_crc32].add(r["shard"])
    assert all(len(x) == 1 for x in home.values())


def test_sources_with_a_common_prefix(make_docs, words):
    """Sources and their cut points are compared whole."""
    sources = [f"https://example.org/{i:02}" for i in range(16)]
    docs = make_docs([(i, words(30, i)) for i in range(640)]).withColumn("source", F.array_join(F.array(F.lit("https://example.org/"), F.lpad((F.col("doc_id") % 16).cast("string"), 2, "0")), ""))
    assert string_cuts(docs, "source", 16) == sources[:15]
    rows = shard(docs, {"source": F.col("source")}, shards=8, whole=0).collect()
    home = defaultdict(set)
    for r in rows:
        home[r.cell].add(r.doc_id % 16)
    assert len(home) == 15 and sorted(map(len, home.values())) == [1] * 14 + [2]
    cells = defaultdict(set)
    for r in shard(docs, shards=8).collect():
        cells[r.doc_id % 16].add(r.cell)
    assert len(set(map(frozenset, cells.values()))) > 8  # by default too
    nulls = docs.withColumn("source", F.when(F.col("doc_id") % 16 > 7, F.col("source")))
    assert string_cuts(nulls, "source", 16) == sources[8:15]


def test_empty(make_docs):
    assert shard(make_docs([])).count() == 0


def test_group_below_what_a_shard_may_deviate(make_docs, words):
    """Equal texts that have 3 % (and 9 %) of a shard's bytes each stay in one
    shard; one of 30 % is cut."""
    docs = [(i, words(30, i)) for i in range(1600)]  # 200 rows a shard
    for g, n in enumerate([6] * 12 + [18] * 8 + [60]):
        docs += [(10_000 * (g + 1) + 37 * k, words(30, 7000 + g)) for k in range(n)]
    home = defaultdict(set)
    rows = shard(make_docs(docs), shards=8).collect()
    for r in rows:
        home[r.text_crc32].add(r["shard"])
    size = check(rows, docs, 8)
    mean = sum(size.values()) / 8
    assert all(0.9 * mean < s < 1.1 * mean for s in size.values())
    crc = [zlib.crc32(words(30, 7000 + g).encode()) for g in range(21)]
    assert all(len(home[c]) == 1 for c in crc[:20])


def index_of(point, bits):
    """A cell's place on the curve by following the curve itself: from cell to
    cell through the tables' corners, without Spark."""
    from tidings.llm.hilbert import curve_states
    n = len(point)
    ranks, states = curve_states(n)
    index = state = 0
    for i in reversed(range(bits)):
        corner = sum((x >> i & 1) << j for j, x in enumerate(point))
        index, state = index << n | ranks[state << n | corner], states[state << n | corner]
    return index


def test_shards_equal_a_plain_version(spark, make_docs, odd_rows, words):
    """Quantiles, cells, order, runs and cuts by sorted lists."""
    import hashlib
    import random

    r = random.Random(3)
    docs = [(i, words(r.randint(1, 60), r.randint(0, 150))) for i in range(500)] + [(1000 + n, t) for n, (_, t) in enumerate(odd_rows)]
    meta = {i: (r.choice(["en", "de", None, "fr"]), r.choice(["a", "b", "c", None])) for i, _ in docs}
    ids = {i for i, _ in docs}
    frame = spark.createDataFrame([(i, t, *meta[i]) for i, t in docs], "doc_id long, text string, lang string, source string")
    bits, shards, whole = 2, 6, 0.1
    size = lambda t: len((t or "").encode()) + 16

    def cut_points(values):
        """Values at which a quantile lies: those that hold the first row of it."""
        values = sorted(values, key=lambda v: (v is not None, v if not isinstance(v, str) else v.encode()))
        parts, out, at = 1 << bits, [], 0
        for v in dict.fromkeys(values):
            n = values.count(v)
            if v is not None and min((at + n) * parts // len(values), parts - 1) > min(at * parts // len(values), parts - 1):
                out.append(v)
            at += n
        return out

    sizes = sorted(size(t) for _, t in docs)
    number_cuts = sorted({sizes[max(0, -(-len(sizes) * k // (1 << bits)) - 1)] for k in range(1, 1 << bits)})
    lang_cuts, source_cuts = cut_points([meta[i][0] for i, _ in docs]), cut_points([meta[i][1] for i, _ in docs])
    over = lambda v, cuts: 0 if v is None else sum((c.encode() if isinstance(c, str) else c) <= (v.encode() if isinstance(v, str) else v) for c in cuts)
    key = lambda t: hashlib.md5((t or "").encode()).hexdigest()
    groups = defaultdict(list)
    for i, t in docs:
        groups[key(t)].append((i, over(meta[i][0], lang_cuts), over(meta[i][1], source_cuts), over(size(t), number_cuts), size(t)))
    total = sum(sizes)
    hashes = {x["doc_id"]: x["h"] for x in frame.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    rows = []
    for k, members in groups.items():
        first = min(members, key=lambda m: m[:4])
        cell, bulk = index_of(first[1:4], bits), sum(m[4] for m in members)
        small = bulk <= int(whole * total / shards)
        rows += [(cell, k, 0 if small else hashes[m[0]], m[0], m[4], bulk if small else None) for m in members]
    rows.sort()
    want, at, start, heads = {}, 0, {}, {}
    for n, (cell, k, _, i, s, bulk) in enumerate(rows):
        start.setdefault(k, at)
        middle = start[k] + bulk / 2 if bulk is not None else at + s / 2
        home = min(int(middle * shards // total), shards - 1)
        heads.setdefault(home, n)
        want[i] = (home, n - heads[home], cell)
        at += s
    got = shard(frame, bits=bits, shards=shards, whole=whole).collect()
    assert len(ids) == len(got) and {x.doc_id: (x["shard"], x.slot, x.cell) for x in got} == want
