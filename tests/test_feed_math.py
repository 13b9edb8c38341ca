"""Feed maths: the reference README's worked examples as goldens, quotas,
the whole-day rule and pruned-vs-unpruned selection."""

import random

import pytest
from pyspark.sql import functions as F

from tidings.functions.common import whole_days, ts_lit
from tidings.functions.feed import interaction_weight, jaccard
from tidings.operators import profile as prof
from tidings.operators import scoring, selection

AS_OF = "2024-01-31 00:00:00"


def _ago(days=0, hours=0):
    return F.lit(AS_OF).cast("timestamp_ntz") - F.make_dt_interval(days=F.lit(days), hours=F.lit(hours))


def test_scoring_example(spark):
    profile = spark.createDataFrame(
        [("rust", 1.00, 0.93, False), ("databases", 0.44, 1.00, False), ("python", 0.22, 0.62, False),
         ("crypto", 0.0, 0.0, True)], "tag string, recent_weight double, long_weight double, hidden boolean")
    posts = spark.createDataFrame(
        [("P1", ["rust", "async"], 1, None), ("P2", ["databases", "sql"], 2, None),
         ("P4", ["machine-learning", "python"], 1, None), ("P3", ["databases", "python"], 3, 1),
         ("P5", ["crypto", "web"], 1, None)], "id string, tags array<string>, scraped int, shown int")
    posts = posts.select("id", "tags",
                         (ts_lit(AS_OF) - F.make_dt_interval(days=F.col("scraped"))).alias("scraped_at"),
                         F.when(F.col("shown").isNotNull(),
                                ts_lit(AS_OF) - F.make_dt_interval(days=F.col("shown"))).alias("last_shown_at"))
    scored = scoring.score_content(posts, profile, AS_OF)
    rows = scoring.ranked_feed(scored).select("id", "score").collect()
    assert [r["id"] for r in rows] == ["P1", "P2", "P4", "P3", "P5"]
    got = {r["id"]: round(r["score"], 2) for r in rows}
    assert got == {"P1": 0.70, "P2": 0.41, "P4": 0.35, "P3": 0.12, "P5": 0.03}


SELECTION_ROWS = [
    ("A", ["rust", "async"], 1.00, 0.50, 0.50, 0.90),
    ("B", ["rust", "tokio"], 0.95, 0.45, 0.55, 0.70),
    ("C", ["databases", "sql"], 0.40, 0.80, 0.20, 0.90),
    ("D", ["databases", "python"], 0.38, 0.75, 0.25, 0.30),
    ("E", ["ml", "python"], 0.20, 0.30, 0.70, 0.95),
    ("F", ["crypto", "web"], 0.05, 0.05, 0.95, 0.80),
]


def _scored_frame(spark, rows, base_day=0):
    df = spark.createDataFrame(rows, "id string, tags array<string>, continuity double, relevance double, "
                                     "novelty double, freshness double")
    df = df.withColumn("interest", 0.5 * F.col("continuity") + 0.2 * F.col("relevance") + 0.3 * F.col("novelty"))
    df = df.withColumn("score", F.col("interest") * F.col("freshness"))
    return df.withColumn("scraped_at", ts_lit(AS_OF))


@pytest.mark.parametrize("prune", [True, False])
def test_selection_example(spark, prune):
    scored = _scored_frame(spark, SELECTION_ROWS)
    picks = selection.pick_order(scored, 4, prune=prune)
    assert [p["id"] for p in picks] == ["A", "C", "E", "F"]
    feed = selection.select_feed(scored, 4, prune=prune).collect()
    assert [r["id"] for r in feed] == ["A", "C", "E", "F"]
    naive = scoring.top_n_by_score(scored, 4).collect()
    assert [r["id"] for r in naive] == ["A", "B", "C", "E"]


@pytest.mark.parametrize("limit,expected", [(1, (0, 0, 0)), (2, (1, 0, 1)), (3, (2, 1, 1)), (4, (2, 1, 1)),
                                            (5, (2, 1, 2)), (10, (5, 2, 3))])
def test_quotas(spark, limit, expected):
    assert tuple(q for _, q in selection.quotas(limit)) == expected
    row = spark.range(1).select(*selection.quota_columns(F.lit(limit))).first()
    assert tuple(row) == expected


def test_whole_days_floor(spark):
    r = spark.range(1).select(
        whole_days(ts_lit("2024-01-03 00:00:00"), ts_lit("2024-01-01 01:00:00")).alias("a"),
        whole_days(ts_lit("2024-01-01 00:00:00"), ts_lit("2024-01-01 01:00:00")).alias("b"),
        F.datediff(ts_lit("2024-01-03 00:00:00"), ts_lit("2024-01-01 01:00:00")).alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == (1, -1, 2)


def test_interaction_weights(spark):
    df = spark.createDataFrame([(t,) for t in ["impression", "open", "read", "like", "bookmark", "share", "hide",
                                                "bogus"]], "type string")
    got = {r["type"]: r["w"] for r in df.select("type", interaction_weight(F.col("type")).alias("w")).collect()}
    assert got == {"impression": 0.1, "open": 1.0, "read": 2.0, "like": 3.0, "bookmark": 3.0, "share": 3.0,
                   "hide": -3.0, "bogus": 0.0}


def test_interactions_collapse_duplicate_tags(spark):
    req = spark.createDataFrame([("c1", "open", ["python", "ai", "python"]), ("c2", "like", [])],
                                "content_id string, type string, tags array<string>")
    ok, rejected = prof.split_interaction_requests(req)
    rows = prof.interaction_rows(ok).collect()
    assert sorted((r["tag"], r["weight"]) for r in rows) == [("ai", 1.0), ("python", 1.0)]
    assert [r["reason"] for r in rejected.collect()] == ["No tags provided"]


def test_profile_normalisation_non_positive_max(spark):
    inter = spark.createDataFrame([("a", "hide", -3.0), ("b", "hide", -3.0)], "tag string, type string, weight double")
    inter = inter.withColumn("created_at", ts_lit(AS_OF))
    rows = {r["tag"]: r for r in prof.tag_profile(inter, AS_OF).collect()}
    assert rows["a"]["recent_weight"] == -3.0 and rows["a"]["hidden"] is True


def test_jaccard(spark):
    r = spark.range(1).select(
        jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c"))).alias("x"),
        jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("y")).first()
    assert r["x"] == pytest.approx(1 / 3) and r["y"] == 0.0


def _check_picks(rows, picks, limit):
    """Each pick beats every row not yet chosen on its own signal, less the
    penalty of its nearest chosen tag set; ties go to the better ranked row;
    buckets come in quota order and no pick is missing."""
    by_id = {r[0]: r for r in rows}
    interest = {r[0]: 0.5 * r[2] + 0.2 * r[3] + 0.3 * r[4] for r in rows}
    value = {"continuity": lambda i: by_id[i][2], "relevance": lambda i: by_id[i][3], "novelty": lambda i: by_id[i][4], "interest": interest.get}

    def worth(i, signal, sets):
        own = set(by_id[i][1])
        near = max([0.0, *(len(own & x) / len(own | x) for x in sets if own | x)])
        return 0.5 * value[signal](i) * by_id[i][5] - 0.5 * near

    assert len(picks) == min(limit, len(rows)) and len({i for i, _ in picks}) == len(picks)
    assert [s for _, s in picks] == selection.pick_schedule(limit)[: len(picks)]
    for n, (i, signal) in enumerate(picks):
        sets = [set(by_id[j][1]) for j, _ in picks[:n]]
        mine = (worth(i, signal, sets), interest[i] * by_id[i][5])
        for j in by_id.keys() - {k for k, _ in picks[:n + 1]}:
            other = (worth(j, signal, sets), interest[j] * by_id[j][5])
            assert other[0] < mine[0] + 1e-12, (i, j)
            if abs(other[0] - mine[0]) < 1e-12 and other[1] != mine[1]:
                assert other[1] < mine[1] + 1e-12, (i, j)


def test_selection_picks_the_best_each_time(spark):
    rng = random.Random(7)
    vocab = ["a", "b", "c", "d", "e"]
    for _ in range(6):
        rows = [(f"p{i:03d}", sorted(rng.sample(vocab, rng.randint(0, 2))), *(round(rng.random(), 3) for _ in range(4)))
                for i in range(rng.randint(5, 40))]
        limit = rng.randint(1, 8)
        picks = selection.pick_order(_scored_frame(spark, rows), limit, prune=True)
        _check_picks(rows, [(p["id"], p["signal"]) for p in picks], limit)


def test_picks_do_not_depend_on_how_many_posts_are_fetched(spark):
    """From one post ahead (all feeds go on to the rounds) to all of them; one
    feed holds most posts, all of one tag set, another's have no tags."""
    rng = random.Random(23)
    vocab = ["a", "b", "c", "d"]
    rows = [(f"f1-{i:03d}", ["a", "b"], *(round(rng.random(), 2) for _ in range(4))) for i in range(60)]
    rows += [(f"f2-{i:03d}", [], *(round(rng.random(), 2) for _ in range(4))) for i in range(20)]
    rows += [(f"f3-{i:03d}", sorted(rng.sample(vocab, rng.randint(0, 3))), *(round(rng.random(), 1) for _ in range(4))) for i in range(40)]
    rows += [(f"f4-{i:03d}", ["x"], 0.5, 0.5, 0.5, 1.0) for i in range(3)]
    scored = _scored_frame(spark, rows).withColumn("feed_id", F.substring("id", 1, 2))
    results = []
    for ahead in (1, 2, 5, 1000):
        got = selection.select_feeds(scored, "feed_id", 5, ahead=ahead, prune=ahead % 2 == 1).collect()
        results.append(sorted((r["feed_id"], r["pick"], r["id"], r["bucket"], r["rank"]) for r in got))
    assert results[0] == results[1] == results[2] == results[3]
    for f in ("f1", "f2", "f3", "f4"):
        mine = [x for x in results[0] if x[0] == f]
        _check_picks([r for r in rows if r[0].startswith(f)], [(x[2], x[3]) for x in mine], 5)


def test_pick_schedule():
    assert selection.pick_schedule(4) == ["continuity", "continuity", "relevance", "novelty"]
    assert selection.pick_schedule(3) == ["continuity", "continuity", "relevance"]
    assert selection.pick_schedule(1) == ["interest"]


def test_many_feeds(spark):
    rng = random.Random(11)
    vocab = ["a", "b", "c", "d"]
    feeds = {f: [(f"{f}-{i:03d}", sorted(rng.sample(vocab, rng.randint(0, 2))), *(round(rng.random(), 3) for _ in range(4)))
                 for i in range(rng.randint(3, 25))] for f in ["f1", "f2", "f3"]}
    scored = _scored_frame(spark, [r for rows in feeds.values() for r in rows]).withColumn("feed_id", F.substring("id", 1, 2))
    for limit in (4, 7):
        many = selection.select_feeds(scored, "feed_id", limit).collect()
        for f, rows in feeds.items():
            mine = sorted((r for r in many if r["feed_id"] == f), key=lambda r: r["pick"])
            _check_picks(rows, [(r["id"], r["bucket"]) for r in mine], limit)
            one = selection.pick_order(scored.where(F.col("feed_id") == f), limit)
            assert [r["id"] for r in mine] == [p["id"] for p in one]


def test_serialize_and_publish(spark, tmp_path):
    import json
    from tidings.sources.sinks import publish_feed
    scored = _scored_frame(spark, SELECTION_ROWS).withColumn("url", F.concat(F.lit("https://x/"), F.col("id"))) \
        .withColumn("title", F.when(F.col("id") == "A", F.lit(None).cast("string")).otherwise(F.col("id"))) \
        .withColumn("summary", F.lit(None).cast("string"))
    feed = selection.select_feed(scored, 4)
    payload = selection.serialize_feed(feed, "2024-01-31 08:30:00")
    doc = json.loads(payload.first()["payload"])
    assert doc["date"] == "2024-01-31" and doc["generated_at"] == "2024-01-31T08:30:00+00:00"
    assert doc["count"] == 4 and [i["id"] for i in doc["items"]] == ["A", "C", "E", "F"]
    assert doc["items"][0]["title"] is None and "summary" in doc["items"][0]
    assert doc["items"][0]["scraped_at"] == "2024-01-31T00:00:00+00:00"
    out = str(tmp_path / "feeds")
    assert publish_feed(payload, out) == (True, None)
    again = selection.serialize_feed(feed.limit(2), "2024-01-31 09:00:00")
    assert publish_feed(again, out) == (True, None)  # same day: overwritten
    files = spark.read.text(out).collect()
    assert len(files) == 1 and json.loads(files[0]["value"])["count"] == 2
