"""Structured Streaming jobs: incremental, exactly-once appends."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from tidings.schemas import REQUEST
from tidings.streaming import jobs as ST


def _requests(spark, rows):
    return spark.createDataFrame(rows, REQUEST)


def _request(i, tags=("a", "b", "a"), kind="like"):
    return (i, f"c{i % 7}", kind, list(tags), dt.datetime(2024, 1, 1 + i % 28))


def test_interactions_stream_is_incremental_and_exactly_once(spark, tmp_path):
    src, out, ck = (str(tmp_path / x) for x in ("requests", "log", "ck"))
    _requests(spark, [_request(i) for i in range(100)] + [_request(500, ())]).coalesce(1).write.parquet(f"{src}/a")

    def run():
        ST.stream_interactions(ST.request_stream(spark, f"{src}/*"), out, ck).awaitTermination()
        return spark.read.parquet(out)

    assert run().count() == 200  # one row per distinct tag; no tags, no row
    assert run().count() == 200  # replay with nothing new: no duplicates
    _requests(spark, [_request(i) for i in range(100, 150)]).coalesce(1).write.parquet(f"{src}/b")
    final = run()  # a new file arrives: only its rows are added
    assert final.count() == 300 and final.select("event_id", "tag").distinct().count() == 300


def test_batches_take_what_the_caller_allows(spark, tmp_path):
    src = str(tmp_path / "requests")
    for k in range(3):
        _requests(spark, [_request(k)]).coalesce(1).write.parquet(f"{src}/{k}")

    def batches(name, **limits):
        q = ST.stream_interactions(ST.request_stream(spark, f"{src}/*", **limits), str(tmp_path / f"log{name}"), str(tmp_path / f"ck{name}"))
        q.awaitTermination()
        return sum(p["numInputRows"] > 0 for p in q.recentProgress)

    assert batches(1) == 1 and batches(2, max_files=1) == 3


def test_a_table_in_a_folder_named_like_a_file_is_streamed(spark, tmp_path):
    """``pages.parquet`` may be one file or, as Spark writes it, a folder."""
    src = str(tmp_path / "requests.parquet")
    _requests(spark, [_request(k) for k in range(30)]).repartition(3).write.parquet(src)
    out = str(tmp_path / "log")
    ST.stream_interactions(ST.request_stream(spark, src), out, str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(out).count() == 60


def test_profile_after_a_restart(spark, tmp_path):
    """A fresh checkpoint in the same folder: the last run's profile is read."""
    out = str(tmp_path / "profile")
    as_of = "2024-01-31 00:00:00"
    for name, tags in (("a", [("x",), ("y",)]), ("b", [("z",)])):
        src = str(tmp_path / name)
        for k, t in enumerate(tags):
            _requests(spark, [_request(k, t)]).coalesce(1).write.parquet(f"{src}/{k}")
        ST.stream_tag_profile(ST.request_stream(spark, f"{src}/*", max_files=1), out, str(tmp_path / f"ck-{name}"), as_of, 2).awaitTermination()
        got = {r["tag"] for r in ST.latest_version(spark, out, as_of).collect()}
        assert got == {t for x in tags for t in x}


def test_ingest_fails_on_unreadable_output(spark, sf_small, tmp_path):
    src, fp, out = (str(tmp_path / x) for x in ("pages", "fp", "content"))
    spark.read.parquet(f"{sf_small}/pages.parquet").limit(5).coalesce(1).write.parquet(f"{src}/a")
    ST.write_existing_fingerprints(spark.createDataFrame([], "id long, url string, text string"), fp)
    (tmp_path / "content").mkdir()
    (tmp_path / "content" / "part-0.parquet").write_text("not parquet")
    q = ST.stream_content_ingest(spark, f"{src}/*", fp, out, str(tmp_path / "ck"))
    with pytest.raises(Exception):
        q.awaitTermination()


def test_ingest_stream_dedups_against_earlier_batches(spark, sf_small):
    src = tempfile.mkdtemp(prefix="tidings-pages-")
    out = tempfile.mkdtemp(prefix="tidings-ingest-") + "/content"
    ck = tempfile.mkdtemp(prefix="tidings-ck-")
    fp = tempfile.mkdtemp(prefix="tidings-fp-") + "/fp"
    pages = spark.read.parquet(f"{sf_small}/pages.parquet")
    pages.coalesce(1).write.parquet(f"{src}/a")
    # later batch: the same pages again under new URLs (exact copies)
    copies = pages.withColumn("url", F.concat(F.col("url"), F.lit("-copy")))
    copies.coalesce(1).write.parquet(f"{src}/b")
    empty = spark.createDataFrame([], "id long, url string, text string")
    ST.write_existing_fingerprints(empty, fp)
    q = ST.stream_content_ingest(spark, f"{src}/*", fp, out, ck, max_files=1)
    q.awaitTermination()
    rows = spark.read.parquet(out)
    batches = sorted(r["batch_id"] for r in rows.select("batch_id").distinct().collect())
    assert batches == [0]  # every copy in the second batch was a duplicate
    assert rows.where(F.col("url").endswith("-copy")).count() == 0


def test_profiles_of_two_days_from_one_checkpoint(spark, tmp_path):
    """The second run reads only the new file; both profiles equal the batch
    profile of all requests so far."""
    from tidings.operators import profile as prof
    src, table, ck = (str(tmp_path / x) for x in ("requests", "weights", "ck"))
    hour = dt.timedelta(minutes=37)
    kinds = ["open", "like", "hide", "impression"]
    parts = [[(i, f"c{i}", kinds[i % 4], [f"t{i % 5}", f"u{i % 3}"], dt.datetime(2024, 1, 1) + i * hour) for i in range(300)],
             [(i, f"c{i}", kinds[i % 3], [f"t{i % 7}"], dt.datetime(2024, 1, 9) + i * hour) for i in range(200)]]
    so_far = []
    for n, (rows, at) in enumerate(zip(parts, ["2024-01-09 07:00:00", "2024-01-20 18:00:00"])):
        _requests(spark, rows).coalesce(1).write.parquet(f"{src}/{n}")
        so_far += rows
        q = ST.stream_tag_weights(ST.request_stream(spark, f"{src}/*"), table, ck)
        q.awaitTermination()
        assert sum(p["numInputRows"] for p in q.recentProgress) == len(rows)
        for folder in (table, ST.compact_tag_weights(spark, table, str(tmp_path / f"compact{n}"))):
            got = {r["tag"]: r for r in ST.profile_at(spark, folder, at).collect()}
            want = prof.tag_profile(ST.request_rows(_requests(spark, so_far)), at).collect()
            assert got.keys() == {r["tag"] for r in want}
            for r in want:
                mine = got[r["tag"]]
                assert mine["hidden"] == r["hidden"]
                assert mine["recent_weight"] == pytest.approx(r["recent_weight"], abs=1e-12) and mine["long_weight"] == pytest.approx(r["long_weight"], abs=1e-12)
    with pytest.raises(ValueError):
        ST.profile_at(spark, table, "2024-01-20 18:30:00")
