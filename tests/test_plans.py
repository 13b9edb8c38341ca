"""Plan-shape checks: predicates and projections reach the Parquet scan,
top-k windows are pre-limited, and the band join is a semi-join."""

import os
import tempfile

from pyspark.sql import functions as F

from tidings import schemas as SC
from tidings.operators import dedup, frontier, scoring, selection
from tidings.sources import testdata as td


def _plan(spark, df):
    import contextlib
    import io
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_content_window_pushes_filters_to_scan(spark, sf_small):
    path = os.path.join(tempfile.mkdtemp(prefix="tidings-content-"), "content")
    td.content(spark, sf_small).drop("text").write.parquet(path)
    stored = spark.read.parquet(path)
    plan = _plan(spark, scoring.content_window(stored).select("id", "score"))
    assert "PushedFilters: [IsNotNull(pipeline_state), IsNotNull(scraped_at), EqualTo(pipeline_state,5)" in plan
    assert "ReadSchema: struct<id:bigint,scraped_at:timestamp_ntz,pipeline_state:int,score:double>" in plan


def test_mmr_prune_is_pre_limited(spark):
    df = spark.createDataFrame([(i, ["a"], 0.5, 0.5, 0.5, 0.5, 1.0, 0.5) for i in range(50)],
                               "id long, tags array<string>, continuity double, relevance double, novelty double, "
                               "interest double, freshness double, score double")
    df = df.withColumn("scraped_at", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    plan = _plan(spark, selection.mmr_candidates(df, 3))
    assert "WindowGroupLimit" in plan and "Partial" in plan
    assert selection.mmr_candidates(df, 3).count() == 3  # one tag set, top 3 per signal, same rows


def test_band_join_is_semi_join_not_nested_loop(spark):
    inc = spark.createDataFrame([(1, "u", 5)], "id long, url string, simhash long")
    ex = spark.createDataFrame([(5,)], "simhash long")
    plan = _plan(spark, dedup.near_dup_urls(inc, ex))
    assert "LeftSemi" in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_enqueue_applies_defaults(spark):
    table = spark.createDataFrame([("https://a/1", "a", 3, 2)], "url string, hostname string, crawl_state int, retry_count long")
    new = spark.createDataFrame([("https://a/2", "a", 1)], "url string, hostname string, crawl_state int")
    out = {r["url"]: r for r in frontier.enqueue(table, new, SC.URL).collect()}
    assert out["https://a/2"]["retry_count"] == 0 and out["https://a/1"]["retry_count"] == 2
