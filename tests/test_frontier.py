"""Frontier views and transitions: the reference's claim and queue truth
tables transcribed as rows."""

from pyspark.sql import functions as F

from tidings import constants as K
from tidings.functions.common import ts_lit
from tidings.operators import frontier as FR

AS_OF = "2024-01-31 12:00:00"
SCHEMA = "id string, url string, hostname string, kind string, crawl_state int, offset_min int, sequence long"


def _urls(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("next_crawl_at", ts_lit(AS_OF) + F.make_dt_interval(mins=F.col("offset_min"))).drop("offset_min")


CLAIM_TABLE = [
    # id, url, host, kind, state, next_crawl_at offset (minutes), seq, claimed?
    ("u1", "https://h/1", "h", "url", K.CRAWL_QUEUED, 0, 1, True),
    ("u2", "https://h/2", "h", "url", K.CRAWL_FETCHING, 9, 2, False),   # claimed a moment ago
    ("u3", "https://h/3", "h", "url", K.CRAWL_FETCHING, -5, 3, True),   # expired lease
    ("u4", "https://h/4", "h", "url", K.CRAWL_FETCHING, 60, 4, False),
    ("u5", "https://h/5", "h", "url", K.CRAWL_SUCCESS, -5, 5, False),
    ("u6", "https://h/6", "h", "url", K.CRAWL_RETRY, 0, 6, True),
    ("s1", "https://h/s1", "h", "source", K.CRAWL_SUCCESS, -1, 7, True),
    ("s2", "https://h/s2", "h", "source", K.CRAWL_FETCHING, 60, 8, False),
]


def test_claim_truth_table(spark):
    urls = _urls(spark, [r[:7] for r in CLAIM_TABLE])
    out = {r["id"]: r for r in FR.claim_urls(urls, urls.select("id"), AS_OF).collect()}
    for row in CLAIM_TABLE:
        got = out[row[0]]
        assert got["applied"] is row[7], row
        if row[7]:
            assert got["crawl_state"] == K.CRAWL_FETCHING
            assert str(got["next_crawl_at"]) == "2024-01-31 12:10:00"


FRONT_TABLE = [
    ("s1", "https://a/s", "a", "source", K.CRAWL_QUEUED, 0, 1, True),
    ("u1", "https://a/1", "a", "url", K.CRAWL_QUEUED, 0, 2, True),
    ("u2", "https://a/2", "a", "url", K.CRAWL_SUCCESS, 0, 3, False),
    ("s2", "https://b/s", "b", "source", K.CRAWL_SUCCESS, 0, 4, True),
    ("u3", "https://b/3", "b", "url", K.CRAWL_FETCHING, -5, 5, True),
    ("u4", "https://b/4", "b", "url", K.CRAWL_FETCHING, 60, 6, False),
]


def test_front_queue_truth_table(spark):
    urls = _urls(spark, [r[:7] for r in FRONT_TABLE])
    front = FR.front_queue(urls, AS_OF)
    got = [r["id"] for r in front.orderBy("branch", "sequence").collect()]
    assert got == ["s1", "s2", "u1", "u3"]  # sources first
    back = {(r["hostname"], r["pos"]): r["id"] for r in FR.back_queue(front).collect()}
    assert back == {("a", 1): "s1", ("a", 2): "u1", ("b", 1): "s2", ("b", 2): "u3"}
    sizes = FR.queue_sizes(front).first()
    assert (sizes["n_items"], sizes["n_hosts"], sizes["n_sources"]) == (4, 2, 2)


def _hosts(spark):
    df = spark.createDataFrame([("a", "a", -1), ("b", "b", 30), ("c", "c", None)],
                               "id string, name string, offset_min int")
    due = F.when(F.col("offset_min").isNotNull(), ts_lit(AS_OF) + F.make_dt_interval(mins=F.col("offset_min")))
    return df.select("id", "name", due.alias("next_allowed_at"),
                     F.lit(0).cast("bigint").alias("crawl_count"), F.lit(0).cast("bigint").alias("success_count"),
                     F.lit(0).cast("bigint").alias("failure_count"),
                     F.lit(None).cast("timestamp_ntz").alias("last_crawled_at"))


def test_scheduler_and_heads(spark):
    urls = _urls(spark, [r[:7] for r in FRONT_TABLE] + [("c1", "https://c/1", "c", "url", 1, 0, 9)])
    front = FR.front_queue(urls, AS_OF)
    sched = [r["name"] for r in FR.scheduler_queue(front, _hosts(spark), AS_OF).collect()]
    assert sched == ["a", "c"]  # b is not due; NULL due time counts as now
    heads = {r["hostname"]: r["id"] for r in FR.due_host_heads(front, _hosts(spark), AS_OF).collect()}
    assert heads == {"a": "s1", "c": "c1"}


def test_lease_single_winner(spark):
    hosts = _hosts(spark)
    req = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3)], "id string, request_seq long")
    out = {r["id"]: r for r in FR.lease_hostnames(hosts, req, AS_OF).collect()}
    assert out["a"]["applied"] and str(out["a"]["next_allowed_at"]) == "2024-01-31 12:10:00"
    assert not out["b"]["applied"]
    assert not out["c"]["applied"]


def test_outcomes_and_host_stats(spark):
    urls = _urls(spark, [("u1", "https://a/1", "a", "url", 2, 10, 1), ("u2", "https://b/2", "b", "url", 2, 10, 2)])
    outcomes = spark.createDataFrame([("u1", "a", True), ("u2", "b", False)], "id string, hostname string, success boolean")
    got = {r["id"]: r for r in FR.apply_url_outcomes(urls, outcomes, AS_OF).collect()}
    assert got["u1"]["crawl_state"] == K.CRAWL_SUCCESS and str(got["u1"]["next_crawl_at"]) == "2024-01-31 12:10:00"
    assert got["u2"]["crawl_state"] == K.CRAWL_RETRY and str(got["u2"]["next_crawl_at"]) == "2024-01-31 12:00:00"
    hs = {r["name"]: r for r in FR.hostname_stats(_hosts(spark), outcomes, AS_OF).collect()}
    assert (hs["a"]["crawl_count"], hs["a"]["success_count"], hs["a"]["failure_count"]) == (1, 1, 0)
    assert (hs["b"]["crawl_count"], hs["b"]["success_count"], hs["b"]["failure_count"]) == (0, 0, 1)
    # rescheduled from its scheduled time (not from now): -1 min + 330 s
    assert str(hs["a"]["next_allowed_at"]) == "2024-01-31 12:04:30"
    assert str(hs["a"]["last_crawled_at"]) == "2024-01-31 12:00:00"
    assert not hs["c"]["applied"]


def test_retry_and_patch(spark):
    urls = _urls(spark, [("u1", "https://b/1", "b", "url", K.CRAWL_SUCCESS, 60, 1),
                         ("u2", "https://a/2", "a", "url", K.CRAWL_FAILED, 60, 2)])
    urls = urls.withColumn("priority_score", F.lit(0.0))
    new_urls, new_hosts = FR.retry_source(urls, _hosts(spark), spark.createDataFrame([("u1",)], "id string"), AS_OF)
    u = {r["id"]: r for r in new_urls.collect()}
    assert u["u1"]["crawl_state"] == K.CRAWL_QUEUED and str(u["u1"]["next_crawl_at"]) == "2024-01-31 12:00:00"
    h = {r["name"]: r for r in new_hosts.collect()}
    assert str(h["b"]["next_allowed_at"]) == "2024-01-31 12:00:00" and not h["a"]["applied"]
    patches = spark.createDataFrame(
        [("u1", 2.5, True, None, False, None, False), ("u2", None, False, None, False, None, False)],
        "id string, priority_score double, set_priority_score boolean, crawl_state int, set_crawl_state boolean, "
        "next_crawl_at timestamp_ntz, set_next_crawl_at boolean")
    out, rejected = FR.patch_source(urls, patches)
    o = {r["id"]: r for r in out.collect()}
    assert o["u1"]["priority_score"] == 2.5 and o["u1"]["crawl_state"] == K.CRAWL_SUCCESS
    assert [r["reason"] for r in rejected.collect()] == ["No fields to update"]


def test_content_claim(spark):
    content = spark.createDataFrame([(1, 1), (2, 5), (3, 1)], "id long, pipeline_state int").withColumn(
        "scraped_at", ts_lit(AS_OF))
    q = FR.content_queue(content)
    assert sorted(r["id"] for r in q.collect()) == [1, 3]
    out = {r["id"]: r for r in FR.claim_content(content, spark.createDataFrame([(1,), (2,)], "id long")).collect()}
    assert out[1]["pipeline_state"] == K.PIPE_SUMMARIZING and out[1]["applied"]
    assert out[2]["pipeline_state"] == K.PIPE_COMPLETED and not out[2]["applied"]


def test_crawl_round(spark):
    from tidings.plans.crawl import crawl_round
    urls = _urls(spark, [("1", "https://a/src", "a", "source", K.CRAWL_SUCCESS, -1, 1),
                         ("2", "https://a/p1", "a", "url", K.CRAWL_QUEUED, -1, 2),
                         ("3", "https://c/p2", "c", "url", K.CRAWL_QUEUED, -1, 3)]).withColumn("id", F.col("id").cast("long"))
    urls = urls.withColumn("retry_count", F.lit(0).cast("bigint")).withColumn("priority_score", F.lit(0.0))
    html_src = '<a href="/new-post">n</a><a href="/p1">old</a>'
    html_page = "<html><head><title>T</title></head><body><p>" + ("word " * 80) + "</p></body></html>"
    pages = spark.createDataFrame([(1, "https://a/src", html_src), (3, "https://c/p2", html_page)],
                                  "page_id long, url string, html string")
    existing = spark.createDataFrame([], "url string, simhash long")
    url_table, hosts, content = crawl_round(urls, _hosts(spark), pages, existing, AS_OF)
    u = {r["url"]: r for r in url_table.collect()}
    assert u["https://a/src"]["crawl_state"] == K.CRAWL_SUCCESS
    assert str(u["https://a/src"]["next_crawl_at"]) == "2024-01-31 18:00:00"   # source recurs in 6 h
    assert u["https://a/new-post"]["crawl_state"] == K.CRAWL_QUEUED           # discovered
    assert u["https://a/p1"]["crawl_state"] == K.CRAWL_QUEUED                 # not the host head this round
    assert u["https://c/p2"]["crawl_state"] == K.CRAWL_SUCCESS
    assert [r["url"] for r in content.collect()] == ["https://c/p2"]
    h = {r["name"]: r for r in hosts.collect()}
    assert h["a"]["crawl_count"] == 1 and h["c"]["crawl_count"] == 1 and h["b"]["crawl_count"] == 0


def test_one_update_equals_claim_refresh_and_outcome(spark):
    urls = _urls(spark, [r[:7] for r in CLAIM_TABLE] + [("s3", "https://h/s3", "h", "source", K.CRAWL_RETRY, -3, 9)])
    claimed = FR.claim_urls(urls, urls.select("id"), AS_OF)
    won = claimed.where("applied").select("id", "kind", (F.col("id") != "u3").alias("success"))
    won = won.withColumn("success", F.col("success") & (F.col("id") != "s3"))
    step = FR.bump_sources(claimed.drop("applied"), won.where("success AND kind = 'source'").select("id"), AS_OF).drop("applied")
    step = FR.apply_url_outcomes(step, won, AS_OF).drop("applied")
    columns = sorted(step.columns)
    assert sorted(map(str, FR.finish_urls(urls, won, AS_OF).select(columns).collect())) == sorted(map(str, step.select(columns).collect()))
