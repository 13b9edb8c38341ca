"""Table API listings, paging, creation and schema checks."""

from pyspark.sql import functions as F

from tidings import schemas as SC
from tidings.functions.common import ts_lit
from tidings.operators import quality as QA
from tidings.operators import tables as TB


def _content(spark, n=60):
    rows = [(i, f"https://h{i % 3}/p{i}", f"h{i % 3}", ["a"] if i % 2 else ["b"], i // 2) for i in range(n)]
    df = spark.createDataFrame(rows, "id long, url string, hostname string, tags array<string>, sec int")
    return df.withColumn("created_at", ts_lit("2024-01-01 00:00:00") + F.make_dt_interval(secs=F.col("sec")))


def _order(rows):
    return sorted(rows, key=lambda r: (r[4], r[0]), reverse=True)


def test_listing_and_cursors(spark):
    df = _content(spark)
    brute = _order([(i, None, None, None, i // 2) for i in range(60)])
    first = [r["id"] for r in TB.list_rows(df, limit=20).collect()]
    assert first == [r[0] for r in brute[:20]]
    after = [r["id"] for r in TB.list_rows(df, limit=20, after_id=first[-1]).collect()]
    assert after == [r[0] for r in brute[20:40]]
    before = [r["id"] for r in TB.list_rows(df, limit=20, before_id=brute[39][0]).collect()]
    assert before == [r[0] for r in brute[19:39]]
    tagged = [r["id"] for r in TB.list_rows(df, contains={"tags": "a"}, equals={"hostname": "h1"}).collect()]
    assert tagged == [r[0] for r in brute if r[0] % 2 == 1 and r[0] % 3 == 1][:20]


def test_create_source_validation(spark):
    urls = spark.createDataFrame([("https://a.com/s",)], "url string")
    hosts = spark.createDataFrame([("a.com",)], "name string")
    req = spark.createDataFrame([("https://a.com/s", "source", "https://a.com/s"),
                                 ("https://a.com/new", "source", "https://a.com/new"),
                                 ("https://b.com/x", "url", "api"),
                                 ("https://c.com/x", "source", "api"),
                                 ("nohost", "source", "nohost")], "url string, kind string, source string")
    new_urls, new_hosts, rejected = TB.create_source(req, urls, hosts)
    assert sorted(r["url"] for r in new_urls.collect()) == ["https://a.com/new", "https://b.com/x"]
    assert sorted(r["name"] for r in new_hosts.collect()) == ["b.com"]
    reasons = {r["url"]: r["reason"] for r in rejected.collect()}
    assert reasons["https://a.com/s"] == "URL already exists"
    assert reasons["https://c.com/x"].startswith("Invalid source and kind")
    assert reasons["nohost"].startswith("Invalid URL")


def test_state_view_labels(spark):
    urls = spark.createDataFrame([(1, "u1", "h", "source", 4, 0), (2, "u2", None, "source", 9, None)],
                                 "id long, url string, hostname string, kind string, crawl_state int, retry_count long")
    urls = urls.withColumn("created_at", ts_lit("2024-01-01 00:00:00"))
    got = {r["id"]: (r["state"], r["hostname"], r["retries"]) for r in TB.source_state_view(urls).collect()}
    assert got == {1: ("RETRY", "h", 0), 2: ("9", "", 0)}


def test_schema_checks(spark):
    df = spark.createDataFrame([("u1", "h", 1, "url", "s"), ("u1", None, 9, "url", "s")],
                               "url string, hostname string, crawl_state int, kind string, source string")
    v = {r["column"]: r for r in QA.validate_table(df, SC.URL).collect()}
    assert v["hostname"]["null_violations"] == 1 and v["crawl_state"]["enum_violations"] == 1
    assert [r["url"] for r in QA.unique_violations(df, "url").collect()] == ["u1"]
    d = QA.apply_defaults(df, SC.URL).first()
    assert d["retry_count"] == 0 and d["priority_score"] == 0.0 and d["last_crawl_at"] is None


def _scan_rows(spark, df):
    """Rows that the scans of an executed frame gave, after row groups were skipped."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found = []

    def walk(node):
        if "Scan" in node.nodeName():
            found.append(node.metrics().apply("numOutputRows").value())
        for child in [node.children().apply(i) for i in range(node.children().size())]:
            walk(child)
        if node.nodeName().startswith("AdaptiveSparkPlan"):
            walk(node.executedPlan())
        if "QueryStage" in node.nodeName():
            walk(node.plan())
    walk(plan)
    return sum(found)


def _listed(spark, n):
    tags = F.when(F.col("id") % 3 == 0, F.array(F.lit("hot"), F.lit("a"))).when(F.col("id") % 50 == 1, F.array(F.lit("rare"))).when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.array(F.lit("b"), F.lit("b")))
    df = spark.range(n).select("id", F.concat(F.lit("https://x/"), "id").alias("url"), F.concat(F.lit("h"), F.col("id") % 4).alias("hostname"), tags.alias("tags"), (F.col("id") % 5).cast("int").alias("pipeline_state"),
                               (ts_lit("2024-01-01 00:00:00") + F.make_dt_interval(hours=(F.col("id") / 4).cast("int"))).alias("created_at"))
    for c in TB.CONTENT_COLUMNS:
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df


def test_stored_listing_gives_the_same_pages(spark, tmp_path):
    from tidings.operators.listing import ContentListing
    df = _listed(spark, 700)
    stored = ContentListing(spark, str(tmp_path / "c"))
    stored.write(df)
    same = 0
    for tag in (None, "hot", "rare", "none"):
        for cursor in ({}, {"after_id": 500}, {"before_id": 10}, {"after_id": 400, "before_id": 100}):
            for more in ({}, {"hostname": "h2", "pipeline_state": 3}, {"id": 33}):
                if more and ("after_id" not in cursor or "before_id" in cursor or tag in (None, "none")):
                    continue
                want = [tuple(r) for r in TB.list_content(df, tag, limit=7, **cursor, **more).collect()]
                got = [tuple(r) for r in stored.list_content(tag, limit=7, **cursor, **more).collect()]
                assert got == want, (tag, cursor, more)
                same += len(want)
    assert same > 70
    try:
        stored.list_content("hot", after_id=10**9)
        raise AssertionError("an unknown cursor has to raise")
    except ValueError:
        pass


def test_a_page_by_tag_reads_few_of_the_rows(spark, tmp_path):
    from tidings.operators.listing import ContentListing
    df = _listed(spark, 40_000)
    stored = ContentListing(spark, str(tmp_path / "c"))
    stored.write(df, row_group_bytes=16_384)
    for tag in ("hot", "rare"):
        page = stored.list_content(tag, limit=20, after_id=20_001)
        assert [r["id"] for r in page.collect()] == [r["id"] for r in TB.list_content(df, tag, limit=20, after_id=20_001).collect()]
        assert _scan_rows(spark, page) < 8_000
    assert _scan_rows(spark, stored.row(123)) < 8_000
