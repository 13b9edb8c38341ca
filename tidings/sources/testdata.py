"""Readers for the driver tables and the mapping onto the feed data model.

The raw tables live as one Parquet file each under an ``sf`` folder.  The
feed model (content, interaction, url, hostname) is derived from them exactly
as FIXTURES.md part B describes, so that Spark and the DuckDB oracle read the
same rows.  Every mapping is a projection / explode / equi-join: it scales
with the input and adds no driver work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.common import ts_lit
from ..functions.urls import url_hostname

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
]


# The fixtures' clock (FIXTURES part B).
NOW = "2024-01-31 00:00:00"


SCAN_PARTITIONS = "spark.tidings.scan.partitions"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table.  Where the setting ``SCAN_PARTITIONS`` is given, its rows
    are dealt out over so many partitions: for tables in one file of one row
    group, which are one task to scan.  By default the files decide."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    wanted = spark.conf.get(SCAN_PARTITIONS, None)
    return df.repartition(int(wanted)) if wanted else df


def content(spark: SparkSession, sf_dir: str, as_of=NOW) -> DataFrame:
    """FIXTURES B1: one content row per document."""
    now = ts_lit(as_of)
    d = read_table(spark, sf_dir, "documents")
    doc_id = F.col("doc_id")
    tags = F.when(doc_id % 97 == 96, F.array().cast("array<string>")).otherwise(
        F.array(F.col("source"),
                F.concat(F.lit("t"), (doc_id % 40).cast("string")),
                F.concat(F.lit("q"), (doc_id % 33).cast("string"))))
    scraped = now - F.make_dt_interval(days=(doc_id % 45).cast("int"), hours=(doc_id % 24).cast("int"))
    shown = F.when(doc_id % 4 == 0, now - F.make_dt_interval(hours=((doc_id % 6) * 12).cast("int")))
    return d.select(
        doc_id.alias("id"),
        F.concat(F.lit("https://"), F.col("source"), F.lit(".example.com/post/"), doc_id.cast("string")).alias("url"),
        F.concat(F.col("source"), F.lit(".example.com")).alias("hostname"),
        F.substring("text", 1, 60).alias("title"),
        F.col("text"),
        F.split("text", "\n").alias("chunks"),
        tags.alias("tags"),
        scraped.alias("scraped_at"),
        shown.cast("timestamp_ntz").alias("last_shown_at"),
        F.lit(None).cast("timestamp_ntz").alias("last_seen_at"),
        F.when(doc_id % 10 == 9, F.lit(1)).otherwise(F.lit(5)).alias("pipeline_state"),
        F.lit(None).cast("string").alias("summary"),
        F.lit(None).cast("string").alias("pipeline_error"),
        F.lit(0.0).alias("score"),
        scraped.alias("created_at"),
    )


def interaction_type(event_type: Column, value: Column, k: Column) -> Column:
    """FIXTURES B2: event type -> interaction type."""
    return (F.when(event_type == "view", "impression")
            .when(event_type == "click", F.when(value < 50, "open").otherwise("read"))
            .when(event_type == "purchase", "like")
            .when(event_type == "signup", F.when(value < 50, "bookmark").otherwise("share"))
            .when(event_type == "error", F.when(k < 5, "hide").otherwise("impression")))


def interactions(spark: SparkSession, sf_dir: str, as_of=NOW) -> DataFrame:
    """FIXTURES B2: events joined to content on ``props.k``, one row per tag.

    The join key domain is small (content ids hit by events), so the event
    side is skewed by construction; AQE's skew-join split handles hot ids and
    the runtime broadcast conversion applies when the content side is small.
    """
    from ..functions.feed import interaction_weight

    ev = read_table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    ev = ev.select("event_id", "ts", "event_type", "value", k.alias("k"))
    c = content(spark, sf_dir, as_of).select(F.col("id").alias("k"), "tags")
    j = ev.join(c, "k")
    typ = interaction_type(F.col("event_type"), F.col("value"), F.col("k"))
    rows = j.select(
        "event_id",
        F.col("k").alias("content_id"),
        F.explode("tags").alias("tag"),
        typ.alias("type"),
        F.col("ts").alias("created_at"),
    )
    return rows.withColumn("weight", interaction_weight(F.col("type")))


def urls(spark: SparkSession, sf_dir: str, as_of=NOW) -> DataFrame:
    """FIXTURES B3: URL frontier rows from ``pages``."""
    now = ts_lit(as_of)
    p = read_table(spark, sf_dir, "pages")
    pid = F.col("page_id")
    kind = F.when(pid % 10 == 0, "source").otherwise("url")
    return p.select(
        pid.alias("id"),
        F.col("url"),
        url_hostname(F.col("url")).alias("hostname"),
        (F.lit(1) + (pid % 6)).cast("int").alias("crawl_state"),
        F.lit(0).cast("bigint").alias("retry_count"),
        F.lit(0.0).alias("priority_score"),
        F.lit(0).cast("bigint").alias("depth"),
        kind.alias("kind"),
        F.when(pid % 10 == 0, F.col("url")).otherwise(F.lit("seed")).alias("source"),
        (now + F.make_dt_interval(mins=(((pid * 37) % 240) - 120).cast("int"))).alias("next_crawl_at"),
        F.lit(None).cast("timestamp_ntz").alias("last_crawl_at"),
        F.lit(None).cast("string").alias("crawl_run_id"),
        pid.alias("sequence"),
        (ts_lit("2024-01-01 00:00:00") + F.make_dt_interval(secs=pid.cast("decimal(18,6)"))).alias("created_at"),
    )


def urls_and_roots(spark: SparkSession, sf_dir: str, as_of=NOW) -> DataFrame:
    """FIXTURES B3 and one due source per host that the fetcher brought no page
    for: the host's root (id ``-1 - first id``), first or last in its queue."""
    now = ts_lit(as_of)
    u = urls(spark, sf_dir, as_of)
    g = u.where("hostname IS NOT NULL").groupBy("hostname").agg(F.min("id").alias("first_id"))
    root = F.concat(F.lit("https://"), F.col("hostname"), F.lit("/"))
    rows = g.select(
        (-1 - F.col("first_id")).alias("id"), root.alias("url"), "hostname", F.lit(1).alias("crawl_state"),
        F.lit("source").alias("kind"), root.alias("source"), (now - F.make_dt_interval(mins=F.lit(1))).alias("next_crawl_at"),
        F.when(F.col("first_id") % 2 == 0, F.lit(-1)).otherwise(F.lit(1 << 40)).cast("bigint").alias("sequence"))
    rows = rows.join(u.select("url"), "url", "left_anti")
    return u.unionByName(rows, allowMissingColumns=True)


def hostnames(spark: SparkSession, sf_dir: str, as_of=NOW) -> DataFrame:
    """FIXTURES B3: one Hostname row per distinct URL host."""
    now = ts_lit(as_of)
    u = urls(spark, sf_dir, as_of)
    g = u.groupBy("hostname").agg(F.min("id").alias("first_id"))
    return g.select(
        F.col("hostname").alias("id"),
        F.col("hostname").alias("name"),
        F.lit(None).cast("timestamp_ntz").alias("last_crawled_at"),
        F.lit(0).cast("bigint").alias("crawl_count"),
        F.lit(10.0).alias("crawl_delay_seconds"),
        (now + F.make_dt_interval(mins=(((F.col("first_id") * 53) % 120) - 60).cast("int"))).alias("next_allowed_at"),
        F.lit(0).cast("bigint").alias("failure_count"),
        F.lit(0).cast("bigint").alias("success_count"),
        (ts_lit("2024-01-01 00:00:00") + F.make_dt_interval(secs=F.col("first_id").cast("decimal(18,6)"))).alias("created_at"),
    )
