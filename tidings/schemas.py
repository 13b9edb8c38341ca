"""Declared table schemas (Q1): Spark types plus field metadata
``required / unique / indexed / enum / default``."""

from __future__ import annotations

from pyspark.sql import types as T

from . import constants as K


def field(name, dtype, nullable=True, *, required=False, unique=False, indexed=False,
          enum=None, default=None):
    meta = {"required": required, "unique": unique, "indexed": indexed}
    if enum is not None:
        meta["enum"] = list(enum)
    if default is not None:
        meta["default"] = default
    return T.StructField(name, dtype, nullable, metadata=meta)


STR, LONG, INT, DBL, BOOL, TS = (T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(),
                                 T.BooleanType(), T.TimestampNTZType())
STR_ARR = T.ArrayType(T.StringType())

HOSTNAME = T.StructType([
    field("name", STR, False, required=True, unique=True, indexed=True),
    field("last_crawled_at", TS, indexed=True),
    field("crawl_count", LONG, default=0),
    field("crawl_delay_seconds", DBL, default=10.0),
    field("next_allowed_at", TS, required=True, indexed=True),
    field("failure_count", LONG, default=0),
    field("success_count", LONG, default=0),
])

URL = T.StructType([
    field("url", STR, False, required=True, unique=True, indexed=True),
    field("hostname", STR, required=True, indexed=True),
    field("crawl_state", INT, required=True, indexed=True, enum=list(K.CRAWL_STATES)),
    field("retry_count", LONG, default=0),
    field("priority_score", DBL, default=0.0, indexed=True),
    field("depth", LONG, default=0),
    field("kind", STR, required=True, indexed=True),
    field("source", STR, required=True, indexed=True),
    field("next_crawl_at", TS, required=True, indexed=True),
    field("last_crawl_at", TS),
    field("crawl_run_id", STR, indexed=True),
])

CONTENT = T.StructType([
    field("url", STR, False, required=True, unique=True, indexed=True),
    field("hostname", STR, required=True, indexed=True),
    field("title", STR),
    field("simhash", STR, required=True, indexed=True),
    field("simhash_1", INT, required=True, indexed=True),
    field("simhash_2", INT, required=True, indexed=True),
    field("simhash_3", INT, required=True, indexed=True),
    field("simhash_4", INT, required=True, indexed=True),
    field("summary", STR),
    field("chunks", STR_ARR, default=[]),
    field("tags", STR_ARR, default=[]),
    field("score", DBL, default=0.0),
    field("scraped_at", TS, required=True, indexed=True),
    field("last_shown_at", TS),
    field("last_seen_at", TS),
    field("crawl_run_id", STR, indexed=True),
    field("pipeline_state", INT, required=True, indexed=True, enum=list(K.PIPELINE_STATES)),
    field("pipeline_error", STR),
])

CRAWL_RUN = T.StructType([
    field("started_at", TS, required=True, indexed=True),
    field("finished_at", TS, indexed=True),
    field("urls_attempted", LONG, default=0),
    field("urls_success", LONG, default=0),
    field("urls_failed", LONG, default=0),
    field("github_action_run_id", STR, indexed=True),
])

INTERACTION = T.StructType([
    field("content_id", STR, required=True, indexed=True),
    field("tag", STR, required=True, indexed=True),
    field("type", STR, required=True, indexed=True, enum=list(K.INTERACTION_WEIGHTS)),
    field("weight", DBL, default=0.0),
])

TAG_SCORE = T.StructType([
    field("tag", STR, required=True, indexed=True),
    field("recent_weight", DBL, default=0.0),
    field("long_weight", DBL, default=0.0),
])

# What readers send, and what the fetcher stores: inputs of the streams.
REQUEST = T.StructType([
    field("event_id", LONG),
    field("content_id", STR, required=True),
    field("type", STR, required=True, enum=list(K.INTERACTION_WEIGHTS)),
    field("tags", STR_ARR),
    field("created_at", TS, required=True),
])

PAGE = T.StructType([field("page_id", LONG, required=True), field("url", STR, required=True), field("html", STR)])

TABLES = {"Hostname": HOSTNAME, "URL": URL, "Content": CONTENT, "CrawlRun": CRAWL_RUN,
          "Interaction": INTERACTION, "TagScore": TAG_SCORE}
