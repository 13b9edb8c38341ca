"""Table API as DataFrame functions: filtered, newest-first listings with
keyset paging, point lookups, source creation and the admin state view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.common import ts_lit
from ..functions.urls import url_hostname
from .frontier import winners

def list_order():
    return [F.col("created_at").desc(), F.col("id").desc()]

SOURCE_COLUMNS = ["id", "url", "hostname", "crawl_state", "retry_count", "priority_score",
                  "next_crawl_at", "last_crawl_at"]
HOSTNAME_COLUMNS = ["id", "name", "crawl_count", "crawl_delay_seconds", "last_crawled_at",
                    "next_allowed_at", "failure_count", "success_count"]
CONTENT_COLUMNS = ["id", "url", "hostname", "title", "summary", "tags", "score", "pipeline_state",
                   "pipeline_error", "scraped_at", "last_shown_at", "last_seen_at"]


def list_rows(df: DataFrame, equals: dict | None = None, isin: dict | None = None,
              contains: dict | None = None, limit: int = K.LIST_LIMIT,
              after_id=None, before_id=None) -> DataFrame:
    """Equality / IN / array-contains filters, then one page in
    ``(created_at desc, id desc)`` order.  The cursor row is looked up in the
    whole table, whether or not it passes the filters (one row reaches the
    driver, so the page is a plain pushed-down range); an id that is not there
    raises.  ``before_id`` wins when both are given."""
    table = df
    for col, v in (equals or {}).items():
        if v is not None:
            df = df.where(F.col(col) == F.lit(v))
    for col, vs in (isin or {}).items():
        if vs:
            df = df.where(F.col(col).isin(list(vs)))
    for col, v in (contains or {}).items():
        if v is not None:
            df = df.where(F.array_contains(F.col(col), F.lit(v)))
    cursor = before_id if before_id is not None else after_id
    if cursor is None:
        return df.orderBy(*list_order()).limit(limit)
    found = table.where(F.col("id") == F.lit(cursor)).select("created_at").head(1)
    if not found:
        raise ValueError(f"no row with the cursor's id: {cursor!r}")
    c_ts, c_id = F.lit(found[0]["created_at"]).cast(table.schema["created_at"].dataType), F.lit(cursor)
    newer = (F.col("created_at") > c_ts) | ((F.col("created_at") == c_ts) & (F.col("id") > c_id))
    older = (F.col("created_at") < c_ts) | ((F.col("created_at") == c_ts) & (F.col("id") < c_id))
    if before_id is not None:
        page = df.where(newer).orderBy(F.col("created_at").asc(), F.col("id").asc()).limit(limit)
        return page.orderBy(*list_order())
    return df.where(older).orderBy(*list_order()).limit(limit)


def list_sources(urls: DataFrame, kind: str | None = "source", sources: list[str] | None = None,
                 id=None, url=None, hostname=None, limit: int = K.LIST_LIMIT,
                 after_id=None, before_id=None) -> DataFrame:
    """P1 + P5: URL rows, kind defaults to ``source``."""
    rows = list_rows(urls, equals={"id": id, "url": url, "hostname": hostname, "kind": kind},
                     isin={"source": sources}, limit=limit, after_id=after_id, before_id=before_id)
    return rows.select(*SOURCE_COLUMNS, "created_at")


def list_hostnames(hostnames: DataFrame, id=None, hostname=None, limit: int = K.LIST_LIMIT,
                   after_id=None, before_id=None) -> DataFrame:
    """The ``hostname`` filter matches the ``name`` column."""
    rows = list_rows(hostnames, equals={"id": id, "name": hostname}, limit=limit,
                     after_id=after_id, before_id=before_id)
    return rows.select(*HOSTNAME_COLUMNS, "created_at")


def list_content(content: DataFrame, tag: str | None = None, id=None, url=None, hostname=None,
                 pipeline_state=None, limit: int = K.LIST_LIMIT, after_id=None, before_id=None) -> DataFrame:
    """Content rows with an optional tag-containment filter."""
    rows = list_rows(content, equals={"id": id, "url": url, "hostname": hostname,
                                      "pipeline_state": pipeline_state},
                     contains={"tags": tag}, limit=limit, after_id=after_id, before_id=before_id)
    return rows.select(*CONTENT_COLUMNS, "created_at")


def lookup_by_id(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Point lookups for a frame of ids (a semi-join; one id is the
    special case)."""
    return df.join(ids.select("id").distinct(), "id", "left_semi")


def source_state_view(urls: DataFrame, kind: str = "source", limit: int = 100) -> DataFrame:
    """The admin table: newest ``limit`` rows of one kind with the state
    label (unknown codes shown as-is)."""
    label = F.col("crawl_state").cast("string")
    for code, name in K.CRAWL_STATES.items():
        label = F.when(F.col("crawl_state") == code, F.lit(name)).otherwise(label)
    rows = list_rows(urls, equals={"kind": kind}, limit=limit)
    return rows.select("id", "url", F.coalesce("hostname", F.lit("")).alias("hostname"),
                       label.alias("state"), F.coalesce("retry_count", F.lit(0)).alias("retries"))


def create_source(requests: DataFrame, urls: DataFrame, hostnames: DataFrame, as_of=None):
    """S15 + Q4: validate source requests ``(url, kind, source)`` and build
    the new URL rows (QUEUED, due now) and Hostname rows (due now).
    An existing host is tolerated; an existing URL is rejected, and so are all
    but the earliest (``request_seq``) of several valid requests for one URL.
    Returns ``(new_urls, new_hostnames, rejected)``."""
    now = ts_lit(as_of)
    seq = [c for c in ("request_seq",) if c in requests.columns]
    req = requests.select("url", F.coalesce("kind", F.lit("source")).alias("kind"),
                          F.coalesce("source", F.lit("api")).alias("source"), *seq)
    host = url_hostname(F.col("url"))
    reason = (F.when(host.isNull(), F.lit("Invalid URL: could not extract hostname"))
              .when((F.col("kind") == "source") & (F.col("url") != F.col("source")),
                    F.lit("Invalid source and kind: source must equal the url for kind 'source'")))
    checked = req.withColumn("hostname", host).withColumn("reason", reason)
    existing = urls.select("url").distinct().withColumn("_exists", F.lit(True))
    checked = checked.join(existing, "url", "left").withColumn(
        "reason", F.coalesce(F.col("reason"), F.when(F.col("_exists"), F.lit("URL already exists")))).drop("_exists")
    accepted, late = winners(checked.where(F.col("reason").isNull()), "url")
    rejected = checked.where(F.col("reason").isNotNull()).unionByName(late.withColumn("reason", F.lit("URL already exists")))
    rejected = rejected.select("url", "kind", "source", "reason")
    new_urls = accepted.select(
        "url", "hostname", F.lit(K.CRAWL_QUEUED).alias("crawl_state"),
        F.lit(0).cast("bigint").alias("retry_count"), F.lit(0.0).alias("priority_score"),
        "kind", "source", now.alias("next_crawl_at"))
    new_hosts = (accepted.select(F.col("hostname").alias("name")).distinct()
                 .join(hostnames.select("name"), "name", "left_anti")
                 .select("name", now.alias("next_allowed_at"),
                         F.lit(0).cast("bigint").alias("crawl_count"),
                         F.lit(0).cast("bigint").alias("success_count"),
                         F.lit(0).cast("bigint").alias("failure_count"),
                         F.lit(10.0).alias("crawl_delay_seconds")))
    return new_urls, new_hosts, rejected
