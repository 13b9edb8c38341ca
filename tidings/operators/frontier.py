"""Crawl frontier as DataFrame views and conditional-update transitions.

Each transition takes a table snapshot and a request / outcome frame plus one
``as_of`` clock and returns the new snapshot with an ``applied`` flag.  Leases
and claims are the same for every request for a row, so competing requests are
one; where they differ (patches) the earliest wins (see ``winners``).  Request frames join the table on its key; AQE broadcasts them
when their measured size is small and uses a shuffle join otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.common import clock, plus_seconds, ts_lit
from .ranks import positions

ACTIVE_URL_STATES = [K.CRAWL_QUEUED, K.CRAWL_RETRY, K.CRAWL_FETCHING]


def request_order(requests: DataFrame, order: str = "request_seq") -> Column:
    """What ranks competing requests: their sequence number (NULL last), then
    all their fields, so that the winner never depends on partitioning."""
    fields = [F.col(f"`{c}`").cast("string") for c in sorted(requests.columns) if c != order]
    first = [F.col(order).isNull(), F.col(order)] if order in requests.columns else []
    return F.struct(*[c.alias(f"k{i}") for i, c in enumerate([*first, *fields])])


def winners(requests: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The earliest request of each key, and the rest (an aggregation per key,
    so a hot key is pre-combined per partition)."""
    ranked = requests.withColumn("_order", request_order(requests)).withColumn("_row", F.struct(*requests.columns))
    best = ranked.groupBy(key).agg(F.min_by("_row", "_order").alias("_row"), F.min("_order").alias("_order"), F.count("*").alias("_n"))
    first = best.select("_row.*")
    late = ranked.join(best.where("_n > 1").select(key, F.col("_order").alias("_best")), key)
    equal = best.where("_n > 1").select(key, "_row", "_order", "_n")
    behind = late.where(F.col("_order") != F.col("_best")).select("_row.*")
    # rows equal in every field: all but one lose
    same = (late.where(F.col("_order") == F.col("_best")).groupBy(key).agg(F.count("*").alias("_same"))
            .join(equal.select(key, "_row"), key).where("_same > 1")
            .select(F.explode(F.array_repeat("_row", F.col("_same").cast("int") - 1)).alias("_row")).select("_row.*"))
    return first, behind.unionByName(same)


# ---------------------------------------------------------------- queue views

def due_sources(urls: DataFrame, as_of=None) -> DataFrame:
    """S3: sources due now, any state."""
    return urls.where((F.col("kind") == "source") & (F.col("next_crawl_at") <= ts_lit(as_of)))


def due_pages(urls: DataFrame, as_of=None) -> DataFrame:
    """Non-source URLs due now in QUEUED / RETRY / FETCHING."""
    return urls.where((F.col("kind") != "source") & (F.col("next_crawl_at") <= ts_lit(as_of))
                      & F.col("crawl_state").isin(*ACTIVE_URL_STATES))


def front_queue(urls: DataFrame, as_of=None, limit: int | None = None) -> DataFrame:
    """Due sources first, then other due URLs; ``branch``/``sequence`` give
    the order.  Every due row is queued; a ``limit`` keeps the first rows of
    each part, for callers that work in slices."""
    as_of = clock(as_of)
    src, oth = due_sources(urls, as_of), due_pages(urls, as_of)
    if limit is not None:
        src, oth = src.orderBy("sequence").limit(limit), oth.orderBy("sequence").limit(limit)
    return src.withColumn("branch", F.lit(0)).unionByName(oth.withColumn("branch", F.lit(1)))


def back_queue(front: DataFrame) -> DataFrame:
    """A5 + W1: FIFO position of each queued URL within its host, by counts
    over a range partitioning: a host with most of the queue covers many
    ranges.  The crawl loop needs the heads alone (:func:`due_host_heads`)."""
    return positions(front, ["hostname"], ["branch", "sequence", "id"])


def back_queue_hosts(front: DataFrame) -> DataFrame:
    """A5: distinct hosts with their queue length."""
    return front.groupBy("hostname").agg(F.count(F.lit(1)).alias("n_urls"))


def scheduler_queue(front: DataFrame, hostnames: DataFrame, as_of=None) -> DataFrame:
    """S6 + L3: due hosts among those queued, earliest due first; a NULL due
    time counts as now."""
    now = ts_lit(as_of)
    due_at = F.coalesce(F.col("next_allowed_at"), now)
    hosts = hostnames.join(front.select(F.col("hostname").alias("name")).distinct(), "name", "left_semi")
    due = hosts.where(due_at <= now).select("id", "name", due_at.alias("next_allowed_at"))
    return due.orderBy("next_allowed_at", "name")


def due_host_heads(front: DataFrame, hostnames: DataFrame, as_of=None) -> DataFrame:
    """J7 + W1: the head URL of each due host (min of ``(branch, sequence)``
    per host -- a partial aggregation, no window)."""
    sched = scheduler_queue(front, hostnames, clock(as_of))
    head = front.groupBy("hostname").agg(
        F.min(F.struct("branch", "sequence", "id", "url", "kind")).alias("h"))
    heads = head.select("hostname", "h.id", "h.url", "h.kind", "h.branch", "h.sequence")
    return heads.join(sched.select(F.col("name").alias("hostname"), "next_allowed_at"), "hostname")


def queue_sizes(front: DataFrame) -> DataFrame:
    """Queue totals."""
    return front.agg(
        F.count(F.lit(1)).alias("n_items"),
        F.countDistinct("hostname").alias("n_hosts"),
        F.sum(F.when(F.col("kind") == "source", 1).otherwise(0)).cast("bigint").alias("n_sources"),
        F.sum(F.when(F.col("kind") != "source", 1).otherwise(0)).cast("bigint").alias("n_pages"))


# ---------------------------------------------------------------- transitions

def lease_hostnames(hostnames: DataFrame, requests: DataFrame, as_of=None,
                    lease_seconds: int = K.HOSTNAME_LEASE_SECONDS) -> DataFrame:
    """A requested host that is due gets ``next_allowed_at = now + lease``."""
    now = ts_lit(as_of)
    req = requests.select("id").distinct().withColumn("_req", F.lit(True))
    j = hostnames.join(req, "id", "left")
    applied = F.coalesce(F.col("_req"), F.lit(False)) & (F.coalesce(F.col("next_allowed_at"), now) <= now)
    return (j.withColumn("applied", applied)
            .withColumn("next_allowed_at", F.when(F.col("applied"), plus_seconds(now, lease_seconds))
                        .otherwise(F.col("next_allowed_at")))
            .drop("_req"))


def claimable(kind: Column, state: Column, next_crawl_at: Column, now: Column) -> Column:
    """C2 predicate: due, and a source (any state) or an active URL state.
    An expired FETCHING lease is recoverable; a live one is not."""
    return (next_crawl_at <= now) & ((kind == "source") | state.isin(*ACTIVE_URL_STATES))


def claim_urls(urls: DataFrame, requests: DataFrame, as_of=None,
               lease_seconds: int = K.CLAIM_LEASE_SECONDS) -> DataFrame:
    """FETCHING with a lease of ``lease_seconds`` for claimable rows."""
    now = ts_lit(as_of)
    req = requests.select("id").distinct().withColumn("_req", F.lit(True))
    j = urls.join(req, "id", "left")
    applied = F.coalesce(F.col("_req"), F.lit(False)) & claimable(
        F.col("kind"), F.col("crawl_state"), F.col("next_crawl_at"), now)
    return (j.withColumn("applied", applied)
            .withColumn("crawl_state", F.when(F.col("applied"), F.lit(K.CRAWL_FETCHING)).otherwise(F.col("crawl_state")))
            .withColumn("next_crawl_at", F.when(F.col("applied"), plus_seconds(now, lease_seconds))
                        .otherwise(F.col("next_crawl_at")))
            .drop("_req"))


def apply_url_outcomes(urls: DataFrame, outcomes: DataFrame, as_of=None) -> DataFrame:
    """C3 + C4 (URL side): SUCCESS, or RETRY with ``next_crawl_at = now``."""
    now = ts_lit(as_of)
    o = outcomes.groupBy("id").agg(F.min(F.col("success")).alias("_ok"))
    j = urls.join(o, "id", "left")
    hit = F.col("_ok").isNotNull()
    return (j.withColumn("applied", hit)
            .withColumn("crawl_state", F.when(hit & F.col("_ok"), F.lit(K.CRAWL_SUCCESS))
                        .when(hit, F.lit(K.CRAWL_RETRY)).otherwise(F.col("crawl_state")))
            .withColumn("next_crawl_at", F.when(hit & ~F.col("_ok"), now).otherwise(F.col("next_crawl_at")))
            .drop("_ok"))


def finish_urls(urls: DataFrame, won: DataFrame, as_of=None, lease_seconds: int = K.CLAIM_LEASE_SECONDS,
                refresh_seconds: int = K.SOURCE_REFRESH_SECONDS) -> DataFrame:
    """C2, C5 and C3 of one round in one update by id: the state in which claim,
    source refresh and outcome leave the rows of ``won`` (``id``, ``success``,
    claimed and crawled in this round)."""
    now = ts_lit(as_of)
    o = won.groupBy("id").agg(F.min("success").alias("_ok"))
    hit, ok = F.col("_ok").isNotNull(), F.col("_ok")
    later = F.when(F.col("kind") == "source", plus_seconds(now, refresh_seconds)).otherwise(plus_seconds(now, lease_seconds))
    return (urls.join(o, "id", "left")
            .withColumn("crawl_state", F.when(hit & ok, F.lit(K.CRAWL_SUCCESS)).when(hit, F.lit(K.CRAWL_RETRY)).otherwise(F.col("crawl_state")))
            .withColumn("next_crawl_at", F.when(hit & ok, later).when(hit, now).otherwise(F.col("next_crawl_at")))
            .drop("_ok"))


def hostname_stats(hostnames: DataFrame, outcomes: DataFrame, as_of=None,
                   cooldown_seconds: int = K.HOST_COOLDOWN_SECONDS) -> DataFrame:
    """A7 + C4 (host side): success bumps crawl_count and success_count, an
    error only failure_count; last_crawled_at = now and the host is
    rescheduled ``cooldown`` seconds per crawl after its scheduled time."""
    now = ts_lit(as_of)
    per_host = outcomes.groupBy("hostname").agg(
        F.sum(F.when(F.col("success"), 1).otherwise(0)).cast("bigint").alias("_ok"),
        F.sum(F.when(F.col("success"), 0).otherwise(1)).cast("bigint").alias("_err"))
    j = hostnames.join(per_host.withColumnRenamed("hostname", "name"), "name", "left")
    hit = F.col("_ok").isNotNull()
    n = F.coalesce(F.col("_ok"), F.lit(0)) + F.coalesce(F.col("_err"), F.lit(0))
    sched = F.coalesce(F.col("next_allowed_at"), now)
    return (j.withColumn("applied", hit)
            .withColumn("crawl_count", F.col("crawl_count") + F.coalesce(F.col("_ok"), F.lit(0)))
            .withColumn("success_count", F.col("success_count") + F.coalesce(F.col("_ok"), F.lit(0)))
            .withColumn("failure_count", F.col("failure_count") + F.coalesce(F.col("_err"), F.lit(0)))
            .withColumn("last_crawled_at", F.when(hit, now).otherwise(F.col("last_crawled_at")))
            .withColumn("next_allowed_at", F.when(hit, plus_seconds(sched, n * F.lit(cooldown_seconds)))
                        .otherwise(F.col("next_allowed_at")))
            .drop("_ok", "_err"))


def bump_sources(urls: DataFrame, source_ids: DataFrame, as_of=None,
                 refresh_seconds: int = K.SOURCE_REFRESH_SECONDS) -> DataFrame:
    """Discovered sources recur ``refresh_seconds`` after now."""
    now = ts_lit(as_of)
    ids = source_ids.select("id").distinct().withColumn("_b", F.lit(True))
    j = urls.join(ids, "id", "left")
    hit = F.coalesce(F.col("_b"), F.lit(False)) & (F.col("kind") == "source")
    return (j.withColumn("applied", hit)
            .withColumn("next_crawl_at", F.when(hit, plus_seconds(now, refresh_seconds)).otherwise(F.col("next_crawl_at")))
            .drop("_b"))


def create_source_urls(links: DataFrame, urls: DataFrame, as_of=None) -> DataFrame:
    """C6 + J6 + X3: new QUEUED URL rows (kind ``url``, due now) for links not
    yet in the URL table.  A link found by several sources is credited to
    the earliest source (by sequence); rows without a host are skipped."""
    from ..functions.urls import url_hostname
    now = ts_lit(as_of)
    first = links.groupBy(F.col("link").alias("url")).agg(
        F.min_by("source", "source_seq").alias("source"))
    fresh = first.join(urls.select("url"), "url", "left_anti")
    host = url_hostname(F.col("url"))
    return fresh.where(host.isNotNull()).select(
        "url", host.alias("hostname"),
        F.lit(K.CRAWL_QUEUED).alias("crawl_state"),
        F.lit("url").alias("kind"),
        "source",
        now.alias("next_crawl_at"))


def enqueue(table: DataFrame, new_rows: DataFrame, schema=None) -> DataFrame:
    """Append new rows to a table snapshot (missing columns take their
    declared defaults, or NULL); the caller writes the result to a new path."""
    from ..operators.quality import apply_defaults
    rows = apply_defaults(new_rows, schema) if schema is not None else new_rows
    return table.unionByName(rows, allowMissingColumns=True)


def retry_source(urls: DataFrame, hostnames: DataFrame, requests: DataFrame, as_of=None):
    """C12 + J8: requested URLs back to QUEUED and due now; their hosts due
    now.  Returns ``(new_urls, new_hostnames)``."""
    now = ts_lit(as_of)
    req = requests.select("id").distinct().withColumn("_r", F.lit(True))
    u = urls.join(req, "id", "left")
    hit = F.coalesce(F.col("_r"), F.lit(False))
    new_urls = (u.withColumn("applied", hit)
                .withColumn("crawl_state", F.when(hit, F.lit(K.CRAWL_QUEUED)).otherwise(F.col("crawl_state")))
                .withColumn("next_crawl_at", F.when(hit, now).otherwise(F.col("next_crawl_at")))
                .drop("_r"))
    hosts = (urls.join(req, "id").select(F.col("hostname").alias("name")).distinct()
             .withColumn("_h", F.lit(True)))
    h = hostnames.join(hosts, "name", "left")
    hh = F.coalesce(F.col("_h"), F.lit(False))
    new_hosts = (h.withColumn("applied", hh)
                 .withColumn("next_allowed_at", F.when(hh, now).otherwise(F.col("next_allowed_at")))
                 .drop("_h"))
    return new_urls, new_hosts


PATCHABLE = ["priority_score", "crawl_state", "next_crawl_at"]


def patch_source(urls: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """C11 + Q4: apply per-field patches (``set_<field>`` flags say which
    fields a request sets).  Rejected with a reason: requests that set nothing,
    requests for an id that is not there, and all but the earliest
    (``request_seq``) of several for one id."""
    flags = [F.coalesce(F.col(f"set_{f}"), F.lit(False)) for f in PATCHABLE]
    any_set = flags[0] | flags[1] | flags[2]
    empty = patches.where(~any_set).select("id", F.lit("No fields to update").alias("reason"))
    known = urls.select("id").distinct()
    absent = patches.where(any_set).join(known, "id", "left_anti").select("id", F.lit("No such URL").alias("reason"))
    ok, late = winners(patches.where(any_set).join(known, "id", "left_semi"), "id")
    rejected = empty.unionByName(absent).unionByName(late.select("id", F.lit("An earlier request for this URL wins").alias("reason")))
    renamed = ok.select("id", *[F.col(f).alias(f"_new_{f}") for f in PATCHABLE],
                        *[F.col(f"set_{f}").alias(f"_set_{f}") for f in PATCHABLE], F.lit(True).alias("_p"))
    j = urls.join(renamed, "id", "left")
    for f in PATCHABLE:
        j = j.withColumn(f, F.when(F.coalesce(F.col(f"_set_{f}"), F.lit(False)), F.col(f"_new_{f}"))
                         .otherwise(F.col(f)))
    j = j.withColumn("applied", F.coalesce(F.col("_p"), F.lit(False)))
    return j.drop("_p", *[f"_new_{f}" for f in PATCHABLE], *[f"_set_{f}" for f in PATCHABLE]), rejected


# ---------------------------------------------------------------- content queue

def content_queue(content: DataFrame, limit: int | None = None) -> DataFrame:
    """Every PENDING content row, oldest first (a range-partitioned sort);
    ``limit`` takes the first rows for callers that work in slices."""
    queue = content.where(F.col("pipeline_state") == K.PIPE_PENDING).orderBy("scraped_at", "id")
    return queue if limit is None else queue.limit(limit)


def claim_content(content: DataFrame, requests: DataFrame) -> DataFrame:
    """PENDING -> SUMMARIZING for the requested rows."""
    req = requests.select("id").distinct().withColumn("_r", F.lit(True))
    j = content.join(req, "id", "left")
    hit = F.coalesce(F.col("_r"), F.lit(False)) & (F.col("pipeline_state") == K.PIPE_PENDING)
    return (j.withColumn("applied", hit)
            .withColumn("pipeline_state", F.when(hit, F.lit(K.PIPE_SUMMARIZING)).otherwise(F.col("pipeline_state")))
            .drop("_r"))
