"""Crawl-side batch jobs over a pages table: content ingest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions import simhash as SH
from ..functions.common import clock, ts_lit
from ..functions.text import html_title, page_chunks, page_sections, relevant_sections
from ..functions.urls import is_ignored_url
from ..operators.bandindex import ContentIndex
from ..operators.dedup import dedup_content, near_dup_urls, with_bands
from ..operators.groups import near_copy_groups


def crawl_pages(pages: DataFrame) -> DataFrame:
    """S8 + U6: fetched pages minus junk URLs, with title and text chunks."""
    kept = pages.where(~is_ignored_url(F.col("url")))
    return kept.select("page_id", "url", html_title(F.col("html")).alias("title"),
                       page_chunks(F.col("html")).alias("chunks"))


KEEP_BROADCAST_ROWS = 1_000_000  # ids of kept rows: eight bytes each


def stored_fingerprints(stored: DataFrame) -> DataFrame:
    """``(url, simhash)`` with the fingerprint as a 64-bit number, from a
    content table (decimal text, as declared) or from numbers."""
    h = F.col("simhash")
    if isinstance(stored.schema["simhash"].dataType, T.StringType):
        h = SH.from_text(h)
    return stored.select(F.col("url") if "url" in stored.columns else F.lit(None).cast("string").alias("url"), h.alias("simhash"))


def content_ingest(pages: DataFrame, existing: DataFrame | ContentIndex, as_of=None,
                   threshold: float = K.SIMILARITY_THRESHOLD, dedup_in_batch: bool | str = False, before: int | None = None) -> DataFrame:
    """New PENDING content rows from crawled pages.

    Junk URLs are dropped, each page is fingerprinted on its whole body text (its
    chunks are those of the sections relevant to its title), pages
    whose url is stored already and pages equal or similar to *stored* content
    (band semi-join) are skipped, of several pages with one url the first (by
    id) stays, and the rest become content rows as declared in ``schemas``.
    ``existing`` needs ``simhash`` and, for the check of urls, ``url``; or it is
    a ``ContentIndex``, whose rows (of batches ``before`` the one given) are
    looked up without being exploded or shuffled.  With ``dedup_in_batch`` only the first page of each exact fingerprint in the
    batch is kept, with ``dedup_in_batch="near"`` the first (by id) of each group
    of near copies.

    The HTML is parsed once: chunks and fingerprint come from the row itself
    and are written to the shared folder.  All decisions are taken on
    ``(id, url, simhash)``; the ids that stay meet the chunks by a broadcast
    where they are counted to be few enough, else by a shuffle.
    """
    from ..session import cut_lineage
    indexed = isinstance(existing, ContentIndex)
    existing = existing if indexed else stored_fingerprints(existing)
    parsed = pages.where(~is_ignored_url(F.col("url"))).select(
        F.col("page_id").alias("id"), "url", html_title(F.col("html")).alias("title"), page_sections(F.col("html")).alias("sections"))
    parsed = cut_lineage(parsed.select(
        "id", "url", "title", F.flatten(relevant_sections(F.col("sections"), F.col("title"))).alias("chunks"),
        SH.fingerprint(SH.tokens(F.array_join(F.flatten("sections"), "\n"))).alias("simhash")))
    narrow = parsed.select("id", "url", "simhash")
    if indexed:
        fresh = existing.unknown_urls(narrow, before)
        fresh = dedup_content(fresh, existing.near_dup_urls(fresh, threshold, before))
    else:
        fresh = narrow.join(existing.where("url IS NOT NULL").select("url").distinct(), "url", "left_anti")
        fresh = dedup_content(fresh, near_dup_urls(fresh, existing, threshold))
    fresh = fresh.groupBy("url").agg(F.min(F.struct("id", "simhash")).alias("first")).select("url", "first.*")
    if dedup_in_batch == "near":
        fresh = near_copy_groups(cut_lineage(fresh), threshold).where("id = group_id")
    elif dedup_in_batch:
        fresh = fresh.groupBy("simhash").agg(F.min(F.struct("id", "url")).alias("first")).select("first.*")
    keep = cut_lineage(fresh.select("id", "url"))
    if keep.limit(KEEP_BROADCAST_ROWS + 1).count() <= KEEP_BROADCAST_ROWS:
        keep = F.broadcast(keep)
    rows = with_bands(parsed.join(keep, ["id", "url"], "left_semi"))
    if narrow.groupBy("id", "url").count().where("count > 1").limit(1).count():  # a page given twice
        rows = rows.dropDuplicates(["url"])
    return rows.select(
        "url",
        F.try_element_at(F.split(F.col("url"), "/"), F.lit(3)).alias("hostname"),
        "title",
        SH.unsigned_text(F.col("simhash")).alias("simhash"),
        *[f"simhash_{k + 1}" for k in range(K.SIMHASH_BANDS)],
        "chunks",
        F.array().cast("array<string>").alias("tags"),
        ts_lit(as_of).alias("scraped_at"),
        F.lit(K.PIPE_PENDING).alias("pipeline_state"),
    )


def fetched(won: DataFrame, pages: DataFrame) -> DataFrame:
    """The claimed rows with ``success``: whether the crawl brought a page."""
    there = pages.select(F.col("page_id").alias("id")).distinct().withColumn("_page", F.lit(True))
    return won.join(there, "id", "left").withColumn("success", F.coalesce("_page", F.lit(False))).drop("_page")


def discover_sources(urls: DataFrame, pages: DataFrame, as_of=None) -> tuple[DataFrame, DataFrame]:
    """Claim due sources, extract their same-site links, create URL rows
    for unseen links, bump each source's next crawl and mark it SUCCESS.  A
    source without a page goes to RETRY, due now.

    Returns ``(new_url_rows, new_url_table)``; the new rows are not yet in
    the returned table (append them with ``unionByName``)."""
    from ..operators import frontier as FR
    from ..operators.links import extract_links

    from ..session import cut_lineage

    as_of = clock(as_of)
    claimed = FR.claim_urls(urls, FR.due_sources(urls, as_of).select("id"), as_of)
    won = cut_lineage(fetched(claimed.where(F.col("applied") & (F.col("kind") == "source")), pages).select("id", "url", "hostname", "sequence", "success"))
    src = won.select(F.col("id").alias("page_id"), F.col("url").alias("source"),
                     F.col("sequence").alias("source_seq"), "hostname")
    src_pages = pages.select("page_id", "html").join(src, "page_id")
    links = extract_links(src_pages.withColumn("url", F.col("source")))
    links = links.join(src.select("page_id", "source", "source_seq"), "page_id")
    new_rows = FR.create_source_urls(links, urls, as_of)
    table = FR.bump_sources(claimed.drop("applied"), won.where("success").select("id"), as_of).drop("applied")
    done = FR.apply_url_outcomes(table, won.select("id", "success"), as_of)
    return new_rows, done


def crawl_round(urls: DataFrame, hostnames: DataFrame, pages: DataFrame, existing: DataFrame,
                as_of=None, limit: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One pass of the crawl loop as a batch job.

    Front queue -> the head URL of every due host -> host lease -> URL claim
    -> sources: link discovery (new URL rows, next crawl in 6 h); pages:
    content ingest with the near-duplicate check against ``existing``
    (``url``, ``simhash``) -> SUCCESS for every claimed URL that brought a page
    (one that yields no new content still completes, as in the reference),
    RETRY for the others -> host counters, rescheduled from their scheduled
    time.  ``limit`` bounds each part of the front queue, for rounds in slices.

    Returns ``(url_table, hostname_table, new_content_rows)``.
    """
    from .. import schemas as SC
    from ..operators import frontier as FR
    from ..operators.links import extract_links

    from ..session import cut_lineage

    as_of = clock(as_of)
    front = FR.front_queue(urls, as_of, limit)
    heads = cut_lineage(FR.due_host_heads(front, hostnames, as_of).select("hostname", "id"))
    leased = FR.lease_hostnames(hostnames, heads.select(F.col("hostname").alias("id")), as_of)
    # the leases and claims won this round: at most one row per due host,
    # written once so every later step reads them instead of re-planning
    # the queue views
    lease_won = cut_lineage(leased.where(F.col("applied")).select("id", "name", "next_allowed_at"))
    claimed0 = FR.claim_urls(urls, heads.join(lease_won.select(F.col("name").alias("hostname")), "hostname",
                                              "left_semi").select("id"), as_of)
    won = cut_lineage(fetched(claimed0.where(F.col("applied")), pages).select("id", "url", "hostname", "kind", "sequence", "success"))

    # sources: discover links
    src = won.where(F.col("kind") == "source").select(
        F.col("id").alias("page_id"), F.col("url").alias("source"), F.col("sequence").alias("source_seq"), "hostname")
    src_pages = pages.select("page_id", "html").join(src, "page_id").withColumn("url", F.col("source"))
    links = extract_links(src_pages).join(src.select("page_id", "source", "source_seq"), "page_id")
    new_urls = FR.create_source_urls(links, urls, as_of)

    # pages: ingest content
    crawl_batch = pages.join(won.where(F.col("kind") != "source").select(F.col("id").alias("page_id")), "page_id")
    new_content = content_ingest(crawl_batch, existing, as_of)

    outcomes = won.select("id", "hostname", "success")
    url_table = FR.finish_urls(urls, outcomes, as_of)
    url_table = FR.enqueue(url_table, new_urls.withColumn("sequence", F.lit(None).cast("bigint")), SC.URL)
    # crawled hosts: counters, rescheduled from their scheduled time; hosts
    # leased without a completed crawl keep the lease
    hosts = FR.hostname_stats(hostnames, outcomes, as_of)
    lease = lease_won.select("id", F.col("next_allowed_at").alias("_lease"))
    hosts = (hosts.join(lease, "id", "left")
             .withColumn("next_allowed_at", F.when(~F.col("applied") & F.col("_lease").isNotNull(), F.col("_lease"))
                         .otherwise(F.col("next_allowed_at")))
             .drop("applied", "_lease"))
    return url_table, hosts, new_content
