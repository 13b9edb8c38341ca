"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per

Every query reads the driver tables (or frames Spark derives from them) in
full; nothing is sampled, capped or filtered by id to keep a check cheap.
Compared results go through ``report`` so they render the same way as the
DuckDB strings in ``oracle.py``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from .. import schemas as SC
from ..functions import simhash as SH
from ..functions import tags as TG
from ..functions import text as TX
from ..functions import urls as U
from ..functions.common import report, ts_lit
from ..functions.feed import decay, jaccard
from ..functions.text import html_title, page_chunks
from ..operators import dedup
from ..operators import enrich as EN
from ..operators import frontier as FR
from ..operators import links as LK
from ..operators import profile as prof
from ..operators import quality as QA
from ..operators import scoring, selection
from ..operators import tables as TB
from ..operators.bandindex import ContentIndex
from ..operators.groups import near_copy_groups
from ..operators.listing import ContentListing
from ..operators.stored import BucketedTable
from ..session import cut_lineage, scratch_path
from ..sources import testdata as td
from ..sources.sinks import publish_feed
from ..streaming import jobs as ST
from .enrichment import enrichment_run
from .feed import build_feed
from . import crawl

NOW = td.NOW
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ROWS_ONLY: set[str] = set()


def query(name: str, rows_only: bool = False):
    def deco(fn):
        QUERIES[name] = fn
        if rows_only:
            ROWS_ONLY.add(name)
        return fn
    return deco


# ---------------------------------------------------------------- shared frames

def _interactions(spark, sf):
    return td.interactions(spark, sf)


def _scored(spark, sf):
    content = td.content(spark, sf)
    profile = prof.tag_profile(_interactions(spark, sf), NOW)
    return scoring.score_content(scoring.content_window(content, NOW), profile, NOW)


# ---------------------------------------------------------------- feed maths

@query("interaction_age")
def q_interaction_age(spark, sf):
    df = prof.interaction_age(_interactions(spark, sf), NOW)
    return report(df.select("event_id", "content_id", "tag", "type", "weight", "created_at", "age"))


@query("interaction_weight")
def q_interaction_weight(spark, sf):
    df = _interactions(spark, sf).groupBy("type", "weight").agg(F.count(F.lit(1)).alias("n"))
    return report(df)


@query("decay")
def q_decay(spark, sf):
    df = prof.interaction_age(_interactions(spark, sf), NOW)
    w, age = F.col("weight"), F.col("age")
    return report(df.select(
        "event_id", "tag", "age",
        decay(w, age, K.RECENT_HALF_LIFE_DAYS).alias("recent_decay"),
        decay(w, age, K.LONG_HALF_LIFE_DAYS).alias("long_decay"),
        decay(F.lit(1.0), age, K.CONTENT_HALF_LIFE_DAYS).alias("content_decay")))


@query("tag_profile_raw")
def q_tag_profile_raw(spark, sf):
    return report(prof.tag_profile_raw(_interactions(spark, sf), NOW))


@query("tag_profile")
def q_tag_profile(spark, sf):
    return report(prof.tag_profile(_interactions(spark, sf), NOW))


@query("hidden_tags")
def q_hidden_tags(spark, sf):
    return prof.hidden_tags(_interactions(spark, sf))


@query("content_window")
def q_content_window(spark, sf):
    df = scoring.content_window(td.content(spark, sf), NOW)
    return report(df.select("id", "url", "hostname", "title", "tags", "scraped_at", "last_shown_at",
                            "pipeline_state"))


@query("freshness")
def q_freshness(spark, sf):
    cands = scoring.content_window(td.content(spark, sf), NOW)
    return report(scoring.freshness(cands, prof.hidden_tags(_interactions(spark, sf)), NOW))


@query("score_content")
def q_score_content(spark, sf):
    return report(_scored(spark, sf).select("id", "continuity", "relevance", "novelty", "freshness",
                                            "interest", "score"))


@query("ranked_feed")
def q_ranked_feed(spark, sf):
    return report(scoring.ranked_feed(_scored(spark, sf)).select("id", "url", "title", "score"))


@query("top_n_by_score")
def q_top_n(spark, sf):
    return report(scoring.top_n_by_score(_scored(spark, sf), K.FEED_LIMIT).select("id", "url", "score", "rank"))


@query("feed_quota")
def q_feed_quota(spark, sf):
    per_host = scoring.content_window(td.content(spark, sf), NOW).groupBy("hostname").agg(
        F.count(F.lit(1)).alias("feed_limit"))
    return per_host.select("hostname", "feed_limit", *selection.quota_columns(F.col("feed_limit")))


@query("tag_jaccard")
def q_tag_jaccard(spark, sf):
    cands = scoring.content_window(td.content(spark, sf), NOW)
    first = cands.groupBy("hostname").agg(F.min("id").alias("first_id"))
    ref = cands.select(F.col("id").alias("first_id"), F.col("tags").alias("ref_tags"))
    j = cands.join(first, "hostname").join(ref, "first_id")
    return report(j.select("id", jaccard(F.col("tags"), F.col("ref_tags")).alias("jaccard")))


@query("mmr_candidates")
def q_mmr_candidates(spark, sf):
    return report(selection.mmr_candidates(_scored(spark, sf), K.FEED_LIMIT).select("id", "score"))


@query("select_feed")
def q_select_feed(spark, sf):
    return report(selection.select_feed(_scored(spark, sf), K.FEED_LIMIT)
                  .select("id", "url", "title", "tags", "score", "rank", "bucket"))


@query("serialize_feed")
def q_serialize_feed(spark, sf):
    """The feed document, parsed back: header fields and the ordered items."""
    feed = selection.select_feed(_scored(spark, sf), K.FEED_LIMIT)
    payload = selection.serialize_feed(feed, NOW)
    return _feed_items(payload.select("payload"), "payload")


def _feed_items(documents, column):
    """Published documents, parsed back: one row per item with all its fields."""
    doc = F.from_json(column, "date string, generated_at string, count long, "
                              "items array<struct<id string, url string, title string, summary string, tags array<string>, "
                              "score double, scraped_at string>>")
    parsed = documents.select(doc.alias("d")).select("d.date", "d.generated_at", "d.count", F.posexplode("d.items").alias("pos", "item"))
    return report(parsed.select("date", "generated_at", "count", (F.col("pos") + 1).cast("bigint").alias("rank"), "item.*"))


@query("mark_shown")
def q_mark_shown(spark, sf):
    content = td.content(spark, sf)
    top = scoring.top_n_by_score(_scored(spark, sf), K.FEED_LIMIT)
    return report(selection.mark_shown(content, top, NOW).select("id", "last_shown_at"))


# ---------------------------------------------------------------- SimHash / dedup


def _doc_fp(spark, sf):
    docs = td.read_table(spark, sf, "documents")
    return dedup.doc_simhash(docs, "doc_id", "text")


def _content_fp(spark, sf):
    """Content rows with their fingerprint and scrape time.  A stored content
    table carries ``simhash``; the driver tables do not, so it is derived, and
    written once for the several reads of one query."""
    c = td.content(spark, sf).select("id", "url", "text", "scraped_at")
    return cut_lineage(c.drop("text").join(dedup.doc_simhash(c, "id", "text"), "id"))


INCOMING_SINCE = "2024-01-16 00:00:00"  # FIXTURES B4: the last 15 days are new
MID_MONTH = "2024-01-15 06:00:00"
SECOND_BATCH_SINCE = "2024-01-24 00:00:00"


@query("doc_simhash")
def q_doc_simhash(spark, sf):
    return _doc_fp(spark, sf)


@query("simhash_bands")
def q_simhash_bands(spark, sf):
    fp = dedup.with_bands(_doc_fp(spark, sf))
    return fp.select("doc_id", SH.unsigned_text(F.col("simhash")).alias("simhash_text"),
                     "simhash_1", "simhash_2", "simhash_3", "simhash_4")


def _split_existing(spark, sf):
    """Stored content (scraped before the cut) and newly scraped content
    (since the cut); every row is in exactly one of the two."""
    fp = _content_fp(spark, sf)
    cut = ts_lit(INCOMING_SINCE)
    return fp.where(F.col("scraped_at") < cut), fp.where(F.col("scraped_at") >= cut)


@query("near_dup_urls")
def q_near_dup_urls(spark, sf):
    existing, incoming = _split_existing(spark, sf)
    return dedup.near_dup_urls(incoming, existing)


@query("dedup_content")
def q_dedup_content(spark, sf):
    existing, incoming = _split_existing(spark, sf)
    return dedup.dedup_content(incoming, dedup.near_dup_urls(incoming, existing)).select("id", "url")


@query("near_dup_incremental")
def q_near_dup_incremental(spark, sf):
    """J3 + J4 against the stored index: two batches of new content, of which
    the second also meets what the first one left."""
    existing, incoming = _split_existing(spark, sf)
    index = ContentIndex(spark, scratch_path(spark, "content-index"))
    index.add(existing, 0)
    second = F.col("scraped_at") >= ts_lit(SECOND_BATCH_SINCE)
    found = []
    for batch, rows in ((1, incoming.where(~second)), (2, incoming.where(second))):
        rows = rows.select("id", "url", "simhash")
        dups = cut_lineage(index.near_dup_urls(rows, before=batch))
        index.add(dedup.dedup_content(rows, dups), batch)
        found.append(dups.select(F.lit(batch).alias("batch"), "id", "url"))
    return found[0].unionByName(found[1])


@query("near_copy_groups")
def q_near_copy_groups(spark, sf):
    """C8 / J5 within a batch: groups of near copies among the new content."""
    _, incoming = _split_existing(spark, sf)
    return near_copy_groups(incoming.select("id", "url", "simhash"))


@query("near_dup_candidates")
def q_near_dup_candidates(spark, sf):
    existing, incoming = _split_existing(spark, sf)
    return dedup.near_dup_candidates(incoming, existing)


@query("simhash_groups")
def q_simhash_groups(spark, sf):
    existing, _ = _split_existing(spark, sf)
    return dedup.simhash_groups(existing)


@query("crawl_pages")
def q_crawl_pages(spark, sf):
    return report(crawl.crawl_pages(td.read_table(spark, sf, "pages")).select("page_id", "url", "title", "chunks"))


@query("page_chunks")
def q_page_chunks(spark, sf):
    p = td.read_table(spark, sf, "pages")
    ch = page_chunks(F.col("html"))
    return report(p.select("page_id", html_title(F.col("html")).alias("title"),
                           F.size(ch).cast("bigint").alias("n_chunks"), ch.alias("chunks")))


@query("relevant_sections")
def q_relevant_sections(spark, sf):
    """The sections of every page ranked by its title, and what stays."""
    p = td.read_table(spark, sf, "pages")
    title = html_title(F.col("html"))
    p = p.select("page_id", title.alias("title"), TX.page_sections(F.col("html")).alias("sections"))
    scored = p.withColumn("scores", TX.section_scores(F.col("sections"), F.col("title")))
    return report(scored.select(
        "page_id", "title", F.size("sections").cast("bigint").alias("n_sections"),
        F.size(F.filter("scores", lambda s: s > 0)).cast("bigint").alias("n_scored"), F.array_max("scores").alias("best"),
        F.flatten(TX.relevant_sections(F.col("sections"), F.col("title"))).alias("chunks")))


@query("content_ingest")
def q_content_ingest(spark, sf):
    existing = _content_fp(spark, sf)
    rows = crawl.content_ingest(td.read_table(spark, sf, "pages"), existing, NOW)
    return report(rows.drop("tags"))


# ---------------------------------------------------------------- URLs and links


def _pages_with_host(spark, sf):
    p = td.read_table(spark, sf, "pages")
    return p.select("page_id", "url", "html", U.url_hostname(F.col("url")).alias("hostname"))


@query("url_parts")
def q_url_parts(spark, sf):
    p = td.read_table(spark, sf, "pages")
    u = F.col("url")
    return p.select("page_id", U.url_scheme(u).alias("scheme"), U.url_netloc(u).alias("netloc"),
                    U.url_path(u).alias("path"), U.url_query(u).alias("query"),
                    U.url_fragment(u).alias("fragment"), U.url_hostname(u).alias("hostname"))


@query("canonicalize_url")
def q_canonicalize_url(spark, sf):
    p = td.read_table(spark, sf, "pages")
    return p.select("page_id", "url", U.canonicalize_url(F.col("url")).alias("canonical"))


@query("is_ignored_url")
def q_is_ignored_url(spark, sf):
    p = td.read_table(spark, sf, "pages")
    return p.select("page_id", "url", U.is_ignored_url(F.col("url")).alias("ignored"))


@query("extract_links")
def q_extract_links(spark, sf):
    return LK.extract_links(_pages_with_host(spark, sf))


@query("filter_links")
def q_filter_links(spark, sf):
    pages = _pages_with_host(spark, sf)
    links = LK.extract_links(pages).join(
        pages.select("page_id", U.url_netloc(F.col("url")).alias("base_host")), "page_id")
    return LK.filter_links(links, "base_host").select("page_id", "canonical", "first_pos")


@query("crawl_scope")
def q_crawl_scope(spark, sf):
    resolved = LK.page_hrefs(td.read_table(spark, sf, "pages"))
    return LK.crawl_scope(resolved).select("page_id", "pos", "absolute", "in_scope")


def _discovery(spark, sf):
    return crawl.discover_sources(td.urls_and_roots(spark, sf), td.read_table(spark, sf, "pages"), NOW)


@query("create_source_urls")
def q_create_source_urls(spark, sf):
    new_rows, _ = _discovery(spark, sf)
    return report(new_rows)


@query("discover_sources")
def q_discover_sources(spark, sf):
    _, table = _discovery(spark, sf)
    return report(table.select("id", "crawl_state", "next_crawl_at", "applied"))


@query("bump_sources")
def q_bump_sources(spark, sf):
    urls = td.urls(spark, sf)
    out = FR.bump_sources(urls, FR.due_sources(urls, NOW).select("id"), NOW)
    return report(out.select("id", "next_crawl_at", "applied"))


# ---------------------------------------------------------------- frontier

def _front(spark, sf):
    return FR.front_queue(td.urls(spark, sf), NOW)


@query("front_queue")
def q_front_queue(spark, sf):
    return _front(spark, sf).select("id", "url", "hostname", "kind", "crawl_state", "branch", "sequence")


@query("back_queue")
def q_back_queue(spark, sf):
    return FR.back_queue(_front(spark, sf)).select("hostname", "pos", "id", "url")


@query("scheduler_queue")
def q_scheduler_queue(spark, sf):
    return report(FR.scheduler_queue(_front(spark, sf), td.hostnames(spark, sf), NOW))


@query("due_host_heads")
def q_due_host_heads(spark, sf):
    heads = FR.due_host_heads(_front(spark, sf), td.hostnames(spark, sf), NOW)
    return report(heads.select("hostname", "id", "url", "kind", "next_allowed_at"))


@query("queue_sizes")
def q_queue_sizes(spark, sf):
    return FR.queue_sizes(_front(spark, sf))


@query("lease_hostnames")
def q_lease_hostnames(spark, sf):
    hosts = td.hostnames(spark, sf)
    sched = FR.scheduler_queue(_front(spark, sf), hosts, NOW)
    return report(FR.lease_hostnames(hosts, sched.select("id"), NOW).select("id", "next_allowed_at", "applied"))


def _claimed(spark, sf):
    urls = td.urls(spark, sf)
    heads = FR.due_host_heads(FR.front_queue(urls, NOW), td.hostnames(spark, sf), NOW)
    return FR.claim_urls(urls, heads.select("id"), NOW)


@query("claim_urls")
def q_claim_urls(spark, sf):
    return report(_claimed(spark, sf).select("id", "crawl_state", "next_crawl_at", "applied"))


@query("claim_stored_urls")
def q_claim_stored_urls(spark, sf):
    """C2 + C3 on a table stored by host: the due heads are claimed and their
    outcomes applied in the buckets of their hosts alone."""
    urls = td.urls(spark, sf)
    table = BucketedTable(spark, scratch_path(spark, "urls"), "hostname")
    table.write(urls)
    heads = cut_lineage(FR.due_host_heads(FR.front_queue(table.rows(), NOW), td.hostnames(spark, sf), NOW).select("hostname", "id"))
    claimed = table.update(heads, lambda t: FR.claim_urls(t, heads, NOW))
    outcomes = cut_lineage(_outcomes(claimed))
    table.update(outcomes, lambda t: FR.apply_url_outcomes(t, outcomes, NOW))
    return report(table.rows().select("id", "hostname", "crawl_state", "next_crawl_at"))


def _outcomes(claimed):
    won = claimed.where(F.col("applied"))
    return won.select("id", "hostname", (~U.is_ignored_url(F.col("url"))).alias("success"))


@query("apply_crawl_outcomes")
def q_apply_crawl_outcomes(spark, sf):
    claimed = _claimed(spark, sf)
    out = FR.apply_url_outcomes(claimed.drop("applied"), _outcomes(claimed), NOW)
    return report(out.select("id", "crawl_state", "next_crawl_at", "applied"))


@query("hostname_stats")
def q_hostname_stats(spark, sf):
    claimed = _claimed(spark, sf)
    out = FR.hostname_stats(td.hostnames(spark, sf), _outcomes(claimed), NOW)
    return report(out.select("name", "crawl_count", "success_count", "failure_count", "last_crawled_at",
                             "next_allowed_at", "applied"))


@query("retry_source")
def q_retry_source(spark, sf):
    urls, hosts = td.urls(spark, sf), td.hostnames(spark, sf)
    req = urls.where(F.col("crawl_state").isin(K.CRAWL_RETRY, K.CRAWL_FAILED)).select("id")
    new_urls, new_hosts = FR.retry_source(urls, hosts, req, NOW)
    out = new_urls.join(new_hosts.select(F.col("name").alias("hostname"),
                                         F.col("next_allowed_at").alias("host_next_allowed_at")), "hostname", "left")
    return report(out.select("id", "crawl_state", "next_crawl_at", "applied", "host_next_allowed_at"))


def _patches(urls):
    """Patches for sources, blocked and failed URLs; sources get two, of which
    the one with the lower number counts; failed ones set nothing; one id is
    not there."""
    src = F.col("kind") == "source"
    blocked = F.col("crawl_state") == K.CRAWL_BLOCKED
    patches = urls.where(src | blocked | (F.col("crawl_state") == K.CRAWL_FAILED)).select(
        "id", F.explode(F.when(src, F.array(F.lit(2), F.lit(1))).otherwise(F.array(F.lit(1)))).alias("request_seq"),
        F.lit(1.0).alias("priority_score"), src.alias("set_priority_score"),
        F.lit(K.CRAWL_QUEUED).alias("crawl_state"), (~src & blocked).alias("set_crawl_state"),
        ts_lit(NOW).alias("next_crawl_at"), (~src & blocked).alias("set_next_crawl_at"))
    patches = patches.withColumn("priority_score", F.col("request_seq").cast("double"))
    absent = patches.where(F.col("set_crawl_state")).withColumn("id", -1 - F.col("id"))
    return patches.unionByName(absent)


@query("patch_source")
def q_patch_source(spark, sf):
    urls = td.urls(spark, sf)
    out, _ = FR.patch_source(urls, _patches(urls))
    return report(out.select("id", "priority_score", "crawl_state", "next_crawl_at", "applied"))


@query("patch_rejected")
def q_patch_rejected(spark, sf):
    urls = td.urls(spark, sf)
    _, rejected = FR.patch_source(urls, _patches(urls))
    return rejected


# ---------------------------------------------------------------- content pipeline

@query("content_queue")
def q_content_queue(spark, sf):
    return report(FR.content_queue(td.content(spark, sf)).select("id", "url", "scraped_at"))


@query("claim_content")
def q_claim_content(spark, sf):
    content = td.content(spark, sf)
    out = FR.claim_content(content, FR.content_queue(content).select("id"))
    return out.select("id", "pipeline_state", "applied")


@query("thin_content")
def q_thin_content(spark, sf):
    c = td.content(spark, sf)
    text = TX.join_chunks(F.col("chunks"))
    return c.select("id", TX.thin_content_reason(text).alias("reason"))


@query("build_enrich_input")
def q_build_enrich_input(spark, sf):
    c = td.content(spark, sf)
    return c.select("id", TX.build_enrich_input(TX.join_chunks(F.col("chunks")), F.col("title"),
                                                F.col("url")).alias("prompt"))


def _raw_tags(spark, sf):
    c = td.content(spark, sf)
    first_line = F.substring_index(F.col("text"), "\n", 1)
    raw = F.concat(F.split(first_line, " "), F.transform("tags", F.upper))
    return c.select("id", raw.alias("raw"))


@query("normalize_tags")
def q_normalize_tags(spark, sf):
    return report(_raw_tags(spark, sf).select("id", TG.normalize_tags(F.col("raw")).alias("tags")))


@query("filter_tags")
def q_filter_tags(spark, sf):
    return report(_raw_tags(spark, sf).select("id", TG.filter_tags(F.col("raw")).alias("tags")))


@query("finalize_tags")
def q_finalize_tags(spark, sf):
    return report(_raw_tags(spark, sf).select("id", TG.finalize_tags(F.col("raw")).alias("tags")))


@query("finalize_tags_allowed")
def q_finalize_tags_allowed(spark, sf):
    """T9 with an allow-list: two of the row's own tags in other spellings and
    the first word of its title."""
    c = td.content(spark, sf).select("id", F.concat(F.transform(F.slice("tags", 1, 2), lambda t: F.concat(F.lit(" "), F.upper(t))),
                                                    F.array(F.substring_index("title", " ", 1))).alias("allowed"))
    rows = _raw_tags(spark, sf).join(c, "id")
    return report(rows.select("id", TG.finalize_tags(F.col("raw"), F.col("allowed")).alias("tags")))


@query("is_ignored_tag")
def q_is_ignored_tag(spark, sf):
    words = _raw_tags(spark, sf).select(F.explode("raw").alias("tag")).distinct()
    return words.select("tag", TG.is_ignored_tag(F.col("tag")).alias("ignored"))


@query("parse_vocabulary")
def q_parse_vocabulary(spark, sf):
    b = td.read_table(spark, sf, "benchmark")
    return report(b.select("item_id", TG.parse_vocabulary(F.col("text")).alias("vocabulary")))


@query("tag_field_names")
def q_tag_field_names(spark, sf):
    b = td.read_table(spark, sf, "benchmark")
    v = b.select("item_id", F.posexplode(TG.parse_vocabulary(F.col("text"))).alias("idx", "tag"))
    return v.select("item_id", F.col("idx").cast("bigint").alias("idx"), "tag",
                    TX.tag_field_name(F.col("tag"), F.col("idx")).alias("field"))


def _grading_cases(spark, sf):
    """Cases from labelled content: the deterministic gate decides the error,
    stored title and tags stand for the model output, labels set the
    expectations."""
    c = td.content(spark, sf)
    labels = td.read_table(spark, sf, "labels")
    text = TX.join_chunks(F.col("chunks"))
    err = F.when(TX.thin_content_reason(text).isNotNull(), F.lit("ThinContentError"))
    empty = F.array().cast("array<string>")
    cases = c.join(labels.withColumnRenamed("doc_id", "id"), "id").select(
        "id",
        F.when(F.col("id") % 2 == 0, F.slice("tags", 1, 2 + (F.col("id") % 4 / 2).cast("int"))).otherwise(empty).alias("allowed_tags"),
        F.when(err.isNull(), F.col("title")).otherwise(F.lit("")).alias("summary"),
        F.when(err.isNull(), F.col("tags")).otherwise(empty).alias("tags"),
        err.alias("error"),
        F.when(F.col("quality") == 0, F.lit("ThinContentError")).alias("expect_error"),
        F.array(F.col("hostname")).alias("expected_tags"),
        F.when(F.col("toxic") == 1, F.array(F.lit("t0"))).otherwise(empty).alias("forbidden_tags"),
        F.array(F.lower(F.substring_index(F.col("title"), " ", 1))).alias("keywords"),
        F.lit(8).alias("min_summary_words"),
        (F.col("toxic") == 1).alias("expect_empty_tags"))
    return cases


@query("grade_enrichment")
def q_grade_enrichment(spark, sf):
    return EN.grade_enrichment(_grading_cases(spark, sf)).select("id", *EN.GRADERS)


@query("enrichment_pass_rate")
def q_enrichment_pass_rate(spark, sf):
    return report(EN.enrichment_pass_rate(EN.grade_enrichment(_grading_cases(spark, sf))))


@query("enrich_content")
def q_enrich_content(spark, sf):
    _, res = enrichment_run(td.content(spark, sf))
    return report(res)


def _keyword_batches():
    """A batch model of ``keyword_model`` that is too busy for some prompts of
    lists longer than four."""
    def model(prompts):
        return [RuntimeError("busy") if len(prompts) > 4 and len(p) % 7 == 0 else EN.keyword_model(p) for p in prompts]
    return model


@query("enrich_in_rounds")
def q_enrich_in_rounds(spark, sf):
    """E1 with a batch model: the same answers as one prompt at a time, though
    some prompts fail until their lists are short enough."""
    _, res = enrichment_run(td.content(spark, sf), make_batch_model=_keyword_batches, pause=lambda tries: 0.0)
    return report(res)


@query("apply_enrichment")
def q_apply_enrichment(spark, sf):
    snapshot, _ = enrichment_run(td.content(spark, sf))
    return report(snapshot.select("id", "pipeline_state", "summary", "tags", "pipeline_error"))


VOCABULARY = ["That", "with", " from ", "this", "ciónes", "home", "avec", "nicht", "have", "tion"]


@query("enrich_allowed")
def q_enrich_allowed(spark, sf):
    """One flag per entry of a closed vocabulary, decoded to tags."""
    _, res = enrichment_run(td.content(spark, sf), EN.vocabulary_model(VOCABULARY), allowed_tags=VOCABULARY)
    return report(res)


# ---------------------------------------------------------------- table API


@query("list_sources")
def q_list_sources(spark, sf):
    return report(TB.list_sources(td.urls(spark, sf)))


@query("list_hostnames")
def q_list_hostnames(spark, sf):
    return report(TB.list_hostnames(td.hostnames(spark, sf)))


@query("list_content")
def q_list_content(spark, sf):
    return report(TB.list_content(td.content(spark, sf), tag="src3"))


def _page_cursor(spark, sf, n: int):
    """The id of the ``n``-th row of the unfiltered content listing -- what a
    client passes back as its cursor (at most ``n`` rows reach the driver)."""
    rows = TB.list_content(td.content(spark, sf), limit=n).select("id").collect()
    return rows[-1]["id"] if rows else None


@query("list_content_after")
def q_list_content_after(spark, sf):
    cur = _page_cursor(spark, sf, K.LIST_LIMIT)
    return report(TB.list_content(td.content(spark, sf), after_id=cur))


@query("list_content_before")
def q_list_content_before(spark, sf):
    cur = _page_cursor(spark, sf, 2 * K.LIST_LIMIT)
    return report(TB.list_content(td.content(spark, sf), before_id=cur))


@query("list_content_after_filtered")
def q_list_content_after_filtered(spark, sf):
    """P4 with a filter: the cursor row itself need not pass it."""
    cur = _page_cursor(spark, sf, K.LIST_LIMIT)
    return report(TB.list_content(td.content(spark, sf), tag="t7", after_id=cur))


def _stored_listing(spark, sf):
    listing = ContentListing(spark, scratch_path(spark, "listing"))
    listing.write(td.content(spark, sf).drop("text", "chunks"))
    return listing


@query("list_content_stored")
def q_list_content_stored(spark, sf):
    """P3 on the stored layout: day counts, postings, rows."""
    return report(_stored_listing(spark, sf).list_content(tag="src3"))


@query("list_content_after_stored")
def q_list_content_after_stored(spark, sf):
    """P4 with a filter on the stored layout."""
    cur = _page_cursor(spark, sf, K.LIST_LIMIT)
    return report(_stored_listing(spark, sf).list_content(tag="t7", after_id=cur))


@query("list_sources_filtered")
def q_list_sources_filtered(spark, sf):
    """P1 with other kinds and an IN filter."""
    return report(TB.list_sources(td.urls(spark, sf), kind="url", sources=["seed", "api"]))


@query("lookup_by_id")
def q_lookup_by_id(spark, sf):
    ids = _interactions(spark, sf).select(F.col("content_id").alias("id"))
    rows = TB.lookup_by_id(td.content(spark, sf), ids)
    return report(rows.select(*TB.CONTENT_COLUMNS))


@query("source_state_view")
def q_source_state_view(spark, sf):
    return TB.source_state_view(td.urls(spark, sf))


@query("create_source")
def q_create_source(spark, sf):
    urls, hosts = td.urls(spark, sf), td.hostnames(spark, sf)
    roots = hosts.select(F.concat(F.lit("https://"), F.col("name"), F.lit("/")).alias("url"))
    again = urls.where(F.col("kind") == "source").select("url")
    reqs = roots.unionByName(again).select("url", F.lit("source").alias("kind"), F.col("url").alias("source"))
    # each root once more as a page, later: it loses
    late = roots.select("url", F.lit("url").alias("kind"), F.lit("api").alias("source"), F.lit(2).alias("request_seq"))
    reqs = reqs.withColumn("request_seq", F.lit(1)).unionByName(late)
    new_urls, new_hosts, rejected = TB.create_source(reqs, urls, hosts, NOW)
    ok = new_urls.select("url", "kind", "hostname", F.lit("accepted").alias("status"))
    bad = rejected.select("url", "kind", U.url_hostname(F.col("url")).alias("hostname"), F.col("reason").alias("status"))
    return ok.unionByName(bad)


@query("validate_table")
def q_validate_table(spark, sf):
    return QA.validate_table(td.urls(spark, sf), SC.URL)


@query("unique_violations")
def q_unique_violations(spark, sf):
    return QA.unique_violations(td.urls(spark, sf), "hostname")


@query("unique_urls")
def q_unique_urls(spark, sf):
    """Q2 on a column declared unique, over stored URLs and discovered ones."""
    new_rows, _ = _discovery(spark, sf)
    table = FR.enqueue(td.urls(spark, sf), new_rows, SC.URL)
    return QA.unique_violations(table.unionByName(table.where(F.col("kind") == "source")), "url")


@query("cast_failures")
def q_cast_failures(spark, sf):
    """Q3: URL rows that came in as text, some of them no numbers."""
    urls = td.urls(spark, sf)
    text = urls.select("url", F.when(F.col("id") % 7 == 0, F.lit("soon")).otherwise(F.col("crawl_state").cast("string")).alias("crawl_state"),
                       F.when(F.col("id") % 5 == 0, F.lit("n/a")).otherwise(F.col("priority_score").cast("string")).alias("priority_score"))
    return QA.cast_failures(text, SC.URL)


@query("apply_defaults")
def q_apply_defaults(spark, sf):
    new_rows, _ = _discovery(spark, sf)
    return report(QA.apply_defaults(new_rows, SC.URL))


# ---------------------------------------------------------------- log appends and upserts

@query("interaction_append")
def q_interaction_append(spark, sf):
    ev = td.read_table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    c = td.content(spark, sf).select(F.col("id").alias("content_id"), "tags")
    req = ev.select("event_id", k.alias("content_id"),
                    td.interaction_type(F.col("event_type"), F.col("value"), k).alias("type"))
    req = req.join(c, "content_id").withColumn("tags", F.concat("tags", F.slice("tags", 1, 1)))
    accepted, _rejected = prof.split_interaction_requests(req)
    return prof.interaction_rows(accepted).select("event_id", "content_id", "tag", "type", "weight")


@query("interaction_rejected")
def q_interaction_rejected(spark, sf):
    """Q4: requests without tags, with the reason."""
    _, rejected = prof.split_interaction_requests(_requests(spark, sf))
    return rejected.select("event_id", "content_id", "type", "reason")


def _requests(spark, sf):
    """Reader requests as they come in (``schemas.REQUEST``)."""
    ev = td.read_table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    c = td.content(spark, sf).select(F.col("id").alias("k"), "tags")
    ev = ev.select("event_id", "ts", "event_type", "value", k.alias("k")).join(c, "k")
    return ev.select("event_id", F.col("k").cast("string").alias("content_id"),
                     td.interaction_type(F.col("event_type"), F.col("value"), F.col("k")).alias("type"), "tags", F.col("ts").cast("timestamp_ntz").alias("created_at"))


@query("tag_score_upsert")
def q_tag_score_upsert(spark, sf):
    inter = _interactions(spark, sf)
    cut = ts_lit("2024-01-15 00:00:00")
    old = prof.tag_profile(inter.where(F.col("created_at") < cut), NOW)
    new = prof.tag_profile(inter.where(F.col("created_at") >= cut), NOW)
    return report(prof.tag_score_upsert(old, new))


# ---------------------------------------------------------------- streaming and sinks


def _request_stream(spark, sf):
    path = scratch_path(spark, "requests")
    _requests(spark, sf).write.parquet(path)
    return ST.request_stream(spark, path)


@query("stream_interactions")
def q_stream_interactions(spark, sf):
    out, ck = scratch_path(spark, "interactions"), scratch_path(spark, "ck-interactions")
    q = ST.stream_interactions(_request_stream(spark, sf), out, ck)
    q.awaitTermination()
    rows = spark.read.parquet(out).withColumn("content_id", F.col("content_id").cast("bigint"))
    return report(rows.select("event_id", "content_id", "tag", "type", "weight", "created_at"))


@query("stream_tag_profile")
def q_stream_tag_profile(spark, sf):
    out, ck = scratch_path(spark, "profile"), scratch_path(spark, "ck-profile")
    q = ST.stream_tag_profile(_request_stream(spark, sf), out, ck, NOW,
                              state_partitions=spark.sparkContext.defaultParallelism)
    q.awaitTermination()
    return report(ST.latest_version(spark, out, NOW))


@query("stream_profile_clocks")
def q_stream_profile_clocks(spark, sf):
    """G2 with a moving clock: two profiles, of the first half of January and
    of its end, from one checkpoint that gets the requests in two parts."""
    path, table, ck = (scratch_path(spark, x) for x in ("requests", "weights", "ck-weights"))
    late = F.col("created_at") >= ts_lit(MID_MONTH)
    requests = _requests(spark, sf)
    profiles = []
    for part, rows, at in (("a", requests.where(~late), MID_MONTH), ("b", requests.where(late), NOW)):
        rows.write.parquet(f"{path}/{part}")
        ST.stream_tag_weights(ST.request_stream(spark, f"{path}/*"), table, ck).awaitTermination()
        profiles.append(ST.profile_at(spark, table, at).withColumn("as_of", F.lit(at)))
    return report(profiles[0].unionByName(profiles[1]))


@query("stream_content_ingest")
def q_stream_content_ingest(spark, sf):
    fp = ST.write_existing_fingerprints(td.content(spark, sf), scratch_path(spark, "existing-fp"))
    out, ck = scratch_path(spark, "ingest"), scratch_path(spark, "ck-ingest")
    q = ST.stream_content_ingest(spark, f"{sf.rstrip('/')}/pages.parquet", fp, out, ck, NOW)
    q.awaitTermination()
    return report(spark.read.parquet(out).drop("tags"))


@query("publish_feed")
def q_publish_feed(spark, sf):
    feed = selection.select_feed(_scored(spark, sf), K.FEED_LIMIT)
    out = scratch_path(spark, "feeds")
    ok, err = publish_feed(selection.serialize_feed(feed, NOW), out)
    if not ok:
        raise err
    return _feed_items(spark.read.text(out), "value")


@query("build_feed")
def q_build_feed(spark, sf):
    content = td.content(spark, sf)
    feed, snapshot = build_feed(content, _interactions(spark, sf), scratch_path(spark, "feeds"), NOW)
    if snapshot is None:
        return content.limit(0).select("id", "last_shown_at")
    return report(snapshot.join(feed.select("id", "rank"), "id").select("id", "rank", "last_shown_at"))


@query("select_feeds")
def q_select_feeds(spark, sf):
    """F3 for many feeds: one feed per source host."""
    scored = _scored(spark, sf).withColumn("feed_id", F.col("hostname"))
    out = selection.select_feeds(scored, "feed_id", K.FEED_LIMIT)
    return report(out.select("feed_id", "id", "rank", "bucket", "score"))


@query("crawl_round")
def q_crawl_round(spark, sf):
    """One batch pass of the crawl loop: every url, host and new content row."""
    existing = _content_fp(spark, sf).select("url", "simhash")
    url_table, hosts, new_content = crawl.crawl_round(td.urls_and_roots(spark, sf), td.hostnames(spark, sf),
                                                      td.read_table(spark, sf, "pages"), existing, NOW)
    none = F.lit(None).cast("bigint")
    rows = url_table.select(F.lit("url").alias("part"), F.col("url").alias("key"), "crawl_state", none.alias("crawls"), none.alias("failures"),
                            F.col("next_crawl_at").alias("at"))
    rows = rows.unionByName(hosts.select(F.lit("host").alias("part"), F.col("name").alias("key"), F.lit(None).cast("int").alias("crawl_state"),
                                         F.col("crawl_count").alias("crawls"), F.col("failure_count").alias("failures"), F.col("next_allowed_at").alias("at")))
    rows = rows.unionByName(new_content.select(F.lit("content").alias("part"), F.concat_ws(" ", "url", "simhash").alias("key"),
                                               F.col("pipeline_state").alias("crawl_state"), none.alias("crawls"), none.alias("failures"), F.col("scraped_at").alias("at")))
    return report(rows)
