"""tidings -- a PySpark-native engine for a personal content feed.

Main entry points (all take and return DataFrames; ``as_of`` is one clock
per run, a ``TIMESTAMP_NTZ`` string or datetime):

Feed
    ``operators.profile.tag_profile(interactions, as_of)``
    ``operators.scoring.content_window(content, as_of)``
    ``operators.scoring.score_content(candidates, profile, as_of)``
    ``operators.selection.select_feed(scored, limit)`` / ``select_feeds(scored, feed_col, limit)``
    ``operators.selection.serialize_feed(feed, generated_at)``, ``sources.sinks.publish_feed(payload, dir)``
    ``plans.feed.build_feed(content, interactions, out_dir, as_of)``

Crawl
    ``operators.frontier``: ``front_queue``, ``back_queue``, ``scheduler_queue``, ``due_host_heads``,
    ``lease_hostnames``, ``claim_urls``, ``apply_url_outcomes``, ``hostname_stats``, ``bump_sources``,
    ``create_source_urls``, ``retry_source``, ``patch_source``, ``enqueue``
    ``operators.links.extract_links`` / ``filter_links``, ``functions.urls.canonicalize_url`` / ``is_ignored_url``
    ``operators.dedup.doc_simhash`` / ``near_dup_urls``
    ``plans.crawl.content_ingest`` / ``discover_sources`` / ``crawl_round``

Content
    ``plans.enrichment.enrichment_run(content, model)``, ``operators.enrich.grade_enrichment``
    ``functions.tags`` and ``functions.text`` (tag clean-up, gates, model input)

Tables and streams
    ``operators.tables`` (listings, cursors, lookups, source creation), ``operators.quality``
    ``streaming.jobs`` (interaction log, tag profile, content ingest)
"""

__version__ = "0.1.0"
