"""Candidate scan and per-post scoring (continuity, relevance, novelty,
freshness, score)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.common import ts_lit
from ..functions.feed import age_factor, interest, shown_factor, suppression_penalty

# Columns a scored row carries forward (narrow: no text or chunks).
CARRY = ["url", "hostname", "title", "summary", "tags", "scraped_at", "last_shown_at"]


def rank_order():
    """Feed order: score descending; ties newest first, then id."""
    return [F.col("score").desc(), F.col("scraped_at").desc(), F.col("id").asc()]


def content_window(content: DataFrame, as_of=None, window_days: int | None = None,
                   exclude_seen: bool = False) -> DataFrame:
    """Completed content scraped within ``[as_of - window, as_of]`` (both
    ends inclusive).  ``window_days`` of 0/None falls back to 30.  The
    predicates reach the Parquet scan when content is stored as a table."""
    days = window_days or K.FEED_WINDOW_DAYS
    now = ts_lit(as_of)
    since = now - F.make_dt_interval(days=F.lit(int(days)))
    out = content.where((F.col("pipeline_state") == K.PIPE_COMPLETED)
                        & (F.col("scraped_at") >= since) & (F.col("scraped_at") <= now))
    if exclude_seen:
        out = out.where(F.col("last_seen_at").isNull())
    return out


def score_content(candidates: DataFrame, profile: DataFrame, as_of=None) -> DataFrame:
    """F1: join each post's tags with the profile and score it.

    Narrow ``(id, tag)`` rows are looked up with an equi-join (AQE broadcasts
    the profile when its measured size is small, else sort-merge with skew
    splitting) and folded per post with a partial+final hash aggregation on
    ``id``; the carried columns meet the result by ``id``.  Tags without a
    profile entry count as zero, so an inner join and a left join back do.
    """
    now = ts_lit(as_of)
    keep = [c for c in CARRY if c in candidates.columns]
    exploded = candidates.select("id", F.explode("tags").alias("tag"))
    prof = profile.select("tag", "recent_weight", "long_weight", "hidden")
    folded = exploded.join(prof, "tag").groupBy("id").agg(
        F.max("recent_weight").alias("_recent"), F.sum("long_weight").alias("_long"), F.max("hidden").alias("_hidden"))
    per_post = candidates.select("id", *keep).join(folded, "id", "left").select(
        "id", *keep,
        F.coalesce("_recent", F.lit(0.0)).alias("max_recent"),
        F.coalesce("_long", F.lit(0.0)).alias("sum_long"),
        F.coalesce("_hidden", F.lit(False)).alias("has_hidden"))
    n_tags = F.size("tags")
    continuity = F.greatest(F.lit(0.0), F.col("max_recent"))
    relevance = F.when(n_tags > 0, F.col("sum_long") / n_tags.cast("double")).otherwise(F.lit(0.0))
    scored = per_post.select(
        "id", *keep,
        continuity.alias("continuity"),
        relevance.alias("relevance"),
        F.col("has_hidden"),
    ).withColumn("novelty", F.lit(1.0) - F.col("relevance"))
    scored = scored.withColumn(
        "freshness",
        age_factor(F.col("scraped_at"), now) * shown_factor(F.col("last_shown_at"), now)
        * suppression_penalty(F.col("has_hidden")))
    scored = scored.withColumn("interest", interest(F.col("continuity"), F.col("relevance"), F.col("novelty")))
    return scored.withColumn("score", F.col("interest") * F.col("freshness"))


def freshness(candidates: DataFrame, hidden: DataFrame, as_of=None) -> DataFrame:
    """M3-M6: freshness gate per post from its timestamps and hidden tags."""
    now = ts_lit(as_of)
    flagged = (candidates.select("id", F.explode("tags").alias("tag"))
               .join(hidden.select("tag").distinct(), "tag", "left_semi")
               .select("id").distinct().withColumn("has_hidden", F.lit(True)))
    c = candidates.join(flagged, "id", "left").withColumn("has_hidden", F.coalesce("has_hidden", F.lit(False)))
    return c.select(
        "id",
        age_factor(F.col("scraped_at"), now).alias("age_factor"),
        shown_factor(F.col("last_shown_at"), now).alias("shown_factor"),
        suppression_penalty(F.col("has_hidden")).alias("suppressed_penalty"),
        (age_factor(F.col("scraped_at"), now) * shown_factor(F.col("last_shown_at"), now)
         * suppression_penalty(F.col("has_hidden"))).alias("freshness"),
    )


def ranked_feed(scored: DataFrame) -> DataFrame:
    """L1: all scored posts, best first; ties keep newest first, then id.

    A range-partitioned global sort: no single-partition window."""
    return scored.orderBy(*rank_order())


def top_n_by_score(scored: DataFrame, n: int = K.FEED_LIMIT) -> DataFrame:
    """L2: naive top N (TakeOrderedAndProject), with its 1-based rank."""
    top = scored.orderBy(*rank_order()).limit(n)
    from pyspark.sql import Window
    # The window sees at most n rows (after the limit).
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*rank_order())).cast("bigint"))
