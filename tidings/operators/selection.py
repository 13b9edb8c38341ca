"""Budgeted, diversified feed selection (quotas + MMR over tag Jaccard).

Greedy MMR is sequential, but a post's MMR only falls while posts are picked: it
is at most its weighted signal, which it has as long as no chosen post shares a
tag.  So the picks are made lazily.  For each signal the posts of the highest
values are fetched, a bounded number per feed; the picks are made among these,
and one is certain if its MMR is above the value of the last post fetched for
its signal, which no other post can exceed.  A feed whose picks are all certain
is done.  For the others more is fetched, and at last (a feed whose posts are
all alike) its picks are made one by one over all its posts.

Of one tag set at most ``limit`` posts per signal can ever be picked, since the
penalty is the same for all of them; ``mmr_candidates`` keeps exactly those rows
with a per-key top-k window (Spark plans it as a partial WindowGroupLimit before
the shuffle, so a tag set holding a third of all posts costs ``limit`` rows per
map partition).
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.common import ts_lit
from ..functions.feed import jaccard, quota
from .scoring import rank_order

SIGNALS = ["continuity", "relevance", "novelty", "interest"]


def quotas(limit: int) -> list[tuple[str, int]]:
    """M8: slots per bucket with Python's half-to-even ``round``."""
    return [("continuity", round(limit * K.CONTINUITY_RATIO)),
            ("relevance", round(limit * K.RELEVANCE_RATIO)),
            ("novelty", round(limit * K.NOVELTY_RATIO))]


def quota_columns(limit: Column) -> list[Column]:
    """M8 as columns, for many feeds / limits at once."""
    return [quota(limit, K.CONTINUITY_RATIO).alias("continuity_slots"),
            quota(limit, K.RELEVANCE_RATIO).alias("relevance_slots"),
            quota(limit, K.NOVELTY_RATIO).alias("novelty_slots")]


def tag_set(tags: Column) -> Column:
    return F.array_sort(F.array_distinct(tags))


CAND_COLUMNS = ["id", "tags", "score", "scraped_at", *SIGNALS, "freshness"]


def mmr_candidates(scored: DataFrame, limit: int = K.FEED_LIMIT) -> DataFrame:
    """Rows that can ever be picked -- the top ``limit`` of each tag set
    for each of the four signals (gated by freshness), in rank order.

    Narrow ``(id, signal, value)`` rows are ranked by one window keyed by
    ``(tag_set, signal)``; the ``rn <= limit`` filter is planned as a partial
    WindowGroupLimit before the shuffle, and the wide rows are picked by a
    semi-join on the few ids that are left."""
    return scored.join(_top_ids(scored, [], limit), "id", "left_semi")


def _top_ids(scored: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Ids among the top ``limit`` of their tag set (within ``keys``) for any
    signal."""
    sig = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), (F.col(s) * F.col("freshness")).alias("value"))
                              for s in SIGNALS])).alias("sv")
    rows = scored.select(*keys, "id", "score", "scraped_at", tag_set(F.col("tags")).alias("_tag_set"), sig)
    w = Window.partitionBy(*keys, "_tag_set", "sv.signal").orderBy(F.col("sv.value").desc(), *rank_order())
    top = rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= limit)
    return top.select(*keys, "id").distinct()


def pick_schedule(limit: int) -> list[str]:
    """The signal of every pick: bucket quotas in order, cut at ``limit``,
    then top-up by interest.  A feed whose pool runs dry gets no further
    picks, so one schedule serves every feed."""
    sched: list[str] = []
    for signal, q in quotas(limit):
        sched += [signal] * q
    sched = sched[:limit]
    return sched + ["interest"] * (limit - len(sched))


AHEAD = 64  # posts fetched at first for each signal, times the feed's limit
MORE = 8  # times as many at the second try


def _jaccard(a: set, b: set) -> float:
    return len(a & b) / len(a | b) if a or b else 0.0


def lazy_picks(rows: list[dict], bounds: dict[str, float], limit: int) -> tuple[list[tuple[int, str]], bool]:
    """Greedy picks among the fetched ``rows`` (``tags``, ``order``, and per
    signal the weighted value), as (row, signal), and whether all of them are
    certain.  ``bounds``: per signal, what posts that were not fetched can have
    at most (absent: all were).  A row's largest similarity so far is kept, and
    looked at again only if it shares a tag with the last pick."""
    sets = [set(r["tags"] or ()) for r in rows]
    having: dict[str, list[int]] = {}
    for i, tags in enumerate(sets):
        for t in tags:
            having.setdefault(t, []).append(i)
    sim, left = [0.0] * len(rows), dict.fromkeys(range(len(rows)))
    chosen: list[tuple[int, str]] = []
    for signal in pick_schedule(limit):
        mmr = lambda i: rows[i][signal] - (1.0 - K.MMR_LAMBDA) * sim[i]  # noqa: B023,E731
        best = min(left, key=lambda i: (-mmr(i), rows[i]["order"]), default=None)
        bound = bounds.get(signal)
        if best is None or (bound is not None and mmr(best) <= bound):
            return chosen, best is None and not bounds
        chosen.append((best, signal))
        del left[best]
        for t in sets[best]:
            for i in having[t]:
                if i in left:
                    sim[i] = max(sim[i], _jaccard(sets[i], sets[best]))
    return chosen, True


def _weighted(signal: str) -> Column:
    """A post's MMR while no chosen post shares a tag (null: below all)."""
    return F.coalesce(F.lit(K.MMR_LAMBDA) * F.col(signal) * F.col("freshness"), F.lit(float("-inf")))


def _fetched(pool: DataFrame, ahead: int) -> DataFrame:
    """Per feed, the ids of the ``ahead`` posts of highest value for each
    signal, and what is left can have at most: ``(_feed, ids, bounds)``."""
    values = F.explode(F.array(*[F.struct(F.lit(s).alias("signal"), _weighted(s).alias("value")) for s in SIGNALS])).alias("sv")
    w = Window.partitionBy("_feed", "sv.signal").orderBy(F.col("sv.value").desc(), *rank_order())
    rows = pool.select("_feed", "id", "score", "scraped_at", values).withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= ahead)
    return rows.select("_feed", "id", F.when(F.col("_rn") == ahead, F.struct("sv.signal", "sv.value")).alias("last"))


PICKS = "_feed string, id string, pick int, bucket string, certain boolean"


def _lazy(pool: DataFrame, limit: int, ahead: int) -> DataFrame:
    """``PICKS`` of every feed from its fetched posts; a feed without picks
    gets one row without an id."""
    own = _fetched(pool, ahead)
    ids = own.groupBy("_feed", "id").agg(F.collect_list("last").alias("lasts"))
    ts_micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("scraped_at"))
    rows = pool.join(ids, ["_feed", "id"]).select("_feed", "id", F.col("id").cast("string").alias("name"), "tags", "score", ts_micros.alias("micros"), "lasts", *[_weighted(s).alias(s) for s in SIGNALS])

    def run(key, table):
        import pyarrow as pa

        rows = table.to_pylist()
        bounds = {x["signal"]: x["value"] for r in rows for x in r["lasts"]}
        for r in rows:  # best score, newest, first id; nulls last where descending, first where ascending
            r["order"] = (r["score"] is None, -(r["score"] or 0.0), r["micros"] is None, -(r["micros"] or 0), r["id"] is not None, r["id"])
        chosen, certain = lazy_picks(rows, bounds, limit)
        out = [(key[0].as_py(), rows[i]["name"], n, signal, certain) for n, (i, signal) in enumerate(chosen)]
        out = out or [(key[0].as_py(), None, 0, None, certain)]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_()), strict=True)],
                        names=["_feed", "id", "pick", "bucket", "certain"])

    return rows.groupBy("_feed").applyInArrow(run, PICKS)  # at most four times ``ahead`` rows a feed


def _one_by_one(pool: DataFrame, limit: int) -> DataFrame:
    """``(_feed, id, pick, bucket)`` in ``limit`` distributed rounds.  Each round
    meets the posts with one row per feed, the picks so far, and takes the
    arg-max per feed with ``min_by`` (a partial aggregation)."""
    from ..session import cut_lineage
    ts_micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("scraped_at"))
    chosen = None
    for rnd, signal in enumerate(pick_schedule(limit)):
        if chosen is None:
            left = pool.withColumn("_sim", F.lit(0.0))
        else:
            picked = chosen.groupBy("_feed").agg(F.collect_list("id").alias("_ids"), F.collect_list(F.struct("tags")).alias("_sets"))
            sims = F.transform("_sets", lambda s: jaccard(F.col("tags"), s["tags"]))
            left = pool.join(picked, "_feed").where(~F.array_contains("_ids", F.col("id"))).withColumn("_sim", F.array_max(sims))
        mmr = _weighted(signal) - F.lit(1.0 - K.MMR_LAMBDA) * F.col("_sim")
        key = F.struct((-mmr).alias("a"), (-F.col("score")).alias("b"), (-ts_micros).alias("c"), F.col("id").alias("d"))
        best = left.groupBy("_feed").agg(F.min_by(F.struct("id", "tags"), key).alias("p"))
        picked = best.select("_feed", "p.*", F.lit(rnd).alias("pick"), F.lit(signal).alias("bucket"))
        chosen = cut_lineage(picked if chosen is None else chosen.unionByName(picked))
    return chosen.select("_feed", F.col("id").cast("string").alias("id"), "pick", "bucket")


def _picks(pool: DataFrame, limit: int, ahead: int) -> DataFrame:
    """``(_feed, id, pick, bucket)`` of all feeds: lazily, with more posts for
    the feeds that need them, and one by one for what is left."""
    from ..session import cut_lineage
    columns = ["_feed", "id", "pick", "bucket"]
    found = cut_lineage(_lazy(pool, limit, ahead))
    done = found.where("certain")
    for more in (ahead * MORE, None):
        open_feeds = found.where("NOT certain").select("_feed").distinct()
        if open_feeds.isEmpty():
            break
        rest = cut_lineage(pool.join(open_feeds, "_feed", "left_semi"))
        if more is None:
            return done.select(columns).where("id IS NOT NULL").unionByName(_one_by_one(rest, limit))
        found = cut_lineage(_lazy(rest, limit, more))
        done = done.unionByName(found.where("certain"))
    return done.select(columns).where("id IS NOT NULL")


def select_feeds(scored: DataFrame, feed_col: str = "feed_id", limit: int = K.FEED_LIMIT, ahead: int | None = None, prune: bool = True) -> DataFrame:
    """F3 for many feeds: the picked posts of every feed with their ``pick``
    number, the ``bucket`` that picked them, and their final ``rank`` (score
    descending, ties in pick order)."""
    from ..session import cut_lineage
    base = scored.withColumnRenamed(feed_col, "_key").withColumn("_feed", F.when(F.col("_key").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("_key").cast("string"))))
    if limit <= 0:
        return base.drop("_feed").limit(0).withColumns({"pick": F.lit(0), "bucket": F.lit(""), "rank": F.lit(0).cast("bigint")}).withColumnRenamed("_key", feed_col)
    cols = ["_feed", "_key", *CAND_COLUMNS]
    pool = base.select(*cols)
    if prune:
        pool = pool.join(_top_ids(base, ["_feed"], limit), ["_feed", "id"], "left_semi")
    pool = cut_lineage(pool)
    picks = _picks(pool, limit, ahead or AHEAD * limit).withColumnRenamed("id", "_name")
    out = pool.withColumn("_name", F.col("id").cast("string")).join(F.broadcast(picks) if _few(picks) else picks, ["_feed", "_name"]).drop("_feed", "_name")
    rank = F.row_number().over(Window.partitionBy("_key").orderBy(F.col("score").desc(), F.col("pick")))  # at most ``limit`` rows
    return out.withColumn("rank", rank.cast("bigint")).withColumnRenamed("_key", feed_col)


PICKS_BROADCAST = 100_000


def _few(picks: DataFrame) -> bool:
    return picks.limit(PICKS_BROADCAST + 1).count() <= PICKS_BROADCAST


def pick_order(scored: DataFrame, limit: int = K.FEED_LIMIT, prune: bool = True) -> list[dict]:
    """F2 + F3: the greedy picks of one feed, in pick order (at most ``limit``
    dicts)."""
    picks = select_feeds(scored.withColumn("_one", F.lit("")), "_one", limit, prune=prune)
    rows = picks.select("id", "tags", "score", "bucket", "pick").orderBy("pick").collect()
    return [{"id": r["id"], "tags": list(r["tags"] or []), "score": r["score"], "signal": r["bucket"]} for r in rows]


def select_feed(scored: DataFrame, limit: int = K.FEED_LIMIT, prune: bool = True, written: bool = False) -> DataFrame:
    """the selected posts with their final ``rank`` and the ``bucket`` that
    picked them.  ``scored`` is read several times, so it is written first
    unless it is a ``written`` table."""
    from ..session import cut_lineage
    scored = scored if written else cut_lineage(scored)
    picks = cut_lineage(select_feeds(scored.withColumn("_one", F.lit("")), "_one", limit, prune=prune).select("id", "rank", "bucket"))
    return scored.join(F.broadcast(picks), "id").orderBy("rank")  # at most ``limit`` rows


def utc_isoformat(ts: Column) -> Column:
    """Python ``datetime.isoformat()`` of a UTC time: fractional seconds only
    when non-zero, ``+00:00`` suffix."""
    frac = F.date_format(ts, "SSSSSS")
    return F.when(ts.isNull(), F.lit(None).cast("string")).otherwise(
        F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
                 F.when(frac != "000000", F.concat(F.lit("."), frac)).otherwise(F.lit("")),
                 F.lit("+00:00")))


def serialize_feed(feed: DataFrame, generated_at: str | _dt.datetime | None = None) -> DataFrame:
    """One row ``(date, generated_at, count, payload)`` where payload is
    the JSON document ``{date, generated_at, count, items}`` with the items in
    rank order and null fields kept.  The feed holds at most ``limit`` rows,
    so the one group is bounded."""
    gen = ts_lit(generated_at)
    item = F.struct(
        F.col("rank"),
        F.struct(F.col("id").cast("string").alias("id"), "url", "title", "summary", "tags", "score",
                 utc_isoformat(F.col("scraped_at")).alias("scraped_at")).alias("item"))
    agg = feed.agg(F.sort_array(F.collect_list(item)).alias("ranked"), F.count(F.lit(1)).alias("count"))
    items = F.transform("ranked", lambda x: x["item"])
    out = agg.select(
        F.date_format(gen, "yyyy-MM-dd").alias("date"),
        utc_isoformat(gen).alias("generated_at"),
        F.col("count"),
        items.alias("items"))
    doc = F.to_json(F.struct("date", "generated_at", "count", "items"), {"ignoreNullFields": "false"})
    return out.withColumn("payload", doc)


def mark_shown(content: DataFrame, feed: DataFrame, as_of=None) -> DataFrame:
    """new content snapshot with ``last_shown_at = as_of`` on the published
    ids.  The published side is at most ``limit`` rows, so broadcasting it is
    bounded by construction."""
    shown = F.broadcast(feed.select("id").distinct().withColumn("_shown", F.lit(True)))
    out = content.join(shown, "id", "left")
    out = out.withColumn("last_shown_at", F.when(F.col("_shown"), ts_lit(as_of))
                         .otherwise(F.col("last_shown_at")))
    return out.drop("_shown")
