"""End-to-end feed build (F5): score -> select -> publish -> mark shown."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .. import constants as K
from ..functions.common import clock
from ..operators.profile import tag_profile
from ..operators.scoring import content_window, score_content
from ..operators.selection import mark_shown, select_feed, serialize_feed
from ..session import cut_lineage
from ..sources.sinks import publish_feed


def scored_candidates(content: DataFrame, interactions: DataFrame, as_of=None,
                      window_days: int | None = None, exclude_seen: bool = False) -> DataFrame:
    """F1: profile (A1-A3) -> candidate scan (S2) -> per-post scores."""
    as_of = clock(as_of)
    profile = tag_profile(interactions, as_of)
    cands = content_window(content, as_of, window_days, exclude_seen)
    return score_content(cands, profile, as_of)


def build_feed(content: DataFrame, interactions: DataFrame, out_dir: str, as_of=None,
               limit: int = K.FEED_LIMIT) -> tuple[DataFrame | None, DataFrame | None]:
    """Run one build at ``as_of`` (default: now, taken once).  Returns ``(feed, new_content_snapshot)``; both are None
    when there are no candidates, and the snapshot is None when publishing
    failed (content is only marked shown after a successful publish)."""
    as_of = clock(as_of)
    scored = cut_lineage(scored_candidates(content, interactions, as_of))  # the test and the selection both read it
    if scored.isEmpty():
        return None, None
    feed = select_feed(scored, limit, written=True)
    payload = serialize_feed(feed, as_of)
    ok, _err = publish_feed(payload, out_dir)
    if not ok:
        return feed, None
    return feed, mark_shown(content, feed, as_of)
