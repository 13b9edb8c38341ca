"""Content enrichment run as one batch job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import enrich as EN
from ..operators import frontier as FR
from ..session import cut_lineage


def enrichment_run(content: DataFrame, model: EN.Model = EN.keyword_model,
                   limit: int | None = None, allowed_tags: list[str] | None = None,
                   max_workers: int = 1, make_batch_model=None, **rounds) -> tuple[DataFrame, DataFrame]:
    """Queue (every PENDING row; ``limit`` takes the oldest) -> claim (PENDING
    -> SUMMARIZING) -> gate + model + tag clean-up -> COMPLETED or FAILED.

    Returns ``(new_content_snapshot, results)``.  The results are written once
    to the shared folder and the snapshot is built from that table, so the
    model is called once per row and both agree.  Stale SUMMARIZING rows are
    not re-queued, as in the reference."""
    queue = FR.content_queue(content, limit)
    claimed = FR.claim_content(content, queue.select("id"))
    won = claimed.where(F.col("applied"))
    if make_batch_model is not None:  # a model for lists of prompts, tries in rounds
        results = cut_lineage(EN.enrich_in_rounds(won, make_batch_model, allowed_tags=allowed_tags, max_workers=max(1, max_workers), **rounds).drop("tries"))
    else:
        results = cut_lineage(EN.enrich_content(won, model, allowed_tags=allowed_tags, max_workers=max_workers))
    snapshot = EN.apply_enrichment(claimed.drop("applied"), results)
    return snapshot, results
