"""Interest profile: decayed per-tag weights from the interaction log.

One hash aggregation keyed by tag (partial aggregation before the shuffle, so
a hot tag costs one partial row per input partition) plus a scalar subquery
for the global maxima -- no unpartitioned window and no join for the
normalisation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.common import ts_lit, whole_days
from ..functions.feed import decay, interaction_weight


def interaction_age(interactions: DataFrame, as_of=None) -> DataFrame:
    """Every interaction with its whole-day ``age`` at ``as_of``."""
    return interactions.withColumn("age", whole_days(ts_lit(as_of), F.col("created_at")))


def tag_profile_raw(interactions: DataFrame, as_of=None) -> DataFrame:
    """A1 + A3: per tag ``sum(w * 0.5^(age/2))``, ``sum(w * 0.5^(age/14))`` and
    whether any HIDE interaction touched it."""
    aged = interaction_age(interactions, as_of)
    w, age = F.col("weight"), F.col("age")
    return aged.groupBy("tag").agg(
        F.sum(decay(w, age, K.RECENT_HALF_LIFE_DAYS)).alias("recent_weight"),
        F.sum(decay(w, age, K.LONG_HALF_LIFE_DAYS)).alias("long_weight"),
        F.max(F.col("type") == "hide").alias("hidden"),
    )


def normalize_profile(raw: DataFrame) -> DataFrame:
    """A2: divide by the maximum over all tags; a non-positive maximum counts
    as 1, so weights may stay negative."""
    def safe(c):
        m = F.max(c)
        return F.when(m > 0, m).otherwise(F.lit(1.0))

    maxima = raw.select(F.struct(safe("recent_weight").alias("r"), safe("long_weight").alias("l"))).scalar()
    safe_r, safe_l = maxima.getField("r"), maxima.getField("l")
    return raw.select(
        "tag",
        (F.col("recent_weight") / safe_r).alias("recent_weight"),
        (F.col("long_weight") / safe_l).alias("long_weight"),
        "hidden",
    )


def tag_profile(interactions: DataFrame, as_of=None) -> DataFrame:
    """A1-A3.  The per-tag sums are written once; the maxima and the result
    both read that table, so the log is aggregated once."""
    from ..session import cut_lineage
    return normalize_profile(cut_lineage(tag_profile_raw(interactions, as_of)))


def hidden_tags(interactions: DataFrame) -> DataFrame:
    """A3 on its own: tags with at least one HIDE interaction."""
    return interactions.where(F.col("type") == "hide").select("tag").distinct()


def tag_score_upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """New snapshot of the TagScore table keyed by tag: every new row, plus
    old rows whose tag is absent from the new set."""
    cols = ["tag", "recent_weight", "long_weight"]
    return new.select(*cols).unionByName(old.select(*cols).join(new.select("tag"), "tag", "left_anti"))


def interaction_rows(requests: DataFrame, distinct_tags: bool = True) -> DataFrame:
    """Interaction requests ``(content_id, type, tags)`` -> log rows,
    one per (distinct) tag with the type's weight.  Requests without tags are
    rejected by the caller (see ``split_interaction_requests``)."""
    tags = F.array_distinct("tags") if distinct_tags else F.col("tags")
    passthrough = [c for c in requests.columns if c != "tags"]
    return requests.select(*passthrough, F.explode(tags).alias("tag"),
                           interaction_weight(F.col("type")).alias("weight"))


def split_interaction_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q4: requests with no tags are rejected with a reason."""
    ok = F.coalesce(F.size("tags"), F.lit(0)) > 0
    accepted = requests.where(ok)
    rejected = requests.where(~ok).withColumn("reason", F.lit("No tags provided"))
    return accepted, rejected
