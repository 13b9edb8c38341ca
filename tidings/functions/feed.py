"""Feed maths as Catalyst expressions (decay, weights, Jaccard, freshness)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .common import whole_days


def decay(weight: Column, age: Column, half_life: float) -> Column:
    """``weight * 0.5 ** (age / half_life)``."""
    return weight * F.pow(F.lit(0.5), age.cast("double") / F.lit(float(half_life)))


def interaction_weight(type_col: Column) -> Column:
    """Interaction type -> weight; unknown types weigh 0.0."""
    expr = None
    for name, w in K.INTERACTION_WEIGHTS.items():
        expr = (F.when(type_col == name, F.lit(w)) if expr is None
                else expr.when(type_col == name, F.lit(w)))
    return expr.otherwise(F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """|A n B| / |A u B| over the distinct elements; 0.0 for two empty sets."""
    union = F.size(F.array_union(a, b))
    inter = F.size(F.array_intersect(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(inter.cast("double") / union.cast("double"))


def age_factor(scraped_at: Column, as_of: Column) -> Column:
    return decay(F.lit(1.0), whole_days(as_of, scraped_at), K.CONTENT_HALF_LIFE_DAYS)


def shown_factor(last_shown_at: Column, as_of: Column) -> Column:
    """1 when never shown, else ``clamp(days_since_shown / 3, 0.15, 1)``."""
    days = whole_days(as_of, last_shown_at).cast("double")
    clamped = F.least(F.greatest(days / F.lit(K.SHOWN_COOLDOWN_DAYS), F.lit(K.SHOWN_FLOOR)), F.lit(1.0))
    return F.when(last_shown_at.isNull(), F.lit(1.0)).otherwise(clamped)


def suppression_penalty(has_hidden_tag: Column) -> Column:
    return F.when(has_hidden_tag, F.lit(K.SUPPRESSED_PENALTY)).otherwise(F.lit(1.0))


def interest(continuity: Column, relevance: Column, novelty: Column) -> Column:
    return (F.lit(K.CONTINUITY_RATIO) * continuity + F.lit(K.RELEVANCE_RATIO) * relevance
            + F.lit(K.NOVELTY_RATIO) * novelty)


def quota(limit: Column, ratio: float) -> Column:
    """Python ``round(limit * ratio)``: half to even on the double product."""
    return F.bround(limit.cast("double") * F.lit(float(ratio)), 0).cast("bigint")
