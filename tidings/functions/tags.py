"""Tag clean-up rules as array higher-order functions (no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .common import let as _let
from .text import PY_SPACE


def tag_key(t: Column) -> Column:
    """``tag.strip().lower()``."""
    return F.lower(F.regexp_replace(t, f"^{PY_SPACE}+|{PY_SPACE}+$", ""))


def normalize_tags(tags: Column) -> Column:
    """Strip, lower, drop empties, de-duplicate keeping first order."""
    keys = F.transform(tags, tag_key)
    return F.array_distinct(F.filter(keys, lambda t: t != ""))


def parse_vocabulary(text: Column) -> Column:
    """Comma- or newline-separated vocabulary -> normalised tags."""
    return normalize_tags(F.split(F.replace(text, F.lit("\n"), F.lit(",")), ","))


def is_ignored_tag(tag: Column) -> Column:
    """Empty, longer than 40 characters, or a boilerplate tag."""
    k = tag_key(tag)
    return (k == "") | (F.length(k) > K.MAX_TAG_LEN) | k.isin(*K.IGNORE_TAGS)


def _junk_key(k: Column) -> Column:
    return k.isNull() | (k == "") | (F.length(k) > K.MAX_TAG_LEN) | k.isin(*K.IGNORE_TAGS)


def filter_tags(tags: Column) -> Column:
    """T4: drop junk tags and case-insensitive repeats, keeping the first
    spelling and the original order.

    O(n log n) per row: each key is computed once, ``(key, index)`` pairs are
    sorted, a pair is a first occurrence when its sorted predecessor has
    another key, and survivors go back to input order."""
    pairs = F.transform(tags, lambda t, i: F.struct(tag_key(t).alias("k"), i.alias("i"), t.alias("t")))

    def body(s: Column) -> Column:
        first = F.filter(s, lambda p, j: (j == 0) | (F.element_at(s, F.greatest(j, F.lit(1)))["k"] != p["k"]))
        kept = F.filter(first, lambda p: ~_junk_key(p["k"]))
        ordered = F.array_sort(F.transform(kept, lambda p: F.struct(p["i"].alias("i"), p["t"].alias("t"))))
        return F.transform(ordered, lambda p: p["t"])

    return _let(F.array_sort(pairs), body)


def finalize_tags(raw: Column, allowed: Column | None = None) -> Column:
    """Normalise; with an allow-list keep only allowed tags, otherwise
    drop boilerplate; cap at 8."""
    tags = normalize_tags(raw)
    if allowed is None:
        kept = filter_tags(tags)
    else:
        allowed_n = normalize_tags(allowed)
        kept = F.when(F.size(allowed_n) > 0,
                      F.filter(tags, lambda t: F.array_contains(allowed_n, t))).otherwise(filter_tags(tags))
    return F.slice(kept, 1, K.MAX_TAGS)


def tags_from_flags(vocabulary: Column, flags: Column) -> Column:
    """Closed-vocabulary output (one boolean per allowed tag, aligned with
    ``vocabulary``) -> the chosen tags in vocabulary order."""
    pairs = F.arrays_zip(vocabulary.alias("tag"), flags.alias("on"))
    return F.transform(F.filter(pairs, lambda p: F.coalesce(p["on"], F.lit(False))), lambda p: p["tag"])
