"""SimHash fingerprints and near-duplicate detection.

Candidate generation is a band-exploded equi-join, not an OR join: each side
is exploded into four ``(band_no, band)`` rows, so equality of any band (which
includes exact fingerprint equality) becomes a plain hash key.  Verification
(``1 - hamming/64 > threshold``) is the residual condition of a ``left_semi``
join, so no candidate pair is ever materialised; Spark stops probing a row at
its first match.  Exact copies are collapsed before the join (distinct
fingerprints per band key), which removes the typical hot bucket; a bucket
that is still large (many near copies) is split into salted sub-buckets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import simhash as SH


def doc_simhash(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """B1: ``(id, simhash)`` for every document, 0 for a text without tokens.

    Tokens are exploded next to their document, so the partial aggregation
    folds each document to one row before the shuffle on ``id``.
    """
    toks = docs.select(F.col(id_col).alias("_id"), F.explode_outer(SH.tokens(F.col(text_col))).alias("tok"))
    hashed = toks.select("_id", F.when(F.col("tok").isNotNull(), SH.token_hash(F.col("tok"))).alias("h"))
    counts = hashed.groupBy("_id").agg(F.count("h").alias("_n"), *SH.bit_count_aggs(F.col("h")))
    return counts.select(F.col("_id").alias(id_col), SH.fingerprint_from_counts(F.col("_n")).alias("simhash"))


def with_simhash(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Attach ``simhash`` and its four bands to each document row."""
    fp = doc_simhash(docs, id_col, text_col)
    out = docs.join(fp, id_col)
    return with_bands(out)


def with_bands(df: DataFrame, h: str = "simhash") -> DataFrame:
    """B2: ``simhash_1..4`` (16-bit bands, low bits first)."""
    for k in range(K.SIMHASH_BANDS):
        df = df.withColumn(f"simhash_{k + 1}", SH.band(F.col(h), k))
    return df


def _band_keys(df: DataFrame, keep: list[str]) -> DataFrame:
    """One row per (row, band): ``band_no``, ``band`` plus ``keep`` columns."""
    exploded = df.select(*keep, F.posexplode(SH.bands(F.col("simhash"))).alias("band_no", "band"))
    return exploded


HOT_BUCKET_ROWS = 100_000


def near_dup_urls(incoming: DataFrame, existing: DataFrame,
                  threshold: float = K.SIMILARITY_THRESHOLD,
                  hot_bucket_rows: int = HOT_BUCKET_ROWS) -> DataFrame:
    """J3 + J4: incoming rows (``id``, ``url``, ``simhash``) that equal or are
    similar (> threshold) to an existing fingerprint sharing a band.

    A band bucket with more than ``hot_bucket_rows`` distinct stored
    fingerprints is split into salted sub-buckets (``pmod(xxhash64(h), s)``)
    and the incoming rows of that bucket are replicated across the salts,
    so no single task probes a hot bucket in full.  The answer is the same:
    a row matches if any sub-bucket holds a match.  The stored side is read
    and reduced to its distinct band keys once, as a written table that both
    the bucket sizes and the join read."""
    from ..session import cut_lineage
    ex = cut_lineage(_band_keys(existing.select("simhash").distinct(), ["simhash"]).withColumnRenamed("simhash", "ex_hash"))
    sizes = ex.groupBy("band_no", "band").agg(F.count(F.lit(1)).alias("_n"))
    hot = sizes.where(F.col("_n") > hot_bucket_rows).select(
        "band_no", "band", F.ceil(F.col("_n") / F.lit(hot_bucket_rows)).cast("int").alias("_salts"))
    ex = ex.join(hot, ["band_no", "band"], "left").select(
        "band_no", "band", "ex_hash",
        F.when(F.col("_salts").isNull(), F.lit(0))
         .otherwise(F.pmod(F.xxhash64("ex_hash"), F.col("_salts"))).cast("int").alias("salt"))
    inc = _band_keys(incoming.select("id", "url", "simhash"), ["id", "url", "simhash"])
    inc = inc.join(hot, ["band_no", "band"], "left").withColumn(
        "salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))).drop("_salts")
    cond = ((inc["band_no"] == ex["band_no"]) & (inc["band"] == ex["band"]) & (inc["salt"] == ex["salt"])
            & (SH.similarity(inc["simhash"], ex["ex_hash"]) > F.lit(float(threshold))))
    hit = inc.join(ex, cond, "left_semi")
    return hit.select("id", "url").distinct()


def dedup_content(incoming: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Incoming rows minus the flagged duplicate urls."""
    return incoming.join(duplicates.select("url").distinct(), "url", "left_anti")


def near_dup_candidates(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """J3 (re-aimed, no pair output): for each incoming row, how many existing
    rows share each band (summed over the four bands) and how many have the
    identical fingerprint.  Existing rows are pre-aggregated to one count per
    key, so the join emits at most four rows per incoming row."""
    ex_band = (_band_keys(existing.select("simhash"), ["simhash"])
               .groupBy("band_no", "band").agg(F.count(F.lit(1)).alias("n_band")))
    ex_exact = existing.groupBy("simhash").agg(F.count(F.lit(1)).alias("n_exact"))
    inc = _band_keys(incoming.select("id", "url", "simhash"), ["id", "url", "simhash"])
    band_hits = (inc.join(ex_band, ["band_no", "band"], "left")
                 .groupBy("id", "url", "simhash")
                 .agg(F.sum(F.coalesce("n_band", F.lit(0))).cast("bigint").alias("band_hits")))
    out = band_hits.join(ex_exact, "simhash", "left")
    return out.select("id", "url", "band_hits", F.coalesce("n_exact", F.lit(0)).cast("bigint").alias("exact_hits"))


def simhash_groups(existing: DataFrame) -> DataFrame:
    """A6 (re-aimed): fingerprint -> number of urls and the first url.  A
    bounded summary instead of an unbounded url list per group."""
    return existing.groupBy("simhash").agg(F.count("url").alias("n_urls"), F.min("url").alias("first_url"))
