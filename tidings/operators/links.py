"""Link discovery: extraction from HTML, resolution, scope and filtering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.urls import (base_parts, canonicalize_url, hrefs, in_crawl_scope, is_ignored_url,
                              resolve_with_parts, same_site, strip_fragment, url_hostname, url_netloc,
                              url_scheme)


def page_hrefs(pages: DataFrame, base_col: str = "url", extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per non-empty href: ``page_id, base, pos, href, absolute``
    (+ extra).  The base URL is parsed once per page, and every href is
    resolved once, inside a ``transform`` before the explode -- the generator
    hands later filters a plain column instead of the resolution
    expression."""
    per_page = pages.select("page_id", F.col(base_col).alias("base"), *extra,
                            base_parts(F.col(base_col)).alias("_b"), hrefs(F.col("html")).alias("_hrefs"))
    resolved = F.transform("_hrefs", lambda h: F.struct(h.alias("href"),
                                                         resolve_with_parts(F.col("_b"), h).alias("absolute")))
    ex = per_page.select("page_id", "base", *extra, F.posexplode(resolved).alias("pos", "_r"))
    ex = ex.select("page_id", "base", *extra, F.col("pos").cast("bigint").alias("pos"), "_r.href", "_r.absolute")
    return ex.where(F.col("href") != "")


def resolve_links(df: DataFrame) -> DataFrame:
    """Adds ``absolute`` = ``urljoin(base, href)``, all JVM-side."""
    if "_b" not in df.columns:
        df = df.withColumn("_b", base_parts(F.col("base")))
    return df.withColumn("absolute", resolve_with_parts(F.col("_b"), F.col("href"))).drop("_b")


def extract_links(pages: DataFrame, base_col: str = "url", host_col: str = "hostname") -> DataFrame:
    """U8 + X4: distinct same-site http(s) links of each page, fragments
    dropped, the page itself excluded.  No canonicalisation or junk filter
    here (the reference applies neither at this step)."""
    ex = page_hrefs(pages.withColumn("_host", F.col(host_col)), base_col, ("_host",))
    res = ex.withColumn("link", strip_fragment(F.col("absolute"))).withColumn("_lhost", url_hostname(F.col("link")))
    host = F.col("_lhost")
    ok = (url_scheme(F.col("link")).isin("http", "https") & host.isNotNull()
          & same_site(host, F.col("_host"))
          & (F.regexp_replace("link", "/+$", "") != F.regexp_replace("base", "/+$", "")))
    kept = res.where(ok)
    return kept.groupBy("page_id", "link").agg(F.min("pos").alias("first_pos"))


def filter_links(links: DataFrame, base_host_col: str | None = None) -> DataFrame:
    """U7 + W2: canonicalise, keep the first occurrence per group, keep only
    links on ``base_host`` (exact netloc, when given) and drop junk."""
    canon = links.withColumn("canonical", canonicalize_url(F.col("link")))
    keys = ["page_id", "canonical"] + ([base_host_col] if base_host_col else [])
    first = canon.groupBy(*keys).agg(F.min("first_pos").alias("first_pos"))
    if base_host_col:
        first = first.where(url_netloc(F.col("canonical")) == F.col(base_host_col))
    return first.where(~is_ignored_url(F.col("canonical")))


def crawl_scope(links: DataFrame) -> DataFrame:
    """Whether each followed link of a page crawl stays in scope."""
    return links.withColumn("in_scope", in_crawl_scope(F.col("absolute"), F.col("base")))
