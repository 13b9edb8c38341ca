"""Content stored for newest-first listings.

``ContentListing`` keeps three Parquet tables:

* ``rows``: the content, range-partitioned and sorted newest first, with Bloom
  filters on ``id`` and ``url`` for point lookups;
* ``postings``: ``(tag, created_at, id)``, one row per tag of a row, sorted by
  tag and newest first, with a null tag for the listing without one;
* ``days``: how many postings a tag has on each day.

A page is found from the inside out.  The day counts tell from which day on the
tag has enough rows beyond the cursor, the postings of these days give the ids
and times of the page, and the rows are read by them.  Every step filters on
the columns that its table is sorted by, so row groups that can't hold what is
looked for are skipped, however many rows a tag has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from .tables import CONTENT_COLUMNS, list_content, list_order

MOST = 10_000  # ids of a slice, eight bytes each


class ContentListing:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def write(self, content: DataFrame, row_group_bytes: int | None = None) -> None:
        """Store ``content`` (with ``id``, ``url``, ``tags``, ``created_at``); a
        row without a time of creation is in no listing."""
        content = content.where("created_at IS NOT NULL")

        def save(rows: DataFrame, name: str, order: list[Column], bloom: tuple[str, ...] = ()) -> None:
            out = rows.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("errorifexists")
            for c in bloom:
                out = out.option(f"parquet.bloom.filter.enabled#{c}", "true")
            if row_group_bytes:
                out = out.option("parquet.block.size", str(row_group_bytes))
            out.parquet(f"{self.path}/{name}")

        newest = list_order()
        save(content, "rows", newest, ("id", "url"))
        tags = F.array_append(F.array_distinct(F.coalesce("tags", F.array().cast("array<string>"))), F.lit(None).cast("string"))
        postings = content.select(F.explode(tags).alias("tag"), "created_at", "id")
        save(postings, "postings", [F.col("tag"), *newest])
        days = self._table("postings").groupBy("tag", F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
        save(days, "days", [F.col("tag"), F.desc("day")])

    def row(self, id) -> DataFrame:
        return self._table("rows").where(F.col("id") == F.lit(id))

    def _slice(self, tag: str | None, n: int, cursor, older: bool) -> DataFrame:
        """The ``n`` postings of the tag next to the cursor (all, if fewer)."""
        mine = F.col("tag").isNull() if tag is None else F.col("tag") == F.lit(tag)
        days, found = self._table("days").where(mine), self._table("postings").where(mine)
        if cursor is not None:
            at, cid = cursor
            day = F.to_date(at)
            beyond = (F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") < cid))
            if not older:
                beyond = (F.col("created_at") > at) | ((F.col("created_at") == at) & (F.col("id") > cid))
            days = days.where(F.col("day") <= day if older else F.col("day") >= day)
            found = found.where(F.col("created_at") <= at if older else F.col("created_at") >= at).where(beyond)
        else:
            day = None
        # whole days beyond the cursor's own, until they hold enough
        counted = days.where(F.col("day") != day) if day is not None else days
        total, last = 0, None
        for r in counted.select("day", "n").orderBy(F.desc("day") if older else F.asc("day")).toLocalIterator():  # a row a day
            total, last = total + r["n"], r["day"]
            if total >= n:
                break
        if total >= n:
            edge = F.lit(last).cast("timestamp_ntz")
            found = found.where(F.col("created_at") >= edge if older else F.col("created_at") < edge + F.make_dt_interval(days=F.lit(1)))
        return found.orderBy(*(list_order() if older else [F.asc("created_at"), F.asc("id")])).limit(n)

    def list_content(self, tag: str | None = None, id=None, url=None, hostname=None, pipeline_state=None,
                     limit: int = K.LIST_LIMIT, after_id=None, before_id=None) -> DataFrame:
        """P3 + P4 as ``tables.list_content``: the same page from the stored
        layout.  With filters besides the tag more postings are looked at until
        the page is full; if ``MOST`` don't fill it, the rows are.  An id or url
        is looked up in the rows (Bloom filters)."""
        rows = self._table("rows")
        plain = lambda: list_content(rows, tag, id, url, hostname, pipeline_state, limit, after_id, before_id)
        if id is not None or url is not None:
            return plain()
        kind = rows.schema["created_at"].dataType
        keep = [F.col(c) == F.lit(v) for c, v in (("hostname", hostname), ("pipeline_state", pipeline_state)) if v is not None]
        cursor, older = None, before_id is None
        if after_id is not None or before_id is not None:
            wanted = after_id if older else before_id
            at = self.row(wanted).select("created_at").head(1)
            if not at:
                raise ValueError(f"no row with the cursor's id: {wanted!r}")
            cursor = (F.lit(at[0]["created_at"]).cast(kind), F.lit(wanted))
        n = limit
        while True:
            some = self._slice(tag, n, cursor, older).select("created_at", "id").collect()
            page = rows.limit(0)
            if some:
                times = [r["created_at"] for r in some]
                page = rows.where(F.col("created_at").between(F.lit(min(times)).cast(kind), F.lit(max(times)).cast(kind)) & F.col("id").isin([r["id"] for r in some]))
                for k in keep:
                    page = page.where(k)
            if len(some) < n or not keep or page.limit(limit).count() == limit:
                break
            n *= 8
            if n > MOST:
                return plain()
        nearest = page.orderBy(*(list_order() if older else [F.asc("created_at"), F.asc("id")])).limit(limit)
        return nearest.orderBy(*list_order()).select(*CONTENT_COLUMNS, "created_at")
