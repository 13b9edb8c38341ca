"""Structured Streaming jobs that keep the interaction log, the tag profile and
the content table current.

* ``stream_interactions`` (G1): reader requests (``REQUEST``) -> weighted
  interaction rows, a stateless ``explode`` into an exactly-once Parquet file
  sink.
* ``stream_tag_profile`` (G2): a stateful streaming aggregation per tag
  (state = one row per tag, kept by the state store and checkpointed); each
  trigger writes a normalised profile version.  Ages are whole days at one
  ``as_of`` per run, so the running sums are exact within a run.
* ``stream_tag_weights`` and ``profile_at`` (G2 with a moving clock): sums per
  tag and hour, kept current from new requests alone, give the profile at any
  whole hour from one checkpoint.
* ``stream_content_ingest`` (G3): new pages -> content rows with the
  near-duplicate check against an index of stored content, to which each
  batch appends what it has kept.  Batches run one after another, which gives
  the single-writer behaviour; each batch writes to a path keyed by ``batch_id``
  with overwrite and looks only at rows of earlier batches, so a replayed batch
  gives the same rows once.

``Trigger.AvailableNow`` matches the reference's drain-then-stop workers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.common import clock, ts_lit, whole_days
from ..functions.feed import decay
from ..operators.bandindex import ContentIndex
from ..operators.dedup import doc_simhash
from ..operators.profile import interaction_rows, normalize_profile, split_interaction_requests
from ..plans.crawl import content_ingest, stored_fingerprints
from ..schemas import PAGE, REQUEST
from ..session import cut_lineage, is_folder, path_exists, scratch_tables



def file_stream(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """File stream over a folder of Parquet files.  A path that names one file
    streams the matching files of its folder (``pathGlobFilter``), so new files
    dropped next to it are picked up by later triggers; a table in a folder of
    such a name (as Spark writes it) is streamed file by file.  ``max_files``
    bounds a micro-batch; by default a trigger takes all that is there."""
    import os
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if path.endswith(".parquet") and not is_folder(spark, path):
        folder, name = os.path.split(path.rstrip("/"))
        return reader.option("pathGlobFilter", name).parquet(folder)
    return reader.parquet(path)


def request_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Reader requests as they arrive (``REQUEST``)."""
    return file_stream(spark, path, REQUEST, max_files)


def request_rows(requests: DataFrame) -> DataFrame:
    """Requests -> weighted interaction rows, one per distinct tag; requests
    without tags are left out (``profile.split_interaction_requests``)."""
    accepted, _ = split_interaction_requests(requests)
    return interaction_rows(accepted)


def stream_interactions(requests: DataFrame, out_path: str, checkpoint: str):
    """G1: append interaction rows to a Parquet sink (exactly once)."""
    return (request_rows(requests).writeStream.format("parquet").option("path", out_path)
            .option("checkpointLocation", checkpoint).outputMode("append")
            .trigger(availableNow=True).start())


def _run_folder(out_path: str, as_of) -> str:
    stamp = str(as_of) if isinstance(as_of, str) else as_of.isoformat(sep=" ")
    return f"{out_path}/as_of=" + "".join(c for c in stamp if c.isalnum())


def stream_tag_profile(requests: DataFrame, out_path: str, checkpoint: str, as_of=None, state_partitions: int | None = None):
    """Running per-tag decayed sums at one clock; each trigger writes the
    normalised profile to ``<out_path>/as_of=<clock>/v=<batch_id>``.  A fresh
    checkpoint starts at batch 0, which clears what an earlier run with the
    same clock left, so the highest version is always the last one written.

    ``state_partitions`` sizes the state store (one row per tag) when the
    checkpoint is new; Spark keeps that number for the life of the
    checkpoint.  The session setting is restored once the query started."""
    spark = requests.sparkSession
    as_of = clock(as_of)
    folder = _run_folder(out_path, as_of)
    age = whole_days(ts_lit(as_of), F.col("created_at"))
    raw = request_rows(requests).groupBy("tag").agg(
        F.sum(decay(F.col("weight"), age, K.RECENT_HALF_LIFE_DAYS)).alias("recent_weight"),
        F.sum(decay(F.col("weight"), age, K.LONG_HALF_LIFE_DAYS)).alias("long_weight"),
        F.max(F.col("type") == "hide").alias("hidden"))

    def write_version(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        writer = normalize_profile(batch).withColumn("v", F.lit(batch_id)).write.mode("overwrite").partitionBy("v")
        mode = "static" if batch_id == 0 else "dynamic"
        writer.option("partitionOverwriteMode", mode).parquet(folder)
        batch.unpersist()

    writer = (raw.writeStream.outputMode("complete").foreachBatch(write_version)
              .option("checkpointLocation", checkpoint).trigger(availableNow=True))
    if not state_partitions:
        return writer.start()
    key = "spark.sql.shuffle.partitions"
    previous = spark.conf.get(key)
    spark.conf.set(key, str(state_partitions))
    try:
        return writer.start()
    finally:
        spark.conf.set(key, previous)


def latest_version(spark: SparkSession, out_path: str, as_of) -> DataFrame:
    """The last profile written by the run with this clock."""
    df = spark.read.parquet(_run_folder(out_path, as_of))
    newest = df.select(F.max("v")).scalar()
    return df.where(F.col("v") == newest).drop("v")


UNIT_SECONDS = 3600


def stream_tag_weights(requests: DataFrame, table: str, checkpoint: str):
    """G2 for a moving clock: each batch adds up the weights of its requests
    per tag and hour of creation, and writes these sums under its number (with
    overwrite, so a replayed batch counts once).  ``profile_at`` gives the
    profile of any whole hour from them, without the log."""
    micros = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("created_at"))
    unit = F.ceil(micros / F.lit(UNIT_SECONDS * 1_000_000)).cast("bigint")  # the first whole hour at or after it

    def write_sums(batch: DataFrame, batch_id: int) -> None:
        sums = request_rows(batch).groupBy("tag", unit.alias("unit")).agg(
            F.sum("weight").alias("weight"), F.max(F.col("type") == "hide").alias("hidden"))
        (sums.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("batch_id").parquet(table))

    return (requests.writeStream.foreachBatch(write_sums).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def profile_at(spark: SparkSession, table: str, as_of) -> DataFrame:
    """The normalised profile at a whole hour.  All events of one hour of
    creation have the same whole days of age at such a clock, so the hourly
    sums decay as the events would.  Rows: tags times hours of activity."""
    import datetime as dt
    at = as_of if isinstance(as_of, dt.datetime) else dt.datetime.fromisoformat(str(as_of))
    at = at.astimezone(dt.timezone.utc).replace(tzinfo=None) if at.tzinfo else at
    seconds, rest = divmod((at - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1), 1_000_000)
    if rest or seconds % UNIT_SECONDS:
        raise ValueError(f"the clock has to be a whole hour: {as_of}")
    age = F.floor((F.lit(seconds // UNIT_SECONDS) - F.col("unit")) * UNIT_SECONDS / F.lit(86_400)).cast("bigint")
    raw = spark.read.schema("tag string, unit long, weight double, hidden boolean").parquet(table).groupBy("tag").agg(
        F.sum(decay(F.col("weight"), age, K.RECENT_HALF_LIFE_DAYS)).alias("recent_weight"),
        F.sum(decay(F.col("weight"), age, K.LONG_HALF_LIFE_DAYS)).alias("long_weight"),
        F.max("hidden").alias("hidden"))
    return normalize_profile(cut_lineage(raw))


def compact_tag_weights(spark: SparkSession, table: str, to: str) -> str:
    """The sums of all batches so far as those of one, at another path."""
    sums = spark.read.parquet(table).groupBy("tag", "unit").agg(F.sum("weight").alias("weight"), F.max("hidden").alias("hidden"), F.max("batch_id").alias("batch_id"))
    last = sums.select(F.max("batch_id")).first()[0]
    sums.withColumn("batch_id", F.lit(last)).write.partitionBy("batch_id").parquet(to)
    return to


def stream_content_ingest(spark: SparkSession, pages_path: str, index_path: str,
                          out_path: str, checkpoint: str, as_of=None, max_files: int | None = None):
    """Drain new pages into PENDING content rows.  ``index_path`` holds the
    index of stored content (``write_existing_fingerprints``); a batch reads
    the buckets that its pages touch and appends the rows it has kept, which
    count as stored for later ones.  A storage error fails the batch."""
    pages = file_stream(spark, pages_path, PAGE, max_files)

    def ingest(batch: DataFrame, batch_id: int) -> None:
        sess = batch.sparkSession
        with scratch_tables():
            index = ContentIndex(sess, index_path)
            if path_exists(sess, out_path):
                sess.read.parquet(out_path)  # an output that can't be read stops the batch here
            rows = content_ingest(batch, index, as_of, before=batch_id).withColumn("batch_id", F.lit(batch_id))
            (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
             .partitionBy("batch_id").parquet(out_path))
            own = f"{out_path.rstrip('/')}/batch_id={batch_id}"
            if path_exists(sess, own):
                index.add(stored_fingerprints(sess.read.parquet(own)), batch_id)

    return (pages.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def write_existing_fingerprints(content: DataFrame, path: str) -> str:
    """Index stored content once, as of before the first batch."""
    fp = doc_simhash(content.select("id", "text"))
    rows = cut_lineage(content.select("id", "url").join(fp, "id").select("url", "simhash"))
    ContentIndex(content.sparkSession, path).add(rows, -1)
    return path
