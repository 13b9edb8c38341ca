"""The corpus pipeline: documents in, packed token sequences out.

Five stages, each one of the operators of ``tidings.llm``; a stage's rows are
written as Parquet and read again as the next one's documents:

* ``toxicity``: documents scored 0.5 or more go;
* ``near_duplicates``: of each group of near copies (and of each set of equal
  texts, and of repeated rows) one document stays, the one of least id;
* ``decontamination``: documents that hold a window of a benchmark item go;
* ``pii``: spans of personal data are replaced by their kind;
* ``packing``: what is left is cut and packed into sequences.

All but the last return the columns of the documents they got.  Decisions of a
stage that looks at all documents are joined back on the id and the text's
hash, in columns whose names the documents don't have in any case of letters, so
other columns can have any names, and ids may repeat or be null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidings.llm import decontam, neardup, packing, pii, toxicity
from tidings.llm.common import cut_lineage, prepare, read_table

#: Stages share their Python workers with each other, and the executors' memory
#: with what the JVM has gathered over all of them, so a worker holds less here
#: than in an operator's own query: texts of a batch, and words in packing's cache.
BATCH_ROWS, CACHE_WORDS = 250, 100_000

ORACLE_SQL = None  # no stage's model can be written in SQL; tests hold each against its operator


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _spare(docs: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until ``docs`` has none of them (Spark compares
    names without case)."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def _own(docs: DataFrame) -> list[Column]:
    return [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = read_table(spark, sf_dir, "labels")
    prepare(spark, BATCH_ROWS)
    scorer = toxicity.fit(docs.select("doc_id", "text"), labels)
    name, = _spare(docs, "toxicity")
    return toxicity.score(docs, scorer, name).where(F.col(name) < 0.5).select(*_own(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark, BATCH_ROWS)
    found = neardup.near_duplicates(docs)
    key = _spare(docs, "id", "node")
    of = lambda rows: rows.select(F.coalesce("doc_id", F.lit(neardup.NO_ID)).alias(key[0]), F.col("node").alias(key[1]))
    gone = cut_lineage(of(found.where("NOT first")).distinct())
    twice = cut_lineage(of(found.where("first")).groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key))
    keyed = docs.withColumn(key[0], F.coalesce(F.col("doc_id").cast("long"), F.lit(neardup.NO_ID))).withColumn(key[1], F.md5(_text()))
    kept = keyed.join(gone, key, "left_anti")
    if twice.limit(1).count():  # rows repeated whole: one of them stays
        again = kept.join(twice, key, "left_semi").dropDuplicates(key)
        kept = kept.join(twice, key, "left_anti").unionByName(again)
    return kept.select(*_own(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = read_table(spark, sf_dir, "benchmark")
    prepare(spark, BATCH_ROWS)
    found = decontam.contamination(docs, benchmark)
    key = _spare(docs, "doc", "version")
    gone = cut_lineage(found.where("n_hit > 0").select(F.col("doc").alias(key[0]), F.col("version").alias(key[1])).distinct())
    doc, version = decontam.document_key()
    keyed = docs.withColumn(key[0], doc).withColumn(key[1], version)
    return keyed.join(gone, key, "left_anti").select(*_own(docs))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark, BATCH_ROWS)
    return pii.redact(docs, pii.fit(docs.select(F.col("doc_id"), _text().alias("text"))))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    prepare(spark, BATCH_ROWS)
    return packing.pack(docs, cache_words=CACHE_WORDS)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = read_table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut_lineage(docs)
    return docs
