"""Toxicity by class-conditional Kneser-Ney models.

Words are spelled out between a start and an end mark, and each class has a
model of the next letter given up to ``ORDER - 1`` before it: absolute
discounting of the class's own counts, backing off to one lower-order model
that both classes share, made of continuation counts.  A history that a class
has not seen is left to the shared model, so rare expressions say nothing about
the class.  The difference of a word's two log-likelihoods is its evidence.

A document's evidence is normalised by its length as a whole, and taken for its
strongest words as well, as a few words decide about a long text.  A logistic
model on these few numbers, fitted on labelled rows that the counts don't use,
gives the score.

Scale: labelled rows are a bounded sample (``SAMPLE`` documents, those of the
least hashes, whole texts), so their ids are broadcast and the model's tables
have a bounded size; all documents are then scored in one pass without a
shuffle.

Defined cases: a null or empty text has no evidence and gets the score of none;
repeated documents are scored alike; a label that is null is none, and of a
document's differing labels the greatest counts; without rows of both classes
every score is the share of toxic rows (0 without any); an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, cut_lineage, doc_text, read_table, trimmed

ORDER, DISCOUNT = 7, 0.8
SAMPLE = 40_000
CALIBRATION = 4  # one in so many sampled rows is kept for the logistic model
STRONG = 3.0  # evidence of a word beyond this adds to the document's excess
CACHE_WORDS = 300_000
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def word_counts(rows: DataFrame) -> DataFrame:
    """``(word, c0, c1)``: tokens of each word in ordinary and toxic texts."""

    def run(batches):
        from collections import Counter

        import pyarrow as pa

        for batch in batches:
            n = [Counter(), Counter()]
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n[toxic].update(words_of(text))
            words = list(n[0].keys() | n[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([n[0][w] for w in words], pa.int64()), pa.array([n[1][w] for w in words], pa.int64())], ["word", "c0", "c1"])

    return rows.select("text", "toxic").mapInArrow(run, "word string, c0 long, c1 long").groupBy("word").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def spelled(counts: DataFrame, order: int) -> DataFrame:
    """``(g, c0, c1)``: every letter of every word with up to ``order - 1``
    letters before it."""
    w = counts.select("c0", "c1", F.concat(F.lit("^"), "word", F.lit("$")).alias("w"))
    ends = F.sequence(F.lit(2), F.length("w"))
    cut = F.transform(ends, lambda j: F.substr(F.col("w"), F.greatest(j - order + 1, F.lit(1)), F.least(j, F.lit(order))))
    return w.select(F.explode(cut).alias("g"), "c0", "c1").groupBy("g").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))


def history(c: str = "g"):
    return F.substr(F.col(c), F.lit(1), F.length(c) - 1)


def shared_model(grams: DataFrame, order: int, discount: float) -> DataFrame:
    """``(g, p)`` for the lower orders: Kneser-Ney on continuation counts.  A
    gram at the start of a word has nothing before it and keeps its count."""
    level = grams.where(F.length("g") == order).select("g")
    starts = grams.where(F.col("g").startswith("^")).select("g", (F.col("c0") + F.col("c1")).alias("n"))
    levels = {}
    for k in range(order - 1, 0, -1):
        follows = level.groupBy(F.substr(F.col("g"), F.lit(2)).alias("g")).agg(F.count("*").alias("n"))
        levels[k] = cut_lineage(follows.unionByName(starts.where(F.length("g") == k)).groupBy("g").agg(F.sum("n").alias("n")))
        level = levels[k].select("g")
    p, below = None, None
    for k in range(1, order):
        total = levels[k].groupBy(history().alias("h")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        own = levels[k].withColumn("h", history()).join(total, "h")
        if below is None:
            here = own.select("g", (F.col("n") / F.col("total")).alias("p"))
        else:
            lower = below.select(F.col("g").alias("s"), F.col("p").alias("q"))
            here = own.withColumn("s", F.substr(F.col("g"), F.lit(2))).join(lower, "s").select("g", ((F.col("n") - discount + discount * F.col("kinds") * F.col("q")) / F.col("total")).alias("p"))
        below = cut_lineage(here)
        p = below if p is None else p.unionByName(below)
    return p


def evidence_tables(counts: DataFrame, order: int = ORDER, discount: float = DISCOUNT) -> tuple[DataFrame, DataFrame]:
    """``(g, value)`` for every letter seen after its history in a class, and
    ``(h, value)`` for a letter not seen after a history: the toxic model's
    log-probability less the ordinary one's."""
    grams = cut_lineage(spelled(counts, order))
    shared = shared_model(grams, order, discount).select(F.col("g").alias("s"), F.col("p").alias("q"))
    seen = lambda c: F.sum((F.col(c) > 0).cast("long"))
    past = cut_lineage(grams.groupBy(history().alias("h")).agg(F.sum("c0").alias("n0"), F.sum("c1").alias("n1"), seen("c0").alias("t0"), seen("c1").alias("t1")))
    own = grams.withColumn("h", history()).withColumn("s", F.substr(F.col("g"), F.lit(2))).join(past, "h").join(shared, "s")

    def p(k: int):
        c, n, t = F.col(f"c{k}"), F.col(f"n{k}"), F.col(f"t{k}")
        return F.when(n > 0, (F.greatest(c - discount, F.lit(0.0)) + discount * t * F.col("q")) / n).otherwise(F.col("q"))

    def left(k: int):
        return F.when(F.col(f"n{k}") > 0, F.log(discount * F.col(f"t{k}") / F.col(f"n{k}"))).otherwise(0.0)

    return own.select("g", F.log(p(1) / p(0)).alias("value")), past.select("h", (left(1) - left(0)).alias("value"))


def keys_of(strings: list[str], order: int):
    """64-bit keys of strings of at most ``order`` letters."""
    import numpy as np

    out = np.zeros(len(strings), np.uint64)
    width = np.array([len(s) for s in strings])
    for n in range(1, order + 1):
        at = np.flatnonzero(width == n)
        if len(at):
            points = np.frombuffer("".join(strings[i] for i in at).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
            out[at] = key_of_columns([points[:, j] for j in range(n)])
    return out


def keyed(table: DataFrame, order: int) -> DataFrame:
    """``(key, value)`` of a table of strings."""
    import numpy as np

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(keys_of(batch.column(0).to_pylist(), order).view(np.int64)), batch.column(1)], ["key", "value"])

    return table.select(table.columns[0], F.col("value").cast("float")).mapInArrow(run, "key long, value float")


def key_of_columns(columns):
    import numpy as np

    h = np.full(len(columns[0]), 0x9E3779B97F4A7C15, np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


class Evidence:
    """Looks up words' evidence in the collected tables."""

    def __init__(self, grams, past, order: int):
        """Both tables as (sorted keys, values)."""
        self.grams, self.past, self.order, self.known = grams, past, order, {}

    @staticmethod
    def find(table, keys, other):
        import numpy as np

        at = np.searchsorted(table[0], keys)
        at[at == len(table[0])] = 0
        return np.where(table[0][at] == keys, table[1][at], other) if len(table[0]) else np.full(len(keys), other)

    def learn(self, words: list[str]) -> None:
        """Spells out words of one length at a time, as one array."""
        import numpy as np

        if len(self.known) > CACHE_WORDS:
            self.known = {}
        by_length: dict[int, list[str]] = {}
        for w in words:
            by_length.setdefault(len(w), []).append(w)
        for n, same in by_length.items():
            points = np.frombuffer("".join(f"^{w}$" for w in same).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n + 2)
            total = np.zeros(len(same))
            for j in range(1, n + 2):
                columns = [points[:, i] for i in range(max(0, j - self.order + 1), j + 1)]
                unseen = self.find(self.past, key_of_columns(columns[:-1]), 0.0)
                total += np.where(np.isnan(v := self.find(self.grams, key_of_columns(columns), np.nan)), unseen, v)
            self.known.update(zip(same, total.tolist(), strict=True))

    def of(self, texts: list[str]):
        """A row of evidence numbers for each text."""
        import numpy as np

        split = [words_of(t) for t in texts]
        new = {w for words in split for w in words if w not in self.known}
        if new:
            self.learn(list(new))
        out = np.zeros((len(texts), 6))
        for i, words in enumerate(split):
            if not words:
                continue
            found = list(map(self.known.get, words))
            if None in found:  # the cache was emptied meanwhile
                self.learn(list(set(words)))
                found = [self.known[w] for w in words]
            v = np.array(found)
            top = np.sort(v)[::-1][:3]
            excess = np.maximum(v - STRONG, 0).sum()
            out[i] = (v.mean(), v.sum() / math.sqrt(len(v)), top[0], top[:2].sum(), top.sum(), excess / math.sqrt(len(v)))
        return out


class Logistic:
    """Logistic regression on scaled columns, by Newton steps with a ridge."""

    def __init__(self, x, y, ridge: float = 1.0):
        import numpy as np

        self.mean, self.scale = x.mean(0), x.std(0) + 1e-9
        z = np.c_[np.ones(len(x)), np.clip((x - self.mean) / self.scale, -8, 8)]
        self.weights = np.zeros(z.shape[1])
        self.weights[0] = math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
        keep = ridge * np.eye(z.shape[1])
        keep[0, 0] = 1e-6
        for _ in range(40):
            p = 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
            step = np.linalg.solve(z.T * (p * (1 - p)) @ z + keep, z.T @ (y - p) - keep @ self.weights)
            self.weights = self.weights + step
            if abs(step).max() < 1e-6:
                break

    def __call__(self, x):
        import numpy as np

        z = np.c_[np.ones(len(x)), np.clip((x - self.mean) / self.scale, -8, 8)]
        return 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))


class Scorer:
    def __init__(self, evidence: Evidence | None, logistic: Logistic | None, share: float):
        self.evidence, self.logistic, self.share = evidence, logistic, share

    def __call__(self, texts: list[str]):
        import numpy as np

        return self.logistic(self.evidence.of(texts)) if self.logistic else np.full(len(texts), self.share)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, order: int = ORDER, discount: float = DISCOUNT, folds: int = 5) -> Scorer:
    """Learns from at most ``sample`` labelled documents whose crc32(doc_id)
    modulo ``folds`` is not 0."""
    import numpy as np

    rank = F.xxhash64("doc_id")
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (crc_mod(F.col("doc_id"), folds) != 0))
    rows = rows.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    rows = rows.orderBy(rank, "doc_id").limit(sample)
    texts = cut_lineage(doc_text(docs).join(F.broadcast(rows), "doc_id").withColumn("kept", F.pmod(rank, F.lit(CALIBRATION)) == 0))
    tally = {(r["kept"], r["toxic"]): r["count"] for r in texts.groupBy("kept", "toxic").count().collect()}
    total, toxic = sum(tally.values()), sum(n for (_, t), n in tally.items() if t)
    if len(tally) < 4:
        return Scorer(None, None, toxic / total if total else 0.0)
    tables = []
    for table in evidence_tables(word_counts(texts.where("not kept")), order, discount):
        found = keyed(table, order).toArrow()  # twelve bytes a row, rows bounded by the sample
        keys = found.column("key").to_numpy().view(np.uint64)
        at = np.argsort(keys)
        tables.append((keys[at], found.column("value").to_numpy()[at]))
        del found
    evidence = Evidence(*tables, order)

    def numbers(batches):
        import pyarrow as pa

        for batch in batches:
            x = evidence.of(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(1), *[pa.array(c) for c in x.T]], ["toxic", *[f"x{i}" for i in range(x.shape[1])]])

    held = texts.where("kept").select("text", "toxic").mapInArrow(numbers, "toxic int, " + ", ".join(f"x{i} double" for i in range(6))).toArrow().to_pandas()
    held = held.sort_values(list(held.columns))
    return Scorer(evidence, Logistic(held.iloc[:, 1:].to_numpy(), held["toxic"].to_numpy().astype(float)), toxic / total)


def score(docs: DataFrame, scorer: Scorer, name: str = "__toxicity") -> DataFrame:
    """``docs`` with a score from 0 to 1 as last column, under a ``name`` that
    ``docs`` does not have."""
    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())])
    at = docs.columns.index("text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = scorer([t or "" for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], [*batch.schema.names, name])
        if scorer.evidence:
            scorer.evidence.known = {}

    return docs.mapInArrow(trimmed(run), schema)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from the rows that are not held out."""
    docs = doc_text(read_table(spark, sf_dir, "documents"))
    found = score(docs, fit(docs, read_table(spark, sf_dir, "labels")))
    return found.select("doc_id", (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("__toxicity").alias("score"), (F.col("__toxicity") >= 0.5).cast("int").alias("predicted"))
