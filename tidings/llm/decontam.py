"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores a posting (document, position, term) for every token of
a document that is a term of the benchmark, and one of a closing mark, whose
position is the document's length.  A phrase is found by intersecting
its terms' lists, each shifted by the term's place in the phrase, from the term
that is rarest in the documents: its postings give the candidate starts, and a
start stays if every other term has a posting at its place.  ``phrase_matches``
gives exact matches, ``proximity_matches`` those with enough of the terms, in
any order, near the expected place.

Scale: the texts are read once.  Tokens are filtered to benchmark terms as they
are read, so the index holds narrow rows of a part of them.  Terms and phrases
are broadcast where their counted size is under ``BROADCAST_ROWS``, and joined
by shuffle beyond it.  A phrase's two rarest terms meet their lists alone; the
common terms' postings are looked at only in the documents that are left (by a
broadcast of those under ``BROADCAST_DOCUMENTS``, else by shuffle), and meet the
candidates by (document, position), a key of one row.

Defined cases: a null or empty text or item has no words; repeated documents
(equal id and text) each get their row; documents of one id and different
texts are told apart; a benchmark without words marks nothing; empty tables
give no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, read_table

WINDOW = 10
BROADCAST_ROWS, BROADCAST_DOCUMENTS = 100_000, 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: ASCII outside letters and digits stands between words.
BETWEEN = "".join(chr(c) for c in range(128) if not chr(c).isalnum())
NO_ID = -1 << 63
CLOSING = "$"  # no word


def tokens(text: Column) -> Column:
    """Lower-cased (A-Z) words of a text."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER + BETWEEN, LOWER + " " * len(BETWEEN)), " "), "")


def document_key() -> list[Column]:
    """What tells documents apart: the id and a hash of the text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("version")]


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def phrases(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """Distinct windows of the items, ``(phrase, terms, item_ids)``: ``window``
    consecutive words, or the whole item where it has fewer."""
    words = benchmark.select("item_id", tokens(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    cut = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, F.lit(window)))).alias("terms"))
    return cut.groupBy("terms").agg(F.collect_set("item_id").alias("item_ids")).select(F.xxhash64("terms").alias("phrase"), "terms", "item_ids")


def build_index(docs: DataFrame, words: DataFrame) -> DataFrame:
    """Postings ``(doc, version, position, term)`` of the documents' tokens
    among ``words`` and of the closing marks, written as a table.  A term is
    its word's hash."""
    closing = docs.sparkSession.range(1).select(F.lit(CLOSING).alias("word"))  # rows of Python would start workers of another kind, which wait on
    terms = words.select("word").unionByName(closing).withColumn("term", F.xxhash64("word"))
    each = docs.select(*document_key(), F.posexplode(F.array_append(tokens(F.col("text")), F.lit(CLOSING))).alias("position", "word"))
    return cut_lineage(each.join(small(terms), "word").select("doc", "version", "position", "term"))


def closing_term() -> Column:
    return F.xxhash64(F.lit(CLOSING))


def ranked_terms(found: DataFrame, index: DataFrame) -> DataFrame:
    """``(phrase, n, rank, place, term, whole)``: each phrase's terms by their
    number of postings, the rarest first, those that no document has before all
    others; ``whole`` tells whether the documents have all of them."""
    counts = index.groupBy("term").agg(F.count("*").alias("postings"))
    placed = found.select("phrase", F.size("terms").alias("n"), F.posexplode("terms").alias("place", "word")).withColumn("term", F.xxhash64("word"))
    placed = placed.join(counts, "term", "left").withColumn("postings", F.coalesce("postings", F.lit(0).cast("long")))
    known = placed.groupBy("phrase", "n").agg(F.array_sort(F.collect_list(F.struct("postings", "place", "term"))).alias("terms"))
    return known.select("phrase", "n", (F.col("terms")[0]["postings"] > 0).alias("whole"), F.posexplode("terms").alias("rank", "t")).select("phrase", "n", "rank", "t.place", "t.term", "whole")


def phrase_matches(index: DataFrame, ranked: DataFrame) -> DataFrame:
    """Exact matches ``(doc, version, phrase, start, n)``."""
    key = ["doc", "version", "position", "term"]
    ranked = ranked.where("whole")
    rarest, second = (ranked.where(F.col("rank") == r).select("phrase", "n", "place", "term") for r in (0, 1))
    starts = index.join(small(rarest), "term").select("doc", "version", "phrase", "n", (F.col("position") - F.col("place")).alias("start")).where("start >= 0").distinct()
    starts = cut_lineage(starts)
    wanted = starts.join(small(second.drop("n")), "phrase").withColumn("position", F.col("start") + F.col("place"))
    pairs = cut_lineage(wanted.join(index.join(small(second.select("term").distinct()), "term", "left_semi").select(key), key, "left_semi").select("doc", "version", "phrase", "n", "start"))
    where = pairs.select("doc", "version").distinct()
    few = where.limit(BROADCAST_DOCUMENTS + 1).count() <= BROADCAST_DOCUMENTS
    lists = index.join(F.broadcast(where), ["doc", "version"], "left_semi") if few else index
    rest = small(ranked.where("rank > 1").groupBy("phrase").agg(F.collect_list(F.struct("place", "term")).alias("rest")))
    places = pairs.where("n > 2").join(rest, "phrase").select("doc", "version", "phrase", "n", "start", F.explode("rest").alias("r"))
    places = places.select("doc", "version", "phrase", "n", "start", "r.place", "r.term", (F.col("start") + F.col("r.place")).alias("position"))
    met = places.join(lists.select(key), key)
    full = met.groupBy("doc", "version", "phrase", "start", "n").agg(F.countDistinct("place").alias("places")).where(F.col("places") == F.col("n") - 2).drop("places")
    short = starts.where("n = 1").unionByName(pairs.where("n = 2"))
    return full.unionByName(short.select(full.columns))


def proximity_matches(index: DataFrame, ranked: DataFrame, slack: int = 5, share: float = 0.8) -> DataFrame:
    """``(doc, version, phrase, start, n, near)``: starts from which at least
    ``share`` of the phrase's distinct terms lie, in any order, at most ``slack``
    tokens outside the phrase's extent.  A match may lack some terms, so starts
    come from one term more than it may lack, the rarest ones: it has at least
    one of them.  A term that no document has counts as one it lacks."""
    terms = ranked.groupBy("phrase", "term").agg(F.min("rank").alias("rank"))
    needed = terms.groupBy("phrase").agg(F.count("*").cast("int").alias("terms"), F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("ordered"))
    needed = needed.withColumn("least", F.greatest(F.ceil(F.col("terms") * F.lit(float(share)) - 1e-9).cast("int"), F.lit(1)))
    seeds = needed.select("phrase", F.explode(F.slice("ordered", F.lit(1), F.col("terms") - F.col("least") + 1)).alias("t")).select("phrase", "t.term")
    rarest = small(ranked.join(seeds, ["phrase", "term"], "left_semi").select("phrase", "n", "place", "term"))
    terms, needed = terms.drop("rank"), needed.drop("ordered", "terms")
    starts = index.join(rarest, "term").select("doc", "version", "phrase", "n", (F.col("position") - F.col("place")).alias("start")).distinct()
    wanted = starts.join(small(terms), "phrase")
    places = index.select("doc", "version", "term", F.col("position").alias("at"))
    met = wanted.join(places, ["doc", "version", "term"]).where((F.col("at") >= F.col("start") - slack) & (F.col("at") < F.col("start") + F.col("n") + slack))
    near = met.groupBy("doc", "version", "phrase", "start", "n").agg(F.countDistinct("term").alias("near"))
    return near.join(small(needed), "phrase").where("near >= least").drop("least")


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: its key, words, words hit, and the items whose
    windows occur in it."""
    found = cut_lineage(phrases(benchmark, window))
    index = build_index(docs, found.select(F.explode("terms").alias("word")).distinct())
    matches = cut_lineage(phrase_matches(index, cut_lineage(ranked_terms(found, index))))
    places = matches.select("doc", "version", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("position")).distinct()
    hit = places.groupBy("doc", "version").agg(F.count("*").alias("n_hit"))
    owners = found.select("phrase", F.explode("item_ids").alias("item_id"))
    items = matches.select("doc", "version", "phrase").distinct().join(owners, "phrase").select("doc", "version", "item_id").distinct()
    items = items.groupBy("doc", "version").agg(F.count("*").alias("n_items"), F.array_sort(F.collect_list(F.col("item_id").cast("string"))).alias("item_ids"))
    rows = index.where(F.col("term") == closing_term()).select("doc", "version", F.col("position").cast("long").alias("n_words"))
    return rows.join(hit.join(items, ["doc", "version"]), ["doc", "version"], "left").select(
        F.when(F.col("doc") != NO_ID, F.col("doc")).alias("doc_id"), "doc", "version", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("item_ids", F.array().cast("array<string>")).alias("item_ids"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that lie in windows of benchmark items."""
    found = contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


SQL = r"""
WITH b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, phrase)),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM m) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
