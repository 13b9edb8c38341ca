import pytest

from pyspark.sql import types as T


@pytest.fixture(scope="session")
def make_docs(spark):
    """A documents table from (doc_id, text) rows, with extra columns whose
    names clash with the operators' own."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                           T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType()),
                           T.StructField("part", T.IntegerType()), T.StructField("shard", T.StringType()), T.StructField("k", T.StringType())])

    def make(rows, partitions=3):
        full = [(i, t, "en", f"src{(i or 0) % 3}", None if t is None else len(t), "x", 7, "y", None) for i, t in rows]
        return spark.createDataFrame(full, schema).repartition(partitions)
    return make


@pytest.fixture(scope="session")
def words():
    """Seeded pseudo-prose: words(n, seed) has n words."""
    import random

    def prose(n, seed):
        r = random.Random(seed)
        parts = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en"]
        return " ".join("".join(r.choice(parts) for _ in range(r.randint(1, 4))) + r.choice(["", "", "", ".", ","]) for _ in range(n))
    return prose


@pytest.fixture(scope="session")
def odd_rows(words):
    """Nulls, empty and blank texts, a repeated row, equal texts, one long text."""
    base = [(i, words(30 + 17 * i, i)) for i in range(1, 14)]
    return base + [(20, None), (21, ""), (22, " \n\t "), (23, words(64, 3)), (24, base[2][1]), (24, base[2][1]), (None, words(40, 99)),
                   (25, words(9000, 5)), (26, "é́ß ＡＢ 漢字 \U0001f600 It's don't"), (27, base[2][1].upper())]
