import random
from collections import defaultdict

import pytest

import corpus_pipeline
from tidings.llm import decontam, neardup, pii, toxicity


@pytest.fixture(scope="module")
def tables(spark, make_docs, words, odd_rows, tmp_path_factory):
    r = random.Random(21)
    docs, labels = list(odd_rows), []
    for i in range(400):
        w = words(r.randint(30, 150), 5000 + i).split()
        toxic = i % 5 == 0
        if toxic:
            for _ in range(5):
                w.insert(r.randrange(len(w)), r.choice(["vilest", "vilescum", "scumbag", "vileon"]))
        labels.append((100 + i, int(toxic)))
        docs.append((100 + i, " ".join(w)))
    base = words(200, 77)
    docs += [(1000 + i, base.replace(" ", f" x{i} ", 1) if i else base) for i in range(6)] + [(1010, base), (1011, base), (1011, base)]
    item = words(30, 88)
    docs += [(1100 + i, words(50, 600 + i) + " " + item + " " + words(20, 700 + i)) for i in range(5)]
    docs += [(1200 + i, words(60, 800 + i) + f" write me{i}@mail.example.com or 10.0.{i}.1 " + words(20, 900 + i)) for i in range(30)]
    d = tmp_path_factory.mktemp("sf")
    make_docs(docs, 4).write.parquet(str(d / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(d / "labels.parquet"))
    spark.createDataFrame([(1, item), (2, words(20, 89)), (3, None)], "item_id long, text string").write.parquet(str(d / "benchmark.parquet"))
    return str(d)


def stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = str(tmp_path / name)
        stage(spark, docs, sf).write.parquet(out)
        yield name, docs, spark.read.parquet(out)
        docs = spark.read.parquet(out)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_each_stage_against_its_operator(spark, tables, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "packing"]
    for name, before, after in stages(spark, tables, tmp_path):
        old, new = before.collect(), after.collect()
        if name != "packing":
            assert after.columns == before.columns
        if name == "toxicity":
            scorer = toxicity.fit(before, spark.read.parquet(f"{tables}/labels.parquet"))
            keep = [x for x, s in zip(old, scorer([x.text or "" for x in old])) if s < 0.5]
            assert sorted(map(repr, map(tuple, keep))) == sorted(map(repr, map(tuple, new)))
            gone = {x.doc_id for x in old} - {x.doc_id for x in new}
            assert len(gone) > 60 and all(100 <= i < 500 and (i - 100) % 5 == 0 for i in gone)
        elif name == "near_duplicates":
            groups = neardup.near_duplicates(before).collect()
            assert sorted(repr(r.doc_id) for r in new) == sorted({repr(r.group_id) for r in groups})
            ids = [r.doc_id for r in new]
            assert len(ids) == len(set(ids)) and 1000 in ids and not set(ids) & {1001, 1002, 1010, 1011}
        elif name == "decontamination":
            hit = {r.doc_id for r in decontam.contamination(before, spark.read.parquet(f"{tables}/benchmark.parquet")).where("n_hit > 0").collect()}
            assert hit == set(range(1100, 1105))
            assert rows(after) == rows(before.where(f"doc_id IS NULL OR doc_id NOT IN ({', '.join(map(str, hit))})"))
        elif name == "pii":
            assert {r.doc_id for r in old} == {r.doc_id for r in new}
            texts = {r.doc_id: r.text for r in new}
            assert "write [EMAIL] or [IP]" in texts[1203] and not any(pii.base_spans(t or "") for t in texts.values())
            same = {r.doc_id: r.text for r in old}
            assert all(t == same[i] for i, t in texts.items() if not pii.base_spans(same[i] or ""))
        else:
            pieces = defaultdict(int)
            for r in new:
                pieces[r.doc_id] += r.length
            assert {r.doc_id: r.doc_tokens for r in new} == pieces and set(pieces) == {r.doc_id for r in old}


@pytest.mark.parametrize("names", [("__toxicity", "__id", "__node", "__doc", "__version"), ("TOXICITY", "ID", "Node", "DOC_", "Version")])
def test_columns_named_like_helpers(spark, tables, tmp_path, names):
    """Every stage on documents whose other columns have its helpers' names, in
    any case of letters: they come back as they were."""
    from pyspark.sql import functions as F
    docs = spark.read.parquet(f"{tables}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars", *[F.concat(F.lit(f"{n} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, tables)
        after.write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        assert after.columns == docs.columns
        for row in after.collect():
            assert all(row[n] == f"{n} of {'none' if row['doc_id'] is None else row['doc_id']}" for n in names), (name, row)
        assert after.count() < docs.count() or name == "pii"


def test_run_gives_the_last_stage(spark, tables, tmp_path):
    last = list(stages(spark, tables, tmp_path))[-1][2]
    got = corpus_pipeline.run(spark, tables)
    key = ["doc_id", "start", "length", "ids_crc32"]
    assert got.columns == last.columns
    assert {r.doc_id for r in got.collect()} == {r.doc_id for r in last.collect()}
    assert got.selectExpr("sum(length)").first() == last.selectExpr("sum(length)").first() and key


def test_empty(spark, tables, tmp_path):
    import os
    d = str(tmp_path / "sf")
    os.mkdir(d)
    spark.read.parquet(f"{tables}/documents.parquet").limit(0).write.parquet(f"{d}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{tables}/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
    assert corpus_pipeline.run(spark, d).count() == 0


def test_workers_of_one_kind_and_small_batches(spark, tables, tmp_path, monkeypatch):
    """No stage makes rows in Python, whose workers are of another kind than
    those of batches and wait beside them, and batches are small."""
    def refuse(*a, **k):
        raise AssertionError("rows made in Python")

    docs = spark.read.parquet(f"{tables}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        with monkeypatch.context() as m:
            m.setattr(type(spark), "createDataFrame", refuse)
            stage(spark, docs, tables).write.parquet(str(tmp_path / name))
        assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 250, name


def test_pii_gives_memory_back(spark, tables, monkeypatch):
    """The PII functions are wrapped so that a worker's free memory goes back."""
    wrapped = []
    monkeypatch.setattr(pii, "trimmed", lambda run: wrapped.append(run.__name__) or run, raising=False)
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    field = pii.fit(docs.selectExpr("doc_id", "coalesce(text, '') AS text"))
    pii.redact(docs, field)
    pii.scan(docs, field)
    assert sorted(wrapped) == ["cut", "run", "run"]
