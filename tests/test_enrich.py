"""Enrichment with a pluggable model, result application and the graders."""

import pytest
from pyspark.sql import functions as F

from tidings import constants as K
from tidings.operators import enrich as EN

LONG = "\n".join(["Spark joins shuffle data across executors for every key."] * 6)


def _claimed(spark):
    return spark.createDataFrame(
        [(1, [LONG], "Joins", "https://x/1"), (2, ["Home"], "Home", "https://x/2"), (3, [], None, "https://x/3")],
        "id long, chunks array<string>, title string, url string")


def test_enrich_gate_and_model(spark):
    res = {r["id"]: r for r in EN.enrich_content(_claimed(spark)).collect()}
    assert res[1]["error"] is None and res[1]["summary"].startswith("Spark joins")
    assert res[1]["tags"] and all(t == t.lower() for t in res[1]["tags"])
    assert res[2]["error"].startswith("content too thin to analyse: 1 non-empty line(s), 4 char(s)")
    assert res[3]["error"] == "Empty chunks"


def test_failing_model_is_retried_and_recorded(spark):
    calls = {"n": 0}

    def flaky(prompt):
        raise RuntimeError("model down")

    res = EN.enrich_content(_claimed(spark), model=flaky).where(F.col("id") == 1).first()
    assert res["error"] == "model down" and res["tags"] is None


def test_apply_enrichment(spark):
    content = spark.createDataFrame([(1, 3, None, [], None), (2, 3, None, [], None), (9, 1, None, [], None)],
                                    "id long, pipeline_state int, summary string, tags array<string>, pipeline_error string")
    results = spark.createDataFrame([(1, "sum", ["a"], None), (2, None, None, "boom")],
                                    "id long, summary string, tags array<string>, error string")
    out = {r["id"]: r for r in EN.apply_enrichment(content, results).collect()}
    assert out[1]["pipeline_state"] == K.PIPE_COMPLETED and out[1]["summary"] == "sum" and out[1]["tags"] == ["a"]
    assert out[2]["pipeline_state"] == K.PIPE_FAILED and out[2]["pipeline_error"] == "boom"
    assert out[9]["pipeline_state"] == K.PIPE_PENDING


CASE_SCHEMA = ("id int, allowed_tags array<string>, summary string, tags array<string>, error string, "
               "expect_error string, expected_tags array<string>, forbidden_tags array<string>, "
               "keywords array<string>, min_summary_words int, expect_empty_tags boolean")


def test_graders(spark):
    cases = spark.createDataFrame([
        # thin page: error expected and produced -> all pass
        (1, [], "", [], "ThinContentError", "ThinContentError", [], [], [], 8, False),
        # good free-form output
        (2, [], "Spark plans joins with Catalyst and shuffles rows by key across executors",
         ["spark", "joins"], None, None, ["Spark"], ["cooking"], ["catalyst"], 8, False),
        # allow-list violated, badly formed tags, short summary, forbidden tag, no keyword
        (3, ["python"], "Too short", ["Python", "cooking"], None, None, ["rust"], ["cooking"], ["spark"], 8, False),
        # tags should be empty
        (4, [], "nothing in this page matches any topic at all really", ["x"], None, None, [], [], [], 8, True),
    ], CASE_SCHEMA)
    g = {r["id"]: r for r in EN.grade_enrichment(cases).collect()}
    assert all(g[1][x] for x in EN.GRADERS)
    assert all(g[2][x] for x in EN.GRADERS)
    assert [g[3][x] for x in EN.GRADERS] == [True, False, False, False, False, False, False, True]
    assert g[4]["tags_empty_when_nothing_applies"] is False
    rate = EN.enrichment_pass_rate(EN.grade_enrichment(cases)).first()
    assert rate["n_assertions"] == 32 and rate["n_passed"] == 8 + 8 + 2 + 7
    assert rate["pass_rate"] == pytest.approx(25 / 32)


def test_allow_list_with_flags(spark):
    vocab = ["Spark", "joins", "cooking"]

    def flag_model(prompt):
        return {"summary": "s", "flags": [True, True, False], "tags": ["ignored"]}

    res = EN.enrich_content(_claimed(spark), model=flag_model, allowed_tags=vocab).where(F.col("id") == 1).first()
    assert res["tags"] == ["spark", "joins"]

    def list_model(prompt):
        return {"summary": "s", "tags": ["Cooking", "rust", "spark"]}

    res = EN.enrich_content(_claimed(spark), model=list_model, allowed_tags=vocab).where(F.col("id") == 1).first()
    assert res["tags"] == ["cooking", "spark"]


def test_concurrent_calls_keep_order(spark):
    seq = EN.enrich_content(_claimed(spark)).orderBy("id").collect()
    par = EN.enrich_content(_claimed(spark), max_workers=4).orderBy("id").collect()
    assert [tuple(r) for r in seq] == [tuple(r) for r in par]


def _prompts(spark, n):
    rows = [(i, [f"{LONG}\nrow number {i:03d} of the batch"], f"T{i}", f"https://x/{i}") for i in range(n)]
    return spark.createDataFrame(rows + [(900, ["Home"], "Home", "https://x/900")], "id long, chunks array<string>, title string, url string").repartition(3)


def _model_maker(folder, broken=(), slow=()):
    """A batch model that notes its calls as files; rows in ``broken`` break
    their whole list (or answer with an error) until tried often enough."""
    def make():
        import os
        import re
        import time
        import uuid
        os.makedirs(f"{folder}/made", exist_ok=True)
        open(f"{folder}/made/{os.getpid()}-{uuid.uuid4().hex}", "w").close()

        def model(prompts):
            ids = [int(re.search(r"row number (\d+)", p).group(1)) for p in prompts]
            os.makedirs(f"{folder}/calls", exist_ok=True)
            with open(f"{folder}/calls/{uuid.uuid4().hex}", "w") as out:
                out.write(",".join(map(str, ids)))
            if set(ids) & set(slow):
                time.sleep(1.5)
            for kind, i in broken:
                if kind == "list" and i in ids and len(ids) > 1:
                    raise RuntimeError("list broken")
            return [RuntimeError(f"no answer for {i}") if ("row", i) in broken else {"summary": f"s{i}", "tags": ["spark", "joins"]} for i in ids]
        return model
    return make


def _calls(folder):
    import os
    return [[int(i) for i in open(f"{folder}/calls/{f}").read().split(",")] for f in os.listdir(f"{folder}/calls")]


def test_rounds_count_calls_and_tries(spark, tmp_path):
    pauses = []
    maker = _model_maker(str(tmp_path), broken=[("row", 7), ("list", 11)])
    out = {r["id"]: r for r in EN.enrich_in_rounds(_prompts(spark, 40), maker, name=str(tmp_path), batch_size=8, sleep=pauses.append).collect()}
    assert len(out) == 41 and out[900]["tries"] == 0 and out[900]["error"].startswith("content too thin")
    assert out[7]["error"] == "no answer for 7" and out[7]["tries"] == K.ENRICH_MAX_TRIES and out[7]["tags"] is None
    assert all(out[i]["error"] is None and out[i]["summary"] == f"s{i}" and out[i]["tags"] == ["spark", "joins"] for i in range(40) if i != 7)
    assert 2 <= out[11]["tries"] <= 4 and pauses == [2.0, 3.0, 4.0, 5.0]
    calls = _calls(str(tmp_path))
    tries = {i: sum(i in c for c in calls) for i in range(40)}
    assert tries == {i: out[i]["tries"] for i in range(40)}  # no row is called for more often than it is tried
    assert sum(out[i]["tries"] == 1 for i in range(40)) >= 40 - 2 * 8 and max(map(len, calls)) <= 8
    made = {f.split("-")[0] for f in __import__("os").listdir(tmp_path / "made")}
    assert len(made) == len(__import__("os").listdir(tmp_path / "made"))  # one model a worker


def test_a_slow_list_does_not_hold_back_the_others(spark):
    import time
    ends = {}

    def model(prompts):
        if "slow" in prompts:
            time.sleep(0.6)
        return [{"summary": p, "tags": []} for p in prompts]

    import pandas as pd
    run = EN._batch_runner(lambda: model, "slow-test", 2, 4)
    frame = pd.DataFrame({"id": range(8), "prompt": ["slow", "a", "b", "c", "d", "e", "f", "g"]})
    start = time.time()
    for out in run(iter([frame])):
        for i in out["id"]:
            ends[i] = time.time() - start
    assert max(ends[i] for i in range(2, 8)) < 0.5 <= min(ends[0], ends[1])


def test_rounds_give_what_single_calls_give(spark):
    def make():
        return lambda prompts: [EN.keyword_model(p) for p in prompts]

    one = sorted(map(tuple, EN.enrich_content(_prompts(spark, 20)).collect()))
    many = sorted(map(tuple, EN.enrich_in_rounds(_prompts(spark, 20), make, name="keywords").drop("tries").collect()))
    assert one == many
    assert EN.enrich_in_rounds(_prompts(spark, 0).where("id < 0"), make, name="keywords").count() == 0
