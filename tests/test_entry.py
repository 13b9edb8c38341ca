"""Driver contract and a DuckDB side-by-side check on the smallest tables."""

import pytest

import __spark_entry__ as entry_mod
from check_oracle import compare, duck_connection
from tidings.plans.catalog import QUERIES, ROWS_ONLY


def test_entry_runs(spark):
    df = entry_mod.entry(spark)
    assert set(df.columns) >= {"id", "score"}
    assert df.count() >= 0


def test_every_query_has_sql_or_is_rows_only():
    q, o = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(o) <= set(q)
    assert set(QUERIES) - set(o) == ROWS_ONLY == set()


@pytest.mark.parametrize("left", ["nothing", "an empty folder", "a cache"])
def test_runs_without_the_corpus_package(tmp_path, left):
    """On a copy without the corpus operators, in a process of its own: nothing
    else is needed of them, also where an empty folder stays behind."""
    import os
    import shutil
    import subprocess
    import sys
    root = os.path.dirname(os.path.abspath(entry_mod.__file__))
    copy = tmp_path / "copy"
    shutil.copytree(f"{root}/tidings", copy / "tidings", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", copy)
    if left != "nothing":
        (copy / "tidings" / "llm" / ("__pycache__" if left == "a cache" else "")).mkdir(parents=True)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=copy, capture_output=True, text=True, timeout=120, env=os.environ | {"PYTHONDONTWRITEBYTECODE": "1"})
    assert out.stdout.split() == [str(len(QUERIES)), str(len(set(QUERIES) - ROWS_ONLY))], out.stderr


def test_a_broken_corpus_operator_is_an_error(monkeypatch):
    import importlib

    def broken(name):
        raise ModuleNotFoundError("No module named 'nowhere'", name="nowhere")

    monkeypatch.setattr(importlib, "import_module", broken)
    with pytest.raises(ModuleNotFoundError):
        entry_mod.queries()


KEYS = ["tag_profile", "score_content", "mmr_candidates", "doc_simhash", "near_dup_urls", "canonicalize_url",
        "extract_links", "filter_links", "front_queue", "hostname_stats", "filter_tags", "thin_content",
        "grade_enrichment", "list_content_after_filtered", "create_source_urls", "create_source", "patch_rejected",
        "validate_table", "enrich_content", "enrich_allowed", "crawl_round", "publish_feed",
        "relevant_sections", "near_dup_incremental", "near_copy_groups", "claim_stored_urls", "back_queue", "stream_profile_clocks", "select_feeds"]


@pytest.fixture(scope="module")
def duck(sf_small):
    return duck_connection(sf_small)


@pytest.mark.parametrize("key", KEYS)
def test_matches_duckdb(spark, duck, sf_small, key):
    r = compare(spark, duck, sf_small, key)
    assert r["ok"], r


def test_streaming_profile_equals_batch(spark, sf_small):
    stream = entry_mod.queries()["stream_tag_profile"](spark, sf_small)
    batch = entry_mod.queries()["tag_profile"](spark, sf_small)
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.select(*stream.columns).collect()))


def test_streaming_ingest_equals_batch(spark, sf_small):
    stream = entry_mod.queries()["stream_content_ingest"](spark, sf_small).select("url", "simhash")
    batch = entry_mod.queries()["content_ingest"](spark, sf_small).select("url", "simhash")
    assert sorted(map(tuple, stream.collect())) == sorted(map(tuple, batch.collect()))
