"""Content enrichment with a caller-supplied model, plus output grading.

Everything except the model call is a Catalyst expression: the empty-chunks
check, the thin-content gate (T5), the model input (T6), tag clean-up (T9)
and the state update (C10).  The model is called in Arrow batches through
``mapInPandas``, for the rows that pass the gate; each gets up to five tries
and an error becomes data, as in the reference worker loop.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..functions.tags import finalize_tags, normalize_tags, tags_from_flags
from ..functions.text import PY_SPACE, build_enrich_input, join_chunks, thin_content_reason

Model = Callable[[str], dict]

_WORD = re.compile(r"[^\W\d_]{4,}")
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")


def keyword_model(prompt: str) -> dict:
    """Deterministic stand-in model: the first two sentences of the content as
    summary, the five most frequent words (4+ letters) as tags."""
    body = prompt.split("Content:\n", 1)[-1]
    sentences = [s.strip() for s in _SENTENCE_END.split(body.strip()) if s.strip()]
    summary = " ".join(sentences[:2])
    words = [w.lower() for w in _WORD.findall(body)]
    counts = Counter(words)
    first = {}
    for i, w in enumerate(words):
        first.setdefault(w, i)
    tags = sorted(counts, key=lambda w: (-counts[w], first[w]))[:5]
    return {"summary": summary, "tags": tags}


def vocabulary_model(vocabulary: list[str]) -> Model:
    """Deterministic closed-vocabulary model: the summary of
    ``keyword_model``, and for each entry whether it is a word of the text."""
    def model(prompt: str) -> dict:
        body = prompt.split("Content:\n", 1)[-1]
        words = {w.lower() for w in _WORD.findall(body)}
        return {"summary": keyword_model(prompt)["summary"], "flags": [v.strip().lower() in words for v in vocabulary]}
    return model


def _runner(model: Model, max_tries: int, max_workers: int = 1):
    def one(prompt: str | None):
        summary, tags, flags, err, tries = None, None, None, None, 0
        while prompt is not None and tries < max_tries:
            tries += 1
            try:
                res = model(prompt)
                summary, err = res.get("summary"), None
                tags = list(res.get("tags") or [])
                flags = [bool(f) for f in res["flags"]] if res.get("flags") is not None else None
                break
            except Exception as e:  # the error is recorded as data
                err = str(e)
        return summary, tags, flags, err, tries

    def run(batches):
        from concurrent.futures import ThreadPoolExecutor
        pool = ThreadPoolExecutor(max_workers) if max_workers > 1 else None
        try:
            for pdf in batches:
                prompts = [None if gate is not None else p for p, gate in zip(pdf["prompt"], pdf["gate_error"])]
                results = list(pool.map(one, prompts)) if pool else [one(p) for p in prompts]
                cols = list(zip(*results)) if results else [[]] * 5
                yield pd.DataFrame({"id": pdf["id"], "summary": list(cols[0]), "raw_tags": list(cols[1]), "flags": list(cols[2]),
                                    "error": [gate if gate is not None else e for gate, e in zip(pdf["gate_error"], cols[3])],
                                    "tries": list(cols[4])})
        finally:
            if pool:
                pool.shutdown()
    return run


def enrich_content(claimed: DataFrame, model: Model = keyword_model,
                   max_tries: int = K.ENRICH_MAX_TRIES, allowed_tags: list[str] | None = None,
                   max_workers: int = 1) -> DataFrame:
    """Enrichment result per claimed row:
    ``id, summary, tags, error`` where exactly one of (tags/summary, error)
    is set.  ``claimed`` needs ``id`` (of any type), ``chunks, title, url``.

    The gate is an expression next to the prompt; a row that it stops passes
    through with its reason and never reaches the model.  The result is lazy:
    whoever reads it twice writes it first (as ``enrichment_run`` does), or
    the model is called again.

    Without ``allowed_tags`` (what the reference worker does) the model's
    free-form tags are cleaned of boilerplate.  With a vocabulary the model
    may answer one boolean per vocabulary entry (``flags``, E2); the chosen
    tags are decoded in vocabulary order and kept only if allowed.
    ``max_workers`` > 1 overlaps I/O-bound model calls inside each task
    (order is kept; every row still gets its own ``max_tries``)."""
    text = join_chunks(F.col("chunks"))
    gate = (F.when(F.coalesce(F.size("chunks"), F.lit(0)) <= 0, F.lit("Empty chunks"))
            .otherwise(thin_content_reason(text)))
    rows = claimed.select("id", build_enrich_input(text, F.col("title"), F.col("url")).alias("prompt"), gate.alias("gate_error"))
    schema = T.StructType([T.StructField("id", claimed.schema["id"].dataType), *T.StructType.fromDDL(
        "summary string, raw_tags array<string>, flags array<boolean>, error string, tries int").fields])
    answered = rows.mapInPandas(_runner(model, max_tries, max_workers), schema)
    return _with_tags(answered, allowed_tags).select("id", "summary", "tags", "error")


# ---------------------------------------------------------------- batch models, tries in rounds

BatchModel = Callable[[list[str]], list]  # per prompt a result as of ``Model``, or an exception
ANSWER = "summary string, raw_tags array<string>, flags array<boolean>, error string"


def per_worker(make_model: Callable[[], BatchModel], name: str) -> BatchModel:
    """The model of this Python worker: made at the first task that asks for it
    by this name, and kept as long as the worker lives."""
    import sys
    import types

    kept = sys.modules.setdefault("_enrich_models", types.ModuleType("_enrich_models")).__dict__
    if name not in kept:
        kept[name] = make_model()
    return kept[name]


def _batch_runner(make_model, name: str, batch_size: int, max_workers: int):
    def answers(model, prompts: list[str]) -> list[tuple]:
        try:
            results = list(model(prompts))
            if len(results) != len(prompts):
                raise ValueError(f"{len(results)} answers to {len(prompts)} prompts")
        except Exception as e:  # the whole call: each of its rows gets another try
            results = [e] * len(prompts)
        out = []
        for r in results:
            if isinstance(r, Exception):
                out.append((None, None, None, str(r)))
            else:
                flags = [bool(f) for f in r["flags"]] if r.get("flags") is not None else None
                out.append((r.get("summary"), list(r.get("tags") or []), flags, None))
        return out

    def run(batches):
        from concurrent.futures import ThreadPoolExecutor, as_completed

        model = per_worker(make_model, name)

        def frame(ids, prompts):
            cols = list(zip(*answers(model, prompts)))
            return pd.DataFrame({"id": ids, **{c: list(x) for c, x in zip(("summary", "raw_tags", "flags", "error"), cols)}})

        with ThreadPoolExecutor(max_workers) as pool:
            for pdf in batches:  # a slow call holds back neither the other calls nor their rows
                calls = [pool.submit(frame, pdf["id"].iloc[i:i + batch_size].reset_index(drop=True), pdf["prompt"].iloc[i:i + batch_size].tolist())
                         for i in range(0, len(pdf), batch_size)]
                for call in as_completed(calls):
                    yield call.result()
    return run


def enrich_in_rounds(claimed: DataFrame, make_model: Callable[[], BatchModel], name: str = "model", max_tries: int = K.ENRICH_MAX_TRIES,
                     allowed_tags: list[str] | None = None, batch_size: int = 16, max_workers: int = 4,
                     pause: Callable[[int], float] = lambda tries: 1.0 + tries, sleep: Callable[[float], None] | None = None) -> DataFrame:
    """E1 with a model that takes lists of prompts: ``id, summary, tags, error,
    tries`` as of ``enrich_content``.

    A round calls the model for every row that is left, in lists of
    ``batch_size`` of which ``max_workers`` run at once in a task.  Rows that
    failed, alone or with their whole list, are dealt out anew to all tasks in
    the next round, in lists half as long, so that a row that breaks its list
    soon breaks only its own; before it the job pauses (``pause`` of the tries
    made, growing by a second, as the reference does per row).  Each round's
    answers are a written table: a lost executor repeats its own calls only."""
    import time

    from ..session import cut_lineage
    text = join_chunks(F.col("chunks"))
    gate = F.when(F.coalesce(F.size("chunks"), F.lit(0)) <= 0, F.lit("Empty chunks")).otherwise(thin_content_reason(text))
    rows = cut_lineage(claimed.select("id", build_enrich_input(text, F.col("title"), F.col("url")).alias("prompt"), gate.alias("gate_error")))
    schema = T.StructType([T.StructField("id", claimed.schema["id"].dataType), *T.StructType.fromDDL(ANSWER).fields])
    left = rows.where("gate_error IS NULL").select("id", "prompt")
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in T.StructType.fromDDL(ANSWER).fields if f.name != "error"]
    done = rows.where("gate_error IS NOT NULL").select("id", *none, F.col("gate_error").alias("error"), F.lit(0).alias("tries"))
    for tries in range(1, max_tries + 1):
        if tries > 1:
            (sleep or time.sleep)(pause(tries - 1))
            left = left.repartition(left.sparkSession.sparkContext.defaultParallelism)
        answered = cut_lineage(left.mapInPandas(_batch_runner(make_model, name, max(1, batch_size >> (tries - 1)), max_workers), schema))
        failed = answered.where("error IS NOT NULL")
        last = tries == max_tries or failed.isEmpty()
        done = done.unionByName((answered if last else answered.where("error IS NULL")).withColumn("tries", F.lit(tries)))
        if last:
            break
        left = cut_lineage(left.join(failed.select("id"), "id", "left_semi"))
    return _with_tags(done, allowed_tags).select("id", "summary", "tags", "error", "tries")


def _with_tags(answered: DataFrame, allowed_tags: list[str] | None) -> DataFrame:
    if allowed_tags:
        vocab = F.array(*[F.lit(t) for t in allowed_tags])
        raw = F.when(F.col("flags").isNotNull(), tags_from_flags(vocab, F.col("flags"))).otherwise(F.col("raw_tags"))
        final = finalize_tags(raw, vocab)
    else:
        final = finalize_tags(F.col("raw_tags"))
    return answered.withColumn("tags", F.when(F.col("error").isNull(), final))


def apply_enrichment(content: DataFrame, results: DataFrame) -> DataFrame:
    """COMPLETED with summary and tags, or FAILED with the error."""
    r = results.select(F.col("id").alias("_id"), F.col("summary").alias("_summary"),
                       F.col("tags").alias("_tags"), F.col("error").alias("_error"))
    j = content.join(r, F.col("id") == F.col("_id"), "left")
    hit = F.col("_id").isNotNull()
    ok = hit & F.col("_error").isNull()
    failed = hit & F.col("_error").isNotNull()
    return (j.withColumn("pipeline_state", F.when(ok, F.lit(K.PIPE_COMPLETED))
                         .when(failed, F.lit(K.PIPE_FAILED)).otherwise(F.col("pipeline_state")))
            .withColumn("summary", F.when(ok, F.col("_summary")).otherwise(F.col("summary")))
            .withColumn("tags", F.when(ok, F.col("_tags")).otherwise(F.col("tags")))
            .withColumn("pipeline_error", F.when(failed & (F.col("_error") != ""), F.col("_error"))
                        .otherwise(F.col("pipeline_error")))
            .drop("_id", "_summary", "_tags", "_error"))


# ---------------------------------------------------------------- grading

GRADERS = ["error_expectation", "summary_has_substance", "tags_subset_of_allowed", "tags_well_formed",
           "expected_tag_present", "forbidden_tag_absent", "summary_mentions_keyword",
           "tags_empty_when_nothing_applies"]


def _word_count(s):
    return F.size(F.filter(F.split(F.coalesce(s, F.lit("")), f"{PY_SPACE}+"), lambda w: w != ""))


def grade_enrichment(cases: DataFrame) -> DataFrame:
    """One boolean column per grader.  ``cases`` carries inputs
    (allowed_tags), output (summary, tags, error) and expectation
    (expect_error, expected_tags, forbidden_tags, keywords,
    min_summary_words, expect_empty_tags)."""
    tags = F.coalesce(F.col("tags"), F.array().cast("array<string>"))
    allowed = normalize_tags(F.coalesce(F.col("allowed_tags"), F.array().cast("array<string>")))
    expected = normalize_tags(F.coalesce(F.col("expected_tags"), F.array().cast("array<string>")))
    forbidden = normalize_tags(F.coalesce(F.col("forbidden_tags"), F.array().cast("array<string>")))
    keywords = F.transform(F.coalesce(F.col("keywords"), F.array().cast("array<string>")), F.lower)
    expect_err = F.coalesce(F.col("expect_error"), F.lit("")) != ""
    summary = F.lower(F.coalesce(F.col("summary"), F.lit("")))
    overlap = lambda a, b: F.exists(a, lambda t: F.array_contains(b, t))
    return cases.select(
        "*",
        F.col("error").eqNullSafe(F.col("expect_error")).alias("error_expectation"),
        (expect_err | (_word_count(F.col("summary")) >= F.col("min_summary_words"))).alias("summary_has_substance"),
        ((F.size(allowed) == 0) | F.forall(tags, lambda t: F.array_contains(allowed, t))).alias("tags_subset_of_allowed"),
        (tags == normalize_tags(tags)).alias("tags_well_formed"),
        ((F.size(expected) == 0) | overlap(tags, expected)).alias("expected_tag_present"),
        ((F.size(forbidden) == 0) | ~overlap(tags, forbidden)).alias("forbidden_tag_absent"),
        ((F.size(keywords) == 0) | F.exists(keywords, lambda k: F.instr(summary, k) > 0)).alias("summary_mentions_keyword"),
        (~F.coalesce(F.col("expect_empty_tags"), F.lit(False)) | (F.size(tags) == 0)).alias("tags_empty_when_nothing_applies"),
    )


def enrichment_pass_rate(graded: DataFrame) -> DataFrame:
    """A10: share of passed (case, grader) assertions, plus counts."""
    passed = sum(F.col(g).cast("int") for g in GRADERS)
    return graded.agg(
        F.count(F.lit(1)).alias("n_cases"),
        (F.count(F.lit(1)) * len(GRADERS)).alias("n_assertions"),
        F.sum(passed).cast("bigint").alias("n_passed"),
        (F.sum(passed) / (F.count(F.lit(1)) * F.lit(len(GRADERS)))).alias("pass_rate"))
