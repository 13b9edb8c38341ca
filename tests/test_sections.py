"""Sections of a page and their ranking by the title."""

import math
import random
import re

from pyspark.sql import functions as F

from tidings.functions import text as TX


def _sections(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "i int, html string")
    return [r["s"] for r in df.select("i", TX.page_sections(F.col("html")).alias("s")).orderBy("i").collect()]


def test_sections_begin_at_headings_and_edges(spark):
    cases = {
        "<p>menu</p><h1>One</h1><p>a</p><p>b</p><h2>Two</h2><p>c</p>": [["menu"], ["One", "a", "b"], ["Two", "c"]],
        "<div>ad</div><article><h1>T</h1><p>x</p></article><div>related</div>": [["ad"], ["T", "x"], ["related"]],
        "<p>a</p><p>b</p>": [["a"], ["b"]],  # nothing marks a section: each paragraph is one
        "<section></section>": [],
        "": [],
        "<main><p>x \x1e y</p></main>": [["x y"]],
        "<nav><h1>no</h1></nav><header><p>kept</p></header>": [["kept"]],
    }
    assert _sections(spark, list(cases)) == list(cases.values())


def _bm25(sections, query):
    """Scores by dictionaries."""
    words = [re.findall(r"[^\W_]+", "\n".join(s).lower()) for s in sections]
    terms = list(dict.fromkeys(re.findall(r"[^\W_]+", (query or "").lower())))
    mean = (sum(map(len, words)) / len(words)) or 1.0
    out = []
    for w in words:
        score = 0.0
        for t in terms:
            df = sum(t in x for x in words)
            idf = math.log(1 + (len(words) - df + 0.5) / (df + 0.5))
            tf = w.count(t)
            score += idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
        out.append(round(score, 9))
    return out


def test_scores_and_choice_equal_a_plain_version(spark):
    r = random.Random(5)
    vocabulary = ["rust", "async", "Über", "data", "the", "of", "x1", "漢字", "menu", "home"]
    cases = []
    for _ in range(60):
        sections = [[" ".join(r.choices(vocabulary, k=r.randint(1, 9))) for _ in range(r.randint(1, 3))] for _ in range(r.randint(1, 6))]
        cases.append((sections, r.choice([None, "", "...", " ".join(r.choices(vocabulary + ["nowhere"], k=r.randint(1, 4)))])))
    cases += [([], "rust"), ([["..."], ["!"]], "rust")]
    df = spark.createDataFrame([(i, s, q) for i, (s, q) in enumerate(cases)], "i int, s array<array<string>>, q string")
    rows = df.select("i", TX.section_scores(F.col("s"), F.col("q")).alias("scores"), TX.relevant_sections(F.col("s"), F.col("q")).alias("kept")).orderBy("i").collect()
    for (sections, query), row in zip(cases, rows, strict=True):
        want = _bm25(sections, query) if sections else []
        assert all(abs(a - b) < 1e-8 for a, b in zip(row["scores"], want, strict=True))
        best = max(want, default=0.0)
        assert row["kept"] == [s for s, x in zip(sections, want, strict=True) if x >= 0.2 * best]


def test_menus_go_and_pages_without_a_match_stay(spark):
    page = "<div>Home About Contact</div><article><h1>Async Rust</h1><p>Tasks in rust.</p></article><section><p>Sign up now</p></section>"
    rows = spark.createDataFrame([("Async Rust",), (None,), ("Gardening",)], "title string").withColumn("html", F.lit(page))
    kept = {r["title"]: r["c"] for r in rows.select("title", TX.page_chunks(F.col("html"), F.col("title")).alias("c")).collect()}
    assert kept["Async Rust"] == ["Async Rust", "Tasks in rust."]
    assert kept[None] == kept["Gardening"] == ["Home About Contact", "Async Rust", "Tasks in rust.", "Sign up now"]
