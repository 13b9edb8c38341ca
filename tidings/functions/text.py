"""Text rules: HTML to text chunks, the thin-content gate, the enrichment
input and tag-field names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .common import let

# FIXED VALUES (our page-text rule): blocks that are never main content, the
# closing tags that end a paragraph, and the entities we decode (&amp; last).
DROP_BLOCKS = ["script", "style", "nav", "footer", "noscript", "template"]
BREAK_PATTERN = r"(?i)<br\s*/?>|</(?:p|div|h[1-6]|li|article|section|tr|blockquote|pre|header|main)\s*>"
ENTITIES = [("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
            ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")]
SPACE_RUN = r"[ \t\r\f\x0B]+"
# FIXED VALUES (our section rule): the tags at which a section begins, the mark
# that stands for them, the constants of the ranking, and the part of the
# page's best score that a relevant section has.
SECTION_EDGE = r"(?i)<(?:h[1-6]|/?(?:article|section|aside|main))\b[^>]*>"
SECTION_MARK = "\x1e"
WORD = r"[\p{L}\p{N}]+"
BM25_K1, BM25_B = 1.2, 0.75
SECTION_SHARE = 0.2


def unescape(c: Column) -> Column:
    return reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), ENTITIES, c)


def html_body_text(html: Column, sections: bool = False) -> Column:
    """Visible text with one line per paragraph-like block, and on demand with
    a mark where a section begins."""
    if sections:
        html = F.replace(html, F.lit(SECTION_MARK), F.lit(" "))
    t = F.regexp_replace(html, r"(?s)<!--.*?-->", " ")
    for tag in DROP_BLOCKS:
        t = F.regexp_replace(t, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    t = F.regexp_replace(t, r"(?is)<head\b[^>]*>.*?</head\s*>", " ")
    if sections:
        t = F.regexp_replace(t, SECTION_EDGE, SECTION_MARK + "$0")
    t = F.regexp_replace(t, BREAK_PATTERN, "\n")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    t = unescape(t)
    return F.regexp_replace(t, SPACE_RUN, " ")


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: s != "")


def page_chunks(html: Column, query: Column | None = None) -> Column:
    """T10 (re-aimed): non-empty trimmed paragraph lines of the page body; with
    a ``query`` those of its relevant sections only."""
    if query is not None:
        return F.flatten(relevant_sections(page_sections(html), query))
    return _lines(html_body_text(html))


def page_sections(html: Column) -> Column:
    """The page body as sections, arrays of paragraph lines: one from each
    heading, and from each edge of a sectioning element, to the next.  In a page
    without any, every paragraph is a section."""
    def cut(text: Column) -> Column:
        parts = F.filter(F.transform(F.split(text, SECTION_MARK), _lines), lambda p: F.size(p) > 0)
        return F.when(F.instr(text, SECTION_MARK) > 0, parts).otherwise(F.transform(_lines(text), lambda p: F.array(p)))

    return let(html_body_text(html, sections=True), cut)


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def section_scores(sections: Column, query: Column) -> Column:
    """BM25 of each section against the distinct words of ``query``, with the
    page's sections as the collection (9 digits).  A section's words are looked
    through once; what is counted per query word are its hits alone."""
    def counted(p: Column) -> Column:
        def one(section: Column) -> Column:
            return let(words(F.array_join(section, "\n")), lambda w: F.struct(
                F.size(w).alias("n"), F.filter(w, lambda x: F.array_contains(p["query"], x)).alias("hits")))
        return let(F.struct(p["query"].alias("query"), F.transform(p["sections"], one).alias("s")), weighed)

    def weighed(p: Column) -> Column:
        n = F.size(p["s"])
        total = F.aggregate(p["s"], F.lit(0), lambda a, s: a + s["n"])

        def idf(t: Column) -> Column:
            df = F.size(F.filter(p["s"], lambda s: F.array_contains(s["hits"], t)))
            return F.struct(t.alias("t"), F.log(F.lit(1.0) + (n - df + F.lit(0.5)) / (df + F.lit(0.5))).alias("idf"))

        return let(F.struct(p["s"].alias("s"), F.when(total > 0, total / n).otherwise(F.lit(1.0)).alias("mean"),
                            F.transform(p["query"], idf).alias("query")), scored)

    def scored(p: Column) -> Column:
        def one(s: Column) -> Column:
            norm = F.lit(BM25_K1) * (F.lit(1.0 - BM25_B) + F.lit(BM25_B) * s["n"] / p["mean"])

            def add(a: Column, q: Column) -> Column:
                tf = F.size(F.filter(s["hits"], lambda x: x == q["t"]))
                return a + q["idf"] * tf * F.lit(BM25_K1 + 1) / (tf + norm)

            return F.round(F.aggregate(p["query"], F.lit(0.0), add), 9)
        return F.transform(p["s"], one)

    return let(F.struct(F.array_distinct(words(F.coalesce(query, F.lit("")))).alias("query"), sections.alias("sections")), counted)


def relevant_sections(sections: Column, query: Column, share: float = SECTION_SHARE) -> Column:
    """The sections that score at least ``share`` of the page's best one, in
    their order; all of them where none has a word of the query."""
    def kept(p: Column) -> Column:
        best = F.coalesce(F.array_max(p["scores"]), F.lit(0.0))
        return F.filter(p["sections"], lambda s, i: F.get(p["scores"], i) >= F.lit(share) * best)

    def bound(s: Column) -> Column:
        return let(F.struct(s.alias("sections"), section_scores(s, query).alias("scores")), kept)

    return let(sections, bound)


def html_title(html: Column) -> Column:
    raw = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    t = F.trim(F.regexp_replace(unescape(raw), SPACE_RUN, " "))
    return F.when(t != "", t)


# ---------------------------------------------------------------- enrichment gate

# Python ``str.isspace()`` characters and ``str.splitlines()`` boundaries,
# written with \x{..} escapes that both the JVM and RE2 understand.
PY_SPACE = (r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
            r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
LINE_BREAKS = r"\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"


def _py_strip(c: Column) -> Column:
    """Python ``str.strip()``."""
    return F.regexp_replace(c, f"^{PY_SPACE}+|{PY_SPACE}+$", "")


def content_lines(text: Column) -> Column:
    """Number of non-blank lines of the stripped text."""
    stripped = _py_strip(text)
    parts = F.split(stripped, LINE_BREAKS)
    return F.size(F.filter(parts, lambda s: _py_strip(s) != ""))


def thin_content_reason(text: Column) -> Column:
    """T5: NULL when the text may be analysed, else the rejection message."""
    stripped = _py_strip(text)
    n_chars = F.length(stripped)
    n_lines = F.when(stripped == "", F.lit(0)).otherwise(content_lines(text))
    msg = F.format_string(
        "content too thin to analyse: %d non-empty line(s), %d char(s) "
        f"(need >= {K.MIN_CONTENT_LINES} lines and >= {K.MIN_CONTENT_CHARS} chars)",
        n_lines, n_chars)
    return F.when((n_chars < K.MIN_CONTENT_CHARS) | (n_lines < K.MIN_CONTENT_LINES), msg)


def build_enrich_input(text: Column, title: Column, url: Column) -> Column:
    """Truncated content with optional Title / URL header lines."""
    body = _py_strip(text)
    cut = F.regexp_replace(F.substring(body, 1, K.MAX_INPUT_CHARS), f"{PY_SPACE}+$", "")
    body = F.when(F.length(body) > K.MAX_INPUT_CHARS, F.concat(cut, F.lit(K.TRUNCATION_MARK))).otherwise(body)
    title_s, url_s = _py_strip(title), _py_strip(url)
    head_t = F.when(title.isNotNull() & (title != ""), F.concat(F.lit("Title: "), title_s))
    head_u = F.when(url.isNotNull() & (url != ""), F.concat(F.lit("URL: "), url_s))
    return F.concat_ws("\n", head_t, head_u, F.concat(F.lit("Content:\n"), body))


def join_chunks(chunks: Column) -> Column:
    """Chunks joined by a blank line."""
    return F.array_join(chunks, "\n\n")


def tag_field_name(tag: Column, idx: Column) -> Column:
    """``tag_<i>_<slug>`` (``tag_<i>`` when the slug is empty)."""
    slug = F.regexp_replace(F.regexp_replace(F.lower(tag), r"[^0-9a-z]+", "_"), r"^_+|_+$", "")
    base = F.concat(F.lit("tag_"), idx.cast("string"))
    return F.when(slug == "", base).otherwise(F.concat(base, F.lit("_"), slug))
