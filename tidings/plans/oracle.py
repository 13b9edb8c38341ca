"""DuckDB reference SQL for each registered query.

Each string reads only the raw driver tables.  The FIXTURES.md mapping
(content, interaction, url_t, host_t) is inlined as CTEs that match
``tidings.sources.testdata`` row for row.  Results are rendered the same way
as ``tidings.functions.common.report``: doubles rounded to 6 digits, arrays
joined with '|', timestamps as text with microseconds.
"""

from __future__ import annotations

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
TS = "'%Y-%m-%d %H:%M:%S.%f'"


def R(x: str) -> str:
    return f"(round(CAST({x} AS DOUBLE), 6) + 0.0)"


def S(x: str) -> str:
    return f"strftime({x}, {TS})"


def J(x: str) -> str:
    return f"array_to_string({x}, '|')"


def DAYS(later: str, earlier: str) -> str:
    return f"CAST(floor((epoch_us({later}) - epoch_us({earlier})) / 86400000000.0) AS BIGINT)"


URL_RE = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"

CTES: dict[str, tuple[list[str], str]] = {}


def cte(name: str, deps: list[str], body: str) -> None:
    CTES[name] = (deps, body)


cte("content", [], f"""
SELECT doc_id AS id,
       'https://' || source || '.example.com/post/' || CAST(doc_id AS VARCHAR) AS url,
       source || '.example.com' AS hostname,
       substr(text, 1, 60) AS title,
       text,
       string_split(text, chr(10)) AS chunks,
       CASE WHEN doc_id % 97 = 96 THEN CAST([] AS VARCHAR[])
            ELSE [source, 't' || CAST(doc_id % 40 AS VARCHAR), 'q' || CAST(doc_id % 33 AS VARCHAR)] END AS tags,
       {AS_OF} - to_days(CAST(doc_id % 45 AS INTEGER)) - to_hours(CAST(doc_id % 24 AS BIGINT)) AS scraped_at,
       CASE WHEN doc_id % 4 = 0 THEN {AS_OF} - to_hours(CAST((doc_id % 6) * 12 AS BIGINT)) END AS last_shown_at,
       CAST(NULL AS TIMESTAMP) AS last_seen_at,
       CASE WHEN doc_id % 10 = 9 THEN 1 ELSE 5 END AS pipeline_state,
       CAST(NULL AS VARCHAR) AS summary,
       CAST(NULL AS VARCHAR) AS pipeline_error,
       0.0::DOUBLE AS score,
       {AS_OF} - to_days(CAST(doc_id % 45 AS INTEGER)) - to_hours(CAST(doc_id % 24 AS BIGINT)) AS created_at
FROM documents""")

WEIGHT_CASE = """CASE type WHEN 'impression' THEN 0.1::DOUBLE WHEN 'open' THEN 1.0::DOUBLE
  WHEN 'read' THEN 2.0::DOUBLE WHEN 'like' THEN 3.0::DOUBLE WHEN 'bookmark' THEN 3.0::DOUBLE
  WHEN 'share' THEN 3.0::DOUBLE WHEN 'hide' THEN -3.0::DOUBLE ELSE 0.0::DOUBLE END"""

cte("interaction", ["content"], f"""
SELECT event_id, content_id, tag, type, created_at, {WEIGHT_CASE} AS weight
FROM (
  SELECT e.event_id, c.id AS content_id, unnest(c.tags) AS tag,
         CASE WHEN e.event_type = 'view' THEN 'impression'
              WHEN e.event_type = 'click' THEN CASE WHEN e.value < 50 THEN 'open' ELSE 'read' END
              WHEN e.event_type = 'purchase' THEN 'like'
              WHEN e.event_type = 'signup' THEN CASE WHEN e.value < 50 THEN 'bookmark' ELSE 'share' END
              WHEN e.event_type = 'error' THEN CASE WHEN e.k < 5 THEN 'hide' ELSE 'impression' END
         END AS type,
         e.ts AS created_at
  FROM (SELECT event_id, ts, event_type, value,
               CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) e
  JOIN content c ON c.id = e.k)""")

cte("url_t", [], f"""
SELECT page_id AS id, url,
       CASE WHEN h = '' THEN NULL ELSE h END AS hostname,
       CAST(1 + page_id % 6 AS INTEGER) AS crawl_state,
       CAST(0 AS BIGINT) AS retry_count,
       0.0::DOUBLE AS priority_score,
       CAST(0 AS BIGINT) AS depth,
       CASE WHEN page_id % 10 = 0 THEN 'source' ELSE 'url' END AS kind,
       CASE WHEN page_id % 10 = 0 THEN url ELSE 'seed' END AS source,
       {AS_OF} + to_minutes(CAST(((page_id * 37) % 240) - 120 AS BIGINT)) AS next_crawl_at,
       CAST(NULL AS TIMESTAMP) AS last_crawl_at,
       CAST(NULL AS VARCHAR) AS crawl_run_id,
       page_id AS sequence,
       TIMESTAMP '2024-01-01 00:00:00' + to_seconds(page_id) AS created_at
FROM (SELECT *, lower(CASE WHEN starts_with(hi, '[') THEN regexp_extract(hi, '^\\[([^\\]]*)\\]', 1)
                         ELSE regexp_replace(hi, ':.*$', '') END) AS h
      FROM (SELECT *, regexp_replace(regexp_extract(url, '{URL_RE}', 4), '^.*@', '') AS hi FROM pages) p0) p1""")

cte("host_t", ["url_t"], f"""
SELECT hostname AS id, hostname AS name,
       CAST(NULL AS TIMESTAMP) AS last_crawled_at,
       CAST(0 AS BIGINT) AS crawl_count,
       10.0::DOUBLE AS crawl_delay_seconds,
       {AS_OF} + to_minutes(CAST(((first_id * 53) % 120) - 60 AS BIGINT)) AS next_allowed_at,
       CAST(0 AS BIGINT) AS failure_count,
       CAST(0 AS BIGINT) AS success_count,
       TIMESTAMP '2024-01-01 00:00:00' + to_seconds(first_id) AS created_at
FROM (SELECT hostname, min(id) AS first_id FROM url_t GROUP BY hostname) g""")

cte("aged", ["interaction"], f"""
SELECT *, {DAYS(AS_OF, 'created_at')} AS age FROM interaction""")

cte("profile_raw", ["aged"], """
SELECT tag,
       sum(weight * pow(0.5, age / 2.0)) AS recent_weight,
       sum(weight * pow(0.5, age / 14.0)) AS long_weight,
       bool_or(type = 'hide') AS hidden
FROM aged GROUP BY tag""")

cte("profile", ["profile_raw"], """
SELECT tag,
       recent_weight / (SELECT CASE WHEN max(recent_weight) > 0 THEN max(recent_weight) ELSE 1.0 END FROM profile_raw) AS recent_weight,
       long_weight / (SELECT CASE WHEN max(long_weight) > 0 THEN max(long_weight) ELSE 1.0 END FROM profile_raw) AS long_weight,
       hidden
FROM profile_raw""")

cte("cand", ["content"], f"""
SELECT * FROM content
WHERE pipeline_state = 5 AND scraped_at >= {AS_OF} - INTERVAL 30 DAY AND scraped_at <= {AS_OF}""")

cte("post_agg", ["cand", "profile"], """
SELECT e.id,
       max(coalesce(p.recent_weight, 0.0)) AS max_recent,
       sum(coalesce(p.long_weight, 0.0)) AS sum_long,
       bool_or(coalesce(p.hidden, false)) AS has_hidden
FROM (SELECT id, unnest(tags) AS tag FROM cand) e LEFT JOIN profile p ON p.tag = e.tag
GROUP BY e.id""")

cte("scored", ["cand", "post_agg"], f"""
SELECT id, url, hostname, title, tags, scraped_at, last_shown_at,
       continuity, relevance, 1.0::DOUBLE - relevance AS novelty, has_hidden, freshness,
       0.5 * continuity + 0.2 * relevance + 0.3 * (1.0 - relevance) AS interest,
       (0.5 * continuity + 0.2 * relevance + 0.3 * (1.0 - relevance)) * freshness AS score
FROM (
  SELECT c.*, greatest(0.0::DOUBLE, coalesce(a.max_recent, 0.0)) AS continuity,
         CASE WHEN len(c.tags) > 0 THEN a.sum_long / len(c.tags) ELSE 0.0::DOUBLE END AS relevance,
         coalesce(a.has_hidden, false) AS has_hidden,
         pow(0.5, {DAYS(AS_OF, 'c.scraped_at')} / 10.0)
         * CASE WHEN c.last_shown_at IS NULL THEN 1.0::DOUBLE
                ELSE least(greatest({DAYS(AS_OF, 'c.last_shown_at')} / 3.0, 0.15), 1.0) END
         * CASE WHEN coalesce(a.has_hidden, false) THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END AS freshness
  FROM cand c LEFT JOIN post_agg a ON a.id = c.id) s""")

cte("ranked", ["scored"], """
SELECT *, row_number() OVER (ORDER BY score DESC, scraped_at DESC, id ASC) AS rank FROM scored""")


def with_ctes(names: list[str], body: str) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    if not order:
        return body
    parts = ",\n".join(f"{n} AS ({CTES[n][1]})" for n in order)
    return f"WITH {parts}\n{body}"


SQL: dict[str, str] = {}


def sql(name: str, ctes: list[str], body: str) -> None:
    SQL[name] = with_ctes(ctes, body)


# --------------------------------------------------------------------------
# Feed maths
# --------------------------------------------------------------------------
sql("interaction_age", ["aged"], f"""
SELECT event_id, content_id, tag, type, {R('weight')} AS weight, {S('created_at')} AS created_at, age FROM aged""")

sql("interaction_weight", ["interaction"], f"""
SELECT type, {R("weight")} AS weight, count(*) AS n FROM interaction GROUP BY type, weight""")

sql("decay", ["aged"], f"""
SELECT event_id, tag, age,
       {R('weight * pow(0.5, age / 2.0)')} AS recent_decay,
       {R('weight * pow(0.5, age / 14.0)')} AS long_decay,
       {R('pow(0.5, age / 10.0)')} AS content_decay
FROM aged""")

sql("tag_profile_raw", ["profile_raw"], f"""
SELECT tag, {R('recent_weight')} AS recent_weight, {R('long_weight')} AS long_weight, hidden FROM profile_raw""")

sql("tag_profile", ["profile"], f"""
SELECT tag, {R('recent_weight')} AS recent_weight, {R('long_weight')} AS long_weight, hidden FROM profile""")

_CLOCKS = [("2024-01-15 06:00:00", "created_at < TIMESTAMP '2024-01-15 06:00:00'"), ("2024-01-31 00:00:00", "true")]
sql("stream_profile_clocks", ["interaction"], " UNION ALL ".join(f"""SELECT * FROM (
WITH r AS (SELECT tag, sum(weight * pow(0.5, age / 2.0)) AS recent_weight, sum(weight * pow(0.5, age / 14.0)) AS long_weight, bool_or(type = 'hide') AS hidden
           FROM (SELECT *, {DAYS(f"TIMESTAMP '{at}'", 'created_at')} AS age FROM interaction WHERE {where}) a GROUP BY tag),
     m AS (SELECT CASE WHEN max(recent_weight) > 0 THEN max(recent_weight) ELSE 1.0 END AS r, CASE WHEN max(long_weight) > 0 THEN max(long_weight) ELSE 1.0 END AS l FROM r)
SELECT tag, {R('recent_weight / m.r')} AS recent_weight, {R('long_weight / m.l')} AS long_weight, hidden, '{at}' AS as_of FROM r, m) z{i}"""
    for i, (at, where) in enumerate(_CLOCKS)))

sql("hidden_tags", ["interaction"], """
SELECT DISTINCT tag FROM interaction WHERE type = 'hide'""")

sql("content_window", ["cand"], f"""
SELECT id, url, hostname, title, {J('tags')} AS tags, {S('scraped_at')} AS scraped_at,
       {S('last_shown_at')} AS last_shown_at, pipeline_state FROM cand""")

sql("freshness", ["scored"], f"""
SELECT id,
       {R(f"pow(0.5, {DAYS(AS_OF, 'scraped_at')} / 10.0)")} AS age_factor,
       {R(f"CASE WHEN last_shown_at IS NULL THEN 1.0 ELSE least(greatest({DAYS(AS_OF, 'last_shown_at')} / 3.0, 0.15), 1.0) END")} AS shown_factor,
       {R('CASE WHEN has_hidden THEN 0.1 ELSE 1.0 END')} AS suppressed_penalty,
       {R('freshness')} AS freshness
FROM scored""")

sql("score_content", ["scored"], f"""
SELECT id, {R('continuity')} AS continuity, {R('relevance')} AS relevance, {R('novelty')} AS novelty,
       {R('freshness')} AS freshness, {R('interest')} AS interest, {R('score')} AS score
FROM scored""")

sql("ranked_feed", ["scored"], f"""
SELECT id, url, title, {R('score')} AS score FROM scored ORDER BY score DESC, scraped_at DESC, id""")

sql("top_n_by_score", ["ranked"], f"""
SELECT id, url, {R('score')} AS score, rank FROM ranked WHERE rank <= 10""")

sql("feed_quota", ["cand"], """
SELECT hostname, n AS feed_limit,
       CAST(round_even(n * 0.5::DOUBLE, 0) AS BIGINT) AS continuity_slots,
       CAST(round_even(n * 0.2::DOUBLE, 0) AS BIGINT) AS relevance_slots,
       CAST(round_even(n * 0.3::DOUBLE, 0) AS BIGINT) AS novelty_slots
FROM (SELECT hostname, count(*) AS n FROM cand GROUP BY hostname) g""")

sql("tag_jaccard", ["cand"], f"""
SELECT a.id AS id, {R("CASE WHEN len(list_distinct(list_concat(a.tags, b.tags))) = 0 THEN 0.0 ELSE len(list_intersect(a.tags, b.tags)) / len(list_distinct(list_concat(a.tags, b.tags))) END")} AS jaccard
FROM cand a JOIN (SELECT hostname, min(id) AS first_id FROM cand GROUP BY hostname) f ON a.hostname = f.hostname
JOIN cand b ON b.id = f.first_id""")

_MMR_WINDOWS = " UNION ".join(
    f"""SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY tag_set
        ORDER BY {s} * freshness DESC, score DESC, scraped_at DESC, id ASC) AS rn FROM ts) w{i} WHERE rn <= 10"""
    for i, s in enumerate(["continuity", "relevance", "novelty", "interest"]))

cte("ts", ["scored"], """
SELECT *, list_sort(list_distinct(tags)) AS tag_set FROM scored""")

sql("mmr_candidates", ["scored", "ts"], f"""
SELECT id, {R('score')} AS score FROM scored WHERE id IN ({_MMR_WINDOWS})""")

sql("mark_shown", ["content", "ranked"], f"""
SELECT c.id, {S(f"CASE WHEN r.id IS NOT NULL THEN {AS_OF} ELSE c.last_shown_at END")} AS last_shown_at
FROM content c LEFT JOIN (SELECT id FROM ranked WHERE rank <= 10) r ON r.id = c.id""")


# --------------------------------------------------------------------------
# SQL builders mirroring the column expressions in tidings.functions
# --------------------------------------------------------------------------
from .. import constants as _K  # noqa: E402
from ..functions import text as _T  # noqa: E402


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def sql_scheme(u: str) -> str:
    return f"lower(regexp_extract({u}, {q(URL_RE)}, 2))"


def sql_netloc(u: str) -> str:
    return f"regexp_extract({u}, {q(URL_RE)}, 4)"


def sql_path(u: str) -> str:
    return f"regexp_extract({u}, {q(URL_RE)}, 5)"


def sql_query(u: str) -> str:
    return f"regexp_extract({u}, {q(URL_RE)}, 7)"


def sql_is_ignored(u: str) -> str:
    import re as _re
    path = f"lower({sql_path(u)})"
    segs = f"list_filter(string_split({path}, '/'), lambda s: s <> '')"
    ext = "(?:" + "|".join(_re.escape(e) for e in _K.IGNORE_EXTENSIONS) + ")$"
    subs = " OR ".join(f"contains({path}, {q(s)})" for s in _K.IGNORE_SUBSTRINGS)
    blocked = "[" + ", ".join(q(s) for s in _K.IGNORE_SEGMENTS) + "]"
    return (f"(({sql_scheme(u)} NOT IN ('http', 'https')) OR len({segs}) = 0"
            f" OR regexp_matches(regexp_replace({sql_path(u)}, '/+$', ''), '^/@[^/]+$')"
            f" OR {subs} OR regexp_matches({path}, {q(ext)})"
            f" OR len(list_intersect({segs}, {blocked})) > 0)")


def sql_unescape(x: str) -> str:
    for a, b in _T.ENTITIES:
        x = f"replace({x}, {q(a)}, {q(b)})"
    return x


def sql_body_text(h: str, sections: bool = False) -> str:
    if sections:
        h = f"replace({h}, chr(30), ' ')"
    t = f"regexp_replace({h}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in _T.DROP_BLOCKS:
        t = f"regexp_replace({t}, {q(rf'(?is)<{tag}\b[^>]*>.*?</{tag}\s*>')}, ' ', 'g')"
    t = f"regexp_replace({t}, {q(r'(?is)<head\b[^>]*>.*?</head\s*>')}, ' ', 'g')"
    if sections:
        t = f"regexp_replace({t}, {q(_T.SECTION_EDGE)}, chr(30) || '\\0', 'g')"
    t = f"regexp_replace({t}, {q(_T.BREAK_PATTERN)}, chr(10), 'g')"
    t = f"regexp_replace({t}, '<[^>]*>', ' ', 'g')"
    t = sql_unescape(t)
    return f"regexp_replace({t}, {q(_T.SPACE_RUN)}, ' ', 'g')"


def sql_lines(t: str) -> str:
    return f"list_filter(list_transform(string_split({t}, chr(10)), lambda l: trim(l)), lambda l: l <> '')"


def sql_chunks(h: str) -> str:
    return sql_lines(sql_body_text(h))


def sql_title(h: str) -> str:
    raw = f"regexp_extract({h}, '(?is)<title[^>]*>(.*?)</title>', 1)"
    t = f"trim(regexp_replace({sql_unescape(raw)}, {q(_T.SPACE_RUN)}, ' ', 'g'))"
    return f"nullif({t}, '')"


def sql_simhash_cte(name: str, src: str, id_col: str, text_col: str, deps: list[str]) -> None:
    """CTE ``name(id, simhash)`` with the fingerprint rule of functions.simhash."""
    sums = ", ".join(f"sum((u >> {i}) & 1) AS b{i}" for i in range(64))
    terms = " + ".join(f"CASE WHEN 2 * b{i} > n THEN CAST({1 << i} AS HUGEINT) ELSE 0 END" for i in range(64))
    cte(name, deps, f"""
SELECT d.{id_col} AS id,
       CAST(CASE WHEN s >= CAST('9223372036854775808' AS HUGEINT)
                 THEN s - CAST('18446744073709551616' AS HUGEINT) ELSE s END AS BIGINT) AS simhash
FROM {src} d LEFT JOIN (
  SELECT id, {terms} AS s FROM (
    SELECT id, count(*) AS n, {sums}
    FROM (SELECT id, CAST('0x' || substr(md5(tok), 1, 16) AS UBIGINT) AS u
          FROM (SELECT {id_col} AS id, unnest(regexp_extract_all(lower({text_col}), '[\\p{{L}}\\p{{N}}]+')) AS tok
                FROM {src}) t0) t1
    GROUP BY id) t2) f ON f.id = d.{id_col}""")


def BAND(h: str, k: int) -> str:
    return f"CAST(({h} >> {16 * k}) & 65535 AS INTEGER)"


def UNSIGNED(h: str) -> str:
    return (f"CAST(CASE WHEN {h} < 0 THEN CAST({h} AS HUGEINT) + CAST('18446744073709551616' AS HUGEINT)"
            f" ELSE CAST({h} AS HUGEINT) END AS VARCHAR)")


# ---- SimHash / dedup ---------------------------------------------------------
sql_simhash_cte("doc_fp", "documents", "doc_id", "text", [])

cte("doc_fp_full", ["content", "doc_fp"], """
SELECT c.id, c.url, c.scraped_at, f.simhash FROM content c JOIN doc_fp f ON f.id = c.id""")

cte("existing_c", ["doc_fp_full"], "SELECT * FROM doc_fp_full WHERE scraped_at < TIMESTAMP '2024-01-16 00:00:00'")
cte("incoming_c", ["doc_fp_full"], "SELECT * FROM doc_fp_full WHERE scraped_at >= TIMESTAMP '2024-01-16 00:00:00'")

_BANDS_UNION = " UNION ALL ".join(
    f"SELECT {{cols}}, {k} AS band_no, {BAND('simhash', k)} AS band FROM {{src}}" for k in range(4))


def _banded(src: str, cols: str) -> str:
    return _BANDS_UNION.format(cols=cols, src=src)


cte("ex_bands", ["existing_c"], _banded("(SELECT DISTINCT simhash FROM existing_c)", "simhash"))
cte("inc_bands", ["incoming_c"], _banded("incoming_c", "id, url, simhash"))

cte("dup_urls", ["ex_bands", "inc_bands"], """
SELECT DISTINCT i.id, i.url FROM inc_bands i JOIN ex_bands e
  ON i.band_no = e.band_no AND i.band = e.band
WHERE 1.0 - bit_count(xor(i.simhash, e.simhash)) / 64.0 > 0.6""")

sql("doc_simhash", ["doc_fp"], "SELECT id AS doc_id, simhash FROM doc_fp")

sql("simhash_bands", ["doc_fp"], f"""
SELECT id AS doc_id, {UNSIGNED('simhash')} AS simhash_text,
       {BAND('simhash', 0)} AS simhash_1, {BAND('simhash', 1)} AS simhash_2,
       {BAND('simhash', 2)} AS simhash_3, {BAND('simhash', 3)} AS simhash_4
FROM doc_fp""")

sql("near_dup_urls", ["dup_urls"], "SELECT id, url FROM dup_urls")

sql("dedup_content", ["incoming_c", "dup_urls"], """
SELECT id, url FROM incoming_c WHERE url NOT IN (SELECT url FROM dup_urls)""")

sql("near_dup_candidates", ["incoming_c", "existing_c"], f"""SELECT * FROM (
WITH eb AS ({_banded('existing_c', 'simhash')}),
     ib AS ({_banded('incoming_c', 'id, url, simhash')}),
     cnt AS (SELECT band_no, band, count(*) AS n_band FROM eb GROUP BY band_no, band),
     ex AS (SELECT simhash, count(*) AS n_exact FROM existing_c GROUP BY simhash)
SELECT h.id, h.url, h.band_hits, CAST(coalesce(ex.n_exact, 0) AS BIGINT) AS exact_hits
FROM (SELECT ib.id, ib.url, ib.simhash, CAST(sum(coalesce(cnt.n_band, 0)) AS BIGINT) AS band_hits
      FROM ib LEFT JOIN cnt ON cnt.band_no = ib.band_no AND cnt.band = ib.band
      GROUP BY ib.id, ib.url, ib.simhash) h
LEFT JOIN ex ON ex.simhash = h.simhash) z""")

_SIMILAR = "1.0 - bit_count(xor(i.simhash, e.simhash)) / 64.0 > 0.6"
sql("near_dup_incremental", ["incoming_c", "existing_c"], f"""SELECT * FROM (
WITH parts AS (SELECT *, CASE WHEN scraped_at < TIMESTAMP '2024-01-24 00:00:00' THEN 1 ELSE 2 END AS batch FROM incoming_c),
     ib AS ({_banded('parts', 'batch, id, url, simhash')}),
     eb AS ({_banded('existing_c', 'simhash')}),
     d0 AS (SELECT DISTINCT i.batch, i.id, i.url FROM ib i JOIN eb e ON i.band_no = e.band_no AND i.band = e.band WHERE {_SIMILAR}),
     kept AS (SELECT * FROM ib WHERE batch = 1 AND url NOT IN (SELECT url FROM d0 WHERE batch = 1)),
     d1 AS (SELECT DISTINCT i.batch, i.id, i.url FROM ib i JOIN kept e ON i.band_no = e.band_no AND i.band = e.band WHERE i.batch = 2 AND {_SIMILAR})
SELECT batch, id, url FROM d0 UNION SELECT batch, id, url FROM d1) z""")

sql("near_copy_groups", ["incoming_c", "inc_bands"], f"""
SELECT * FROM (
WITH RECURSIVE links AS MATERIALIZED (SELECT DISTINCT i.simhash AS a, e.simhash AS b FROM (SELECT DISTINCT simhash, band_no, band FROM inc_bands) i
                JOIN (SELECT DISTINCT simhash, band_no, band FROM inc_bands) e ON i.band_no = e.band_no AND i.band = e.band WHERE {_SIMILAR}),
     reach(node, other) AS (SELECT a, b FROM links UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
     least AS (SELECT r.node, min(c.id) AS group_id FROM reach r JOIN incoming_c c ON c.simhash = r.other GROUP BY r.node)
SELECT c.id, c.url, l.group_id FROM incoming_c c JOIN least l ON l.node = c.simhash) z""")

sql("simhash_groups", ["existing_c"], """
SELECT simhash, CAST(count(url) AS BIGINT) AS n_urls, min(url) AS first_url FROM existing_c GROUP BY simhash""")

# ---- pages -------------------------------------------------------------------
cte("pages_ok", [], f"""
SELECT page_id, url, {sql_title('html')} AS title, {sql_chunks('html')} AS chunks
FROM pages WHERE NOT {sql_is_ignored('url')}""")

cte("pages_txt", ["pages_ok"], "SELECT page_id, url, title, chunks, array_to_string(chunks, chr(10)) AS text FROM pages_ok")
sql_simhash_cte("page_fp", "pages_txt", "page_id", "text", ["pages_txt"])

sql("crawl_pages", ["pages_ok"], f"SELECT page_id, url, title, {J('chunks')} AS chunks FROM pages_ok")

sql("page_chunks", [], f"""
SELECT page_id, {sql_title('html')} AS title, CAST(len({sql_chunks('html')}) AS BIGINT) AS n_chunks,
       {J(sql_chunks('html'))} AS chunks FROM pages""")

# sections, BM25 by joining words with the title's, and the lines of those that stay
cte("page_parts", [], f"""
SELECT page_id, title, CASE WHEN instr(t, chr(30)) > 0
         THEN list_filter(list_transform(string_split(t, chr(30)), lambda s: {sql_lines('s')}), lambda p: len(p) > 0)
         ELSE list_transform({sql_lines('t')}, lambda p: [p]) END AS parts
FROM (SELECT page_id, {sql_title('html')} AS title, {sql_body_text('html', True)} AS t FROM pages)""")
cte("page_section", ["page_parts"], """
SELECT page_id, unnest(parts) AS lines, unnest(range(len(parts))) AS i FROM page_parts""")
cte("section_word", ["page_section"], f"""
SELECT page_id, i, unnest(regexp_extract_all(lower(array_to_string(lines, chr(10))), {q(_T.WORD)})) AS w FROM page_section""")
cte("title_word", ["page_parts"], f"""
SELECT DISTINCT page_id, unnest(regexp_extract_all(lower(title), {q(_T.WORD)})) AS w FROM page_parts""")
cte("section_score", ["page_section", "section_word", "title_word"], f"""SELECT * FROM (
WITH sizes AS (SELECT s.page_id, s.i, count(w) AS n FROM page_section s LEFT JOIN section_word x ON x.page_id = s.page_id AND x.i = s.i GROUP BY ALL),
     means AS (SELECT page_id, count(*) AS sections, sum(n) / count(*) AS mean FROM sizes GROUP BY page_id),
     tfs AS (SELECT page_id, i, w, count(*) AS tf FROM section_word SEMI JOIN title_word USING (page_id, w) GROUP BY ALL),
     idfs AS (SELECT page_id, w, ln(1.0 + (sections - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tfs JOIN means USING (page_id) GROUP BY page_id, w, sections),
     sums AS (SELECT page_id, i, sum(idf * tf * ({_T.BM25_K1} + 1) / (tf + {_T.BM25_K1} * ({1 - _T.BM25_B}::DOUBLE + {_T.BM25_B}::DOUBLE * n / mean))) AS score
              FROM tfs JOIN idfs USING (page_id, w) JOIN means USING (page_id) JOIN sizes USING (page_id, i) GROUP BY page_id, i)
SELECT s.page_id, s.i, s.lines, round(coalesce(score, 0.0::DOUBLE), 9) AS score FROM page_section s LEFT JOIN sums USING (page_id, i)) z""")
cte("relevant", ["page_parts", "section_score"], f"""SELECT * FROM (
WITH best AS (SELECT page_id, max(score) AS best, count(*) AS n_sections, count(*) FILTER (score > 0) AS n_scored FROM section_score GROUP BY page_id)
SELECT p.page_id, p.title, coalesce(any_value(b.n_sections), 0) AS n_sections, coalesce(any_value(b.n_scored), 0) AS n_scored, any_value(b.best) AS best,
       coalesce(flatten(list(s.lines ORDER BY s.i) FILTER (s.score >= {_T.SECTION_SHARE} * b.best)), CAST([] AS VARCHAR[])) AS chunks
FROM page_parts p LEFT JOIN best b USING (page_id) LEFT JOIN section_score s USING (page_id) GROUP BY p.page_id, p.title) z""")
sql("relevant_sections", ["relevant"], f"SELECT page_id, title, n_sections, n_scored, {R('best')} AS best, {J('chunks')} AS chunks FROM relevant")

cte("ingested", ["pages_txt", "page_fp", "doc_fp_full", "relevant"], f"""SELECT * FROM (
WITH inc AS (SELECT p.page_id AS id, p.url, p.title, r.chunks, f.simhash FROM pages_txt p JOIN page_fp f ON f.id = p.page_id JOIN relevant r ON r.page_id = p.page_id
             WHERE p.url NOT IN (SELECT url FROM doc_fp_full)),
     eb AS ({_banded('(SELECT DISTINCT simhash FROM doc_fp_full)', 'simhash')}),
     ib AS ({_banded('inc', 'id, url, simhash')}),
     dup AS (SELECT DISTINCT ib.url FROM ib JOIN eb ON ib.band_no = eb.band_no AND ib.band = eb.band
             WHERE 1.0 - bit_count(xor(ib.simhash, eb.simhash)) / 64.0 > 0.6),
     kept AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS rn FROM inc WHERE url NOT IN (SELECT url FROM dup))
SELECT url, string_split(url, '/')[3] AS hostname, title, {UNSIGNED('simhash')} AS simhash,
       {BAND('simhash', 0)} AS simhash_1, {BAND('simhash', 1)} AS simhash_2,
       {BAND('simhash', 2)} AS simhash_3, {BAND('simhash', 3)} AS simhash_4,
       {J('chunks')} AS chunks, {S(AS_OF)} AS scraped_at, 1 AS pipeline_state
FROM kept WHERE rn = 1) z""")

sql("content_ingest", ["ingested"], "SELECT * FROM ingested")


# ---- more SQL builders --------------------------------------------------------
from .. import schemas as _SC  # noqa: E402
from ..functions import urls as _U  # noqa: E402

PY = _T.PY_SPACE


def sql_hostname(u: str) -> str:
    hi = f"regexp_replace({sql_netloc(u)}, '^.*@', '')"
    h = (f"lower(CASE WHEN starts_with({hi}, '[') THEN regexp_extract({hi}, {q(r'^\[([^\]]*)\]')}, 1)"
         f" ELSE regexp_replace({hi}, ':.*$', '') END)")
    return f"nullif({h}, '')"


def sql_dec(x: str) -> str:
    return f"url_decode(replace({x}, '+', ' '))"


def sql_enc(x: str) -> str:
    return f"replace(url_encode({x}), '%20', '+')"


def sql_canonical_query(qry: str) -> str:
    tracking = ", ".join(q(t) for t in _K.TRACKING_PARAMS)
    kept = f"list_filter(string_split({qry}, '&'), lambda p: instr(p, '=') > 0 AND length(p) > instr(p, '='))"
    dec = (f"list_transform({kept}, lambda p: struct_pack(k := {sql_dec('split_part(p, ' + q('=') + ', 1)')},"
           f" v := {sql_dec('substr(p, instr(p, ' + q('=') + ') + 1)')}))")
    useful = f"list_filter({dec}, lambda kv: lower(kv.k) NOT IN ({tracking}))"
    enc = f"list_transform({useful}, lambda kv: {sql_enc('kv.k')} || '=' || {sql_enc('kv.v')})"
    return f"array_to_string({enc}, '&')"


def sql_canonical_from(src: str, url_col: str) -> str:
    """Subquery over ``src`` adding ``canonical`` for ``url_col``."""
    schemes = ", ".join(q(x) for x in _U._NETLOC_SCHEMES)
    return f"""(SELECT *, _prefix || _auth || _path2 || CASE WHEN _q <> '' THEN '?' || _q ELSE '' END AS canonical
FROM (SELECT *, CASE WHEN _netloc <> '' OR (_scheme IN ({schemes}) AND starts_with(_path2, '/'))
                     THEN '//' || _netloc ELSE '' END AS _auth,
             CASE WHEN _scheme <> '' THEN _scheme || ':' ELSE '' END AS _prefix
      FROM (SELECT *, CASE WHEN _netloc <> '' AND NOT starts_with(_path1, '/') THEN '/' || _path1 ELSE _path1 END AS _path2
            FROM (SELECT *, CASE WHEN _p0 = '' THEN '/' ELSE _p0 END AS _path1
                  FROM (SELECT *, {sql_scheme(url_col)} AS _scheme, {sql_netloc(url_col)} AS _netloc,
                               regexp_replace({sql_path(url_col)}, '/+$', '') AS _p0,
                               {sql_canonical_query(sql_query(url_col))} AS _q
                        FROM {src}) c0) c1) c2) c3) c4"""


def sql_resolve(base: str, href: str) -> str:
    origin = f"regexp_extract({base}, {q(URL_RE)}, 2) || '://' || {sql_netloc(base)}"
    bpath = sql_path(base)
    bdir = f"regexp_replace({bpath}, '[^/]*$', '')"
    bdir = f"CASE WHEN {bdir} = '' THEN '/' ELSE {bdir} END"
    nofrag = f"regexp_replace({base}, '#.*$', '')"
    return (f"CASE WHEN regexp_matches({href}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {href}"
            f" WHEN starts_with({href}, '//') THEN regexp_extract({base}, {q(URL_RE)}, 2) || ':' || {href}"
            f" WHEN starts_with({href}, '/') THEN {origin} || {href}"
            f" WHEN {href} = '' THEN {base}"
            f" WHEN starts_with({href}, '#') THEN {nofrag} || {href}"
            f" WHEN starts_with({href}, '?') THEN {origin} || {bpath} || {href}"
            f" ELSE {origin} || {bdir} || {href} END")


def sql_same_site(h: str, b: str) -> str:
    return f"({h} = {b} OR {h} = 'www.' || {b} OR {b} = 'www.' || {h})"


def sql_strip(x: str) -> str:
    return f"regexp_replace({x}, {q('^' + PY + '+|' + PY + '+$')}, '', 'g')"


def sql_key(x: str) -> str:
    return f"lower({sql_strip(x)})"


def sql_normalize(lst: str) -> str:
    ks = f"list_filter(list_transform({lst}, lambda t: {sql_key('t')}), lambda t: t <> '')"
    return f"list_filter({ks}, lambda x, i: list_position({ks}, x) = i)"


def sql_ignored_tag(t: str) -> str:
    tags = ", ".join(q(x) for x in _K.IGNORE_TAGS)
    k = sql_key(t)
    return f"({k} = '' OR length({k}) > {_K.MAX_TAG_LEN} OR {k} IN ({tags}))"


def sql_filter_tags(lst: str) -> str:
    keys = f"list_transform({lst}, lambda t: {sql_key('t')})"
    return (f"list_filter({lst}, lambda t, i: NOT {sql_ignored_tag('t')}"
            f" AND NOT list_contains(list_slice({keys}, 1, i - 1), {sql_key('t')}))")


def sql_thin_reason(text: str) -> str:
    st = sql_strip(text)
    lines = f"list_filter(regexp_split_to_array({st}, {q(_T.LINE_BREAKS)}), lambda s: {sql_strip('s')} <> '')"
    n_lines = f"CASE WHEN {st} = '' THEN 0 ELSE len({lines}) END"
    n_chars = f"length({st})"
    msg = ("printf('content too thin to analyse: %d non-empty line(s), %d char(s) "
           f"(need >= {_K.MIN_CONTENT_LINES} lines and >= {_K.MIN_CONTENT_CHARS} chars)', {n_lines}, {n_chars})")
    return f"CASE WHEN {n_chars} < {_K.MIN_CONTENT_CHARS} OR {n_lines} < {_K.MIN_CONTENT_LINES} THEN {msg} END"


def sql_prompt(text: str, title: str, url: str) -> str:
    body0 = sql_strip(text)
    cut = f"regexp_replace(substr({body0}, 1, {_K.MAX_INPUT_CHARS}), {q(PY + '+$')}, '')"
    body = f"CASE WHEN length({body0}) > {_K.MAX_INPUT_CHARS} THEN {cut} || {q(_K.TRUNCATION_MARK)} ELSE {body0} END"
    ht = f"CASE WHEN {title} IS NOT NULL AND {title} <> '' THEN 'Title: ' || {sql_strip(title)} END"
    hu = f"CASE WHEN {url} IS NOT NULL AND {url} <> '' THEN 'URL: ' || {sql_strip(url)} END"
    return f"concat_ws(chr(10), {ht}, {hu}, 'Content:' || chr(10) || {body})"


JOIN2 = "chr(10) || chr(10)"

# ---- URLs and links ---------------------------------------------------------
sql("url_parts", ["url_t"], f"""
SELECT p.page_id, {sql_scheme('p.url')} AS scheme, {sql_netloc('p.url')} AS netloc, {sql_path('p.url')} AS path,
       {sql_query('p.url')} AS query, regexp_extract(p.url, {q(URL_RE)}, 9) AS fragment, u.hostname
FROM pages p JOIN url_t u ON u.id = p.page_id""")

sql("canonicalize_url", [], f"SELECT page_id, url, canonical FROM {sql_canonical_from('pages', 'url')}")

sql("is_ignored_url", [], f"SELECT page_id, url, {sql_is_ignored('url')} AS ignored FROM pages")

def sql_hrefs(html: str) -> str:
    """Link targets of a page: comments and raw text dropped, tags cut at the
    first '>', the attribute picked from each tag, quotes removed."""
    t = f"regexp_replace({html}, '(?is)<!--.*?-->', ' ', 'g')"
    for tag in ("script", "style", "textarea", "title"):
        t = f"regexp_replace({t}, {q(rf'(?is)<{tag}[^>]*>.*?</{tag}[^>]*>')}, '', 'g')"
    attr = q(r"""(?is)[\s"'/]href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*)""")
    tags = f"list_filter(regexp_extract_all({t}, {q('(?is)<a[' + chr(92) + 's/][^>]*>')}), lambda x: regexp_matches(x, {attr}))"
    raw = f"list_transform({tags}, lambda x: regexp_extract(x, {attr}, 1))"
    bare = f"list_transform({raw}, lambda x: CASE WHEN x[1] IN (chr(34), chr(39)) THEN substr(x, 2, length(x) - 2) ELSE x END)"
    plain = "x"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&nbsp;", chr(160)), ("&amp;", "&")):
        plain = f"replace({plain}, {q(a)}, {q(b)})"
    return f"list_transform({bare}, lambda x: {plain})"


cte("hrefs_t", ["url_t"], f"""
SELECT page_id, base, host, href, pos FROM (
  SELECT page_id, base, host, unnest(l) AS href, unnest(range(len(l))) AS pos
  FROM (SELECT p.page_id, p.url AS base, u.hostname AS host, {sql_hrefs('p.html')} AS l
        FROM pages p JOIN url_t u ON u.id = p.page_id) h0) h1
WHERE href <> ''""")

cte("links_t", ["hrefs_t"], f"""
SELECT page_id, base, host, pos, href, regexp_replace({sql_resolve('base', 'href')}, '#.*$', '') AS link FROM hrefs_t""")

cte("extracted", ["links_t"], f"""
SELECT page_id, link, min(pos) AS first_pos FROM links_t
WHERE {sql_scheme('link')} IN ('http', 'https') AND {sql_hostname('link')} IS NOT NULL
  AND {sql_same_site(sql_hostname('link'), 'host')}
  AND regexp_replace(link, '/+$', '') <> regexp_replace(base, '/+$', '')
GROUP BY page_id, link""")

sql("extract_links", ["extracted"], "SELECT page_id, link, first_pos FROM extracted")

sql("filter_links", ["extracted"], f"""
SELECT page_id, canonical, min(first_pos) AS first_pos
FROM {sql_canonical_from("(SELECT e.*, " + sql_netloc('p.url') + " AS base_host FROM extracted e JOIN pages p ON p.page_id = e.page_id)", 'link')}
WHERE {sql_netloc('canonical')} = base_host AND NOT {sql_is_ignored('canonical')}
GROUP BY page_id, canonical""")

sql("crawl_scope", ["hrefs_t"], f"""
SELECT page_id, pos, absolute,
       (starts_with(absolute, base) AND NOT (lower(absolute) = lower(base) OR starts_with(lower(absolute), lower(base) || '#'))
        AND NOT regexp_matches(absolute, {q(_K.CRAWL_EXCLUDE_PATTERN)})) AS in_scope
FROM (SELECT page_id, pos, base, {sql_resolve('base', 'href')} AS absolute FROM hrefs_t) s""")

cte("due_src", ["url_t"], f"SELECT * FROM url_t WHERE kind = 'source' AND next_crawl_at <= {AS_OF}")

cte("url_r", ["url_t"], f"""
SELECT * FROM url_t
UNION ALL BY NAME
SELECT -1 - first_id AS id, root AS url, hostname, 1 AS crawl_state, 'source' AS kind, root AS source,
       {AS_OF} - to_minutes(1) AS next_crawl_at, CASE WHEN first_id % 2 = 0 THEN -1 ELSE 1099511627776 END AS sequence
FROM (SELECT hostname, 'https://' || hostname || '/' AS root, min(id) AS first_id FROM url_t WHERE hostname IS NOT NULL GROUP BY hostname) g
WHERE root NOT IN (SELECT url FROM url_t)""")

cte("due_src_r", ["url_r"], f"SELECT * FROM url_r WHERE kind = 'source' AND next_crawl_at <= {AS_OF}")

cte("src_links", ["due_src_r"], f"""
SELECT page_id, link, source, source_seq FROM (
  SELECT page_id, base, host, source, source_seq,
         regexp_replace({sql_resolve('base', 'href')}, '#.*$', '') AS link
  FROM (SELECT page_id, base, host, source, source_seq, unnest(l) AS href
        FROM (SELECT d.id AS page_id, d.url AS base, d.hostname AS host, d.url AS source, d.sequence AS source_seq,
                     {sql_hrefs('p.html')} AS l
              FROM due_src_r d JOIN pages p ON p.page_id = d.id) s0) s1
  WHERE href <> '') s2
WHERE {sql_scheme('link')} IN ('http', 'https') AND {sql_hostname('link')} IS NOT NULL
  AND {sql_same_site(sql_hostname('link'), 'host')}
  AND regexp_replace(link, '/+$', '') <> regexp_replace(base, '/+$', '')""")

cte("new_url_rows", ["src_links", "url_r"], f"""
SELECT url, {sql_hostname('url')} AS hostname, 1 AS crawl_state, 'url' AS kind, source, {AS_OF} AS next_crawl_at
FROM (SELECT link AS url, arg_min(source, source_seq) AS source FROM src_links GROUP BY link) g
WHERE url NOT IN (SELECT url FROM url_r) AND {sql_hostname('url')} IS NOT NULL""")

sql("create_source_urls", ["new_url_rows"], f"""
SELECT url, hostname, crawl_state, kind, source, {S('next_crawl_at')} AS next_crawl_at FROM new_url_rows""")

sql("apply_defaults", ["new_url_rows"], f"""
SELECT url, hostname, crawl_state, CAST(0 AS BIGINT) AS retry_count, 0.0::DOUBLE AS priority_score,
       CAST(0 AS BIGINT) AS depth, kind, source, {S('next_crawl_at')} AS next_crawl_at,
       CAST(NULL AS VARCHAR) AS last_crawl_at, CAST(NULL AS VARCHAR) AS crawl_run_id
FROM new_url_rows""")

sql("discover_sources", ["url_r", "due_src_r"], f"""
SELECT u.id,
       CASE WHEN d.id IS NULL THEN u.crawl_state WHEN p.page_id IS NULL THEN 4 ELSE 3 END AS crawl_state,
       {S(f"CASE WHEN d.id IS NULL THEN u.next_crawl_at WHEN p.page_id IS NULL THEN {AS_OF} ELSE {AS_OF} + to_seconds({_K.SOURCE_REFRESH_SECONDS}) END")} AS next_crawl_at,
       d.id IS NOT NULL AS applied
FROM url_r u LEFT JOIN due_src_r d ON d.id = u.id LEFT JOIN (SELECT DISTINCT page_id FROM pages) p ON p.page_id = u.id""")

sql("bump_sources", ["url_t", "due_src"], f"""
SELECT u.id,
       {S(f"CASE WHEN d.id IS NOT NULL THEN {AS_OF} + to_seconds({_K.SOURCE_REFRESH_SECONDS}) ELSE u.next_crawl_at END")} AS next_crawl_at,
       d.id IS NOT NULL AS applied
FROM url_t u LEFT JOIN due_src d ON d.id = u.id""")

# ---- frontier ----------------------------------------------------------------
def frontier_ctes(urls: str, suffix: str = "") -> None:
    """Queue, due hosts, heads and claims over a table of URLs."""
    cte(f"front{suffix}", [urls], f"""
SELECT *, 0 AS branch FROM {urls} WHERE kind = 'source' AND next_crawl_at <= {AS_OF}
UNION ALL
SELECT *, 1 AS branch FROM {urls} WHERE kind <> 'source' AND next_crawl_at <= {AS_OF} AND crawl_state IN (1, 4, 2)""")

    cte(f"sched{suffix}", [f"front{suffix}", "host_t"], f"""
SELECT id, name, coalesce(next_allowed_at, {AS_OF}) AS next_allowed_at FROM host_t
WHERE name IN (SELECT hostname FROM front{suffix}) AND coalesce(next_allowed_at, {AS_OF}) <= {AS_OF}""")

    cte(f"heads{suffix}", [f"front{suffix}", f"sched{suffix}"], f"""
SELECT f.hostname, f.id, f.url, f.kind, s.next_allowed_at FROM (
  SELECT *, row_number() OVER (PARTITION BY hostname ORDER BY branch, sequence) AS rn FROM front{suffix}) f
JOIN sched{suffix} s ON s.name = f.hostname WHERE f.rn = 1""")

    cte(f"claimed{suffix}", [urls, f"heads{suffix}"], f"""
SELECT u.*, (h.id IS NOT NULL AND u.next_crawl_at <= {AS_OF} AND (u.kind = 'source' OR u.crawl_state IN (1, 4, 2))) AS applied
FROM {urls} u LEFT JOIN heads{suffix} h ON h.id = u.id""")


frontier_ctes("url_t")
frontier_ctes("url_r", "_r")

cte("claimed2", ["claimed"], f"""
SELECT * REPLACE (CASE WHEN applied THEN 2 ELSE crawl_state END AS crawl_state,
                  CASE WHEN applied THEN {AS_OF} + to_seconds({_K.CLAIM_LEASE_SECONDS}) ELSE next_crawl_at END AS next_crawl_at)
FROM claimed""")

cte("outcomes", ["claimed2"], f"""
SELECT id, hostname, NOT {sql_is_ignored('url')} AS success FROM claimed2 WHERE applied""")

sql("front_queue", ["front"], "SELECT id, url, hostname, kind, crawl_state, branch, sequence FROM front")

sql("back_queue", ["front"], """
SELECT hostname, row_number() OVER (PARTITION BY hostname ORDER BY branch, sequence) AS pos, id, url FROM front""")

sql("scheduler_queue", ["sched"], f"SELECT id, name, {S('next_allowed_at')} AS next_allowed_at FROM sched")

sql("due_host_heads", ["heads"], f"SELECT hostname, id, url, kind, {S('next_allowed_at')} AS next_allowed_at FROM heads")

sql("queue_sizes", ["front"], """
SELECT count(*) AS n_items, count(DISTINCT hostname) AS n_hosts,
       CAST(sum(CASE WHEN kind = 'source' THEN 1 ELSE 0 END) AS BIGINT) AS n_sources,
       CAST(sum(CASE WHEN kind <> 'source' THEN 1 ELSE 0 END) AS BIGINT) AS n_pages FROM front""")

sql("lease_hostnames", ["host_t", "sched"], f"""
SELECT h.id, {S(f"CASE WHEN s.id IS NOT NULL AND coalesce(h.next_allowed_at, {AS_OF}) <= {AS_OF} THEN {AS_OF} + to_seconds({_K.HOSTNAME_LEASE_SECONDS}) ELSE h.next_allowed_at END")} AS next_allowed_at,
       (s.id IS NOT NULL AND coalesce(h.next_allowed_at, {AS_OF}) <= {AS_OF}) AS applied
FROM host_t h LEFT JOIN sched s ON s.id = h.id""")

sql("claim_urls", ["claimed2"], f"SELECT id, crawl_state, {S('next_crawl_at')} AS next_crawl_at, applied FROM claimed2")

sql("apply_crawl_outcomes", ["claimed2", "outcomes"], f"""
SELECT c.id,
       CASE WHEN o.id IS NULL THEN c.crawl_state WHEN o.success THEN 3 ELSE 4 END AS crawl_state,
       {S(f"CASE WHEN o.id IS NOT NULL AND NOT o.success THEN {AS_OF} ELSE c.next_crawl_at END")} AS next_crawl_at,
       o.id IS NOT NULL AS applied
FROM claimed2 c LEFT JOIN outcomes o ON o.id = c.id""")

sql("claim_stored_urls", ["claimed2", "outcomes"], f"""
SELECT c.id, c.hostname,
       CASE WHEN o.id IS NULL THEN c.crawl_state WHEN o.success THEN 3 ELSE 4 END AS crawl_state,
       {S(f"CASE WHEN o.id IS NOT NULL AND NOT o.success THEN {AS_OF} ELSE c.next_crawl_at END")} AS next_crawl_at
FROM claimed2 c LEFT JOIN outcomes o ON o.id = c.id""")

sql("hostname_stats", ["host_t", "outcomes"], f"""
SELECT h.name, h.crawl_count + coalesce(o.ok, 0) AS crawl_count, h.success_count + coalesce(o.ok, 0) AS success_count,
       h.failure_count + coalesce(o.err, 0) AS failure_count,
       {S(f"CASE WHEN o.hostname IS NOT NULL THEN {AS_OF} ELSE h.last_crawled_at END")} AS last_crawled_at,
       {S(f"CASE WHEN o.hostname IS NOT NULL THEN coalesce(h.next_allowed_at, {AS_OF}) + to_seconds({_K.HOST_COOLDOWN_SECONDS} * (o.ok + o.err)) ELSE h.next_allowed_at END")} AS next_allowed_at,
       o.hostname IS NOT NULL AS applied
FROM host_t h LEFT JOIN (SELECT hostname, CAST(sum(CASE WHEN success THEN 1 ELSE 0 END) AS BIGINT) AS ok,
                                CAST(sum(CASE WHEN success THEN 0 ELSE 1 END) AS BIGINT) AS err
                         FROM outcomes GROUP BY hostname) o ON o.hostname = h.name""")

sql("retry_source", ["url_t", "host_t"], f"""
WITH_REQ
SELECT u.id, CASE WHEN r THEN 1 ELSE u.crawl_state END AS crawl_state,
       {S(f"CASE WHEN r THEN {AS_OF} ELSE u.next_crawl_at END")} AS next_crawl_at, r AS applied,
       {S(f"CASE WHEN h.hit THEN {AS_OF} ELSE h.next_allowed_at END")} AS host_next_allowed_at
FROM (SELECT *, crawl_state IN (4, 5) AS r FROM url_t) u
LEFT JOIN (SELECT name, next_allowed_at, name IN (SELECT hostname FROM url_t WHERE crawl_state IN (4, 5)) AS hit
           FROM host_t) h ON h.name = u.hostname""".replace("WITH_REQ\n", ""))

sql("patch_source", ["url_t"], f"""
SELECT id,
       CASE WHEN sp THEN 1.0::DOUBLE ELSE priority_score END AS priority_score,
       CASE WHEN ss THEN 1 ELSE crawl_state END AS crawl_state,
       {S(f"CASE WHEN ss THEN {AS_OF} ELSE next_crawl_at END")} AS next_crawl_at,
       (sp OR ss) AS applied
FROM (SELECT *, kind = 'source' AS sp, (kind <> 'source' AND crawl_state = 6) AS ss FROM url_t) u""")

sql("patch_rejected", ["url_t"], """
SELECT id, 'No fields to update' AS reason FROM url_t WHERE kind <> 'source' AND crawl_state = 5
UNION ALL SELECT -1 - id, 'No such URL' FROM url_t WHERE kind <> 'source' AND crawl_state = 6
UNION ALL SELECT id, 'An earlier request for this URL wins' FROM url_t WHERE kind = 'source'""")

# ---- content pipeline -----------------------------------------------------------
cte("cqueue", ["content"], f"""
SELECT * FROM content WHERE pipeline_state = 1""")

sql("content_queue", ["cqueue"], f"SELECT id, url, {S('scraped_at')} AS scraped_at FROM cqueue")

sql("claim_content", ["content", "cqueue"], """
SELECT c.id, CASE WHEN q.id IS NOT NULL AND c.pipeline_state = 1 THEN 3 ELSE c.pipeline_state END AS pipeline_state,
       (q.id IS NOT NULL AND c.pipeline_state = 1) AS applied
FROM content c LEFT JOIN cqueue q ON q.id = c.id""")

sql("thin_content", ["content"], f"SELECT id, {sql_thin_reason(f'array_to_string(chunks, {JOIN2})')} AS reason FROM content")

sql("build_enrich_input", ["content"], f"""
SELECT id, {sql_prompt(f'array_to_string(chunks, {JOIN2})', 'title', 'url')} AS prompt FROM content""")

cte("raw_tags", ["content"], """
SELECT id, list_concat(string_split(split_part(text, chr(10), 1), ' '), list_transform(tags, lambda t: upper(t))) AS raw
FROM content""")

sql("normalize_tags", ["raw_tags"], f"SELECT id, {J(sql_normalize('raw'))} AS tags FROM raw_tags")
sql("filter_tags", ["raw_tags"], f"SELECT id, {J(sql_filter_tags('raw'))} AS tags FROM raw_tags")
sql("finalize_tags", ["raw_tags"], f"""
SELECT id, {J(f"list_slice({sql_filter_tags('n')}, 1, {_K.MAX_TAGS})")} AS tags
FROM (SELECT id, {sql_normalize('raw')} AS n FROM raw_tags) z""")
sql("finalize_tags_allowed", ["raw_tags", "content"], f"""
SELECT id, {J(f"list_slice(CASE WHEN len(a) > 0 THEN list_filter(n, lambda t: list_contains(a, t)) ELSE {sql_filter_tags('n')} END, 1, {_K.MAX_TAGS})")} AS tags
FROM (SELECT t.id, {sql_normalize('t.raw')} AS n, {sql_normalize("list_concat(list_transform(list_slice(c.tags, 1, 2), lambda x: ' ' || upper(x)), [split_part(c.title, ' ', 1)])")} AS a
      FROM raw_tags t JOIN content c ON c.id = t.id) z""")
sql("is_ignored_tag", ["raw_tags"], f"""
SELECT tag, {sql_ignored_tag('tag')} AS ignored FROM (SELECT DISTINCT unnest(raw) AS tag FROM raw_tags) z""")

VOCAB = sql_normalize("string_split(replace(text, chr(10), ','), ',')")
sql("parse_vocabulary", [], f"SELECT item_id, {J(VOCAB)} AS vocabulary FROM benchmark")
sql("tag_field_names", [], f"""
SELECT item_id, idx, tag,
       CASE WHEN slug = '' THEN 'tag_' || CAST(idx AS VARCHAR) ELSE 'tag_' || CAST(idx AS VARCHAR) || '_' || slug END AS field
FROM (SELECT *, regexp_replace(regexp_replace(lower(tag), '[^0-9a-z]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug
      FROM (SELECT item_id, unnest(v) AS tag, unnest(range(len(v))) AS idx
            FROM (SELECT item_id, {VOCAB} AS v FROM benchmark) a) b) c""")

cte("gcases", ["content"], f"""
SELECT id, CASE WHEN id % 2 = 0 THEN list_slice(tags, 1, CASE WHEN id % 4 = 2 THEN 3 ELSE 2 END) ELSE CAST([] AS VARCHAR[]) END AS allowed_tags,
       CASE WHEN err IS NULL THEN title ELSE '' END AS summary,
       CASE WHEN err IS NULL THEN tags ELSE CAST([] AS VARCHAR[]) END AS tags,
       err AS error,
       CASE WHEN quality = 0 THEN 'ThinContentError' END AS expect_error,
       [hostname] AS expected_tags,
       CASE WHEN toxic = 1 THEN ['t0'] ELSE CAST([] AS VARCHAR[]) END AS forbidden_tags,
       [lower(split_part(title, ' ', 1))] AS keywords,
       8 AS min_summary_words,
       toxic = 1 AS expect_empty_tags
FROM (SELECT c.*, l.quality, l.toxic,
             CASE WHEN {sql_thin_reason(f'array_to_string(c.chunks, {JOIN2})')} IS NOT NULL THEN 'ThinContentError' END AS err
      FROM content c JOIN labels l ON l.doc_id = c.id) z""")

_WORDS = f"len(list_filter(regexp_split_to_array(coalesce(summary, ''), {q(PY + '+')}), lambda w: w <> ''))"
cte("graded", ["gcases"], f"""
SELECT id,
  error IS NOT DISTINCT FROM expect_error AS error_expectation,
  (coalesce(expect_error, '') <> '' OR {_WORDS} >= min_summary_words) AS summary_has_substance,
  (len({sql_normalize('allowed_tags')}) = 0 OR len(list_filter(tags, lambda t: NOT list_contains({sql_normalize('allowed_tags')}, t))) = 0) AS tags_subset_of_allowed,
  (tags = {sql_normalize('tags')}) AS tags_well_formed,
  (len({sql_normalize('expected_tags')}) = 0 OR len(list_filter(tags, lambda t: list_contains({sql_normalize('expected_tags')}, t))) > 0) AS expected_tag_present,
  (len({sql_normalize('forbidden_tags')}) = 0 OR len(list_filter(tags, lambda t: list_contains({sql_normalize('forbidden_tags')}, t))) = 0) AS forbidden_tag_absent,
  (len(keywords) = 0 OR len(list_filter(keywords, lambda k: contains(lower(coalesce(summary, '')), lower(k)))) > 0) AS summary_mentions_keyword,
  (NOT coalesce(expect_empty_tags, false) OR len(tags) = 0) AS tags_empty_when_nothing_applies
FROM gcases""")

sql("grade_enrichment", ["graded"], "SELECT * FROM graded")

_PASSED = " + ".join(f"CAST({g} AS INTEGER)" for g in [
    "error_expectation", "summary_has_substance", "tags_subset_of_allowed", "tags_well_formed",
    "expected_tag_present", "forbidden_tag_absent", "summary_mentions_keyword", "tags_empty_when_nothing_applies"])
sql("enrichment_pass_rate", ["graded"], f"""
SELECT count(*) AS n_cases, count(*) * 8 AS n_assertions, CAST(sum({_PASSED}) AS BIGINT) AS n_passed,
       {R(f"sum({_PASSED}) / (count(*) * 8.0)")} AS pass_rate FROM graded""")

# ---- enrichment by the keyword model ----------------------------------------------
def sql_body(text: str) -> str:
    """What the model sees after the header lines."""
    return f"regexp_extract({sql_prompt(text, 'NULL', 'NULL')}, {q('(?s)^Content:' + chr(10) + '(.*)$')}, 1)"


cte("to_enrich", ["cqueue"], f"""
SELECT id, body, reason,
       list_filter(list_transform(string_split(regexp_replace({sql_strip('body')}, {q('([.!?])' + PY + '+')}, {q(chr(92) + '1' + chr(1))}, 'g'), chr(1)), lambda x: {sql_strip('x')}), lambda x: x <> '') AS sentences,
       list_transform(regexp_extract_all(body, {q('[' + chr(92) + 'p{L}' + chr(92) + 'p{Nl}' + chr(92) + 'p{No}]{4,}')}), lambda x: lower(x)) AS words
FROM (SELECT id, {sql_body(f'array_to_string(chunks, {JOIN2})')} AS body,
             CASE WHEN len(chunks) = 0 THEN 'Empty chunks' ELSE {sql_thin_reason(f'array_to_string(chunks, {JOIN2})')} END AS reason
      FROM cqueue) b""")

cte("frequent", ["to_enrich"], """
SELECT id, list(w ORDER BY n DESC, i) AS tags FROM (
  SELECT id, w, n, i, row_number() OVER (PARTITION BY id ORDER BY n DESC, i) AS rn FROM (
    SELECT id, w, count(*) AS n, min(i) AS i
    FROM (SELECT id, unnest(words) AS w, unnest(range(len(words))) AS i FROM to_enrich) a GROUP BY id, w) b) c
WHERE rn <= 5 GROUP BY id""")

cte("enriched", ["to_enrich", "frequent"], f"""
SELECT e.id, CASE WHEN reason IS NULL THEN array_to_string(list_slice(sentences, 1, 2), ' ') END AS summary,
       CASE WHEN reason IS NULL THEN list_slice({sql_filter_tags(sql_normalize("coalesce(f.tags, CAST([] AS VARCHAR[]))"))}, 1, {_K.MAX_TAGS}) END AS tags,
       reason AS error
FROM to_enrich e LEFT JOIN frequent f ON f.id = e.id""")

sql("enrich_content", ["enriched"], f"SELECT id, summary, {J('tags')} AS tags, error FROM enriched")

sql("apply_enrichment", ["content", "enriched"], f"""
SELECT c.id, CASE WHEN e.id IS NULL THEN c.pipeline_state WHEN e.error IS NULL THEN {_K.PIPE_COMPLETED} ELSE {_K.PIPE_FAILED} END AS pipeline_state,
       CASE WHEN e.id IS NOT NULL AND e.error IS NULL THEN e.summary ELSE c.summary END AS summary,
       {J('CASE WHEN e.id IS NOT NULL AND e.error IS NULL THEN e.tags ELSE c.tags END')} AS tags,
       CASE WHEN e.error IS NOT NULL THEN e.error ELSE c.pipeline_error END AS pipeline_error
FROM content c LEFT JOIN enriched e ON e.id = c.id""")


def _vocabulary_sql() -> str:
    from .catalog import VOCABULARY
    return "[" + ", ".join(q(v) for v in VOCABULARY) + "]"


SQL_LATE = {"enrich_allowed": lambda: with_ctes(["to_enrich"], f"""
SELECT id, CASE WHEN reason IS NULL THEN array_to_string(list_slice(sentences, 1, 2), ' ') END AS summary,
       CASE WHEN reason IS NULL THEN {J(f"list_slice(list_filter({sql_normalize(_vocabulary_sql())}, lambda t: list_contains(words, t)), 1, {_K.MAX_TAGS})")} END AS tags,
       reason AS error FROM to_enrich""")}

# ---- table API -------------------------------------------------------------------
_SRC_COLS = f"id, url, hostname, crawl_state, retry_count, priority_score, {S('next_crawl_at')} AS next_crawl_at, {S('last_crawl_at')} AS last_crawl_at"
_HOST_COLS = f"id, name, crawl_count, crawl_delay_seconds, {S('last_crawled_at')} AS last_crawled_at, {S('next_allowed_at')} AS next_allowed_at, failure_count, success_count"
_CONTENT_COLS = (f"id, url, hostname, title, summary, {J('tags')} AS tags, {R('score')} AS score, pipeline_state, pipeline_error,"
                 f" {S('scraped_at')} AS scraped_at, {S('last_shown_at')} AS last_shown_at, {S('last_seen_at')} AS last_seen_at")

sql("list_sources", ["url_t"], f"""
SELECT {_SRC_COLS}, {S('created_at')} AS created_at FROM url_t WHERE kind = 'source'
ORDER BY created_at DESC, id DESC LIMIT {_K.LIST_LIMIT}""")

sql("list_sources_filtered", ["url_t"], f"""
SELECT {_SRC_COLS}, {S('created_at')} AS created_at FROM url_t WHERE kind = 'url' AND source IN ('seed', 'api')
ORDER BY url_t.created_at DESC, id DESC LIMIT {_K.LIST_LIMIT}""")

sql("list_hostnames", ["host_t"], f"""
SELECT {_HOST_COLS}, {S('created_at')} AS created_at FROM host_t ORDER BY created_at DESC, id DESC LIMIT {_K.LIST_LIMIT}""")

sql("list_content", ["content"], f"""
SELECT {_CONTENT_COLS}, {S('created_at')} AS created_at FROM content WHERE list_contains(tags, 'src3')
ORDER BY created_at DESC, id DESC LIMIT {_K.LIST_LIMIT}""")

cte("ordered_content", ["content"], "SELECT *, row_number() OVER (ORDER BY created_at DESC, id DESC) AS _rn FROM content")

sql("list_content_after", ["ordered_content"], f"""
SELECT {_CONTENT_COLS}, {S('created_at')} AS created_at FROM ordered_content
WHERE _rn > {_K.LIST_LIMIT} ORDER BY created_at DESC, id DESC LIMIT {_K.LIST_LIMIT}""")

sql("list_content_after_filtered", ["ordered_content"], f"""
SELECT {_CONTENT_COLS}, {S('created_at')} AS created_at FROM ordered_content
WHERE _rn > {_K.LIST_LIMIT} AND list_contains(tags, 't7') ORDER BY _rn LIMIT {_K.LIST_LIMIT}""")

sql("list_content_before", ["ordered_content"], f"""
SELECT {_CONTENT_COLS}, {S('created_at')} AS created_at FROM ordered_content
WHERE _rn < {2 * _K.LIST_LIMIT} ORDER BY created_at ASC, id ASC LIMIT {_K.LIST_LIMIT}""")

sql("lookup_by_id", ["content", "interaction"], f"""
SELECT {_CONTENT_COLS} FROM content WHERE id IN (SELECT content_id FROM interaction)""")

_STATE_LABEL = "CASE " + " ".join(f"WHEN crawl_state = {c} THEN {q(n)}" for c, n in _K.CRAWL_STATES.items()) + \
    " ELSE CAST(crawl_state AS VARCHAR) END"
sql("source_state_view", ["url_t"], f"""
SELECT id, url, coalesce(hostname, '') AS hostname, {_STATE_LABEL} AS state, coalesce(retry_count, 0) AS retries
FROM url_t WHERE kind = 'source' ORDER BY created_at DESC, id DESC LIMIT 100""")

sql("create_source", ["url_t", "host_t"], f"""
SELECT url, kind, {sql_hostname('url')} AS hostname,
       CASE WHEN {sql_hostname('url')} IS NULL THEN 'Invalid URL: could not extract hostname'
            WHEN late OR url IN (SELECT url FROM url_t) THEN 'URL already exists' ELSE 'accepted' END AS status
FROM (SELECT 'https://' || name || '/' AS url, 'source' AS kind, false AS late FROM host_t
      UNION ALL SELECT url, 'source', false FROM url_t WHERE kind = 'source'
      UNION ALL SELECT 'https://' || name || '/', 'url', true FROM host_t) r""")

_URL_COLS = [f for f in _SC.URL.fields if f.name in (
    "url", "hostname", "crawl_state", "retry_count", "priority_score", "depth", "kind", "source",
    "next_crawl_at", "last_crawl_at", "crawl_run_id")]


def _validate_part(f) -> str:
    req = bool(f.metadata.get("required"))
    enum = f.metadata.get("enum")
    nulls = f"CAST(sum(CASE WHEN {f.name} IS NULL THEN 1 ELSE 0 END) AS BIGINT)" if req else "CAST(count(*) * 0 AS BIGINT)"
    if enum:
        vals = ", ".join(q(str(e)) for e in enum)
        bad = f"CAST(sum(CASE WHEN {f.name} IS NOT NULL AND CAST({f.name} AS VARCHAR) NOT IN ({vals}) THEN 1 ELSE 0 END) AS BIGINT)"
    else:
        bad = "CAST(count(*) * 0 AS BIGINT)"
    repeats = f"count({f.name}) - count(DISTINCT {f.name})" if f.metadata.get("unique") else "CAST(count(*) * 0 AS BIGINT)"
    return (f"SELECT {q(f.name)} AS \"column\", {str(req).lower()} AS required, {str(bool(enum)).lower()} AS has_enum,"
            f" true AS present, true AS type_ok, {nulls} AS null_violations, {bad} AS enum_violations,"
            f" {repeats} AS unique_violations FROM url_t")


sql("validate_table", ["url_t"], " UNION ALL ".join(_validate_part(f) for f in _URL_COLS))

sql("unique_violations", ["url_t"], "SELECT hostname, count(*) AS n FROM url_t GROUP BY hostname HAVING count(*) > 1")

sql("unique_urls", ["url_t", "new_url_rows"], """
SELECT url, count(*) AS n FROM (
  SELECT url FROM url_t UNION ALL SELECT url FROM new_url_rows UNION ALL SELECT url FROM url_t WHERE kind = 'source') t
GROUP BY url HAVING count(*) > 1""")

sql("cast_failures", ["url_t"], """
SELECT 'url' AS "column", CAST(0 AS BIGINT) AS n
UNION ALL SELECT 'crawl_state', count(*) FROM url_t WHERE id % 7 = 0
UNION ALL SELECT 'priority_score', count(*) FROM url_t WHERE id % 5 = 0""")

# ---- appends and upserts -------------------------------------------------------------
sql("interaction_append", ["content"], f"""
SELECT event_id, content_id, tag, type, {WEIGHT_CASE} AS weight FROM (
  SELECT event_id, content_id, type, unnest(list_distinct(tags)) AS tag FROM (
    SELECT e.event_id, c.id AS content_id, list_concat(c.tags, list_slice(c.tags, 1, 1)) AS tags,
           CASE WHEN e.event_type = 'view' THEN 'impression'
                WHEN e.event_type = 'click' THEN CASE WHEN e.value < 50 THEN 'open' ELSE 'read' END
                WHEN e.event_type = 'purchase' THEN 'like'
                WHEN e.event_type = 'signup' THEN CASE WHEN e.value < 50 THEN 'bookmark' ELSE 'share' END
                WHEN e.event_type = 'error' THEN CASE WHEN e.k < 5 THEN 'hide' ELSE 'impression' END END AS type
    FROM (SELECT event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) e
    JOIN content c ON c.id = e.k) r
  WHERE len(tags) > 0) x""")


sql("interaction_rejected", ["content"], """
SELECT e.event_id, CAST(c.id AS VARCHAR) AS content_id,
       CASE WHEN e.event_type = 'view' THEN 'impression'
            WHEN e.event_type = 'click' THEN CASE WHEN e.value < 50 THEN 'open' ELSE 'read' END
            WHEN e.event_type = 'purchase' THEN 'like'
            WHEN e.event_type = 'signup' THEN CASE WHEN e.value < 50 THEN 'bookmark' ELSE 'share' END
            WHEN e.event_type = 'error' THEN CASE WHEN e.k < 5 THEN 'hide' ELSE 'impression' END END AS type,
       'No tags provided' AS reason
FROM (SELECT event_id, event_type, value, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) e
JOIN content c ON c.id = e.k WHERE len(c.tags) = 0""")


def _profile_sql(where: str) -> str:
    return f"""SELECT tag,
       recent_weight / (SELECT CASE WHEN max(recent_weight) > 0 THEN max(recent_weight) ELSE 1.0 END FROM pr) AS recent_weight,
       long_weight / (SELECT CASE WHEN max(long_weight) > 0 THEN max(long_weight) ELSE 1.0 END FROM pr) AS long_weight
FROM pr""".replace("pr", f"(SELECT tag, sum(weight * pow(0.5, age / 2.0)) AS recent_weight, sum(weight * pow(0.5, age / 14.0)) AS long_weight FROM aged WHERE {where} GROUP BY tag)")


cte("prof_old", ["aged"], _profile_sql("created_at < TIMESTAMP '2024-01-15 00:00:00'"))
cte("prof_new", ["aged"], _profile_sql("created_at >= TIMESTAMP '2024-01-15 00:00:00'"))

sql("tag_score_upsert", ["prof_old", "prof_new"], f"""
SELECT tag, {R('recent_weight')} AS recent_weight, {R('long_weight')} AS long_weight FROM prof_new
UNION ALL
SELECT tag, {R('recent_weight')} AS recent_weight, {R('long_weight')} AS long_weight FROM prof_old
WHERE tag NOT IN (SELECT tag FROM prof_new)""")


# ---- greedy selection as a recursive query (at most `limit` steps) ------------
def _schedule_sql(limit: int) -> str:
    from ..operators.selection import pick_schedule
    return "[" + ", ".join(q(s) for s in pick_schedule(limit)) + "]"


def _jaccard_sql(a: str, b: str) -> str:
    union = f"len(list_distinct(list_concat({a}, {b})))"
    return f"(CASE WHEN {union} = 0 THEN 0.0::DOUBLE ELSE len(list_intersect({a}, {b})) / {union} END)"


_LIMIT = _K.FEED_LIMIT
_SIGNAL_SQL = ("CASE sched[step + 1] WHEN 'continuity' THEN c.continuity WHEN 'relevance' THEN c.relevance "
               "WHEN 'novelty' THEN c.novelty ELSE c.interest END")
_SIM_SQL = (f"CASE WHEN len(p.sets) = 0 THEN 0.0::DOUBLE "
            f"ELSE list_max(list_transform(p.sets, lambda s: {_jaccard_sql('c.tags', 's')})) END")

cte("picks", ["scored"], f"""
SELECT * FROM (
WITH RECURSIVE sel(step, ids, sets, sched) AS (
  SELECT 0, CAST([] AS BIGINT[]), CAST([] AS VARCHAR[][]), {_schedule_sql(_LIMIT)}
  UNION ALL
  SELECT p.step + 1, list_append(p.ids, b.id), list_append(p.sets, b.tags), p.sched
  FROM sel p, LATERAL (
    SELECT c.id, c.tags FROM scored c
    WHERE NOT list_contains(p.ids, c.id)
    ORDER BY 0.5 * (CASE p.sched[p.step + 1] WHEN 'continuity' THEN c.continuity WHEN 'relevance' THEN c.relevance
                        WHEN 'novelty' THEN c.novelty ELSE c.interest END) * c.freshness
             - 0.5 * ({_SIM_SQL}) DESC,
             c.score DESC, c.scraped_at DESC, c.id ASC
    LIMIT 1) b
  WHERE p.step < {_LIMIT})
SELECT ids, sched FROM sel ORDER BY step DESC LIMIT 1) z""")

sql("select_feed", ["scored", "picks"], f"""
SELECT s.id, s.url, s.title, {J('s.tags')} AS tags, {R('s.score')} AS score,
       row_number() OVER (ORDER BY s.score DESC, x.pick ASC) AS rank,
       x.bucket
FROM (SELECT unnest(ids) AS id, unnest(range(len(ids))) AS pick, unnest(sched[1:len(ids)]) AS bucket FROM picks) x
JOIN scored s ON s.id = x.id""")

cte("picks_by_feed", ["scored"], f"""
SELECT * FROM (
WITH RECURSIVE sel(feed, step, ids, sets, sched) AS (
  SELECT hostname, 0, CAST([] AS BIGINT[]), CAST([] AS VARCHAR[][]), {_schedule_sql(_LIMIT)}
  FROM (SELECT DISTINCT hostname FROM scored) f
  UNION ALL
  SELECT p.feed, p.step + 1, list_append(p.ids, b.id), list_append(p.sets, b.tags), p.sched
  FROM sel p, LATERAL (
    SELECT c.id, c.tags FROM scored c
    WHERE c.hostname = p.feed AND NOT list_contains(p.ids, c.id)
    ORDER BY 0.5 * (CASE p.sched[p.step + 1] WHEN 'continuity' THEN c.continuity WHEN 'relevance' THEN c.relevance
                        WHEN 'novelty' THEN c.novelty ELSE c.interest END) * c.freshness
             - 0.5 * ({_SIM_SQL}) DESC,
             c.score DESC, c.scraped_at DESC, c.id ASC
    LIMIT 1) b
  WHERE p.step < {_LIMIT})
SELECT feed, ids, sched FROM (
  SELECT *, row_number() OVER (PARTITION BY feed ORDER BY step DESC) AS rn FROM sel) w WHERE rn = 1) z""")

sql("select_feeds", ["scored", "picks_by_feed"], f"""
SELECT x.feed AS feed_id, s.id, row_number() OVER (PARTITION BY x.feed ORDER BY s.score DESC, x.pick ASC) AS rank,
       x.bucket, {R('s.score')} AS score
FROM (SELECT feed, unnest(ids) AS id, unnest(range(len(ids))) AS pick, unnest(sched[1:len(ids)]) AS bucket
      FROM picks_by_feed) x
JOIN scored s ON s.id = x.id""")

sql("build_feed", ["scored", "picks"], f"""
SELECT s.id, row_number() OVER (ORDER BY s.score DESC, x.pick ASC) AS rank, {S(AS_OF)} AS last_shown_at
FROM (SELECT unnest(ids) AS id, unnest(range(len(ids))) AS pick FROM picks) x JOIN scored s ON s.id = x.id""")

sql("publish_feed", ["scored", "picks"], f"""
SELECT '2024-01-31' AS date, '2024-01-31T00:00:00+00:00' AS generated_at, (SELECT CAST(len(ids) AS BIGINT) FROM picks) AS count,
       row_number() OVER (ORDER BY s.score DESC, x.pick ASC) AS rank, CAST(s.id AS VARCHAR) AS id, s.url, s.title,
       CAST(NULL AS VARCHAR) AS summary, {J('s.tags')} AS tags, {R('s.score')} AS score,
       strftime(s.scraped_at, '%Y-%m-%dT%H:%M:%S') || '+00:00' AS scraped_at
FROM (SELECT unnest(ids) AS id, unnest(range(len(ids))) AS pick FROM picks) x JOIN scored s ON s.id = x.id""")
SQL["serialize_feed"] = SQL["publish_feed"]

# ---- streams: the drained result equals the batch result ------------------------
SQL["stream_tag_profile"] = SQL["tag_profile"]
SQL["list_content_stored"] = SQL["list_content"]
SQL["list_content_after_stored"] = SQL["list_content_after_filtered"]
SQL["enrich_in_rounds"] = SQL["enrich_content"]

sql("stream_interactions", ["interaction"], f"""
SELECT event_id, content_id, tag, type, {R('weight')} AS weight, {S('created_at')} AS created_at FROM interaction""")

sql("stream_content_ingest", ["ingested"], "SELECT *, 0 AS batch_id FROM ingested")

# ---- one crawl round ---------------------------------------------------------------
cte("cr_won", ["claimed_r"], "SELECT c.id, c.url, c.hostname, c.kind, c.sequence, c.id IN (SELECT page_id FROM pages) AS success FROM claimed_r c WHERE applied")

cte("cr_links", ["cr_won"], f"""
SELECT page_id, link FROM (
  SELECT page_id, base, host, regexp_replace({sql_resolve('base', 'href')}, '#.*$', '') AS link
  FROM (SELECT page_id, base, host, unnest(l) AS href
        FROM (SELECT w.id AS page_id, w.url AS base, w.hostname AS host, {sql_hrefs('p.html')} AS l
              FROM cr_won w JOIN pages p ON p.page_id = w.id WHERE w.kind = 'source') s0) s1
  WHERE href <> '') s2
WHERE {sql_scheme('link')} IN ('http', 'https') AND {sql_hostname('link')} IS NOT NULL
  AND {sql_same_site(sql_hostname('link'), 'host')}
  AND regexp_replace(link, '/+$', '') <> regexp_replace(base, '/+$', '')""")

cte("cr_ingested", ["pages_txt", "page_fp", "doc_fp_full", "cr_won"], f"""SELECT * FROM (
WITH inc AS (SELECT p.page_id AS id, p.url, f.simhash FROM pages_txt p JOIN page_fp f ON f.id = p.page_id
             WHERE p.page_id IN (SELECT id FROM cr_won WHERE kind <> 'source') AND p.url NOT IN (SELECT url FROM doc_fp_full)),
     eb AS ({_banded('(SELECT DISTINCT simhash FROM doc_fp_full)', 'simhash')}),
     ib AS ({_banded('inc', 'id, url, simhash')}),
     dup AS (SELECT DISTINCT ib.url FROM ib JOIN eb ON ib.band_no = eb.band_no AND ib.band = eb.band
             WHERE 1.0 - bit_count(xor(ib.simhash, eb.simhash)) / 64.0 > 0.6),
     kept AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY id) AS rn FROM inc WHERE url NOT IN (SELECT url FROM dup))
SELECT url, {UNSIGNED('simhash')} AS simhash FROM kept WHERE rn = 1) z""")

sql("crawl_round", ["url_r", "host_t", "sched_r", "cr_won", "cr_links", "cr_ingested"], f"""
SELECT 'url' AS part, url AS key, crawl_state, CAST(NULL AS BIGINT) AS crawls, CAST(NULL AS BIGINT) AS failures, {S('next_crawl_at')} AS at FROM (
  SELECT u.url, CASE WHEN w.id IS NULL THEN u.crawl_state WHEN w.success THEN 3 ELSE 4 END AS crawl_state,
         CASE WHEN w.id IS NULL THEN u.next_crawl_at WHEN NOT w.success THEN {AS_OF}
              WHEN u.kind = 'source' THEN {AS_OF} + to_seconds({_K.SOURCE_REFRESH_SECONDS})
              ELSE {AS_OF} + to_seconds({_K.CLAIM_LEASE_SECONDS}) END AS next_crawl_at
  FROM url_r u LEFT JOIN cr_won w ON w.id = u.id
  UNION ALL
  SELECT url, 1, {AS_OF} FROM (SELECT DISTINCT link AS url FROM cr_links) g
  WHERE url NOT IN (SELECT url FROM url_r) AND {sql_hostname('url')} IS NOT NULL) t
UNION ALL
SELECT 'host', h.name, NULL, h.crawl_count + coalesce(o.ok, 0), h.failure_count + coalesce(o.err, 0),
       {S(f"CASE WHEN o.hostname IS NOT NULL THEN coalesce(h.next_allowed_at, {AS_OF}) + to_seconds({_K.HOST_COOLDOWN_SECONDS} * (o.ok + o.err)) WHEN s.id IS NOT NULL THEN {AS_OF} + to_seconds({_K.HOSTNAME_LEASE_SECONDS}) ELSE h.next_allowed_at END")}
FROM host_t h LEFT JOIN sched_r s ON s.id = h.id
LEFT JOIN (SELECT hostname, CAST(count(*) FILTER (success) AS BIGINT) AS ok, CAST(count(*) FILTER (NOT success) AS BIGINT) AS err
           FROM cr_won GROUP BY hostname) o ON o.hostname = h.name
UNION ALL
SELECT 'content', url || ' ' || simhash, 1, NULL, NULL, {S(AS_OF)} FROM cr_ingested""")

for _name, _make in SQL_LATE.items():
    SQL[_name] = _make()
