"""URL parsing, canonicalisation and junk predicates as Catalyst expressions.

All rules follow Python's ``urllib.parse`` behaviour where the reference uses
it (``urlsplit``, ``parse_qsl``, ``urlencode``), written with built-in string
and array functions so they stay inside whole-stage code generation.
"""

from __future__ import annotations

import json
import re
from html import unescape
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import constants as K
from .common import let

_RE = K.URL_REGEX
# Schemes for which urlunsplit writes '//' even with an empty netloc.
_NETLOC_SCHEMES = ["http", "https", "ftp", "ws", "wss", "file", "git", "svn", "sftp"]


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _RE, 2))


def url_netloc(url: Column) -> Column:
    return F.regexp_extract(url, _RE, 4)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, _RE, 5)


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, _RE, 7)


def url_fragment(url: Column) -> Column:
    return F.regexp_extract(url, _RE, 9)


def url_parts(url: Column) -> Column:
    return F.struct(url_scheme(url).alias("scheme"), url_netloc(url).alias("netloc"),
                    url_path(url).alias("path"), url_query(url).alias("query"),
                    url_fragment(url).alias("fragment"))


def url_hostname(url: Column) -> Column:
    """``urlsplit(url).hostname``: userinfo and port removed, lower-cased,
    NULL when empty.  Not ``parse_url``: that returns NULL for hosts with
    ``_`` or URLs with spaces."""
    hostinfo = F.regexp_replace(url_netloc(url), r"^.*@", "")
    bracketed = F.regexp_extract(hostinfo, r"^\[([^\]]*)\]", 1)
    plain = F.regexp_replace(hostinfo, r":.*$", "")
    host = F.lower(F.when(hostinfo.startswith("["), bracketed).otherwise(plain))
    return F.when(host == "", F.lit(None).cast("string")).otherwise(host)


def strip_fragment(url: Column) -> Column:
    """``urldefrag``: everything before the first '#'."""
    return F.regexp_replace(url, r"#.*$", "")


def _unquote_plus(c: Column) -> Column:
    """Python ``unquote_plus`` (errors='replace'): a '%' not followed by two hex
    digits stays literal, so escape it before the JVM decoder sees it."""
    return F.url_decode(F.regexp_replace(c, r"%(?![0-9A-Fa-f]{2})", "%25"))


def _quote_plus(c: Column) -> Column:
    """Python ``quote_plus`` with no extra safe characters: the JVM encoder
    differs only on '*' (kept by the JVM) and '~' (kept by Python)."""
    enc = F.url_encode(c)
    return F.replace(F.replace(enc, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical_query(query: Column) -> Column:
    """``urlencode`` of ``parse_qsl(query)`` minus tracking parameters.

    Pieces without '=' and blank values vanish (``keep_blank_values=False``),
    names are compared case-insensitively, order is kept.
    """
    tracking = list(K.TRACKING_PARAMS)
    pieces = F.split(query, "&")
    kept = F.filter(pieces, lambda p: (F.instr(p, "=") > 0)
                    & (F.length(p) > F.instr(p, "=")))
    decoded = F.transform(kept, lambda p: F.struct(
        _unquote_plus(F.substring_index(p, "=", 1)).alias("k"),
        _unquote_plus(p.substr(F.instr(p, "=") + 1, F.length(p))).alias("v")))
    useful = F.filter(decoded, lambda kv: ~F.lower(kv["k"]).isin(*tracking))
    encoded = F.transform(useful, lambda kv: F.concat(_quote_plus(kv["k"]), F.lit("="), _quote_plus(kv["v"])))
    return F.array_join(encoded, "&")


def canonicalize_url(url: Column) -> Column:
    """Drop fragment and tracking parameters, re-encode the rest, strip the
    trailing '/' (an empty path becomes '/')."""
    scheme = url_scheme(url)
    netloc = url_netloc(url)
    path = F.regexp_replace(url_path(url), r"/+$", "")
    path = F.when(path == "", F.lit("/")).otherwise(path)
    query = canonical_query(url_query(url))
    has_netloc = netloc != ""
    path = F.when(has_netloc & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path)
    authority = F.when(has_netloc | (scheme.isin(*_NETLOC_SCHEMES) & path.startswith("/")),
                       F.concat(F.lit("//"), netloc)).otherwise(F.lit(""))
    prefix = F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(F.lit(""))
    suffix = F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))
    return F.concat(prefix, authority, path, suffix)


def _ext_regex() -> str:
    return "(?:" + "|".join(re.escape(e) for e in K.IGNORE_EXTENSIONS) + ")$"


def is_ignored_url(url: Column) -> Column:
    """Junk-URL predicate: non-http(s), site root, bare profile page, known
    junk substrings, asset extensions or any blocked path segment."""
    scheme = url_scheme(url)
    raw_path = url_path(url)
    path = F.lower(raw_path)
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    bare_profile = F.regexp_replace(raw_path, r"/+$", "").rlike(r"^/@[^/]+$")
    substr_hit = None
    for s in K.IGNORE_SUBSTRINGS:
        hit = F.instr(path, s) > 0
        substr_hit = hit if substr_hit is None else (substr_hit | hit)
    blocked = F.array(*[F.lit(s) for s in K.IGNORE_SEGMENTS])
    return (~scheme.isin("http", "https")
            | (F.size(segments) == 0)
            | bare_profile
            | substr_hit
            | path.rlike(_ext_regex())
            | F.arrays_overlap(segments, blocked))


def in_crawl_scope(link: Column, seed: Column) -> Column:
    """Followed-link scope of a page crawl: starts with the seed URL, is not
    the seed itself (fragment and case ignored) and does not end in a
    login / signin / signup / changelog path."""
    low_link, low_seed = F.lower(link), F.lower(seed)
    is_seed = (low_link == low_seed) | low_link.startswith(F.concat(low_seed, F.lit("#")))
    return link.startswith(seed) & ~is_seed & ~link.rlike(K.CRAWL_EXCLUDE_PATTERN)


def same_site(host: Column, base_host: Column) -> Column:
    """Same host, tolerating a ``www.`` prefix on either side."""
    return ((host == base_host) | (host == F.concat(F.lit("www."), base_host))
            | (base_host == F.concat(F.lit("www."), host)))


# ---------------------------------------------------------------- link extraction

# Parts of a page that hold no markup: comments and raw-text elements.
NO_MARKUP = r"(?is)<!--.*?-->|<(script|style|textarea|title)\b[^>]*>.*?</\1\s*>"
# An <a> tag up to the end of its href value.  Quoted values of attributes
# before it are passed whole, so text in them is never taken for an attribute;
# the name must follow white space, a quote or a slash.
HREF_TAG = (r"(?is)<a(?=[\s/])(?:[^>\"']|\"[^\"]*\"|'[^']*')*?(?<=[\s\"'/])href\s*=\s*"
            r"(?:\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)")
HREF_VALUE = r"(?is)[\s\"'/]href\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>][^\s>]*)$"
# A character reference at the start of a string, and what stands behind '&'.
REFERENCE = r"^&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
LAST_POINT = 0x10FFFF


def _names_json() -> str:
    """The named references of the standard, as Python knows them, by their
    first two characters; of each the longest name first."""
    by_head: dict[str, list[dict[str, str]]] = {}
    for name in sorted(html5, key=lambda n: (-len(n), n)):
        by_head.setdefault(name[:2], []).append({"n": name, "v": html5[name]})
    return json.dumps(by_head)


def _character(number: Column) -> Column:
    """The text of a numeric reference: code points below 160 as the standard
    maps them, surrogates and numbers beyond the last one as U+FFFD,
    noncharacters as nothing."""
    low = F.array(*[F.lit(unescape(f"&#{n};")) for n in range(160)])
    char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    return (F.when(number < 160, F.get(low, number.cast("int")))
            .when(number.between(0xD800, 0xDFFF) | (number > LAST_POINT), F.lit("\ufffd"))
            .when(number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(0xFFFE) == 0xFFFE), F.lit(""))
            .otherwise(char))


def _number(ref: Column) -> Column:
    """The number of a numeric reference; of a very large one, one that is too
    large."""
    hexa = ref.rlike("^#[xX]")
    digits = F.regexp_extract(ref, "^#[xX]?0*([0-9a-fA-F]*)", 1)
    value = F.when(digits == "", F.lit("0")).when(hexa, F.conv(digits, 16, 10)).otherwise(digits)
    return F.when(F.length(digits) > 8, F.lit(LAST_POINT + 1).cast("bigint")).otherwise(value.cast("bigint"))


def decode_entities(c: Column) -> Column:
    """``html.unescape``: numeric references, and of the named ones the longest
    that the text begins with."""
    names = F.from_json(F.lit(_names_json()), "map<string,array<struct<n:string,v:string>>>")

    def one(part: Column) -> Column:
        ref = F.regexp_extract(part, REFERENCE, 1)
        return let(F.struct(part.alias("part"), ref.alias("ref"), F.substr(part, F.length(ref) + 2, F.length(part)).alias("rest")), decoded)

    def decoded(p: Column) -> Column:
        ref = p["ref"]
        found = F.get(F.filter(F.try_element_at(names, F.substring(ref, 1, 2)), lambda e: F.startswith(ref, e["n"])), F.lit(0))
        named = let(found, lambda e: F.concat(e["v"], F.substr(ref, F.length(e["n"]) + 1, F.length(ref)), p["rest"]))
        return (F.when(ref == "", p["part"])
                .when(F.startswith(ref, F.lit("#")), F.concat(let(_number(ref), _character), p["rest"]))
                .otherwise(F.coalesce(named, p["part"])))

    return F.when(F.instr(c, "&") > 0, F.array_join(F.transform(F.split(c, "(?=&)", -1), one), "")).otherwise(c)


def hrefs(html: Column) -> Column:
    """All ``a[href]`` values of a page, in document order: double-quoted,
    single-quoted or bare, entities decoded, comments and scripts left out."""
    markup = F.regexp_replace(html, NO_MARKUP, " ")
    tags = F.regexp_extract_all(markup, F.lit(HREF_TAG), F.lit(0))

    def value(tag: Column) -> Column:
        raw = F.regexp_extract(tag, HREF_VALUE, 1)
        quoted = raw.startswith('"') | raw.startswith("'")
        return decode_entities(F.when(quoted, F.substr(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw))

    return F.transform(tags, value)


def base_parts(base: Column) -> Column:
    """The pieces of a page URL that reference resolution needs; computed
    once per page, before its hrefs are exploded."""
    b_path = url_path(base)
    return F.struct(
        F.regexp_extract(base, _RE, 2).alias("scheme"),
        F.concat(F.regexp_extract(base, _RE, 2), F.lit("://"), url_netloc(base)).alias("origin"),
        b_path.alias("path"),
        url_query(base).alias("query"),
        base.alias("base"))


def _merge_path(base_path: Column, ref_path: Column) -> Column:
    """``urljoin``'s path step: merge with the base directory (relative
    references), then remove '.' and '..' segments with a stack."""
    def body(p: Column) -> Column:
        base_segs, ref = p["base_segs"], p["ref"]
        base_dir = F.when(F.element_at(base_segs, -1) != "",
                          F.slice(base_segs, 1, F.size(base_segs) - 1)).otherwise(base_segs)
        return let(F.struct(F.concat(base_dir, F.split(ref, "/")).alias("merged"), ref.alias("ref")), tail)

    def tail(q: Column) -> Column:
        merged, ref = q["merged"], q["ref"]
        # inside a relative merge, empty middle segments vanish (no '//')
        rel = F.filter(merged, lambda seg, i: (i == 0) | (i == F.size(merged) - 1) | (seg != ""))
        segs = F.when(ref.startswith("/"), F.split(ref, "/")).otherwise(rel)
        return let(segs, finish)

    def finish(segs: Column) -> Column:
        stack = F.aggregate(
            segs, F.array().cast("array<string>"),
            lambda acc, seg: F.when(seg == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(seg == ".", acc)
            .otherwise(F.concat(acc, F.array(seg))))
        stack = F.when(F.element_at(segs, -1).isin(".", ".."), F.concat(stack, F.array(F.lit("")))).otherwise(stack)
        joined = F.array_join(stack, "/")
        joined = F.when(joined == "", F.lit("/")).otherwise(joined)
        return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))

    return let(F.struct(F.split(base_path, "/").alias("base_segs"), ref_path.alias("ref")), body)


# Schemes for which urljoin resolves relative references (FIXED VALUES,
# Python's ``urllib.parse.uses_relative``).
USES_RELATIVE = ["", "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms",
                 "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss"]


def resolve_with_parts(b: Column, href: Column) -> Column:
    """``urljoin(base, href)`` with JVM expressions, given :func:`base_parts`
    of the base: other-scheme references stay as they are; scheme-relative
    references take the base scheme; empty-path references keep the base
    path (and the base query unless one is given); path references are
    merged with the base directory and cleaned of dot segments.  Schemes are
    lower-cased and empty query / fragment markers dropped, as
    ``urlunparse`` does.  Intermediate values are bound once with
    :func:`let` so the expression stays small wherever it is used."""
    def step1(p: Column) -> Column:
        href_, b_, h_scheme = p["href"], p["b"], p["h_scheme"]
        b_scheme = F.lower(b_["scheme"])
        same = (h_scheme != "") & (h_scheme == b_scheme) & h_scheme.isin(*USES_RELATIVE)
        ref = F.when(same, href_.substr(F.length(h_scheme) + 2, F.length(href_))).otherwise(href_)
        return let(F.struct(href_.alias("href"), b_.alias("b"), b_scheme.alias("b_scheme"),
                            ((h_scheme != "") & ~same).alias("other"), ref.alias("ref")), step2)

    def step2(p: Column) -> Column:
        ref = p["ref"]
        lead = F.regexp_extract(ref, r"^[^?#]*", 0)
        return let(F.struct(p["href"].alias("href"), p["b"].alias("b"), p["b_scheme"].alias("b_scheme"),
                            p["other"].alias("other"), ref.alias("ref"), lead.alias("lead"),
                            F.regexp_extract(ref, r"^[^?#]*\?([^#]*)", 1).alias("query"),
                            F.regexp_extract(ref, r"^[^#]*#(.*)$", 1).alias("frag"),
                            (F.regexp_extract(ref, r"^//([^/?#]*)", 1) != "").alias("has_netloc"),
                            # '//' with an empty authority: the rest is a path on the base host
                            F.when(ref.startswith("//"), lead.substr(F.lit(3), F.length(lead)))
                             .otherwise(lead).alias("path")), step3)

    def step3(p: Column) -> Column:
        b_, query, frag, path = p["b"], p["query"], p["frag"], p["path"]
        q_part = F.when(query != "", F.concat(F.lit("?"), query)).otherwise(F.lit(""))
        f_part = F.when(frag != "", F.concat(F.lit("#"), frag)).otherwise(F.lit(""))
        origin = F.concat(p["b_scheme"], F.lit("://"), url_netloc(b_["base"]))
        q_keep = F.when(query != "", query).otherwise(b_["query"])
        empty_path_ref = F.concat(origin, b_["path"],
                                  F.when(q_keep != "", F.concat(F.lit("?"), q_keep)).otherwise(F.lit("")), f_part)
        return (F.when(p["other"], p["href"])
                .when(p["href"] == "", b_["base"])
                .when(p["has_netloc"], F.concat(p["b_scheme"], F.lit(":"), p["lead"], q_part, f_part))
                .when(path == "", empty_path_ref)
                .otherwise(F.concat(origin, _merge_path(b_["path"], path), q_part, f_part)))

    h_scheme = F.lower(F.regexp_extract(href, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return let(F.struct(href.alias("href"), b.alias("b"), h_scheme.alias("h_scheme")), step1)


def resolve_href(base: Column, href: Column) -> Column:
    return resolve_with_parts(base_parts(base), href)
