"""Properties on random inputs (one Spark job per rule), and agreement with
Python's urllib where the standard defines the result."""

import random
import string

from pyspark.sql import functions as F

from tidings import constants as K
from tidings.functions import tags as TG
from tidings.functions import urls as U


def _rand_url(rng):
    scheme = rng.choice(["http", "https", "HTTPS", "ftp"])
    host = rng.choice(["a.com", "www.B.org", "m.c.net:8080", "user@d.io", "e_f.example.com"])
    segs = [rng.choice(["", "Post", "about", "tags", "x.JSON", "@me", "m", "a%2Fb", "caf%C3%A9", "new-in-go", "p~1"])
            for _ in range(rng.randint(0, 4))]
    path = "/" + "/".join(segs) + rng.choice(["", "/", "//"])
    keys = ["utm_source", "UTM_Medium", "ref", "q", "a b", "k*", "x~", "", "p%26q", "z"]
    vals = ["", "1", "a+b", "%41", "%zz", "caf%C3%A9", "x=y", "~*", " "]
    params = []
    for _ in range(rng.randint(0, 4)):
        k, v = rng.choice(keys), rng.choice(vals)
        params.append(rng.choice([f"{k}={v}", k, f"={v}"]))
    query = ("?" + "&".join(params)) if params or rng.random() < 0.2 else ""
    frag = rng.choice(["", "#top", "#a?b"])
    return f"{scheme}://{host}{path}{query}{frag}"


def test_random_urls(spark):
    """A canonical form is canonical itself, has no fragment, no tracking key
    and no trailing slash, and keeps scheme, host and the other parameters;
    what is junk by scheme, extension or segment is found so."""
    from urllib.parse import parse_qsl, urlsplit
    rng = random.Random(1234)
    urls = sorted({_rand_url(rng) for _ in range(400)})
    df = spark.createDataFrame([(u,) for u in urls], "url string").withColumn("c", U.canonicalize_url(F.col("url")))
    rows = df.select("url", "c", U.canonicalize_url(F.col("c")).alias("cc"), U.is_ignored_url(F.col("url")).alias("i"),
                     U.url_hostname(F.col("url")).alias("h")).collect()
    for r in rows:
        before, after = urlsplit(r["url"]), urlsplit(r["c"])
        assert r["cc"] == r["c"], r["url"]
        assert r["h"] == before.hostname == after.hostname, r["url"]
        assert "#" not in r["c"] and (after.path == "/" or not after.path.endswith("/")), r["url"]
        kept = parse_qsl(after.query)
        assert not {k.lower() for k, _ in kept} & set(K.TRACKING_PARAMS), r["url"]
        assert [p for p in parse_qsl(before.query) if p in kept] == kept, r["url"]
        assert len(kept) == sum(k.lower() not in K.TRACKING_PARAMS for k, _ in parse_qsl(before.query)), r["url"]
        segments = [x.lower() for x in before.path.split("/") if x]
        if before.scheme == "ftp" or not segments or set(segments) & {"about", "tags"} or before.path.lower().endswith(".json"):
            assert r["i"], r["url"]
        if before.scheme != "ftp" and set(segments) <= {"post", "new-in-go", "p~1"} and segments:
            assert not r["i"], r["url"]


def test_random_tag_lists(spark):
    """Normalised tags are stripped, lower and distinct; filtering keeps the
    first spelling of each tag in order and drops junk; both are idempotent."""
    rng = random.Random(99)
    good = ["Python", " python", "PYTHON ", "Rust", "rust", "Data Bases", "y" * 40, "sql", "\u00fcmlaut", "\u00dcMLAUT", "a\tb", "\u3000c"]
    junk = ["", "  ", "Home", "home page", "x" * 41, "Privacy Policy"]
    lists = [[rng.choice(good + junk) for _ in range(rng.randint(0, 12))] for _ in range(200)]
    df = spark.createDataFrame(list(enumerate(lists)), "i int, raw array<string>")
    df = df.select("i", "raw", TG.normalize_tags(F.col("raw")).alias("n"), TG.filter_tags(F.col("raw")).alias("f"), TG.finalize_tags(F.col("raw")).alias("z"))
    df = df.withColumn("nn", TG.normalize_tags(F.col("n"))).withColumn("ff", TG.filter_tags(F.col("f")))
    for r in df.collect():
        keys = {t.strip().lower() for t in r["raw"]} - {""}
        assert r["nn"] == r["n"] and r["ff"] == r["f"]
        assert set(r["n"]) == keys and len(r["n"]) == len(keys)
        assert not set(r["f"]) & set(junk) and {t.strip().lower() for t in r["f"]} == {t.strip().lower() for t in r["raw"] if t not in junk}
        assert len({t.strip().lower() for t in r["f"]}) == len(r["f"])
        places = [r["raw"].index(t) for t in r["f"]]
        assert places == sorted(places)
        assert r["z"] == [t.strip().lower() for t in r["f"]][: K.MAX_TAGS]


def test_random_references_match_urljoin(spark):
    from urllib.parse import urljoin
    rng = random.Random(77)
    bases = ["https://s.example.com/a/b/c", "https://s.example.com/a/b/", "http://h.org", "https://h.org/x?q=1#f",
             "https://h.org/p/q.html?z=9"]
    pieces = ["", ".", "..", "x", "y.html", "", "a b", "%41"]
    refs = set()
    for _ in range(300):
        segs = [rng.choice(pieces) for _ in range(rng.randint(1, 4))]
        ref = rng.choice(["", "/", "./", "../"]) + "/".join(segs)
        ref += rng.choice(["", "?", "?k=v", "#", "#frag", "?a=1#b"])
        refs.add(ref)
    refs |= {"?", "#", "?#f", ".", "..", "./", "../../..", "a//b", "/a//b", "//cdn.example.com/x", "mailto:x@y"}
    rows = [(i, b, r, 0) for i, (b, r) in enumerate((b, r) for b in bases for r in sorted(refs))]
    df = spark.createDataFrame(rows, "page_id long, base string, href string, pos long")
    from tidings.operators import links as LK
    for r in LK.resolve_links(df).collect():
        assert r["absolute"] == urljoin(r["base"], r["href"]), (r["base"], r["href"])
