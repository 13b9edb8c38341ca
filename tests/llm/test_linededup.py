import random
import zlib

import numpy as np
import pytest

from tidings.llm import linededup


def brute(rows, chars=20, documents=3):
    """{(id, text): (lines, dropped, kept text)} by dictionaries."""
    blank = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(blank))
    having = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            having.setdefault(key(line), set()).add(linededup.NO_ID if i is None else i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        me = linededup.NO_ID if i is None else i
        kept = [x for x in lines if len(key(x)) < chars or len(having[key(x)]) < documents or max(having[key(x)]) == me]
        out[i, t or ""] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def lined(words, n_docs=60, seed=1):
    r = random.Random(seed)
    shared = [words(6, s) for s in range(12)]
    rows = []
    for i in range(n_docs):
        lines = [r.choice(shared) if r.random() < 0.5 else words(5, 1000 + 50 * i + j) for j in range(r.randint(1, 12))]
        lines = [("  " + x.upper() + "\t" if r.random() < 0.2 else x) for x in lines]
        rows.append((i, "\n".join(["the line that everyone has, everywhere"] * r.randint(0, 3) + lines)))
    return rows


def results(docs, **k):
    found = linededup.apply_bitmaps(docs, linededup.line_bitmaps(docs, **k))
    return sorted(((r["doc_id"] is not None, r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in found.collect()), key=str)


def expected(rows, **k):
    known = brute(rows, **k)
    return sorted(((i is not None, i, *known[i, t or ""]) for i, t in rows), key=str)


def test_equals_brute_force_with_odd_rows(make_docs, words, odd_rows):
    line = "a line of more than twenty code points"
    rows = lined(words) + [(i + 100 if i is not None else None, t) for i, t in odd_rows]
    rows += [(200, line), (200, line + "\nmore of the same document"), (201, line), (None, line.upper()), (None, "x\n" + line), (202, "éééééééééé"), (203, "éééééééééé"), (204, "éééééééééé"),
             (205, "é" * 20), (206, "é" * 20), (207, "é" * 20), (208, " " * 30 + "\n" * 5), (209, " " * 30), (210, " " * 30)]
    assert results(make_docs(rows)) == expected(rows)


@pytest.mark.parametrize("documents", [2, 3, 4])
def test_number_of_documents(make_docs, words, documents):
    rows = lined(words, 30, 7)
    assert results(make_docs(rows), documents=documents, hold=1) == expected(rows, documents=documents)


def test_equal_and_null_ids_with_a_hot_line(make_docs, words):
    """A third of all rows under one id (and as many without one) share a line
    with few others; rows of one id count once."""
    line = "one line that very many rows of one document have"
    rows = [(5, f"{line}\n{words(3, i)}") for i in range(150)] + [(None, f"{words(2, i)}\n{line}") for i in range(150)]
    for more in ([], [(9, line)], [(9, line), (3, line + "\n" + line)]):
        assert results(make_docs(rows + more, 7), hold=20) == expected(rows + more)


def test_hot_line_over_many_ranges(spark, make_docs, words):
    line = "the same line in every document of the table"
    rows = [(i, f"{line}\n{words(4, i % 50)} {i}\n{line}") for i in range(400)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        assert results(make_docs(rows, 8)) == expected(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_marks_do_not_depend_on_where_ranges_are_cut():
    """Every cut of a sorted sequence decides the same."""
    r = random.Random(4)
    rows = sorted(((r.randint(0, 2), 0, r.randint(0, 5), v, 1, b"") for v in range(40)), key=lambda x: (x[0], -x[2], x[3]))
    rows = [(*x[:3], i, *x[4:]) for i, x in enumerate(rows)]

    def decided(cuts, hold):
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
        marks = [(p, *m) for p, part in enumerate(parts) for m in linededup.stream_marks(iter(part), 3, hold)]
        totals = {}
        for _, kind, h1, _, doc, _, _, _, docs, last in marks:
            if kind == linededup.EDGE:
                n, keeper, before = totals.get(h1, (0, doc, None))
                totals[h1] = (n + docs - (before == doc), max(keeper, doc), last)
        return {m[5] for m in marks if m[1] == linededup.DROP or (m[1] == linededup.OPEN and totals[m[2]][0] >= 3 and m[4] < totals[m[2]][1])}

    whole = decided([], 100)
    assert whole
    for seed in range(60):
        r = random.Random(seed)
        cuts = sorted(r.sample(range(1, len(rows)), r.randint(1, 12)))
        assert decided(cuts, r.choice([1, 2, 100])) == whole


def test_bitmaps(make_docs):
    line = "a line of more than twenty code points"
    rows = [(1, f"x\n{line}\ny\n{line}"), (2, line), (3, f"{line}\nz")]
    found = {r["doc"]: r for r in linededup.line_bitmaps(make_docs(rows)).collect()}
    bits = {d: np.unpackbits(np.frombuffer(zlib.decompress(r["keep"]), np.uint8), count=r["n_lines"]).tolist() for d, r in found.items()}
    assert bits == {1: [1, 0, 1, 0], 2: [0]}
    assert {d: r["n_dropped"] for d, r in found.items()} == {1: 2, 2: 1}


def test_empty_and_long(make_docs, words):
    assert results(make_docs([], 1)) == []
    long = "\n".join(words(8, i % 300) for i in range(20_000))
    rows = [(1, long), (2, long), (3, long + "\nend"), (4, None)]
    assert results(make_docs(rows)) == expected(rows)
