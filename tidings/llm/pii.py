"""Personal data by a semi-Markov conditional random field.

Four kinds have a plain definition (``base_spans``): e-mail, IP, card, phone.
Text around these is split into islands, runs of neighbouring units (stretches
without white space, trimmed of quotes and closing punctuation) that each hold
a digit or ``@``.  The field scores every segment of up to ``LONGEST`` units of
an island, for every kind, by features of the whole span -- its digits,
separators and grouping, its checksum, what stands before it -- and dynamic
programming over segment ends chooses boundaries and kinds jointly.  Weights
maximise the likelihood of the base spans in a bounded sample of islands.  A
segment that no base span touches is added where it is on the best path and its
marginal probability is at least ``SURE``.

Scale: one pass over the documents without a shuffle, in time linear in a text;
the sample is bounded by ``SAMPLE_DOCS`` and ``SAMPLE_ISLANDS``.

Defined cases: a null or empty text has no spans; offsets are code points of
the whole text; base spans of different kinds may overlap; repeated documents
are scanned each; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_text, read_table, trimmed

KINDS = ("email", "ip", "card", "phone")
LONGEST, SURE, PIECE = 6, 0.9, 12
SAMPLE_DOCS, SAMPLE_ISLANDS = 20_000, 6_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
CALL = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TRIGGER = re.compile(r"[0-9@]")
UNIT_SPLIT = re.compile(r"\S+")
TRIM_LEFT, TRIM_RIGHT = "\"'<[{,;:!?=", "\"'>]},;:!?."


def luhn(digits: str) -> bool:
    odd, even = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def small_part(part: str) -> bool:
    return len(part := part.lstrip("0")) <= 3 and int(part or "0") <= 255


def emails(text: str):
    """The run of local characters before each @, with the domain after it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def addresses(text: str):
    """Each four consecutive parts of a dotted run of numbers."""
    for m in DOTTED.finditer(text):
        parts = m[0].split(".") if "." in m[0] else ()
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            end = at + sum(map(len, four)) + 3
            if all(map(small_part, four)):
                yield at, end
            at = end + 1


def cards(text: str):
    for m in DIGITS.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := only_digits(m[0])) <= 19 and luhn(d):
            yield m.span()


def phones(text: str):
    for m in CALL.finditer(text):
        if 9 <= len(only_digits(m[0])) <= 15:
            yield m.span()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the plain definitions, by kind, then start."""
    found = []
    if "@" in text:
        found += [(0, *s) for s in emails(text)]
    if TRIGGER.search(text):
        if "." in text:
            found += [(1, *s) for s in addresses(text)]
        found += [(2, *s) for s in cards(text)]
        if "+" in text:
            found += [(3, *s) for s in phones(text)]
    return found


def islands(text: str):
    """Lists of neighbouring units, each ``(start, end)``."""
    run, at, n = [], 0, len(text)
    while at < n and (m := TRIGGER.search(text, at)):
        start = end = m.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        if m := UNIT_SPLIT.match(text, end):
            end = m.end()
        gap = text[run[-1][1]:start] if run else ""
        if run and (len(gap) > 8 or any(c in "\n\r" or not c.isspace() and c not in TRIM_LEFT + TRIM_RIGHT for c in gap)):
            yield run
            run = []
        at = end
        word = text[start:end]
        left = len(word) - len(word.lstrip(TRIM_LEFT))
        right = len(word.rstrip(TRIM_RIGHT))
        if left < right:
            run.append((start + left, start + right))
    if run:
        yield run


FEATURES = ("bias", "at", "one_at", "domain", "dots0", "dots1", "dots2", "dots3", "dots4", "plus", "brackets", "hyphens", "blanks1", "blanks2", "blanks3",
            "letters", "digits_to_3", "digits_to_6", "digits_to_8", "digits_to_12", "digits_to_19", "digits_more", "checksum", "bytes", "even_groups", "after_sign", "quoted", "mixed", "other")


def features(text: str, start: int, end: int):
    """Numbers that describe the whole span."""
    import numpy as np

    s = text[start:end]
    digits = only_digits(s)
    n, dots, ats = len(digits), s.count("."), s.count("@")
    letters = sum(c.isalpha() for c in s)
    parts = s.split(".")
    blanks = s.count(" ")
    before, after = text[start - 1:start], text[end:end + 1]
    groups = re.split(r"[ -]", s)
    other = sum(not c.isalnum() and c not in " .@+()-_%" for c in s)
    return np.array([
        1, ats > 0, ats == 1, ats == 1 and bool(DOMAIN.fullmatch(s[s.find("@") + 1:])), dots == 0, dots == 1, dots == 2, dots == 3, dots > 3, s[:1] == "+", "(" in s and ")" in s, "-" in s, blanks == 1, blanks == 2, blanks > 2,
        letters > 0, n <= 3, 3 < n <= 6, 6 < n <= 8, 8 < n <= 12, 12 < n <= 19, n > 19, 13 <= n <= 19 and luhn(digits), len(parts) == 4 and all(p.isascii() and p.isdigit() and small_part(p) for p in parts),
        len(groups) > 1 and len({len(g) for g in groups}) == 1, before in ("=", ":", "#"), before in ("\"", "'") or after in ("\"", "'"), letters > 0 and n > 0 and ats == 0, other > 0], float)


def segments(text: str, units):
    """Feature rows of all segments: ``rows[j][d]`` ends at unit j, d + 1 long."""
    return [[features(text, units[j - d][0], units[j][1]) for d in range(min(LONGEST, j + 1))] for j in range(len(units))]


class Field:
    """Weights (one row for outside, one for each kind) and inference."""

    def __init__(self, weights=None):
        import numpy as np

        self.w = np.zeros((len(KINDS) + 1, len(FEATURES))) if weights is None else weights

    def scores(self, rows):
        """``out[j][d]``: scores of the segment for outside (one unit alone) and each kind."""
        import numpy as np

        out = []
        for row in rows:
            s = np.array(row) @ self.w.T
            s[1:, 0] = -np.inf
            out.append(s)
        return out

    def best(self, scores) -> list[tuple[int, int, int]]:
        """Best path as (first unit, last unit, label)."""
        value, back = [0.0], []
        for j, s in enumerate(scores):
            options = [(value[j - d] + float(s[d, k]), d, k) for d in range(len(s)) for k in range(s.shape[1])]
            v, d, k = max(options, key=lambda o: (o[0], -o[1], -o[2]))
            value.append(v)
            back.append((d, k))
        path, j = [], len(scores)
        while j > 0:
            d, k = back[j - 1]
            path.append((j - 1 - d, j - 1, k))
            j -= d + 1
        return path[::-1]

    def marginals(self, scores):
        """Log-partition, and the probability of every segment and label."""
        import numpy as np

        n = len(scores)
        forward = np.full(n + 1, -np.inf)
        forward[0] = 0
        for j, s in enumerate(scores):
            forward[j + 1] = np.logaddexp.reduce([forward[j - d] + x for d in range(len(s)) for x in s[d]])
        backward = np.full(n + 1, -np.inf)
        backward[n] = 0
        for i in range(n - 1, -1, -1):
            backward[i] = np.logaddexp.reduce([scores[i + d][d, k] + backward[i + d + 1] for d in range(min(LONGEST, n - i)) for k in range(scores[i + d].shape[1])])
        return forward[n], [np.exp(np.array([forward[j - d] + s[d] + backward[j + 1] for d in range(len(s))]) - forward[n]) for j, s in enumerate(scores)]


def gold(units, spans) -> list[tuple[int, int, int]] | None:
    """The path that has the base spans as segments; None if one of them does
    not begin and end with units or has too many."""
    starts, ends = {u[0]: i for i, u in enumerate(units)}, {u[1]: i for i, u in enumerate(units)}
    taken = []
    for k, a, b in spans:
        if b <= units[0][0] or a >= units[-1][1]:
            continue
        if a not in starts or b not in ends or ends[b] - starts[a] >= LONGEST:
            return None
        taken.append((starts[a], ends[b], k + 1))
    taken.sort()
    path, at = [], 0
    for i, j, k in taken:
        if i < at:
            return None
        path += [(u, u, 0) for u in range(at, i)] + [(i, j, k)]
        at = j + 1
    return path + [(u, u, 0) for u in range(at, len(units))]


def pieces(units, path):
    """An island's units and path in pieces of at most ``PIECE`` units, cut
    between segments, so that islands of any length are learnt from."""
    part: list = []
    for i, j, k in path or ():
        if part and j - part[0][0] >= PIECE:
            yield units[part[0][0]:i], [(a - part[0][0], b - part[0][0], c) for a, b, c in part]
            part = []
        part.append((i, j, k))
    if part:
        yield units[part[0][0]:], [(a - part[0][0], b - part[0][0], c) for a, b, c in part]


def train(samples, rounds: int = 30, rate: float = 0.5, ridge: float = 1e-4) -> Field:
    """Gradient ascent on the paths' likelihood; ``samples``: (rows, path,
    times seen)."""
    import numpy as np

    field = Field()
    total = sum(n for _, _, n in samples) or 1
    size = np.full_like(field.w, 1e-6)
    for _ in range(rounds):
        grad = -ridge * field.w
        for rows, path, n in samples:
            _, p = field.marginals(field.scores(rows))
            for i, j, k in path:
                grad[k] += rows[j][j - i] * (n / total)
            for row, q in zip(rows, p, strict=True):
                grad -= q.T @ np.array(row) * (n / total)
        size += grad * grad
        field.w = field.w + rate * grad / np.sqrt(size)
    return field


def found_spans(text: str, field: Field) -> tuple[list, list]:
    """(base spans, all spans), each ``(kind, start, end)``."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    added, at = [], 0
    for run in islands(text):
        free, part = [], []
        for u in run:
            while at < len(taken) and taken[at][1] <= u[0]:
                at += 1
            if any(a < u[1] and u[0] < b for a, b in taken[at:at + 8]):
                free, part = free + [part] * bool(part), []
            else:
                part.append(u)
        for units in free + [part] * bool(part):
            scores = field.scores(segments(text, units))
            path = [x for x in field.best(scores) if x[2]]
            if path:
                _, p = field.marginals(scores)
                added += [(k - 1, units[i][0], units[j][1]) for i, j, k in path if p[j][j - i, k] >= SURE]
    return base, sorted(base + added)


def spelled(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_islands: int = SAMPLE_ISLANDS) -> Field:
    """Weights from the islands of at most ``sample_docs`` documents, those of
    the least hashes of their ids, and at most ``sample_islands`` islands (or
    pieces of longer ones)."""
    ids = docs.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for text in batch.column(0).to_pylist():
                base = base_spans(text)
                for units in islands(text):
                    for part, path in pieces(units, gold(units, base)):
                        a, b = max(0, part[0][0] - 1), part[-1][1] + 1
                        out.append((text[a:b], [x - a for u in part for x in u], [x for s in path for x in s]))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())))], ["text", "units", "path"])

    rows = docs.join(F.broadcast(ids), "doc_id").select("text").mapInArrow(trimmed(cut), "text string, units array<int>, path array<int>")
    rows = rows.orderBy(F.xxhash64("text"), "text").limit(sample_islands).collect()
    import numpy as np

    grouped: dict = {}
    for text, units, path in rows:
        fx = segments(text, list(zip(units[::2], units[1::2], strict=True)))
        way = tuple(zip(path[::3], path[1::3], path[2::3], strict=True))
        key = (way, b"".join(np.array(r).tobytes() for r in fx))
        grouped.setdefault(key, [fx, way, 0])[2] += 1
    return train([tuple(g) for g in grouped.values()])


def scan(docs: DataFrame, field: Field) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)``."""

    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            out = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                base, spans = found_spans(text, field)
                out.append((doc, *(sum(s[0] == k for s in base) for k in range(4)), hashlib.sha256(spelled(base).encode()).hexdigest(), spelled(spans)))
            kinds = [pa.int64()] * 5 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return doc_text(docs).mapInArrow(trimmed(run), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets (a null text
    stays null), and ``n_chars``, where there is one, of the new text."""
    names = docs.columns
    at, size = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def clean(text: str) -> str:
        out, end = [], 0
        for a, b, k in sorted((a, b, k) for k, a, b in found_spans(text, field)[1]):
            if a >= end:
                out += [text[end:a], f"[{KINDS[k].upper()}]"]
            end = max(end, b)
        return "".join(out) + text[end:] if out else text

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            columns = list(batch.columns)
            texts = [None if t is None else clean(t) for t in columns[at].to_pylist()]
            if size is not None:
                columns[size] = pa.array([n if new == old else len(new) for n, new, old in zip(columns[size].to_pylist(), texts, columns[at].to_pylist(), strict=True)], columns[size].type)
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(trimmed(run), docs.schema)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    docs = read_table(spark, sf_dir, "documents")
    return scan(docs, fit(doc_text(docs)))
