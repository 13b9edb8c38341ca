import hashlib
import random

import numpy as np

from tidings.llm.fingerprint import Powers, PrefixHash, edited, fingerprint, fingerprint_documents, likeness


def test_spans_and_extensions():
    r = random.Random(1)
    a = [r.randint(0, 3) for _ in range(400)]
    b = a[50:200] + [9] + a[:100]
    t = Powers()
    x, y = PrefixHash(np.array(a, np.uint32), t), PrefixHash(np.array(b, np.uint32), t)
    for _ in range(300):
        i, j, n = r.randrange(380), r.randrange(230), r.randint(1, 20)
        assert (x.span(i, n) == y.span(j, n)) == (a[i:i + n] == b[j:j + n])
        k = 0
        while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
            k += 1
        assert x.extension(i, y, j) == k
    assert x.extension(50, y, 0) == 150


def test_likeness_follows_overlap(words):
    a, b = words(800, 1), words(800, 2)
    assert likeness(fingerprint(a), fingerprint(a)) == 1
    assert likeness(fingerprint(a), fingerprint(b)) < 0.15
    assert 0.6 < likeness(fingerprint(a), fingerprint(a[:4000] + "xyz" + a[4000:])) <= 1
    assert likeness(fingerprint(""), fingerprint("")) == 1 and likeness(fingerprint(""), fingerprint(a)) == 0
    assert fingerprint("ab") != fingerprint("ba") != fingerprint("a")


def test_documents_against_a_loop(make_docs, odd_rows):
    for ranges in (2, 5):
        got = fingerprint_documents(make_docs(odd_rows), ranges).collect()
        rows = sorted(((i if i is not None else -1 << 63, i, t or "") for i, t in odd_rows), key=lambda x: (x[0], x[2]))
        want = []
        for n, (_, i, t) in enumerate(rows):
            after = rows[(n + 1) % len(rows)][2]
            new = edited(t, after)
            want.append((i, len(t), hashlib.sha256(new.encode()).hexdigest(), fingerprint(t), fingerprint(new),
                         likeness(fingerprint(t), fingerprint(new)), likeness(fingerprint(t), fingerprint(after))))
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_alone_and_empty(make_docs):
    r = fingerprint_documents(make_docs([(5, "abcdef")])).collect()
    assert len(r) == 1 and r[0].near_next == 1 and r[0].edited_sha256 == hashlib.sha256(b"abcabc").hexdigest()
    assert fingerprint_documents(make_docs([])).count() == 0
