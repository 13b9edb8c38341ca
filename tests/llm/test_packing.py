import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tidings.llm.packing import assign, pack


def test_every_id_once_and_nothing_padded(make_docs, odd_rows):
    got = [r.asDict() for r in pack(make_docs(odd_rows), keep_ids=True).collect()]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = defaultdict(list)
    for i, text in odd_rows:
        want[i].append(np.array(t.encode(text or "", add_special_tokens=False).ids + [2], "<u4").tobytes())
    pieces, sequences = defaultdict(dict), defaultdict(list)
    for r in got:
        assert r["ids_crc32"] == zlib.crc32(r["ids"]) and len(r["ids"]) == 4 * r["length"] > 0
        if r["doc_id"] != 24:
            pieces[r["doc_id"]][r["start"]] = bytes(r["ids"])
        assert r["doc_tokens"] in {len(x) // 4 for x in want[r["doc_id"]]}
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for i, whole in want.items():
        if i != 24:
            assert b"".join(pieces[i][s] for s in sorted(pieces[i])) == whole[0]
    assert sum(r["length"] for r in got if r["doc_id"] == 24) == sum(len(x) // 4 for x in want[24])
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == 4096 or at & (at - 1) == 0 and at < 4096


def test_least_cost_sequence_with_room():
    pieces, sizes = assign([6, 5, 3, 2], sequence=8, linear=1, quadratic=1)
    assert sizes == [8, 8]
    assert pieces == [(0, 0, 6, 0, 0), (1, 0, 5, 1, 0), (2, 0, 3, 1, 5), (3, 0, 2, 0, 6)]
    pieces, sizes = assign([7, 7, 4], sequence=8)
    assert sizes == [8, 8, 2] and sum(n for _, _, n, _, _ in pieces) == 18


def test_empty(make_docs):
    assert pack(make_docs([])).count() == 0


def test_a_small_cache_gives_the_same_rows(odd_rows):
    """With room for few words the encoder forgets, and encodes them again."""
    from tidings.llm.packing import WordEncoder

    small, large = WordEncoder("word_bpe_49k.json", cache_words=50), WordEncoder("word_bpe_49k.json")
    for _, text in odd_rows * 2:
        texts = [text or ""]
        assert small.encode(texts) == large.encode(texts)
        assert len(small.cores) + len(small.others) <= 50 + len(set((text or "").split())) * 2 + 1
    assert len(large.cores) > 200
