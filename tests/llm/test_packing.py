import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from gristmill.llm import packing
from gristmill.llm.common import slices

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


def whole_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


TEXTS = ["Hello, World! it's 12 o'clock <|endoftext|> <| x", "ÀÉß×÷ÿ naïve İstanbul ſ 中文 ½ é", "a\u0085b c\x1cd\te", "I'LL can't,. ...;; (x)", "", " ", "%%%a### b***c", "ÄÖÜ" * 500]


def test_ids_are_the_tokenizers():
    tokens = packing.WordTokens(PATH)
    for _ in range(2):
        at = 0
        for _, _, data, offsets in slices(pa.array(TEXTS)):
            ids, begin = tokens.encode(data, offsets)
            for i in range(len(offsets) - 1):
                assert ids[begin[i] : begin[i + 1]].tolist() == whole_ids(TEXTS[at])
                at += 1
        tokens.forget()


def test_best_fit_has_no_overlap():
    sizes = np.random.default_rng(1).integers(1, 2049, 3000)
    bins, offsets = packing.best_fit(sizes)
    for b in range(bins.max() + 1):
        own = np.argsort(offsets[bins == b])
        s, o = sizes[bins == b][own], offsets[bins == b][own]
        assert (o == np.concatenate([[0], np.cumsum(s)[:-1]])).all() and s.sum() <= 2048
    assert bins.max() + 1 <= 1.02 * sizes.sum() / 2048 + 1


@pytest.mark.parametrize("at_once", [400_000, 7])
def test_round_trip(documents, odd_rows, prose, monkeypatch, at_once):
    monkeypatch.setattr(packing, "ITEMS_AT_ONCE", at_once)
    rows = [*odd_rows, *[(100 + i, prose(3 + 37 * i % 400, i)) for i in range(80)], (300, prose(2500, 9)), (301, TEXTS[0])]
    got = packing.pack(documents(rows).repartition(6), PATH, capacity=512).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
    for i, text in rows:
        if i is None or i == 6:
            continue
        ids = np.array([*whole_ids(text), 0], "<u4")
        own = sorted(pieces[i], key=lambda r: r.piece)
        assert [(r.piece, r.start, r.length) for r in own] == [(k, a, len(ids[a : a + 512])) for k, a in enumerate(range(0, len(ids), 512))]
        assert [r.ids_crc32 for r in own] == [zlib.crc32(ids[a : a + 512].tobytes()) for a in range(0, len(ids), 512)]
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 512
    if at_once > 7:
        assert len(sequences) <= 1.05 * sum(r.length for r in got) / 512 + 1


def test_empty(documents):
    assert packing.pack(documents([]), PATH).count() == 0


def test_numbers_of_hashes():
    rng = random.Random(5)
    keys = [rng.randrange(1 << 64) for _ in range(3000)] + [(i << 32) + 7 for i in range(50)]
    known = packing.Numbers(16)
    for i, k in enumerate(keys):
        assert known.add(k) == i
    asked = np.array([*keys, 5, 1 << 63], np.uint64)
    assert known.find(asked).tolist() == [*range(len(keys)), -1, -1]
    # A dict of as many whole numbers takes some 100 bytes for each.
    assert len(known) == len(keys) and known.keys.nbytes + known.numbers.nbytes <= 48 * len(keys)
