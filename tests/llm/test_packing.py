import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from graphloom.llm import packing
from graphloom.llm.word_bpe import WordBpe

from .brute import best_fit
from .conftest import ODD


def test_plan_has_the_bins_of_one_by_one_best_fit():
    r = random.Random(7)
    for _ in range(300):
        size = r.choice([10, 37, 64])
        lengths = [r.randint(1, size) for _ in range(r.randint(1, 120))]
        used, ranks = Counter(), Counter()
        for length, low, high, per_bin, first, offset in packing.best_fit_decreasing(Counter(lengths), size):
            assert low == ranks[length]
            ranks[length] = high
            for k in range(high - low):
                assert used[first + k // per_bin] == offset + k % per_bin * length
                used[first + k // per_bin] += length
        assert ranks == Counter(lengths)
        assert sorted(size - u for u in used.values()) == best_fit(lengths, size)


def test_plan_refuses_pieces_that_are_too_long():
    with pytest.raises(ValueError):
        packing.best_fit_decreasing({11: 1}, 10)
    assert packing.best_fit_decreasing({}, 10) == []


def test_word_ids_are_the_librarys():
    r, w = random.Random(2), WordBpe(packing.default_tokenizer())
    signs = "aaeetthhinoNS.,!!''12³ªÉéßÀµ<|>§ ­$漢éΣ😀ẖH̱\x85\x1c   \n\t\r"
    texts = ["".join(r.choice(signs) for _ in range(r.randrange(40))) for _ in range(1500)] + ["<|endoftext|> a", "it's they'll", "a" * 30]
    for t in texts:
        ids = np.frombuffer(b"".join(w.encode(packing._words(t))), "<u4").tolist() if t else []
        assert ids == w.library.encode(t, add_special_tokens=False).ids, repr(t)


def test_ids_of_long_runs_are_the_librarys():
    r, w = random.Random(4), WordBpe(packing.default_tokenizer())
    texts = [unit * n for unit in ("-", "=", "a", "ab", "ha", "é", "=-", "...", "7") for n in (513, 2049, 5003)] + ["".join(r.choice("abcdefgh") for _ in range(3000)), "-" * 200_000]
    for t in texts:
        assert np.frombuffer(w.encode([t])[0], "<u4").tolist() == w.library.encode(t, add_special_tokens=False).ids, (t[:20], len(t))


def test_packed_documents(docs_of):
    library = WordBpe(packing.default_tokenizer()).library
    rows = ODD + [(100 + k, "some words " * k) for k in range(40)]
    out = packing.pack_documents(docs_of(rows, extra=True), packing.default_tokenizer()).collect()
    want = Counter()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            want[i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(np.array(ids[k : k + 2048], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 2048
    assert sorted(2048 - sum(n for _, n in b) for b in bins.values()) == best_fit([r.length for r in out], 2048)
    assert packing.pack_documents(docs_of([]), packing.default_tokenizer()).count() == 0
