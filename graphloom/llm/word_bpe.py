"""Ids of words by a byte-level BPE file with word ends, as the tokenizers library makes them.

Plain words (of Latin-1, without apostrophes, angle brackets or control characters) are merged together by
bpe.merge_words; all others go to the library.
"""

from __future__ import annotations

import json
import os
import unicodedata

import numpy as np

from .bpe import PairRanks, merge_words

_LETTER, _NUMBER, _OTHER, _LIBRARY = range(4)


def _classes() -> np.ndarray:
    out = np.full(256, _OTHER)
    for i in range(256):
        kind = unicodedata.category(chr(i))[0]
        out[i] = _LETTER if kind == "L" else _NUMBER if kind == "N" else _OTHER
        if kind in "CZ" or chr(i) in "'<>":
            out[i] = _LIBRARY
    return out


def _byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is visible, else the next unused
    one from 256 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b) if b in seen else chr(next(spare)) for b in range(256)]


class WordBpe:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        symbols = _byte_symbols()
        self.inner = np.array([vocab[c] for c in symbols], np.int64)
        self.last = np.array([vocab[c + end] for c in symbols], np.int64)
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.pairs = PairRanks([vocab[a] for a, _ in merges], [vocab[b] for _, b in merges], range(len(merges)), [vocab[a + b] for a, b in merges])
        self.kind = _classes()
        self.lower = np.array([ord(chr(i).lower()) for i in range(256)], np.int64)

    def encode(self, words: list[str]) -> list[bytes]:
        """The words' ids as little-endian unsigned 32-bit numbers; a word has no white space."""
        out = [b""] * len(words)
        plain = []
        for i, w in enumerate(words):
            if w.isascii() or max(w) < "Ā":
                plain.append(i)
        flat = np.frombuffer("".join([words[i] for i in plain]).encode("latin-1"), np.uint8)
        lengths = np.fromiter((len(words[i]) for i in plain), np.int64, len(plain))
        owner = np.repeat(np.arange(len(plain)), lengths)
        kind = self.kind[flat]
        odd = np.zeros(len(plain), bool)
        odd[owner[kind == _LIBRARY]] = True
        good = ~odd & (lengths > 0)
        rest = sorted(set(range(len(words))) - {i for i, g in zip(plain, good.tolist(), strict=True) if g} - {i for i in plain if not words[i]})
        if good.any():
            use = good[owner]
            code, own, kind = self.lower[flat[use]], owner[use], kind[use]
            first = np.ones(len(code), bool)
            first[1:] = (own[1:] != own[:-1]) | (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
            final = np.append(first[1:], True)
            # Characters from 128 on are two bytes in UTF-8.
            wide = code >= 128
            at = np.cumsum(1 + wide) - 1  # of each character's last byte
            data, is_last = np.zeros(len(code) + int(wide.sum()), np.int64), np.zeros(len(code) + int(wide.sum()), bool)
            data[at] = np.where(wide, 0x80 | (code & 0x3F), code)
            data[at[wide] - 1] = 0xC0 | (code[wide] >> 6)
            is_last[at] = final
            ends = np.flatnonzero(is_last) + 1
            ids, sizes = merge_words(np.where(is_last, self.last[data], self.inner[data]), np.diff(ends, prepend=0), self.pairs)
            per_word = np.bincount(own[first], sizes, len(plain)).astype(np.int64)
            raw, stops = ids.astype("<u4").tobytes(), (np.cumsum(per_word) * 4).tolist()
            for i, a, b, g in zip(plain, [0, *stops], stops, good.tolist()):
                if g:
                    out[i] = raw[a:b]
        for k in range(0, len(rest), 4096):
            some = rest[k : k + 4096]
            for i, e in zip(some, self.library.encode_batch_fast([words[i] for i in some], add_special_tokens=False), strict=True):
                out[i] = np.array(e.ids, "<u4").tobytes()
        return out
