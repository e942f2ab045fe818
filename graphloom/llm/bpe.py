"""Vectorised BPE: all words of a batch are merged together on flat numpy arrays.

Words of very many symbols (runs of spaces or dashes, text without spaces) are parted first: where no pair of the table
can ever join two neighbours, and what is still long is merged window after window. Two results that stand side by side
are the result of the whole if each two neighbouring tokens, merged anew by themselves, stay as they are: the first merge
across tokens would be the first one of those two alone as well.
"""

from __future__ import annotations

import numpy as np

NONE = np.int64(1 << 40)
#: Words of more symbols are parted.
LONG = 512


class PairRanks:
    """Which pairs of symbols merge: their rank (lower first) and the symbol they make, in a hash table with open
    addressing that is looked up for arrays of pairs."""

    SLOTS = 20  # as a power of 2

    def __init__(self, left, right, rank, made):
        keys = (np.asarray(left, np.int64) << 32) | np.asarray(right, np.int64)
        if len(keys) > (1 << self.SLOTS) // 4:
            raise ValueError("too many pairs for the table")
        self.keys = np.full(1 << self.SLOTS, -1, np.int64)
        self.rank, self.made = np.full(len(self.keys), NONE), np.zeros(len(self.keys), np.int64)
        slots, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):  # of those that want a free slot, the last written has it; the others try the next
            free = self.keys[slots[todo]] == -1
            self.keys[slots[todo[free]]] = keys[todo[free]]
            todo = todo[self.keys[slots[todo]] != keys[todo]]
            slots[todo] = (slots[todo] + 1) % len(self.keys)
        self.rank[slots], self.made[slots] = rank, made
        left, right, made = (np.asarray(x, np.int64) for x in (left, right, made))
        # Of each symbol the first and the last of those that it was made of, and how many these are.
        self.first, self.last, self.size = np.arange(n := int(max(made.max(initial=0), left.max(initial=0), right.max(initial=0))) + 1), np.arange(n), np.ones(n, np.int64)
        for _ in range(len(made) + 1):
            before = self.size.copy()
            self.first[made], self.last[made], self.size[made] = self.first[left], self.last[right], self.size[left] + self.size[right]
            if (before == self.size).all():
                break
        self.joined = np.unique((self.last[left] << 32) | self.first[right])

    def apart(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """For symbols of words as they begin, side by side: whether no merge can ever join them."""
        keys = (left << 32) | right
        at = np.minimum(np.searchsorted(self.joined, keys), max(len(self.joined) - 1, 0))
        return self.joined[at] != keys if len(self.joined) else np.ones(len(keys), bool)

    def sizes(self, symbols: np.ndarray) -> np.ndarray:
        return np.where(symbols < len(self.size), self.size[np.minimum(symbols, len(self.size) - 1)], 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.SLOTS)).astype(np.int64)

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranks (NONE where the pair doesn't merge) and slots in the table."""
        keys = (left << 32) | right
        slots = self._slot(keys)
        there = self.keys[slots]
        other = np.flatnonzero((there != keys) & (there != -1))
        while len(other):
            slots[other] = (slots[other] + 1) % len(self.keys)
            there = self.keys[slots[other]]
            other = other[(there != keys[other]) & (there != -1)]
        return self.rank[slots], slots


def merge_words(symbols: np.ndarray, lengths: np.ndarray, pairs: PairRanks) -> tuple[np.ndarray, np.ndarray]:
    """Merges each word's symbols until no pair of the table is left: the pair of the least rank first, the leftmost of
    equals. symbols: those of all words, one word after the other. Returns the same for the merged words."""
    lengths = np.asarray(lengths, np.int64)
    if not (lengths > LONG).any():
        return _rounds(symbols, lengths, pairs)
    sym, word = np.asarray(symbols, np.int64), np.repeat(np.arange(len(lengths)), lengths)
    new = np.concatenate(([True], word[1:] != word[:-1]))
    inner = np.flatnonzero(~new & (lengths > LONG)[word])
    new[inner[pairs.apart(sym[inner - 1], sym[inner])]] = True
    starts = np.flatnonzero(new)
    parts = np.diff(np.append(starts, len(sym)))
    known: dict = {}
    merged = {i: _by_windows(sym[starts[i] : starts[i] + parts[i]], pairs, known, LONG) for i in np.flatnonzero(parts > LONG).tolist()}
    short = parts <= LONG
    got, sizes = _rounds(sym[np.repeat(short, parts)], parts[short], pairs)
    out_sizes = np.zeros(len(parts), np.int64)
    out_sizes[short] = sizes
    for i, m in merged.items():
        out_sizes[i] = len(m)
    out = np.empty(int(out_sizes.sum()), np.int64)
    out[np.repeat(short, out_sizes)] = got
    ends = np.cumsum(out_sizes)
    for i, m in merged.items():
        out[ends[i] - len(m) : ends[i]] = m
    return out, np.bincount(word[starts], out_sizes, len(lengths)).astype(np.int64)


def _by_windows(sym: np.ndarray, pairs: PairRanks, known: dict, size: int) -> np.ndarray:
    """One long word, by windows of `size` symbols that begin where a token ends; of a window, the tokens of its first half
    count. known remembers windows and pairs of tokens, so that runs of one symbol cost a look-up for each window. Where
    two tokens don't stand side by side, windows are made twice as large."""

    def merged(part: np.ndarray) -> np.ndarray:
        key = part.tobytes()
        if key not in known:
            if len(known) > 4096:
                known.clear()
            known[key] = _rounds(part, np.array([len(part)]), pairs)[0]
        return known[key]

    if size >= len(sym):
        return merged(sym)
    out: list[np.ndarray] = []
    at = last = 0
    while at < len(sym):
        got = merged(sym[at : at + size])
        if at + size < len(sym):
            got = got[: max(1, int(np.searchsorted(np.cumsum(pairs.sizes(got)), size // 2, "right")))]
        ends = at + np.cumsum(pairs.sizes(got))
        if out:
            two = merged(sym[last : ends[0]])
            if len(two) != 2 or two[0] != out[-1][-1] or two[1] != got[0]:
                return _by_windows(sym, pairs, known, 2 * size)
        out.append(got)
        last, at = int(ends[-2]) if len(ends) > 1 else at, int(ends[-1])
    return np.concatenate(out)


def _rounds(symbols: np.ndarray, lengths: np.ndarray, pairs: PairRanks) -> tuple[np.ndarray, np.ndarray]:
    """merge_words() in rounds.

    In a round each word merges all places of its least rank at once (of overlapping ones, every second from the left).
    Where that could make a pair of no greater rank, which would come before the later places, the word merges its
    leftmost place only.
    """
    n_words = len(lengths)
    out_lengths = np.array(lengths, np.int64)
    sym, word = np.array(symbols, np.int64), np.repeat(np.arange(n_words), lengths)
    done: list[tuple[np.ndarray, np.ndarray]] = []

    def ranked(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs at i, i + 1."""
        j = np.minimum(i + 1, len(sym) - 1)
        rank, at = pairs.look(sym[i], sym[j])
        rank[(word[i] != word[j]) | (j == i)] = NONE
        return rank, at

    rank, at = ranked(np.arange(len(sym)))
    while len(sym):
        starts = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
        least = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.append(starts, len(sym)))
        if (over := least == NONE).any():  # compaction: words without a pair are done
            gone = np.repeat(over, sizes)
            done.append((word[gone], sym[gone]))
            sym, word, rank, at = sym[~gone], word[~gone], rank[~gone], at[~gone]
            least, sizes = least[~over], sizes[~over]
            if not len(sym):
                break
        each = np.repeat(least, sizes)
        hit = np.flatnonzero(rank == each)
        # Of a run of overlapping places, every second.
        first = np.concatenate(([True], np.diff(hit) > 1))
        run = np.maximum.accumulate(np.where(first, np.arange(len(hit)), 0))
        hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
        lead = np.concatenate(([True], word[hit][1:] != word[hit][:-1]))
        if not lead.all():
            more = np.flatnonzero(~lead | np.append(~lead[1:], False))  # of words with several places
            ok = np.ones(len(hit), bool)
            ok[more] = lead[more] | _safe(sym, word, hit[more], pairs.made[at[hit[more]]], each[hit[more]], pairs)
            hit = hit[ok]
        sym[hit] = pairs.made[at[hit]]
        keep = np.ones(len(sym), bool)
        keep[hit + 1] = False
        new = np.cumsum(keep)[hit] - 1  # where the merged symbols are after compaction
        sym, word, rank, at = sym[keep], word[keep], rank[keep], at[keep]
        touched = np.zeros(len(sym), bool)
        touched[new] = touched[np.maximum(new - 1, 0)] = True
        near = np.flatnonzero(touched)
        rank[near], at[near] = ranked(near)
    words = np.concatenate([w for w, _ in done]) if done else np.zeros(0, np.int64)
    syms = np.concatenate([s for _, s in done]) if done else np.zeros(0, np.int64)
    order = np.argsort(words, kind="stable")
    out_lengths[:] = np.bincount(words, minlength=n_words)
    return syms[order], out_lengths


def _safe(sym, word, hit, made, least, pairs) -> np.ndarray:
    """For each place to merge, whether its word can merge all its places at once."""
    after = sym.copy()
    after[hit] = made
    inner = np.zeros(len(sym), bool)
    inner[hit + 1] = True
    bad = np.zeros(len(hit), bool)
    last = len(sym) - 1
    left, right = hit - 1, hit + 2
    left_after = np.where((left >= 0) & inner[np.maximum(left, 0)], left - 1, left)
    for place, symbol in ((left, sym), (left_after, after)):
        p = np.maximum(place, 0)
        rank, _ = pairs.look(symbol[p], made)
        bad |= (rank <= least) & (place >= 0) & (word[p] == word[hit])
    for symbol in (sym, after):
        p = np.minimum(right, last)
        rank, _ = pairs.look(made, symbol[p])
        bad |= (rank <= least) & (right <= last) & (word[p] == word[hit])
    unsafe = np.unique(word[hit[bad]])
    return ~np.isin(word[hit], unsafe)
