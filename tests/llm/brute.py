"""Plain versions of the operators, for small tables."""

import hashlib
import re
from collections import Counter

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def exact(rows):
    """{doc_id: (keep_id, size)} for distinct ids."""
    groups = {}
    for i, t in rows:
        groups.setdefault(SPACE.sub(" ", t or ""), []).append(i)
    return {i: (min(g), len(g)) for g in groups.values() for i in g}


def components(rows, size, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()
    ids, up = sorted(sets), {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    where = {}
    for i in ids:
        for x in sets[i]:
            where.setdefault(x, []).append(i)
    for i in ids:
        for j, n in Counter(j for x in sets[i] for j in where[x] if j < i).items():
            if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in ids}


def without_repeats(rows, n=20):
    """{doc_id: (words, kept words)}."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = words(t)
        gone = [False] * len(w)
        for s in range(len(w) - n + 1):
            k = tuple(w[s : s + n])
            if k in seen:
                gone[s : s + n] = [True] * n
            seen.add(k)
        out[i] = (w, [x for x, g in zip(w, gone, strict=True) if not g])
    return out


def best_fit(lengths, size):
    """Remaining capacities of the bins."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [(room, k) for k, room in enumerate(bins) if room >= n]
        if fits:
            bins[min(fits)[1]] -= n
        else:
            bins.append(size - n)
    return sorted(bins)


def kneser_ney(words, order, chars):
    """A function of a word: the log probability of its characters and its end, from {word: count}, by the definition; so
    many characters are known in all. An n-gram has a count at the highest order; else its number of distinct characters in front or, at the word's start,
    where there is none, its count."""
    import math

    texts = {f" {w} ": n for w, n in words.items()}
    raw = Counter()
    for t, n in texts.items():
        for end in range(1, len(t)):
            for k in range(1, order + 1):
                if end - k + 1 >= 0:
                    raw[t[end - k + 1 : end + 1]] += n
    grams = [None, *({g for g in raw if len(g) == k} for k in range(1, order + 1))]
    count = {}
    for k in range(1, order + 1):
        more = Counter(g[1:] for g in grams[k + 1]) if k < order else {}
        for g in grams[k]:
            count[g] = raw[g] if k == order else more.get(g, raw[g] if k > 1 and g[0] == " " else 0)
    least = {}
    for k in range(1, order + 1):
        c = Counter(count[g] for g in grams[k])
        least[k] = c[1] / (c[1] + 2 * c[2]) if c[1] and c[2] else 0.5

    def p(char, context):
        if len(context) >= order:
            context = context[len(context) - order + 1 :]
        k = len(context) + 1
        lower = p(char, context[1:]) if context else 1 / (chars + 1)
        own = [g for g in grams[k] if g[:-1] == context]
        if not own:
            return lower
        total = sum(count[g] for g in own)
        back = max(sum(min(count[g], least[k]) for g in own) / total, 1e-6)
        return max(count.get(context + char, 0) - least[k], 0) / total + back * lower

    return lambda w: sum(math.log(p(c, f" {w} "[:i])) for i, c in enumerate(f"{w} ", 1))
