"""Language identification by interpolated Kneser-Ney character models.

A text is read as lower-case words of letters; a character is predicted from those before it in its word, the space in
front included. Each language has a model of order ORDER: the highest order from counts, lower ones from continuation
counts, each interpolated with the next lower by the mass that absolute discounting took. The models are kept as sorted
arrays of n-gram hashes of each language: the interpolated log probability of every n-gram that it has, and the log
back-off weight of every context. A text gets the language of the lowest cross-entropy for a
character. To reject texts, each word counts in the language where it is likeliest, so that those of two learned languages
stay: one whose cross-entropy is then above what sampled texts kept out of training had at its length goes.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, by_bytes, documents, materialize
from .wordcache import RowCache, current, sums

ORDER = 5
#: What is learned from: documents of a language.
MAX_DOCS = 1000
CACHED_WORDS = 150_000
#: A text is rejected if it is more deviations from the usual than this quantile of the texts kept out of training, and than
#: so many at least; N such texts leave room for 1 + FEW / N times that.
KEPT, LEAST, FEW = 0.998, 3.0, 10
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Of words with a space before and after: for each predicted character its word, its place in it (from 1), the
    character, and for orders 1..ORDER+1 the hash of the n-gram that ends there (of use if it fits into the word)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    code = np.frombuffer(f" {'  '.join(words)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    grams, h = [], (code + np.uint64(1)) * _B
    unit = h
    for _ in range(ORDER + 1):
        grams.append((h ^ (h >> np.uint64(29))) * _A)
        h = np.concatenate((unit[:1], h[:-1])) * _A + unit
    return owner, place, code, grams


class NothingToLearn(ValueError):
    """No text with a language and a letter."""


@dataclass
class LanguageModels:
    """The n-grams of an order and their contexts stand language after language, each language's sorted; gram_ends and
    context_ends have the bounds, so that memory goes with the n-grams that languages have."""

    langs: list[str]
    grams: list[np.ndarray]  # of orders 1..ORDER: hashes
    logp: list[np.ndarray]  # [n-gram, 1]
    gram_ends: list[np.ndarray]  # [language + 1]
    contexts: list[np.ndarray]  # of lengths 1..ORDER-1: hashes
    backoff: list[np.ndarray]  # [context, 1]
    context_ends: list[np.ndarray]
    unseen: np.ndarray  # log probability of a character that no language has
    mean: np.ndarray  # cross-entropy of a language's texts, each word in its likeliest language
    spread: np.ndarray  # [language, 2]: deviation is sqrt(a² + b² / characters)
    cut: float  # deviations from the mean at which a text is rejected
    scale: float  # of the confidence

    def words(self, words: list[str]) -> np.ndarray:
        """For each word: log probability in each language, the highest of them, and how many characters were predicted.
        Other characters than letters part words."""
        found = [_LETTERS.findall(w.lower()) for w in words]
        parts = list(itertools.chain.from_iterable(found))
        out = np.zeros((len(words), len(self.langs) + 2))
        if not parts:
            return out
        owner, place, _, grams = _grams(parts)
        at = np.flatnonzero(place > 0)
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, found), np.int64, len(found)))[owner[at]]
        # A score depends on the longest n-gram that ends there within the word; each distinct one is looked up once.
        longest = np.choose(np.minimum(place[at], ORDER - 1), [g[at] for g in grams[:ORDER]])
        _, first, inverse = np.unique(longest, return_index=True, return_inverse=True)
        for j in range(len(self.langs)):
            out[:, j] = np.bincount(word, self._scores(j, at[first], place, grams)[inverse], len(words))
        if self.langs:
            out[:, -2] = out[:, :-2].max(1)
        out[:, -1] = np.bincount(word, minlength=len(words))
        return out

    def _scores(self, j: int, at: np.ndarray, place: np.ndarray, grams: list[np.ndarray]) -> np.ndarray:
        """Log probabilities in a language of the characters at these places."""
        score = np.zeros(len(at))
        todo, left = np.arange(len(at)), np.ones(len(at), bool)
        for k in range(ORDER, 0, -1):
            fits = todo if k == 1 else todo[place[at[todo]] >= k - 1]
            a, b = self.gram_ends[k - 1][j : j + 2]
            found = _find(self.grams[k - 1][a:b], grams[k - 1][at[fits]])
            hit = found >= 0
            score[fits[hit]] += self.logp[k - 1][a:b, 0][found[hit]]
            left[fits[hit]] = False
            todo = todo[left[todo]]
            if k > 1:  # the context's k - 1 characters end one before
                miss = fits[~hit]
                a, b = self.context_ends[k - 2][j : j + 2]
                found = _find(self.contexts[k - 2][a:b], grams[k - 2][at[miss] - 1])
                hit = found >= 0
                score[miss[hit]] += self.backoff[k - 2][a:b, 0][found[hit]]
        score[todo] += self.unseen[j]
        return score

    def decide(self, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From texts' sums of words(): language numbers (-1 without letters), confidence, and whether it is rejected."""
        n = total[:, -1]
        if not self.langs:
            return np.full(len(n), -1), np.zeros(len(n)), n == 0
        entropy = -total[:, :-2] / np.maximum(n, 1)[:, None]
        best = entropy.argmin(1)
        low = entropy[np.arange(len(n)), best]
        weight = np.exp(-np.minimum(np.sqrt(n)[:, None] * (entropy - low[:, None]) * self.scale, 700))
        score = np.where(n > 0, 1 / weight.sum(1), 0.0)
        rejected = (n == 0) | (-total[:, -2] / np.maximum(n, 1) > self.mean[best] + self.cut * _deviation(self.spread[best], n))
        return np.where(n > 0, best, -1), score, rejected


def _find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places in the sorted keys, -1 where there is none."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _counts(words: list[str], times: np.ndarray) -> list[np.ndarray]:
    """The distinct n-grams of words that come so many times, as columns: order, hash, hash without the last character,
    hash without the first one, whether it begins with the word, how often it comes."""
    owner, place, _, grams = _grams(words)
    out = []
    for k in range(1, ORDER + 1):
        at = np.flatnonzero((place > 0) & (place >= k - 1))
        key, first, inv = np.unique(grams[k - 1][at], return_index=True, return_inverse=True)
        n, first = np.bincount(inv, times[owner[at]], len(key)).astype(np.int64), at[first]
        shorter = (grams[k - 2][first - 1], grams[k - 2][first]) if k > 1 else (np.zeros_like(key), np.zeros_like(key))
        out.append((np.full(len(key), k), key, *shorter, (place[first] == k - 1) & (k > 1), n))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def fit(words: list[tuple[str, str, int]]) -> LanguageModels:
    """From (language, word, count)."""
    per = {}
    for lang in sorted({x[0] for x in words}):
        own = [(w, c) for x, w, c in words if x == lang]
        per[lang] = _counts([w for w, _ in own], np.array([c for _, c in own]))
    return fit_counts(per)


def fit_counts(per: dict[str, list[np.ndarray]]) -> LanguageModels:
    """From the columns of _counts() of each language; not calibrated, so that only texts without letters are rejected."""
    langs = sorted(per)
    if not langs:
        raise NothingToLearn("no labelled documents to learn languages from")
    chars = len(np.unique(np.concatenate([c[1][c[0] == 1] for c in per.values()])))
    grams, logp, contexts, backoff = ([[] for _ in range(ORDER)] for _ in range(4))
    unseen = np.zeros(len(langs))
    for j, lang in enumerate(langs):
        orders = []
        for k in range(1, ORDER + 1):
            own = np.flatnonzero(per[lang][0] == k)
            own = own[np.argsort(per[lang][1][own])]
            orders.append([c[own] for c in per[lang][1:]])
        below = np.array([1.0 / (chars + 1)])
        for k, (key, context, shorter, start, n) in enumerate(orders):
            # Continuation counts: of the distinct n-grams longer by one; an n-gram at the word's start has none longer,
            # so it keeps its count. The highest order has counts.
            count = n.astype(np.float64)
            if k + 1 < ORDER:
                longer = _find(key, orders[k + 1][2])
                more = np.bincount(longer[longer >= 0], minlength=len(key)).astype(np.float64)
                count = np.where(more > 0, more, np.where(start, count, 0))
            once, twice = (count == 1).sum(), (count == 2).sum()
            d = once / (once + 2 * twice) if once and twice else 0.5
            places, ctx = np.unique(context, return_inverse=True)
            total = np.bincount(ctx, count, len(places))
            weights = np.maximum(np.bincount(ctx, np.minimum(count, d), len(places)) / total, 1e-6)
            lower = below[_find(orders[k - 1][0], shorter)] if k else below
            p = np.maximum(count - d, 0) / total[ctx] + weights[ctx] * lower
            if k == 0:
                unseen[j] = np.log(weights[0] / (chars + 1))
            else:
                contexts[k].append(places)
                backoff[k].append(np.log(weights).astype(np.float32)[:, None])
            grams[k].append(key)
            logp[k].append(np.log(p).astype(np.float32)[:, None])
            below = p
    ends = lambda parts: [np.cumsum([0, *map(len, p)]) for p in parts]
    join = lambda parts: [np.concatenate(p) for p in parts]
    return LanguageModels(
        langs, join(grams), join(logp), ends(grams), join(contexts[1:]), join(backoff[1:]), ends(contexts[1:]), unseen, np.full(len(langs), np.inf), np.ones((len(langs), 2)), LEAST, 1.0
    )


def nothing_learned() -> LanguageModels:
    """Models of no language: all texts are `und`, and only those without letters are rejected."""
    return LanguageModels([], [], [], [], [], [], [], np.zeros(0), np.zeros(0), np.zeros((0, 2)), LEAST, 1.0)


def _deviation(spread: np.ndarray, n: np.ndarray) -> np.ndarray:
    return np.sqrt(spread[:, 0] ** 2 + spread[:, 1] ** 2 / np.maximum(n, 1))


def _spread(off: np.ndarray, n: np.ndarray) -> np.ndarray:
    """From squared distances and lengths: deviation at short lengths goes by 1 / characters."""
    short = n <= np.median(n)
    a2 = off[~short].mean() if not short.all() else 0.0
    return np.sqrt([max(a2, 1e-4), max(np.mean(off[short] * n[short]), 1.0)])


def _calibrate(model: LanguageModels, trial: LanguageModels, totals: np.ndarray, truth: np.ndarray) -> LanguageModels:
    """The usual cross-entropy by language, its deviation by length, the cut and the scale that makes confidence fit
    accuracy, from samples' sums of the trial model's words() and their languages' numbers in it; it wasn't learned from
    them. Where a language has under 5 samples, the deviation is that of all; one without any has the highest usual
    cross-entropy of the others. With no sample at all only texts without letters are rejected."""
    n = totals[:, -1]
    ok = n > 0
    if not ok.any():
        return model
    entropy = -totals[:, :-2] / np.maximum(n, 1)[:, None]
    right = ok & (entropy.argmin(1) == truth)
    right = right if right.any() else ok
    h, m, lang = -totals[right, -2] / n[right], n[right], truth[right]
    usual = {j: np.median(h[lang == j]) for j in np.unique(lang).tolist()}
    off = (h - np.array([usual[j] for j in lang])) ** 2
    pooled, apart = _spread(off, m), np.var(list(usual.values()))
    spread = {j: _spread(off[lang == j], m[lang == j]) if (lang == j).sum() >= 5 else pooled for j in usual}
    z = np.sqrt(off) * np.sign(h - np.array([usual[j] for j in lang])) / _deviation(np.array([spread[j] for j in lang]), m)
    model.cut = max(float(np.quantile(z, KEPT)), LEAST) * (1 + FEW / len(z))
    for i, name in enumerate(model.langs):
        j = trial.langs.index(name) if name in trial.langs else -1
        model.mean[i] = usual.get(j, max(usual.values()))
        model.spread[i] = spread[j] if j in spread else np.sqrt(pooled**2 + [apart, 0])
    gap = np.sqrt(n)[:, None] * (entropy - entropy.min(1)[:, None])
    best = None
    for scale in (0.5, 1, 2, 4, 8):
        p = np.exp(-np.minimum(gap * scale, 700))
        p /= p.sum(1)[:, None]
        loss = -np.log(np.maximum(p[ok, truth[ok]], 1e-9)).mean()
        if best is None or loss < best[0]:
            best = loss, scale
    model.scale = float(best[1])
    return model


def learn(docs: DataFrame, learned_from, max_docs: int = MAX_DOCS, id_col="doc_id", text_col="text", lang_col="lang") -> LanguageModels:
    """Models from a bounded sample, by hash of the id, of the rows where the condition `learned_from` holds and text and
    language aren't null: about max_docs documents for each language, with all their words. N-grams are counted in Spark;
    the driver gets the distinct ones. A fifth of each language's sampled documents, up to a tenth of max_docs and one at
    least of two, is kept out of a trial model, on which they serve for calibration; the models returned have all."""
    rows = docs.where(learned_from & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = materialize(rows.groupBy("lang").count().withColumnRenamed("count", "of"), "languages")
    part = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 24))
    sample = rows.join(counts, "lang").where(part < F.lit((1 << 24) * max_docs) / F.col("of") + 1)
    own = Window.partitionBy("lang")
    few = F.when(F.col("m") > 1, F.greatest(F.lit(1), F.least(F.lit(max_docs // 10), F.floor(F.col("m") / 5)))).otherwise(0)
    ranked = sample.withColumn("rank", F.row_number().over(own.orderBy(F.xxhash64(F.lit("calibration"), F.col("id").cast("string")), F.xxhash64("text")))).withColumn("m", F.count(F.lit(1)).over(own))
    sample = materialize(ranked.select("text", "lang", (F.col("rank") <= few).alias("out")), "sample")
    model = fit_counts(_gram_counts(sample))
    trained = _gram_counts(sample.where(~F.col("out")))
    if not trained:
        return model
    trial = fit_counts(trained)
    return _calibrate(model, trial, *_sample_totals(sample.where("out"), trial))


def _sample_totals(samples: DataFrame, trial: LanguageModels) -> tuple[np.ndarray, np.ndarray]:
    """For the rows (text, lang) of languages that the model has: the sums of its words(), and the languages' numbers. The
    texts are read in tasks; the driver gets a row of numbers for each."""
    shared = samples.sparkSession.sparkContext.broadcast(trial)
    schema = pa.schema([("truth", pa.int32()), ("total", pa.list_(pa.float64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, langs = _cache(shared.value), shared.value.langs
        for b in batches:
            texts, truth = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in by_bytes(texts):
                words = [t.lower().split() for t in texts[i:j]]
                cache.fill(set().union(*words))
                totals = sums(cache.matrix, [cache.rows(ws) for ws in words])
                rows = [(langs.index(x), t) for x, t in zip(truth[i:j], totals.tolist(), strict=True) if x in langs]
                if rows:
                    yield batch(schema, *zip(*rows, strict=True))

    found = samples.select("text", "lang").mapInArrow(run, "truth int, total array<double>").toArrow()
    return np.array(found["total"].to_pylist(), np.float64).reshape(-1, len(trial.langs) + 2), np.array(found["truth"].to_pylist(), np.int64)


def _gram_counts(sample: DataFrame) -> dict[str, list[np.ndarray]]:
    """For each language the columns of _counts() of all words of (text, lang)."""
    names = ("k", "gram", "context", "shorter", "start", "n")
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
    schema = pa.schema([("lang", pa.string()), *zip(names, types, strict=True)])

    def counted(seen: dict) -> Iterator[pa.RecordBatch]:
        for lang, times in seen.items():
            columns = [c.view(np.int64) if c.dtype == np.uint64 else c for c in _counts(list(times), np.array(list(times.values())))]
            yield batch(schema, pa.array([lang] * len(columns[0])), *columns)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter, defaultdict

        seen: dict = defaultdict(Counter)
        size = 0
        for b in batches:
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if words := _LETTERS.findall(text.lower()):
                    seen[lang].update(words)
                    size += len(text)
                if size > 1 << 20:
                    yield from counted(seen)
                    seen.clear()
                    size = 0
        yield from counted(seen)

    grams = sample.select("text", "lang").mapInArrow(split, "lang string, k long, gram long, context long, shorter long, start boolean, n long")
    table = grams.groupBy("lang", "k", "gram").agg(F.min("context").alias("context"), F.min("shorter").alias("shorter"), F.max("start").alias("start"), F.sum("n").alias("n")).toArrow()
    which = table.column("lang").combine_chunks().dictionary_encode()
    codes, columns = which.indices.to_numpy(), [table.column(c).to_numpy() for c in names]
    columns = [c.view(np.uint64) if c_name in ("gram", "context", "shorter") else c for c_name, c in zip(names, columns, strict=True)]
    order = np.argsort(codes, kind="stable")
    ends = np.searchsorted(codes[order], np.arange(len(which.dictionary) + 1))
    return {lang: [c[order[ends[j] : ends[j + 1]]] for c in columns] for j, lang in enumerate(which.dictionary.to_pylist())}


def _cache(models: LanguageModels) -> RowCache:
    """Of this worker process."""
    # The cache holds the models, so no others can have their id meanwhile.
    return current(("languages", id(models)), lambda: RowCache(models.words, len(models.langs) + 2, CACHED_WORDS))


def _judged(cache: RowCache, models: LanguageModels, texts: list) -> Iterator[tuple]:
    """For ranges i..j-1 of the texts: i, j and what decide() gives."""
    for i, j in by_bytes(texts):
        words = [t.lower().split() if t else [] for t in texts[i:j]]
        cache.fill(set().union(*words))
        yield i, j, *models.decide(sums(cache.matrix, [cache.rows(ws) for ws in words]))


def identify(docs: DataFrame, models: LanguageModels, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, lang_pred, score, rejected. lang_pred is the language of the lowest cross-entropy, or `und` for a
    null text and one without letters; these, and texts unlike all languages, are rejected. Where no language was learned,
    all are `und`. Ids may be null or repeat; other columns aren't read."""
    shared = docs.sparkSession.sparkContext.broadcast(models)  # bounded by max_docs a language
    schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, names = _cache(shared.value), [*shared.value.langs, UNKNOWN]
        for b in batches:
            ids = b.column(0)
            for i, j, best, score, rejected in _judged(cache, shared.value, b.column(1).to_pylist()):
                yield batch(schema, ids.slice(i, j - i), [names[k] for k in best.tolist()], score, rejected)

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")


def keep_identified(docs: DataFrame, models: LanguageModels, text_col: str = "text") -> DataFrame:
    """The rows of docs whose text isn't rejected, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(models)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _cache(shared.value)
        for b in batches:
            rejected = [r for _, _, _, _, r in _judged(cache, shared.value, b.column(at).to_pylist())]
            yield b.filter(pa.array(~np.concatenate(rejected) if rejected else np.zeros(0, bool)))

    return docs.mapInArrow(run, docs.schema)


def held_out(id_col: str = "doc_id", parts: int = 3, which: int = 1):
    """Whether crc32 of the id as text leaves `which` by `parts`; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % parts == which, F.lit(False))


def query(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    try:
        models = learn(docs, F.col("doc_id").isNotNull() & ~held_out())
    except NothingToLearn:
        models = nothing_learned()
    out = identify(docs, models)
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
