"""A quality classifier of supervised subword embeddings.

A text is the mean of learned vectors of its words and of their character n-grams, both hashed into buckets, and of a
pseudo-word for each word that repeats the one before it; a softmax layer gives the probabilities of the labels. Vectors
and layer are trained together by stochastic gradient descent in numpy on a bounded sample of labelled rows. To score, a
word's vectors are added up once and remembered, so a text costs a look-up and a row addition for each word.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, by_bytes, documents
from .language_id import held_out
from .wordcache import RowCache, current, sums

BUCKETS, WIDTH, GRAMS = 1 << 17, 16, (3, 4, 5)
#: Bound of what is learned from: documents of each label.
MAX_DOCS = 2000
EPOCHS, RATE = 12, 0.6
CACHED_WORDS = 250_000
THRESHOLD = 0.3
REPEAT = 0  # the bucket of the pseudo-word
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word number, bucket) of all features of distinct words: the word itself and its n-grams with its borders."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    code = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(code)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    unit = (code + np.uint64(1)) * _B
    owners, buckets = [], []

    def add(h, of):
        h = (h ^ (h >> np.uint64(31))) * _A
        owners.append(of)
        buckets.append(1 + (h >> np.uint64(20)).astype(np.int64) % (BUCKETS - 1))

    power = _A ** (place.astype(np.uint64) + np.uint64(1))
    starts = np.cumsum(lengths) - lengths
    add(np.add.reduceat(unit * power, starts) + np.uint64(7), np.arange(len(words)))
    h = unit
    for n in range(2, max(GRAMS) + 1):
        h = np.concatenate((unit[:1], h[:-1])) * _A + unit
        if n in GRAMS:
            at = np.flatnonzero(place >= n - 1)
            add(h[at] + np.uint64(n), owner[at])
    return np.concatenate(owners), np.concatenate(buckets)


@dataclass
class QualityModel:
    vectors: np.ndarray  # [BUCKETS, WIDTH]
    layer: np.ndarray  # [WIDTH, 2]
    bias: np.ndarray  # [2]

    def words(self, words: list[str]) -> np.ndarray:
        """For each word: the sum of its features' vectors, and their number."""
        out = np.zeros((len(words), WIDTH + 1), np.float32)
        for i in range(0, len(words), 1 << 14):
            some = words[i : i + (1 << 14)]
            owner, bucket = features(some)
            order = np.argsort(owner, kind="stable")
            count = np.bincount(owner, minlength=len(some))
            out[i : i + len(some), :WIDTH] = np.add.reduceat(self.vectors[bucket[order]], np.cumsum(count) - count)
            out[i : i + len(some), WIDTH] = count
        return out

    def score(self, total: np.ndarray, repeats: np.ndarray) -> np.ndarray:
        """Probability of label 1 from texts' sums of words() and their numbers of repeated words."""
        hidden = (total[:, :WIDTH] + repeats[:, None] * self.vectors[REPEAT]) / np.maximum(total[:, WIDTH] + repeats, 1)[:, None]
        z = hidden @ self.layer + self.bias
        return 1 / (1 + np.exp(np.clip(z[:, 0] - z[:, 1], -700, 700)))


def train(docs: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = EPOCHS, rate: float = RATE, seed: int = 1) -> QualityModel:
    """From (label, distinct buckets, their shares of the text's features): stochastic gradient descent, one document at a
    time in random order, with a rate that falls to zero."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (BUCKETS, WIDTH)).astype(np.float32)
    layer, bias = np.zeros((WIDTH, 2), np.float32), np.zeros(2, np.float32)
    steps, done = max(1, epochs * len(docs)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            label, bucket, share = docs[i]
            lr = np.float32(rate * (1 - done / steps))
            done += 1
            hidden = share @ vectors[bucket]
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = layer @ p
            layer -= lr * np.outer(hidden, p)
            bias -= lr * p
            vectors[bucket] -= lr * share[:, None] * back
    return QualityModel(vectors, layer, bias)


def _repeats(rows: np.ndarray) -> int:
    return int((rows[1:] == rows[:-1]).sum())


def learn(docs: DataFrame, labels: DataFrame, learned_from, max_docs: int = MAX_DOCS, id_col="doc_id", text_col="text", label_col="quality") -> QualityModel:
    """A model from a bounded sample, by hash of the id: about max_docs documents of each label, of the rows of labels
    where the condition `learned_from` holds. A null text is empty. With one label only, or none, scores are constant."""
    known = labels.where(learned_from & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    counts = {r.label: r["count"] for r in known.groupBy("label").count().collect()}
    part = F.pmod(F.xxhash64(F.lit("quality"), F.col("id").cast("string")), F.lit(1 << 24))
    cut = {k: min(1 << 24, int((1 << 24) * max_docs / n) + 1) for k, n in counts.items()}
    chosen = known.where(part < F.when(F.col("label") == 1, cut.get(1, 0)).otherwise(cut.get(0, 0))).dropDuplicates(["id"])
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id").select("label", "text")
    schema = pa.schema([("label", pa.int32()), ("bucket", pa.list_(pa.int32())), ("share", pa.list_(pa.float32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for label, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = (text or "").split()
                names = {w: i for i, w in enumerate(dict.fromkeys(words))}
                rows = np.fromiter(map(names.__getitem__, words), np.int64, len(words))
                owner, bucket = features(list(names))
                weight = np.bincount(rows, minlength=len(names))[owner].astype(np.float64)
                bucket, weight = np.append(bucket, REPEAT), np.append(weight, _repeats(rows))
                distinct, place = np.unique(bucket, return_inverse=True)
                total = np.bincount(place, weight)
                out.append((label, distinct.astype(np.int32), (total / max(total.sum(), 1)).astype(np.float32)))
            yield batch(schema, *zip(*out, strict=True))

    found = sample.mapInArrow(run, "label int, bucket array<int>, share array<float>").toArrow()
    return train([(x, np.asarray(y, np.int32), np.asarray(z, np.float32)) for x, y, z in zip(found["label"].to_pylist(), _lists(found["bucket"]), _lists(found["share"]), strict=True)])


def _lists(column: pa.ChunkedArray) -> Iterator[np.ndarray]:
    for chunk in column.chunks:
        for v in chunk:
            yield v.values.to_numpy(zero_copy_only=False)


def score(docs: DataFrame, model: QualityModel, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, score (probability of label 1), predicted. An empty or null text has no features, so its score is
    that of the bias alone. Ids may be null or repeat; other columns aren't read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x WIDTH numbers
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        cache = current(("quality", id(m)), lambda: RowCache(m.words, WIDTH + 1, CACHED_WORDS))
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in by_bytes(texts):
                words = [t.split() if t else [] for t in texts[i:j]]
                cache.fill(set().union(*words))
                rows = [cache.rows(ws) for ws in words]
                p = m.score(sums(cache.matrix, rows), np.array([_repeats(r) for r in rows], np.float64))
                yield batch(schema, ids[i:j], p, (p >= threshold).astype(np.int32))

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, score double, predicted int")


def query(spark, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = learn(docs, labels, F.col("doc_id").isNotNull() & ~held_out(parts=5, which=0))
    return score(docs, model).select("doc_id", held_out(parts=5, which=0).alias("held_out"), "score", "predicted")
