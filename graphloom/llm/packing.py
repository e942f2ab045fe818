"""Best-fit decreasing packing of token sequences.

Tokens are made once and kept as a table of pieces. Which bin a piece goes to depends on its length alone, and there
are at most `size` lengths, so the driver runs best-fit decreasing on the histogram of lengths: a segment tree over
remaining capacities finds the tightest open bins in logarithmic time, and pieces of one length that the rule puts into
alike bins are placed together. The plan has the same bins as placing the pieces of all documents one by one, but its
size depends on the number of lengths only. Pieces find their places by their rank among those of their length, which
is counted in each task and added up over tasks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, by_bytes, documents, materialize
from .word_bpe import WordBpe
from .wordcache import WordCache, current

SIZE = 2048
CACHED_WORDS = 400_000


class CapacityTree:
    """For each remaining capacity 0..size, groups of alike open bins: [first, count, used offset]. The segment tree has
    at each node whether any capacity below it has open bins."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.open = [0] * (2 * self.leaves)
        self.groups: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def add(self, capacity: int, first: int, count: int) -> None:
        self.groups[capacity].append((first, count))
        i = capacity + self.leaves
        while i and not self.open[i]:
            self.open[i] = 1
            i >>= 1

    def take(self, capacity: int) -> tuple[int, int]:
        """Takes out a group of bins with this remaining capacity."""
        out = self.groups[capacity].pop()
        if not self.groups[capacity]:
            i = capacity + self.leaves
            self.open[i] = 0
            while (i := i >> 1) and not (self.open[2 * i] or self.open[2 * i + 1]):
                self.open[i] = 0
        return out

    def tightest(self, length: int) -> int:
        """The least capacity of at least `length` that has open bins, or -1."""
        i = length + self.leaves
        if self.open[i]:
            return length
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.leaves
            i >>= 1
        return -1


def best_fit_decreasing(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, low, high, per_bin, first, offset): the pieces of that length with ranks low..high-1 go, per_bin to
    a bin, into the bins from `first` on, the first of each bin at `offset`.

    One by one, best fit keeps filling the tightest bin with pieces of one length until it takes no more, since the bin
    stays the tightest; then it turns to the next bin alike. Hence the steps of many bins at once here.
    """
    tree, plan, bins = CapacityTree(size), [], 0
    for length in sorted((n for n, count in histogram.items() if count), reverse=True):
        if not 0 < length <= size:
            raise ValueError(f"a piece of {length} tokens; the most is {size}")
        rank, left = 0, histogram[length]
        while left:
            capacity = tree.tightest(length)
            if capacity < 0:
                capacity = size
                first, count = bins, -(-left // (size // length))
                bins += count
            else:
                first, count = tree.take(capacity)
            per_bin = capacity // length
            if full := min(count, left // per_bin):
                plan.append((length, rank, rank + full * per_bin, per_bin, first, size - capacity))
                tree.add(capacity - per_bin * length, first, full)
                rank, left = rank + full * per_bin, left - full * per_bin
            if full < count and left:  # under per_bin pieces are left
                plan.append((length, rank, rank + left, left, first + full, size - capacity))
                tree.add(capacity - left * length, first + full, 1)
                full, rank, left = full + 1, rank + left, 0
            if full < count:
                tree.add(capacity, first + full, count - full)
    return plan


def _cache(path: str) -> WordCache:
    """Of this worker process: the words' ids as bytes of unsigned 32-bit numbers."""
    return current(("word ids", path), lambda: WordCache(WordBpe(path).encode, CACHED_WORDS))


def _words(text: str | None) -> list[str]:
    """The words of a text; A-Z in lower case where that can't change how characters compose."""
    if not text:
        return []
    try:
        text = text.encode("latin-1").lower().decode("latin-1")
    except UnicodeEncodeError:
        pass
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def token_pieces(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, shard, nth): the documents' ids, then end_id, cut at every `size` ids.

    The tokenizer drops white space and splits there before all else, so a text's ids are its words' ids one after the
    other. nth counts the pieces of one length in a shard (the task) from 0. A null text is empty: one piece, end_id.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("shard", pa.int32()), ("nth", pa.int64())])
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, nth, cache = TaskContext.get().partitionId(), {}, _cache(tokenizer)
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for i, j in by_bytes(texts):
                words = [_words(t) for t in texts[i:j]]
                cache.fill(set().union(*words))
                get, rows = cache.table.__getitem__, []
                for doc, ws in zip(ids[i:j], words, strict=True):
                    data = b"".join(map(get, ws)) + end
                    for k, at in enumerate(range(0, len(data), 4 * size)):
                        cut = data[at : at + 4 * size]
                        n = len(cut) // 4
                        nth[n] = nth.get(n, -1) + 1
                        rows.append((doc, k, at // 4, n, zlib.crc32(cut), shard, nth[n]))
                yield batch(schema, *zip(*rows, strict=True))

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, shard int, nth long")


def pack(pieces: DataFrame, size: int = SIZE) -> DataFrame:
    """pieces (a table with columns length, shard and nth, as token_pieces() makes it) with sequence_id and offset.

    Sequences are as many as best-fit decreasing over all pieces opens. An empty table gives no rows.
    """
    spark = pieces.sparkSession
    counts = pieces.groupBy("length", "shard").agg((F.max("nth") + 1).alias("n"))
    base = counts.select("length", "shard", (F.sum("n").over(Window.partitionBy("length").orderBy("shard")) - F.col("n")).alias("base"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    plan = spark.createDataFrame(best_fit_decreasing(histogram, size), "length long, low long, high long, per_bin long, first long, at long")
    ranked = pieces.join(base, ["length", "shard"]).withColumn("rank", F.col("base") + F.col("nth"))
    p, x = ranked.alias("p"), F.broadcast(plan).alias("x")
    k = F.col("rank") - F.col("low")
    rows = p.join(x, (F.col("p.length") == F.col("x.length")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return rows.select("p.*", (F.col("first") + F.floor(k / F.col("per_bin"))).alias("sequence_id"), (F.col("at") + k % F.col("per_bin") * F.col("p.length")).alias("offset")).drop("base", "rank", "shard", "nth")


def pack_documents(docs: DataFrame, tokenizer: str, size: int = SIZE, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Rows with a null or repeated id are
    packed like any other; other columns aren't read."""
    return pack(materialize(token_pieces(docs, tokenizer, size, end_id, id_col, text_col), "pieces"), size)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), default_tokenizer())
