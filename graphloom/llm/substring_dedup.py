"""Substring dedup over a log-structured index of fingerprints.

A window is 20 consecutive words. Its anchor is the place of the least hash among its 6-word grams, so equal windows
have equal anchors at equal places; neighbouring windows mostly share one. All windows that an anchor is chosen by lie
in its context, which has a hash of its own. A run of the index has, sorted by gram hash, the first place of each
context of a batch of documents; runs are never changed.

A new batch is merge-joined by gram hash with the runs before it. Of a context that came before, all windows are
repeats. Where one gram has several contexts, windows may be equal though contexts differ; such windows are hashed
whole, from the texts. Windows count as equal if their hashes over all 20 words and those of their grams, two 64-bit
hashes, are equal: that verifies what the sampled fingerprints found. Runs are compacted into one when they become more
than MAX_RUNS. An index can be saved and opened again, to add later batches.

What single tasks could gather of a frequent passage is bounded: a range of texts passes on one row of each context or
window, the first; its other places are repeats already. Grams on very many rows are found by Misra-Gries summaries. They
are kept apart: their contexts are dealt by gram and context, and are all candidates, without a merge-join.
"""

from __future__ import annotations

import hashlib
import itertools
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch, by_bytes, documents, materialize, ordered, restored, scratch_path
from .exact_dedup import heavy_candidates
from .filters import has, key_filter, pair_key
from .wordcache import release_memory

WORDS, GRAM = 20, 6
#: The documents go into the index in batches that end at these quantiles of their numbers.
BATCHES, MAX_RUNS = (0.5,), 3
#: Grams that are kept apart, at most.
HEAVY = 1024
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


class _Texts:
    """Words of some texts one after the other, with hashes of grams and windows, and the anchors."""

    def __init__(self, words: list[list[bytes]]):
        import xxhash

        self.lengths = np.array([len(w) for w in words], np.int64)
        n = int(self.lengths.sum())
        h = np.fromiter(map(xxhash.xxh3_64_intdigest, itertools.chain.from_iterable(words)), np.uint64, n)
        ends = np.cumsum(self.lengths)
        starts = ends - self.lengths
        self.empty = n < WORDS
        if self.empty:
            return
        gram = self._rolled(h, GRAM, _A)
        self.window = self._rolled(h, WORDS, _B)
        gram = (gram ^ (gram >> np.uint64(32))) * _C
        self.gram = gram
        # For each window the place of its least gram, leftmost of equals: minima over 2, 4, 8 and then WIDTH grams.
        width, size, value, place = WORDS - GRAM + 1, 1, gram, np.arange(len(gram))
        while size < width:
            step = min(size, width - size)
            later = value[step:] < value[:-step]
            place = np.where(later, place[step:], place[:-step])
            value = np.where(later, value[step:], value[:-step])
            size += step
        doc = np.repeat(np.arange(len(words)), self.lengths)
        whole = doc[: n - WORDS + 1] == doc[WORDS - 1 :]
        self.start = np.flatnonzero(whole)  # of each window, in the words of all texts
        self.doc = doc[self.start]
        self.at = self.start - starts[self.doc]
        self.anchor = place[self.start]
        if not len(self.start):
            self.empty = True
            return
        first = np.flatnonzero(np.concatenate(([True], (self.anchor[1:] != self.anchor[:-1]) | (self.doc[1:] != self.doc[:-1]))))
        last = np.append(first[1:], len(self.start)) - 1
        self.first, self.last = first, last  # windows of each context
        low, high, anchor = self.start[first], self.start[last], self.anchor[first]
        # Windows of one context overlap, so the first and the last of them tell all of its words.
        mixed = self.window[low] * _A + self.window[high] * _B + ((anchor - low) * 64 + (high - low)).astype(np.uint64) * _C
        self.context = mixed ^ (mixed >> np.uint64(31))

    @staticmethod
    def _rolled(h: np.ndarray, n: int, factor: np.uint64) -> np.ndarray:
        out = np.zeros(len(h) - n + 1, np.uint64)
        for j in range(n):
            out = out * factor + h[j : len(h) - n + 1 + j]
        return out ^ (out >> np.uint64(29))


def _firsts(keys: list[np.ndarray], doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each distinct key the row with the least (doc, at), and all other rows."""
    order = np.lexsort((at, doc, *keys))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    return order[new], order[~new]


_PLACES = pa.schema([("g", pa.int64()), ("h", pa.int64()), ("doc", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("repeat", pa.bool_())])
_PLACES_SQL = "g long, h long, doc long, low long, high long, repeat boolean"


class _Frequent:
    """A Misra-Gries summary of numbers, fed with arrays."""

    def __init__(self, k: int):
        self.k, self.items, self.low = k, np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def add(self, values: np.ndarray) -> None:
        items, low = np.unique(values, return_counts=True)
        items, place = np.unique(np.concatenate((self.items, items)), return_inverse=True)
        low = np.bincount(place, np.concatenate((self.low, low))).astype(np.int64)
        if len(items) > self.k:  # taking the (k+1)th largest count from all is as good as one by one
            low -= np.partition(low, -self.k - 1)[-self.k - 1]
        self.items, self.low = items[low > 0], low[low > 0]


def _places(docs: DataFrame, chosen=None) -> DataFrame:
    """Rows (g, h, doc, low, high, repeat) of the contexts in documents (doc, text as binary): h is the context's hash,
    low and high the first words of its first and last window. With filters `chosen` of (doc, low) and of doc: of the
    single windows in the chosen contexts, h being the window's hash. repeat: this isn't the first place in its range of
    texts. Without filters also rows without doc: of the frequent grams of the task, h being a count as a Misra-Gries
    summary has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, of_docs = (None, None) if chosen is None else chosen.value
        frequent = _Frequent(HEAVY)
        release_memory()
        for b in batches:
            ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            if of_docs is not None:
                use = np.flatnonzero(has(of_docs, ids))
                ids, texts = ids[use], [texts[k] for k in use.tolist()]
            for i, j in by_bytes(texts, 4 << 20):
                t = _Texts([x.split() if x else [] for x in texts[i:j]])
                if t.empty:
                    continue
                own = ids[i:j]
                doc, low, high = own[t.doc[t.first]], t.at[t.first], t.at[t.last]
                g, h = t.gram[t.anchor[t.first]], t.context
                if bits is not None:
                    use = np.flatnonzero(has(bits, pair_key(doc, low)))
                    if not len(use):
                        continue
                    times = (t.last - t.first + 1)[use]
                    w = np.repeat(t.first[use] - np.concatenate(([0], np.cumsum(times)[:-1])), times) + np.arange(times.sum())
                    doc, low, g, h = own[t.doc[w]], t.at[w], np.repeat(g[use], times), t.window[t.start[w]]
                    high = low
                one, rest = _firsts([g, h], doc, low)
                if bits is None:
                    frequent.add(g[one])
                for rows, repeat in ((one, False), (rest, True)):
                    if len(rows):
                        yield batch(_PLACES, g[rows].view(np.int64), h[rows].view(np.int64), doc[rows], low[rows], high[rows], np.full(len(rows), repeat))
        if len(frequent.items):
            none = pa.nulls(len(frequent.items))
            yield batch(_PLACES, frequent.items.view(np.int64), frequent.low, *(none.cast(f.type) for f in list(_PLACES)[2:]))

    return docs.select("doc", "text").mapInArrow(run, _PLACES_SQL)


_RUN = "k bigint, g bigint, h bigint, doc bigint, low bigint, high bigint"


class FingerprintIndex:
    """Sorted immutable runs of the contexts of documents seen so far, in the shared folder."""

    def __init__(self, spark, max_runs: int | None = None, path: str | None = None):
        self.spark, self.max_runs = spark, MAX_RUNS if max_runs is None else max_runs
        self.path, self.runs, self.compacted = path or scratch_path(spark, "fingerprints"), [], 0
        self.buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.texts: DataFrame | None = None

    def save(self) -> None:
        """Writes the names of the runs beside them."""
        about = json.dumps({"runs": self.runs, "buckets": self.buckets, "max_runs": self.max_runs})
        self.spark.createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/_index")

    @classmethod
    def open(cls, spark, path: str, texts: DataFrame) -> FingerprintIndex:
        """A saved index, with the documents (doc, text as binary) that are in it."""
        about = json.loads(spark.read.text(f"{path}/_index").first()[0])
        index = cls(spark, about["max_runs"], path)
        index.runs, index.buckets, index.texts = about["runs"], about["buckets"], texts
        for name in index.runs:
            spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({_RUN}) USING parquet CLUSTERED BY (k) SORTED BY (k) INTO {index.buckets} BUCKETS LOCATION '{path}/{name}'")
        return index

    def _write(self, rows: DataFrame, heavy: DataFrame) -> str:
        """A run: rows (k, g, h, doc, low, high), bucketed and sorted by k, so that joins by k need no exchange. k is g, but
        for heavy grams it is mixed with h, so that no bucket gets all of such a gram."""
        name = f"fingerprints_{uuid.uuid4().hex}"
        keyed = rows.join(F.broadcast(heavy.withColumn("heavy", F.lit(True))), "g", "left")
        keyed = keyed.select(F.when(F.col("heavy"), F.xxhash64("g", "h")).otherwise(F.col("g")).alias("k"), "g", "h", "doc", "low", "high")
        (keyed.repartition(self.buckets, "k").sortWithinPartitions("k").write.option("path", f"{self.path}/{name}").option("compression", "zstd").bucketBy(self.buckets, "k").sortBy("k").saveAsTable(name))
        return name

    def add(self, docs: DataFrame) -> DataFrame:
        """Adds a batch of documents (doc, text as binary), whose ids are greater than all before. Returns spans (doc, low,
        high) of the windows that came earlier, low and high being the first words of the first and last window."""
        spark = self.spark
        found = materialize(_places(docs), "contexts")
        sums = found.where("doc IS NULL").groupBy("g").agg(F.sum("h").alias("low")).where("low > 1").orderBy(F.desc("low"), "g").limit(HEAVY)
        heavy = spark.createDataFrame([(r.g,) for r in sums.collect()], "g long")  # at most HEAVY rows
        found = found.where("doc IS NOT NULL")
        new = found.where(~F.col("repeat")).drop("repeat")
        name = self._write(new, heavy)
        run = spark.table(name)
        repeats = [found.where("repeat").select("doc", "low", "high")]
        plain = run.where("k = g")
        several = plain.groupBy("k").agg(F.count("*").alias("n")).where("n > 1").select("k", F.lit(True).alias("several"))
        mine = plain.join(several, "k", "left")
        places = ("g", "h", "doc", "low", "high", "new")
        candidates = run.where("k <> g").withColumn("new", F.lit(True)).select(*places)
        hit = F.coalesce(F.col("several"), F.lit(False))
        for i, r in enumerate(self.runs):  # the merge-joins
            history = spark.table(r)
            # Grams that are heavy in either are all candidates, wherever they are; the others are found by k.
            apart = history.select("g", "k").where("k <> g").select("g").distinct().withColumn(f"apart{i}", F.lit(True))
            mine = mine.join(history.where("k = g").select("k").distinct().withColumn(f"in{i}", F.lit(True)), "k", "left")
            mine = mine.join(materialize(apart, "apart"), "g", "left")
            hit = hit | F.coalesce(F.col(f"in{i}"), F.col(f"apart{i}"), F.lit(False))
            light = history.where("k = g").join(plain.select("k"), "k", "left_semi")
            other = history.where("k <> g").unionByName(history.where("k = g").join(F.broadcast(heavy), "g", "left_semi"))
            candidates = candidates.unionByName(light.unionByName(other).withColumn("new", F.lit(False)).select(*places))
        candidates = candidates.unionByName(mine.where(hit).withColumn("new", F.lit(True)).select(*places))
        nth = F.row_number().over(Window.partitionBy("g", "h").orderBy("doc", "low"))
        ranked = materialize(candidates.withColumn("nth", nth), "candidates")
        repeats.append(ranked.where("nth > 1 AND new").select("doc", "low", "high"))
        # Grams with several contexts: their windows one by one.
        firsts = ranked.where("nth = 1")
        mixed = materialize(firsts.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g"), "mixed")
        edges = firsts.join(mixed, "g", "left_semi")
        self.texts = docs if self.texts is None else self.texts.unionByName(docs)
        chosen = spark.sparkContext.broadcast((key_filter(edges, "doc", "low"), key_filter(edges, "doc")))
        windows = _places(self.texts, chosen)
        fresh = docs.agg(F.min("doc")).first()[0]
        ranked = windows.where(~F.col("repeat")).withColumn("nth", F.row_number().over(Window.partitionBy("g", "h").orderBy("doc", "low")))
        both = ranked.where("nth > 1").drop("nth").unionByName(windows.where("repeat"))
        if fresh is not None:
            repeats.append(materialize(both.where(F.col("doc") >= fresh).select("doc", "low", "high"), "windows"))
        self.runs.append(name)
        if len(self.runs) > self.max_runs:
            self.compact()
        out = repeats[0]
        for r in repeats[1:]:
            out = out.unionByName(r)
        return out

    def compact(self) -> None:
        """Makes one run of all; of a context that several have, the first place stays."""
        rows = self.spark.table(self.runs[0])
        for r in self.runs[1:]:
            rows = rows.unionByName(self.spark.table(r))
        first = rows.groupBy("g", "h").agg(F.min(F.struct("doc", "low", "high")).alias("f")).select("g", "h", "f.*")
        heavy = self.spark.createDataFrame([(int(x),) for x in heavy_candidates(rows.select("g"), "g", HEAVY)], "g long")
        merged = self._write(first, heavy)
        self.drop()
        self.runs = [merged]
        self.compacted += 1

    def drop(self) -> None:
        for r in self.runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {r}")
        self.runs = []


def repeated_spans(rows: DataFrame, batches: int | tuple[float, ...] | None = None) -> DataFrame:
    """(doc, spans): for each document of rows (doc, text as binary) with windows that came earlier, the arrays of (low,
    high) as FingerprintIndex.add() has them. The documents go into the index in batches, so many or with ends at these
    quantiles of doc."""
    spark = rows.sparkSession
    index = FingerprintIndex(spark)
    batches = BATCHES if batches is None else batches
    ends = [k / batches for k in range(1, batches)] if isinstance(batches, int) else list(batches)
    cuts = rows.approxQuantile("doc", ends, 0.01) if ends else []
    bounds = [None, *sorted({int(c) for c in cuts}), None]
    spans = None
    for low, high in itertools.pairwise(bounds):
        part = rows.select("doc", "text")
        part = part if low is None else part.where(F.col("doc") > low)
        part = part if high is None else part.where(F.col("doc") <= high)
        found = index.add(part)
        spans = found if spans is None else spans.unionByName(found)
    try:
        return materialize(spans.groupBy("doc").agg(F.collect_list(F.struct("low", "high")).alias("spans")), "spans")
    finally:
        index.drop()


def _kept(words: list[bytes], spans) -> list[bytes]:
    gone = np.zeros(len(words) + 1, np.int32)
    low = np.array([s["low"] for s in spans], np.int64)
    high = np.array([s["high"] for s in spans], np.int64) + WORDS
    np.add.at(gone, low, 1)
    np.add.at(gone, high, -1)
    keep = np.cumsum(gone[:-1]) == 0
    return list(itertools.compress(words, keep.tolist()))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int | tuple[float, ...] | None = None, with_text: bool = False) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 of the kept words joined by one space; with_text also kept_text
    (null where nothing goes).

    A word goes if it is in a window whose words also stand at an earlier place: in a document of a smaller id, or before
    in the same. Null texts have no words. Where ids repeat or are null, rows are ordered by id (nulls last), then by the
    text's hash; of rows equal in both, either may be the earlier. Other columns aren't read.
    """
    rows = ordered(docs, id_col, text_col)
    spans = repeated_spans(rows, batches)
    bits = docs.sparkSession.sparkContext.broadcast(key_filter(spans, "doc"))
    schema = pa.schema([("doc", pa.int64()), ("id", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()), ("text", pa.binary())])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents without spans are done here; only the others' texts go on to the join."""
        for b in batches:
            docs, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(2).to_pylist()
            maybe = has(bits.value, docs).tolist() if len(docs) else []
            n, sha = [], []
            for t, m in zip(texts, maybe, strict=True):
                words = t.split() if t else []
                n.append(len(words))
                sha.append(None if m else hashlib.sha256(b" ".join(words)).hexdigest())
            yield batch(schema, b.column(0), b.column(1), n, sha, [t if m else None for t, m in zip(texts, maybe, strict=True)])

    out_schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            removed, shas, kept_texts = [], [], []
            for n, sha, text, s in zip(*(b.column(i).to_pylist() for i in range(1, 5)), strict=True):
                words = _kept(text.split(), s) if s else text.split() if text and sha is None else None
                kept = None if words is None else b" ".join(words)
                shas.append(sha or hashlib.sha256(kept or b"").hexdigest())
                removed.append(n - len(words) if s else 0)
                kept_texts.append(kept.decode("utf-8", "replace") if s and with_text else None)
            yield batch(out_schema, b.column(0), b.column(1), removed, shas, kept_texts)

    looked = rows.select("doc", F.col("id").cast("long"), "text").mapInArrow(look, "doc long, id long, n_words long, sha string, text binary")
    joined = looked.join(spans, "doc", "left").select("id", "n_words", "sha", "text", "spans")
    out = joined.mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out if with_text else out.drop("kept_text")


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars", batches: int | tuple[float, ...] | None = None) -> DataFrame:
    """docs with the repeated words cut out of their texts: where words go, the text is the others joined by one space,
    and the length column, if there is one, is the new text's. Every row stays, even one that loses all of its words."""
    rows = ordered(docs, id_col, text_col, rest=True)
    spans = repeated_spans(rows, batches)
    joined = rows.join(spans, "doc", "left").select("text", "rest", "spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            for i, s in enumerate(b.column("spans").to_pylist()):
                if s:
                    texts[i] = b" ".join(_kept(texts[i].split(), s))
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), b.column("rest"), b.column("spans").is_valid()], names=["text", "rest", "cut"])

    kinds = dict(joined.dtypes)
    made = joined.mapInArrow(cut, f"text binary, rest {kinds['rest']}, cut boolean")
    out = restored(made, docs, text_col) if length_col not in docs.columns else made.select(
        *[F.col("text").cast("string").alias(c) if c == text_col else F.when(F.col("cut"), F.length(F.col("text").cast("string"))).otherwise(F.col(f"rest.`{c}`")).cast(docs.schema[c].dataType).alias(c) if c == length_col else F.col(f"rest.`{c}`") for c in docs.columns]
    )
    return out


def query(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(documents(spark, sf_dir))


SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
win AS (SELECT doc_id, s, list_slice(words, s, s + {WORDS - 1}) AS k FROM (SELECT doc_id, words, unnest(range(1, len(words) - {WORDS - 2})) AS s FROM d WHERE len(words) >= {WORDS})),
dup AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, s + o AS p FROM dup, range({WORDS}) t(o)),
w AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS p FROM d),
k AS (SELECT doc_id, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY w.p) FILTER (WHERE gone.p IS NULL) AS kept FROM w LEFT JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""
