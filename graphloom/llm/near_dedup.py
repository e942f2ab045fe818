"""MinHash near-dedup by a multi-index Hamming join.

A document's signature has SLOTS b-bit minima. It is split into chunks, 13 or, for similarities under 0.85, 16.
Documents are candidates if their signatures differ in at most 25 slots, or 31: by the pigeonhole principle, they then
differ in at most one slot of some chunk. A chunk's allowed errors are enumerated by leaving out each of its slots in
turn, so all pairs under the threshold share a key. For documents whose sets have the least similarity that is linked,
0.85 or 0.8, the chance that signatures differ in more slots is under one in a million.

Documents of equal sets are one from the start. Then every document of a key is held against the key's first one
(linear in rows, however many share the key); candidates are confirmed on the full sets, and links make components. Only
in keys whose documents are still of several components all pairs across these are compared, by signature within a
task. Documents that are candidates there form families. Keys and families are dealt out as pairs of blocks of ids and
signatures, families by their sets' sizes too; the texts of those documents that have a candidate of another component in
a pair of blocks follow, and their full sets are compared as rows of a matrix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, by_bytes, documents, materialize, ordered, restored
from .components import connected_components
from .filters import has, key_filter
from .wordcache import release_memory

SLOTS = 64
#: Rows of a block, where keys are dealt out as pairs of blocks and hubs' documents as parts; those of a family's block, and
#: about how many shingles it has at most.
BLOCK, FAMILY_BLOCK, BLOCK_SHINGLES = 2000, 400, 1_000_000
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)
_RNG = np.random.default_rng(20240229)
_FACTORS = _RNG.integers(1, 1 << 63, SLOTS, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_ADDED = _RNG.integers(1, 1 << 63, SLOTS, dtype=np.int64).astype(np.uint64)


def chunks_for(percent: int) -> int:
    return 13 if percent >= 85 else 16


def _most(chunks: int) -> int:
    """Slots in which candidates may differ."""
    return 2 * chunks - 1


def shingle_sets(words: list[list[bytes]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of texts of words, as 64-bit hashes, one text after the other; and how many each has. With
    fewer words than `size`, all of them are one shingle."""
    import itertools

    import xxhash

    lengths = np.array([len(w) for w in words], np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, itertools.chain.from_iterable(words)), np.uint64, int(lengths.sum()))
    ends = np.cumsum(lengths)
    out_h, out_d = [], []
    if len(h) >= size:
        g = np.zeros(len(h) - size + 1, np.uint64)
        for j in range(size):
            g = g * _A + h[j : len(h) - size + 1 + j] * _B
            g ^= g >> np.uint64(29)
        doc = np.repeat(np.arange(len(words)), lengths)
        whole = doc[: len(g)] == doc[size - 1 :]
        out_h.append(g[whole])
        out_d.append(doc[: len(g)][whole])
    for i in np.flatnonzero((lengths > 0) & (lengths < size)).tolist():
        one = xxhash.xxh3_64_intdigest(b" ".join(words[i]), seed=size)
        out_h.append(np.array([one], np.uint64))
        out_d.append(np.array([i]))
    if not out_h:
        return np.zeros(0, np.uint64), np.zeros(len(words), np.int64)
    g, doc = np.concatenate(out_h), np.concatenate(out_d)
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[new], np.bincount(doc[new], minlength=len(words)).astype(np.int64)


def _split(texts: list[bytes | None]) -> list[list[bytes]]:
    return [t.lower().split() if t else [] for t in texts]  # of bytes: A-Z only, and white space of ASCII


_SIGNED = pa.schema([("doc", pa.int64()), ("id", pa.int64()), ("n_shingles", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("signature", pa.binary())])


def signatures(rows: DataFrame, size: int) -> DataFrame:
    """(doc, id, n_shingles, d1, d2, signature) of rows (doc, id, text as binary): d1 and d2 are digests of the whole set,
    the signature SLOTS unsigned 16-bit minima; null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for b in batches:
            texts = b.column(2).to_pylist()
            for i, j in by_bytes(texts, 1 << 20):
                sets, counts = shingle_sets(_split(texts[i:j]), size)
                some = np.flatnonzero(counts)
                starts = (np.cumsum(counts) - counts)[some]
                d = np.zeros((2, j - i), np.int64)
                signed: list[bytes | None] = [None] * (j - i)
                if len(some):
                    for k, f in enumerate((_B, _C)):
                        m = (sets ^ (sets >> np.uint64(32))) * f
                        d[k, some] = np.add.reduceat(m ^ (m >> np.uint64(29)), starts).view(np.int64)
                    minima = np.empty((len(some), SLOTS), "<u2")
                    for k in range(SLOTS):
                        m = (sets * _FACTORS[k] + _ADDED[k]) >> np.uint64(20)
                        # The low bits of the least value; those above decide which it is.
                        minima[:, k] = np.minimum.reduceat(m, starts).astype(np.uint16)
                    for r, s in enumerate(some.tolist()):
                        signed[s] = minima[r].tobytes()
                yield batch(_SIGNED, b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), counts, d[0], d[1], pa.array(signed, pa.binary()))

    return rows.select("doc", F.col("id").cast("long"), "text").mapInArrow(run, "doc long, id long, n_shingles long, d1 long, d2 long, signature binary")


def _keys_of(signed: np.ndarray, chunks: int) -> np.ndarray:
    """[document, SLOTS]: for each slot the hash of the other slots of its chunk."""
    out = np.empty(signed.shape, np.uint64)
    s = signed.astype(np.uint64)
    for c, part in enumerate(np.array_split(np.arange(SLOTS), chunks)):
        for left_out in part:
            h = np.full(len(s), c * SLOTS + left_out + 1, np.uint64) * _C
            for p in part:
                if p != left_out:
                    h = (h ^ s[:, p]) * _A
                    h ^= h >> np.uint64(29)
            out[:, left_out] = h
    return out


_KEYED = pa.schema([("key", pa.int64()), ("doc", pa.int64())])


def signature_keys(signed: DataFrame, chunks: int, wanted=None) -> DataFrame:
    """(key, doc) of rows (doc, signature), of all keys or of those that pass a filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        bits = None if wanted is None else wanted.value
        for b in batches:
            for i in range(0, b.num_rows, 4096):
                some = b.slice(i, 4096)
                keys = _keys_of(np.frombuffer(b"".join(some.column(1).to_pylist()), "<u2").reshape(-1, SLOTS), chunks).ravel()
                doc = np.repeat(some.column(0).to_numpy(zero_copy_only=False), SLOTS)
                if bits is not None:
                    use = has(bits, keys)
                    keys, doc = keys[use], doc[use]
                yield batch(_KEYED, keys.view(np.int64), doc)

    return signed.select("doc", "signature").mapInArrow(run, "key long, doc long")


def _texts_of(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, text) of the documents (doc) that are wanted; texts of others mostly don't reach the shuffle."""
    bits = rows.sparkSession.sparkContext.broadcast(key_filter(wanted, "doc"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                some = b.slice(i, 1024)
                yield some.filter(pa.array(has(bits.value, some.column(0).to_numpy(zero_copy_only=False))))

    return rows.select("doc", "text").mapInArrow(run, "doc long, text binary").join(wanted, "doc", "left_semi")


def _similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Of two sorted sets that aren't empty."""
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.count_nonzero(a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b)
    return 100 * both >= percent * (len(a) + len(b) - both)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _confirmed(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Those of pairs (a, b), a table, whose sets are similar. The pairs of one a are dealt out in parts of BLOCK, and a's
    text comes once for each part, before the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        known = None
        for b in batches:
            hubs, others, texts = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            links = []
            for i, j in by_bytes(texts):
                sets, counts = shingle_sets(_split(texts[i:j]), size)
                ends = np.cumsum(counts)
                for k in range(i, j):
                    own = sets[ends[k - i] - counts[k - i] : ends[k - i]]
                    if others[k] is None:
                        known = own.copy()
                    elif _similar(known, own, percent):
                        links.append((hubs[k], others[k]))
            if links:
                yield batch(_LINKS, *zip(*links, strict=True))

    parts = materialize(pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("parts")), "parts")
    others = pairs.join(parts, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), "b")
    hubs = parts.select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"))
    rows = others.unionByName(hubs).withColumn("doc", F.coalesce("b", "a")).join(texts, "doc")
    return rows.repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).select("a", "b", "text").mapInArrow(run, "a long, b long")


_PART = "struct<g:bigint,a:int,b:int>"


def _in_blocks(rows: DataFrame, group: str, blocks) -> DataFrame:
    """rows with columns block and part (g, a, b): a group is dealt out as all pairs of its blocks, each a part of its own;
    a row is in as many parts as there are blocks, whose number `blocks` is an aggregate. part is one column, so that rows
    are dealt by it and not by the group."""
    counts = materialize(rows.groupBy(group).agg(F.greatest(F.lit(1), blocks).cast("int").alias("blocks")), "blocks")
    placed = rows.join(counts, group).withColumn("block", F.pmod(F.xxhash64("doc"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    part = F.struct(F.col(group).alias("g"), F.least("block", "other").alias("a"), F.greatest("block", "other").alias("b"))
    return placed.withColumn("other", other).select(*rows.columns, "block", part.cast(_PART).alias("part"))


def _near_rows(table: pa.Table, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of one part's rows (doc, component, signature, block, part): each row and those behind it that are its candidates and
    of another component. In a part of two blocks only rows of different blocks are compared; a part of one has the rest."""
    comp, block = table["component"].to_numpy(), table["block"].to_numpy()
    signed = np.frombuffer(b"".join(table["signature"].to_pylist()), "<u2").reshape(-1, SLOTS)
    two = table["part"][0].as_py() if len(comp) else None
    across = bool(two) and two["a"] != two["b"]
    for i in range(len(comp) - 1):
        others = np.flatnonzero((comp[i + 1 :] != comp[i]) & ((block[i + 1 :] != block[i]) | (not across))) + i + 1
        if len(others):
            near = others[(signed[others] != signed[i]).sum(1) <= most]
            if len(near):
                yield i, near


class _Union:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)


def _candidate_families(most: int):
    def run(table: pa.Table) -> pa.Table:
        """Of one part of a key: (a, b) for each document that is a candidate of one of another component, b being the first
        of all it is connected with by candidates."""
        table = table.sort_by("doc")
        doc = table["doc"].to_numpy()
        sets, flagged = _Union(len(doc)), np.zeros(len(doc), bool)
        for i, near in _near_rows(table, most):
            flagged[i] = flagged[near] = True
            for j in near.tolist():
                sets.join(i, j)
        rows = np.flatnonzero(flagged)
        return pa.table({"a": doc[rows], "b": doc[[sets.root(i) for i in rows.tolist()]] if len(rows) else doc[rows]}, _LINKS)

    return run


def _open_rows(most: int):
    def run(table: pa.Table) -> pa.Table:
        """(part, doc, component) of those of one part of a family that have a candidate of another component in it."""
        flagged = np.zeros(table.num_rows, bool)
        for i, near in _near_rows(table, most):
            flagged[i] = flagged[near] = True
        return table.select(["part", "doc", "component"]).filter(pa.array(flagged))

    return run


def shared_counts(sets: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """[n, n]: how many elements each two sets have in common. Sets are rows of a matrix of `width` elements at a time."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    use = times[column] > 1
    _, column = np.unique(column[use], return_inverse=True)
    row, order = row[use], np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for k in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, (k, k + width))
        x = np.zeros((len(sets), width), np.float32)
        x[row[a:b], column[a:b] - k] = 1
        out += x @ x.T
    return out


def _family_links(size: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Links among one part's documents (doc, component, text, ...) that join different components."""
        doc, comp = table["doc"].to_numpy(), table["component"].to_numpy().copy()
        flat, counts = shingle_sets(_split(table["text"].to_pylist()), size)
        ends = np.cumsum(counts)
        both = shared_counts([flat[e - n : e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)])
        links = []
        for i in range(len(doc) - 1):
            like = np.flatnonzero(100 * both[i, i + 1 :] >= percent * (counts[i] + counts[i + 1 :] - both[i, i + 1 :])) + i + 1
            for c in np.unique(comp[like]).tolist():
                if c != comp[i]:
                    links.append((doc[i], doc[like[comp[like] == c][0]]))
                    comp[comp == c] = comp[i]
        return pa.table({"a": [int(a) for a, _ in links], "b": [int(b) for _, b in links]}, _LINKS)

    return run


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept, for links between documents whose sets of `size`-word shingles
    have a Jaccard similarity of at least percent/100, which must be 80 at least.

    A null or empty text has an empty set, which is linked with nothing. Rows of equal sets are linked. Where ids repeat
    or are null, rows count by themselves, ordered by id (nulls last) and text; component_id is the id of the
    component's first row, and kept marks that row. Other columns aren't read.
    """
    out = components_of(ordered(docs, id_col, text_col), size, percent)
    names = out.select(F.col("doc").alias("component"), F.col("id").alias("component_id"))
    return out.join(names, "component").select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("component") == F.col("doc")).alias("kept"))


def keep_one(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The first row of each component, with all its columns."""
    rows = ordered(docs, id_col, text_col, rest=True)
    kept = components_of(rows, size, percent).where("component = doc").select("doc")
    return restored(rows.join(kept, "doc", "left_semi"), docs, text_col)


def components_of(rows: DataFrame, size: int, percent: int) -> DataFrame:
    """(doc, id, n_shingles, component) of rows (doc, id, text as binary); component is its least doc."""
    if percent < 80:
        raise ValueError("a similarity of at least 80 percent")
    chunks = chunks_for(percent)
    signed = materialize(signatures(rows, size), "signatures")
    digests = signed.where("n_shingles > 0")
    # Small tables on one side of a join are written first, so that the join can split the other side's large groups.
    first = materialize(digests.groupBy("d1", "d2", "n_shingles").agg(F.min("doc").alias("rep")), "representatives")
    members = digests.join(first, ["d1", "d2", "n_shingles"]).select("doc", "rep")
    # One document of each distinct set, from here on.
    sets = materialize(digests.join(first.select(F.col("rep").alias("doc")), "doc", "left_semi").select("doc", "signature", "n_shingles"), "sets")
    spark = rows.sparkSession
    shared = signature_keys(sets, chunks).groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).where("low < high").select("key")
    wanted = spark.sparkContext.broadcast(key_filter(shared, "key"))
    keyed = materialize(signature_keys(sets, chunks, wanted), "keys")
    hubs = materialize(keyed.groupBy("key").agg(F.min("doc").alias("a"), F.count("*").alias("n")).where("n > 1").select("key", "a"), "hubs")
    pairs = materialize(keyed.join(hubs, "key").where("a < doc").select("a", F.col("doc").alias("b")).distinct(), "pairs")
    sa, sb = (sets.select(F.col("doc").alias(x), F.col("signature").alias(f"s{x}")) for x in "ab")
    pairs = materialize(_near_pairs(pairs.join(sa, "a").join(sb, "b"), _most(chunks)), "pairs")
    ends = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct()
    links = materialize(_confirmed(pairs, materialize(_texts_of(rows, materialize(ends, "ends")), "texts"), size, percent), "links")
    parts = connected_components(links)
    rest = _rest_links(rows, sets, keyed, parts, size, percent)
    if not rest.isEmpty():
        parts = connected_components(links.unionByName(rest))
    of = members.join(parts.select(F.col("doc").alias("rep"), "component"), "rep", "left").select("doc", F.coalesce("component", "rep").alias("component"))
    return signed.select("doc", "id", "n_shingles").join(of, "doc", "left").withColumn("component", F.coalesce("component", "doc"))


def _near_pairs(pairs: DataFrame, most: int) -> DataFrame:
    """Those of pairs (a, b, sa, sb) whose signatures differ in at most `most` slots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        for b in batches:
            one, two = (np.frombuffer(b"".join(b.column(i).to_pylist()), "<u2").reshape(-1, SLOTS) for i in (2, 3))
            yield b.select([0, 1]).filter(pa.array((one != two).sum(1) <= most))

    return pairs.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long")


def _rest_links(rows: DataFrame, sets: DataFrame, keyed: DataFrame, parts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between different components, from keys whose documents are of several."""
    placed = keyed.join(parts, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    open_keys = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("key")
    held = materialize(placed.join(open_keys, "key", "left_semi").join(sets, "doc").select("key", "doc", "component", "signature"), "open")
    most = _most(chunks_for(percent))
    found = _in_blocks(held, "key", F.ceil(F.count("*") / BLOCK)).groupBy("part").applyInArrow(_candidate_families(most), "a long, b long").distinct()
    families = materialize(found, "candidates")
    if families.isEmpty():
        return families
    whole = materialize(connected_components(families).select("doc", F.col("component").alias("family")), "families")
    full = whole.join(parts, "doc", "left").withColumn("component", F.coalesce("component", "doc")).join(sets, "doc")
    full = materialize(full.select("family", "doc", "component", "signature", "n_shingles"), "family-rows")
    blocks = F.greatest(F.ceil(F.count("*") / FAMILY_BLOCK), F.ceil(F.sum("n_shingles") / BLOCK_SHINGLES))
    opened = materialize(_in_blocks(full, "family", blocks).groupBy("part").applyInArrow(_open_rows(most), f"part {_PART}, doc long, component long"), "open-rows")
    texts = _texts_of(rows, materialize(opened.select("doc").distinct(), "open-docs"))
    return materialize(opened.join(texts, "doc").groupBy("part").applyInArrow(_family_links(size, percent), "a long, b long"), "rest")


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), size=3, percent=85)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(words, i, i + 2) AS k FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 1, 2))) AS i FROM d WHERE len(words) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS shared FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * shared >= 85 * (a.n + b.n - shared)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.other),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept FROM c LEFT JOIN n USING (doc_id)
"""
