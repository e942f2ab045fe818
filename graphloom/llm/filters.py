"""Filters that tell which rows later passes need.

They only save work: a key that was put in always passes, others may. A filter has 64 bits or more for each slot in use,
so that under 2 % of the others pass, up to 2^MOST_BITS bits, which is what the driver and the executors hold of it at most; a larger number of keys fills it, more
rows pass and results stay the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch

LEAST_BITS, MOST_BITS = 26, 28
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the filter has the keys."""
    slot = _slots(keys, (len(bits) * 64 - 1).bit_length())
    return (bits[slot >> 6] >> (slot & 63).astype(np.uint64)) & np.uint64(1) == 1


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    k = keys.astype(np.uint64) * _A
    return (k >> np.uint64(64 - bits)).astype(np.int64)


def pair_key(doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    k = (doc.astype(np.uint64) * _B) ^ (at.astype(np.uint64) * _C)
    return k ^ (k >> np.uint64(33))


def key_filter(keys: DataFrame, *columns: str) -> np.ndarray:
    """A filter over the rows' keys (doc) or (doc, at); at most 2^MOST_BITS / 64 rows come to the driver."""
    schema = pa.schema([("word", pa.int64()), ("bits", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]
            slot = np.unique(_slots(pair_key(*c) if len(c) == 2 else c[0], MOST_BITS))
            word, first = np.unique(slot >> 6, return_index=True)
            if len(word):
                bits = np.bitwise_or.reduceat(np.uint64(1) << (slot & 63).astype(np.uint64), first)
                yield batch(schema, word, bits.view(np.int64))

    found = keys.select(*columns).mapInArrow(run, "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits")).toArrow()
    if not found.num_rows:
        return np.zeros(1 << (LEAST_BITS - 6), np.uint64)
    word, bits = found["word"].to_numpy(), found["bits"].to_numpy().view(np.uint64)
    used = int(np.bitwise_count(bits).sum())
    size = min(MOST_BITS, max(LEAST_BITS, (64 * used - 1).bit_length()))
    out = np.zeros(1 << (size - 6), np.uint64)
    # Slots are a hash's leading bits, so those of a smaller filter are the quotients.
    for k in range(64):
        slot = ((word[(bits >> np.uint64(k)) & np.uint64(1) == 1] << 6) + k) >> (MOST_BITS - size)
        np.bitwise_or.at(out, slot >> 6, np.uint64(1) << (slot & 63).astype(np.uint64))
    return out
