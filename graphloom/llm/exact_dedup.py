"""Exact dedup with a split of heavy hitters.

The rows' digests go to a small table first. Misra-Gries summaries, one of k counters for each partition, are added up:
every digest on over 2/(k+1) of the rows is among the k largest sums. These at most k candidates are counted exactly
(each task adds up its own rows first), and the winners so verified are broadcast; their rows are decided where they
lie. All other rows are dealt by digest; none of their groups can hold over 2/(k+1) of the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, documents, hex_sha256, materialize, ordered, restored

#: Counters in a summary, and so the bound of what is broadcast.
COUNTERS = 1024


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def misra_gries(df: DataFrame, column: str, k: int = COUNTERS) -> DataFrame:
    """Misra-Gries summaries of a column of strings or longs, one for each partition: (item, low), at most k rows each. low
    is at least the item's count in the partition less n/(k+1) for n rows, and at most that count. Nulls aren't counted."""
    import numpy as np
    import pyarrow.compute as pc

    kind = "string" if dict(df.dtypes)[column] == "string" else "long"
    schema = pa.schema([("item", pa.string() if kind == "string" else pa.int64()), ("low", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = schema.empty_table()
        for b in batches:
            counts = pc.value_counts(b.column(0).drop_null())
            more = pa.Table.from_arrays([counts.field(0), counts.field(1)], schema=schema)
            held = pa.concat_tables([held, more]).group_by("item").aggregate([("low", "sum")]).rename_columns(["item", "low"])
            if held.num_rows > k:  # taking the (k+1)th largest count from all is as good as one by one
                low = held["low"].to_numpy()
                least = np.partition(low, -k - 1)[-k - 1]
                held = pa.Table.from_arrays([held["item"].filter(pa.array(low > least)), pa.array(low[low > least] - least)], schema=schema)
        yield from held.combine_chunks().to_batches()

    return df.select(F.col(column).cast(kind)).mapInArrow(run, f"item {kind}, low long")


def heavy_candidates(df: DataFrame, column: str, k: int = COUNTERS) -> list:
    """At most k values of the column; any on over 2/(k+1) of the rows is among them."""
    sums = misra_gries(df, column, k).groupBy("item").agg(F.sum("low").alias("low")).where("low > 1")
    return [r.item for r in sums.orderBy(F.desc("low"), "item").limit(k).collect()]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = COUNTERS) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id (the id of the row that stays), group_size, kept, text_sha256.

    Texts are equal when they are after each run of white space became one space; a null text counts as empty. Of equal
    texts the row with the smallest id stays, null ids last; of repeated ids one row stays. Other columns aren't read,
    so their names don't matter. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    norm = normalised(F.col(text_col))
    rows = materialize(docs.select(F.col(id_col).alias("doc_id"), hex_sha256(norm).alias("text_sha256"), F.monotonically_increasing_id().alias("row")), "digests")
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("id"), F.col("row").alias("row"))
    found = heavy_candidates(rows, "text_sha256", k)
    out = "doc_id", F.col("first.id").alias("keep_id"), "group_size", (F.col("first.row") == F.col("row")).alias("kept"), "text_sha256"
    w = Window.partitionBy("text_sha256")
    if not found:
        return rows.select("*", F.min(order).over(w).alias("first"), F.count("*").over(w).alias("group_size")).select(*out)
    candidates = F.broadcast(spark.createDataFrame([(x,) for x in found], "text_sha256 string"))
    winners = rows.join(candidates, "text_sha256", "left_semi").groupBy("text_sha256").agg(F.min(order).alias("first"), F.count("*").alias("group_size"))
    winners = spark.createDataFrame(winners.collect(), winners.schema)  # at most k rows
    heavy = rows.join(F.broadcast(winners), "text_sha256").select(*out)
    rest = rows.join(candidates, "text_sha256", "left_anti").select("*", F.min(order).over(w).alias("first"), F.count("*").over(w).alias("group_size")).select(*out)
    return heavy.unionByName(rest)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns; of rows with one id and equal texts, one stays."""
    rows = ordered(docs, id_col, text_col, rest=True)
    kept = exact_dedup(rows.select("doc", F.col("text").cast("string").alias("text")), "doc").where("kept").select(F.col("doc_id").alias("doc"))
    return restored(rows.join(kept, "doc", "left_semi"), docs, text_col)


def query(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM n JOIN g USING (t)
"""
