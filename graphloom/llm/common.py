"""What the text operators share: words, Arrow batches and row numbers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.staging import materialize, scratch_path

#: What separates words, as a Java or RE2 character class. bytes.split() splits at exactly these.
SPACE = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def hex_sha256(column) -> F.Column:
    return F.sha2(column.cast("binary"), 256)


def by_bytes(values: list, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of a list of bytes (or None) that hold about `limit` bytes, so that the arrays made of a range stay small;
    one longer value makes a range of its own."""
    start = size = 0
    for i, v in enumerate(values):
        n = len(v) if v else 0
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(values):
        yield start, len(values)


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def unique_ids(df: DataFrame, column: str) -> bool:
    """Whether the column has whole numbers, none null and none twice."""
    if dict(df.dtypes)[column] not in ("tinyint", "smallint", "int", "bigint"):
        return False
    return df.where(F.col(column).isNull()).isEmpty() and df.groupBy(column).count().where("count > 1").isEmpty()


def ordered(docs: DataFrame, id_col: str, text_col: str, rest: bool = False) -> DataFrame:
    """(doc, id, text as binary), doc being a number of its own for each row: doc is the id where ids are whole and
    distinct; else rows are numbered by id (nulls last) and text. With rest also a struct of all columns but the text."""
    columns = [F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")]
    if rest:
        columns.append(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text_col]).alias("rest"))
    rows = docs.select(*columns)
    others = [c for c in rows.columns if c != "id"]
    if unique_ids(rows, "id"):
        return rows.select(F.col("id").cast("long").alias("doc"), "id", *others)
    order = [F.col("id").asc_nulls_last(), F.xxhash64("text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(dealt.select(F.monotonically_increasing_id().alias("doc"), "id", *others), "ordered")


def restored(rows: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """The columns of docs from rows that ordered(docs, ..., rest=True) made."""
    return rows.select(*[F.col("text").cast("string").alias(c) if c == text_col else F.col(f"rest.`{c}`") for c in docs.columns])


__all__ = ["SPACE", "batch", "by_bytes", "documents", "hex_sha256", "materialize", "ordered", "restored", "scratch_path", "unique_ids"]
