"""Connected components by alternating large-star and small-star steps over DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """(doc, component) for each end of links (a, b), two columns of long: component is the least number that can be
    reached. No group is gathered: a step takes minima, combined before the shuffle, and joins them back. They are tables
    by then, so that a join can split the links of a number that has very many."""
    a, b = F.col("a"), F.col("b")
    edges = materialize(links.where(a != b).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "links")
    state = None
    while True:
        both = edges.unionByName(edges.select(b.alias("a"), a.alias("b")))
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "minima")
        large = both.where(b > a).join(low, "a").select(b.alias("a"), F.col("m").alias("b")).unionByName(edges.join(low, "a").select("a", F.col("m").alias("b")))
        large = materialize(large.where(a != b).distinct(), "large")
        low = materialize(large.groupBy("a").agg(F.min("b").alias("m")), "minima")
        joined = large.join(low, "a")
        small = joined.select(b.alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        edges = materialize(small.where(a != b).distinct(), "small")
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if now == state:
            break
        state = now
    # Stars now: each number but the centres has its component's least number as its only neighbour.
    return edges.select(a.alias("doc"), b.alias("component")).unionByName(edges.select(b.alias("doc"), b.alias("component")).distinct())
