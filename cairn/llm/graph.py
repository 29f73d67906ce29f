"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.session import drop_written, written


def _digest(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a") % 1000003)).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long); the root is the least node reachable.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): edges never grow in
    number beyond nodes plus edges, and the rounds grow with the logarithm of the longest chain.
    Each round is a written table, as is the result. Only minima are grouped, never lists of neighbours,
    and the joins are plain ones, which adaptive execution splits where one node has most of the edges.
    """
    now = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _digest(now)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        after = small.where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        after = written(after.where("a != b").distinct(), "edges")
        new = _digest(after)
        drop_written(now)
        now = after
        if new == state:
            break
        state = new
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = written(roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()), "roots")
    drop_written(now)
    return out
