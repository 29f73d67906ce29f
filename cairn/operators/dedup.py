"""Deduplication of chunks and their placement in packs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Bytes of an object's header, and of a pack.
OBJECT_HEADER = 53
PACK_BYTES = 256 << 20


def unique_objects(chunks: DataFrame) -> DataFrame:
    """(digest, length, refs) of each distinct chunk; partial aggregation comes before the shuffle."""
    return chunks.groupBy("digest").agg(F.first("length").alias("length"), F.count("*").alias("refs"))


def new_objects(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct chunks (digest, length) that the index does not have."""
    return chunks.select("digest", "length").dropDuplicates(["digest"]).join(index.select("digest"), "digest", "left_anti")


def growth(chunks: DataFrame) -> DataFrame:
    """For each snapshot in order of name: logical bytes, and those of chunks no earlier snapshot has."""
    first = chunks.groupBy("digest").agg(F.min("snapshot").alias("snapshot"), F.first("length").alias("length"))
    new = first.groupBy("snapshot").agg(F.count("*").alias("new_objects"), F.sum("length").alias("new_bytes"))
    own = chunks.groupBy("snapshot").agg(F.count("*").alias("refs"), F.sum("length").alias("logical_bytes"))
    joined = own.join(new, "snapshot", "left").na.fill(0, ["new_objects", "new_bytes"])
    saved = F.round(F.lit(100.0) * (F.lit(1.0) - F.col("new_bytes") / F.col("logical_bytes")), 4)
    return joined.select("snapshot", "refs", "logical_bytes", "new_objects", "new_bytes", saved.alias("saved_pct"))


def place(objects: DataFrame, max_bytes: int = PACK_BYTES, first_pack: int = 0) -> DataFrame:
    """``objects`` (digest, stored_size) with pack_id and offset: running record sizes in digest order, cut at ``max_bytes``.

    A record goes to the pack in which its end falls, so a pack can hold less than its limit but
    never more by a whole record. The running sum is taken within the 4,096 ranges of the first
    three hex digits, on top of the sums of the ranges before: no task sorts all objects.
    """
    sized = objects.withColumn("record", F.col("stored_size").cast("bigint") + OBJECT_HEADER).withColumn("range", F.substring("digest", 1, 3))
    sums = sized.groupBy("range").agg(F.sum("record").alias("s"))
    before = sums.select("range", F.coalesce(F.sum("s").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    own = Window.partitionBy("range").orderBy("digest").rowsBetween(Window.unboundedPreceding, 0)
    run = sized.withColumn("run", F.sum("record").over(own)).join(F.broadcast(before), "range")  # 4,096 rows at most
    end = F.col("before") + F.col("run")
    run = run.withColumn("end", end).withColumn("pack_id", F.floor((end - 1) / max_bytes) + first_pack)
    return run.withColumn("offset", F.col("end") - F.col("record")).drop("range", "record", "run", "before", "end")
