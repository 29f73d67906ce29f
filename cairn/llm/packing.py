"""Length buckets of least padding, and token-budget batches within them.

Sequences longer than ``max_length`` are cut into full windows and a rest, so the histogram of
lengths has at most ``max_length + 1`` bars whatever the input; a dynamic programme over it finds
the bucket boundaries whose total padding is least. Batches of a bucket hold as many sequences as
the token budget allows at the bucket's length. A sequence's place in its bucket is its place in
a hashed shard plus the sizes of the shards before, so no bucket is ever sorted in one task. Equal
sequences (of one id, piece and length) are counted before the shuffle and dealt out again after
it, RUN at a time, so an id that many rows share fills no task.

Defined results: a null or zero length is one empty sequence, in the first bucket; null ids are
packed like others; repeated rows are packed as often as they occur; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.session import drop_written, written

#: Rows of a shard, about.
SHARD_ROWS = 50_000
#: Equal sequences dealt out by one task at once.
RUN = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("int")


def boundaries(histogram: dict[int, int], n_buckets: int) -> list[int]:
    """Ascending bucket lengths, at most ``n_buckets``, that make the sum of paddings least."""
    lengths = np.array(sorted(histogram), np.int64)
    m = len(lengths)
    if not m:
        return []
    count = np.concatenate([[0], np.cumsum([histogram[int(x)] for x in lengths])]).astype(np.int64)
    tokens = np.concatenate([[0], np.cumsum([int(x) * histogram[int(x)] for x in lengths])]).astype(np.int64)
    best = np.full(m + 1, np.iinfo(np.int64).max // 2)
    best[0] = 0
    cuts = []
    for _ in range(min(n_buckets, m)):
        new, cut = best.copy(), np.full(m + 1, -1, np.int64)
        for j in range(1, m + 1):  # the bucket holds lengths[i:j]
            cost = best[:j] + lengths[j - 1] * (count[j] - count[:j]) - (tokens[j] - tokens[:j])
            i = int(cost.argmin())
            if cost[i] < new[j]:
                new[j], cut[j] = cost[i], i
        best = new
        cuts.append(cut)
    out, j = [], m
    for cut in reversed(cuts):
        if j and cut[j] >= 0:
            out.append(int(lengths[j - 1]))
            j = int(cut[j])
    return out[::-1]


def pack(df: DataFrame, length: Column, *, id_col: str = "doc_id", max_length: int = 2048, n_buckets: int = 16, token_budget: int = 65_536) -> DataFrame:
    """(id, piece, start, length, bucket_length, batch, slot) for every sequence of every row.

    ``batch`` numbers the batches of a bucket from 0, ``slot`` the places in a batch.
    """
    if not 0 < max_length <= token_budget:
        raise ValueError("max_length must lie between 1 and token_budget")
    sizes = df.select(F.col(id_col).alias("id"), F.coalesce(length, F.lit(0)).cast("bigint").alias("n"))
    last = F.greatest(F.ceil(F.col("n") / max_length), F.lit(1)) - 1
    pieces = sizes.select("id", "n", F.posexplode(F.array_repeat(F.lit(0), (last + 1).cast("int"))).alias("piece", "zero"))
    start = F.col("piece").cast("bigint") * max_length
    pieces = written(pieces.select("id", "piece", start.alias("start"), F.least(F.col("n") - start, F.lit(max_length)).cast("int").alias("length")), "pieces")

    histogram = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # max_length + 1 rows at most
    bounds = boundaries(histogram, n_buckets)
    bucket = F.lit(bounds[-1] if bounds else 0)
    for b in reversed(bounds[:-1]):
        bucket = F.when(F.col("length") <= b, b).otherwise(bucket)
    shards = max(64, math.ceil(sum(histogram.values()) / SHARD_ROWS))
    sequence = ["bucket_length", "shard", "id", "piece", "start", "length"]
    shard = F.pmod(F.xxhash64("id", "piece", "length"), F.lit(shards))
    equal = pieces.select("*", bucket.alias("bucket_length"), shard.alias("shard")).groupBy(*sequence).agg(F.count("*").alias("n"))

    before = Window.partitionBy("bucket_length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("bucket_length", "shard").orderBy(F.xxhash64("length", "piece", "id"), "id", "piece", "length").rowsBetween(Window.unboundedPreceding, 0)
    placed = written(equal.withColumn("place", F.sum("n").over(own) - F.col("n")), "placed")
    drop_written(pieces)
    offsets = placed.groupBy("bucket_length", "shard").agg(F.sum("n").alias("s"))
    offsets = offsets.select("bucket_length", "shard", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("offset"))
    ranked = placed.join(offsets, ["bucket_length", "shard"]).select(*sequence, "n", (F.col("offset") + F.col("place")).alias("first"))
    few = ranked.where(F.col("n") <= RUN).withColumn("run", F.lit(0).cast("bigint"))
    many = ranked.where(F.col("n") > RUN).withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1, F.lit(RUN).cast("bigint")))).repartition(*sequence, "run")
    each = few.unionByName(many).withColumn("k", F.explode(F.sequence("run", F.least(F.col("n"), F.col("run") + RUN) - 1)))
    rank, room = F.col("first") + F.col("k"), F.floor(F.lit(token_budget) / F.greatest(F.col("bucket_length"), F.lit(1)))
    return each.select(F.col("id").alias(id_col), "piece", "start", "length", "bucket_length", F.floor(rank / room).alias("batch"), (rank % room).cast("int").alias("slot"))
