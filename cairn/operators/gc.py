"""Mark and sweep: reachability, pack statistics, selection, compaction plans, audits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators.dedup import OBJECT_HEADER

THRESHOLD = 0.5


def live(refs: DataFrame) -> DataFrame:
    """The distinct digests that snapshots refer to."""
    return refs.select("digest").distinct()


def classify(objects: DataFrame, index: DataFrame, live_digests: DataFrame) -> DataFrame:
    """objects (digest, pack_id, offset, stored_size) with ``state``: orphan, live or garbage, and record bytes.

    A record is an orphan where the index lacks its digest or places it elsewhere.
    """
    at = index.select("digest", F.col("pack_id").alias("i_pack"), F.col("offset").alias("i_offset"))
    found = objects.join(at, "digest", "left").join(live_digests.select("digest", F.lit(True).alias("is_live")), "digest", "left")
    indexed = F.col("i_pack").eqNullSafe(F.col("pack_id")) & F.col("i_offset").eqNullSafe(F.col("offset"))
    state = F.when(~indexed, "orphan").when(F.col("is_live"), "live").otherwise("garbage")
    return found.select("digest", "pack_id", "offset", state.alias("state"), (F.col("stored_size") + OBJECT_HEADER).cast("bigint").alias("record_bytes"))


def _sums(prefixes: tuple[str, ...]) -> list:
    out = []
    for s in prefixes:
        hit = F.col("state") == s
        out += [F.count_if(hit).alias(f"{s}_objects"), F.coalesce(F.sum(F.when(hit, F.col("record_bytes"))), F.lit(0)).alias(f"{s}_bytes")]
    return out


def pack_stats(classified: DataFrame) -> DataFrame:
    """Live and garbage objects and bytes by pack; packs of orphans alone have no row, orphans are reported beside."""
    stats = classified.groupBy("pack_id").agg(*_sums(("live", "garbage", "orphan")))
    return stats.where("live_objects + garbage_objects > 0")


def totals(classified: DataFrame) -> DataFrame:
    return classified.agg(*_sums(("live", "garbage", "orphan")))


def select_packs(stats: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(pack_id, ratio) with garbage over all indexed bytes at or above the threshold, worst first."""
    total = F.col("live_bytes") + F.col("garbage_bytes")
    ratio = (F.col("garbage_bytes") / total).alias("ratio")
    return stats.where(total > 0).select("pack_id", ratio).where(F.col("ratio") >= threshold).orderBy(F.desc("ratio"), "pack_id")


def compact_plan(classified: DataFrame, packs: DataFrame) -> DataFrame:
    """What compaction of ``packs`` does to each indexed object in them: ``copy`` or ``erase``."""
    inside = classified.where("state <> 'orphan'").join(packs.select("pack_id"), "pack_id", "left_semi")
    return inside.select("digest", "pack_id", "offset", "record_bytes", F.when(F.col("state") == "live", "copy").otherwise("erase").alias("action"))


def dangling(refs: DataFrame, index: DataFrame) -> DataFrame:
    """References that the index does not know, as often as they occur."""
    return refs.join(index.select("digest"), "digest", "left_anti")


def audit(refs: DataFrame, index: DataFrame) -> DataFrame:
    """By snapshot: references, dangling ones, and whether it is broken."""
    known = index.select("digest", F.lit(True).alias("known"))
    lost = F.count_if(F.col("known").isNull())
    rows = refs.join(known, "digest", "left").groupBy("snapshot").agg(F.count("*").alias("refs"), lost.alias("dangling"))
    return rows.withColumn("broken", F.col("dangling") > 0)
