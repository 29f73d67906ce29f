"""The index as a log: replay, valid prefix, rebuild, lookups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Log operations, bytes of a log record, and the least log that calls for a checkpoint.
INSERT, ERASE = 1, 2
LOG_RECORD = 57
CHECKPOINT_BYTES = 64 << 20


def valid_prefix(log: DataFrame, pos: str = "pos", ok: str = "ok") -> DataFrame:
    """Records before the first corrupt one: one aggregate, and a filter by its one row."""
    first = log.where(~F.col(ok)).agg(F.min(pos).alias("__bad"))
    return log.join(F.broadcast(first), F.col("__bad").isNull() | (F.col(pos) < F.col("__bad"))).drop("__bad")


def replay(log: DataFrame, base: DataFrame | None = None, base_lsn: int = 0) -> DataFrame:
    """(digest, pack_id, offset) after applying the log (lsn, op, digest, pack_id, offset) to a checkpoint at ``base_lsn``."""
    records = log.where(F.col("lsn") > base_lsn).select("digest", "lsn", "op", "pack_id", "offset")
    if base is not None:
        old = base.select("digest", F.lit(base_lsn).cast("bigint").alias("lsn"), F.lit(INSERT).cast("tinyint").alias("op"), "pack_id", "offset")
        records = records.unionByName(old)
    last = records.groupBy("digest").agg(F.max_by(F.struct("op", "pack_id", "offset"), "lsn").alias("last"))
    return last.where(F.col("last.op") == INSERT).select("digest", "last.pack_id", "last.offset")


def rebuild(objects: DataFrame) -> DataFrame:
    """(digest, pack_id, offset) of the last copy of each object in pack order."""
    at = F.struct("pack_id", "offset")
    return objects.groupBy("digest").agg(F.max(at).alias("at")).select("digest", "at.pack_id", "at.offset")


def checkpoint_due(log_records: int, checkpoint_bytes: int) -> bool:
    return log_records * LOG_RECORD >= max(CHECKPOINT_BYTES, checkpoint_bytes // 4)


def latest_pack(objects: DataFrame) -> DataFrame:
    return objects.agg(F.coalesce(F.max("pack_id"), F.lit(0)).cast("bigint").alias("latest_pack_id"))
