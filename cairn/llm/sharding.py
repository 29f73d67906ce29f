"""Shards by size-tiered compaction under a versioned manifest.

Arrivals are appended as small immutable Parquet shards, without a shuffle. A shard's tier is the
whole logarithm of its size; once a tier has ``fanout`` shards they are merged into files of the
target size, again without a shuffle: a task reads several small files and writes one. Every
change is a new manifest version that lists the shards added and removed; beside each ``FULL``-th
lies a whole listing. A version's rows are written aside, and a rename of the folder commits it, guarded by a
claim that only one writer can create. Readers see a whole version or the one before. Replaced
shards stay, so older versions can be read, until ``expire`` drops what no kept version lists.
Only DataFrames and Hadoop's file system are used.

A claim without its version is what a crash leaves, or a writer at work: it can be taken over
after ``lease`` seconds, and a writer whose claim was taken over, or whose base is no longer the
last version, does not commit. What it wrote is dropped by the next ``expire``.

The driver holds the paths of the shards that a read or a merge is about, as Spark's scans do; a
merge takes ``GROUP_FILES`` at most.

Defined results: rows are kept as they are, nulls, empty texts and repeats included; an empty
arrival commits a version without new shards; a version without shards reads as an empty table
of the first arrival's columns; a store without versions cannot be read (``ValueError``), and
compacting it is version 0; columns may have any names, and ``read`` adds one only if asked to.
"""

from __future__ import annotations

import json
import math
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.session import drop

MANIFEST = "path string, bytes bigint, n_rows bigint, tier int, added int"
CHANGES = MANIFEST + ", removed boolean"
#: Of so many versions one lists all shards.
FULL = 16
GROUP_FILES = 10_000


class Conflict(RuntimeError):
    """Another writer has committed the version, or is about to."""


class ShardStore:
    def __init__(self, spark: SparkSession, path: str, *, target_bytes: int = 256 << 20, tier_bytes: int = 1 << 20, fanout: int = 4, shard_rows: int = 2_000, lease: float = 3_600):
        self.spark, self.path = spark, path.rstrip("/")
        self.target_bytes, self.tier_bytes, self.fanout, self.shard_rows, self.lease = target_bytes, tier_bytes, fanout, shard_rows, lease

    # ---- files

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(f"{self.path}/{folder}")
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _put(self, path: str, text: str) -> None:
        """Create a file that does not exist yet."""
        fs, p = self._fs(path)
        out = fs.create(p, False)
        out.write(bytearray(text.encode()))
        out.close()

    def _get(self, path: str) -> str:
        fs, p = self._fs(path)
        source = fs.open(p)
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    # ---- versions

    def versions(self) -> list[int]:
        """The versions that can be read."""
        return sorted(int(n[2:]) for n in self._names("manifest") if n.startswith("v="))

    def _last(self) -> int:
        return (self.versions() or [0])[-1]

    def _deltas(self, versions: list[int]) -> DataFrame:
        return self.spark.read.schema(CHANGES).parquet(*[f"{self.path}/manifest/v={v:06d}" for v in versions])

    def manifest(self, version: int | None = None) -> DataFrame:
        """One row for each shard of a version, the last by default."""
        have = self.versions()
        if not have:
            return self.spark.createDataFrame([], MANIFEST)
        version = version or have[-1]
        if version not in have:
            raise ValueError(f"no version {version}")
        full = max((int(n[5:]) for n in self._names("manifest") if n.startswith("full=") and int(n[5:]) <= version), default=0)
        later = [v for v in have if full < v <= version]
        now = self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/full={full:06d}") if full else self.spark.createDataFrame([], MANIFEST)
        if not later:
            return now
        changes = self._deltas(later)
        now = now.unionByName(changes.where("NOT removed").drop("removed"))
        return now.join(changes.where("removed").select("path"), "path", "left_anti")

    def _list_all(self, version: int) -> None:
        """Write the whole listing of a version beside its changes, unless it is there."""
        if f"full={version:06d}" not in self._names("manifest"):
            aside = f"{self.path}/aside/{uuid.uuid4().hex}"
            self.manifest(version).write.parquet(aside)
            fs, p = self._fs(aside)
            fs.rename(p, self._fs(f"{self.path}/manifest/full={version:06d}")[1])

    def _claim(self, version: int) -> str:
        """Reserve a version; the token tells the owner."""
        at, token = f"{self.path}/claims/{version:06d}", uuid.uuid4().hex
        fs, p = self._fs(at)
        if fs.exists(p) and time.time() - fs.getFileStatus(p).getModificationTime() / 1000 >= self.lease and version not in self.versions():
            fs.delete(p, False)
        try:
            self._put(at, token)
        except Exception as e:
            if not fs.exists(p):
                raise
            raise Conflict(f"version {version} is taken; its claim can be taken over {self.lease} seconds after it was made") from e
        return token

    def _commit(self, added: DataFrame, removed: DataFrame | None, version: int) -> int:
        """Make ``version`` of the last one by adding and removing shards."""
        aside, final = f"{self.path}/aside/{uuid.uuid4().hex}", f"{self.path}/manifest/v={version:06d}"
        rows = added.withColumn("removed", F.lit(False))
        if removed is not None:
            rows = rows.unionByName(removed.withColumn("removed", F.lit(True)))
        rows.write.parquet(aside)
        token = self._claim(version)
        if self._last() != version - 1 or self._get(f"{self.path}/claims/{version:06d}") != token:
            raise Conflict(f"version {version} does not follow the last one")
        fs, target = self._fs(final)
        fs.mkdirs(target.getParent())
        if not fs.rename(self._fs(aside)[1], target):
            raise Conflict(f"version {version} could not be renamed into place")
        if version % FULL == 0:
            self._list_all(version)
        return version

    # ---- shards

    def _schema(self) -> T.StructType:
        return T.StructType.fromJson(json.loads(self._get(f"{self.path}/schema.json")))

    def _listing(self, folder: str, version: int) -> DataFrame:
        """The shards with rows in a folder that a finished job has written."""
        read = self.spark.read.schema(self._schema()).parquet(folder)
        file = read.metadataColumn("_metadata")
        files = read.groupBy(file.getField("file_path").alias("path"), file.getField("file_size").alias("bytes")).agg(F.count("*").alias("n_rows"))
        tier = F.floor(F.log(F.greatest(F.col("bytes") / self.tier_bytes, F.lit(1.0))) / math.log(self.fanout)).cast("int")
        return files.select("path", "bytes", "n_rows", tier.alias("tier"), F.lit(version).alias("added"))

    def append(self, df: DataFrame) -> int:
        """Commit an arrival as shards of at most ``shard_rows`` rows; returns the version."""
        version = self._last() + 1
        if not self._fs(f"{self.path}/schema.json")[0].exists(self._fs(f"{self.path}/schema.json")[1]):
            self._put(f"{self.path}/schema.json", df.schema.json())
        folder = f"{self.path}/data/{version:06d}-{uuid.uuid4().hex}"
        df.write.option("maxRecordsPerFile", self.shard_rows).option("compression", "zstd").parquet(folder)
        return self._commit(self._listing(folder, version), None, version)

    def compact(self) -> int:
        """Merge tiers that have ``fanout`` shards below the target size, until none has; returns the version."""
        while True:
            now = self.manifest()
            small = now.where(F.col("bytes") < self.target_bytes // 2)
            full = small.groupBy("tier").agg(F.count("*").alias("n")).where(F.col("n") >= self.fanout).orderBy("tier").first()
            if full is None:
                return self._last()
            group = small.where(F.col("tier") == full.tier).orderBy("added", "path").limit(GROUP_FILES).collect()  # the oldest first
            files, size = [r.path for r in group], sum(r.bytes for r in group)
            n = max(1, min(math.ceil(size / self.target_bytes), len(files) // 2)) if size >= self.target_bytes else max(1, len(files) // self.fanout)
            version = self._last() + 1
            folder = f"{self.path}/data/{version:06d}-{uuid.uuid4().hex}"
            self.spark.read.schema(self._schema()).parquet(*files).coalesce(n).write.option("compression", "zstd").parquet(folder)
            merged = self._listing(folder, version).withColumn("tier", F.greatest(F.col("tier"), F.lit(full.tier + 1)))
            self._commit(merged, self.spark.createDataFrame(group, MANIFEST), version)

    def read(self, version: int | None = None, shard_col: str | None = None) -> DataFrame:
        """The rows of a version; ``shard_col``, if given, names a column for the file that each is in."""
        if not self.versions():
            raise ValueError("the store has no versions")
        files = [r.path for r in self.manifest(version).select("path").toLocalIterator()]
        if not files:
            empty = self.spark.createDataFrame([], self._schema())
            return empty.withColumn(shard_col, F.lit(None).cast("string")) if shard_col else empty
        rows = self.spark.read.schema(self._schema()).parquet(*files)
        return rows.withColumn(shard_col, rows.metadataColumn("_metadata").getField("file_path")) if shard_col else rows

    def expire(self, keep: int = 1, *, lease: float | None = None) -> int:
        """Forget all but the last ``keep`` versions and delete what none of them lists; returns the files deleted.

        Folders that an unfinished writer of the last ``lease`` seconds may be filling are left alone.
        """
        have = self.versions()
        if not have:
            return 0
        lease = self.lease if lease is None else lease
        first = have[-keep:][0]
        self._list_all(first)
        for v in have:
            if v < first:
                drop(self.spark, f"{self.path}/manifest/v={v:06d}")
        for n in self._names("manifest"):
            if n.startswith("full=") and int(n[5:]) < first:
                drop(self.spark, f"{self.path}/manifest/{n}")
        kept = self.manifest(first).select("path").union(self._deltas([v for v in have if v >= first]).where("NOT removed").select("path"))
        used = {"/".join(r.path.split("/")[-2:]) for r in kept.toLocalIterator()}
        deleted = 0
        for folder in self._names("data"):
            fs, p = self._fs(f"{self.path}/data/{folder}")
            if int(folder[:6]) > have[-1] and time.time() - fs.getFileStatus(p).getModificationTime() / 1000 < lease:
                continue
            gone = [n for n in self._names(f"data/{folder}") if n.startswith("part-") and f"{folder}/{n}" not in used]
            deleted += len(gone)
            if len(gone) == sum(n.startswith("part-") for n in self._names(f"data/{folder}")):
                drop(self.spark, f"{self.path}/data/{folder}")
            else:
                drop(self.spark, *[f"{self.path}/data/{folder}/{n}" for n in gone])
        return deleted
