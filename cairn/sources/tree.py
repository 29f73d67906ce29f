"""File trees and file tables as sources of chunks.

A source lists its files, names their chunks, and hands out the bytes of those chunks that are
wanted; so names are all that is shuffled of a file that holds nothing new. What Spark's own file
source leaves out (empty and hidden files, modes, files over 2 GiB) is kept. A tree is on a file
system that all executors share.

Files over LARGE bytes are cut by several tasks: allowed cuts are found in segments, as they depend
on 48 bytes alone; one task a file hops over them (8 bytes for each 8 KiB of the file); and chunks
are hashed in segments again.
"""

from __future__ import annotations

import hashlib
import math
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cairn.functions.chunking import WINDOW, candidates, chunk_ends, hops
from cairn.functions.chunking import chunks as cut

FILES = "file string, path string, size bigint, mode int"
REFS = "path string, chunk_idx bigint, offset bigint, length bigint, digest binary"
CHUNKS = "digest binary, bytes binary"
LARGE = 64 << 20
#: Bytes of files or chunks that a task reads, about, and the names it lists at once.
TASK_BYTES, NAMES = 128 << 20, 10_000
#: Bytes of chunks that a task hands on at once.
BATCH_BYTES = 8 << 20
#: Folders that the driver looks for before tasks walk what is below them.
FOLDERS = 64
CHANGED = "a file changed, or two files share a path"


def batches_of(rows: Iterator[tuple], schema: pa.Schema, limit: int = NAMES) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most ``limit`` rows, and of about BATCH_BYTES where the last column is binary."""
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += len(row[-1]) if isinstance(row[-1], bytes) else 0
        if len(part) >= limit or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)
            part, size = [], 0
    if part:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def _to_list(root: str) -> list[tuple[str, bool]]:
    """Folders below ``root``: those to list, and those to walk; together they cover the tree."""
    flat, deep = [], [root]
    while deep and len(deep) < FOLDERS:
        below = []
        for d in deep:
            with os.scandir(d) as found:
                below += [e.path for e in found if e.is_dir(follow_symlinks=False)]
        flat, deep = flat + deep, below
    return [(d, False) for d in flat] + [(d, True) for d in deep]


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """(file, path, size, mode) of regular files, links to files included; the driver sees only the uppermost folders."""
    root = os.path.abspath(root)
    if os.path.isfile(root):
        st = os.stat(root)
        return spark.createDataFrame([(root, os.path.basename(root), st.st_size, st.st_mode & 0o7777)], FILES)
    folders = spark.createDataFrame(_to_list(root), "folder string, deep boolean")
    schema = arrow_schema(FILES)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for folder, deep in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for d, below, names in os.walk(folder):
                    if not deep:
                        below.clear()
                    for p in (os.path.join(d, n) for n in names):
                        if os.path.isfile(p):
                            st = os.stat(p)
                            yield p, os.path.relpath(p, root).replace(os.sep, "/"), st.st_size, st.st_mode & 0o7777

    return folders.repartition(FOLDERS).mapInArrow(lambda b: batches_of(rows(b), schema), FILES)


class Tree:
    """The files below a folder, or one file."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def files(self) -> DataFrame:
        return list_tree(self.spark, self.root)

    def _tasks(self, n: int, size: int) -> int:
        return max(1, min(n, max(self.spark.sparkContext.defaultParallelism, math.ceil(size / TASK_BYTES), math.ceil(n / NAMES))))

    def refs(self, files: DataFrame) -> DataFrame:
        """The chunks of ``files`` (a written listing), each file read once, a large one twice."""
        n, size, large = files.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.count_if(F.col("size") > LARGE)).first()
        schema = arrow_schema(REFS)

        def small(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for batch in batches:
                for file, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    with open(file, "rb") as f:
                        data = memoryview(f.read())
                    start = 0
                    for k, end in enumerate(chunk_ends(data)):
                        yield path, k, start, end - start, hashlib.sha256(data[start:end]).digest()
                        start = end

        few = files.where(F.col("size") <= LARGE).select("file", "path").repartition(self._tasks(n, size), "path")
        found = few.mapInArrow(lambda b: batches_of(small(b), schema), REFS)
        return found.unionByName(self._large(files.where(F.col("size") > LARGE))) if large else found

    def _large(self, files: DataFrame) -> DataFrame:
        marks_schema, cuts, refs_schema = "file string, path string, size bigint, at bigint, marks array<bigint>", "file string, path string, chunk_idx bigint, offset bigint, length bigint", arrow_schema(REFS)
        marks_arrow, cuts_arrow = arrow_schema(marks_schema), arrow_schema(cuts)

        def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for batch in batches:
                for r in batch.to_pylist():
                    with open(r["file"], "rb") as f:
                        f.seek(r["at"])
                        data = f.read(LARGE + WINDOW - 1)
                    yield r["file"], r["path"], r["size"], r["at"], [r["at"] + e for e in candidates(data)]

        def hop(rows: pa.Table) -> pa.Table:
            order = rows.sort_by("at")
            found = order.column("marks").combine_chunks().flatten().to_pylist() if len(order) else []
            ends = hops(found, order.column("size")[0].as_py())
            starts = [0, *ends[:-1]]
            same = lambda c: pa.array([order.column(c)[0].as_py()] * len(ends), pa.string())
            return pa.table([same("file"), same("path"), pa.array(range(len(ends)), pa.int64()), pa.array(starts, pa.int64()), pa.array([e - s for s, e in zip(starts, ends, strict=True)], pa.int64())], schema=cuts_arrow)

        def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            handle, now = None, None
            for batch in batches:
                for r in batch.to_pylist():
                    if r["file"] != now:
                        if handle:
                            handle.close()
                        handle, now = open(r["file"], "rb"), r["file"]
                    handle.seek(r["offset"])
                    data = handle.read(r["length"])
                    if len(data) < r["length"]:
                        raise ValueError(CHANGED)
                    yield r["path"], r["chunk_idx"], r["offset"], r["length"], hashlib.sha256(data).digest()
            if handle:
                handle.close()

        whole = files.select("file", "path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(LARGE).cast("bigint"))).alias("at"))
        found = whole.repartition("path", "at").mapInArrow(lambda b: batches_of(marks(b), marks_arrow, 1), marks_schema)
        at = found.groupBy("path").applyInArrow(hop, cuts)
        dealt = at.repartition("path", F.floor(F.col("offset") / TASK_BYTES)).sortWithinPartitions("file", "offset")
        return dealt.mapInArrow(lambda b: batches_of(hashed(b), refs_schema), REFS)

    def chunks(self, files: DataFrame, wanted: DataFrame) -> DataFrame:
        """(digest, bytes) of ``wanted`` (digest, path, offset, length, a written table): only these bytes are read again."""
        n, size = wanted.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
        schema = arrow_schema(CHUNKS)

        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            handle, now = None, None
            for batch in batches:
                for r in batch.to_pylist():
                    if r["file"] != now:
                        if handle:
                            handle.close()
                        handle, now = open(r["file"], "rb"), r["file"]
                    handle.seek(r["offset"])
                    data = handle.read(r["length"])
                    if hashlib.sha256(data).digest() != bytes(r["digest"]):
                        raise ValueError(CHANGED)
                    yield bytes(r["digest"]), data
            if handle:
                handle.close()

        placed = wanted.join(files.select("file", "path"), "path").select("file", "offset", "length", "digest")
        dealt = placed.repartition(self._tasks(n, size), "file", F.floor(F.col("offset") / TASK_BYTES)).sortWithinPartitions("file", "offset")
        return dealt.mapInArrow(lambda b: batches_of(read(b), schema), CHUNKS)


class Table:
    """Rows (path, size, mode, content); a row holds a whole file, 2 GiB at most."""

    def __init__(self, rows: DataFrame):
        self.rows = rows.select("path", "mode", "content")

    def files(self) -> DataFrame:
        return self.rows.select("path", F.length("content").cast("bigint").alias("size"), F.col("mode").cast("int").alias("mode"))

    def refs(self, files: DataFrame) -> DataFrame:
        named = cut(self.rows.select(F.lit("").alias("snapshot"), "path", "content"))
        return named.select("path", *[F.col(c).cast("bigint").alias(c) for c in ("chunk_idx", "offset", "length")], F.unhex("digest").alias("digest"))

    def chunks(self, files: DataFrame, wanted: DataFrame) -> DataFrame:
        """As for a tree. ``wanted`` is a written table, so it is broadcast where it is below Spark's threshold; else contents are shuffled by path."""
        listed = wanted.groupBy("path").agg(F.collect_list(F.struct("offset", "length", "digest")).alias("wanted"))
        each = self.rows.join(listed, "path").select("content", F.explode("wanted").alias("w"))
        each = each.select("w.digest", F.substring("content", (F.col("w.offset") + 1).cast("int"), F.col("w.length").cast("int")).alias("bytes"))
        same = F.sha2("bytes", 256) == F.lower(F.hex("digest"))
        return each.select("digest", F.when(same, F.col("bytes")).otherwise(F.raise_error(F.lit(CHANGED)).cast("binary")).alias("bytes"))
