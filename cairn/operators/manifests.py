"""Manifests: files and their ordered chunk digests, as rows, structs and JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Files in a part of a manifest, about.
PART_FILES = 10_000

MANIFEST = "is_directory boolean, files array<struct<path:string,size:bigint,mode:int,chunks:array<string>>>"


def file_entries(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """(snapshot, path, size, mode, chunks) for every file, empty files with no chunks."""
    listed = chunks.groupBy("snapshot", "path").agg(F.sort_array(F.collect_list(F.struct("chunk_idx", "digest"))).alias("c"))
    joined = files.select("snapshot", "path", "size", "mode").join(listed, ["snapshot", "path"], "left")
    return joined.select("snapshot", "path", "size", "mode", F.coalesce(F.col("c.digest"), F.array().cast("array<string>")).alias("chunks"))


def to_json(entries: DataFrame, is_directory: bool = True, part_files: int = PART_FILES) -> DataFrame:
    """(snapshot, part, manifest): a snapshot's files as JSON documents, each in order of path.

    A file's part is the hash of its path over as many parts as the snapshot needs, so no document,
    and no task, has to hold a whole snapshot; the parts together list each file once.
    """
    parts = entries.groupBy("snapshot").agg(F.ceil(F.count("*") / part_files).alias("n_parts"))
    dealt = entries.join(parts, "snapshot").withColumn("part", F.pmod(F.xxhash64("path"), F.col("n_parts")))
    files = F.sort_array(F.collect_list(F.struct("path", "size", "mode", "chunks"))).alias("files")
    return dealt.groupBy("snapshot", "part").agg(files).select("snapshot", "part", F.to_json(F.struct(F.lit(is_directory).alias("is_directory"), "files")).alias("manifest"))


def from_json(text: Column) -> Column:
    """The manifest struct; malformed JSON is an error, absent fields have defaults."""
    m = F.from_json(text, MANIFEST, {"mode": "FAILFAST"})
    return F.struct(F.coalesce(m["is_directory"], F.lit(True)).alias("is_directory"), m["files"].alias("files"))


def refs(entries: DataFrame) -> DataFrame:
    """(snapshot, path, chunk_idx, digest): one row for each place that refers to a chunk."""
    return entries.select("snapshot", "path", F.posexplode("chunks").alias("chunk_idx", "digest"))


def info(entries: DataFrame) -> DataFrame:
    """By snapshot: files, logical bytes, references and distinct chunks."""
    return summary(entries, entries.select("snapshot", F.explode("chunks").alias("digest")))


def summary(files: DataFrame, refs: DataFrame) -> DataFrame:
    """The same of files (snapshot, size) and references (snapshot, digest)."""
    chunks = refs.groupBy("snapshot").agg(F.count("digest").alias("refs"), F.count_distinct("digest").alias("distinct_chunks"))
    whole = files.groupBy("snapshot").agg(F.count("*").alias("files"), F.sum("size").alias("logical_bytes"))
    joined = whole.join(chunks, "snapshot", "left").na.fill(0, ["refs", "distinct_chunks"])
    return joined.select("snapshot", "files", "logical_bytes", "refs", "distinct_chunks")
