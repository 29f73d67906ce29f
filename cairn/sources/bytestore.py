"""Stores in the byte format: pack files, an index checkpoint, an index log and JSON manifests.

Layout of a store's folder: ``packs/pack_NNNNNN.pack``, ``index.ckpt``, ``index.wal``, ``manifests/NAME``.
Numbers are little-endian, digests are BLAKE3. The folder is on a file system that all executors share.

Packs are read by a task each, as a stream of records. A checkpoint and a log are one file each, and
their rules (a checksum over all of it; nothing counts after the first bad record) need it in order,
so each is read by one task: 44 bytes an object, 57 bytes a change since the checkpoint.
"""

from __future__ import annotations

import os
import struct
import time
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import checks, codec
from cairn.functions.blake3 import blake3, blake3_many
from cairn.operators import index as ix
from cairn.operators import manifests
from cairn.session import drop_written, written

# Fixed values of the format: marks, versions, layouts, limits.
PACK_MAGIC, OBJECT_MAGIC, CHECKPOINT_MAGIC = b"RELICPAK", b"RLOB", b"RLCKPT01"
PACK_VERSION, CHECKPOINT_VERSION = 1, 1
PACK_HEADER = struct.Struct("<8sIIqI")  # magic, version, pack_id, created_at, crc of what precedes it
OBJECT_HEADER = struct.Struct("<4sBII32sII")  # magic, codec, original_size, stored_size, digest, payload_crc, crc of what precedes it
LOG_RECORD = struct.Struct("<BQ32sIQI")  # op, lsn, digest, pack_id, offset, crc of what precedes it
CHECKPOINT_HEADER = struct.Struct("<8sIQQ32s")  # magic, version, count, lsn, digest of the rows
CHECKPOINT_ROW = struct.Struct("<32sIQ")  # digest, pack_id, offset
PACK_HEADER_BYTES, OBJECT_HEADER_BYTES = PACK_HEADER.size, OBJECT_HEADER.size
MAX_ORIGINAL, MAX_STORED = 1 << 20, 2 << 20

#: Bytes of payload in a batch that a task hands on.
BATCH_BYTES = 8 << 20
OBJECTS = "pack_id bigint, offset bigint, codec tinyint, original_size bigint, stored_size bigint, digest string, payload_crc bigint, payload binary"
CHANGES = "op tinyint, lsn bigint, digest string, pack_id bigint, offset bigint"
PLACES = "digest string, pack_id bigint, offset bigint"


def _sealed(layout: struct.Struct, *values) -> bytes:
    """The record with the CRC of all its other bytes at its end."""
    body = layout.pack(*values, 0)[:-4]
    return body + zlib.crc32(body).to_bytes(4, "little")


def _intact(record: bytes) -> bool:
    return zlib.crc32(record[:-4]) == int.from_bytes(record[-4:], "little")


def pack_header(pack_id: int, created_at: int) -> bytes:
    return _sealed(PACK_HEADER, PACK_MAGIC, PACK_VERSION, pack_id, created_at)


def object_header(codec_id: int, original_size: int, payload: bytes, digest: bytes) -> bytes:
    return _sealed(OBJECT_HEADER, OBJECT_MAGIC, codec_id, original_size, len(payload), digest, zlib.crc32(payload))


def log_record(op: int, lsn: int, digest: bytes, pack_id: int, offset: int) -> bytes:
    return _sealed(LOG_RECORD, op, lsn, digest, pack_id, offset)


def scan_pack(path: str, verify: bool = True) -> Iterator[tuple]:
    """Rows of ``OBJECTS`` up to the first record that is short or bad; a bad pack header is an error."""
    with open(path, "rb") as f:
        head = f.read(PACK_HEADER.size)
        if len(head) < PACK_HEADER.size or not head.startswith(PACK_MAGIC) or not _intact(head):
            raise ValueError(f"bad pack header in {path}")
        _, version, pack_id, _, _ = PACK_HEADER.unpack(head)
        if version != PACK_VERSION:
            raise ValueError(f"unsupported version {version} of {path}")
        while len(head := f.read(OBJECT_HEADER.size)) == OBJECT_HEADER.size:
            magic, kind, original, stored, digest, crc, _ = OBJECT_HEADER.unpack(head)
            if magic != OBJECT_MAGIC or not _intact(head) or original > MAX_ORIGINAL or stored > MAX_STORED:
                return
            payload = f.read(stored)
            if len(payload) < stored or verify and zlib.crc32(payload) != crc:
                return
            yield pack_id, f.tell() - stored - len(head), kind, original, stored, digest.hex(), crc, payload


def _tasks(spark: SparkSession, paths: list[str], rows, schema: str) -> DataFrame:
    """``rows(path)`` of each path, a task each."""
    names = [c.split()[0] for c in schema.split(", ")]
    listed = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths)), "path")
    types = spark.createDataFrame([], schema).toArrow().schema

    def batch(part: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, types.field(n).type) for n, c in zip(names, zip(*part, strict=True), strict=True)], schema=types)

    def run(batches):
        for given in batches:
            for path in given.column(0).to_pylist():
                part, size = [], 0
                for row in rows(path):
                    part.append(row)
                    size += 100 + (len(row[-1]) if isinstance(row[-1], bytes) else 0)
                    if size >= BATCH_BYTES:
                        yield batch(part)
                        part, size = [], 0
                if part:
                    yield batch(part)

    return listed.mapInArrow(run, schema)


def read_packs(spark: SparkSession, folder: str, verify: bool = True) -> DataFrame:
    """Objects of all packs of a folder. Files with other names are skipped; the number in a pack's name must be its own."""
    names = sorted(n for n in os.listdir(folder) if n.startswith("pack_") and n.endswith(".pack") and n[5:-5].isdigit())

    def rows(path: str) -> Iterator[tuple]:
        named = int(os.path.basename(path)[5:-5])
        for row in scan_pack(path, verify):
            if row[0] != named:
                raise ValueError(f"{path} holds pack {row[0]}")
            yield row

    return _tasks(spark, [os.path.join(folder, n) for n in names], rows, OBJECTS)


def audit_packs(spark: SparkSession, folder: str) -> DataFrame:
    """(pack, records, good_bytes, file_bytes): a pack with more bytes than good ones is cut short or damaged."""

    def rows(path: str) -> Iterator[tuple]:
        sizes = [OBJECT_HEADER_BYTES + r[4] for r in scan_pack(path)]
        yield os.path.basename(path), len(sizes), PACK_HEADER_BYTES + sum(sizes), os.path.getsize(path)

    names = sorted(n for n in os.listdir(folder) if n.startswith("pack_") and n.endswith(".pack") and n[5:-5].isdigit())
    return _tasks(spark, [os.path.join(folder, n) for n in names], rows, "pack string, records bigint, good_bytes bigint, file_bytes bigint")


def scan_log(path: str) -> Iterator[tuple]:
    """Rows of ``CHANGES`` up to the first record that is short, bad or of an unknown kind; a missing file has none."""
    if not os.path.exists(path):
        return
    with open(path, "rb") as f:
        while len(record := f.read(LOG_RECORD.size)) == LOG_RECORD.size and _intact(record):
            op, lsn, digest, pack_id, offset, _ = LOG_RECORD.unpack(record)
            if op not in (ix.INSERT, ix.ERASE):
                return
            yield op, lsn, digest.hex(), pack_id, offset


def read_log(spark: SparkSession, path: str) -> DataFrame:
    return _tasks(spark, [path], scan_log, CHANGES)


def checkpoint_lsn(path: str) -> int:
    """0 if the file is missing or shorter than its header."""
    if not os.path.exists(path) or os.path.getsize(path) < CHECKPOINT_HEADER.size:
        return 0
    with open(path, "rb") as f:
        return CHECKPOINT_HEADER.unpack(f.read(CHECKPOINT_HEADER.size))[3]


def scan_checkpoint(path: str) -> Iterator[tuple]:
    """Rows of ``PLACES``; none if the file is missing or shorter than its header, an error if it is damaged."""
    if not os.path.exists(path) or os.path.getsize(path) < CHECKPOINT_HEADER.size:
        return
    with open(path, "rb") as f:
        magic, version, count, _, digest = CHECKPOINT_HEADER.unpack(f.read(CHECKPOINT_HEADER.size))
        body = f.read()
    if magic != CHECKPOINT_MAGIC or version != CHECKPOINT_VERSION or count != len(body) // CHECKPOINT_ROW.size or blake3_many([body])[0] != digest:
        raise ValueError(f"damaged checkpoint {path}")
    for d, pack_id, offset in CHECKPOINT_ROW.iter_unpack(body[: count * CHECKPOINT_ROW.size]):
        yield d.hex(), pack_id, offset


def read_checkpoint(spark: SparkSession, path: str) -> DataFrame:
    return _tasks(spark, [path], scan_checkpoint, PLACES)


def checkpoint_row(digest: bytes, pack_id: int, offset: int) -> bytes:
    return CHECKPOINT_ROW.pack(digest, pack_id, offset)


def checkpoint_bytes(body: bytes, lsn: int) -> bytes:
    return CHECKPOINT_HEADER.pack(CHECKPOINT_MAGIC, CHECKPOINT_VERSION, len(body) // CHECKPOINT_ROW.size, lsn, blake3_many([body])[0]) + body


def read_index(spark: SparkSession, store: str) -> DataFrame:
    """(digest, pack_id, offset): the checkpoint with the log's later changes applied."""
    at = os.path.join(store, "index.ckpt")
    return ix.replay(read_log(spark, os.path.join(store, "index.wal")), read_checkpoint(spark, at), checkpoint_lsn(at))


def read_manifests(spark: SparkSession, store: str, recursive: bool = False) -> DataFrame:
    """(snapshot, is_directory, path, size, mode, chunks): a row for each file; ``.tmp`` names are skipped.

    ``recursive`` takes manifests in folders below too, as marking for garbage collection has to.
    """
    folder = os.path.join(store, "manifests")
    found = [os.path.relpath(os.path.join(d, n), folder) for d, _, names in os.walk(folder) for n in names if os.path.isfile(os.path.join(d, n))]
    names = sorted(n for n in found if not n.endswith(".tmp") and (recursive or os.sep not in n))

    def rows(path: str) -> Iterator[tuple]:
        with open(path, encoding="utf-8") as f:
            yield os.path.relpath(path, folder), f.read()

    texts = _tasks(spark, [os.path.join(folder, n) for n in names], rows, "snapshot string, text string")
    parsed = texts.select("snapshot", manifests.from_json(F.col("text")).alias("m"))
    return parsed.select("snapshot", "m.is_directory", F.inline("m.files"))


def read_files(spark: SparkSession, store: str, snapshot: str) -> DataFrame:
    """(snapshot, path, size, mode, content) of a snapshot; a missing, corrupt or misnamed object is an error."""
    entries = read_manifests(spark, store).where(F.col("snapshot") == snapshot)
    refs = manifests.refs(entries).withColumn("digest", F.lower("digest"))
    objects = read_packs(spark, os.path.join(store, "packs")).join(read_index(spark, store), ["digest", "pack_id", "offset"])
    found = refs.join(objects.select("digest", codec.decoded("codec", "payload", "original_size").alias("bytes")), "digest", "left")
    fault = F.when(F.col("bytes").isNull(), F.raise_error(F.concat(F.lit("missing object "), F.col("digest"))))
    fault = fault.when(F.lower(F.hex(blake3("bytes"))) != F.col("digest"), F.raise_error(F.concat(F.lit("misnamed object "), F.col("digest"))))
    parts = found.select("path", "chunk_idx", F.coalesce(fault.cast("binary"), F.col("bytes")).alias("bytes"))
    whole = parts.groupBy("path").agg(F.expr("listagg(bytes, x'') WITHIN GROUP (ORDER BY chunk_idx)").alias("content"))
    out = entries.join(whole, "path", "left").withColumn("content", F.coalesce("content", F.lit(b"")))
    return out.select("snapshot", "path", "size", "mode", "content")


def write_packs(objects: DataFrame, folder: str, created_at: int | None = None) -> DataFrame:
    """Write packs of (pack_id, digest, codec, original_size, payload), one task each; (digest, pack_id, offset) of what was written.

    Packs are renamed into place when whole. Objects of a pack are in order of their digests.
    """
    os.makedirs(folder, exist_ok=True)
    born = int(time.time()) if created_at is None else created_at
    spark = objects.sparkSession
    rows = objects.select("pack_id", "digest", "codec", "original_size", "payload").repartition("pack_id").sortWithinPartitions("pack_id", "digest")

    def run(batches):
        pack, f, tmp = None, None, ""

        def close() -> None:
            if f is not None:
                f.flush()
                os.fsync(f.fileno())
                f.close()
                os.replace(tmp, os.path.join(folder, f"pack_{pack:06d}.pack"))

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["pack_id"] != pack:
                    close()
                    pack = r["pack_id"]
                    tmp = os.path.join(folder, f".pack_{pack:06d}.{os.getpid()}.{time.time_ns()}.tmp")
                    f = open(tmp, "wb")  # noqa: SIM115
                    f.write(pack_header(pack, born))
                out.append((r["digest"], pack, f.tell()))
                f.write(object_header(r["codec"], r["original_size"], r["payload"], bytes.fromhex(r["digest"])) + r["payload"])
            d, p, o = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.string()), pa.array(p, pa.int64()), pa.array(o, pa.int64())], names=["digest", "pack_id", "offset"])
        close()

    written = rows.mapInArrow(run, PLACES)
    written.write.format("noop").mode("overwrite").save()
    return read_packs(spark, folder).select("digest", "pack_id", "offset")


def _in_one_task(rows: DataFrame, path: str, write) -> int:
    """``write(file, batches)`` by one task, which returns a number; the file is renamed into place when whole."""

    def run(batches):
        tmp = f"{path}.{os.getpid()}.{time.time_ns()}.tmp"
        with open(tmp, "wb") as f:
            n = write(f, batches)
            f.flush()
            os.fsync(f.fileno())
        os.replace(tmp, path)
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return rows.coalesce(1).mapInArrow(run, "n bigint").first()[0]


def write_checkpoint(places: DataFrame, path: str, lsn: int = 0) -> int:
    """The checkpoint of (digest, pack_id, offset); the digest of its rows precedes them, so one task holds their 44 bytes each. Returns how many."""

    def write(f, batches) -> int:
        body, n = bytearray(), 0
        for b in batches:
            for d, pack_id, offset in zip(*(c.to_pylist() for c in b.columns), strict=True):
                body += checkpoint_row(bytes.fromhex(d), pack_id, offset)
                n += 1
        f.write(checkpoint_bytes(bytes(body), lsn))
        return n

    return _in_one_task(places.select("digest", "pack_id", "offset").orderBy("digest"), path, write)


def write_log(changes: DataFrame, path: str) -> int:
    """The log of changes (op, lsn, digest, pack_id, offset) in order of their numbers, as a stream of records; returns how many."""

    def write(f, batches) -> int:
        n = 0
        for b in batches:
            for op, lsn, d, pack_id, offset in zip(*(c.to_pylist() for c in b.columns), strict=True):
                f.write(log_record(op, lsn, bytes.fromhex(d), pack_id, offset))
                n += 1
        return n

    return _in_one_task(changes.select("op", "lsn", "digest", "pack_id", "offset").orderBy("lsn"), path, write)


def write_manifests(files: DataFrame, folder: str) -> int:
    """A JSON manifest for each snapshot of (snapshot, is_directory, path, size, mode, chunks), a file's entry at a time; returns how many."""
    os.makedirs(folder, exist_ok=True)
    texts = files.select("snapshot", "is_directory", F.to_json(F.struct("path", "size", "mode", "chunks")).alias("entry"), "path")
    dealt = texts.repartition("snapshot").sortWithinPartitions("snapshot", "path")

    def run(batches):
        now, f, tmp, n = None, None, "", 0

        def close() -> None:
            if f is not None:
                f.write("]}")
                f.flush()
                os.fsync(f.fileno())
                f.close()
                os.replace(tmp, os.path.join(folder, now))

        for batch in batches:
            for snapshot, is_directory, entry, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if snapshot != now:
                    close()
                    now, n = snapshot, n + 1
                    tmp = os.path.join(folder, f"{snapshot}.{time.time_ns()}.tmp")
                    f = open(tmp, "w", encoding="utf-8")  # noqa: SIM115
                    f.write('{"is_directory":' + ("true" if is_directory else "false") + ',"files":[' + entry)
                else:
                    f.write("," + entry)
        close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    return dealt.mapInArrow(run, "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def export(objects: DataFrame, entries: DataFrame, store: str, as_log: bool = False) -> int:
    """Write objects (digest, pack_id, codec, original_size, payload) and files (snapshot, is_directory, path, size, mode, chunks) as a store.

    Objects get BLAKE3 names, whatever their digests were, and manifests refer to those. Packs first,
    then the index, as a checkpoint or as a log of insertions, then the manifests; returns how many. A snapshot without files has none.
    """
    named = written(objects.select("digest", checks.to_hex(blake3(codec.decoded("codec", "payload", "original_size"))).alias("blake3")), "names")
    places = write_packs(objects.join(named, "digest").drop("digest").withColumnRenamed("blake3", "digest"), os.path.join(store, "packs"))
    log, checkpoint = os.path.join(store, "index.wal"), os.path.join(store, "index.ckpt")
    if as_log:
        # numbers in order of place, a range of them for each task
        numbered = written(places.select("*", F.monotonically_increasing_id().alias("lsn")), "places")
        write_log(numbered.select(F.lit(ix.INSERT).cast("tinyint").alias("op"), (F.col("lsn") + 1).alias("lsn"), "digest", "pack_id", "offset"), log)
        drop_written(numbered)
    else:
        write_checkpoint(places, checkpoint)
        open(log, "ab").close()
    refs = manifests.refs(entries).join(named, "digest").select("snapshot", "path", "chunk_idx", F.col("blake3").alias("digest"))
    files = manifests.file_entries(entries, refs).join(entries.select("snapshot", "path", "is_directory"), ["snapshot", "path"])
    n = write_manifests(files, os.path.join(store, "manifests"))
    drop_written(named)
    return n
