"""The snapshot store: backup, restore, list, remove, gc, fsck, checkpoint, over Parquet.

Layout below one folder, on any file system that Hadoop knows:

    objects/b=<id>/pack=<n>/      payloads of a pack: digest, place, codec, sizes, CRC; packs written together
    index/v=<n>/                  checkpoint of the index
    log/lsn=<n>/                  index changes since, one folder a commit
    CURRENT/v=<n>                 the checkpoint in force: the last
    manifests/<name>/v=<n>/       a snapshot's files and references; the last version is in force
    LOCK                          the writer: machine, process, time

A folder is written aside and renamed into place, and nothing is ever renamed onto something. A
backup renames its packs as one folder, then the index log, then the manifest; a compaction renames
new packs, then one log folder that moves what lives and erases what does not, and deletes the old packs last. So
whatever a crash leaves is either not referred to by the index (objects no reader looks up) or an
older version. The next writer drops what lies aside, and ``gc`` drops packs that the index does not know.

A pack is a hash class of the new digests, as many classes as the new bytes fill packs, so a
chunk's bytes are shuffled once: to the task that compresses and writes its pack.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import math
import os
import posixpath
import re
import socket
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import checks
from cairn.functions import codec as codecs
from cairn.operators import dedup, gc, manifests
from cairn.operators import index as ix
from cairn.session import drop_written, written
from cairn.sources.tree import LARGE, Table, Tree, arrow_schema, batches_of

OBJECT = "digest binary, pack_id bigint, offset bigint, codec tinyint, original_size bigint, stored_size bigint, payload_crc bigint, payload binary"
PLACE = "digest binary, pack_id bigint, offset bigint"
LOG = "lsn bigint, op tinyint, digest binary, pack_id bigint, offset bigint"
FILE = "snapshot string, path string, size bigint, mode int, is_directory boolean"
REF = "snapshot string, path string, chunk_idx bigint, offset bigint, length bigint, digest binary"
META = "version int, count bigint, lsn bigint, checksum bigint"
AT = ["digest", "pack_id", "offset"]
#: Folders of the log that call for a checkpoint, whatever their size: each is a file to open for every command.
LOG_FOLDERS = 64
#: Partitions that packs are dealt to, at most; a task writes several packs one after another.
PACK_TASKS = 20_000


class StoreError(RuntimeError):
    pass


class IndexUnavailable(StoreError):
    """The checkpoint cannot be read; only fsck, list, remove and help work."""


@dataclass
class GcReport:
    totals: dict
    packs: list = field(default_factory=list)
    dangling: int = 0
    reclaimed: int = 0
    dry_run: bool = False
    swept: int = 0  # packs that the index does not know


@dataclass
class FsckReport:
    snapshots: int
    live_chunks: int
    dangling: int
    broken: list[str]
    corrupt: int = 0
    rebuilt: int | None = None
    duplicated: int = 0  # places that hold more than one object
    unplaced: int = 0  # index entries without an object


def _names_of(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _hex(digest: Column | str) -> Column:
    return F.lower(F.hex(digest))


def _born(pid: int) -> str | None:
    """When a process of this machine began, where that can be told; a number used again has another."""
    try:
        with open(f"/proc/{pid}/stat") as f:
            return f.read().rpartition(")")[2].split()[19]
    except OSError:
        return None


class SnapshotStore:
    def __init__(self, spark: SparkSession, path: str, *, pack_bytes: int = dedup.PACK_BYTES):
        self.spark, self.path, self.pack_bytes = spark, path.rstrip("/") or "/", pack_bytes
        self._verified: int | None = None
        self._known: dict[int, dict] = {}

    def __enter__(self) -> SnapshotStore:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None and not self.degraded:
            self.sync()

    # ---- files

    def _p(self, *parts: str) -> str:
        return posixpath.join(self.path, *parts)

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _local(self, path: str) -> str | None:
        """The path as the driver's own file system has it, if it is on that."""
        fs, p = self._fs(path)
        return p.toUri().getPath() if fs.getUri().getScheme() == "file" else None

    def _exists(self, *parts: str) -> bool:
        fs, p = self._fs(self._p(*parts))
        return fs.exists(p)

    def _names(self, folder: str) -> list[str]:
        fs, p = self._fs(self._p(folder))
        names = sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []
        return [n for n in names if not n.endswith(".crc")]

    def _drop(self, *parts: str) -> None:
        fs, p = self._fs(self._p(*parts))
        fs.delete(p, True)

    def _write(self, df: DataFrame, folder: str, by: str | None = None) -> None:
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(by) if by else writer).parquet(folder)
        if local := self._local(folder):  # elsewhere a finished file is durable
            for d, _, names in os.walk(local):
                for p in (d, *(os.path.join(d, n) for n in names)):
                    handle = os.open(p, os.O_RDONLY)
                    os.fsync(handle)
                    os.close(handle)

    def _rename(self, source: str, *parts: str) -> None:
        fs, target = self._fs(self._p(*parts))
        fs.mkdirs(target.getParent())
        if fs.exists(target) or not fs.rename(self._fs(source)[1], target):
            raise StoreError(f"cannot rename to {target}")

    def _publish(self, df: DataFrame, *parts: str) -> None:
        """Write aside, then rename into a place where nothing is."""
        aside = self._p("aside", uuid.uuid4().hex)
        self._write(df, aside)
        self._rename(aside, *parts)

    def _stage(self, df: DataFrame, name: str) -> DataFrame:
        """A table of the command at work; the next writer drops it."""
        folder = self._p("staged", f"{uuid.uuid4().hex}-{name}")
        df.write.parquet(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    # ---- the lock

    def _create(self, path: str, text: str) -> bool:
        """Make a file that does not exist yet; False if it does."""
        if local := self._local(path):
            os.makedirs(os.path.dirname(local), exist_ok=True)
            try:
                handle = os.open(local, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644)
            except FileExistsError:
                return False
            with os.fdopen(handle, "w") as f:
                f.write(text)
            return True
        fs, p = self._fs(path)
        try:
            out = fs.create(p, False)
        except Exception:
            if fs.exists(p):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def owner(self) -> dict | None:
        """Who holds the lock: host, pid, born, since, token; empty if that cannot be read, None if nobody does."""
        fs, p = self._fs(self._p("LOCK"))
        if not fs.exists(p):
            return None
        source = fs.open(p)
        try:
            return json.loads(bytes(source.readAllBytes()).decode())
        except ValueError:
            return {}
        finally:
            source.close()

    @staticmethod
    def _gone(owner: dict) -> bool:
        """Whether the owner was a process of this machine that has ended."""
        if owner.get("host") != socket.gethostname():
            return False
        try:
            os.kill(owner["pid"], 0)
        except ProcessLookupError:
            return True
        except PermissionError:
            pass
        return owner.get("born") != _born(owner["pid"])

    def unlock(self) -> dict | None:
        """Take the lock from whoever holds it, to be used where that writer is known to have died; returns the owner."""
        owner = self.owner()
        self._drop("LOCK")
        return owner

    @contextlib.contextmanager
    def _lock(self) -> Iterator[None]:
        me = {"host": socket.gethostname(), "pid": os.getpid(), "born": _born(os.getpid()), "since": time.strftime("%Y-%m-%dT%H:%M:%S%z"), "token": uuid.uuid4().hex}
        if not self._create(self._p("LOCK"), json.dumps(me)):
            owner = self.owner() or {}
            if not self._gone(owner):
                raise StoreError(f"{self.path} is locked by another writer: {owner}; if that has died, unlock")
            self._drop("LOCK")
            if not self._create(self._p("LOCK"), json.dumps(me)):
                raise StoreError(f"{self.path} is locked by another writer: {self.owner()}")
        try:
            for folder in ("aside", "staged"):
                self._drop(folder)
            yield
        finally:
            if (self.owner() or {}).get("token") == me["token"]:
                self._drop("LOCK")

    # ---- tables

    def _empty(self, schema: str) -> DataFrame:
        return self.spark.createDataFrame([], schema)

    def _pack_folders(self) -> dict[int, str]:
        """Where each pack lies below ``objects``; names come over in one string, as a large store has many."""
        fs, p = self._fs(self._p("objects/b=*/pack=*"))
        found = fs.globStatus(p)
        if not found:
            return {}
        jvm = self.spark._jvm
        text = jvm.java.util.Arrays.deepToString(jvm.java.util.List.of(jvm.org.apache.hadoop.fs.FileUtil.stat2Paths(found)).toArray())
        return {int(k): folder for folder, k in re.findall(r"/objects/(b=[0-9a-f]{32}/pack=([0-9]+))(?=[,\]])", text)}

    def packs(self) -> list[int]:
        return sorted(self._pack_folders())

    def objects(self, packs: list[int] | None = None) -> DataFrame:
        """The objects of some packs, or of all."""
        have = self._pack_folders()
        wanted = sorted(have if packs is None else {*have} & {*packs})
        if not wanted:
            return self._empty(OBJECT)
        return self.spark.read.schema(OBJECT).parquet(*[self._p("objects", have[k]) for k in wanted])

    def _drop_packs(self, packs: list[int]) -> None:
        have = self._pack_folders()
        for k in {*packs} & {*have}:
            self._drop("objects", have.pop(k))
        for batch in {n for n in self._names("objects")} - {f.split("/")[0] for f in have.values()}:
            self._drop("objects", batch)

    def log(self) -> DataFrame:
        """The log after the checkpoint."""
        lsn = self._meta()["lsn"]
        names = [n for n in self._names("log") if int(n[4:]) > lsn]
        return self.spark.read.schema(LOG).parquet(*[self._p("log", n) for n in names]) if names else self._empty(LOG)

    def _lsn(self) -> int:
        marks = [int(n[4:]) for n in self._names("log")]
        return max([*marks, self._meta()["lsn"]])

    def _meta(self) -> dict:
        """The checkpoint in force, checked against its own count and checksum."""
        have = self._names("CURRENT")
        if not have:
            return {"version": 0, "count": 0, "lsn": 0, "checksum": 0}
        version = int(have[-1][2:])
        try:
            meta = self._known.get(version) or self.spark.read.schema(META).parquet(self._p("CURRENT", f"v={version:06d}")).first().asDict()
        except Exception as e:
            raise IndexUnavailable(f"checkpoint {version}: {e}") from e
        self._known = {version: meta}
        if meta["version"] != version or not self._names(f"index/v={version:06d}"):
            raise IndexUnavailable(f"checkpoint {version} is missing")
        return meta

    @staticmethod
    def _summary(index: DataFrame) -> tuple[int, int]:
        r = index.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("digest", "pack_id", "offset")), F.lit(0))).first()
        return r[0], r[1]

    def _base(self, version: int) -> DataFrame:
        return self.spark.read.schema(PLACE).parquet(self._p("index", f"v={version:06d}")) if version else self._empty(PLACE)

    def verify_checkpoint(self) -> None:
        """Raise IndexUnavailable unless the checkpoint's rows match its metadata; a version is read through once."""
        meta = self._meta()
        if meta["version"] and meta["version"] != self._verified:
            try:
                found = self._summary(self._base(meta["version"]))
            except Exception as e:
                raise IndexUnavailable(str(e)) from e
            if found != (meta["count"], meta["checksum"]):
                raise IndexUnavailable(f"checkpoint {meta['version']} does not match its checksum")
            self._verified = meta["version"]

    @property
    def degraded(self) -> bool:
        try:
            self.verify_checkpoint()
        except IndexUnavailable:
            return True
        return False

    def index(self, digests: DataFrame | None = None) -> DataFrame:
        """(digest, pack_id, offset) of all objects in force, or of some digests: the others leave before anything is shuffled, where those are few."""
        meta = self._meta()
        base, log = self._base(meta["version"]), self.log()
        if digests is not None:
            only = digests.select("digest")
            base, log = base.join(only, "digest", "left_semi"), log.join(only, "digest", "left_semi")
        return ix.replay(log, base, meta["lsn"])

    def snapshots(self) -> dict[str, int]:
        """The version in force of each snapshot."""
        fs, p = self._fs(self._p("manifests/*/v=*"))
        found: dict[str, int] = {}
        for s in fs.globStatus(p) or []:
            name, version = s.getPath().getParent().getName(), int(s.getPath().getName()[2:])
            found[name] = max(version, found.get(name, 0))
        return dict(sorted(found.items()))

    def _manifest(self, part: str, schema: str, name: str | None = None) -> DataFrame:
        have = [(n, v) for n, v in self.snapshots().items() if name in (None, n)]
        if not have:
            return self._empty(schema)
        return self.spark.read.schema(schema).parquet(*[self._p("manifests", n, f"v={v:06d}", part) for n, v in have])

    def files(self, name: str | None = None) -> DataFrame:
        return self._manifest("files", FILE, name)

    def refs(self, name: str | None = None) -> DataFrame:
        """A row for each place that refers to a chunk."""
        return self._manifest("refs", REF, name)

    def entries(self, name: str | None = None) -> DataFrame:
        """The files of one snapshot or all, each with its digests in order; a row holds a file's whole list."""
        files = self.files(name)
        listed = manifests.file_entries(files, self.refs(name))
        return listed.join(files.select("snapshot", "path", "is_directory"), ["snapshot", "path"])

    # ---- packs

    def _put(self, rows: DataFrame, size: int) -> list[int]:
        """Write new packs of (digest, bytes) or of objects without a place, ``size`` bytes in all; returns their numbers."""
        first = max([-1, *self.packs()]) + 1
        n = max(1, math.ceil(size / self.pack_bytes))
        columns = [c for c in _names_of(OBJECT) if c not in AT] if "payload" in rows.columns else ["bytes"]
        dealt = rows.select((F.lit(first) + F.pmod(F.xxhash64("digest"), F.lit(n))).cast("bigint").alias("pack_id"), "digest", *columns)
        dealt = dealt.repartition(min(n, PACK_TASKS), "pack_id").sortWithinPartitions("pack_id", "digest")
        schema = arrow_schema(OBJECT)

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            codec, pack, offset = codecs.Codec(), None, 0
            for batch in batches:
                for k in range(batch.num_rows):
                    row = [c[k].as_py() for c in batch.columns]
                    if row[0] != pack:
                        pack, offset = row[0], 0
                    if len(row) == 3:
                        kind, payload = codec.encode(row[2])
                        row[2:] = [kind, len(row[2]), len(payload), zlib.crc32(payload), payload]
                    yield row[1], pack, offset, *row[2:]
                    offset += dedup.OBJECT_HEADER + row[4]

        placed = dealt.mapInArrow(lambda b: batches_of(place(b), schema), OBJECT)
        aside = self._p("aside", uuid.uuid4().hex)
        self._write(placed.withColumn("pack", F.col("pack_id")), aside, by="pack")
        batch = f"b={uuid.uuid4().hex}"
        self._rename(aside, "objects", batch)
        return [k for k, folder in self._pack_folders().items() if folder.startswith(batch)]

    def _append(self, changes: DataFrame) -> None:
        lsn = self._lsn() + 1
        self._publish(changes.select(F.lit(lsn).cast("bigint").alias("lsn"), F.col("op").cast("tinyint").alias("op"), *AT), "log", f"lsn={lsn:012d}")

    # ---- commands

    def backup(self, root: str, name: str) -> dict:
        """Store a file or a folder as snapshot ``name``, replacing one of that name."""
        if not os.path.exists(root):
            raise StoreError(f"{root} does not exist")
        return self._ingest(Tree(self.spark, root), name, os.path.isdir(root))

    def ingest(self, files: DataFrame, name: str, is_directory: bool = True) -> dict:
        """Store rows (path, mode, content) as a snapshot, replacing one of that name."""
        return self._ingest(Table(files), name, is_directory)

    def _ingest(self, source: Tree | Table, name: str, is_directory: bool) -> dict:
        if not checks.valid_name(name):
            raise StoreError(f"invalid snapshot name {name!r}")
        with self._lock():
            self.verify_checkpoint()
            files = self._stage(source.files(), "files")
            twice = files.groupBy("path").count().where("count > 1").first()
            if twice:
                raise StoreError(f"two files share a path: {twice.path!r}")
            refs = self._stage(source.refs(files), "refs")
            once = self._stage(refs.groupBy("digest").agg(F.min(F.struct("path", "offset", "length")).alias("at")).select("digest", "at.*"), "once")
            new = self._stage(once.join(self.index(once).select("digest"), "digest", "left_anti"), "new")
            n, size = new.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
            stored = 0
            if n:
                objects = self.objects(self._put(source.chunks(files, new), size))
                kept, stored = objects.agg(F.count("*"), F.sum("stored_size")).first()
                if kept != n:
                    raise StoreError(f"{kept} objects were written instead of {n}")
                self._append(objects.select(F.lit(ix.INSERT).alias("op"), *AT))
            version = self.snapshots().get(name, 0) + 1
            sizes = refs.groupBy("path").agg(F.sum("length").alias("bytes"))
            listed = files.join(sizes, "path", "left").select(F.lit(name).alias("snapshot"), "path", F.coalesce("bytes", F.lit(0)).cast("bigint").alias("size"), "mode", F.lit(is_directory).alias("is_directory"))
            aside = self._p("aside", uuid.uuid4().hex)
            self._write(listed, posixpath.join(aside, "files"))
            self._write(refs.select(F.lit(name).alias("snapshot"), *_names_of(REF)[1:]), posixpath.join(aside, "refs"))
            self._rename(aside, "manifests", name, f"v={version:06d}")
            for old in self._names(f"manifests/{name}"):
                if int(old[2:]) < version:
                    self._drop("manifests", name, old)
            self._drop("staged")
            self._checkpoint_if_due()
            e = self.files(name).agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
            return {"files": e[0], "logical_bytes": e[1], "new_objects": n, "stored_bytes": stored}

    def restore(self, name: str, out: str) -> int:
        """Write a snapshot's files below ``out`` (a single-file snapshot to ``out`` itself); returns how many.

        Only the packs that hold the snapshot's chunks are read, and only stored bytes are shuffled,
        once at most to the join and once to the tasks that write; those check CRC, size and digest,
        and each writes its part of a file at its place.
        """
        self.verify_checkpoint()
        if name not in self.snapshots():
            raise StoreError(f"no snapshot {name!r}")
        files, refs = self.files(name), self.refs(name)
        bad = files.where(~checks.path_ok(F.col("path"))).select("path").first()
        if bad:
            raise StoreError(f"unsafe path {bad.path!r}")
        digests = refs.select("digest").distinct()
        wanted = written(digests.join(self.index(digests), "digest", "left"), "wanted")
        lost = wanted.where("pack_id IS NULL").first()
        packs = [r.pack_id for r in wanted.select("pack_id").distinct().collect()]  # a row for each pack
        held = self.objects([p for p in packs if p is not None])
        lost = lost or wanted.join(held.select(AT), AT, "left_anti").first()
        if lost:
            raise StoreError(f"missing object {bytes(lost.digest).hex()}")
        whole = files.select("path", "is_directory", "size", "mode")
        parts = written(refs.select("path", F.col("offset").alias("at"), "length", "digest").join(wanted, "digest"), "parts")
        rows = held.join(parts, AT).join(whole.select("path", "is_directory"), "path")
        rows = rows.select("path", "is_directory", "at", "length", "digest", "codec", "original_size", "payload_crc", "payload")
        rows = rows.repartition("path", F.floor(F.col("at") / LARGE)).sortWithinPartitions("path", "at")

        def target(path: str, is_directory: bool) -> str:
            return os.path.join(out, path) if is_directory else out

        def create(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for batch in batches:
                for path, is_directory, size, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    file = target(path, is_directory)
                    os.makedirs(os.path.dirname(os.path.abspath(file)), exist_ok=True)
                    with contextlib.suppress(FileNotFoundError):
                        os.unlink(file)
                    with open(file, "wb") as f:
                        f.truncate(size)
                yield (batch.num_rows,)

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            codec, handle, now, done = codecs.Codec(), None, None, 0
            for batch in batches:
                for k in range(batch.num_rows):
                    path, is_directory, at, length, digest, kind, size, crc, payload = (c[k].as_py() for c in batch.columns)
                    if path != now:
                        if handle:
                            handle.close()
                            yield now, done
                        handle, now, done = open(target(path, is_directory), "r+b"), path, 0
                    if zlib.crc32(payload) != crc:
                        raise ValueError(f"corrupt payload {digest.hex()}")
                    data = codec.decode(kind, payload, size)
                    if len(data) != length or hashlib.sha256(data).digest() != digest:
                        raise ValueError(f"corrupt object {digest.hex()}")
                    handle.seek(at)
                    handle.write(data)
                    done += length
            if handle:
                handle.close()
                yield now, done

        def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
            for batch in batches:
                for path, is_directory, _, mode in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if mode:
                        with contextlib.suppress(PermissionError):
                            os.chmod(target(path, is_directory), mode)
                yield (batch.num_rows,)

        counted, summed = arrow_schema("n bigint"), arrow_schema("path string, bytes bigint")
        whole.mapInArrow(lambda b: batches_of(create(b), counted), "n bigint").count()
        sizes = written(rows.mapInArrow(lambda b: batches_of(fill(b), summed), "path string, bytes bigint"), "filled")
        filled = whole.join(sizes.groupBy("path").agg(F.sum("bytes").alias("bytes")), "path", "left")
        wrong = filled.where("coalesce(bytes, 0) <> size").first()
        if wrong:
            raise StoreError(f"{wrong.path!r} has {wrong.bytes} bytes of {wrong['size']}")
        done = whole.mapInArrow(lambda b: batches_of(finish(b), counted), "n bigint").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        drop_written(wanted, parts, sizes)
        return done

    def list(self) -> DataFrame:
        """(name, manifest_bytes) of the snapshots, in order of name."""
        rows = []
        for n, v in self.snapshots().items():
            fs, p = self._fs(self._p("manifests", n, f"v={v:06d}"))
            rows.append((n, fs.getContentSummary(p).getLength()))
        return self.spark.createDataFrame(rows, "name string, manifest_bytes bigint").orderBy("name")

    def remove(self, name: str) -> None:
        if name not in self.snapshots():
            raise StoreError(f"no snapshot {name!r}")
        with self._lock():
            gone = self._p("aside", uuid.uuid4().hex)
            fs, p = self._fs(gone)
            fs.mkdirs(p.getParent())
            if not fs.rename(self._fs(self._p("manifests", name))[1], p):  # all versions at once
                raise StoreError(f"cannot remove {name!r}")
            fs.delete(p, True)

    def info(self, name: str | None = None) -> DataFrame:
        return manifests.summary(self.files(name), self.refs(name))

    def sync(self) -> bool:
        """Write a checkpoint if one is due; whether it was."""
        with self._lock():
            self.verify_checkpoint()
            return self._checkpoint_if_due()

    def checkpoint(self) -> int:
        """Write the index as a new checkpoint and empty the log; returns the version."""
        with self._lock():
            self.verify_checkpoint()
            return self._checkpoint(self.index())

    def _checkpoint(self, index: DataFrame) -> int:
        version = max([0, *(int(n[2:]) for folder in ("index", "CURRENT") for n in self._names(folder))]) + 1
        logged = self._names("log")
        lsn = max([int(n[4:]) for n in logged], default=0)
        with contextlib.suppress(IndexUnavailable):
            lsn = max(lsn, self._meta()["lsn"])
        self._publish(index.select(AT), "index", f"v={version:06d}")
        count, checksum = self._summary(self._base(version))
        self._publish(self.spark.createDataFrame([(version, count, lsn, checksum)], META), "CURRENT", f"v={version:06d}")
        for n in logged:
            self._drop("log", n)
        for folder in ("CURRENT", "index"):
            for n in self._names(folder):
                if int(n[2:]) < version:
                    self._drop(folder, n)
        return version

    def checkpoint_due(self) -> bool:
        """By the log's size against the checkpoint's, or its number of folders."""
        fs, p = self._fs(self._p("index"))
        size = fs.getContentSummary(p).getLength() if fs.exists(p) else 0
        return len(self._names("log")) >= LOG_FOLDERS or ix.checkpoint_due(self.log().count(), size)

    def _checkpoint_if_due(self) -> bool:
        due = self.checkpoint_due()
        if due:
            self._checkpoint(self.index())
        return due

    def classified(self) -> DataFrame:
        return gc.classify(self.objects().select(*AT, "stored_size"), self.index(), gc.live(self.refs()))

    def gc(self, dry_run: bool = False, threshold: float = gc.THRESHOLD, include_orphans: bool = False) -> GcReport:
        """Mark, analyse and select; then compact unless ``dry_run``.

        Packs of which the index knows nothing are what a crash has left; they go too, unless some
        reference is dangling: then the index may be what is wrong.
        """
        with contextlib.nullcontext() if dry_run else self._lock():
            self.verify_checkpoint()
            classified = written(self.classified(), "classified")
            report = GcReport(gc.totals(classified).first().asDict(), dry_run=dry_run)
            report.dangling = gc.live(gc.dangling(self.refs(), self.index())).count()
            picked = gc.select_packs(gc.pack_stats(classified), threshold)
            if include_orphans:
                picked = picked.select("pack_id").union(classified.where("state = 'orphan'").select("pack_id")).distinct()
            report.packs = [r.pack_id for r in picked.select("pack_id").collect()]  # a row for each pack of garbage
            unknown = classified.groupBy("pack_id").agg(F.count_if(F.col("state") != "orphan").alias("known")).where("known = 0")
            left = [] if report.dangling else sorted({r.pack_id for r in unknown.collect()} | ({*self.packs()} - {r.pack_id for r in classified.select("pack_id").distinct().collect()}))
            report.swept = len(left)
            if not dry_run:
                if report.packs:
                    report.reclaimed = self._compact(classified, report.packs)
                self._drop_packs(left)
            drop_written(classified)
        return report

    def _compact(self, classified: DataFrame, packs: list[int]) -> int:
        """Copy what lives out of ``packs`` verbatim, put the index without the rest in force, then drop them; no other pack is read."""
        chosen = self.spark.createDataFrame([(p,) for p in packs], "pack_id bigint")
        plan = self._stage(gc.compact_plan(classified, chosen), "plan")
        sums = {r.action: (r.n, r.b) for r in plan.groupBy("action").agg(F.count("*").alias("n"), F.sum("record_bytes").alias("b")).collect()}
        n, size = sums.get("copy", (0, 0))
        gone = plan.where("action = 'erase'")
        changes = gone.select(F.lit(ix.ERASE).alias("op"), "digest", F.lit(0).cast("bigint").alias("pack_id"), F.lit(0).cast("bigint").alias("offset"))
        if n:
            kept = self.objects(packs).join(plan.where("action = 'copy'").select(AT), AT, "left_semi")
            moved = self.objects(self._put(kept, size))
            if moved.count() != n:
                raise StoreError(f"{moved.count()} objects were moved instead of {n}; gc again, or fsck")
            changes = changes.unionByName(moved.select(F.lit(ix.INSERT).alias("op"), *AT))
        self._append(changes)
        self._checkpoint(self.index())
        self._drop_packs(packs)
        self._drop("staged")
        return sums.get("erase", (0, 0))[1]

    def _sound(self) -> DataFrame:
        """The objects whose CRC and digest hold."""
        intact = self.objects().where(F.crc32("payload") == F.col("payload_crc"))
        return intact.where(F.sha2(codecs.decoded("codec", "payload", "original_size"), 256) == _hex("digest"))

    def fsck(self, rebuild: bool = False, deep: bool = False) -> FsckReport:
        """Audit references, index and objects against each other.

        ``rebuild`` makes the index anew from the objects; ``deep`` re-hashes payloads and keeps
        corrupt ones out of that index.
        """
        rebuilt = None
        if rebuild:
            with self._lock():
                self._checkpoint(ix.rebuild((self._sound() if deep else self.objects()).select(AT)))
                rebuilt = self._meta()["count"]
        try:
            self.verify_checkpoint()
            index = self.index()
        except IndexUnavailable:
            index = self._empty(PLACE)
        audit = gc.audit(self.refs(), index).collect()  # a row for each snapshot
        at = self.objects().select(AT)
        report = FsckReport(len(self.snapshots()), sum(r.refs for r in audit), sum(r.dangling for r in audit), sorted(r.snapshot for r in audit if r.broken), rebuilt=rebuilt)
        report.duplicated = at.groupBy(AT).count().where("count > 1").count()
        report.unplaced = index.join(at, AT, "left_anti").count()
        if deep:
            report.corrupt = self.objects().count() - self._sound().count()
        return report
