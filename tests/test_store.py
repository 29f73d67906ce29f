import json
import os
import random
import socket

import pytest
from pyspark.sql import functions as F

from cairn import store as store_module
from cairn.operators import gc
from cairn.operators import index as ix
from cairn.operators import manifests
from cairn.sources import tree as tree_source
from cairn.sources.tree import Tree
from cairn.store import PLACE, IndexUnavailable, SnapshotStore, StoreError


@pytest.fixture
def tree(tmp_path):
    rng = random.Random(3)
    root = tmp_path / "tree"
    for name, data in {"a.bin": rng.randbytes(120_000), "b/c d.txt": b"text " * 9000, "b/.hidden": b"h", "b/empty": b"", "é/ü.txt": "größe".encode() * 100}.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    os.chmod(root / "b/.hidden", 0o600)
    return root


def contents(root):
    return {os.path.relpath(os.path.join(d, n), root): open(os.path.join(d, n), "rb").read() for d, _, names in os.walk(root) for n in names}


def test_life_of_a_store(spark, tree, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"), pack_bytes=60_000)
    first = store.backup(str(tree), "one")
    assert first["files"] == 5 and first["new_objects"] > 5
    assert store.backup(str(tree), "two")["new_objects"] == 0
    assert store.restore("two", str(tmp_path / "out")) == 5
    assert contents(tmp_path / "out") == contents(tree)
    assert os.stat(tmp_path / "out/b/.hidden").st_mode & 0o777 == 0o600
    assert [r.name for r in store.list().collect()] == ["one", "two"]
    assert {r.snapshot: r.files for r in store.info().collect()} == {"one": 5, "two": 5}
    store.checkpoint()
    (tree / "a.bin").write_bytes(random.Random(4).randbytes(120_000))
    store.backup(str(tree), "three")
    store.remove("one")
    store.remove("two")
    dry = store.gc(dry_run=True)
    assert dry.reclaimed == 0 and dry.totals["garbage_objects"] > 0 and dry.packs
    done = store.gc()
    assert done.reclaimed > 0 and done.dangling == 0
    assert store.gc(dry_run=True).totals["orphan_objects"] == 0
    report = store.fsck(deep=True)
    assert (report.snapshots, report.dangling, report.broken, report.corrupt) == (1, 0, [], 0)
    before = sorted(map(tuple, store.index().collect()))
    assert store.fsck(rebuild=True).rebuilt == len(before) and sorted(map(tuple, store.index().collect())) == before
    store.restore("three", str(tmp_path / "out3"))
    assert contents(tmp_path / "out3") == contents(tree)
    for bad in ("", "..", "a/b", "x.tmp"):
        with pytest.raises(StoreError):
            store.backup(str(tree), bad)
    with pytest.raises(StoreError):
        store.restore("none", str(tmp_path / "x"))
    with store._lock(), pytest.raises(StoreError, match="locked"):
        store.backup(str(tree), "four")


def test_single_file_and_degraded_store(spark, tree, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    assert store.gc(dry_run=True).packs == [] and store.fsck().snapshots == 0
    store.backup(str(tree / "a.bin"), "file")
    store.restore("file", str(tmp_path / "copy"))
    assert (tmp_path / "copy").read_bytes() == (tree / "a.bin").read_bytes()
    version = store.checkpoint()
    spark.createDataFrame([], PLACE).write.mode("overwrite").parquet(str(tmp_path / f"store/index/v={version:06d}"))
    store = SnapshotStore(spark, str(tmp_path / "store"))
    assert store.degraded
    with pytest.raises(IndexUnavailable):
        store.backup(str(tree), "more")
    assert store.fsck().broken == ["file"] and [r.name for r in store.list().collect()] == ["file"]
    assert store.fsck(rebuild=True).broken == [] and not store.degraded


def damage(store, **changes):
    """Rewrite every pack with some columns changed."""
    for k, folder in store._pack_folders().items():
        store._write(store.objects([k]).withColumns(changes), store._p("aside", str(k)))
        store._drop("objects", folder)
        store._rename(store._p("aside", str(k)), "objects", folder)


def hidden(byte):
    """The payloads, but another one for the file of one byte."""
    return F.when(F.col("original_size") == 1, F.lit(byte)).otherwise(F.col("payload"))


def test_corruption_is_found(spark, tree, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    store.backup(str(tree), "s")
    damage(store, payload=hidden(b"H"))
    assert store.fsck(deep=True).corrupt == 1
    with pytest.raises(Exception, match="corrupt payload"):
        store.restore("s", str(tmp_path / "out"))
    assert store.fsck(rebuild=True).broken == []
    report = store.fsck(rebuild=True, deep=True)
    assert (report.corrupt, report.dangling, report.broken, report.rebuilt) == (1, 1, ["s"], store.objects().count() - 1)
    with pytest.raises(StoreError, match="missing object"):
        store.restore("s", str(tmp_path / "out"))


def test_wrong_bytes_under_a_right_crc_and_doubled_objects_are_found(spark, tree, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    store.backup(str(tree), "s")
    damage(store, payload=hidden(b"H"), payload_crc=F.crc32(hidden(b"H")))
    with pytest.raises(Exception, match="corrupt object"):
        store.restore("s", str(tmp_path / "out"))
    damage(store, payload=hidden(b"h"), payload_crc=F.crc32(hidden(b"h")))
    store.restore("s", str(tmp_path / "out"))
    store.objects().limit(2).write.mode("append").parquet(store._p("objects", store._pack_folders()[0]))
    assert store.fsck().duplicated == 2
    with pytest.raises(StoreError, match="bytes of"):
        store.restore("s", str(tmp_path / "out"))
    store._drop_packs([0])
    assert store.fsck().unplaced == store.index().count()


def dying(store, monkeypatch, after):
    """Let the store raise at its ``after``-th rename or deletion of a pack, log or manifest; returns the calls so far."""
    calls = []
    for name in ("_rename", "_drop"):
        plain = getattr(SnapshotStore, name)

        def step(self, *args, plain=plain, name=name):
            if name == "_rename" or args[0] in ("objects", "log", "manifests"):
                calls.append((name, args))
                if len(calls) == after:
                    raise RuntimeError("crash")
            return plain(self, *args)

        monkeypatch.setattr(SnapshotStore, name, step)
    return calls


def test_crashes_at_every_step(spark, tree, tmp_path, monkeypatch):
    """Whatever step of a backup or a compaction is the last, readers see whole snapshots and the next commands go on."""
    path, out = str(tmp_path / "store"), str(tmp_path / "out")
    SnapshotStore(spark, path, pack_bytes=60_000).backup(str(tree), "s")
    before = contents(tree)
    (tree / "a.bin").write_bytes(random.Random(9).randbytes(50_000))
    for command in ("backup", "gc"):
        for after in range(1, 40):
            store = SnapshotStore(spark, path, pack_bytes=60_000)
            with monkeypatch.context() as m:
                dying(store, m, after)
                try:
                    store.backup(str(tree), "s") if command == "backup" else store.gc(threshold=0.01)
                    crashed = False
                except RuntimeError as e:
                    crashed = "crash" in str(e)
                    assert crashed
            store = SnapshotStore(spark, path, pack_bytes=60_000)
            report = store.fsck()
            assert (report.dangling, report.duplicated, report.broken) == (0, 0, [])
            store.restore("s", out)
            assert contents(out) == (before if command == "backup" and crashed and contents(out) != contents(tree) else contents(tree))
            if not crashed:
                break
        assert after > 3 and not crashed
    done = store.gc()
    assert done.totals["orphan_objects"] == 0 and store.fsck(deep=True).unplaced == 0
    assert store.objects().count() == store.index().count() == done.totals["live_objects"] + done.totals["garbage_objects"]


def test_locks(spark, tree, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    store.backup(str(tree / "b"), "s")
    left = {"host": socket.gethostname(), "pid": os.getpid(), "born": "an earlier process", "token": "x"}
    (tmp_path / "store/LOCK").write_text(json.dumps(left))
    (tmp_path / "store/aside").mkdir(exist_ok=True)
    (tmp_path / "store/aside/half").write_text("x")
    store.remove("s")  # the owner has ended, so its lock is taken over and what it left is dropped
    assert not (tmp_path / "store/aside/half").exists() and store.owner() is None
    (tmp_path / "store/LOCK").write_text(json.dumps(left | {"host": "elsewhere"}))
    with pytest.raises(StoreError, match="elsewhere"):
        store.backup(str(tree / "b"), "s")
    assert store.unlock()["host"] == "elsewhere"
    (tmp_path / "store/LOCK").write_text("")  # its writer died while it made it
    with pytest.raises(StoreError, match="locked"):
        store.sync()
    assert store.unlock() == {} and store.sync() is False


def test_what_is_read(spark, tree, tmp_path, monkeypatch):
    """An unchanged backup reads no chunk again, a restore reads only its packs, and of files only wanted bytes are shuffled."""
    store = SnapshotStore(spark, str(tmp_path / "store"), pack_bytes=60_000)
    store.backup(str(tree), "one")
    packs = store.packs()
    (tree / "a.bin").write_bytes(random.Random(4).randbytes(120_000))
    store.backup(str(tree / "a.bin"), "two")
    assert store.packs()[: len(packs)] == packs
    with monkeypatch.context() as m:
        m.setattr(Tree, "chunks", lambda *_: pytest.fail("read again"))
        assert store.backup(str(tree / "a.bin"), "three")["new_objects"] == 0
    store._drop_packs(packs)
    assert store.restore("three", str(tmp_path / "copy")) == 1
    assert (tmp_path / "copy").read_bytes() == (tree / "a.bin").read_bytes()
    source = Tree(spark, str(tree))
    files = store._stage(source.files(), "files")
    refs = store._stage(source.refs(files), "refs")
    plan = source.chunks(files, refs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan.split("MapInArrow")[0] and "bytes" not in plan.split("MapInArrow")[1].split("\n", 1)[1]


def test_large_files_are_cut_by_several_tasks(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    (tmp_path / "in/deep/er").mkdir(parents=True)
    for k, data in enumerate([rng.randbytes(700_000), b"\0" * 300_000, b"ab" * 1_000_000, rng.randbytes(90_000), b""]):
        (tmp_path / f"in/{'deep/er/' * (k % 2)}f{k}").write_bytes(data)
    t = Tree(spark, str(tmp_path / "in"))
    whole = {tuple(r) for r in t.refs(t.files()).collect()}
    monkeypatch.setattr(tree_source, "LARGE", 100_000)
    monkeypatch.setattr(tree_source, "TASK_BYTES", 150_000)
    monkeypatch.setattr(tree_source, "FOLDERS", 2)
    monkeypatch.setattr(store_module, "LARGE", 100_000)
    assert {tuple(r) for r in t.refs(t.files()).collect()} == whole and len(whole) > 150
    store = SnapshotStore(spark, str(tmp_path / "store"))
    assert store.backup(str(tmp_path / "in"), "s")["files"] == 5
    assert store.restore("s", str(tmp_path / "out")) == 5 and contents(tmp_path / "out") == contents(tmp_path / "in")


def test_checkpoints_come_by_themselves(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "LOG_FOLDERS", 3)
    schema = "path string, mode int, content binary"
    with SnapshotStore(spark, str(tmp_path / "store")) as store:
        for k in range(4):
            store.ingest(spark.createDataFrame([("f", 0, bytearray(b"%d" % k * 3000))], schema), "s")
            assert len(store._names("log")) == (k + 1) % 3
    assert store.index().count() == 4 and store._names("manifests/s") == ["v=000004"] and store._names("staged") == []
    monkeypatch.setattr(ix, "CHECKPOINT_BYTES", 1)
    assert SnapshotStore(spark, str(tmp_path / "store")).checkpoint_due() is False  # the checkpoint is much larger than the log


def test_stream_of_files(spark, tmp_path, monkeypatch):
    from cairn.streaming.ingest import ingest_stream

    rows = spark.createDataFrame([("a", 0, bytearray(b"abc")), ("b", 0, bytearray(b"abc"))], "path string, mode int, content binary")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    store = SnapshotStore(spark, str(tmp_path / "store"))
    stream = lambda: ingest_stream(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), store, str(tmp_path / "cp")).awaitTermination()
    with monkeypatch.context() as m:
        dying(store, m, 3)  # the objects and the log are in place, the manifest is not
        with pytest.raises(Exception, match="crash"):
            stream()
    assert store.snapshots() == {} and store.objects().count() == 1
    stream()
    assert [r.name for r in store.list().collect()] == ["batch-000000"] and store.objects().count() == 1


def test_log_rules(spark):
    log = spark.createDataFrame([(1, 1, "a", 0, 0), (2, 1, "b", 0, 9), (3, 2, "a", 0, 0), (4, 1, "b", 1, 5)], "lsn long, op int, digest string, pack_id long, offset long")
    assert list(map(tuple, ix.replay(log).collect())) == [("b", 1, 5)]
    base = ix.replay(log.where("lsn <= 2"))
    assert list(map(tuple, ix.replay(log, base, 2).collect())) == [("b", 1, 5)]
    marked = log.select("lsn", (F.col("lsn") != 3).alias("ok"))
    assert [r.lsn for r in ix.valid_prefix(marked, "lsn").orderBy("lsn").collect()] == [1, 2]
    assert ix.valid_prefix(marked.where("ok"), "lsn").count() == 3
    assert ix.checkpoint_due(1_177_349, 0) and not ix.checkpoint_due(1_177_348, 0)


def test_pack_selection_threshold(spark):
    stats = spark.createDataFrame([(0, 50, 50), (1, 51, 49), (2, 0, 0), (3, 0, 10), (4, 10, 10)], "pack_id long, live_bytes long, garbage_bytes long")
    assert [r.pack_id for r in gc.select_packs(stats).collect()] == [3, 0, 4]


def test_paths_must_be_unique_and_repeats_are_stored_once(spark, tmp_path):
    store = SnapshotStore(spark, str(tmp_path / "store"))
    schema = "path string, mode int, content binary"
    same = random.Random(5).randbytes(30_000)
    rows = [(f"f{i}", 0, bytearray(same)) for i in range(6)]
    first = store.ingest(spark.createDataFrame(rows, schema), "same")
    refs = store.refs().count()
    assert first["files"] == 6 and refs == 6 * first["new_objects"] == 6 * store.objects().count()
    mixed = [("x", 0, bytearray(b"a" * 3000)), ("x", 0, bytearray(b"b" * 3000))]
    with pytest.raises(Exception, match="share a path"):
        store.ingest(spark.createDataFrame(mixed, schema), "mixed")
    assert [r.name for r in store.list().collect()] == ["same"] and store.refs().count() == refs
    assert store.ingest(spark.createDataFrame(rows[:2], schema), "again")["new_objects"] == 0
    assert store.ingest(spark.createDataFrame([], schema), "empty")["files"] == 0
    assert {r.snapshot: (r.files, r.refs) for r in store.info().collect()} == {"same": (6, refs), "again": (2, refs // 3)}


def test_manifest_in_parts_lists_each_file_once(spark):
    entries = spark.range(50).selectExpr("if(id < 40, 'big', 'small') AS snapshot", "string(id) AS path", "id AS size", "0 AS mode", "array(sha2(string(id), 256)) AS chunks")
    text = manifests.to_json(entries, part_files=7)
    assert text.where("snapshot = 'big'").count() > 1
    read = text.select("snapshot", manifests.from_json(F.col("manifest")).alias("m")).select("snapshot", F.explode("m.files").alias("f")).select("snapshot", "f.path", "f.size", "f.mode", "f.chunks")
    assert sorted(map(str, read.collect())) == sorted(map(str, entries.collect()))
    assert manifests.to_json(entries).count() == 2
