import os
import random

import pytest
from pyspark.sql import functions as F

from cairn.__main__ import export_store, import_store
from cairn.functions.blake3 import blake3, blake3_many
from cairn.operators import index as ix
from cairn.sources import bytestore as bs
from cairn.store import SnapshotStore


def test_blake3_against_the_jvm(spark):
    java = spark._jvm.org.apache.commons.codec.digest.Blake3
    rng = random.Random(3)
    items = [rng.randbytes(n) for n in (0, 1, 63, 64, 65, 1023, 1024, 1025, 2048, 2049, 3072, 4097, 10_000, 31_744, 65_536, 100_001)]
    assert blake3_many(items) == [bytes(java.hash(bytearray(x))) for x in items]
    assert blake3_many([]) == [] and blake3_many([b""])[0].hex().startswith("af1349b9f5f9a1a6")
    got = spark.createDataFrame([*enumerate(items), (-1, None)], "i int, c binary").select("i", blake3("c").alias("d")).collect()
    assert {r.i: r.d and bytes(r.d) for r in got} == {-1: None, **dict(enumerate(blake3_many(items)))}


def test_layout():
    assert [x.size for x in (bs.PACK_HEADER, bs.OBJECT_HEADER, bs.LOG_RECORD, bs.CHECKPOINT_HEADER, bs.CHECKPOINT_ROW)] == [28, 53, 57, 60, 44]
    assert bs.pack_header(7, 1)[:16] == b"RELICPAK\1\0\0\0\7\0\0\0"


@pytest.fixture
def exported(spark, tmp_path):
    rng = random.Random(3)
    tree = {"a.bin": rng.randbytes(120_000), "b/c d.txt": b"text " * 9000, "b/copy.txt": b"text " * 9000, "b/.hidden": b"h", "b/empty": b""}
    for name, data in tree.items():
        (tmp_path / "tree" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "tree" / name).write_bytes(data)
    store = SnapshotStore(spark, str(tmp_path / "store"), pack_bytes=60_000)
    store.backup(str(tmp_path / "tree"), "one")
    out = str(tmp_path / "bytes")
    assert export_store(store, out) == {"snapshots": 1}
    return tree, out, store


def test_round_trip_of_a_store(spark, exported, tmp_path):
    tree, out, store = exported
    files = bs.read_files(spark, out, "one")
    assert {r.path: bytes(r.content) for r in files.collect()} == tree
    objects = bs.read_packs(spark, os.path.join(out, "packs"))
    assert objects.select("pack_id").distinct().count() > 1 and objects.count() == store.objects().count()
    assert sorted(map(tuple, bs.read_index(spark, out).collect())) == sorted(map(tuple, ix.rebuild(objects).collect()))
    again = SnapshotStore(spark, str(tmp_path / "again"))
    assert [r["files"] for r in import_store(again, out)] == [len(tree)]
    assert again.index().count() == store.index().count()
    assert bs.read_files(spark, out, "none").count() == 0


def test_damage(spark, exported):
    tree, out, _ = exported
    pack = os.path.join(out, "packs", sorted(os.listdir(os.path.join(out, "packs")))[0])
    data = open(pack, "rb").read()
    rows = list(bs.scan_pack(pack))
    second = rows[1][1]
    os.makedirs(os.path.join(out, "manifests/below"))
    with open(os.path.join(out, "manifests/one")) as f, open(os.path.join(out, "manifests/below/two"), "w") as g:
        g.write(f.read())
    files = {recursive: {r.snapshot for r in bs.read_manifests(spark, out, recursive).select("snapshot").collect()} for recursive in (False, True)}
    assert files == {False: {"one"}, True: {"one", "below/two"}}
    open(pack, "ab").write(b"torn")
    first = bs.audit_packs(spark, os.path.join(out, "packs")).orderBy("pack").collect()
    assert tuple(first[0])[1:] == (len(rows), len(data), len(data) + 4) and all(r.good_bytes == r.file_bytes for r in first[1:])
    for cut in (second, second + 20, second + 60):  # between records, within a header, within a payload
        open(pack, "wb").write(data[:cut])
        assert list(bs.scan_pack(pack)) == rows[:1]
    bad = bytearray(data)
    bad[second + 53] ^= 1
    open(pack, "wb").write(bad)
    assert list(bs.scan_pack(pack)) == rows[:1] and len(list(bs.scan_pack(pack, verify=False))) == len(rows)
    with pytest.raises(Exception, match="misnamed|corrupt|missing|zstd|decompress"):
        bs.read_files(spark, out, "one").collect()
    open(pack, "wb").write(b"x" * 40)
    with pytest.raises(ValueError, match="pack header"):
        list(bs.scan_pack(pack))
    open(pack, "wb").write(data)
    os.rename(pack, pack.replace("pack_0", "pack_9"))
    with pytest.raises(Exception, match="holds pack"):
        bs.read_packs(spark, os.path.join(out, "packs")).collect()
    at = os.path.join(out, "index.ckpt")
    body = bytearray(open(at, "rb").read())
    body[-1] ^= 1
    open(at, "wb").write(body)
    with pytest.raises(Exception, match="damaged checkpoint"):
        bs.read_checkpoint(spark, at).collect()
    open(at, "wb").write(body[:30])
    assert bs.read_checkpoint(spark, at).count() == 0 and bs.checkpoint_lsn(at) == 0


def test_log(spark, tmp_path):
    a, b = b"\1" * 32, b"\2" * 32
    records = [bs.log_record(1, 1, a, 0, 28), bs.log_record(1, 2, b, 0, 99), bs.log_record(2, 3, a, 0, 0), bs.log_record(3, 4, b, 0, 0), bs.log_record(2, 5, b, 0, 0)]
    path = tmp_path / "index.wal"
    assert bs.read_log(spark, str(path)).count() == 0
    path.write_bytes(b"".join(records))
    assert [r.lsn for r in bs.read_log(spark, str(path)).orderBy("lsn").collect()] == [1, 2, 3]
    assert [tuple(r) for r in bs.read_index(spark, str(tmp_path)).collect()] == [(b.hex(), 0, 99)]
    bs.write_checkpoint(spark.createDataFrame([(a.hex(), 3, 28)], bs.PLACES), str(tmp_path / "index.ckpt"), lsn=1)
    assert bs.checkpoint_lsn(str(tmp_path / "index.ckpt")) == 1
    assert bs.read_index(spark, str(tmp_path)).select(F.sort_array(F.collect_list("digest"))).count() == 1


def test_log_written_and_read(spark, tmp_path, exported):
    rows = [(1, 3, "03" * 32, 0, 81), (1, 1, "01" * 32, 0, 28), (2, 4, "01" * 32, 0, 0), (1, 2, "02" * 32, 0, 55)]
    path = str(tmp_path / "index.wal")
    assert bs.write_log(spark.createDataFrame(rows, "op tinyint, lsn bigint, digest string, pack_id bigint, offset bigint"), path) == 4
    assert [tuple(r) for r in bs.read_log(spark, path).collect()] == sorted(rows, key=lambda r: r[1]) and os.path.getsize(path) == 4 * 57
    tree, out, store = exported
    as_log = str(tmp_path / "logged")
    assert export_store(store, as_log, as_log=True) == {"snapshots": 1} and not os.path.exists(os.path.join(as_log, "index.ckpt"))
    assert sorted(map(tuple, bs.read_index(spark, as_log).collect())) == sorted(map(tuple, bs.read_index(spark, out).collect()))
    assert {r.path: bytes(r.content) for r in bs.read_files(spark, as_log, "one").collect()} == tree
