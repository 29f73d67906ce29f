import random
import zlib

import pytest
from pyspark.sql import functions as F

from cairn.functions import checks, codec
from cairn.functions.chunking import MAX_CHUNK, MIN_CHUNK, chunk_ends, chunks


def scalar_ends(data):
    """The rule byte by byte: a rolling polynomial hash, started anew at each chunk."""
    ends, start = [], 0
    while start < len(data):
        h, e = 0, start
        while e < len(data):
            h = (h * 257 + data[e] - (data[e - 48] * pow(257, 48, 1 << 64) if e - start >= 48 else 0)) % (1 << 64)
            e += 1
            if e - start >= MIN_CHUNK and (h & 0x1FFF == 0 or e - start >= MAX_CHUNK):
                break
        ends.append(e)
        start = e
    return ends


def test_chunk_ends_against_the_scalar_rule():
    rng = random.Random(4)
    for n in (0, 1, 100, 2047, 2048, 4096, 60_000):
        data = rng.randbytes(n)
        assert chunk_ends(data) == scalar_ends(data)
    assert chunk_ends(b"\0" * 10_000) == [2048, 4096, 6144, 8192, 10_000]
    assert chunk_ends(b"a" * 2_500_000) == [1_048_576, 2_097_152, 2_500_000]
    random.seed(1)
    ends = chunk_ends(random.randbytes(300_000))
    assert len(ends) == 29 and ends[:3] == [4195, 7452, 28470]


def test_segments_do_not_show(monkeypatch):
    from cairn.functions import chunking

    data = random.Random(9).randbytes(200_000)
    want = chunk_ends(data)
    monkeypatch.setattr(chunking, "SEGMENT", 1_000)
    assert chunk_ends(data) == want


def test_insertion_keeps_most_chunks():
    data = random.Random(8).randbytes(400_000)
    cut = lambda d: {d[a:b] for a, b in zip([0, *chunk_ends(d)], chunk_ends(d))}  # noqa: B905, E731
    before, after = cut(data), cut(data[:100_000] + b"inserted" + data[100_000:])
    assert len(after - before) <= 3


def test_chunks_of_nulls_and_empty_files(spark):
    df = spark.createDataFrame([("s", "a", b""), ("s", "b", None), ("s", "c", b"x" * 5000)], "snapshot string, path string, content binary")
    assert [(r.path, r.length) for r in chunks(df).collect()] == [("c", 5000)]


def test_codec():
    assert codec.encode(b"") == (codec.RAW, b"")
    noise = random.Random(1).randbytes(5000)
    assert codec.encode(noise) == (codec.RAW, noise)
    kind, packed = codec.encode(b"text " * 1000)
    assert kind == codec.ZSTD and codec.decode(kind, packed, 5000) == b"text " * 1000
    with pytest.raises(ValueError):
        codec.decode(codec.RAW, b"abc", 4)
    with pytest.raises(ValueError):
        codec.decode(7, b"abc", 3)


def test_builtin_hashes(spark):
    r = spark.range(1).select(F.crc32(F.lit(b"abc")).alias("c"), F.sha2(F.lit(b"abc"), 256).alias("d")).first()
    assert r.c == 891568578 == zlib.crc32(b"abc") and r.d.startswith("ba7816bf8f01cfea")


def test_names_paths_and_hex(spark):
    names = ["", ".", "..", "a/b", "a\\b", "x.tmp", "ok", "v1.2"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(checks.name_ok(F.col("n"))).collect()] == [checks.valid_name(n) for n in names] == [False] * 6 + [True] * 2
    paths = ["/x", "a/../b", "..", "a/b", "a..b", ""]
    df = spark.createDataFrame([(n,) for n in paths], "n string")
    assert [r[0] for r in df.select(checks.path_ok(F.col("n"))).collect()] == [checks.safe_path(n) for n in paths] == [False] * 3 + [True] * 3
    df = spark.createDataFrame([("AB" * 32,)], "h string")
    assert df.select(checks.to_hex(checks.from_hex(F.col("h")))).first()[0] == "ab" * 32
    with pytest.raises(Exception, match="not a digest"):
        spark.createDataFrame([("zz",)], "h string").select(checks.from_hex(F.col("h"))).collect()
    assert df.select(checks.pack_id(checks.pack_name(F.lit(7)))).first()[0] == 7
    assert [checks.human(n) for n in (5, 2048, 3 << 20)] == ["5 B", "2.0 KB", "3.0 MB"]
