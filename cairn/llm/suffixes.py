"""Repeated passages by a logarithmic family of sparse suffix indexes.

A passage of ``length`` bytes is named by its anchor: of the ``anchor``-byte strings in it, the
leftmost with the least hash. Equal passages have equal anchors at equal offsets, so an index of
the suffixes that start at anchors finds every repeat, with about one suffix in 77 of all.
Neighbouring passages with one anchor form a run, which is the unit of the index.

The index is a family of levels, each sorted by the hash of a suffix's first bytes and bucketed by
it. A new batch gets a sorted array of its own, which is merge-scanned against each level (a
sort-merge join of two sorted, equally bucketed tables, without a shuffle); then levels of equal
size merge two by two. The scans yield the anchors that occur more than once. Runs at such anchors
whose whole contents occur twice are repeats throughout; where contents under one anchor differ,
the passages of one run for each content are compared: in one task for an anchor with up to MANY
contents, beyond that as rows of their own, dealt by their hashes.

Contents are compared by 64-bit hashes within an anchor's 64-bit hash, texts by 128 bits (``h1``, ``h2``).
Where many rows share an anchor or a text, the joins by it are of plain written tables, which
adaptive execution splits.

Defined results: a null text is empty; a text shorter than ``length`` has nothing to remove; rows
with equal texts are documents of their own, so each loses all that a long enough text has; null
ids are passed through; other columns are not read.
"""

from __future__ import annotations

import gc
import hashlib
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.session import drop, drop_written, scratch, written

LENGTH = 200
ANCHOR = 48
#: Bytes of text hashed in one go; positions in a piece fit 20 bits.
PIECE = 1 << 20
BATCHES = 4
#: Runs compared at once, and the contents of an anchor beyond which its passages are compared by a shuffle.
GROUP = 2_000
MANY = 20_000

_BYTES = np.frombuffer(b"".join(hashlib.sha256(bytes([b])).digest()[:8] for b in range(256)), "<u8")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Hasher:
    """Hashes of all substrings of one length, by prefix sums modulo 2^64."""

    def __init__(self, size: int):
        self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _BASE, np.uint64)]))
        self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _INVERSE, np.uint64)]))

    def windows(self, data: np.ndarray, n: int) -> np.ndarray:
        if len(data) < n:
            return np.zeros(0, np.uint64)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTES[data] * self.up[: len(data)], out=sums[1:])
        h = (sums[n:] - sums[:-n]) * self.down[: len(data) - n + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, from minima over the heads and tails of blocks of w."""
    n = len(x) - w + 1
    padded = np.concatenate([x, np.full(-len(x) % w, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    heads = np.minimum.accumulate(padded, axis=1).reshape(-1)
    tails = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(tails[:n], heads[w - 1 : w - 1 + n])


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, int]]]:
    """Groups of (text, from, to) of at most PIECE bytes; a longer text is cut with an overlap, so each passage lies in one piece."""
    group: list[tuple[int, int, int]] = []
    size = 0
    for k, t in enumerate(texts):
        if len(t) < length:
            continue
        for a in range(0, len(t) - length + 1, PIECE - length + 1):
            b = min(len(t), a + PIECE)
            if size + b - a > PIECE:
                yield group
                group, size = [], 0
            group.append((k, a, b))
            size += b - a
    if group:
        yield group


def runs_in(texts: list[bytes], hasher: Hasher, length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(text, start, passages, anchor hash, content hash) of every run."""
    out: list[tuple[np.ndarray, ...]] = []
    for group in _pieces(texts, length):
        joined = b"".join(texts[k][a:b] for k, a, b in group)
        sizes = np.array([b - a for _, a, b in group])
        begin = np.cumsum(sizes) - sizes
        grams = hasher.windows(np.frombuffer(joined, np.uint8), anchor)
        at = np.arange(len(grams), dtype=np.uint64)
        low = np.uint64((1 << 20) - 1)
        best = _sliding_min((grams & ~low) | at, length - anchor + 1) & low  # the leftmost least
        whole = np.ones(len(best), bool)
        for e in begin[1:]:
            whole[e - length + 1 : e] = False  # passages across two texts
        new = whole.copy()
        new[1:] &= (best[1:] != best[:-1]) | ~whole[:-1]
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], len(best))
        owner = np.searchsorted(begin, starts, "right") - 1
        ends = np.minimum(ends, begin[owner] + sizes[owner] - length + 1)
        view = memoryview(joined)
        content = np.fromiter((xxhash.xxh3_64_intdigest(view[s : e + length - 1]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, len(starts))
        which = np.array([k for k, _, _ in group])[owner]
        offset = starts - begin[owner] + np.array([a for _, a, _ in group])[owner]
        out.append((which, offset, ends - starts, grams[best[starts].astype(np.int64)], content))
    if not out:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def runs(df: DataFrame, length: int, anchor: int) -> DataFrame:
    """(h1, h2, start, n, key, content) for every run of (h1, h2, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(PIECE)
        for batch in batches:
            names = [batch.column(i).to_numpy() for i in (0, 1)]
            for a in range(0, batch.num_rows, 256):
                which, start, n, key, content = runs_in(batch.column(2).slice(a, 256).to_pylist(), hasher, length, anchor)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(h[a + which]) for h in names), pa.array(start), pa.array(n.astype(np.int32)), pa.array(key.view(np.int64)), pa.array(content.view(np.int64))],
                    names=["h1", "h2", "start", "n", "key", "content"],
                )

    return df.select("h1", "h2", F.col("text").cast("binary").alias("text")).mapInArrow(run, "h1 long, h2 long, start long, n int, key long, content long")


def release() -> None:
    """Let Spark's cleaner delete the shuffle files of finished steps."""
    gc.collect()
    spark = SparkSession.getActiveSession()
    if spark is not None:
        spark._jvm.System.gc()


class SuffixIndex:
    """Levels of sorted anchor keys; ``add`` returns the keys of a batch that occur more than once so far."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[tuple[int, str, str]] = []  # size in batches, table, path

    def _store(self, df: DataFrame, size: int) -> tuple[int, str, str]:
        name, path = f"cairn_level_{uuid.uuid4().hex}", scratch(self.spark, "level")
        df.write.option("path", path).option("compression", "zstd").bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name)
        return size, name, path

    def _drop(self, level: tuple[int, str, str]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {level[1]}")
        drop(self.spark, level[2])

    def add(self, batch: DataFrame) -> DataFrame:
        counted = written(batch.groupBy("key").agg(F.count("*").alias("n")), "keys")
        new = self._store(counted.select("key").repartition(self.buckets, "key"), 1)
        hits = counted.where("n > 1").select("key")
        for _, name, _ in self.levels:
            hits = hits.unionByName(self.spark.table(new[1]).join(self.spark.table(name), "key", "left_semi"))
        hits = written(hits, "hits")
        drop_written(counted)
        self.levels.append(new)
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            b, a = self.levels.pop(), self.levels.pop()
            merged = self.spark.table(a[1]).alias("a").join(self.spark.table(b[1]).alias("b"), F.col("a.key") == F.col("b.key"), "full")
            self.levels.append(self._store(merged.select(F.coalesce("a.key", "b.key").alias("key")), a[0] + b[0]))
            self._drop(a)
            self._drop(b)
        return hits

    def close(self) -> None:
        for level in self.levels:
            self._drop(level)
        self.levels = []


def _contexts(length: int):
    """(key, content_count, kinds, h1, h2, start, context) of the runs listed for a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                text, listed = batch.column(2)[k].as_py(), batch.column(3)[k].values
                key, start, n, count, kinds = (listed.field(i) for i in range(5))
                context = [text[s : s + m + length - 1] for s, m in zip(start.to_pylist(), n.to_pylist(), strict=True)]
                name = [pa.array(np.full(len(context), batch.column(i)[k].as_py())) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([key, count, kinds, *name, start, pa.array(context, pa.binary())], names=["key", "c", "kinds", "h1", "h2", "start", "context"])

    return run


CONTEXT = "key long, c long, kinds long, h1 long, h2 long, start long, context binary"
SPANS = "h1 long, h2 long, start long, end long"


def _windows(contexts: list[bytes], length: int, hasher: Hasher) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, offset, hash) of every passage in the contexts."""
    rows, offsets, hashes = [], [], []
    step = max(1, PIECE // max(map(len, contexts)))
    for a in range(0, len(contexts), step):
        group = contexts[a : a + step]
        sizes = np.array([len(c) for c in group])
        n = sizes - length + 1
        h = hasher.windows(np.frombuffer(b"".join(group), np.uint8), length)
        row = np.repeat(np.arange(len(group)), n)
        offset = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hashes.append(h[(np.cumsum(sizes) - sizes)[row] + offset])
        rows.append(row + a)
        offsets.append(offset)
    return tuple(np.concatenate(x) for x in (rows, offsets, hashes))


def _compare(length: int):
    """Spans (h1, h2, start, end) of passages that another run at the same anchor has; rows come sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(PIECE)

        def spans(rows: pa.RecordBatch) -> pa.RecordBatch:
            key, c, h1, h2, start = (rows.column(i).to_numpy() for i in (0, 1, 3, 4, 5))
            row, offset, h = _windows(rows.column(6).to_pylist(), length, hasher)
            h = h + key.view(np.uint64)[row] * _BASE  # passages match under one anchor only
            _, which, count = np.unique(h, return_inverse=True, return_counts=True)
            twice = (count[which] > 1) & (c[row] == 1)
            row, offset = row[twice], offset[twice]
            first = np.ones(len(row), bool)
            first[1:] = (row[1:] != row[:-1]) | (offset[1:] != offset[:-1] + 1)
            last = np.append(first[1:], True)[: len(row)]
            begin, end = start[row[first]] + offset[first], start[row[last]] + offset[last] + length
            return pa.RecordBatch.from_arrays([pa.array(h1[row[first]]), pa.array(h2[row[first]]), pa.array(begin), pa.array(end)], names=["h1", "h2", "start", "end"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            for a in range(0, batch.num_rows, GROUP):
                part = batch.slice(a, GROUP)
                if held and held[-1].column(0)[-1] == part.column(0)[-1]:
                    held.append(part)
                    continue
                rows = pa.concat_batches([*held, part])
                cut = int(np.searchsorted(rows.column(0).to_numpy(), rows.column(0)[-1].as_py()))
                if cut:
                    yield spans(rows.slice(0, cut))
                held = [rows.slice(cut)]
        if held:
            yield spans(pa.concat_batches(held))

    return run


def _passages(length: int):
    """(key, window, h1, h2, start) of each passage of each context, for anchors with many contents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher(PIECE)
        for batch in batches:
            for a in range(0, batch.num_rows, GROUP):
                rows = batch.slice(a, GROUP)
                key, h1, h2, start = (rows.column(i).to_numpy() for i in (0, 3, 4, 5))
                row, offset, h = _windows(rows.column(6).to_pylist(), length, hasher)
                columns = key[row], h.view(np.int64), h1[row], h2[row], start[row] + offset
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "window", "h1", "h2", "start"])

    return run


def repeated_spans(docs: DataFrame, *, length: int = LENGTH, anchor: int = ANCHOR, batches: int = BATCHES) -> DataFrame:
    """(h1, h2, start, end), distinct and maybe overlapping, of what repeats in (id, text, h1, h2)."""
    spark = docs.sparkSession
    all_runs = written(runs(docs, length, anchor).withColumn("batch", F.pmod("h1", F.lit(batches)).cast("int")), "runs", partition_by=["batch"])
    index = SuffixIndex(spark)
    found = []
    for k in range(batches):
        found.append(index.add(all_runs.where(F.col("batch") == k)))
        release()
    index.close()
    hits = written(reduce(DataFrame.unionByName, found).distinct(), "hits")
    again = written(all_runs.join(hits, "key", "left_semi").select("key", "content", "h1", "h2", "start", "n"), "candidates")
    drop_written(all_runs, hits, *found)
    release()

    place = F.xxhash64("h1", "h2", "start")
    contents = written(again.groupBy("key", "content").agg(F.count("*").alias("c"), F.min(place).alias("place")), "contents")
    mixed = written(contents.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1"), "mixed")
    whole = again.join(contents.where("c > 1").select("key", "content"), ["key", "content"], "left_semi")
    end = F.col("start") + F.col("n") + (length - 1)
    spans = whole.select("h1", "h2", "start", end.alias("end")).distinct()

    first = contents.join(mixed, "key").select("key", "content", "c", "kinds", "place")
    first = again.withColumn("place", place).join(first, ["key", "content", "place"])
    listed = first.groupBy("h1", "h2").agg(F.collect_set(F.struct("key", "start", "n", "c", "kinds")).alias("runs"))
    named = docs.groupBy("h1", "h2").agg(F.min("id").alias("__id")).join(listed, ["h1", "h2"])
    named = written(named.select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), "__id", "runs"), "named")
    one = docs.join(named, (F.col("h1") == F.col("__h1")) & (F.col("h2") == F.col("__h2")) & F.col("id").eqNullSafe(F.col("__id")))
    one = one.select("h1", "h2", F.col("text").cast("binary").alias("text"), "runs")
    contexts = written(one.mapInArrow(_contexts(length), CONTEXT), "contexts")
    release()
    few = contexts.where(F.col("kinds") <= MANY).distinct().repartition("key").sortWithinPartitions("key")
    parts = few.mapInArrow(_compare(length), SPANS)
    passages = contexts.where(F.col("kinds") > MANY).mapInArrow(_passages(length), "key long, window long, h1 long, h2 long, start long")
    at = F.xxhash64("h1", "h2", "start")
    twice = passages.groupBy("key", "window").agg(F.min(at).alias("a"), F.max(at).alias("b")).where("a != b").select("key", "window")
    hot = passages.join(twice, ["key", "window"], "left_semi").select("h1", "h2", "start", (F.col("start") + length).alias("end"))
    out = written(spans.unionByName(parts).unionByName(hot), "spans")
    drop_written(again, contents, mixed, named, contexts)
    release()
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, removed, runs_, digest = [], [], [], []
        for k in range(batch.num_rows):
            text = batch.column(1)[k].as_py()
            spans = batch.column(2)[k].values
            kept, pos, gone, count = hashlib.sha256(), 0, 0, 0
            if spans is not None and len(spans):
                start, end = spans.field(0).to_numpy(), spans.field(1).to_numpy()
                order = np.argsort(start, kind="stable")
                start, end = start[order], np.maximum.accumulate(end[order])
                first = np.append(True, start[1:] > end[:-1])
                last = np.append(first[1:], True)
                for s, e in zip(start[first].tolist(), end[last].tolist(), strict=True):
                    kept.update(text[pos:s])
                    gone, count, pos = gone + e - s, count + 1, e
            kept.update(text[pos:])
            n.append(len(text))
            removed.append(gone)
            runs_.append(count)
            digest.append(kept.hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs_, pa.int64()), pa.array(digest, pa.string())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        )


def remove_repeats(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, anchor: int = ANCHOR, batches: int = BATCHES) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) for every row: each byte goes that a repeated ``length``-byte string covers."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = df.select(F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(1), text).alias("h2"))
    spans = repeated_spans(docs, length=length, anchor=anchor, batches=batches)
    by_text = spans.groupBy("h1", "h2").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    by_text = written(by_text.select(F.col("h1").alias("__h1"), F.col("h2").alias("__h2"), "spans"), "removed")
    drop_written(spans)
    joined = docs.join(by_text, (F.col("h1") == F.col("__h1")) & (F.col("h2") == F.col("__h2")), "left")
    kind = docs.schema["id"].dataType
    schema = T.StructType([T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())])
    return joined.select("id", F.col("text").cast("binary").alias("text"), "spans").mapInArrow(_cut, schema).withColumnRenamed("id", id_col)
