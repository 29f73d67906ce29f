"""Near duplicates by SimHash fingerprints and multi-index hashing.

A fingerprint has 64 bits in two segments of 32. Two fingerprints within 3 bits differ by at most
one bit in one of the segments, so each fingerprint looks up, for each segment, its own value and
the values one bit away; what it finds is verified over all 64 bits. Of two values one bit apart
one has a 0 there, so it is enough to enumerate the bits that are 0.

Work is on distinct fingerprints: copies never make pairs. Where a table bucket holds many
fingerprints, the links found are a spanning forest of the bucket (a search that drops what it
has reached), so a large group of near copies costs its size, not its square. A bucket holds
distinct fingerprints that share half their bits, 16 bytes each.

Defined results: a null or wordless text has fingerprint zero, linked like any other; rows that
repeat give repeated rows; a null id takes part in linking but never names a component (null if
its component has no id at all); other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm import similar
from cairn.llm.common import map_texts
from cairn.llm.graph import components
from cairn.session import drop_written, written

SHINGLE = 3
SEED = 42
RADIUS = 3
CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of the word shingles, each counted as often as it occurs."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    starts = [0, *accumulate(len(w) + 1 for w in words)]
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        hashes = [digest(joined, SEED)]
    else:
        hashes = [digest(joined[a : z - 1], SEED) for a, z in zip(starts, starts[shingle:], strict=False)]
    counts = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        block = np.array(hashes[i : i + CHUNK], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n).view("<u8")[0])


def _fingerprints(texts: list[bytes]) -> list[pa.Array]:
    return [pa.array(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))]


def _forest(values: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """Links that span the components of ``values`` (uint64): each search step only looks at what no step has reached."""
    rest = values
    while len(rest) > 1:
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            one = stack.pop()
            near = np.bitwise_count(rest ^ one) <= radius
            if near.any():
                found = rest[near]
                yield one, found
                stack.extend(found)
                rest = rest[~near]


def _bucket_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(key: np.ndarray, fp: np.ndarray, own: np.ndarray) -> pa.RecordBatch | None:
            edge = np.flatnonzero(np.diff(key)) + 1
            starts, ends = np.append(0, edge), np.append(edge, len(key))
            stored = np.add.reduceat(own.astype(np.int64), starts)
            a, b = [], []
            for s, e in zip(starts[mask := (ends - starts > 1) & (stored > 0)], ends[mask], strict=True):
                for one, found in _forest(fp[s:e], radius):
                    a.append(np.full(len(found), one))
                    b.append(found)
            if a:
                return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])
            return None

        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            now = (batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False))
            if held and held[-1][0][-1] == now[0][-1]:  # one bucket so far
                held.append(now)
                continue
            key, fp, own = (np.concatenate(x) for x in zip(*held, now, strict=True))
            cut = int(np.searchsorted(key, key[-1]))
            if cut and (out := links(key[:cut], fp[:cut], own[:cut])):
                yield out
            held = [(key[cut:], fp[cut:], own[cut:])]
        if held and (out := links(*(np.concatenate(x) for x in zip(*held, strict=True)))):
            yield out

    return run


def links(fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between the distinct longs in column ``fp`` that join all within ``radius`` <= 3 bits."""
    if radius > 3:
        raise ValueError("two segments probed at radius 1 find distances up to 3")
    segment = "shiftrightunsigned(fp, 32) + 4294967296L * 0", "(fp & 4294967295L) + 4294967296L * 1"
    rows = fingerprints.select("fp", F.explode(F.array(*[F.expr(s) for s in segment])).alias("own_key"))
    ball = "filter(transform(sequence(0, 32), i -> if(i = 32, own_key, own_key | shiftleft(1L, i))), (k, i) -> i = 32 or k != own_key)"
    probes = rows.select("fp", "own_key", F.explode(F.expr(ball)).alias("key"))
    probes = probes.select("key", "fp", (F.col("key") == F.col("own_key")).alias("own"))
    buckets = probes.repartition("key").sortWithinPartitions("key")
    return buckets.mapInArrow(_bucket_links(radius), "a long, b long")


def near_duplicates(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(id, fp, component_id) for every row: the least id reachable over links, its own included."""
    marks = written(map_texts(df, _fingerprints, [("fp", T.LongType())], id_col=id_col, text_col=text_col), "fingerprints")
    distinct = written(marks.groupBy("fp").agg(F.min(id_col).alias("least_id")), "distinct")
    roots = components(links(distinct, radius))
    named = roots.join(distinct, roots["node"] == distinct["fp"]).select("fp", "root", "least_id")
    least = named.groupBy("root").agg(F.min("least_id").alias("group_id"))
    linked = named.join(least, "root").select("fp", "group_id")
    # written, so that the last join is of two plain exchanges, which adaptive execution splits where copies share one fingerprint
    labels = written(distinct.join(linked, "fp", "left").select("fp", F.coalesce("group_id", "least_id").alias("component_id")), "labels")
    drop_written(distinct, roots)
    return marks.join(labels, "fp").select(id_col, "fp", "component_id")


def deduplicate(docs: DataFrame) -> DataFrame:
    """The document with the least doc_id of every group, with all its columns.

    Texts whose fingerprints link, as in ``near_duplicates``, are candidates, which the exact check of ``similar`` follows:
    five-word shingles at a similarity of 0.8. Texts of that similarity whose fingerprints are further apart are found by their
    rarest shingles, so no pair is lost.
    Rows that share a doc_id and a group are one document and one of them stays; in different groups
    they are different documents, each of which stays where its group is named by that doc_id. Rows
    without a doc_id cannot be named as a copy of another, so they all stay.
    """
    labels = similar.near_duplicates(docs, fingerprint=fingerprint, links=links).where("doc_id = component_id")
    least = labels.groupBy("doc_id", "root").agg(F.min("text_hash").alias("__kept_text"))
    kept = written(least.select(F.col("doc_id").alias("__kept_id"), "__kept_text"), "kept")
    rows = docs.withColumn("__text", F.xxhash64(F.coalesce("text", F.lit(""))))
    same = (rows["doc_id"] == kept["__kept_id"]) & (rows["__text"] == kept["__kept_text"])
    named = rows.join(kept, same, "left_semi").dropDuplicates(["doc_id", "__text"]).drop("__text")
    return named.unionByName(docs.where(F.col("doc_id").isNull()))


def hexadecimal(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
