"""Content-defined chunk boundaries.

A cut may follow a byte when the low 13 bits of a polynomial hash of the last 48 bytes are zero
and the chunk has 2 KiB; it must at 1 MiB. Hashes of windows of 2, 4, ... 32 bytes come from those
of half the size, for all positions at once, in 16-bit numbers whose overflow does no harm; 32 and
16 bytes make 48. Only the hop from cut to cut is a loop.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Window, base, mask, least and greatest chunk.
WINDOW, BASE, MASK, MIN_CHUNK, MAX_CHUNK = 48, 257, 0x1FFF, 2_048, 1 << 20
#: Positions hashed in one go, so that the numbers stay in a core's cache.
SEGMENT = 1 << 16


def _longer(left: np.ndarray, right: np.ndarray, shift: int) -> np.ndarray:
    """Hashes of windows that go on, after those of ``left``, with those of ``right`` of ``shift`` bytes."""
    return left * np.uint16(pow(BASE, shift, 1 << 16)) + right


def candidates(data: bytes | memoryview) -> list[int]:
    """Ends (exclusive) of the windows that allow a cut."""
    found: list[int] = []
    whole = np.frombuffer(data, np.uint8)
    for a in range(0, max(len(whole) - WINDOW + 1, 0), SEGMENT):
        h = whole[a : a + SEGMENT + WINDOW - 1].astype(np.uint16)
        for n in (1, 2, 4, 8):
            h = _longer(h[:-n], h[n:], n)
        of_16 = h
        h = _longer(h[:-16], h[16:], 16)
        n = len(h) - 16  # windows of 48 bytes
        h = _longer(h[:n], of_16[32 : 32 + n], 16)
        found += (a + WINDOW + np.flatnonzero((h & np.uint16(MASK)) == 0)).tolist()
    return found


def hops(marks: list[int], size: int) -> list[int]:
    """End offsets of the chunks of ``size`` bytes whose allowed cuts are ``marks``, in order."""
    ends, start = [], 0
    while start < size:
        k = bisect_left(marks, start + MIN_CHUNK)
        end = min(marks[k] if k < len(marks) else size, start + MAX_CHUNK, size)
        ends.append(end)
        start = end
    return ends


def chunk_ends(data: bytes | memoryview) -> list[int]:
    """End offsets of the chunks of ``data``; none for empty data."""
    return hops(candidates(data), len(data))


def _ends_of_all(content: pd.Series) -> pd.Series:
    return content.map(lambda c: chunk_ends(c or b""))


def digest(content: Column) -> Column:
    """64 lower-case hex digits that name a chunk."""
    return F.sha2(content, 256)


def chunks(files: DataFrame, keys: tuple[str, ...] = ("snapshot", "path"), *, empty: bool = False) -> DataFrame:
    """(*keys, chunk_idx, offset, length, digest, bytes) of files (*keys, content).

    Files without content have no chunk; with ``empty`` they have one, of no bytes, or null if the content is.
    The boundaries come from one Arrow UDF; cutting and hashing stay in generated code.
    """
    cut = files.select(*keys, "content", F.pandas_udf(_ends_of_all, T.ArrayType(T.IntegerType()))("content").alias("ends"))
    each = cut.select(*keys, "content", "ends", (F.posexplode_outer if empty else F.posexplode)("ends").alias("chunk_idx", "end"))
    if empty:
        each = each.fillna(0, ["chunk_idx", "end"])
    offset = F.when(F.col("chunk_idx") > 0, F.get("ends", F.col("chunk_idx") - 1)).otherwise(0)
    each = each.select(*keys, "chunk_idx", offset.alias("offset"), (F.col("end") - offset).alias("length"), "content")
    body = F.substring(F.col("content"), F.col("offset") + 1, F.col("length"))
    each = each.select(*keys, "chunk_idx", "offset", "length", body.alias("bytes"))
    return each.select(*keys, "chunk_idx", "offset", "length", digest(F.col("bytes")).alias("digest"), "bytes")
