"""BLAKE3 digests of many byte strings at once, with numpy: every chunk of 1,024 bytes is a lane.

A null has a null digest. ``sha2(content, 256)`` is the engine's own and cheaper digest; this one is
for stores whose objects are named by BLAKE3.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the published function: initial words, the order of words from round to round, flags.
IV = (0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19)
ORDER = (2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8)
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
CHUNK, BLOCK = 1024, 64
#: Bytes that are hashed at once.
LANE_BYTES = 8 << 20


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def _compress(cv: np.ndarray, words: np.ndarray, counter: np.ndarray, size: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """New chaining values (8, lanes) from (8, lanes) and a block's words (16, lanes)."""
    a, b = cv[:4].copy(), cv[4:].copy()
    c = np.repeat(np.array(IV[:4], np.uint32)[:, None], cv.shape[1], axis=1)
    d = np.stack([counter.astype(np.uint32), (counter >> 32).astype(np.uint32), size.astype(np.uint32), flags.astype(np.uint32)])
    for turn in range(7):
        for half in (0, 8):
            if half:  # diagonals become columns
                b, c, d = np.roll(b, -1, 0), np.roll(c, -2, 0), np.roll(d, -3, 0)
            for first, (n, m) in enumerate(((16, 12), (8, 7))):
                a = a + b + words[half + first : half + 8 : 2]
                d = _turn(d ^ a, n)
                c = c + d
                b = _turn(b ^ c, m)
            if half:
                b, c, d = np.roll(b, 1, 0), np.roll(c, 2, 0), np.roll(d, 3, 0)
        if turn < 6:
            words = words[list(ORDER)]
    return np.concatenate([a ^ c, b ^ d])


def _hash_lanes(items: list[bytes]) -> list[bytes]:
    counts = np.array([max(1, -(-len(x) // CHUNK)) for x in items])
    padded = b"".join(x + bytes(int(n) * CHUNK - len(x)) for x, n in zip(items, counts, strict=True))
    words = np.frombuffer(padded, "<u4").reshape(-1, CHUNK // BLOCK, 16)
    first = np.cumsum(counts) - counts
    counter = np.arange(counts.sum()) - np.repeat(first, counts)
    sizes = np.minimum(CHUNK, np.repeat([len(x) for x in items], counts) - counter * CHUNK)
    last = np.maximum(0, (sizes - 1) // BLOCK)
    alone = np.repeat(counts == 1, counts)
    cv = np.repeat(np.array(IV, np.uint32)[:, None], len(counter), axis=1)
    for b in range(CHUNK // BLOCK):
        on = np.flatnonzero(last >= b)
        end = last[on] == b
        flags = CHUNK_START * (b == 0) + CHUNK_END * end + ROOT * (end & alone[on])
        cv[:, on] = _compress(cv[:, on], words[on, b].T, counter[on], np.clip(sizes[on] - b * BLOCK, 0, BLOCK), flags)
    nodes = [np.arange(f, f + n) for f, n in zip(first, counts, strict=True)]
    while any(len(x) > 1 for x in nodes):  # neighbours merge, an odd one at the end moves up
        left = np.concatenate([x[0 : len(x) - 1 : 2] for x in nodes])
        right = np.concatenate([x[1::2] for x in nodes])
        top = np.concatenate([np.full(len(x) // 2, len(x) == 2) for x in nodes])
        zero = np.zeros(len(left), np.int64)
        iv = np.repeat(np.array(IV, np.uint32)[:, None], len(left), axis=1)
        cv[:, left] = _compress(iv, np.concatenate([cv[:, left], cv[:, right]]), zero, zero + BLOCK, PARENT + ROOT * top)
        nodes = [x[::2] for x in nodes]
    out = np.ascontiguousarray(cv[:, [x[0] for x in nodes]].T.astype("<u4"))
    return [row.tobytes() for row in out]


def blake3_many(items: list[bytes]) -> list[bytes]:
    out: list[bytes] = []
    group: list[bytes] = []
    size = 0
    for x in items:
        if group and size + len(x) > LANE_BYTES:
            out += _hash_lanes(group)
            group, size = [], 0
        group.append(x)
        size += max(CHUNK, len(x))
    return out + (_hash_lanes(group) if group else [])


def _digests(content: pd.Series) -> pd.Series:
    have = content.notna()
    out = pd.Series([None] * len(content), dtype=object)
    out[have.to_numpy()] = blake3_many([bytes(x) for x in content[have]])
    return out


def blake3(content: Column | str) -> Column:
    """The 32-byte digest of a binary column."""
    return F.pandas_udf(_digests, T.BinaryType())(content)
