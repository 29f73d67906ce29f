"""Chunk payloads: zstd where it saves more than a twentieth, raw otherwise."""

from __future__ import annotations

import pandas as pd
import zstandard
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Codec ids and the compression level.
RAW, ZSTD, LEVEL = 0, 1, 3


class Codec:
    """One compressor and one decompressor, for a task or a batch."""

    def __init__(self) -> None:
        self.compressor, self.decompressor = zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()

    def encode(self, data: bytes) -> tuple[int, bytes]:
        if not data:
            return RAW, b""
        packed = self.compressor.compress(data)
        return (RAW, data) if len(packed) + len(data) // 20 >= len(data) else (ZSTD, packed)

    def decode(self, codec: int, payload: bytes, size: int) -> bytes:
        if codec == RAW:
            out = payload
        elif codec == ZSTD:
            out = self.decompressor.decompress(payload, max_output_size=size)
        else:
            raise ValueError(f"unknown codec {codec}")
        if len(out) != size:
            raise ValueError(f"payload of {len(out)} bytes, {size} expected")
        return out


def encode(data: bytes) -> tuple[int, bytes]:
    return Codec().encode(data)


def decode(codec: int, payload: bytes, size: int) -> bytes:
    return Codec().decode(codec, payload, size)


def _encode_all(content: pd.Series) -> pd.DataFrame:
    pairs = list(map(Codec().encode, content))
    return pd.DataFrame({"codec": [c for c, _ in pairs], "payload": [p for _, p in pairs]})


def _decode_all(codec: pd.Series, payload: pd.Series, size: pd.Series) -> pd.Series:
    return pd.Series(list(map(Codec().decode, codec, payload, size)), dtype=object)


def encoded(content: Column | str) -> Column:
    """struct<codec, payload>, one compressor for each batch."""
    kind = T.StructType([T.StructField("codec", T.ByteType()), T.StructField("payload", T.BinaryType())])
    return F.pandas_udf(_encode_all, kind)(content)


def decoded(codec: Column | str, payload: Column | str, size: Column | str) -> Column:
    return F.pandas_udf(_decode_all, T.BinaryType())(codec, payload, size)


def codec_name(codec: Column) -> Column:
    return F.when(codec == RAW, "raw").when(codec == ZSTD, "zstd").otherwise("unknown")
