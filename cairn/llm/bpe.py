"""Byte-level BPE by a sentencepiece model written straight from a rank file.

Each byte is mapped to one printable character; the mapped vocabulary becomes a BPE model whose
pieces are scored by their negative rank, with no normalisation, so that sentencepiece merges in
the order of the ranks. A text is cut by the pre-token pattern; a worker remembers pre-tokens with
their ids, written out, and with what these ids decode to, so that a text's ids and bytes are joined
from those of its pre-tokens. Texts are encoded in runs, so that new pre-tokens go to sentencepiece together, with borders between them that no piece crosses.

Defined results: a null text is empty and has no tokens; repeated rows give repeated rows; other
columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from operator import itemgetter

import pyarrow as pa
import regex
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from cairn.llm.common import blocks, map_texts

#: Distinct pre-tokens that a worker remembers, and their characters; at half of either it forgets those not met since the half before.
MEMORY, MEMORY_CHARS = 200_000, 8 << 20
#: A byte that no UTF-8 text has, between pre-tokens that are encoded together.
BORDER = b"\xff"
#: Characters of text whose pre-tokens are looked up together, at most; a longer text is a run of its own.
RUN_CHARS = 1 << 18


_FIRST, _SECOND = itemgetter(0), itemgetter(1)


def byte_chars() -> list[str]:
    """A printable, non-blank character for each byte: itself where it is one, else one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def read_ranks(data: bytes) -> list[bytes]:
    """Tokens by rank from lines of base64 and rank; the ranks must be 0, 1, 2, ..."""
    pairs = sorted((int(rank), base64.b64decode(token)) for token, rank in map(bytes.split, data.splitlines()))
    if [r for r, _ in pairs] != list(range(len(pairs))):
        raise ValueError("ranks must count from 0 without gaps")
    return [t for _, t in pairs]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One field in protobuf's wire format."""
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    return _varint(number << 3) + _varint(value)


def serialise(tokens: list[bytes]) -> bytes:
    """A sentencepiece ModelProto: the tokens as BPE pieces in rank order, then the unknown piece."""
    to = byte_chars()
    normal, unknown, bpe = 1, 2, 2
    pieces = [_field(1, "".join(to[b] for b in t).encode()) + _field(2, -float(i)) + _field(3, normal) for i, t in enumerate(tokens)]
    pieces.append(_field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown))
    trainer = _field(3, bpe) + _field(4, len(pieces)) + _field(40, len(tokens))
    identity = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(_field(1, p) for p in pieces) + _field(2, trainer) + _field(3, identity)


class Codec:
    """Encodes and decodes whole texts; remembers at most MEMORY pre-tokens, of MEMORY_CHARS, besides those of the run at work."""

    def __init__(self, ranks: bytes, pattern: str):
        tokens = read_ranks(ranks)
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(tokens))
        self.split = regex.compile(pattern).findall
        # a border between pre-tokens becomes a character that no piece has, so nothing merges across it: the unknown piece, which is the last
        self.to = dict(enumerate(byte_chars())) | {BORDER[0]: "\n"}
        self.tokens = [*tokens, BORDER]
        self.decimals = [*map(str, range(len(tokens))), "\n"]
        #: Pre-token: its ids in decimals, and the bytes that they decode to.
        self.memory: dict[str, tuple[str, bytes]] = {}
        self.before: dict[str, tuple[str, bytes]] = {}
        self.held = 0

    def learn(self, pre_tokens: list[str]) -> None:
        """Have all of them in the memory; a pre-token that is a token itself has its id."""
        new = set(pre_tokens).difference(self.memory)
        if not new:
            return
        size = sum(map(len, new))
        if 2 * (len(self.memory) + len(new)) > MEMORY or 2 * (self.held + size) > MEMORY_CHARS:
            # what one run brings beyond its half is forgotten with the next run
            small = 2 * len(self.memory) <= MEMORY and 2 * self.held <= MEMORY_CHARS
            self.before, self.memory, self.held = self.memory if small else {}, {}, 0
            new = set(pre_tokens)
            size = sum(map(len, new))
        self.held += size
        memory, before = self.memory, self.before
        rest = []
        for p in new:
            if p in before:
                memory[p] = before[p]
            elif (i := self.rank.get(b := p.encode())) is not None:
                memory[p] = self.decimals[i], self.tokens[i]
            else:
                rest.append(p)
        if rest:
            joined = BORDER.join([p.encode() for p in rest]).decode("latin-1").translate(self.to)
            ids = self.model.encode(joined, num_threads=1)
            spelt = " ".join(map(self.decimals.__getitem__, ids)).split(" \n ")
            memory.update(zip(rest, zip(spelt, self.decode(ids).split(BORDER), strict=True), strict=True))

    def spelt(self, texts: list[str]) -> Iterator[tuple[str, bytes]]:
        """For each text its ids in decimals, joined by blanks, and the bytes that they decode to."""
        for a, z in blocks(list(map(len, texts)), RUN_CHARS):
            cut = list(map(self.split, texts[a:z]))
            self.learn(list(chain.from_iterable(cut)))
            for pre_tokens in cut:
                found = list(map(self.memory.__getitem__, pre_tokens))
                yield " ".join(map(_FIRST, found)), b"".join(map(_SECOND, found))

    def encode(self, text: str) -> list[int]:
        return [int(i) for ids, _ in self.spelt([text]) for i in ids.split()]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def _codec(ranks: bytes, pattern: str) -> Codec:
    return Codec(ranks, pattern)


def encoded(df: DataFrame, ranks: Broadcast, pattern: str, *, keep_ids: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, ids) for every row.

    ``ranks`` broadcasts the bytes of a rank file, whose size is fixed by the vocabulary.
    """
    fields: list[tuple[str, T.DataType]] = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    if keep_ids:
        fields.append(("ids", T.ArrayType(T.IntegerType())))

    def run(texts: list[bytes]) -> list[pa.Array]:
        codec = _codec(ranks.value, pattern)
        n, spelt, back, all_ids = [], [], [], []
        for ids, decoded in codec.spelt([t.decode("utf-8") for t in texts]):
            n.append(ids.count(" ") + 1 if ids else 0)
            spelt.append(hashlib.sha256(ids.encode()).hexdigest())
            back.append(hashlib.sha256(decoded).hexdigest())
            if keep_ids:
                all_ids.append(list(map(int, ids.split())))
        out = [pa.array(n, pa.int64()), pa.array(spelt, pa.string()), pa.array(back, pa.string())]
        return [*out, pa.array(all_ids, pa.list_(pa.int32()))] if keep_ids else out

    return map_texts(df, run, fields, id_col=id_col, text_col=text_col)
