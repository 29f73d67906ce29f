"""Token counts by greedy longest match, in time linear in a word's length.

The automaton is a trie over the vocabulary, pieces that continue a word under a second root, with
failure links (Song et al., 2021). A failure link leads to where matching goes on once the longest
pieces of what was read are taken off; how many pieces that takes off is stored, so counting adds
up numbers and builds no piece. Where nothing can be taken off the word is one unknown token.

Defined results: a null text is empty; words are maximal runs without \\x20 and \\x09-\\x0D; a word longer than
``max_chars`` is one unknown token where that limit is given; repeated rows give repeated rows.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from cairn.llm.common import map_texts

#: Distinct words that a worker remembers; then it starts afresh.
MEMORY = 300_000


class Automaton:
    def __init__(self, initial: Iterable[str], continuing: Iterable[str]):
        self.next: list[dict[str, int]] = [{}, {}]  # root of words, root of what continues one
        self.fail: list[int] = [-1, -1]  # -1: none
        self.popped: list[int] = [0, 0]
        final = [False, False]
        for root, pieces in ((0, initial), (1, continuing)):
            for piece in pieces:
                at = root
                for c in piece:
                    if c not in self.next[at]:
                        self.next[at][c] = len(self.next)
                        self.next.append({})
                        self.fail.append(-1)
                        self.popped.append(0)
                        final.append(False)
                    at = self.next[at][c]
                final[at] |= bool(piece)
        queue = deque([0, 1])
        while queue:  # by depth, so a link's target is complete
            u = queue.popleft()
            for c, v in self.next[u].items():
                queue.append(v)
                if final[v]:  # all of it is one piece
                    self.fail[v], self.popped[v] = 1, 1
                    continue
                at, n = self.fail[u], self.popped[u]
                while at >= 0 and c not in self.next[at]:
                    at, n = self.fail[at], n + self.popped[at]
                if at >= 0:
                    self.fail[v], self.popped[v] = self.next[at][c], n

    def count(self, word: str) -> int:
        """Pieces of ``word``, or 0 if it has no greedy split."""
        at, n = 0, 0
        nexts, fail, popped = self.next, self.fail, self.popped
        for c in word:
            while c not in nexts[at]:
                if fail[at] < 0:
                    return 0
                n += popped[at]
                at = fail[at]
            at = nexts[at][c]
        while at > 1:
            if fail[at] < 0:
                return 0
            n += popped[at]
            at = fail[at]
        return n


@lru_cache(maxsize=2)
def _automaton(vocabulary: tuple[tuple[str, ...], tuple[str, ...]]) -> tuple[Automaton, dict[bytes, int]]:
    return Automaton(*vocabulary), {}


def token_counts(df: DataFrame, vocabulary: Broadcast, *, max_chars: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_tokens, n_unknown) for every row; an unknown word is one token.

    ``vocabulary`` broadcasts the pieces that begin and that continue a word.
    """

    def run(texts: list[bytes]) -> list[pa.Array]:
        automaton, memory = _automaton(vocabulary.value)
        rows = []
        for t in texts:
            words = t.split()
            new = {w for w in words if w not in memory}
            if new:
                if len(memory) + len(new) > MEMORY:
                    memory.clear()
                    new = set(words)
                for w in new:
                    word = w.decode("utf-8")
                    memory[w] = 0 if max_chars and len(word) > max_chars else automaton.count(word)
            counts = [memory[w] for w in words]
            unknown = counts.count(0)
            rows.append((len(words), sum(counts) + unknown, unknown))
        return [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)]

    return map_texts(df, run, [("n_words", T.LongType()), ("n_tokens", T.LongType()), ("n_unknown", T.LongType())], id_col=id_col, text_col=text_col)


def vocabulary(spark: SparkSession, path: str) -> Broadcast:
    """The pieces of a sentencepiece model file on the driver, a fixed number of them, for all executors."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(pieces_of(f.read()))


def pieces_of(model: bytes) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """The vocabulary of a sentencepiece model, U+2581 marking the start of a word."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    usable = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    mark = "▁"
    initial = tuple(p[1:] for p in usable if p[0] == mark and len(p) > 1 and mark not in p[1:])
    return initial, tuple(p for p in usable if mark not in p)
