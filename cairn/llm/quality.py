"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one failure bit
for each rule; a policy is a named, versioned mask over those bits, so changing a policy or
computing an ablation never reads a text again.

Defined results: a null text is an empty text (no words, so the rule ``few_words`` fails); null
ids are passed through; repeated rows give repeated ledger rows; other columns of the input are
not read, so their names cannot clash; an empty table gives an empty ledger.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairn.llm.common import blocks, map_texts

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
#: Texts of more words find their repeated windows by sorting, in a few arrays, instead of a hash table.
SORT_ABOVE = 100_000

MEASURES = [("n_words", T.LongType()), ("word_chars", T.LongType()), ("n_symbols", T.LongType()), ("n_dup_lines", T.LongType()), ("n_repeat_words", T.LongType())]


def _covered(hits: list[int], n: int) -> int:
    """Positions within WINDOW after the ascending starts ``hits``."""
    total = end = 0
    for i in hits:
        total += i + WINDOW - max(i, end)
        end = i + WINDOW
    return total


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a WINDOW-word window found twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    if n > SORT_ABOVE:
        return _repeat_words_sorted(words)
    grams = list(zip(words, words[1:], words[2:], words[3:], words[4:], strict=False))
    if len(set(grams)) == n:
        return 0
    count = Counter(grams)
    return _covered([i for i, g in enumerate(grams) if count[g] > 1], n)


def _repeat_words_sorted(words: list[bytes]) -> int:
    """The same by exact ranks: windows of 1, 2, 4 and then 5 words are named by dense numbers."""
    names: dict[bytes, int] = {}
    one = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    rank = lambda a, b: np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1].astype(np.int64)
    two = rank(one[:-1], one[1:])
    four = rank(two[:-2], two[2:])
    five = rank(four[:-1], one[WINDOW - 1 :])
    return _covered(np.flatnonzero(np.bincount(five)[five] > 1).tolist(), len(five))


def measure(text: bytes) -> tuple[int, int, int, int, int]:
    words = text.split()  # on space and \x09-\x0D only
    chars = len(b"".join(words).decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    dup = 0
    if b"\n" in text:
        lines = [x for x in text.split(b"\n") if x.strip()]
        dup = len(lines) - len(set(lines))
    return len(words), chars, symbols, dup, repeat_words(words)


def _measure_all(texts: list[bytes]) -> list[pa.Array]:
    rows = [measure(t) for t in texts]
    return [pa.array([r[k] for r in rows], pa.int64()) for k in range(len(MEASURES))]


@dataclass(frozen=True)
class Rule:
    name: str
    fails: str  # SQL over the measurements, in whole numbers


#: The order fixes the bits; add new rules at the end.
RULES = [
    Rule("few_words", "n_words < 10"),
    Rule("repeated_windows", "100 * n_repeat_words > 20 * n_words"),
    Rule("many_symbols", "10 * n_symbols > n_words"),
    Rule("duplicate_lines", "n_words > 0 AND n_dup_lines >= 10 AND n_words < 5 * n_dup_lines"),
    Rule("short_words", "word_chars < 2 * n_words"),
    Rule("long_words", "word_chars > 25 * n_words"),
]
BIT = {r.name: 1 << i for i, r in enumerate(RULES)}
BASE = BIT["few_words"] | BIT["repeated_windows"]

#: Policies are versioned masks: a document goes if it fails any rule of the mask.
POLICIES = {
    "base-v1": BASE,
    "web-v1": BASE | BIT["many_symbols"],
    "web-v2": BASE | BIT["many_symbols"] | BIT["duplicate_lines"] | BIT["short_words"] | BIT["long_words"],
}


def ledger(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the measurements, and ``failed_bits``: bit i is set if RULES[i] fails."""
    return with_bits(map_texts(df, _measure_all, MEASURES, id_col=id_col, text_col=text_col))


def with_bits(measured: DataFrame) -> DataFrame:
    """Measurements with ``failed_bits``."""
    bits = reduce(lambda a, b: a.bitwiseOR(b), (F.when(F.expr(r.fails), F.lit(1 << i)).otherwise(F.lit(0)) for i, r in enumerate(RULES)))
    return measured.withColumn("failed_bits", bits.cast("long"))


def keeps(policy: str = "web-v2") -> Column:
    """Whether a ledger row passes a policy."""
    return F.col("failed_bits").bitwiseAND(F.lit(POLICIES[policy]).cast("long")) == 0


def sole_failure() -> Column:
    """The bit of the one rule that a ledger row fails, 0 if it fails none or several: without that rule it would stay."""
    return F.when(F.bit_count("failed_bits") == 1, F.col("failed_bits")).otherwise(F.lit(0).cast("long"))


def ablation(rows: DataFrame, policy: str = "web-v2") -> DataFrame:
    """For each rule of a policy: documents failing it, failing it alone, and kept without it.

    One aggregation by bit pattern, of which there are at most 2 to the number of rules; the rest
    is arithmetic on those few rows.
    """
    mask = POLICIES[policy]
    patterns = rows.select(F.col("failed_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))
    rules = F.array(*[F.struct(F.lit(r.name).alias("rule"), F.lit(BIT[r.name]).cast("long").alias("bit")) for r in RULES if BIT[r.name] & mask])
    each = patterns.select("bits", "n", F.explode(rules).alias("r")).select("bits", "n", "r.rule", "r.bit")
    has = F.col("bits").bitwiseAND(F.col("bit")) != 0
    return each.groupBy("rule").agg(
        F.coalesce(F.sum(F.when(has, F.col("n"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("bit"), F.col("n"))), F.lit(0)).alias("n_failed_alone"),
        F.coalesce(F.sum(F.when(F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit"))) == 0, F.col("n"))), F.lit(0)).alias("n_kept_without"),
    )


def filter_documents(docs: DataFrame, policy: str = "web-v2") -> DataFrame:
    """The documents that pass a policy, every column of the input as it was.

    The texts are measured where they are, without a join, so nothing is shuffled and rows that
    share an id are judged each by its own text; texts pass through Python once.
    """
    names = docs.columns
    others = F.struct(*[F.col(f"`{c}`") for c in names if c != "text"], F.lit(0).alias("__none"))
    packed = docs.select(others.alias("row"), F.col("`text`").cast("binary").alias("body"))
    schema = T.StructType([*packed.schema.fields, *(T.StructField(n, t) for n, t in MEASURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            sizes = pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist() if batch.num_rows else []
            for a, b in blocks(sizes):
                part = batch.slice(a, b - a)
                found = _measure_all([t or b"" for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, *found], names=schema.names)

    judged = with_bits(packed.mapInArrow(run, schema)).where(keeps(policy))
    return judged.select(*[F.col("body").cast("string").alias(c) if c == "text" else F.col("row").getField(c).alias(c) for c in names])
