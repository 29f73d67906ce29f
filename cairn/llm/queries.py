"""The text operators over their whole tables, by name, and their oracles in DuckDB's SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import bpe, lines, packing, pii, quality, search, sharding, simhash, suffixes, wordpiece
from cairn.llm.common import documents
from cairn.llm.oracle import ORACLE as SQL
from cairn.session import scratch, written

#: The vocabulary of word pieces.
PIECES = "piece_bpe_32k.model"


def op1_length_buckets(spark: SparkSession, sf_dir: str, model: str = PIECES) -> DataFrame:
    """Whole documents by their number of word-piece tokens."""
    counts = wordpiece.token_counts(documents(spark, sf_dir), wordpiece.vocabulary(spark, public_tokenizers.path(model)))
    return packing.pack(counts, F.col("n_tokens"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.spans_of(documents(spark, sf_dir))
    base = F.filter("spans", lambda s: s["kind"].isin(pii.BASE))
    n = [F.size(pii.of_kind("spans", k)).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *n, F.sha2(pii.spelt(base), 256).alias("base_sha256"), pii.spelt(F.col("spans")).alias("spans"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", simhash.hexadecimal().alias("fingerprint"), "component_id")


def op4_sharding(spark: SparkSession, sf_dir: str, arrivals: int = 4) -> DataFrame:
    """Documents arrive in four parts by id; every row of the last version, read back from its shards."""
    store = sharding.ShardStore(spark, scratch(spark, "shards"))
    docs = documents(spark, sf_dir).select("doc_id", "text", F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(arrivals)).alias("arrival"))
    for k in range(arrivals):
        store.append(docs.where(F.col("arrival") == k))
        store.compact()
        store.expire()
    return store.read().select("doc_id", "arrival", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("text"), 256).alias("text_sha256"))


def op5_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for each document whose id is divisible by 50."""
    found = search.top_k(documents(spark, sf_dir), F.col("doc_id") % 50 == 0)
    return found.select("query_id", F.col("id").alias("doc_id"), "score", "rank")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored ledger under the policy; ``sole_failure`` is the rule without which a rejected document would stay."""
    base = F.col("failed_bits").bitwiseAND(F.lit(quality.BASE).cast("long")) != 0
    rows = written(quality.ledger(documents(spark, sf_dir)), "ledger")
    return rows.select("doc_id", *[n for n, _ in quality.MEASURES], base.alias("base_failed"), quality.keeps().alias("kept"), "failed_bits", quality.sole_failure().alias("sole_failure"))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str, model: str = PIECES) -> DataFrame:
    return wordpiece.token_counts(documents(spark, sf_dir), wordpiece.vocabulary(spark, public_tokenizers.path(model)))


def op9_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    with open(public_tokenizers.path(ranks), "rb") as f:
        data = spark.sparkContext.broadcast(f.read())
    return bpe.encoded(documents(spark, sf_dir), data, public_tokenizers.PATTERN, keep_ids=False)


def op10_site_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    out = lines.drop_boilerplate(docs, host_col="source", text_col="text", count_cols=("n_lines", "n_dropped"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_length_buckets,
        op2_pii,
        op3_simhash,
        op4_sharding,
        op5_bm25,
        op6_quality_rules,
        op7_suffixes,
        op8_token_counts,
        op9_byte_bpe,
        op10_site_lines,
    )
} | {"pipeline": corpus_pipeline.run}
ORACLE = {k: v for k, v in SQL.items() if k in QUERIES}
