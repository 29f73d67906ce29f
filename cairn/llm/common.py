"""What the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text that a Python worker handles at once.
BLOCK_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def blocks(lengths: list[int], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of at most ``limit`` bytes; a longer row is a run of its own."""
    start = size = 0
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(lengths):
        yield start, len(lengths)


def map_texts(
    df: DataFrame,
    fn: Callable[[list[bytes]], list[pa.Array]],
    fields: list[tuple[str, T.DataType]],
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, outputs of ``fn``) for every row; ``fn`` gets whole texts as UTF-8 bytes, null as empty.

    Rows stay in their partitions: no shuffle, and only the two columns are read.
    """
    narrow = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    schema = T.StructType([T.StructField(id_col, narrow.schema["id"].dataType), *(T.StructField(n, t) for n, t in fields)])
    names = [id_col, *(n for n, _ in fields)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            sizes = pa.compute.binary_length(texts).to_pylist() if batch.num_rows else []
            for a, b in blocks(sizes):
                out = fn(texts.slice(a, b - a).to_pylist())
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), *out], names=names)

    return narrow.mapInArrow(run, schema)
