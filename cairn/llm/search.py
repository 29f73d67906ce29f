"""Exact top-k search by BM25 over sharded inverted indexes with block-max pruning.

Documents are dealt by hash into shards of a bounded number of documents. A shard's index is one
row of a table, built once: its terms with their document frequencies, and each term's postings.
Inside a shard documents that share their weightiest term are neighbours, in blocks of ``BLOCK``.
For a query the terms are parted: the rarer ones are essential and scored from their postings; of
those that more than one document in ``OFTEN`` holds, only the greatest impact in each block is
used at first, which with the essential scores bounds every document. Tiles of ``TILE`` blocks with a
bound that reaches the k-th best score so far are scored for all such queries of some hundred by one product of matrices in single
precision, and what then may still reach it, by the bounds of its errors, is scored exactly. The k-th best is that of this shard, of
those before it in the task, or of the seed shards. The seeds, about the square root of the
number of shards, are searched first, and their merged k-th best prunes all others. Document
counts, lengths and document frequencies are global, so scores of different shards compare, and
merging the shards' k best gives exactly the k best of all.

Queries are taken in blocks of ``QUERY_TERMS`` terms at most (12 bytes each and 8 for each distinct one; a query of more terms, and
what shares its hash class, is a block of its own), the only thing that is broadcast. Each block is one pass over the index, and its results are written before the next
begins; so neither memory nor shuffled bytes grow with the product of queries and shards.

Defined results: words are lower-cased A-Z and cut at blanks; a query without words has no rows; a
null text is empty and never found; equal scores go by id, nulls first; rows that repeat are
found as often as they occur, and queries that share an id are one query of all their words; rows whose score is 0 are never returned;
other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cairn.llm.common import map_texts
from cairn.session import drop_written, reread, scratch, written

K1, B = 1.2, 0.75
BLOCK = 16
#: A term in more than one document of so many is frequent.
OFTEN = 24
#: Frequent terms, at most, others are essential: 12 bytes for each in each document of a shard whose tile has it.
COLUMNS = 1024
SHARD_DOCS = 6_000
#: Terms of the queries that are searched at once, at most: 40 MB.
QUERY_TERMS = 2_000_000
#: Hash classes of queries for each block; whole classes make a block.
CLASSES = 32
#: Queries that are searched in a shard at once, at most.
LOOKED_UP = 256
#: Scores that are held at once, about: documents of a shard for each of these queries.
CELLS = 2_000_000
#: Postings that are read at once, about.
POSTINGS = 50_000
#: Blocks whose documents are scored together.
TILE = 8
#: Scores are rounded to six places, so that much less than the k-th best may still tie with it.
SLACK = 2e-6
#: Documents of a shard that hold a term which may decide who is whose neighbour.
SHARED = 5


def _bags(texts: list[bytes]) -> list[pa.Array]:
    n, terms, counts = [], [], []
    for t in texts:
        words = t.lower().split()
        bag = Counter(words)
        n.append(len(words))
        terms.append(np.array([xxhash.xxh3_64_intdigest(w) for w in bag], np.uint64).view(np.int64))
        counts.append(np.fromiter(bag.values(), np.int32, len(bag)))
    return [pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int32()))]


def _neighbours(sizes: np.ndarray, term: np.ndarray, counts: np.ndarray, held: np.ndarray) -> np.ndarray:
    """An order of the documents that puts those with the same weightiest shared term together."""
    key = np.full(len(sizes), -1, np.int64)
    some = np.flatnonzero(sizes)
    if len(some):
        weight = np.where(held[term] >= SHARED, counts * np.log(1 + len(sizes) / held[term]), 0.0)
        most = np.maximum.reduceat(weight, (np.cumsum(sizes) - sizes)[some])
        at = np.flatnonzero(weight == np.repeat(most, sizes[some]))
        owner = np.repeat(some, sizes[some])[at]
        key[owner[::-1]] = term[at[::-1]]
    return np.argsort(key, kind="stable")


def _flat(column: pa.ChunkedArray) -> np.ndarray:
    return pa.chunked_array([c.flatten() for c in column.chunks], column.type.value_type).to_numpy()


def _build(id_type: pa.DataType):
    """The index of one shard: a row."""

    def run(key, docs):
        lengths = docs.column("n").to_numpy()
        sizes = pa.compute.list_value_length(docs.column("terms")).to_numpy()
        terms, term, held = np.unique(_flat(docs.column("terms")), return_inverse=True, return_counts=True)
        counts = _flat(docs.column("counts"))
        order = _neighbours(sizes, term, counts, held)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        doc = np.repeat(place, sizes)
        by_term = np.lexsort((doc, term))
        one = lambda values, kind: pa.array([values.astype(kind)], pa.list_(pa.from_numpy_dtype(kind)))
        ids = pa.chunked_array(docs.column("id").chunks, id_type).combine_chunks().take(pa.array(order))
        return pa.table(
            {
                "shard": pa.array([key[0].as_py()], pa.int32()),
                "n_docs": pa.array([len(order)], pa.int64()),
                "n_words": pa.array([int(lengths.sum())], pa.int64()),
                "ids": pa.ListArray.from_arrays(pa.array([0, len(order)], pa.int32()), ids),
                "lengths": one(lengths[order], np.int64),
                "terms": one(terms, np.int64),
                "held": one(held, np.int32),
                "docs": one(doc[by_term], np.int32),
                "counts": one(counts[by_term], np.int32),
            }
        )

    return run


class Asked:
    """A block of queries: ids, where each one's terms end, its terms in order as places in the block's own, and their weights."""

    def __init__(self, rows: pa.Table, total: int, id_type: pa.DataType):
        self.ids = pa.chunked_array(rows.column("query_id").chunks, id_type).combine_chunks()
        self.cuts = np.append(0, np.cumsum(pa.compute.list_value_length(rows.column("terms")).to_numpy().astype(np.int64)))
        self.terms, first, at = np.unique(_flat(rows.column("terms")), return_index=True, return_inverse=True)
        self.at, self.weights = at.astype(np.int32), _flat(rows.column("weights"))
        dfs = _flat(rows.column("dfs"))[first]
        often = np.flatnonzero(dfs * OFTEN > total)
        self.frequent = self.terms[np.sort(often[np.argsort(-dfs[often], kind="stable")[:COLUMNS]])]
        self.least = np.zeros(len(self.ids))


class Shard:
    """Postings sorted by term and document; impacts of the frequent terms by document, in tiles, and by block."""

    def __init__(self, row: dict[str, pa.Array], frequent: np.ndarray, mean: float):
        lengths, self.terms, self.held, self.doc, counts = (row[c].to_numpy() for c in ("lengths", "terms", "held", "docs", "counts"))
        self.n_docs = len(lengths)
        tf = counts.astype(np.float64)
        self.impact = tf * (K1 + 1) / (tf + (K1 * (1 - B + B * lengths / mean))[self.doc])
        self.begin = np.cumsum(self.held, dtype=np.int64) - self.held
        at, known = _positions(self.terms, frequent)
        at = at[known]
        self.column = np.full(len(self.terms), -1)
        self.column[at] = np.arange(len(at))
        post = _ranges(self.begin[at], self.held[at])
        self.blocks = np.arange(0, self.n_docs, BLOCK)
        self.tiles, self.top = self._tiles(np.repeat(np.arange(len(at)), self.held[at]), self.doc[post], self.impact[post], len(at))
        # sums of so many numbers in single precision are off by this share at most
        self.slips = (len(at) + 8) * 2.0**-23
        self.ids = row["ids"]
        self.by_id = np.empty(self.n_docs, np.int64)
        self.by_id[pa.compute.sort_indices(self.ids, null_placement="at_start").to_numpy()] = np.arange(self.n_docs)

    def _tiles(self, column: np.ndarray, doc: np.ndarray, impact: np.ndarray, columns: int) -> tuple[list[tuple[np.ndarray, np.ndarray, np.ndarray]], np.ndarray]:
        """For each tile the columns that it has, and the impacts by document, exact and in single precision; the greatest by column and block."""
        by_doc = np.argsort(doc.astype(np.uint16) if len(self.blocks) * BLOCK <= 1 << 16 else doc, kind="stable")
        starts = self.blocks[::TILE]
        cuts = np.append(np.searchsorted(doc[by_doc], starts), len(doc))
        tiles, tops = [], []
        for t, a in enumerate(starts):
            own = by_doc[cuts[t] : cuts[t + 1]]
            blocks = self.blocks[t * TILE : (t + 1) * TILE] - a
            impacts = np.zeros((min(TILE * BLOCK, self.n_docs - a), columns))
            impacts[doc[own] - a, column[own]] = impact[own]
            tops.append(np.maximum.reduceat(impacts, blocks).astype(np.float32))
            used = np.flatnonzero(tops[-1].any(axis=0))
            impacts = impacts.take(used, axis=1)
            tiles.append((used, impacts, impacts.astype(np.float32)))
        return tiles, np.ascontiguousarray(np.concatenate(tops).T)

    def search(self, asked: Asked, k: int, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, documents, scores): the k best that reach ``least``, which is raised on the way."""
        place, there = _positions(self.terms, asked.terms)
        place[~there] = -1
        step = max(1, min(LOOKED_UP, CELLS // self.n_docs))
        for a in range(0, len(least), step):
            z = min(a + step, len(least))
            part = slice(asked.cuts[a], asked.cuts[z])
            at = place[asked.at[part]]
            known = np.flatnonzero(at >= 0)
            at, weight = at[known], asked.weights[part][known]
            of = np.repeat(np.arange(z - a), np.diff(asked.cuts[a : z + 1]))[known]
            column = self.column[at]
            often, rare = column >= 0, column < 0
            essential = self._essential(at[rare], weight[rare], np.searchsorted(of[rare], np.arange(z - a + 1)))
            column, weight, of = column[often], weight[often], of[often]
            weights = np.zeros((len(self.top), z - a), np.float32)
            weights[column, of] = weight
            under = self._under(least[a:z])
            scores = self._nearly(essential, weights, under)
            cuts = np.searchsorted(of, np.arange(z - a + 1))
            for q in np.flatnonzero(scores.max(axis=1) > under):
                own = slice(cuts[q], cuts[q + 1])
                found = self._best(essential[q], scores[q], under[q], column[own], weight[own], k, least[a + q])
                if found:
                    docs, exact, least[a + q] = found
                    yield a + q, docs, exact

    def _essential(self, at: np.ndarray, weight: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Scores of all documents by the rarer terms of each query."""
        begin, held = self.begin[at], self.held[at]
        ends = np.append(0, np.cumsum(held, dtype=np.int64))[cuts]
        out = np.empty((len(cuts) - 1, self.n_docs))
        a = 0
        while a < len(out):
            z = max(a + 1, int(np.searchsorted(ends, ends[a] + POSTINGS, "right")) - 1)
            own = slice(cuts[a], cuts[z])
            post = _ranges(begin[own], held[own])
            doc, score = self.doc[post], self.impact[post] * np.repeat(weight[own], held[own])
            for q in range(a, z):
                own = slice(ends[q] - ends[a], ends[q + 1] - ends[a])
                out[q] = np.bincount(doc[own], weights=score[own], minlength=out.shape[1])
            a = z
        return out

    def _under(self, least: np.ndarray) -> np.ndarray:
        """What scores in single precision exceed if the exact ones reach ``least``, or are not 0."""
        return (np.maximum(least - SLACK, 0) * (1 - self.slips)).astype(np.float32)

    def _nearly(self, essential: np.ndarray, weights: np.ndarray, under: np.ndarray) -> np.ndarray:
        """Scores in single precision; of tiles where no block's bound exceeds ``under``, the essential ones only."""
        scores = essential.astype(np.float32)
        bounds = weights.T @ self.top
        bounds += np.maximum.reduceat(scores, self.blocks, axis=1)
        reach = np.logical_or.reduceat(bounds > under[:, None], np.arange(0, len(self.blocks), TILE), axis=1)
        for t, (used, _, impacts) in enumerate(self.tiles):
            some = np.flatnonzero(reach[:, t])
            if len(some):
                scores[some, t * TILE * BLOCK : (t + 1) * TILE * BLOCK] += weights[used][:, some].T @ impacts.T
        return scores

    def _best(self, essential: np.ndarray, scores: np.ndarray, under: float, column: np.ndarray, weight: np.ndarray, k: int, least: float):
        docs = np.flatnonzero(scores > under)
        if len(docs) > k:
            near = scores[docs]
            kth = float(np.partition(near, len(near) - k)[len(near) - k]) * (1 - self.slips)
            docs = docs[near > self._under(kth)]
        weights = np.zeros(len(self.top))
        weights[column] = weight
        tile, exact = docs // (TILE * BLOCK), essential[docs]
        for t in dict.fromkeys(tile.tolist()):
            used, impacts, _ = self.tiles[t]
            some = tile == t
            # terms are summed one after another, alike in all shards, so equal texts tie
            if len(used):
                exact[some] += np.cumsum(impacts[docs[some] - t * TILE * BLOCK] * weights[used], axis=1)[:, -1]
        exact = np.round(exact, 6)
        good = np.flatnonzero((exact > 0) & (exact > least - SLACK))
        if not len(good):
            return None
        best = good[np.lexsort((self.by_id[docs[good]], -exact[good]))[:k]]
        return docs[best], exact[best], max(least, float(exact[best[-1]])) if len(best) == k else least


def _positions(terms: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted term is among the sorted terms, and whether it is there."""
    at = np.searchsorted(terms, wanted)
    at[at == len(terms)] = 0
    return at, terms[at] == wanted if len(terms) else np.zeros(len(wanted), bool)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _search_shards(shared: Broadcast, k: int, mean: float):
    """For each shard of a task the k best of every query in ``shared``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: Asked = shared.value
        least = asked.least.copy()
        for batch in batches:
            for i in range(batch.num_rows):
                shard = Shard({c: batch.column(c)[i].values for c in INDEX_LISTS}, asked.frequent, mean)
                found = list(shard.search(asked, k, least))
                if found:
                    of = np.repeat([q for q, _, _ in found], [len(d) for _, d, _ in found])
                    docs, scores = (np.concatenate([f[c] for f in found]) for c in (1, 2))
                    yield pa.RecordBatch.from_arrays([asked.ids.take(pa.array(of)), shard.ids.take(pa.array(docs)), pa.array(scores)], names=["query_id", "id", "score"])

    return run


INDEX_LISTS = ("ids", "lengths", "terms", "held", "docs", "counts")


def build_index(df: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shard_docs: int = SHARD_DOCS) -> DataFrame:
    """A row for each shard; texts are read once, and each document is shuffled once."""
    spark = df.sparkSession
    shards = max(1, math.ceil(df.count() / shard_docs))
    bags = map_texts(df, _bags, [("n", T.LongType()), ("terms", T.ArrayType(T.LongType())), ("counts", T.ArrayType(T.IntegerType()))], id_col=id_col, text_col=text_col)
    kind = bags.schema[id_col].dataType
    long, ints = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())
    fields = [("shard", T.IntegerType()), ("n_docs", T.LongType()), ("n_words", T.LongType()), ("ids", T.ArrayType(kind)), ("lengths", long), ("terms", long), ("held", ints), ("docs", ints), ("counts", ints)]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    dealt = bags.select(F.col(id_col).alias("id"), "n", "terms", "counts", F.pmod(F.xxhash64(id_col, "n", "terms"), F.lit(shards)).cast("int").alias("shard"))
    path = scratch(spark, "index")
    # a file for each shard, so that shards spread evenly over tasks
    dealt.groupBy("shard").applyInArrow(_build(to_arrow_type(kind)), schema).write.option("compression", "zstd").option("maxRecordsPerFile", 1).parquet(path)
    return reread(spark, schema, path)


def weighted_queries(df: DataFrame, index: DataFrame, total: int, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, terms, weights, dfs) of the rows of ``df``; a weight is occurrences times the rarity of a term."""
    bags = map_texts(df, _bags, [("n", T.LongType()), ("terms", T.ArrayType(T.LongType())), ("counts", T.ArrayType(T.IntegerType()))], id_col=id_col, text_col=text_col)
    df_of = index.select(F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("held").alias("held")))).groupBy("term").agg(F.sum("held").alias("df"))
    asked = bags.select(F.col(id_col).alias("query_id"), F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("counts").alias("qf"))))
    idf = F.log(F.lit(1.0) + (F.lit(float(total)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weighted = asked.join(df_of, "term").select("query_id", "term", (F.col("qf") * idf).alias("weight"), "df")
    pairs = F.sort_array(F.collect_list(F.struct("term", "weight", "df")))
    return weighted.groupBy("query_id").agg(pairs.alias("p")).select("query_id", F.col("p.term").alias("terms"), F.col("p.weight").alias("weights"), F.col("p.df").alias("dfs"))


def query_blocks(queries: DataFrame, query_terms: int) -> tuple[Column, list[tuple[int, int]]]:
    """The class of a query, and the classes, from and to, of each block of at most ``query_terms`` terms."""
    n_terms = queries.agg(F.sum(F.size("terms"))).first()[0] or 0
    classes = CLASSES * max(1, math.ceil(n_terms / query_terms))
    of = F.pmod(F.xxhash64("query_id"), F.lit(classes))
    sizes = sorted(queries.groupBy(of.alias("c")).agg(F.sum(F.size("terms")).alias("n")).collect())  # a row for each class
    blocks, held = [], 0
    for c, n in sizes:
        if blocks and held + n <= query_terms:
            blocks[-1], held = (blocks[-1][0], c), held + n
        else:
            blocks.append((c, c))
            held = n
    return of, blocks


def top_k(
    df: DataFrame,
    is_query: Column,
    *,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    shard_docs: int = SHARD_DOCS,
    query_terms: int = QUERY_TERMS,
) -> DataFrame:
    """(query_id, id, score, rank): for each row that ``is_query`` picks by its id, the k best of all rows."""
    spark = df.sparkSession
    index = build_index(df, id_col=id_col, text_col=text_col, shard_docs=shard_docs)
    total, n_words, shards = index.agg(F.sum("n_docs"), F.sum("n_words"), F.max("shard") + 1).first()
    total, shards, mean = total or 0, shards or 0, (n_words or 0) / max(1, total or 0) or 1.0
    queries = written(weighted_queries(df.where(is_query), index, total, id_col=id_col, text_col=text_col), "queries")
    of, blocks = query_blocks(queries, query_terms)
    seeds = math.isqrt(shards)
    kind = queries.schema["query_id"].dataType
    schema = T.StructType([T.StructField("query_id", kind), T.StructField("id", kind), T.StructField("score", T.DoubleType())])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_first("id"))
    path = scratch(spark, "found")
    for a, z in blocks:
        rows = queries.where(of.between(a, z)).toArrow().combine_chunks()
        asked = Asked(rows, total, to_arrow_type(kind))

        def found(part: Column, shared: Broadcast) -> DataFrame:
            return index.where(part).select(*INDEX_LISTS).mapInArrow(_search_shards(shared, k, mean), schema)

        first = spark.sparkContext.broadcast(asked)
        best = written(_ranked(found(F.col("shard") < seeds, first), order, k), "seeds")
        reached = best.where(F.col("rank") == k).select("query_id", "score").toArrow()
        at = pa.compute.index_in(asked.ids, value_set=reached.column("query_id")).to_numpy(zero_copy_only=False)
        asked.least = np.append(reached.column("score").to_numpy(), 0.0)[np.nan_to_num(at, nan=len(reached)).astype(np.int64)]
        then = spark.sparkContext.broadcast(asked)
        rest = found(F.col("shard") >= seeds, then)
        _ranked(rest.union(best.drop("rank")), order, k).write.mode("append").parquet(path)
        first.unpersist()
        then.unpersist()
        drop_written(best)
    drop_written(index, queries)
    ranked = T.StructType([*schema.fields, T.StructField("rank", T.IntegerType())])
    return spark.read.schema(ranked).parquet(path) if blocks else spark.createDataFrame([], ranked)


def _ranked(found: DataFrame, order: Window, k: int) -> DataFrame:
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
