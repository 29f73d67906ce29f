"""The snapshot engine's operators over the fixture tables, by name.

Mapping: a snapshot is a ``documents.source``, a path a ``doc_id``, a file's content the UTF-8 of
its text. For garbage collection the snapshot ``src0`` is removed. Objects are placed in packs of
PACK bytes in order of digest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import checks, codec
from cairn.functions.chunking import chunks as cut
from cairn.functions.chunking import digest
from cairn.operators import dedup, gc, manifests
from cairn.operators import index as ix
from cairn.plans.oracle import ORACLE as SQL
from cairn.session import written

PACK = 256 << 10
REMOVED = "src0"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.encode(F.coalesce("text", F.lit("")), "utf-8")
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("source").alias("snapshot"), F.col("doc_id").cast("string").alias("path"), F.octet_length(content).cast("bigint").alias("size"), F.lit(0o644).alias("mode"), content.alias("content"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut(files(spark, sf_dir))


def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks(spark, sf_dir).select("snapshot", "path", "chunk_idx", "digest")


def stored_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The references with their lengths, written once for queries that need them more than once."""
    return written(chunks(spark, sf_dir).select("snapshot", "path", "chunk_idx", "digest", "length"), "refs")


def objects(refs: DataFrame) -> DataFrame:
    """All distinct chunks in packs; payloads count as stored raw."""
    return dedup.place(refs.groupBy("digest").agg(F.first("length").alias("stored_size")), PACK)


def index(objects: DataFrame) -> DataFrame:
    """The index of ``objects``, without digests that begin with ``00`` and with those of ``01`` placed elsewhere."""
    moved = F.when(F.col("digest").startswith("01"), F.col("offset") + 7).otherwise(F.col("offset"))
    return objects.where(~F.col("digest").startswith("00")).select("digest", "pack_id", moved.alias("offset"))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = stored_refs(spark, sf_dir)
    at = written(objects(held), "objects")
    return gc.classify(at, index(at), gc.live(held.where(F.col("snapshot") != REMOVED)))


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    op = F.when(F.col("event_type") == "error", ix.ERASE).otherwise(ix.INSERT).cast("tinyint")
    key = F.sha2(F.col("user_id").cast("string").cast("binary"), 256)
    return e.select((F.col("event_id") + 1).alias("lsn"), op.alias("op"), key.alias("digest"), F.floor(F.col("event_id") / 1000).alias("pack_id"), (F.col("event_id") * 53).alias("offset"))


def last_lsn(records: DataFrame) -> int:
    return records.agg(F.max("lsn")).first()[0] or 0


@query
def file_inventory(spark, sf):
    return files(spark, sf).select("snapshot", "path", "size")


@query
def whole_file_digest(spark, sf):
    return files(spark, sf).select("snapshot", "path", digest(F.col("content")).alias("digest"))


@query
def cdc_chunks(spark, sf):
    return chunks(spark, sf).select("snapshot", "path", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), F.col("offset").cast("bigint").alias("offset"), F.col("length").cast("bigint").alias("length"), "digest")


@query
def chunk_size_histogram(spark, sf):
    return chunks(spark, sf).groupBy(F.floor(F.log2("length")).alias("log2_length")).agg(F.count("*").alias("n_chunks"), F.sum("length").alias("n_bytes"))


@query
def unique_objects(spark, sf):
    return dedup.unique_objects(chunks(spark, sf)).select("digest", F.col("length").cast("bigint").alias("length"), "refs")


@query
def dedup_ratio(spark, sf):
    u = dedup.unique_objects(chunks(spark, sf))
    out = u.agg(F.sum("refs").alias("refs"), F.count("*").alias("objects"), F.sum(F.col("refs") * F.col("length")).alias("logical_bytes"), F.sum("length").alias("unique_bytes"))
    return out.select("*", F.round(F.lit(100.0) * (F.lit(1.0) - F.col("unique_bytes") / F.col("logical_bytes")), 4).alias("saved_pct"))


@query
def dedup_growth(spark, sf):
    return dedup.growth(chunks(spark, sf))


@query
def incremental_new_chunks(spark, sf):
    """What all other snapshots add to a store that holds one."""
    held = stored_refs(spark, sf)
    new = dedup.new_objects(held.where(F.col("snapshot") != REMOVED), held.where(F.col("snapshot") == REMOVED))
    return new.select("digest", F.col("length").cast("bigint").alias("length"))


@query
def pack_assignment(spark, sf):
    return objects(chunks(spark, sf)).select("digest", F.col("stored_size").cast("bigint").alias("stored_size"), "pack_id", "offset")


@query
def index_replay(spark, sf):
    return ix.replay(log(spark, sf))


@query
def checkpoint_replay(spark, sf):
    """A checkpoint of the log's first half, and the rest of the log on top."""
    records = log(spark, sf)
    half = last_lsn(records) // 2
    return ix.replay(records, ix.replay(records.where(F.col("lsn") <= half)), half)


@query
def wal_valid_prefix(spark, sf):
    """The log before a corrupt record at nine tenths of it."""
    records = log(spark, sf)
    marked = records.select("lsn", "op", "digest", (F.col("lsn") != last_lsn(records) * 9 // 10).alias("ok"))
    return ix.valid_prefix(marked, "lsn").select("lsn", F.col("op").cast("int").alias("op"), "digest")


@query
def index_rebuild(spark, sf):
    return ix.rebuild(log(spark, sf).where(F.col("op") == ix.INSERT))


@query
def index_lookup(spark, sf):
    """Where each reference is stored."""
    held = stored_refs(spark, sf)
    return held.join(index(objects(held)), "digest").select("snapshot", "path", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), "digest", "pack_id", "offset")


@query
def latest_pack(spark, sf):
    return ix.latest_pack(objects(chunks(spark, sf)))


@query
def manifest_refs(spark, sf):
    """References read back from each snapshot's manifest as JSON, in parts of bounded size."""
    entries = written(manifests.file_entries(files(spark, sf), chunks(spark, sf)), "entries")
    text = manifests.to_json(entries).select("snapshot", manifests.from_json(F.col("manifest")).alias("m"))
    read = text.select("snapshot", F.explode("m.files").alias("f")).select("snapshot", "f.path", "f.size", "f.mode", "f.chunks")
    return manifests.refs(read).select("snapshot", "path", F.col("chunk_idx").cast("bigint").alias("chunk_idx"), "digest")


@query
def live_objects(spark, sf):
    return gc.live(refs(spark, sf).where(F.col("snapshot") != REMOVED))


@query
def gc_classify(spark, sf):
    return classified(spark, sf)


@query
def gc_totals(spark, sf):
    return gc.totals(classified(spark, sf))


@query
def gc_pack_stats(spark, sf):
    return gc.pack_stats(classified(spark, sf))


@query
def gc_select_packs(spark, sf):
    return gc.select_packs(gc.pack_stats(classified(spark, sf)), 0.05)


@query
def gc_compact_plan(spark, sf):
    c = classified(spark, sf)
    return gc.compact_plan(c, gc.select_packs(gc.pack_stats(c), 0.05))


@query
def dangling_refs(spark, sf):
    held = stored_refs(spark, sf)
    return gc.audit(held, index(objects(held)))


@query
def dangling_digests(spark, sf):
    held = stored_refs(spark, sf)
    return gc.live(gc.dangling(held, index(objects(held))))


@query
def orphan_objects(spark, sf):
    return classified(spark, sf).where("state = 'orphan'").select("digest", "pack_id", "offset", "record_bytes")


@query
def snapshot_info(spark, sf):
    return manifests.info(manifests.file_entries(files(spark, sf), chunks(spark, sf)))


@query
def snapshot_list(spark, sf):
    return files(spark, sf).groupBy("snapshot").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).orderBy("snapshot")


@query
def reassemble_check(spark, sf):
    """The digest of each file put together again from its chunks.

    Rows are told apart by a number, as keys may come again; an empty text has the digest of no bytes, a null one none.
    """
    key, docs = ("row", "snapshot", "path"), table(spark, sf, "documents")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("source").alias("snapshot"), F.col("doc_id").cast("string").alias("path"), F.encode("text", "utf-8").alias("content"))
    joined = cut(rows, key, empty=True).groupBy(*key).agg(F.expr("listagg(bytes, x'') WITHIN GROUP (ORDER BY chunk_idx)").alias("content"))
    return joined.select("snapshot", "path", digest(F.col("content")).alias("digest"))


@query
def path_safety(spark, sf):
    url = F.col("url")
    path = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("/"), url)).when(F.col("page_id") % 7 == 0, F.concat(F.lit("a/../"), url)).otherwise(url)
    return table(spark, sf, "pages").select("page_id", path.alias("path"), checks.path_ok(path).alias("is_safe"))


@query
def name_validation(spark, sf):
    n = F.col("page_id")
    name = F.when(n % 6 == 0, F.lit("")).when(n % 6 == 1, F.lit("..")).when(n % 6 == 2, F.col("url")).when(n % 6 == 3, F.concat(n.cast("string"), F.lit(".tmp"))).when(n % 6 == 4, F.concat(F.lit("a\\"), n.cast("string"))).otherwise(F.concat(F.lit("snap-"), n.cast("string")))
    return table(spark, sf, "pages").select("page_id", name.alias("name"), checks.name_ok(name).alias("is_valid"))


@query
def hex_roundtrip(spark, sf):
    d = digest(F.encode("text", "utf-8"))
    return table(spark, sf, "documents").select("doc_id", checks.to_hex(checks.from_hex(F.upper(d))).alias("digest"), checks.digest_ok(F.substring(d, 1, 63)).alias("short_ok"))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(digest, bytes, s, back) of each distinct chunk: as it is, stored, and read back."""
    c = chunks(spark, sf_dir).groupBy("digest").agg(F.any_value("bytes").alias("bytes"))
    stored = c.select("digest", "bytes", codec.encoded("bytes").alias("s"))
    return stored.select("*", codec.decoded("s.codec", "s.payload", F.length("bytes")).alias("back"))


@query
def crc_audit(spark, sf):
    """CRC-32 of each distinct chunk, and whether the chunk read back from its stored payload has it too."""
    crc = F.crc32("bytes")
    return payloads(spark, sf).select("digest", crc.alias("crc"), (F.crc32("back") == crc).alias("crc_ok"))


@query
def zstd_roundtrip(spark, sf):
    """Whether each distinct chunk comes back from its stored payload, which is never larger and only smaller if compressed."""
    size, stored = F.length("bytes").cast("bigint"), F.length("s.payload")
    fits = F.when(F.col("s.codec") == codec.RAW, stored == size).when(F.col("s.codec") == codec.ZSTD, stored + F.floor(size / 20) < size).otherwise(False)
    return payloads(spark, sf).select("digest", size.alias("size"), fits.alias("fits"), (digest(F.col("back")) == F.col("digest")).alias("intact"))


ORACLE: dict[str, str] = {k: v for k, v in SQL.items() if k in QUERIES}
