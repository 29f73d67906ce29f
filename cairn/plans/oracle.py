"""The same queries in DuckDB's SQL, boundaries included: window sums and a recursive walk."""

FILES = """files AS MATERIALIZED (SELECT source AS snapshot, doc_id::VARCHAR AS path, octet_length(encode(coalesce(text, '')))::BIGINT AS size, encode(coalesce(text, '')) AS content FROM documents)"""

CHUNKS = f"""{FILES},
byte_rows AS (SELECT path, i, ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT AS v FROM (SELECT path, hex(content) AS h, unnest(range(size)) AS i FROM files)),
win AS (SELECT path, i + 1 AS e, sum(v) OVER w AS s1, sum(v * i) OVER w AS s2 FROM byte_rows WINDOW w AS (PARTITION BY path ORDER BY i ROWS BETWEEN 47 PRECEDING AND CURRENT ROW)),
marks AS (SELECT path, list(e ORDER BY e) AS es FROM win WHERE e >= 48 AND (s1 + 256 * ((e - 1) * s1 - s2)) % 8192 = 0 GROUP BY path),
hop AS (SELECT f.path, f.size, coalesce(es, []) AS es, -1 AS k, 0::BIGINT AS b, 0::BIGINT AS e FROM files f LEFT JOIN marks USING (path)
  UNION ALL SELECT path, size, es, k + 1, e, least(coalesce(list_min(list_filter(es, lambda x: x >= e + 2048)), size), e + 1048576, size) FROM hop WHERE e < size),
chunks AS MATERIALIZED (SELECT snapshot, hop.path, k::BIGINT AS chunk_idx, b AS "offset", e - b AS length, content[b + 1 : e] AS bytes, sha256(content[b + 1 : e]) AS digest FROM hop JOIN files USING (path) WHERE k >= 0)"""

OBJECTS = f"""{CHUNKS},
objects AS MATERIALIZED (SELECT digest, stored_size, ((e - 1) // 262144)::BIGINT AS pack_id, (e - stored_size - 53)::BIGINT AS "offset" FROM (
  SELECT digest, stored_size, sum(stored_size + 53) OVER (ORDER BY digest) AS e FROM (SELECT digest, first(length) AS stored_size FROM chunks GROUP BY digest))),
ind AS (SELECT digest, pack_id, CASE WHEN digest LIKE '01%' THEN "offset" + 7 ELSE "offset" END AS "offset" FROM objects WHERE digest NOT LIKE '00%'),
live AS (SELECT DISTINCT digest FROM chunks WHERE snapshot <> 'src0'),
classified AS MATERIALIZED (SELECT o.digest, o.pack_id, o."offset", CASE WHEN i.digest IS NULL OR i.pack_id <> o.pack_id OR i."offset" <> o."offset" THEN 'orphan' WHEN l.digest IS NOT NULL THEN 'live' ELSE 'garbage' END AS state,
  o.stored_size + 53 AS record_bytes FROM objects o LEFT JOIN ind i ON o.digest = i.digest LEFT JOIN live l ON o.digest = l.digest)"""

SUMS = ", ".join(f"count(*) FILTER (state = '{s}') AS {s}_objects, coalesce(sum(record_bytes) FILTER (state = '{s}'), 0)::BIGINT AS {s}_bytes" for s in ("live", "garbage", "orphan"))
STATS = f"{OBJECTS}, stats AS MATERIALIZED (SELECT * FROM (SELECT pack_id, {SUMS} FROM classified GROUP BY pack_id) WHERE live_objects + garbage_objects > 0)"
PICKED = f"{STATS}, picked AS (SELECT pack_id, garbage_bytes / (live_bytes + garbage_bytes) AS ratio FROM stats WHERE live_bytes + garbage_bytes > 0 AND garbage_bytes / (live_bytes + garbage_bytes) >= 0.05)"
LOG = """log AS (SELECT event_id + 1 AS lsn, CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS op, sha256(user_id::VARCHAR) AS digest, event_id // 1000 AS pack_id, event_id * 53 AS "offset" FROM events)"""
#: The table of the reflected CRC-32, byte by byte, and each distinct chunk's bytes as numbers.
CRC = f"""{CHUNKS},
table_rows AS (SELECT i AS v, i::BIGINT AS c, 0 AS k FROM range(256) x(i) UNION ALL SELECT v, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM table_rows WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY v) AS t FROM table_rows WHERE k = 8),
hexed AS MATERIALIZED (SELECT digest, hex(first(bytes)) AS h, first(length)::BIGINT AS n FROM chunks GROUP BY digest),
numbers AS MATERIALIZED (SELECT digest, list_transform(range(n), lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::BIGINT) AS bs FROM hexed)"""


def _with(ctes: str, query: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{query}"


_REPLAY = _with(LOG, """SELECT digest, r.pack_id AS pack_id, r."offset" AS "offset" FROM (SELECT digest, arg_max({'op': op, 'pack_id': pack_id, 'offset': "offset"}, lsn) AS r FROM log GROUP BY digest) WHERE r.op = 1""")
_PATH = "CASE WHEN page_id % 5 = 0 THEN '/' || url WHEN page_id % 7 = 0 THEN 'a/../' || url ELSE url END"
_NAME = r"CASE page_id % 6 WHEN 0 THEN '' WHEN 1 THEN '..' WHEN 2 THEN url WHEN 3 THEN page_id || '.tmp' WHEN 4 THEN 'a\' || page_id ELSE 'snap-' || page_id END"

ORACLE = {
    "file_inventory": "SELECT source AS snapshot, doc_id::VARCHAR AS path, octet_length(encode(text))::BIGINT AS size FROM documents",
    "whole_file_digest": "SELECT source AS snapshot, doc_id::VARCHAR AS path, sha256(text) AS digest FROM documents",
    "cdc_chunks": _with(CHUNKS, 'SELECT snapshot, path, chunk_idx, "offset", length, digest FROM chunks'),
    "chunk_size_histogram": _with(CHUNKS, "SELECT floor(log2(length))::BIGINT AS log2_length, count(*) AS n_chunks, sum(length)::BIGINT AS n_bytes FROM chunks GROUP BY 1"),
    "unique_objects": _with(CHUNKS, "SELECT digest, first(length) AS length, count(*) AS refs FROM chunks GROUP BY digest"),
    "dedup_ratio": _with(CHUNKS, """SELECT *, round(100.0::DOUBLE * (1.0::DOUBLE - unique_bytes / logical_bytes), 4) AS saved_pct FROM (SELECT sum(refs)::BIGINT AS refs, count(*) AS objects, sum(refs * length)::BIGINT AS logical_bytes, sum(length)::BIGINT AS unique_bytes
      FROM (SELECT first(length) AS length, count(*) AS refs FROM chunks GROUP BY digest))"""),
    "dedup_growth": _with(CHUNKS, """SELECT snapshot, refs, logical_bytes, coalesce(new_objects, 0) AS new_objects, coalesce(new_bytes, 0)::BIGINT AS new_bytes, round(100.0::DOUBLE * (1.0::DOUBLE - coalesce(new_bytes, 0) / logical_bytes), 4) AS saved_pct
      FROM (SELECT snapshot, count(*) AS refs, sum(length)::BIGINT AS logical_bytes FROM chunks GROUP BY snapshot)
      LEFT JOIN (SELECT snapshot, count(*) AS new_objects, sum(length) AS new_bytes FROM (SELECT digest, min(snapshot) AS snapshot, first(length) AS length FROM chunks GROUP BY digest) GROUP BY snapshot) USING (snapshot)"""),
    "incremental_new_chunks": _with(CHUNKS, "SELECT DISTINCT digest, length FROM chunks WHERE snapshot <> 'src0' AND digest NOT IN (SELECT digest FROM chunks WHERE snapshot = 'src0')"),
    "pack_assignment": _with(OBJECTS, "SELECT * FROM objects"),
    "index_replay": _REPLAY,
    "checkpoint_replay": _REPLAY,
    "wal_valid_prefix": _with(LOG, "SELECT lsn, op::INT AS op, digest FROM log WHERE lsn < coalesce((SELECT max(lsn) * 9 // 10 FROM log), 9223372036854775807)"),
    "index_rebuild": _with(LOG, """SELECT digest, r.pack_id AS pack_id, r."offset" AS "offset" FROM (SELECT digest, max({'pack_id': pack_id, 'offset': "offset"}) AS r FROM log WHERE op = 1 GROUP BY digest)"""),
    "index_lookup": _with(OBJECTS, 'SELECT snapshot, path, chunk_idx, digest, ind.pack_id, ind."offset" FROM chunks JOIN ind USING (digest)'),
    "latest_pack": _with(OBJECTS, "SELECT coalesce(max(pack_id), 0)::BIGINT AS latest_pack_id FROM objects"),
    "manifest_refs": _with(CHUNKS, "SELECT snapshot, path, chunk_idx, digest FROM chunks"),
    "live_objects": _with(CHUNKS, "SELECT DISTINCT digest FROM chunks WHERE snapshot <> 'src0'"),
    "gc_classify": _with(OBJECTS, "SELECT * FROM classified"),
    "gc_totals": _with(OBJECTS, f"SELECT {SUMS} FROM classified"),
    "gc_pack_stats": _with(STATS, "SELECT * FROM stats"),
    "gc_select_packs": _with(PICKED, "SELECT pack_id, ratio FROM picked"),
    "gc_compact_plan": _with(PICKED, """SELECT digest, pack_id, "offset", record_bytes, CASE WHEN state = 'live' THEN 'copy' ELSE 'erase' END AS action FROM classified WHERE state <> 'orphan' AND pack_id IN (SELECT pack_id FROM picked)"""),
    "dangling_refs": _with(OBJECTS, "SELECT snapshot, count(*) AS refs, count(*) FILTER (ind.digest IS NULL) AS dangling, count(*) FILTER (ind.digest IS NULL) > 0 AS broken FROM chunks LEFT JOIN ind USING (digest) GROUP BY snapshot"),
    "dangling_digests": _with(OBJECTS, "SELECT DISTINCT digest FROM chunks WHERE digest NOT IN (SELECT digest FROM ind)"),
    "orphan_objects": _with(OBJECTS, """SELECT digest, pack_id, "offset", record_bytes FROM classified WHERE state = 'orphan'"""),
    "snapshot_info": _with(CHUNKS, """SELECT snapshot, f.files, f.logical_bytes, refs, distinct_chunks FROM (SELECT snapshot, count(*) AS files, sum(size)::BIGINT AS logical_bytes FROM files GROUP BY snapshot) f
      JOIN (SELECT snapshot, count(*) AS refs, count(DISTINCT digest) AS distinct_chunks FROM chunks GROUP BY snapshot) USING (snapshot)"""),
    "snapshot_list": f"WITH {FILES} SELECT snapshot, count(*) AS files, sum(size)::BIGINT AS bytes FROM files GROUP BY snapshot ORDER BY snapshot",
    "reassemble_check": "SELECT source AS snapshot, doc_id::VARCHAR AS path, sha256(text) AS digest FROM documents",
    "crc_audit": _with(CRC, "SELECT digest, xor(list_reduce([4294967295] || bs, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS crc, true AS crc_ok FROM numbers, crc_table"),
    "zstd_roundtrip": _with(CHUNKS, "SELECT digest, first(length) AS size, true AS fits, true AS intact FROM chunks GROUP BY digest"),
    "path_safety": f"SELECT page_id, {_PATH} AS path, NOT (starts_with({_PATH}, '/') OR list_contains(string_split({_PATH}, '/'), '..')) AS is_safe FROM pages",
    "name_validation": f"SELECT page_id, name, NOT (name IN ('', '.', '..') OR contains(name, '/') OR contains(name, chr(92)) OR ends_with(name, '.tmp')) AS is_valid FROM (SELECT page_id, {_NAME} AS name FROM pages)",
    "hex_roundtrip": "SELECT doc_id, sha256(text) AS digest, false AS short_ok FROM documents",
}
