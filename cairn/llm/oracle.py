"""DuckDB's SQL for the text operators that SQL can express."""

WORDS = r"[^\x20\x09-\x0D]+"

OP4 = "SELECT doc_id, coalesce(doc_id, 0) % 4 AS arrival, length(text)::BIGINT AS n_chars, sha256(text) AS text_sha256 FROM documents"

OP5 = rf"""
WITH t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORDS}') AS ws FROM documents),
c AS (SELECT count(*) AS n_docs, avg(len(ws)) AS mean FROM t),
tf AS (SELECT doc_id, w, n, count(*) AS f FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS w FROM t) GROUP BY ALL),
df AS (SELECT w, count(*) AS d FROM tf GROUP BY w),
q AS (SELECT doc_id AS query_id, w, f * ln(1 + (n_docs - d + 0.5e0) / (d + 0.5e0)) AS weight FROM tf JOIN df USING (w), c WHERE doc_id % 50 = 0),
i AS (SELECT doc_id, w, f * 2.2e0 / (f + 1.2e0 * (0.25e0 + 0.75e0 * n / mean)) AS impact FROM tf, c),
s AS (SELECT query_id, doc_id, round(sum(weight * impact), 6) AS score FROM q JOIN i USING (w) GROUP BY ALL)
SELECT query_id, doc_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM s WHERE score > 0 QUALIFY rank <= 10
"""

OP6 = rf"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{WORDS}') AS ws FROM docs),
pos AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5),
win AS (SELECT doc_id, i, array_to_string(ws[i:i+4], ' ') AS g FROM pos),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM rep, (SELECT unnest(range(5)) AS j) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM docs),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM ln WHERE regexp_matches(l, '{WORDS}') GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN dup USING (doc_id)),
b AS (SELECT *, (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT
    + 8 * (n_words > 0 AND n_dup_lines >= 10 AND n_words < 5 * n_dup_lines)::BIGINT + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 25 * n_words)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits, CASE WHEN bit_count(failed_bits) = 1 THEN failed_bits ELSE 0 END AS sole_failure FROM b
"""

OP7 = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
w AS MATERIALIZED (SELECT r, i, md5_number(b[i + 1 : i + 200]) AS k FROM (SELECT r, b, unnest(range(n - 199)) AS i FROM d WHERE n >= 200)),
hit AS (SELECT r, i FROM w SEMI JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
new AS (SELECT r, i, coalesce(i > lag(i) OVER (PARTITION BY r ORDER BY i) + 200, true)::INT AS fresh FROM hit),
run AS (SELECT r, min(i) AS s, max(i) + 200 AS e FROM (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS g FROM new) GROUP BY r, g),
gap AS (SELECT r, s, lag(e, 1, 0) OVER (PARTITION BY r ORDER BY s) AS p FROM (SELECT r, s, e FROM run UNION ALL SELECT r, n, n FROM d)),
kept AS (SELECT r, sha256(unhex(string_agg(hex(b[p + 1 : s]), '' ORDER BY s, p))) AS kept_sha256 FROM gap JOIN d USING (r) GROUP BY r),
gone AS (SELECT r, sum(e - s)::BIGINT AS n_removed, count(*) AS n_spans FROM run GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256 FROM d JOIN kept USING (r) LEFT JOIN gone USING (r)
"""

OP10 = r"""
WITH l AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, source, trim(u, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS k FROM (SELECT doc_id, source, unnest(ls) AS u FROM l)),
n AS (SELECT source, k, count(DISTINCT doc_id) AS n FROM e WHERE k <> '' GROUP BY ALL),
tot AS (SELECT source, count(*) AS total FROM documents GROUP BY source),
bad AS (SELECT n.source, list(k) AS ks FROM n JOIN tot ON n.source IS NOT DISTINCT FROM tot.source WHERE n > 0.1 * total GROUP BY n.source),
k AS (SELECT doc_id, ls, list_filter(ls, lambda x: NOT list_contains(coalesce(ks, []), trim(x, ' ' || chr(9) || chr(11) || chr(12) || chr(13)))) AS kept
  FROM l LEFT JOIN bad ON l.source IS NOT DISTINCT FROM bad.source)
SELECT doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(ls) - len(kept), 0)::BIGINT AS n_dropped, sha256(array_to_string(kept, chr(10))) AS kept_sha256 FROM k
"""


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def _luhn(x: str) -> str:
    d = _digits(x)
    return f"""(length({d}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(length({d})), lambda i:
      CASE WHEN i % 2 = 1 THEN (substr({d}, (length({d}) - i)::BIGINT, 1)::INT * 2) // 10 + (substr({d}, (length({d}) - i)::BIGINT, 1)::INT * 2) % 10
      ELSE substr({d}, (length({d}) - i)::BIGINT, 1)::INT END)) % 10 = 0)"""


def _near(words: str) -> str:
    return f"(regexp_matches(lower(substr(t, greatest(1, s - 39), least(s, 40))), '{words}') OR regexp_matches(lower(substr(t, s + length(m) + 1, 40)), '{words}'))"


#: kind, what may stand before it if not the text's beginning, plain pattern, what follows from the match m at s, validator
OP2_KINDS = [
    ("email", "", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "m", "true"),
    ("ip", "", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+", "m", "list_max(list_transform(string_split(m, '.'), lambda p: CASE WHEN length(ltrim(p, '0')) > 3 THEN 999 ELSE ('0' || ltrim(p, '0'))::INT END)) <= 255"),
    ("card", "", r"[0-9](?:[ -]?[0-9])+", "m", _luhn("m")),
    ("phone", "", r"\+[0-9][ ().0-9-]+[0-9]", "m", f"length({_digits('m')}) BETWEEN 9 AND 15"),
    (
        "iban",
        "[^A-Za-z0-9]",
        "[A-Z]{2}[0-9]{2}",
        """(SELECT list_filter(list_transform(range(len(w), 0, -1), lambda i: array_to_string(w[1:i], ' ')), lambda x: NOT regexp_matches(x, '[a-z]') AND length(replace(x, ' ', '')) BETWEEN 15 AND 34
        AND list_reduce([0] || list_transform(string_split(replace(x, ' ', '')[5:] || replace(x, ' ', '')[1:4], ''), lambda c: strpos('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c)::INT - 1), lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1)[1]
        FROM (SELECT string_split(regexp_extract(substr(t, s + 1, 80), '^[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}[A-Za-z0-9]?'), ' ') AS w))""",
        "m IS NOT NULL",
    ),
    ("ssn", "[^0-9-]", "[0-9]{3}-[0-9]{2}-[0-9]{4}", "m", f"NOT regexp_matches(substr(t, s + 12, 1), '[0-9-]') AND NOT regexp_matches(m, '^(?:000|666|9)|-00-|0000$') AND {_near('ssn|social|tax')}"),
    ("secret", "[^0-9A-Za-z]", "[0-9a-f]{32,}", "m", f"NOT regexp_matches(substr(t, s + length(m) + 1, 1), '[0-9A-Za-z]') AND {_near('token|secret|passw|api.?key|credential')}"),
]


def _kind(order: int, name: str, lead: str, core: str, take: str, valid: str) -> str:
    pattern = f"(?:^|{lead})(?:{core})" if lead else core
    return f"""SELECT doc_id, {order} AS o, '{name}' AS kind, s, s + length(m) AS e FROM (SELECT doc_id, t, s, {take} AS m FROM (
      SELECT doc_id, t, regexp_extract(ms[i], '(?:{core})$') AS m, (list_sum(list_transform(ps[1:i], lambda p: length(p))) + list_sum(list_transform(ms[1:i], lambda x: length(x))) - length(regexp_extract(ms[i], '(?:{core})$')))::BIGINT AS s
      FROM (SELECT doc_id, t, ms, ps, unnest(range(1, len(ms) + 1)) AS i FROM (
        SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS ps FROM docs) WHERE len(ms) > 0))) WHERE {valid}"""


OP2 = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS MATERIALIZED ({" UNION ALL ".join(_kind(i, *k) for i, k in enumerate(OP2_KINDS))}),
a AS (SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) FILTER (o < 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY o, s) AS spans FROM f GROUP BY doc_id)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN a USING (doc_id)
"""

ORACLE = {"op2_pii": OP2, "op4_sharding": OP4, "op5_bm25": OP5, "op6_quality_rules": OP6, "op7_suffixes": OP7, "op10_site_lines": OP10}
