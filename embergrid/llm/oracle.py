"""SQL counterparts of the queries that SQL can express (DuckDB dialect)."""

from __future__ import annotations

_CRC_TABLE = """SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(0, 8),
    lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END, i) AS c FROM range(256) r(i))"""


def _crc(hex_column: str) -> str:
    """CRC-32 of bytes written in hex; the table of bytes is ``t``."""
    octets = f"list_transform(regexp_extract_all({hex_column}, '..'), lambda p: ('0x' || p)::BIGINT)"
    return f"xor(list_reduce({octets}, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::BIGINT), 4294967295::BIGINT)"


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_DRAWN = "('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT"

RESAMPLE = f"""
WITH tab AS ({_CRC_TABLE}), texts AS (
  SELECT true AS mine, row_number() OVER () AS id, doc_id, {_WORDS} AS words FROM documents
  UNION ALL SELECT false, row_number() OVER (), NULL, {_WORDS} FROM benchmark
), features AS (
  SELECT mine, id, unnest(words) AS f FROM texts
  UNION ALL SELECT mine, id, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) FROM texts
), hashed AS (
  SELECT f, {_crc('x')} % 10000 AS bucket FROM (SELECT DISTINCT f, hex(encode(f)) AS x FROM features) CROSS JOIN tab
), counts AS (
  SELECT mine, id, bucket, count(*) AS n FROM features JOIN hashed USING (f) GROUP BY ALL
), per_bucket AS (
  SELECT bucket, coalesce(sum(n) FILTER (mine), 0) AS s, coalesce(sum(n) FILTER (NOT mine), 0) AS t FROM counts GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST((t + 1) * (sum(s) OVER () + 10000) AS DOUBLE)
    / CAST((s + 1) * (sum(t) OVER () + 10000) AS DOUBLE))) AS BIGINT) AS gain FROM per_bucket
), weights AS (
  SELECT id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain) / CAST(sum(n) AS DOUBLE)) AS BIGINT) AS weight
  FROM counts JOIN gains USING (bucket) WHERE mine GROUP BY id
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(({_DRAWN} + 0.5e0) / 4294967296e0))) AS BIGINT) AS score, len(words) >= 20 AS long
  FROM texts LEFT JOIN weights USING (id) WHERE mine
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY long ORDER BY score DESC, doc_id NULLS FIRST) AS place FROM scored
)
SELECT doc_id, n_features, weight, score,
  CASE WHEN long AND place <= 25 * (SELECT count(*) FROM scored WHERE long) // 100 THEN place END AS rank
FROM placed
"""

SHARDS = f"""
WITH tab AS ({_CRC_TABLE}), texts AS (
  SELECT doc_id, row_number() OVER () AS row, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS x,
    substr(md5(coalesce(text, '')), 1, 15) AS mark FROM documents
), sized AS (
  SELECT doc_id, mark, row, CAST(size AS BIGINT) AS size, {_crc('x')} AS text_crc32 FROM texts CROSS JOIN tab
), summed AS (
  SELECT *, sum(size) OVER (ORDER BY mark, doc_id NULLS FIRST, row) AS upto, sum(size) OVER (PARTITION BY mark) AS copies, sum(size) OVER () AS total FROM sized
), middles AS (
  SELECT *, CASE WHEN copies * 16 <= 0.05e0 * total THEN 2 * min(upto - size) OVER (PARTITION BY mark) + copies ELSE 2 * upto - size END AS twice FROM summed
), placed AS (SELECT *, CAST(least(15, twice * 16 // (2 * total)) AS INT) AS shard FROM middles)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY mark, doc_id NULLS FIRST, row) - 1 AS slot, CAST(NULL AS INT) AS grown_shard
FROM placed
"""

HISTORIES = f"""
WITH tab AS ({_CRC_TABLE}), conv AS (
  SELECT c, c - c % 100 AS base, {_crc('x')} % 6 AS h
  FROM (SELECT DISTINCT conv_id AS c, hex(encode(CAST(conv_id AS VARCHAR))) AS x FROM conversations WHERE conv_id IS NOT NULL) CROSS JOIN tab
), own AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
    md5(CAST(octet_length(encode(coalesce(role, ''))) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS nth
  FROM conversations WHERE conv_id IS NOT NULL
), grown AS (
  SELECT v.c, o.nth, o.role, o.text FROM conv v JOIN own o ON o.c = v.base AND o.nth < v.h
  UNION ALL SELECT v.c, o.nth + 5, o.role, o.text FROM conv v JOIN own o ON o.c = v.c AND o.nth >= v.h
), steps AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY nth) AS d, count(*) OVER (PARTITION BY c) AS len, length(text) AS chars,
    md5(string_agg(len(role) || ':' || len(text) || ':' || role || text, '') OVER (PARTITION BY c ORDER BY nth)) AS key FROM grown
), members AS (
  SELECT c, d, len, chars, key FROM steps
  UNION ALL SELECT c, 0, coalesce((SELECT max(s.len) FROM steps s WHERE s.c = conv.c), 0), 0, '' FROM conv
), nodes AS (
  SELECT d, key, min(c) AS conv_id, count(*) AS n, any_value(chars) AS chars, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (len = d) AS ids
  FROM members GROUP BY d, key
), links AS (
  SELECT DISTINCT m.d, m.key, p.key AS parent FROM members m JOIN members p ON p.c = m.c AND p.d = m.d - 1
), kids AS (SELECT d - 1 AS d, parent AS key, count(*) AS n FROM links GROUP BY ALL), below AS (
  SELECT DISTINCT m.d, m.key, a.d AS top_d, a.key AS top FROM members m JOIN members a ON a.c = m.c AND a.d <= m.d
), sums AS (
  SELECT b.top_d AS d, b.top AS key, count(*) FILTER (k.n IS NULL) AS leaves, sum((n.n - 1) * n.chars) AS saved
  FROM below b JOIN nodes n ON n.d = b.d AND n.key = b.key LEFT JOIN kids k ON k.d = b.d AND k.key = b.key GROUP BY ALL
)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n AS n_convs, coalesce(k.n, 0) AS n_children, s.leaves AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ids, '')) AS ends_sha256
FROM nodes n JOIN sums s ON s.d = n.d AND s.key = n.key LEFT JOIN kids k ON k.d = n.d AND k.key = n.key
LEFT JOIN links l ON l.d = n.d AND l.key = n.key LEFT JOIN nodes p ON p.d = n.d - 1 AND p.key = l.parent
"""
