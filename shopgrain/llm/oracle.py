"""SQL of the queries that SQL can express."""

# DuckDB has SHA-1 as hex only; base 32 takes five bits of it at a time.
_SHA1_BASE32 = """
SELECT page_id, p, h, string_agg(
  substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (CASE WHEN bit_at + 5 > 8
      THEN ((('0x' || substr(h, b * 2 + 1, 4))::INT >> (11 - bit_at)) & 31)
      ELSE ((('0x' || substr(h, b * 2 + 1, 2))::INT >> (3 - bit_at)) & 31) END) + 1, 1), '' ORDER BY i) AS d
FROM (SELECT page_id, p, sha1(p) AS h FROM (SELECT page_id, coalesce(html, '') AS p FROM pages)),
  (SELECT i, i * 5 // 8 AS b, i * 5 % 8 AS bit_at FROM range(32) r(i))
GROUP BY ALL"""


def _words(column: str) -> str:
    low = f"translate({column}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return rf"regexp_extract_all({low}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


# DuckDB has no CRC-32: the table of the bytes, and the words byte by byte.
_CRC32 = """
polynomial AS (SELECT [list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)
  FOR b IN range(256)] AS crc),
hashed AS (SELECT w, xor(4294967295, list_reduce(
    [('0x' || substr(hex(w), 2 * i + 1, 2))::BIGINT FOR i IN range(strlen(w))],
    lambda c, b: xor(crc[(xor(c, b) & 255) + 1], c >> 8), 4294967295)) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM words), polynomial)"""


ORACLE: dict[str, str] = {
    "op11_importance_resampling": f"""
WITH lists AS (SELECT 'd' AS side, doc_id, {_words("text")} AS ws FROM documents
  UNION ALL SELECT 'b', NULL, {_words("text")} FROM benchmark),
words AS (SELECT side, doc_id, unnest(ws) AS w FROM lists),
{_CRC32},
counted AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t
  FROM words JOIN hashed USING (w) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::BIGINT AS ss, coalesce(sum(t), 0)::BIGINT AS tt FROM counted),
gained AS (SELECT bucket, floor(1000 * ln(((t + 1) * (ss + 10000))::DOUBLE / ((s + 1) * (tt + 10000))::DOUBLE))::BIGINT AS gain
  FROM counted, totals),
weighed AS (SELECT doc_id, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
  FROM words JOIN hashed USING (w) JOIN gained USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (SELECT doc_id, coalesce(len(ws), 0)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || doc_id), 8))::BIGINT + 0.5::DOUBLE)
      / 4294967296::DOUBLE)))::BIGINT AS score
  FROM lists LEFT JOIN weighed USING (doc_id) WHERE side = 'd'),
placed AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
  FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored LEFT JOIN placed USING (doc_id)""",
    "op2_seekable_bundles": f"""
SELECT page_id, strlen(p) AS payload_bytes, d AS payload_digest,
  CASE WHEN page_id = min(page_id) OVER w THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> min(page_id) OVER w THEN min(page_id) OVER w END AS refers_to
FROM ({_SHA1_BASE32}) WINDOW w AS (PARTITION BY h)""",
    # Windows of all items, looked up among the document windows of their length.
    "op8_prefix_filter": f"""
WITH d AS (SELECT doc_id, {_words("text")} AS w FROM documents),
b AS (SELECT item_id, {_words("text")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS k,
    array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS s
  FROM b, unnest(range(1, greatest(len(w) - 9, 1) + 1)) r(i) WHERE len(w) > 0),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
  FROM d, (SELECT DISTINCT k FROM bw) ks, unnest(range(1, len(w) - k + 2)) r(i) WHERE len(w) >= k),
h AS (SELECT doc_id, k, i, item_id FROM dw JOIN bw USING (k, s)),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT doc_id, coalesce(len(w), 0)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
  coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN g USING (doc_id)""",
}
