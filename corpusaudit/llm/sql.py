"""DuckDB SQL of the registered queries, written from their definitions."""

from __future__ import annotations

#: CRC-32 of a text's bytes, bit by bit as published (polynomial 0xEDB88320), with the table of single bytes made in place.
JUMP_SHARDS = """
WITH RECURSIVE bits(byte, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL
  SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
steps AS MATERIALIZED (SELECT list(c ORDER BY byte) AS t FROM bits WHERE k = 8),
hexed AS (SELECT doc_id, COALESCE(text, '') AS text, regexp_extract_all(hex(encode(COALESCE(text, ''))), '..') AS pairs FROM documents),
crcs AS (
  SELECT doc_id, octet_length(encode(text)) + 1 AS size,
    xor(4294967295, list_reduce(list_transform(pairs, lambda p: CAST('0x' || p AS BIGINT)),
      lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1]), CAST(4294967295 AS BIGINT))) AS text_crc32
  FROM hexed, steps),
jumps(doc_id, n, key, b, j) AS (
  SELECT DISTINCT doc_id, n, CAST(COALESCE(doc_id, 0) AS HUGEINT), CAST(-1 AS BIGINT), CAST(0 AS BIGINT) FROM documents, (VALUES (16), (17)) v(n)
  UNION ALL
  SELECT doc_id, n, k, j, CAST(floor((j + 1) * (CAST(2147483648 AS DOUBLE) / CAST(k // 8589934592 + 1 AS DOUBLE))) AS BIGINT)
  FROM (SELECT doc_id, n, j, (key * 2862933555777941757 + 1) % 18446744073709551616 AS k FROM jumps WHERE j < n) s),
placed AS (
  SELECT doc_id, MAX(CASE WHEN n = 16 THEN b END) AS shard, MAX(CASE WHEN n = 17 THEN b END) AS grown_shard
  FROM jumps WHERE j >= n GROUP BY doc_id)
SELECT c.doc_id, CAST(size AS BIGINT) AS size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  ROW_NUMBER() OVER (PARTITION BY shard ORDER BY c.doc_id, text_crc32, size) - 1 AS slot, CAST(grown_shard AS INTEGER) AS grown_shard
FROM crcs c JOIN placed p ON p.doc_id IS NOT DISTINCT FROM c.doc_id
"""

#: Words by splitting at the six white-space bytes after A-Z became lower case; pairs meet over shared shingles; the closure runs until nothing is reached anew.
NEAR_DUPLICATES = """
WITH RECURSIVE split AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[ \\x09-\\x0D]+'), lambda w: w <> '') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM split),
classes AS MATERIALIZED (SELECT MIN(doc_id) AS doc_id, list_sort(s) AS s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY list_sort(s), len(s)),
items AS (SELECT doc_id, n, unnest(s) AS g FROM classes),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, x.n AS n, y.n AS m, COUNT(*) AS i FROM items x JOIN items y ON x.g = y.g AND x.doc_id < y.doc_id
  WHERE 100 * least(x.n, y.n) >= 85 * greatest(x.n, y.n) GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM pairs WHERE 100 * i >= 85 * (n + m - i)),
mutual AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT doc_id, doc_id FROM classes UNION SELECT r.a, l.b FROM reach r JOIN mutual l ON l.a = r.b),
low AS (SELECT a, MIN(b) AS component_id FROM reach GROUP BY a)
SELECT t.doc_id, CAST(len(t.s) AS BIGINT) AS n_shingles, COALESCE(w.component_id, t.doc_id) AS component_id, t.doc_id = COALESCE(w.component_id, t.doc_id) AS kept
FROM sets t LEFT JOIN classes c ON len(t.s) > 0 AND c.s = list_sort(t.s) LEFT JOIN low w ON w.a = c.doc_id
"""

#: Windows as joined words; a document's strings of the same numbers of words meet them by equality.
BENCHMARK = """
WITH lower_docs AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM documents),
item_words AS (SELECT item_id, list_filter(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS w FROM benchmark),
windows AS MATERIALIZED (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (
  SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM item_words WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
grams AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM lower_docs, lengths WHERE len(w) >= n)),
found AS MATERIALIZED (SELECT doc_id, item_id, g.n, i FROM grams g JOIN windows x ON x.g = g.g AND x.n = g.n),
hits AS (SELECT doc_id, COUNT(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, COUNT(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (
  SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, COALESCE(n_hit, 0) AS n_hit, COALESCE(n_items, 0) AS n_items, sha256(COALESCE(items, '')) AS items_sha256,
  COALESCE(n_hit, 0) > 0 AND 20 * COALESCE(n_hit, 0) >= len(d.w) AS contaminated
FROM lower_docs d LEFT JOIN hits h ON h.doc_id = d.doc_id LEFT JOIN named m ON m.doc_id = d.doc_id
"""

# Calls, results and schemas derived from the conversations; both engines read these texts.
CALLS = """
SELECT conv_id, turn, 'call-' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS call_id,
  CASE WHEN turn >= 2 THEN 'call-' || CAST(conv_id AS STRING) || '-' || CAST(CASE WHEN turn % 5 = 4 THEN turn ELSE turn - 2 END AS STRING) END AS after,
  CASE (conv_id + turn) % 4 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' WHEN 2 THEN 'store' ELSE 'unheard' END AS tool,
  CASE WHEN conv_id % 11 = 3 THEN '[' || CAST(turn AS STRING) || ']' WHEN conv_id % 13 = 5 THEN '{broken' ELSE
    '{ "query" : "' || REPLACE(REPLACE(REPLACE(text, chr(92), ' '), '"', ' '), chr(10), ' ') || '"' ||
    CASE WHEN conv_id % 3 = 0 THEN ', "limit": ' || CAST(turn AS STRING) WHEN conv_id % 3 = 1 THEN ', "limit": "many"' ELSE '' END ||
    CASE WHEN conv_id % 7 = 0 THEN ', "extra": true' ELSE '' END || ' }' END AS arguments
FROM conversations WHERE role = 'assistant'"""
RESULTS = """
SELECT 'call-' || CAST(conv_id AS STRING) || '-' || CAST(turn - 1 AS STRING) AS call_id, turn, REPLACE(REPLACE(REPLACE(text, chr(92), ' '), '"', ' '), chr(10), ' ') AS content
FROM conversations WHERE role = 'user'"""
SCHEMAS = """
SELECT tool, field, type, required FROM VALUES ('search', 'query', 'STRING', true), ('search', 'limit', 'BIGINT', false),
  ('lookup', 'query', 'STRING', true), ('lookup', 'limit', 'BIGINT', true), ('store', 'query', 'STRING', true), ('store', 'limit', 'STRING', false) AS s(tool, field, type, required)"""

#: Depth by following ids upwards; canonical JSON by joining the known parts in key order.
TOOL_CALLS = f"""
WITH RECURSIVE calls AS MATERIALIZED ({CALLS}),
results AS ({RESULTS}),
schemas AS ({SCHEMAS.replace("FROM VALUES", "FROM (VALUES").replace("AS s(", ") AS s(")}),
climb(call_id, up, depth) AS (
  SELECT call_id, after, 0 FROM calls
  UNION ALL
  SELECT l.call_id, c.after, depth + 1 FROM climb l JOIN calls c ON c.call_id = l.up WHERE depth < 100),
tops AS (SELECT l.call_id, MIN(depth) AS depth FROM climb l LEFT JOIN calls c ON c.call_id = l.up WHERE c.call_id IS NULL GROUP BY l.call_id),
answers AS (SELECT call_id, COUNT(*) AS n_results, MIN(turn) AS turn, arg_min(content, turn) AS content FROM results GROUP BY call_id),
given AS (
  SELECT call_id, conv_id, tool, 'query' AS field, 'STRING' AS kind FROM calls WHERE conv_id % 11 <> 3 AND conv_id % 13 <> 5
  UNION ALL SELECT call_id, conv_id, tool, 'limit', CASE WHEN conv_id % 3 = 0 THEN 'BIGINT' ELSE 'STRING' END FROM calls WHERE conv_id % 11 <> 3 AND conv_id % 13 <> 5 AND conv_id % 3 < 2
  UNION ALL SELECT call_id, conv_id, tool, 'extra', 'BOOLEAN' FROM calls WHERE conv_id % 11 <> 3 AND conv_id % 13 <> 5 AND conv_id % 7 = 0),
found AS (
  SELECT call_id, 'not an object' AS error FROM calls WHERE conv_id % 11 = 3 OR conv_id % 13 = 5
  UNION ALL SELECT call_id, 'unknown tool' FROM calls WHERE conv_id % 11 <> 3 AND conv_id % 13 <> 5 AND tool = 'unheard'
  UNION ALL SELECT g.call_id, 'unknown ' || g.field FROM given g LEFT JOIN schemas s ON s.tool = g.tool AND s.field = g.field WHERE g.tool <> 'unheard' AND s.field IS NULL
  UNION ALL SELECT g.call_id, g.field || ' is not ' || s.type FROM given g JOIN schemas s ON s.tool = g.tool AND s.field = g.field WHERE g.kind <> s.type
  UNION ALL SELECT c.call_id, 'missing ' || s.field FROM calls c JOIN schemas s ON s.tool = c.tool AND s.required LEFT JOIN given g ON g.call_id = c.call_id AND g.field = s.field
    WHERE g.field IS NULL AND c.conv_id % 11 <> 3 AND c.conv_id % 13 <> 5),
errors AS (SELECT call_id, list(DISTINCT error ORDER BY error) AS errors FROM found GROUP BY call_id),
rows AS (SELECT c.conv_id, c.turn, c.call_id, c.tool, t.depth, COALESCE(e.errors, []) AS errors, COALESCE(a.n_results, 0) AS n_results,
    '{{"arguments":' || CASE WHEN conv_id % 13 = 5 AND conv_id % 11 <> 3 THEN 'null' WHEN conv_id % 11 = 3 THEN arguments ELSE
      '{{' || CASE WHEN conv_id % 7 = 0 THEN '"extra":true,' ELSE '' END ||
      CASE WHEN conv_id % 3 = 0 THEN '"limit":' || CAST(c.turn AS STRING) || ',' WHEN conv_id % 3 = 1 THEN '"limit":"many",' ELSE '' END ||
      '"query":' || regexp_extract(arguments, '"query" : ("[^"]*")', 1, 's') || '}}' END AS head, content FROM calls c
  LEFT JOIN tops t USING (call_id) LEFT JOIN errors e USING (call_id) LEFT JOIN answers a USING (call_id))
SELECT conv_id, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY COALESCE(depth, 1000000), turn, call_id) - 1 AS position, turn, call_id, tool, CAST(depth AS BIGINT) AS depth,
  CASE WHEN depth IS NULL THEN 'cyclic' WHEN len(errors) > 0 THEN 'invalid' WHEN n_results = 0 THEN 'unanswered' ELSE 'ok' END AS status, errors, n_results,
  head || ',"call_id":"' || call_id || '","result":' || COALESCE('"' || content || '"', 'null') || ',"tool":"' || tool || '"}}' AS message
FROM rows
"""

#: Terms by splitting at all other bytes; every term of an item joins the documents that hold it.
LEXICAL = """
WITH doc_terms AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')) AS term FROM documents),
item_terms AS (SELECT item_id, unnest(list_filter(regexp_split_to_array(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '')) AS term FROM benchmark),
lengths AS MATERIALIZED (SELECT doc_id, COUNT(*) AS n FROM doc_terms GROUP BY doc_id),
corpus AS MATERIALIZED (SELECT COUNT(*) AS docs, CAST(SUM(n) AS BIGINT) AS length FROM lengths),
asked AS MATERIALIZED (SELECT item_id, term, COUNT(*) AS times FROM item_terms GROUP BY item_id, term),
tfs AS MATERIALIZED (SELECT doc_id, term, COUNT(*) AS tf FROM doc_terms WHERE term IN (SELECT term FROM asked) GROUP BY doc_id, term),
weights AS MATERIALIZED (SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * COUNT(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tfs, corpus GROUP BY term, docs),
gains AS MATERIALIZED (SELECT t.doc_id, t.term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + ((25 * n * docs) // length)))) AS gain
  FROM tfs t JOIN weights USING (term) JOIN lengths l ON l.doc_id = t.doc_id, corpus),
scores AS (SELECT item_id, doc_id, CAST(SUM(times * gain) AS BIGINT) AS score FROM asked JOIN gains USING (term) GROUP BY item_id, doc_id),
ranked AS (SELECT item_id, CAST(ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20
"""

#: Prefixes as joined digests of their turns; ancestors by the path of a node's smallest member.
PREFIX_TRIE = """
WITH RECURSIVE bits(byte, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL
  SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM bits WHERE k < 8),
steps AS MATERIALIZED (SELECT list(c ORDER BY byte) AS t FROM bits WHERE k = 8),
ids AS MATERIALIZED (
  SELECT conv_id, xor(4294967295, list_reduce(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda c, b: xor(c // 256, t[(xor(c, b) % 256) + 1]), CAST(4294967295 AS BIGINT))) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL), steps),
own AS MATERIALIZED (
  SELECT conv_id, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos, octet_length(encode(COALESCE(text, ''))) AS bytes,
    md5(length(COALESCE(role, '')) || ':' || COALESCE(role, '') || COALESCE(text, '')) AS digest FROM conversations),
parts AS (
  SELECT i.conv_id AS c, 0 AS part, pos, bytes, digest FROM ids i JOIN own o ON o.conv_id = i.conv_id - i.conv_id % 5 AND pos < h
  UNION ALL SELECT i.conv_id, 1, pos, bytes, digest FROM ids i JOIN own o ON o.conv_id = i.conv_id AND pos >= h),
walks AS MATERIALIZED (
  SELECT conv_id AS c, 0 AS d, '' AS prefix, 0 AS bytes FROM ids
  UNION ALL SELECT c, ROW_NUMBER() OVER w, string_agg(digest, '') OVER w, bytes FROM parts WINDOW w AS (PARTITION BY c ORDER BY part, pos)),
nodes AS MATERIALIZED (SELECT prefix, d, MIN(c) AS conv_id, COUNT(*) AS n_convs, any_value(bytes) AS bytes FROM walks GROUP BY prefix, d),
children AS (SELECT left(prefix, 32 * (d - 1)) AS prefix, d - 1 AS d, COUNT(*) AS n FROM nodes WHERE d > 0 GROUP BY ALL),
counted AS MATERIALIZED (SELECT n.*, COALESCE(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.prefix = n.prefix AND c.d = n.d),
totals AS (
  SELECT w.prefix, w.d, SUM(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, SUM((n_convs - 1) * n.bytes) AS saved_tokens
  FROM counted n JOIN walks w ON w.c = n.conv_id AND w.d <= n.d GROUP BY ALL),
ends AS (SELECT prefix, d, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM (SELECT *, MAX(d) OVER (PARTITION BY c) AS size FROM walks) WHERE d = size GROUP BY ALL)
SELECT n.conv_id, CAST(n.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(t.n_leaves AS BIGINT) AS n_leaves,
  CAST(t.saved_tokens AS BIGINT) AS saved_tokens, sha256(COALESCE(e.ids, '')) AS ends_sha256
FROM counted n JOIN totals t ON t.prefix = n.prefix AND t.d = n.d LEFT JOIN ends e ON e.prefix = n.prefix AND e.d = n.d
LEFT JOIN nodes p ON n.d > 0 AND p.d = n.d - 1 AND p.prefix = left(n.prefix, 32 * (n.d - 1))
"""
