"""Results of the operators as plain SQL, where SQL can express them."""

from __future__ import annotations

#: Code points of the blanks stripped from a line, and of A-Z with its lower case.
BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

LINE_DEDUP = f"""
WITH split AS (
  SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents
), lines AS (
  SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM split
), keyed AS (
  SELECT doc_id, k, line, {LOWER.format(f"trim(line, {BLANKS})")} AS key FROM lines
), common AS (
  SELECT key AS common FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10
)
SELECT doc_id, count(*) AS n_lines, count(common) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE common IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common ON key = common
GROUP BY doc_id
"""

WARC = """
WITH bodies AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), digests AS (
  SELECT page_id, octet_length(body) AS payload_bytes, CAST(unhex(sha1(body)) AS BIT)::VARCHAR AS bits FROM bodies
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY bits, payload_bytes) AS first FROM digests
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         1 + CAST(list_sum(list_transform(range(5), lambda j:
           CAST(substr(bits, 5 * i + j + 1, 1) AS INT) * [16, 8, 4, 2, 1][j + 1])) AS INT), 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM firsts
"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words
), shingles AS MATERIALIZED (
  SELECT doc_id, unnest(s) AS shingle FROM sets
), sizes AS (
  SELECT doc_id, len(s) AS n FROM sets
), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS MATERIALIZED (
  SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), both_ways AS MATERIALIZED (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.doc_id, b FROM reach JOIN both_ways ON other = a
)
SELECT doc_id, any_value(n) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reach JOIN sizes USING (doc_id) GROUP BY doc_id
"""

DECONTAMINATE = f"""
WITH docs AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), cut AS (
  SELECT item, unnest(list_transform(range(1, len(w) - least(13, len(w)) + 2), lambda i: w[i:i + least(13, len(w)) - 1])) AS words
  FROM items WHERE len(w) > 0
), windows AS MATERIALIZED (
  SELECT words, array_to_string(words, ' ') AS key, list(DISTINCT item) AS items FROM cut GROUP BY words
), sizes AS (
  SELECT DISTINCT len(words) AS n FROM windows
), places AS MATERIALIZED (
  SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs)
), starts AS (
  SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM docs, sizes WHERE len(w) >= n
), hits AS MATERIALIZED (
  SELECT doc_id, i, n, items FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS key FROM starts) JOIN windows USING (key)
), covered AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, list_sort(list(DISTINCT item)) AS items FROM (SELECT doc_id, unnest(items) AS item FROM hits) GROUP BY doc_id
), frequency AS MATERIALIZED (
  SELECT word, count(*) AS f FROM places GROUP BY word
), spread AS (
  SELECT key, word, k, f FROM (SELECT key, unnest(words) AS word, generate_subscripts(words, 1) AS k FROM windows) LEFT JOIN frequency USING (word)
), anchors AS (
  SELECT key, arg_min(word, (f, k)) AS anchor FROM spread GROUP BY key HAVING count(*) = count(f)
), anchored AS MATERIALIZED (
  SELECT key, doc_id, i FROM anchors JOIN places ON word = anchor
), wanted AS (
  SELECT DISTINCT key, word FROM spread
), around AS (
  SELECT anchored.key, anchored.doc_id, anchored.i, count(DISTINCT wanted.word) AS found
  FROM anchored JOIN wanted ON wanted.key = anchored.key
  JOIN places ON places.doc_id = anchored.doc_id AND places.word = wanted.word AND places.i BETWEEN anchored.i - 26 AND anchored.i + 26
  GROUP BY ALL
), close AS (
  SELECT DISTINCT around.doc_id, around.key FROM around
  JOIN (SELECT key, count(*) AS need FROM wanted GROUP BY key) AS n ON n.key = around.key AND need = found
), near AS (
  SELECT doc_id, count(DISTINCT item) AS n_near FROM (SELECT doc_id, unnest(items) AS item FROM close JOIN windows USING (key)) GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(items), 0) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       coalesce(n_near, 0) AS n_near_items
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id) LEFT JOIN near USING (doc_id)
"""

#: CRC-32 of the bytes of a text, bit by bit.
CRC32 = (
    "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(octet_length(encode({0}))), lambda i: "
    "('0x' || substr(hex(encode({0})), CAST(2 * i + 1 AS INT), 2))::BIGINT)), lambda c, b: "
    "list_reduce([xor(c, b), 1, 1, 1, 1, 1, 1, 1, 1], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
)

RESAMPLING = f"""
WITH docs AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), items AS MATERIALIZED (
  SELECT regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), own AS MATERIALIZED (
  SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM docs) GROUP BY ALL
), asked AS MATERIALIZED (
  SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM items) GROUP BY ALL
), names AS MATERIALIZED (
  SELECT word, {CRC32.format("word")} % 10000 AS bucket FROM (SELECT word FROM own UNION SELECT word FROM asked)
), corpus AS (
  SELECT bucket, sum(n) AS s FROM own JOIN names USING (word) GROUP BY bucket
), target AS (
  SELECT bucket, sum(n) AS t FROM asked JOIN names USING (word) GROUP BY bucket
), totals AS (
  SELECT coalesce((SELECT sum(n) FROM own), 0) AS all_s, coalesce((SELECT sum(n) FROM asked), 0) AS all_t
), gains AS MATERIALIZED (
  SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * (all_t + 10000)::DOUBLE))) AS BIGINT) AS gain
  FROM (SELECT unnest(range(10000)) AS bucket) LEFT JOIN corpus USING (bucket) LEFT JOIN target USING (bucket), totals
), weighed AS (
  SELECT doc_id, sum(n * gain) AS total FROM own JOIN names USING (word) JOIN gains USING (bucket) GROUP BY doc_id
), scored AS (
  SELECT doc_id, len(w) AS n_features, CASE WHEN len(w) = 0 THEN 0 ELSE CAST(floor(total::DOUBLE / len(w)) AS BIGINT) END AS weight,
         ('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT AS h
  FROM docs LEFT JOIN weighed USING (doc_id)
), scores AS (
  SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM scored
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scores WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score,
       CASE WHEN rank <= 10 * (SELECT count(*) FROM ranked) // 100 THEN rank END AS rank
FROM scores LEFT JOIN ranked USING (doc_id)
"""

PREFIX_TRIE = f"""
WITH own AS MATERIALIZED (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS rn
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS MATERIALIZED (
  SELECT conv_id, conv_id - conv_id % 20 AS base, {CRC32.format("CAST(conv_id AS VARCHAR)")} % 4 AS h FROM (SELECT DISTINCT conv_id FROM own)
), rebuilt AS (
  SELECT c.conv_id, 0 AS part, rn, role, text FROM convs AS c JOIN own ON own.conv_id = base AND rn <= h
  UNION ALL
  SELECT conv_id, 1, rn, role, text FROM convs JOIN own USING (conv_id) WHERE rn > h
), placed AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, rn) AS depth, md5(length(role) || ':' || role || text) AS turn,
         len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS words
  FROM rebuilt
), paths AS MATERIALIZED (
  SELECT conv_id, depth, words, string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM placed
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM convs
), lengths AS (
  SELECT conv_id, max(depth) AS depth FROM paths GROUP BY conv_id
), nodes AS MATERIALIZED (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
         string_agg(CASE WHEN lengths.conv_id IS NOT NULL THEN CAST(paths.conv_id AS VARCHAR) END, ',' ORDER BY paths.conv_id) AS ends
  FROM paths LEFT JOIN lengths USING (conv_id, depth) GROUP BY path, depth
), families AS MATERIALIZED (
  SELECT above.path, count(*) AS n_children FROM nodes AS above JOIN nodes AS below
  ON below.depth = above.depth + 1 AND above.path = substr(below.path, 1, 32 * above.depth::INT) GROUP BY above.path
), pairs AS (
  SELECT DISTINCT a.path, b.path AS below FROM paths AS a JOIN paths AS b ON a.conv_id = b.conv_id AND a.depth <= b.depth
), subtrees AS (
  SELECT pairs.path, sum((n_convs - 1) * words) AS saved, count(*) FILTER (WHERE n_children IS NULL) AS leaves
  FROM pairs JOIN nodes ON nodes.path = below LEFT JOIN families ON families.path = below GROUP BY pairs.path
)
SELECT nodes.conv_id, nodes.depth, above.conv_id AS parent_conv_id, nodes.n_convs, coalesce(n_children, 0) AS n_children,
       leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(nodes.ends, '')) AS ends_sha256
FROM nodes JOIN subtrees ON subtrees.path = nodes.path LEFT JOIN families ON families.path = nodes.path
LEFT JOIN nodes AS above ON nodes.depth > 0 AND above.path = substr(nodes.path, 1, 32 * (nodes.depth::INT - 1))
"""

ORACLE = {
    "op6_near_duplicates": NEAR_DUPLICATES,
    "op8_decontaminate": DECONTAMINATE,
    "op9_warc": WARC,
    "op10_line_dedup": LINE_DEDUP,
    "op11_resampling": RESAMPLING,
    "op13_prefix_trie": PREFIX_TRIE,
}
