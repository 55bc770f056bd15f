"""DuckDB twins of the corpus queries that SQL can express."""

QUALITY_RULES = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws,
         list_filter(string_split(text, chr(10)),
                     lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
windows AS (
  SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS win
  FROM (SELECT rid, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)),
again AS (
  SELECT rid, i FROM windows
  QUALIFY count(*) OVER (PARTITION BY rid, win) > 1),
repeated AS (
  SELECT rid, count(DISTINCT i + k) AS n
  FROM again, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
m AS (
  SELECT w.rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words,
    len(lines) AS n_lines, len(list_distinct(ws)) AS n_distinct,
    length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_capitals,
    length(regexp_replace(text, '[^!]', '', 'g')) AS n_exclamations
  FROM w LEFT JOIN repeated r USING (rid)),
judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > 3 * n_words OR 10 * n_capitals > 3 * word_chars
    OR 10 * n_exclamations > 3 * n_words OR 2 * n_dup_lines > n_lines
    OR word_chars < 2 * n_words OR word_chars > 20 * n_words
    OR 20 * n_distinct < n_words) AS kept
FROM judged
"""

_WINDOW_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = ("translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")

DECONTAMINATION = rf"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WINDOW_WORD}') AS ws
  FROM benchmark),
known AS (
  SELECT DISTINCT item, n, array_to_string(ws[i : i + n - 1], ' ') AS win
  FROM (SELECT item, ws, least(10, len(ws)) AS n,
               unnest(generate_series(1, len(ws) - least(10, len(ws)) + 1)) AS i
        FROM items WHERE len(ws) > 0)),
lengths AS (SELECT DISTINCT n FROM known),
d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WINDOW_WORD}') AS ws
  FROM documents),
scanned AS (
  SELECT rid, n, i, array_to_string(ws[i : i + n - 1], ' ') AS win
  FROM (SELECT rid, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i
        FROM d, lengths WHERE len(ws) >= n)),
hits AS (SELECT rid, i, s.n, item FROM scanned s JOIN known k ON s.n = k.n AND s.win = k.win),
covered AS (
  SELECT rid, count(DISTINCT spot) AS n_hit
  FROM (SELECT rid, unnest(generate_series(i, i + n - 1)) AS spot FROM hits) GROUP BY rid),
named AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
"""

JACCARD_JOIN = rf"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
sets AS (
  SELECT rid, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5
    THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(ws) - 4),
         lambda i: array_to_string(ws[i : i + 4], ' '))) END AS s FROM w),
same AS (SELECT rid, doc_id, len(s) AS n, md5(array_to_string(list_sort(s), chr(10))) AS set_id, s
         FROM sets),
one AS (SELECT set_id, any_value(n) AS n, any_value(s) AS s FROM same WHERE n > 0 GROUP BY set_id),
tokens AS (SELECT set_id, n, unnest(s) AS t FROM one),
common AS (
  SELECT a.set_id AS u, b.set_id AS v, a.n AS n_u, b.n AS n_v, count(*) AS c
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.set_id < b.set_id
   AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY ALL),
links AS (SELECT u, v FROM common WHERE 100 * c >= 80 * (n_u + n_v - c)),
ways AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
reach AS (
  SELECT set_id AS start, set_id AS spot FROM one
  UNION SELECT start, v FROM reach JOIN ways ON spot = u),
least_id AS (
  SELECT start AS set_id, min(doc_id) AS component_id
  FROM reach JOIN same ON same.set_id = spot AND n > 0 GROUP BY start)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles,
       CASE WHEN n = 0 THEN doc_id ELSE component_id END AS component_id
FROM same LEFT JOIN least_id USING (set_id)
"""

MIX_SOURCES = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, text,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
drawn AS (
  SELECT doc_id, source, size,
    1 - pow((CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12)
             AS BIGINT) + 0.5) / pow(2.0, 48),
        1 / coalesce(1 / (1 + 7 * least(1.0, CAST(length(regexp_replace(text, '[^#*$%&|<>!]', '', 'g'))
            AS DOUBLE) / greatest(size, 1))), 1.0)) AS key
  FROM sized),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight
  FROM drawn GROUP BY source),
filling AS (
  SELECT 0 AS round, source, source_size, weight, false AS capped FROM sources
  UNION ALL
  SELECT round + 1, source, source_size, weight,
    capped OR 2.0 * source_size <= weight
      * (1.5 * sum(source_size) OVER () - coalesce(sum(CASE WHEN capped THEN 2.0 * source_size END) OVER (), 0))
      / nullif(sum(CASE WHEN capped THEN 0 ELSE weight END) OVER (), 0)
  FROM filling WHERE round < 60),
goal AS (
  SELECT source, source_size, CAST(CASE WHEN capped THEN 2.0 * source_size ELSE weight
      * (1.5 * sum(source_size) OVER () - coalesce(sum(CASE WHEN capped THEN 2.0 * source_size END) OVER (), 0))
      / sum(CASE WHEN capped THEN 0 ELSE weight END) OVER () END AS DOUBLE) AS target
  FROM filling WHERE round = 60),
line AS (
  SELECT doc_id, size, source_size, target,
    CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
    sum(size) OVER (PARTITION BY drawn.source ORDER BY key, doc_id, size
                    ROWS UNBOUNDED PRECEDING) AS upto
  FROM drawn JOIN goal ON drawn.source IS NOT DISTINCT FROM goal.source)
SELECT doc_id, size, source_size, target, CAST(size * e AS BIGINT) AS taken, CAST(e AS INTEGER) AS epochs
FROM (SELECT *, whole + CASE WHEN upto - size / 2.0 <= target - whole * source_size
                        THEN 1 ELSE 0 END AS e FROM line)
"""

_NEAREST = r"""
near{n} AS (
  SELECT rid, p, e, d FROM (
    SELECT rid, c.p, e, CAST(sum((c.v - b.v) * (c.v - b.v)) AS BIGINT) AS d
    FROM cells c JOIN book{n} b ON c.p = b.p AND c.j = b.j GROUP BY rid, c.p, e)
  QUALIFY row_number() OVER (PARTITION BY rid, p ORDER BY d, e) = 1)"""

_MOVED = r"""
book{m} AS (
  SELECT b.p, b.e, b.j, coalesce(g.v, b.v) AS v
  FROM book{n} b LEFT JOIN (
    SELECT c.p, e, c.j, CAST(floor(sum(c.v) / count(*)) AS BIGINT) AS v
    FROM near{n} a JOIN cells c ON a.rid = c.rid AND a.p = c.p GROUP BY c.p, e, c.j) g
  ON b.p = g.p AND b.e = g.e AND b.j = g.j)"""

VECTOR_CODES = ",".join([r"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, embedding
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
cells AS (
  SELECT rid, (i - 1) // (n // 16) AS p, (i - 1) % (n // 16) AS j,
         CAST(floor(256 * embedding[i]) AS BIGINT) AS v
  FROM (SELECT rid, embedding, len(embedding) AS n, unnest(generate_series(1, len(embedding))) AS i
        FROM kept)),
book0 AS (SELECT p, rid - 1 AS e, j, v FROM cells WHERE rid <= 64)""",
    _NEAREST.format(n=0), _MOVED.format(n=0, m=1), _NEAREST.format(n=1), _MOVED.format(n=1, m=2),
    _NEAREST.format(n=2), r"""
books AS (
  SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, e, j)) AS codebooks_sha256 FROM book2),
coded AS (
  SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM near2 GROUP BY rid)
SELECT vec_id, code, error,
       CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN kept USING (rid), books
"""])

PREFIX_TRIE = r"""
WITH RECURSIVE bytes AS (
  SELECT CAST(i AS UBIGINT) AS i, 0 AS k, CAST(i AS UBIGINT) AS v FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN v % 2 = 1 THEN xor(v >> 1, CAST(3988292384 AS UBIGINT)) ELSE v >> 1 END
  FROM bytes WHERE k < 8),
crc AS (
  SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS pos, CAST(4294967295 AS UBIGINT) AS v
  FROM (SELECT DISTINCT conv_id FROM conversations WHERE conv_id IS NOT NULL)
  UNION ALL
  SELECT conv_id, s, pos + 1, xor(crc.v >> 8, bytes.v)
  FROM crc JOIN bytes ON k = 8 AND i = xor(crc.v, CAST(ord(s[pos + 1]) AS UBIGINT)) % 256
  WHERE pos < length(s)),
taken AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         CAST(xor(v, CAST(4294967295 AS UBIGINT)) % 4 AS INTEGER) AS h
  FROM crc WHERE pos = length(s)),
turns AS (
  SELECT conv_id, md5(coalesce(role, '')) || md5(coalesce(text, '')) AS t,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS w,
         row_number() OVER (PARTITION BY conv_id
                            ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS rn
  FROM conversations WHERE conv_id IS NOT NULL),
merged AS (
  SELECT k.conv_id, 0 AS own, rn, t, w FROM taken k JOIN turns b ON b.conv_id = base AND rn <= h
  UNION ALL
  SELECT k.conv_id, 1, rn, t, w FROM taken k JOIN turns o ON o.conv_id = k.conv_id AND rn > h),
whole AS (
  SELECT k.conv_id, coalesce(l, []) AS l, coalesce(w, []) AS w
  FROM taken k LEFT JOIN (
    SELECT conv_id, list(t ORDER BY own, rn) AS l, list(w ORDER BY own, rn) AS w
    FROM merged GROUP BY conv_id) m ON m.conv_id = k.conv_id),
nodes AS (
  SELECT key, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(p) AS p,
         any_value(word) AS words,
         string_agg(CASE WHEN ends THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ending
  FROM (SELECT conv_id, depth, l[1:depth] AS p, array_to_string(l[1:depth], ',') AS key,
               CASE WHEN depth = 0 THEN 0 ELSE w[depth] END AS word, depth = len(l) AS ends
        FROM (SELECT conv_id, l, w, unnest(generate_series(0, len(l))) AS depth FROM whole))
  GROUP BY key, depth),
linked AS (
  SELECT *, CASE WHEN depth > 0 THEN array_to_string(p[1:depth - 1], ',') END AS above FROM nodes),
children AS (SELECT above AS key, count(*) AS n FROM linked WHERE depth > 0 GROUP BY above),
figures AS (
  SELECT l.*, coalesce(c.n, 0) AS n_children, (l.n_convs - 1) * words AS saves
  FROM linked l LEFT JOIN children c ON c.key = l.key),
subtrees AS (
  SELECT key, count(*) FILTER (n_children = 0) AS n_leaves, sum(saves) AS saved_tokens
  FROM (SELECT array_to_string(p[1:e], ',') AS key, n_children, saves
        FROM (SELECT p, n_children, saves, unnest(generate_series(0, depth)) AS e FROM figures))
  GROUP BY key)
SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id,
       CAST(f.n_convs AS BIGINT) AS n_convs, CAST(f.n_children AS BIGINT) AS n_children,
       CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens,
       sha256(coalesce(f.ending, '')) AS ends_sha256
FROM figures f JOIN subtrees s ON s.key = f.key LEFT JOIN nodes u ON f.depth > 0 AND u.key = f.above
"""
