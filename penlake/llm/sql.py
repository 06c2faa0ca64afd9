"""SQL (DuckDB) over whole tables for the queries that SQL can express."""

from __future__ import annotations

CHAT_FORMAT = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), marked AS (
  SELECT *, length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n'))
    + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length('<|im_start|>' || chr(10) || '<|im_end|>' || chr(10)) AS shown
  FROM said
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(shown) AS BIGINT) AS formatted_chars
FROM marked GROUP BY conv_id
"""

QUALITY_RULES = r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text FROM documents
), cut AS (
  SELECT r, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM docs
), places AS (
  SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM cut
), windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM places
), repeated AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM windows WHERE n > 1) GROUP BY r
), measured AS (
  SELECT d.r, d.doc_id, d.source AS host, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words
  FROM docs d JOIN cut USING (r) LEFT JOIN repeated p USING (r)
), judged AS (
  SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repetitive, 10 * n_symbols > 3 * n_words AS symbols,
    20 * n_dup_lines > n_words AS dup_lines, n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words) AS word_length
  FROM measured
), failures AS (
  SELECT host, rule, count(*) AS n, count(*) FILTER (failed) AS failed
  FROM (SELECT host, short, repetitive, symbols, dup_lines, word_length FROM judged WHERE host IS NOT NULL)
  UNPIVOT (failed FOR rule IN (short, repetitive, symbols, dup_lines, word_length)) GROUP BY host, rule
), moments AS (
  SELECT rule, sum(failed) / sum(n) AS m, sum(failed * failed / n) / sum(n) AS square FROM failures GROUP BY rule
), priors AS (
  SELECT rule, m, least(greatest(m * (1 - m) / greatest(square - m * m, 1e-9) - 1, 1.0), 10000.0) AS strength FROM moments
), posteriors AS (
  SELECT host, rule, m, n + strength AS size, (failed + m * strength) / (n + strength) AS rate FROM failures JOIN priors USING (rule)
), deviations AS (
  SELECT *, sqrt(rate * (1 - rate) / (size + 1)) AS sd FROM posteriors
), verdicts AS (
  SELECT host, bool_or(rate - 3 * sd > greatest(3.0 * m, 0.3)) AS refused, list(rule) FILTER (rate - 1.0 * sd > m) AS strict FROM deviations GROUP BY host
), results AS (
  SELECT j.*, j.short OR j.repetitive AS base_failed, coalesce(v.refused, false) AS host_refused,
    coalesce(short AND list_contains(strict, 'short') OR repetitive AND list_contains(strict, 'repetitive') OR symbols AND list_contains(strict, 'symbols')
      OR dup_lines AND list_contains(strict, 'dup_lines') OR word_length AND list_contains(strict, 'word_length'), false) AS host_failed
  FROM judged j LEFT JOIN verdicts v ON j.host = v.host
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_refused, host_failed,
  NOT (base_failed OR host_refused OR host_failed) AS kept
FROM results
"""

JACCARD_JOIN = r"""
WITH RECURSIVE cut AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), places AS (
  SELECT r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM cut WHERE len(w) > 0
), shingles AS (
  SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS g FROM places
), sets AS (
  SELECT r, md5(string_agg(g, chr(10) ORDER BY g)) AS key, count(*) AS n FROM shingles GROUP BY r
), nodes AS (
  SELECT key, min(r) AS node, any_value(n) AS n, min(doc_id) AS first, count(*) AS copies FROM sets JOIN cut USING (r) GROUP BY key
), own AS (
  SELECT node, g FROM nodes JOIN shingles ON r = node
), pairs AS (
  SELECT x.node AS a, y.node AS b, count(*) AS shared FROM own x JOIN own y ON x.g = y.g AND x.node < y.node GROUP BY x.node, y.node
), links AS (
  SELECT a, b FROM pairs JOIN nodes x ON x.node = a JOIN nodes y ON y.node = b WHERE 9 * shared >= 4 * (x.n + y.n)
), ways AS (
  SELECT a, b FROM links UNION ALL SELECT b, a FROM links
), reached AS (
  SELECT node, node AS root FROM nodes UNION SELECT ways.b, root FROM reached JOIN ways ON ways.a = reached.node
), classes AS (
  SELECT reached.node, min(nodes.first) AS class_id FROM reached JOIN nodes ON nodes.node = reached.root GROUP BY reached.node
), counted AS (
  SELECT a AS node, sum(copies) AS others FROM ways JOIN nodes ON nodes.node = b GROUP BY a
)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id, CAST(coalesce(coalesce(others, 0) + copies - 1, 0) AS BIGINT) AS n_links, coalesce(copies, 1) AS n_copies
FROM cut LEFT JOIN sets USING (r) LEFT JOIN nodes USING (key) LEFT JOIN classes USING (node) LEFT JOIN counted USING (node)
"""

SUBSTRING_DEDUP = r"""
WITH cut AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), places AS (
  SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM cut
), windows AS (
  SELECT doc_id, i, w[i] AS word, CASE WHEN i + 19 <= len(w) THEN array_to_string(w[i:i + 19], ' ') END AS seq FROM places
), first AS (
  SELECT doc_id, i, word, seq IS NOT NULL AND row_number() OVER (PARTITION BY seq ORDER BY doc_id, i) > 1 AS again FROM windows
), covered AS (
  SELECT doc_id, i, word, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM first
), kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS rest FROM covered GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256
FROM cut LEFT JOIN kept USING (doc_id)
"""

WARC = r"""
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS sha FROM pages
), bits AS (
  SELECT *, CAST(CAST(unhex(sha) AS BIT) AS VARCHAR) AS b, min(page_id) OVER (PARTITION BY sha) AS first_id FROM payloads
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1
    + 16 * CAST(b[5 * i + 1] AS INT) + 8 * CAST(b[5 * i + 2] AS INT) + 4 * CAST(b[5 * i + 3] AS INT)
    + 2 * CAST(b[5 * i + 4] AS INT) + CAST(b[5 * i + 5] AS INT) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM bits
"""

SPELLING = r"""
WITH RECURSIVE said AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run
  FROM documents
), runs AS (
  SELECT doc_id, run, count(*) AS n FROM said WHERE length(run) >= 7 GROUP BY doc_id, run
), bytes AS (
  SELECT run, n, flatten(list_transform(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda c: unicode(c)),
    lambda u: CASE WHEN u < 128 THEN [u, 0, 0, 0, 0, 0, 0, 0] ELSE [195, 0, 0, 0, 0, 0, 0, 0, u - 64, 0, 0, 0, 0, 0, 0, 0] END)) AS bits FROM runs
), hashed AS (
  SELECT run, n, xor(list_reduce(list_transform(bits, lambda x: CAST(x AS BIGINT)), lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1)), CAST(4294967295 AS BIGINT)), 4294967295) AS h
  FROM bytes
), changed AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM changed WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), cut AS (
  SELECT word, n, substr(word, 1, i) AS a, substr(word, i + 2) AS b FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)
), shorter AS (
  SELECT DISTINCT c.word AS long, c.n AS long_n, w.word AS short, w.n AS short_n FROM cut c JOIN words w ON w.word = c.a || c.b
), near AS (
  SELECT x.word, y.word AS other, y.n AS other_n FROM cut x JOIN cut y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION ALL SELECT long, short, short_n FROM shorter UNION ALL SELECT short, long, long_n FROM shorter
), best AS (
  SELECT word, count(*) AS n_near, first(other ORDER BY other_n DESC, other) AS other, max(other_n) AS other_n FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * w.n THEN other END AS form, CASE WHEN other_n >= 10 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), steps AS (
  SELECT word, word AS here, form AS ahead FROM forms
  UNION ALL SELECT s.word, f.word, f.form FROM steps s JOIN forms f ON s.ahead = f.word
)
SELECT f.word, f.form, s.here AS root, f.n, f.n_near, f.form_n FROM forms f JOIN steps s ON s.word = f.word AND s.ahead IS NULL
"""

# Equal 8-word phrases of one document stand q words apart; where they do so for places in a row, that is a stretch with
# period q, as long as it gets. A run has at least 16 such words, so it's found; the smallest of its periods counts.
PERIODIC_RUNS = r"""
WITH cut AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), hashed AS (
  SELECT *, len(w) AS n, xor(list_reduce(flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(unicode(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0])),
    lambda c, x: xor(xor(c, x) >> 1, 3988292384 * (xor(c, x) & 1)), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM cut
), tails AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a FROM hashed
), spots AS (
  SELECT r, i, w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + (h // 10) % 8)) END + 1] AS word FROM (SELECT *, unnest(range(n)) AS i FROM tails)
), texts AS (
  SELECT r, list(word ORDER BY i) AS w, count(*) AS n FROM spots GROUP BY r
), phrases AS (
  SELECT r, n, i, array_to_string(w[i + 1:i + 8], ' ') AS phrase FROM (SELECT r, n, w, unnest(range(n - 7)) AS i FROM texts WHERE n >= 24)
), apart AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM phrases x JOIN phrases y ON x.r = y.r AND x.phrase = y.phrase AND y.i > x.i AND 3 * (y.i - x.i) <= x.n
), stretches AS (
  SELECT r, q, min(i) AS first, count(*) + 7 + q AS size FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM apart) GROUP BY r, q, island
), runs AS (
  SELECT r, first, size, min(q) AS q FROM stretches WHERE size >= greatest(24, 3 * q) GROUP BY r, first, size
), best AS (
  SELECT r, count(*) AS n_runs, first(struct_pack(s := first, l := size, q := q) ORDER BY CAST(size AS DOUBLE) / q DESC, first, q) AS top,
    string_agg(first || ',' || size || ',' || q || chr(10), '' ORDER BY first, q) AS lines FROM runs GROUP BY r
), marks AS (
  SELECT r, i, sum(d) AS d FROM (SELECT r, first + q AS i, 1 AS d FROM runs UNION ALL SELECT r, first + size, -1 FROM runs) GROUP BY r, i
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS rest
  FROM (SELECT s.r, s.i, word, sum(coalesce(d, 0)) OVER (PARTITION BY s.r ORDER BY s.i) AS inside FROM spots s LEFT JOIN marks m ON m.r = s.r AND m.i = s.i) WHERE inside = 0 GROUP BY r
)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(top.s AS BIGINT) AS "start", CAST(top.l AS BIGINT) AS "length", CAST(top.q AS BIGINT) AS "period",
  CAST(1000 * top.l // top.q AS BIGINT) AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(rest, '')) AS collapsed_sha256
FROM cut LEFT JOIN best USING (r) LEFT JOIN kept USING (r)
"""

EXACT_DEDUP = r"""
WITH normal AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM normal
"""
