"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

MIXING = rf"""
WITH d AS (
  SELECT doc_id, source, len({WORDS}) AS size,
         -ln((CAST('0x' || substr(md5(concat_ws('|', 'mix', coalesce(CAST(doc_id AS VARCHAR), ''), md5(coalesce(text, '')))), 1, 8) AS BIGINT) + 0.5) / 4294967296.0)
         / greatest(coalesce(length(regexp_replace(text, '[0-9#*$%&|<>@{{}}\[\]\\/=+_~^]', '', 'g')) / CAST(greatest(length(text), 1) AS DOUBLE), 0.0), 0.1) AS key
  FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
ranked AS (
  SELECT source, source_size, source_size * 2 AS cap,
         [5, 2, 1][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS INT) + 1] AS weight
  FROM per),
levels AS (
  SELECT *, (sum(source_size) OVER () * 150 / 100.0
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level
  FROM ranked),
targets AS (
  SELECT source, source_size,
         least(coalesce(max(CASE WHEN level * weight <= cap THEN level END) OVER () * weight, CAST(cap AS DOUBLE)), CAST(cap AS DOUBLE)) AS target
  FROM levels),
goals AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS goal,
         CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS epochs
  FROM targets),
run AS (
  SELECT d.*, g.source_size, g.target, g.epochs, g.goal - g.epochs * g.source_size AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS UNBOUNDED PRECEDING) - size AS before
  FROM d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(epochs * size + greatest(least(rest - before, size), 0) AS BIGINT) AS taken
FROM run
"""

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
windows AS (
  SELECT rid, p, list_aggregate(ws[p:p + 4], 'string_agg', ' ') AS w FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS p FROM d)),
twins AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, w) AS n FROM windows) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i) AS n FROM (SELECT rid, unnest(range(p, p + 5)) AS i FROM twins) GROUP BY rid),
rows_ AS (SELECT rid, l FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
twice AS (SELECT rid, count(*) - count(DISTINCT l) AS n FROM rows_ GROUP BY rid),
base AS (
  SELECT d.doc_id, d.source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(twice.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words
  FROM d LEFT JOIN covered USING (rid) LEFT JOIN twice USING (rid)),
failed AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM base),
hosts AS (SELECT source, count(*) AS n, CAST(sum(CAST(base_failed AS INT)) AS BIGINT) AS f FROM failed WHERE source IS NOT NULL GROUP BY source),
totals AS (SELECT sum(f) AS f, sum(n) AS n, count(*) AS k, sum(n * n) AS nn, sum(f * f / CAST(n AS DOUBLE)) AS ff FROM hosts),
means AS (SELECT *, f / CAST(n AS DOUBLE) AS m, f / CAST(n AS DOUBLE) * (1 - f / CAST(n AS DOUBLE)) AS spread, n - nn / CAST(n AS DOUBLE) AS effective FROM totals),
varied AS (SELECT *, CASE WHEN effective > 0 AND spread > 0 THEN (ff - n * m * m - (k - 1) * spread) / effective ELSE 0 END AS between_ FROM means),
prior AS (SELECT m, CASE WHEN between_ > 0 THEN least(greatest(spread / between_ - 1, 1.0), 1e6) ELSE 1e6 END AS strength FROM varied)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce((h.f + m * strength) / (h.n + strength) <= 0.5, true) AS kept
FROM failed LEFT JOIN hosts h USING (source) CROSS JOIN prior
"""

SUBSTRINGS = rf"""
WITH d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
windows AS (SELECT doc_id, p, list_aggregate(ws[p:p + 12], 'string_agg', ' ') AS w FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS p FROM d)),
least_ AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY w) AS first FROM windows),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS i FROM least_ WHERE first < doc_id),
lost AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id),
kept AS (
  SELECT d.doc_id, len(ws) AS n, coalesce(len(gone), 0) AS removed,
         CASE WHEN gone IS NULL THEN ws ELSE list_transform(list_filter(range(1, len(ws) + 1), lambda i: NOT list_contains(gone, i)), lambda i: ws[i]) END AS left_
  FROM d LEFT JOIN lost USING (doc_id))
SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(removed AS BIGINT) AS n_removed, sha256(array_to_string(left_, ' ')) AS kept_sha256
FROM kept
"""

LINKS = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (
  SELECT DISTINCT doc_id, list_aggregate(CASE WHEN len(ws) < 5 THEN ws ELSE ws[p:p + 4] END, 'string_agg', ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS p FROM d WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * pairs.n >= 75 * (x.n + y.n - pairs.n)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(doc_id, label) AS (
  SELECT doc_id, doc_id FROM d
  UNION
  SELECT e.b, r.label FROM reach r JOIN edges e ON e.a = r.doc_id WHERE r.label < e.b)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, min(label) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) JOIN reach USING (doc_id) GROUP BY d.doc_id, n
"""

LEXICAL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM documents),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
totals AS (SELECT count(*) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_all FROM d WHERE len(ws) > 0),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY rid, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf CROSS JOIN totals GROUP BY term, n_docs),
m AS (SELECT rid, doc_id, CAST(10 + (90 * len(ws) * n_docs) // n_all AS BIGINT) AS m FROM d CROSS JOIN totals WHERE len(ws) > 0),
score AS (
  SELECT item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (rid) GROUP BY item_id, rid, doc_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM score WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""

TRIE = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, list({'r': role, 't': text} ORDER BY turn ASC NULLS FIRST, md5(concat(length(role), ':', role, text))) AS s
  FROM t GROUP BY conv_id),
steps AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)) AS tab),
k AS (
  SELECT conv_id, s,
         xor(list_reduce(list_concat([4294967295], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
                         lambda a, b: xor(a // 256, tab[1 + xor(a % 256, b)])), 4294967295) % 9 AS h
  FROM c CROSS JOIN steps),
rebuilt AS (
  SELECT k.conv_id, list_concat(coalesce(d.s[1:h], []), k.s[h + 1:]) AS s
  FROM k LEFT JOIN c d ON d.conv_id = k.conv_id - k.conv_id % 5),
nodes AS (
  SELECT d, p, min(conv_id) AS conv_id, count(*) AS n, string_agg(CASE WHEN len(s) = d THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id) AS ends
  FROM (SELECT conv_id, s, d, s[1:d] AS p FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM rebuilt)) GROUP BY d, p),
children AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
v AS (SELECT nodes.*, coalesce(n_children, 0) AS n_children FROM nodes LEFT JOIN children USING (d, p)),
below AS (
  SELECT a AS d, p[1:a] AS p, CAST(sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves,
         CAST(sum(CASE WHEN d > 0 THEN (n - 1) * strlen(p[d].t) ELSE 0 END) AS BIGINT) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM v) GROUP BY ALL)
SELECT v.conv_id, v.d AS depth, up.conv_id AS parent_conv_id, v.n AS n_convs, CAST(v.n_children AS BIGINT) AS n_children,
       n_leaves, saved_tokens, sha256(coalesce(v.ends, '')) AS ends_sha256
FROM v JOIN below USING (d, p) LEFT JOIN v up ON up.d = v.d - 1 AND up.p = v.p[1:v.d - 1] AND v.d > 0
"""

STATEMENTS = {
    "op1_ngram_jaccard_join": LINKS,
    "op3_source_mixing": MIXING,
    "op9_quality_rules": QUALITY,
    "op10_substring_dedup": SUBSTRINGS,
    "op12_lexical_search": LEXICAL,
    "op13_prefix_trie": TRIE,
}
