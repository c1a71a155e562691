"""DuckDB SQL for the queries of this folder that SQL can express, written from their definitions."""

from __future__ import annotations

MIXING = r"""
WITH docs AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT // 16777216 AS cell
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM docs GROUP BY source),
levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
         (1.5::DOUBLE * sum(source_size) OVER ()
          - coalesce(sum(2.0::DOUBLE * source_size) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level
  FROM sources
  WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
targets AS (
  SELECT source, source_size,
         CASE WHEN cap <= weight * level THEN cap ELSE weight * max(CASE WHEN cap > weight * level THEN level END) OVER () END AS target
  FROM levels),
wanted AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM targets),
cells AS (
  SELECT d.source, d.cell, sum(d.size)::BIGINT AS words FROM docs d GROUP BY d.source, d.cell HAVING sum(d.size) > 0),
running AS (
  SELECT *, sum(words) OVER (PARTITION BY source ORDER BY cell)::BIGINT AS through FROM cells),
under AS (
  SELECT w.source, coalesce(min(r.cell), 68719476736) AS cell
  FROM wanted w LEFT JOIN running r
    ON r.source IS NOT DISTINCT FROM w.source AND r.through > w.target - w.whole * w.source_size
   -- the cell in which the budget runs out is taken if that comes nearer
   AND NOT (r.through - words <= w.target - w.whole * w.source_size
            AND r.through - (w.target - w.whole * w.source_size) <= (w.target - w.whole * w.source_size) - (r.through - words))
  GROUP BY w.source)
SELECT d.doc_id, d.size, w.source_size, w.target, d.size * (w.whole + CASE WHEN d.cell < u.cell THEN 1 ELSE 0 END)::BIGINT AS taken
FROM docs d
JOIN wanted w ON w.source IS NOT DISTINCT FROM d.source
JOIN under u ON u.source IS NOT DISTINCT FROM d.source
"""

QUALITY = r"""
WITH docs AS (
  SELECT doc_id, coalesce('=' || lang, '') AS lang, coalesce('=' || source, '') AS source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
windows AS (
  SELECT doc_id, k AS start, array_to_string(words[k:k + 7], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS k FROM docs WHERE len(words) >= 8)),
twice AS (
  SELECT doc_id, start FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT word)::BIGINT AS n
  FROM (SELECT doc_id, unnest(range(start, start + 8)) AS word FROM twice) GROUP BY doc_id),
base AS (
  SELECT d.doc_id, d.lang, d.source, len(words)::BIGINT AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
         coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM docs d LEFT JOIN covered c USING (doc_id)),
measured AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, n_symbols / greatest(n_words, 1) AS symbols,
         n_dup_lines / greatest(n_lines, 1) AS repeated, word_chars / greatest(n_words, 1) AS length
  FROM base),
levels AS (
  SELECT grouping(lang, source) AS level, lang, source, count(*) AS n,
         list_sort(list(symbols)) AS s, list_sort(list(repeated)) AS r, list_sort(list(length)) AS l
  FROM measured WHERE NOT base_failed GROUP BY GROUPING SETS ((lang, source), (lang), ())),
fences AS (
  SELECT level, lang, source, n,
         s[ceil(0.5 * n)::INT] + 3.0 * greatest(s[ceil(0.5 * n)::INT] - s[ceil(0.1 * n)::INT], 0.05) AS symbol_most,
         r[ceil(0.5 * n)::INT] + 3.0 * greatest(r[ceil(0.5 * n)::INT] - r[ceil(0.1 * n)::INT], 0.15) AS line_most,
         l[ceil(0.5 * n)::INT] - 3.0 * greatest(l[ceil(0.9 * n)::INT] - l[ceil(0.5 * n)::INT], 0.5) AS length_least,
         l[ceil(0.5 * n)::INT] + 3.0 * greatest(l[ceil(0.5 * n)::INT] - l[ceil(0.1 * n)::INT], 0.5) AS length_most
  FROM levels),
chosen AS (
  SELECT o.lang, o.source, CASE WHEN o.n >= 30 THEN o WHEN g.n >= 30 THEN g ELSE a END AS f
  FROM (FROM fences WHERE level = 0) o JOIN (FROM fences WHERE level = 1) g ON g.lang = o.lang, (FROM fences WHERE level = 3) a)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(symbols <= f.symbol_most AND repeated <= f.line_most AND length BETWEEN f.length_least AND f.length_most, false) AS kept
FROM measured m LEFT JOIN chosen c ON c.lang = m.lang AND c.source = m.source
"""

_URL_HEAD = r"""
WITH parts AS (
  SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
urls AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
rules(rule, verdict, top, start) AS (
  VALUES ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'), ('example.org/en/1', 'block', 'example.org', '/en/1'),
         ('com/fr/', 'allow', 'com', '/fr/'), ('com/de/', 'block', 'com', '/de/')),
fits AS (
  SELECT u.page_id, u.host, u.path, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM urls u LEFT JOIN rules r ON (u.host = r.top OR ends_with(u.host, '.' || r.top)) AND starts_with(u.path, r.start)
  GROUP BY u.page_id, u.host, u.path),
hosts AS (
  SELECT host, count(*) AS pages, count(*) FILTER (verdict = 'allow')::DOUBLE AS t, count(*) FILTER (verdict = 'block')::DOUBLE AS d
  FROM fits WHERE host <> '' GROUP BY host),
links AS (
  SELECT host AS a, unnest(list_distinct(list_transform(regexp_extract_all(regexp_replace(coalesce(html, ''),
           '(?is)<!--.*?-->|<script[\s>].*?</script|<style[\s>].*?</style', ' ', 'g'),
           '(?i)<a\s[^>]*?href\s*=\s*["'']?\s*(?:[a-z][a-z0-9+.\-]*:)?//([^/?#"''\s<>]+)', 1),
           lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')))) AS b
  FROM urls),
nearest AS (
  SELECT h.host, arg_max(o.host, length(o.host)) AS top, any_value(h.pages) AS weight
  FROM hosts h JOIN hosts o ON ends_with(h.host, '.' || o.host) GROUP BY h.host),
edges AS MATERIALIZED (
  SELECT a, b, sum(weight) AS weight
  FROM (SELECT a, b, count(*) AS weight FROM links WHERE a <> b AND a <> '' AND b <> '' GROUP BY a, b
        UNION ALL SELECT host, top, weight FROM nearest UNION ALL SELECT top, host, weight FROM nearest)
  GROUP BY a, b),
shares AS MATERIALIZED (
  SELECT a, b, weight / sum(weight) OVER (PARTITION BY a) AS forward, weight / sum(weight) OVER (PARTITION BY b) AS back FROM edges),
r0 AS MATERIALIZED (
  SELECT host, sum(t) AS t, sum(d) AS d
  FROM (SELECT host, t, d FROM hosts UNION ALL SELECT a, 0, 0 FROM edges UNION ALL SELECT b, 0, 0 FROM edges) GROUP BY host)"""
_URL_ROUND = """,
r{k} AS MATERIALIZED (
  SELECT s.host, 0.15::DOUBLE * s.t + 0.85::DOUBLE * coalesce(f.t, 0) AS t, 0.15::DOUBLE * s.d + 0.85::DOUBLE * coalesce(g.d, 0) AS d
  FROM r0 s LEFT JOIN (SELECT e.b AS host, sum(p.t * e.forward) AS t FROM r{j} p JOIN shares e ON e.a = p.host GROUP BY e.b) f ON f.host = s.host
       LEFT JOIN (SELECT e.a AS host, sum(p.d * e.back) AS d FROM r{j} p JOIN shares e ON e.b = p.host GROUP BY e.a) g ON g.host = s.host)"""
URL_FILTERS = _URL_HEAD + "".join(_URL_ROUND.format(k=k, j=k - 1) for k in range(1, 21)) + """
SELECT f.page_id, f.host, f.path, f.rule, coalesce(f.verdict, CASE WHEN r.d > 0.500000001 * (r.t + r.d) THEN 'block' ELSE 'allow' END) AS verdict
FROM fits f LEFT JOIN r20 r ON r.host = f.host
"""

PREFIX_TRIE = r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
         -- crc32 of the decimal id, bit by bit
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, 8 * length(conv_id::VARCHAR)),
               lambda i: ((ascii(substr(conv_id::VARCHAR, (i // 8) + 1, 1)) >> (i % 8)::INT) & 1)::BIGINT)),
             lambda a, x: xor(a >> 1, 3988292384 * (xor(a, x) & 1))), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
rows_of AS (
  SELECT c.conv_id, 0 AS part, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.base AND t.place < c.h
  UNION ALL SELECT c.conv_id, 1, t.place, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place >= c.h),
whole AS (
  SELECT c.conv_id, coalesce(list({'r': r.role, 't': r.text} ORDER BY r.part, r.place) FILTER (r.place IS NOT NULL), []) AS seq
  FROM convs c LEFT JOIN rows_of r USING (conv_id) GROUP BY c.conv_id),
steps AS (
  SELECT conv_id, d AS depth, len(seq) AS size, seq[1:d] AS node, CASE WHEN d > 0 THEN length(seq[d].t) ELSE 0 END AS chars
  FROM (SELECT conv_id, seq, unnest(range(0, len(seq) + 1)) AS d FROM whole)),
nodes AS MATERIALIZED (
  SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256
  FROM steps GROUP BY depth, node),
children AS (
  SELECT depth - 1 AS depth, node[1:depth - 1] AS node, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
told AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children, p.conv_id AS parent_conv_id
  FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.node = n.node
       LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.node = n.node[1:n.depth - 1]),
below AS (
  SELECT depth, node, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens
  FROM (SELECT unnest(range(0, depth + 1)) AS depth, node[1:unnest(range(0, depth + 1))] AS node, (n_children = 0)::INT AS leaf, (n_convs - 1) * chars AS saved FROM told)
  GROUP BY depth, node)
SELECT t.conv_id, t.depth, t.parent_conv_id, t.n_convs, t.n_children, b.n_leaves, b.saved_tokens, t.ends_sha256
FROM told t JOIN below b ON b.depth = t.depth AND b.node = t.node
"""

ORACLES: dict[str, str] = {
    "op4_mixing": MIXING,
    "op7_quality": QUALITY,
    "op11_prefix_trie": PREFIX_TRIE,
    "op13_url_filters": URL_FILTERS,
}
