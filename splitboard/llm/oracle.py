"""DuckDB SQL for the queries that SQL can express."""

OP2 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

OP5 = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS h
  FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight, 3 * source_size AS stop FROM sizes
), leveled AS (
  SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) - CAST(coalesce(sum(stop) OVER b, 0) AS DOUBLE))
            / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS DOUBLE) AS level
  FROM ranked
  WINDOW b AS (ORDER BY CAST(stop AS DOUBLE) / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goals AS (
  SELECT source, source_size, least(CAST(stop AS DOUBLE), weight * max(level) OVER ()) AS target FROM leveled
), based AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS base FROM goals
), run AS (
  SELECT d.*, g.source_size, g.target, g.base, g.target - g.base * g.source_size AS budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS after,
         sum(size) OVER (PARTITION BY d.source, h) AS held
  FROM sized d JOIN based g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * least(base + CASE WHEN 2 * (after - held) + held <= 2 * budget THEN 1 ELSE 0 END, 3) AS BIGINT) AS taken
FROM run
"""

OP10 = """
WITH said AS (
  SELECT conv_id, turn, role, regexp_replace(coalesce(text, ''), '<(\\\\*)\\|', '<\\\\\\1|', 'g') AS text,
         regexp_replace(regexp_replace(role, '<(\\\\*)\\|', '<\\\\\\1|', 'g'), '[\\r\\n]', ' ', 'g') AS name
  FROM conversations
), people AS (
  SELECT DISTINCT conv_id, role AS perspective FROM said WHERE role IS DISTINCT FROM 'system'
), rendered AS (
  SELECT s.*, p.perspective,
         CASE WHEN role IS NOT DISTINCT FROM perspective THEN '<|assistant|>' WHEN role IS NULL THEN '<|user|>'
              WHEN role = 'system' THEN '<|system|>' ELSE '<|user name=' || name || '|>' END
         || chr(10) || text || '<|end|>' || chr(10) AS rendered
  FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
), placed AS (
  SELECT *, row_number() OVER w - 1 AS position,
         CAST(sum(length(rendered)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS stop
  FROM rendered WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role NULLS FIRST, text)
)
SELECT conv_id, perspective, position, turn, role, rendered, stop - length(rendered) AS start, stop,
       CASE WHEN role IS NOT DISTINCT FROM perspective THEN stop - length(text) - 8 END AS mask_start,
       CASE WHEN role IS NOT DISTINCT FROM perspective THEN stop END AS mask_stop
FROM placed
"""

OP11 = r"""
WITH docs AS (
  SELECT row_number() OVER () AS d, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), tokens AS (
  SELECT d, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs
), kept AS (
  SELECT lang, term FROM tokens GROUP BY ALL HAVING count(DISTINCT d) >= 3
), sizes AS (
  SELECT lang, count(*) AS v FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM docs
), counts AS (
  SELECT lang, source, term, count(*) AS c FROM tokens JOIN kept USING (lang, term) GROUP BY ALL
), cells AS (
  SELECT g.lang, g.source, k.term, coalesce(c, 0) AS c, sum(coalesce(c, 0)) OVER (PARTITION BY g.lang, g.source) AS n, v,
         sum(coalesce(c, 0)) OVER (PARTITION BY g.lang, k.term) AS c_lang, sum(coalesce(c, 0)) OVER (PARTITION BY g.lang) AS n_lang
  FROM groups g JOIN kept k USING (lang) JOIN sizes USING (lang) LEFT JOIN counts USING (lang, source, term)
), shares AS (
  SELECT lang, source, term, c, 1 + CAST(1000000000 AS HUGEINT) * (c + 1) // (n + v) AS p, 1 + CAST(1000000000 AS HUGEINT) * (c_lang + 1) // (n_lang + v) AS q FROM cells
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM shares WHERE c > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM every QUALIFY part = 'pair' OR rank <= 200
"""

OP13 = r"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), marks AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id
), flags AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         MAP {'A': len(words) < 200, 'B': 100 * len(list_distinct(words)) < 50 * len(words), 'C': 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text),
              'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)} AS fails
  FROM docs LEFT JOIN marks USING (doc_id)
), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5
), replayed AS (
  SELECT part, good, toxic, fails, filter_order,
         coalesce(list_position([fails[filter_order[i]] FOR i IN [1, 2, 3, 4, 5]], true), 6) AS first,
         len([i FOR i IN ['A', 'B', 'C', 'D', 'E'] IF fails[i]]) AS n_fails
  FROM flags, orders
), counted AS (
  SELECT part, filter_order, step, filter_order[step] AS letter, count(*) FILTER (first > step) AS kept, count(*) FILTER (first = step) AS removed,
         count(*) FILTER (first < step AND fails[filter_order[step]]) AS redundant, count(*) FILTER (n_fails = 1 AND fails[filter_order[step]]) AS unique_fails,
         count(*) FILTER (first = step AND good) AS good_lost, count(*) FILTER (first = step AND toxic) AS toxic_lost
  FROM replayed, (SELECT unnest([1, 2, 3, 4, 5]) AS step) GROUP BY ALL
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM counted
"""

ORACLES = {"op10_chat": OP10, "op11_divergence": OP11, "op13_filter_audit": OP13, "op2_exact_dedup": OP2, "op5_mixing": OP5}
