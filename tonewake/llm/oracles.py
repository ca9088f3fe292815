"""SQL (DuckDB's) for the queries that SQL can express."""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
BLANKED = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP1 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {WORDS.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS.format(LOWER.format("text"))} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
im AS (SELECT item, w, least(8, len(w)) AS m FROM i WHERE len(w) > 0),
iw AS (SELECT DISTINCT item, m, array_to_string(w[k:k + m - 1], ' ') AS win FROM (SELECT item, w, m, unnest(generate_series(1, len(w) - m + 1)) AS k FROM im)),
dw AS (SELECT r, m, k, array_to_string(w[k:k + m - 1], ' ') AS win FROM (SELECT r, w, m, unnest(generate_series(1, len(w) - m + 1)) AS k FROM d, (SELECT DISTINCT m FROM iw) WHERE len(w) >= m)),
found AS (SELECT dw.r, dw.k, dw.m, iw.item FROM dw JOIN iw ON dw.m = iw.m AND dw.win = iw.win),
hits AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(generate_series(k, k + m - 1)) AS p FROM found) GROUP BY 1),
items AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM found GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(hits.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(items.n, 0) >= 2 AS contaminated
FROM d LEFT JOIN hits ON d.r = hits.r LEFT JOIN items ON d.r = items.r"""

OP3 = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, coalesce(text, '') AS t, {BLANKED.format("coalesce(text, '')")} AS w FROM documents),
tri AS (SELECT r, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS g FROM (SELECT r, w, unnest(generate_series(1, len(w) - 2)) AS k FROM d WHERE len(w) >= 3)),
twice AS (SELECT r, k FROM (SELECT *, count(*) OVER (PARTITION BY r, g) AS n FROM tri) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([k, k + 1, k + 2]) AS p FROM twice) GROUP BY 1),
l AS (SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY k) AS nth, len({BLANKED.format("line")}) AS n, regexp_extract_all(line, '\S+') AS ws FROM (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS k FROM d) WHERE len({BLANKED.format("line")}) > 0),
judged AS (SELECT *, regexp_matches(line, '(?i)all rights reserved|terms of (?:use|service)|privacy policy|cookie (?:policy|settings|consent)|enable javascript|lorem ipsum|click here|sign in to|log ?in to|subscribe (?:now|to our)|share (?:on|via) (?:facebook|twitter)|skip to (?:main )?content')
 OR (regexp_matches(line, '[|»›•·>]') AND len(list_filter(ws, lambda x: list_contains(['|', '»', '›', '>', '•', '·', '/', '::'], x))) > 0.1 * len(ws))
 OR (regexp_matches(line, '[#*$%&|<>~^=_]{{2,}}') AND len(list_filter(ws, lambda x: regexp_matches(x, '[#*$%&|<>~^=_]{{2,}}'))) > 0.3 * len(ws))
 OR (contains(line, '!!') AND len(regexp_extract_all(line, '!!')) > 0.3 * len(ws))
 OR (len(ws) < 12 AND NOT regexp_matches(line, '[.!?:;…。！？]["''”’»)\]]*\s*$')) AS failed FROM l),
per AS (SELECT r, count(*) AS n_lines, sum(CASE WHEN nth > 1 THEN 1 ELSE 0 END) AS dup, sum(failed::INT) AS n_failed, sum(CASE WHEN failed THEN 0 ELSE n END) AS words_left FROM judged GROUP BY 1),
b AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines,
 coalesce(rep.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines, CAST(coalesce(n_failed, 0) AS BIGINT) AS n_failed_lines, CAST(coalesce(words_left, 0) AS BIGINT) AS words_left FROM d LEFT JOIN rep ON d.r = rep.r LEFT JOIN per ON d.r = per.r)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND words_left >= 0.5 * n_words AS kept FROM b"""

OP4 = r"""
WITH p AS (SELECT page_id, row_number() OVER () AS r, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)), '') AS host,
 regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', ' ', 'gis'),
 '</?(?:p|div|br|li|ul|ol|h[1-6]|tr|td|th|table|nav|header|footer|article|section|title|head|body|html|main|aside|form|option|pre|blockquote|dl|dt|dd|hr)\b[^>]*>', chr(10), 'gi'), '<[^>]*>', '', 'g') AS t FROM pages),
l AS (SELECT page_id, r, host, list_filter(list_transform(string_split(replace(replace(replace(replace(replace(replace(t, '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13))), lambda x: x <> '') AS ls FROM p),
c AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(ls)) AS line FROM l WHERE host IS NOT NULL) GROUP BY 1, 2),
h AS (SELECT host, count(*) AS pages FROM l WHERE host IS NOT NULL GROUP BY 1 HAVING count(*) >= 10),
s AS (SELECT c.host, list(line) AS common FROM c JOIN h ON c.host = h.host WHERE n > 0.1 * pages GROUP BY 1),
k AS (SELECT page_id, l.host, ls, list_filter(ls, lambda x: NOT list_contains(coalesce(common, []), x)) AS kept FROM l LEFT JOIN s ON l.host = s.host)
SELECT page_id, host, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(kept) AS BIGINT) AS n_dropped, md5(array_to_string(kept, chr(10))) AS kept_md5 FROM k"""

OP7 = f"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, {BLANKED.format(LOWER.format("coalesce(text, '')"))} AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[k:k + 4], ' ') AS g FROM (SELECT r, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.r AS x, b.r AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY 1, 2),
e AS (SELECT x, y, c = nx.n AND c = ny.n AS same FROM shared JOIN n nx ON x = nx.r JOIN n ny ON y = ny.r WHERE 100 * c >= 80 * (nx.n + ny.n - c)),
reach AS (SELECT r, r AS t FROM d UNION SELECT reach.r, e.y FROM reach JOIN e ON reach.t = e.x),
comp AS (SELECT reach.r, min(d.doc_id) AS component_id FROM reach JOIN d ON reach.t = d.r GROUP BY 1),
copy AS (SELECT x, min(d.doc_id) AS least, count(*) AS k FROM e JOIN d ON e.y = d.r WHERE same GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, least(d.doc_id, coalesce(copy.least, d.doc_id)) AS class_id, 1 + coalesce(copy.k, 0) AS n_copies
FROM d LEFT JOIN n ON d.r = n.r JOIN comp ON d.r = comp.r LEFT JOIN copy ON d.r = copy.x"""

ORACLES = {"op1_decontamination": OP1, "op3_quality": OP3, "op4_line_dedup": OP4, "op7_jaccard_join": OP7}
