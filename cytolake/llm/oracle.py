"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

SPACE = r"[\x20\x09-\x0D]+"

OP8 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, string_split(t, chr(10)) AS ls FROM d),
win AS (SELECT doc_id, i, list_aggregate(ws[i:i + 7], 'string_agg', ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 7)) AS i FROM w WHERE len(ws) >= 9)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(generate_series(0, 7)) AS k) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(ls) AS line FROM w),
lf AS (SELECT doc_id, line, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS n,
         length(line) - length(replace(line, '!', '')) AS ex, length(line) - length(replace(line, '|', '')) AS bars,
         length(line) - length(translate(line, '#*$%&|<>', '')) AS sy, right(rtrim(line, ' '), 1) AS last, lower(line) AS low FROM ln),
bad AS (SELECT doc_id, count(*) AS lines, sum(length(line)) AS chars FROM lf WHERE n > 0 AND (
          (n < 4 AND last NOT IN ('.', '!', '?', ':', ';', '…', '"', '''', ')', '”', '»', ']'))
          OR (n >= 4 AND ex * 2 >= n) OR (bars >= 2 AND bars * 4 >= n) OR (n >= 4 AND sy * 2 >= n)
          OR regexp_matches(low, 'lorem ipsum|enable javascript|cookie policy|privacy policy|terms of use|terms of service|all rights reserved|click here|sign in to|subscribe to our'))
        GROUP BY doc_id),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lf WHERE n > 0 GROUP BY doc_id),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(bad.lines, 0) AS BIGINT) AS n_lines_removed,
        CAST(coalesce(bad.chars, 0) AS BIGINT) AS chars_removed, length(t) AS n
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN bad USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (chars_removed * 100 > n * 50) AS kept, n_lines_removed, chars_removed
FROM m
"""

OP2 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, t, unnest(string_split(regexp_replace(t, '([.!?]) ', '\1' || chr(1) || chr(10), 'g'), chr(10))) AS s, generate_subscripts(string_split(regexp_replace(t, '([.!?]) ', '\1' || chr(1) || chr(10), 'g'), chr(10)), 1) AS i FROM d),
s AS (SELECT doc_id, t, i, replace(s, chr(1), '') AS s, right(s, 1) <> chr(1) AS line_end,
        list_filter(regexp_split_to_array(translate(replace(s, chr(1), ''), '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~', ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM l),
o AS (SELECT *, sum(length(s) + 1) OVER (PARTITION BY doc_id ORDER BY i) - length(s) - 1 AS start,
        coalesce(sum(CASE WHEN line_end OR len(ws) >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM s),
u AS (SELECT doc_id, g, min(start) AS a, max(start + length(s)) AS b, translate(list_aggregate(flatten(list(ws ORDER BY i)), 'string_agg', ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm,
        len(flatten(list(ws))) AS n FROM o GROUP BY doc_id, g HAVING len(flatten(list(ws))) > 0),
k AS (SELECT *, row_number() OVER (PARTITION BY norm ORDER BY doc_id, g) > 1 AND n >= 5 AS gone FROM u),
r AS (SELECT doc_id, count(*) AS n_units, count(*) FILTER (WHERE gone) AS n_removed, string_agg(a || ':' || b, ',' ORDER BY a) FILTER (WHERE gone) AS removed FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_units, 0) AS BIGINT) AS n_units, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(removed, '') AS removed FROM d LEFT JOIN r USING (doc_id)
"""

OP3 = r"""
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) AS r(rh, rp, v)),
fit AS (SELECT page_id, rh || rp AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC) AS k
        FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT p.page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN fit ON fit.page_id = p.page_id AND k = 1
"""

ORACLE: dict[str, str] = {"op2_line_hashing": OP2, "op3_bloom_cascade": OP3, "op8_quality_rules": OP8}
