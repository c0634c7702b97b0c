"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_MEASURES = r"""
d AS (SELECT doc_id, source AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, host, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
win AS (SELECT doc_id, i, list_slice(ws, i, i + 7) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, sum(least(8, i - p)) AS n FROM (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -8) AS p FROM rep) GROUP BY doc_id),
m AS (SELECT w.doc_id, host, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
      FROM w LEFT JOIN cov ON w.doc_id = cov.doc_id),
f AS (SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed, n_symbols * 10 > word_chars AS s_failed, n_dup_lines * 10 > n_words AS l_failed FROM m),
h AS (SELECT host, r, count(*) AS n, sum(CASE WHEN bad THEN 1 ELSE 0 END) AS k
      FROM (SELECT host, 'base' AS r, base_failed AS bad FROM f UNION ALL SELECT host, 'symbols', s_failed FROM f UNION ALL SELECT host, 'lines', l_failed FROM f) GROUP BY host, r),
p AS (SELECT r, sum(n) AS docs, sum(CAST(n AS DOUBLE) * n) AS docs2, count(*) AS hosts, sum(k) AS s, sum(CAST(k AS DOUBLE) * k / n) AS q,
             (sum(k) + 0.5::DOUBLE) / (sum(n) + 1) AS mean FROM h GROUP BY r),
p2 AS (SELECT r, mean, greatest(coalesce((q - CAST(s AS DOUBLE) * s / docs - (hosts - 1) * mean * (1 - mean)) / nullif(docs - docs2 / docs, 0), 0), mean * (1 - mean) / 1000) AS between_hosts FROM p),
z AS (SELECT h.host, h.r, mean, between_hosts, (k + mean * greatest(mean * (1 - mean) / between_hosts - 1, 1)) / (n + greatest(mean * (1 - mean) / between_hosts - 1, 1)) AS shrunk FROM h JOIN p2 ON h.r = p2.r),
v AS (SELECT host, bool_or(shrunk > 0.5) AS rejected, coalesce(bool_or(shrunk > mean + sqrt(between_hosts)) FILTER (r = 'symbols'), false) AS watch_s, coalesce(bool_or(shrunk > mean + sqrt(between_hosts)) FILTER (r = 'lines'), false) AS watch_l FROM z GROUP BY host)
"""

ORACLES = {
    "op9_quality_rules": f"""
WITH {_MEASURES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT rejected AND NOT (watch_s AND s_failed) AND NOT (watch_l AND l_failed) AS kept
FROM f JOIN v ON f.host IS NOT DISTINCT FROM v.host""",
}
