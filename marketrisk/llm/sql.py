"""DuckDB SQL of the queries that SQL can express."""

WORD, GAP = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"

QUALITY = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT rid, doc_id, source, regexp_extract_all(t, '{WORD}') AS ws,
         length(regexp_replace(t, '{GAP}', '', 'g')) AS word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines
  FROM d
), windows AS (
  SELECT rid, i, array_to_string(ws[i : i + 4], ' ') AS win FROM w, unnest(range(1, len(ws) - 3)) AS u(i)
), again AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS times FROM windows
), repeated AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM again, range(5) AS u(k) WHERE times > 1 GROUP BY rid
), m AS (
  SELECT w.rid, doc_id, source, len(ws) AS n_words, word_chars, n_symbols, len(lines) AS n_lines,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words
  FROM w LEFT JOIN repeated USING (rid)
), judged AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m
), failed AS (
  SELECT *, base_failed OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * n_lines
         OR word_chars < 2 * n_words OR word_chars > 20 * n_words AS rule_failed
  FROM judged
), hosts AS (
  SELECT source AS host, count(*) AS n, sum(rule_failed::INT)::BIGINT AS f FROM failed WHERE source IS NOT NULL GROUP BY 1
), total AS (
  SELECT count(*) AS k, sum(n) AS docs, sum(f) / sum(n) AS p, sum(n * n) / sum(n) AS own, sum(f * f / n) AS squares FROM hosts
), fitted AS (
  SELECT p, CASE WHEN p * (1 - p) * (docs - own - (k - 1)) > 0
                 THEN (squares - docs * p * p - p * (1 - p) * (k - 1)) / (p * (1 - p) * (docs - own - (k - 1))) END AS r
  FROM total
), prior AS (
  SELECT p, CASE WHEN r IS NULL THEN 10 WHEN r <= 1 / (1 + 1e6) THEN 1e6 ELSE (1 - least(r, 0.999)) / least(r, 0.999) END AS weight
  FROM fitted
), bad AS (
  SELECT host FROM hosts, prior WHERE (f + p * weight) / (n + weight) > 0.5
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
       n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND bad.host IS NULL AS kept
FROM failed LEFT JOIN bad ON source = bad.host
"""

NEAR = rf"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws
  FROM documents
), shingles AS (
  SELECT DISTINCT rid, ws[i] || ' ' || ws[i + 1] AS shingle FROM d, unnest(range(1, len(ws))) AS u(i)
  UNION ALL
  SELECT rid, ws[1] FROM d WHERE len(ws) = 1
), sizes AS (
  SELECT rid, count(*) AS n FROM shingles GROUP BY rid
), shared AS (
  SELECT a.rid AS x, b.rid AS y, count(*) AS c
  FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.rid < b.rid GROUP BY 1, 2
), links AS (
  SELECT x, y FROM shared JOIN sizes p ON p.rid = x JOIN sizes q ON q.rid = y WHERE 100 * c >= 80 * (p.n + q.n - c)
), both_ways AS (
  SELECT x, y FROM links UNION ALL SELECT y, x FROM links
), reached AS (
  SELECT rid AS x, rid AS y FROM d
  UNION
  SELECT reached.x, both_ways.y FROM reached JOIN both_ways ON reached.y = both_ways.x
), least_id AS (
  SELECT reached.x AS rid, min(d.doc_id) AS component_id FROM reached JOIN d ON d.rid = reached.y GROUP BY 1
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN sizes USING (rid) JOIN least_id USING (rid)
"""

MIX = rf"""
WITH sized AS (
  SELECT doc_id, source, key, size, count(*) OVER alike AS n, row_number() OVER alike - 1 AS place
  FROM (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(text, '')) AS key,
               len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size
        FROM documents)
  WINDOW alike AS (PARTITION BY key, source, size)
), sources AS (
  SELECT source, sum(size)::BIGINT AS s FROM sized GROUP BY 1
), weighed AS (
  SELECT source, s, 2.0::DOUBLE * s AS cap,
         [3.0::DOUBLE, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w
  FROM sources
), stopping AS (
  SELECT *, 1.5::DOUBLE * sum(s) OVER () AS total,
         coalesce(sum(cap) OVER before, 0) AS used, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS left_over
  FROM weighed
  WINDOW before AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT (total - used) / left_over AS l FROM stopping WHERE (total - used) / left_over * w <= cap
  ORDER BY cap / w, source NULLS LAST LIMIT 1
), planned AS (
  SELECT source, s, least(l * w, cap) AS target,
         CASE WHEN s > 0 THEN least(l * w, cap) / s ELSE 0 END AS rate
  FROM weighed, level
), plan AS (
  SELECT source, s, target, floor(rate)::BIGINT AS whole, rate - floor(rate) AS part FROM planned
), tossed AS (
  SELECT plan.source, k,
         sum(size * (floor(n * part)::BIGINT
                     + CASE WHEN ('0x' || substr(md5(k || ':' || key), 1, 8))::BIGINT / 4294967296.0 < n * part - floor(n * part)
                            THEN 1 ELSE 0 END)) AS extra
  FROM (SELECT DISTINCT key, source, size, n FROM sized) AS sized JOIN plan ON sized.source IS NOT DISTINCT FROM plan.source, range(64) AS u(k)
  GROUP BY 1, 2
), chosen AS (
  SELECT t.source, arg_min(k, (abs(extra - (target - whole * s)), k)) AS seed
  FROM tossed t JOIN plan ON t.source IS NOT DISTINCT FROM plan.source GROUP BY 1
)
SELECT doc_id, size, s AS source_size, target,
       size * (whole + CASE WHEN place < floor(n * part)::BIGINT
                                 + CASE WHEN ('0x' || substr(md5(seed || ':' || key), 1, 8))::BIGINT / 4294967296.0
                                             < n * part - floor(n * part) THEN 1 ELSE 0 END
                            THEN 1 ELSE 0 END) AS taken
FROM sized JOIN plan ON sized.source IS NOT DISTINCT FROM plan.source
           JOIN chosen ON sized.source IS NOT DISTINCT FROM chosen.source
"""

ORACLE = {
    "op3_minhash_dedup": NEAR,
    "op5_quality_rules": QUALITY,
    "op8_source_mix": MIX,
}
