"""SQL of impact reports, for the oracles of several catalogues: over symbols, imports, and what is asked for."""

from __future__ import annotations

CALLS = """f AS (SELECT * FROM symbols WHERE kind = 'function'),
called AS (
  SELECT i.fact_id, row_number() OVER (PARTITION BY i.fact_id ORDER BY f.line_number, f.name, f.fact_id) AS n, f.name AS callee, f.relative_path AS called_path, f.line_number AS callee_line
  FROM imports i JOIN f ON f.relative_path = i.resolved_path AND lower(f.name) = lower(regexp_extract(i.import_spec, '([^:/.]+)$', 1))
), calling AS (
  SELECT i.fact_id, row_number() OVER (PARTITION BY i.fact_id ORDER BY f.line_number <= i.line_number DESC, CASE WHEN f.line_number <= i.line_number THEN -f.line_number ELSE f.line_number END,
      CASE WHEN f.line_number <= i.line_number THEN f.name END DESC, CASE WHEN f.line_number > i.line_number THEN f.name END, CASE WHEN f.line_number <= i.line_number THEN f.fact_id END DESC, f.fact_id) AS n,
    f.name AS caller, f.relative_path AS calling_path, f.line_number AS caller_line
  FROM imports i JOIN f ON f.relative_path = i.importer_path
)"""

ASKED = "asked AS (SELECT DISTINCT relative_path AS t FROM symbols UNION SELECT DISTINCT name FROM symbols)"
SEEDS = """seeds AS (SELECT t, relative_path AS p FROM asked JOIN (SELECT DISTINCT relative_path FROM symbols) f ON f.relative_path = t UNION SELECT t, relative_path FROM asked JOIN symbols ON name = t),
near AS (SELECT t, p FROM seeds UNION SELECT t, resolved_path FROM seeds JOIN imports ON importer_path = p WHERE resolved_path IS NOT NULL UNION SELECT t, importer_path FROM seeds JOIN imports ON resolved_path = p),
named AS (SELECT t, s.* FROM asked JOIN symbols s ON name = t),
defined AS (SELECT * FROM named UNION ALL SELECT t, s.* FROM seeds JOIN symbols s ON s.relative_path = p WHERE t NOT IN (SELECT t FROM named)),
touching AS (SELECT DISTINCT t, i.* FROM seeds JOIN imports i ON (importer_path = p AND resolved_path IS NOT NULL) OR resolved_path = p)"""
CHECKS = """checks AS (SELECT DISTINCT t, 'cargo xtask check' AS chk, 1 AS part FROM near UNION SELECT DISTINCT t, 'cargo test (in Brand#1)', 0 FROM near WHERE p = 'Brand#1')"""
RELATED = """calls AS (SELECT c.fact_id, 'symbol:' || caller || '@' || calling_path AS src, 'symbol:' || callee || '@' || called_path AS dst FROM called c JOIN calling g ON c.fact_id = g.fact_id WHERE c.n = 1 AND g.n = 1),
related AS (
  SELECT DISTINCT t, 'defines' AS kind, 'file:' || relative_path AS src, 'symbol:' || name || '@' || relative_path AS dst, relative_path || ' defines symbol:' || name || '@' || relative_path AS summary FROM defined
  UNION SELECT t, kind, 'file:' || importer_path, 'file:' || resolved_path, importer_path || ' ' || kind || ' ' || resolved_path || ' via `' || import_spec || '`' FROM (SELECT t, importer_path, resolved_path, import_spec, unnest(['references', 'imports']) AS kind FROM touching)
  UNION SELECT t, 'calls', src, dst, src || ' calls ' || dst || ' via `' || import_spec || '`' FROM touching JOIN calls USING (fact_id)
  UNION SELECT t, kind, 'file:' || p, 'check:' || chk, p || ' ' || kind || ' via `' || chk || '`' FROM (
    SELECT *, CASE WHEN contains(chk, ' test') THEN 'tests' ELSE 'builds' END AS kind, row_number() OVER (PARTITION BY t ORDER BY part, p) AS n FROM checks JOIN near USING (t)) WHERE n <= 24
)"""
REPORT = f"{ASKED},\n{SEEDS},\n{CHECKS}"
PLACED = """SELECT t AS request_id, kind, src, dst, row_number() OVER (PARTITION BY t ORDER BY CASE kind WHEN 'defines' THEN 2 WHEN 'imports' THEN 3 WHEN 'references' THEN 4 WHEN 'calls' THEN 5 WHEN 'builds' THEN 6 ELSE 7 END,
  src, dst, summary) AS place FROM related"""

# brands alone, or with names, under the one target that holds all paths
BRANDS = "asked AS (SELECT DISTINCT relative_path AS t FROM symbols)"
ONE_CHECK = "checks AS (SELECT DISTINCT t, 'cargo xtask check' AS chk, 0 AS part FROM near)"
BRIEFS = """ways AS (SELECT importer_path AS a, resolved_path AS b FROM imports WHERE resolved_path IS NOT NULL UNION SELECT resolved_path, importer_path FROM imports WHERE resolved_path IS NOT NULL),
hop1 AS (SELECT DISTINCT t, b AS p FROM seeds JOIN ways ON a = p WHERE (t, b) NOT IN (SELECT (t, p) FROM seeds)),
hop2 AS (SELECT DISTINCT t, b AS p FROM hop1 JOIN ways ON a = p WHERE (t, b) NOT IN (SELECT (t, p) FROM seeds) AND (t, b) NOT IN (SELECT (t, p) FROM hop1)),
around AS (SELECT t, p, hop FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY hop, p) AS n FROM (SELECT *, 1 AS hop FROM hop1 UNION ALL SELECT *, 2 FROM hop2)) WHERE n <= 24),
listed AS (SELECT t, p, min((part, hop)) AS first FROM (SELECT t, p, 0 AS part, 0 AS hop FROM near UNION ALL SELECT t, p, 2, hop FROM around) GROUP BY t, p),
suggested AS (SELECT t, list(p ORDER BY n) AS files FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY first, p) AS n FROM listed) WHERE n <= 6 GROUP BY t)"""
