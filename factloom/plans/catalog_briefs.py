"""Whole briefs: what a reader must know, for scopes that name paths, symbols or only words."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import brief, lexical
from . import adapters as A
from . import reports as R
from .catalog_state import _bm25
from .registry import Registry

add = Registry()
QUERIES, ORACLES = add.queries, add.oracles

# words that begin a name but are none; every path as a document of the names in it
_WORD_SCOPES = f"""word_asked AS (SELECT DISTINCT string_split(name, ' ')[1] AS q FROM symbols WHERE string_split(name, ' ')[1] NOT IN (SELECT t FROM asked)),
words AS (SELECT q, lower(q) AS term FROM word_asked WHERE length(q) >= 2),
parts AS (SELECT relative_path, string_agg(name, ' ' ORDER BY name) AS text FROM (SELECT DISTINCT relative_path, name FROM symbols) GROUP BY relative_path),
{_bm25("parts")},
hit AS (SELECT t, p, place FROM (SELECT q AS t, relative_path AS p, row_number() OVER (PARTITION BY q ORDER BY round(bm25, 9) DESC, relative_path) AS place FROM parts_hits) WHERE place <= 24),
whop1 AS (SELECT DISTINCT t, b AS p FROM hit JOIN ways ON a = p WHERE (t, b) NOT IN (SELECT (t, p) FROM hit)),
whop2 AS (SELECT DISTINCT t, b AS p FROM whop1 JOIN ways ON a = p WHERE (t, b) NOT IN (SELECT (t, p) FROM hit) AND (t, b) NOT IN (SELECT (t, p) FROM whop1)),
waround AS (SELECT t, p, hop FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY hop, p) AS n FROM (SELECT *, 1 AS hop FROM whop1 UNION ALL SELECT *, 2 FROM whop2)) WHERE n <= 24),
wlisted AS (SELECT t, p, min((part, n)) AS first FROM (SELECT t, p, 1 AS part, place AS n FROM hit UNION ALL SELECT t, p, 2, hop FROM waround) GROUP BY t, p),
wsuggested AS (SELECT t, list(p ORDER BY n) AS files FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY first, p) AS n FROM wlisted) WHERE n <= 6 GROUP BY t)"""
_TOLD = """every AS (
  SELECT t, files, CASE WHEN length(t) % 2 = 0 THEN 'safe_edit' ELSE 'entity_lookup' END AS class FROM suggested UNION ALL SELECT t, files, 'safe_edit' FROM wsuggested
), ready AS (SELECT *, (['ready', 'stale', 'degraded'])[length(t) % 3 + 1] AS readiness, (['fresh', 'stale', 'unverified'])[length(t) % 3 + 1] AS fresh FROM every),
sym AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY relative_path, line_number, fact_id) AS k FROM symbols),
told AS (
  SELECT t, 0 AS n, 'Exact path `' || t || '` is indexed as `rust` at `' || t || '` (10 bytes).' AS statement, 0.99 AS confidence, fresh AS freshness, 'ev_file_anchor_' || regexp_replace(lower(t), '[^0-9a-z]', '_', 'g') || '_path' AS evidence FROM ready WHERE t IN (SELECT relative_path FROM symbols)
  UNION ALL SELECT t, k, 'Exact symbol `' || name || '` is defined in `' || relative_path || '`:' || line_number || ' as a `' || kind || '`.', 0.97, fresh, 'ev_symbol_definition_' || regexp_replace(lower(fact_id), '[^0-9a-z]', '_', 'g') FROM ready JOIN sym ON name = t WHERE k <= 2
  UNION ALL SELECT t, 3, 'Lexical anchors for `' || t || '` matched ' || count(*) || ' path(s): ' || string_agg(p, ', ' ORDER BY place) FILTER (place <= 4) || '.', 0.70, any_value(fresh), 'ev_lexical_hit_' || regexp_replace(lower(arg_min(p, place)), '[^0-9a-z]', '_', 'g') FROM ready JOIN hit USING (t) GROUP BY t
  UNION ALL SELECT t, 4, 'Direct structural adjacency from `' || t || '` reaches ' || len(files) || ' indexed file(s): ' || array_to_string(files[:4], ', ') || CASE WHEN len(files) > 4 THEN ', and ' || (len(files) - 4) || ' more' ELSE '' END || '.', 0.82, fresh, NULL FROM ready WHERE len(files) > 1
  UNION ALL SELECT t, 6, 'Coverage audit for `' || class || '` is incomplete.', 0.72, 'unverified', NULL FROM ready WHERE class = 'safe_edit' OR readiness = 'stale'
)"""


@add(
    "SELECT t AS request_id, statement, confidence, freshness, evidence, place FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY n) AS place FROM told) WHERE place <= 5",
    (A.SYMBOLS, A.PART_IMPORTS, R.ASKED, R.SEEDS, R.BRIEFS, _WORD_SCOPES, _TOLD),
)
def i12_whole_briefs(spark, d):
    """What a reader must know of every brand, part name and first word of a name: two classes, three states of readiness, and
    full text for words."""
    s, i = A.symbols(spark, d), A.part_imports(spark, d)
    paths = s.select("relative_path").distinct()
    files = paths.select(F.lit("parts").alias("snapshot_id"), "relative_path", F.lit("rs").alias("extension"), F.lit("rust").alias("language"), F.lit(10).cast("long").alias("size_bytes"), F.lit("h").alias("content_hash"))
    facts = {"files": files, "symbols": s, "imports": i, "verification_targets": A.targets(spark)}
    named = s.select("relative_path").union(s.select("name")).distinct().select(F.col("relative_path").alias("scope_hint"))
    words = s.select(F.get(F.split("name", " "), F.lit(0)).alias("scope_hint")).distinct().join(named, "scope_hint", "left_anti")
    size = F.length("scope_hint")
    ready = F.get(F.array(F.lit("ready"), F.lit("stale"), F.lit("degraded")), size % 3)
    scopes = named.select("scope_hint", F.when(size % 2 == 0, "safe_edit").otherwise("query").alias("task_type")).union(words.select("scope_hint", F.lit("safe_edit")))
    scope = F.col("scope_hint")
    asked = scopes.select(scope.alias("request_id"), "scope_hint", scope.alias("goal"), scope.alias("question"), "task_type", F.lit("human").alias("consumer_type"), F.lit("standard").alias("depth"), F.lit(4096).alias("token_budget"), F.lit(800).alias("latency_budget"), ready.alias("readiness"))
    texts = s.groupBy("relative_path").agg(F.array_join(F.array_sort(F.collect_set("name")), " ").alias("text"))
    docs = texts.select(F.lit("parts").alias("snapshot_id"), "relative_path", lexical.body("relative_path", "text").alias("body"))
    found = brief.whole_brief(asked, facts, lexical.build_index(docs)).select("request_id", F.inline("must_know"))
    first = F.when(F.col("confidence").isin(0.99, 0.97, 0.7), F.get("evidence_ids", F.lit(0)))
    return found.select("request_id", "statement", F.col("confidence").cast("decimal(3,2)").alias("confidence"), "freshness", first.alias("evidence"), "place")


_ONE_LESS = "every_import AS (SELECT * FROM imports), fewer AS (SELECT * FROM every_import WHERE NOT (importer_path = 'Brand#3' AND line_number > 20))"


def _over(sql: str) -> str:
    """SQL of briefs over the imports that are left."""
    return sql.replace(" imports ", " fewer ").replace("JOIN imports", "JOIN fewer")


@add(
    "SELECT t AS request_id, files AS suggested_files, CASE WHEN n <= 1 THEN 'none' WHEN n <= 4 THEN 'localized' WHEN n <= 8 THEN 'moderate' ELSE 'high' END AS impact_level FROM suggested JOIN (SELECT t, count(*) AS n FROM near GROUP BY t) USING (t)",
    (A.SYMBOLS, A.PART_IMPORTS, _ONE_LESS, R.BRANDS, _over(R.SEEDS), _over(R.BRIEFS)),
)
def i11_kept_briefs(spark, d):
    """Briefs of every brand that are kept while some imports of one brand go: those which may have used them are made anew."""
    s, i = A.symbols(spark, d), A.part_imports(spark, d)
    files = s.select("relative_path").distinct().select(F.lit("parts").alias("snapshot_id"), "relative_path", F.lit("rs").alias("extension"), F.lit("rust").alias("language"), F.lit(10).cast("long").alias("size_bytes"), F.lit("h").alias("content_hash"))
    old = {"files": files, "symbols": s, "imports": i, "verification_targets": A.targets(spark)}
    new = old | {"imports": i.where("not (importer_path = 'Brand#3' and line_number > 20)")}
    scope = F.col("relative_path")
    asked = files.select(scope.alias("request_id"), scope.alias("scope_hint"), scope.alias("goal"), scope.alias("question"), F.lit("safe_edit").alias("task_type"), F.lit("human").alias("consumer_type"), F.lit("standard").alias("depth"), F.lit(4096).alias("token_budget"), F.lit(800).alias("latency_budget"))
    index = lexical.build_index(files.select("snapshot_id", "relative_path", lexical.body("relative_path", F.lit("")).alias("body")))
    kept = brief.kept_briefs(asked, old, index)
    return brief.maintained(kept, asked, old, new, index)["briefs"].select("request_id", "suggested_files", "impact_level")
