"""Queries over facts of one snapshot: scans, lookups, the graph and full text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import align, decisions, graph, lexical, lookup
from ..sources import scan
from . import adapters as A
from . import reports as R
from .registry import Registry

add = Registry()
QUERIES, ORACLES = add.queries, add.oracles


# --- A: scans --------------------------------------------------------------------------------------------------------


@add(
    r"""SELECT page_id, ext, lang, NOT (list_has_any(dirs, ['.git','.idea','.mypy_cache','.pytest_cache','.ruff_cache','.venv','.vscode','__pycache__','build','dist','node_modules','out','target'])
      OR starts_with(name, '.env')) AND NOT list_contains(['bin','class','dll','dylib','exe','gif','gz','ico','jpeg','jpg','pdf','png','so','tar','zip'], coalesce(ext, '')) AND size <= 2097152 AS included
FROM (SELECT *, CASE ext WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'json' THEN 'json' WHEN 'md' THEN 'markdown' WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust'
        WHEN 'toml' THEN 'toml' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'yaml' THEN 'yaml' WHEN 'yml' THEN 'yaml' END AS lang
  FROM (SELECT page_id, octet_length(encode(html)) AS size, parts[:-2] AS dirs, parts[-1] AS name, nullif(lower(regexp_extract(p, '[^/]\.([^./]*)$', 1)), '') AS ext
    FROM (SELECT *, string_split(p, '/') AS parts FROM (SELECT page_id, html, regexp_replace(url, '^https?://', '') AS p FROM pages))))"""
)
def a3_scan_filter(spark, d):
    """Pages as files: extension, language, and whether a scan takes them."""
    p = A.table(spark, d, "pages").select("page_id", F.regexp_replace("url", "^https?://", "").alias("p"), F.octet_length("html").alias("size"))
    ext = scan.extension("p")
    return p.select("page_id", ext.alias("ext"), scan.language(ext).alias("lang"), scan.included("p", "size").alias("included"))


@add(
    """SELECT item_id, lower(printf('%016x', list_reduce(
    list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, octet_length(encode(text)) + 1), lambda i: ('0x' || substr(hex(encode(text)), 2 * i - 1, 2))::HUGEINT)),
    lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616::HUGEINT)::UBIGINT)) AS hash FROM benchmark"""
)
def a5_fnv1a(spark, d):
    """The content hash of every benchmark text."""
    return A.table(spark, d, "benchmark").select("item_id", X.fnv1a("text").alias("hash"))


# --- B: lookups ------------------------------------------------------------------------------------------------------


def _all_paths(spark, d):
    return A.files(spark, d).select(F.monotonically_increasing_id().alias("request_id"), "relative_path")


@add("SELECT relative_path AS target, size_bytes, content_hash FROM files", (A.FILES,))
def b1_exact_path(spark, d):
    """Every path, asked for with the other slashes."""
    f = A.files(spark, d)
    asked = f.select(F.col("relative_path").alias("request_id"), F.translate("relative_path", "/", "\\").alias("target"))
    return lookup.exact_path(f, asked).select(F.col("relative_path").alias("target"), "size_bytes", "content_hash")


@add("SELECT name AS target, relative_path, kind, line_number FROM symbols", (A.SYMBOLS,))
def b2_exact_symbol(spark, d):
    """Symbols of every part name, and of the names in capitals, which none has."""
    names = A.table(spark, d, "part").select("p_name").distinct()
    asked = names.select(F.col("p_name").alias("target")).union(names.select(F.upper("p_name"))).distinct().select(F.col("target").alias("request_id"), "target")
    return lookup.exact_symbol(A.symbols(spark, d), asked).select(F.col("name").alias("target"), "relative_path", "kind", "line_number")


@add("SELECT fact_id AS target, min(name) AS name FROM (SELECT fact_id, first_value(name) OVER (PARTITION BY fact_id ORDER BY relative_path, line_number, name) AS name FROM symbols) GROUP BY fact_id", (A.SYMBOLS,))
def b3_symbol_by_fact_id(spark, d):
    s = A.symbols(spark, d)
    return lookup.symbol_by_fact_id(s, s.select(F.col("fact_id").alias("request_id"), F.col("fact_id").alias("target")).distinct()).select(F.col("fact_id").alias("target"), "name")


@add("SELECT relative_path, name, line_number, row_number() OVER (PARTITION BY relative_path ORDER BY line_number, name, fact_id) AS place FROM symbols", (A.SYMBOLS,))
def b4_symbols_for_path(spark, d):
    brands = A.table(spark, d, "part").select(F.col("p_brand").alias("relative_path")).distinct().withColumn("request_id", F.lit(0))
    return lookup.symbols_for_path(A.symbols(spark, d), brands).select("relative_path", "name", "line_number", "place")


@add("SELECT a AS path, b AS other, 'out' AS way FROM edges UNION ALL SELECT b, a, 'in' FROM edges", (A.EDGES,))
def b5_b6_imports(spark, d):
    """Edges out of and into every node."""
    e = A.edges(spark, d)
    nodes = e.select("importer_path").union(e.select("resolved_path")).distinct().select(F.lit(0).alias("request_id"), F.col("importer_path").alias("relative_path"))
    out = lookup.direct_imports(e, nodes).select(F.col("importer_path").alias("path"), F.col("resolved_path").alias("other"), F.lit("out").alias("way"))
    return out.union(lookup.reverse_imports(e, nodes).select("resolved_path", "importer_path", F.lit("in")))


@add("SELECT DISTINCT name AS target, relative_path FROM symbols UNION SELECT relative_path, relative_path FROM symbols", (A.SYMBOLS,))
def b8_seed_paths(spark, d):
    """Seeds of every part name and brand."""
    s = A.symbols(spark, d)
    asked = s.select("name").union(s.select("relative_path")).distinct().select(F.col("name").alias("request_id"), F.col("name").alias("target"))
    return lookup.seed_paths(s.select("relative_path").distinct(), s, asked).select(F.col("request_id").alias("target"), "relative_path")


@add("SELECT relative_path, scope_root, chk, priority FROM files, targets WHERE scope_root = '' OR relative_path = scope_root OR starts_with(relative_path, scope_root || '/')", (A.FILES, A.TARGETS))
def b9_scope_match(spark, d):
    """Every file with the targets whose scope holds it: a prefix join as an equi-join."""
    return graph.verification_matches(_all_paths(spark, d), A.targets(spark)).select("relative_path", "scope_root", F.col("check").alias("chk"), "priority")


@add(
    r"""SELECT relative_path, contains(lower(relative_path), 'doc_1') AS named, true AS decision_doc, regexp_matches(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'decision|rationale|tradeoff|status:|intent') AS marked,
  regexp_matches(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'license|copyright') AS licensed FROM files""",
    (A.FILES,),
)
def b11_b12_markers(spark, d):
    """Documents that look like or speak of decisions, under the rules' words and words of the corpus."""
    f = A.files(spark, d)
    return f.select("relative_path", F.contains("relative_path", F.lit("doc_1")).alias("named"), lookup.looks_like_decision_doc("relative_path", "language", "extension").alias("decision_doc"), lookup.has_marker("text").alias("marked"), lookup.has_marker("text", ("license", "copyright")).alias("licensed"))


@add(
    """SELECT relative_path, arg_max(manifest, length(folder)) AS manifest_path FROM files JOIN (VALUES ('', 'Cargo.toml'), ('src1', 'src1/Cargo.toml'), ('src1/en', 'src1/en/Cargo.toml'), ('src2/fr', 'src2/fr/Cargo.toml')) m(folder, manifest)
  ON folder = '' OR starts_with(relative_path, folder || '/') GROUP BY relative_path""",
    (A.FILES,),
)
def b23_nearest_manifest(spark, d):
    m = spark.createDataFrame([("", "Cargo.toml"), ("src1", "src1/Cargo.toml"), ("src1/en", "src1/en/Cargo.toml"), ("src2/fr", "src2/fr/Cargo.toml")], "folder string, manifest_path string")
    return lookup.nearest_manifest(A.files(spark, d), m).select("relative_path", "manifest_path")


@add("SELECT relative_path FROM files WHERE relative_path ILIKE 'SRC1_/%'", (A.FILES,))
def b22_scope_like(spark, d):
    """The full-text scope: signs of a pattern count, case does not."""
    return A.files(spark, d).where(lookup.scope_filter("relative_path", F.lit("SRC1_/"))).select("relative_path")


# --- C: the graph ----------------------------------------------------------------------------------------------------

_SEEDS = "seeds AS (SELECT n_nationkey AS request_id, 'nation:' || n_nationkey AS p FROM nation)"
_IMPACTED = "impacted AS (SELECT request_id, p FROM seeds UNION SELECT request_id, b FROM seeds JOIN edges ON p = a UNION SELECT request_id, a FROM seeds JOIN edges ON p = b)"


@add("SELECT request_id, p AS relative_path FROM impacted", (A.EDGES, _SEEDS, _IMPACTED))
def c1_impacted_paths(spark, d):
    return graph.impacted_paths(A.nation_seeds(spark, d), A.edges(spark, d))


@add("SELECT relative_path, name, line_number FROM symbols", (A.SYMBOLS,))
def c2_defined_symbols(spark, d):
    s = A.symbols(spark, d)
    return graph.defined_symbols(s.select("relative_path").distinct().withColumn("request_id", F.lit(0)), s).select("relative_path", "name", "line_number")


@add("SELECT DISTINCT request_id, a AS importer_path, b AS resolved_path FROM seeds JOIN edges ON p = a OR p = b", (A.EDGES, _SEEDS))
def c3_touching_imports(spark, d):
    return graph.touching_imports(A.nation_seeds(spark, d), A.edges(spark, d)).select("request_id", "importer_path", "resolved_path")


@add(
    """SELECT request_id, kind, 'file:' || a AS src, 'file:' || b AS dst, a || ' ' || kind || ' ' || b || ' via `' || spec || '`' AS summary
FROM (SELECT DISTINCT request_id, a, b, spec FROM seeds JOIN edges ON p = a OR p = b), (VALUES ('references'), ('imports')) k(kind)""",
    (A.EDGES, _SEEDS),
)
def c5_reference_edges(spark, d):
    e = graph.reference_edges(graph.touching_imports(A.nation_seeds(spark, d), A.edges(spark, d)))
    return e.select("request_id", "kind", "src", "dst", "summary")


@add("SELECT c.fact_id, caller, calling_path, caller_line, callee, called_path, callee_line FROM called c JOIN calling g ON c.fact_id = g.fact_id WHERE c.n = 1 AND g.n = 1", (A.SYMBOLS, A.PART_IMPORTS, R.CALLS))
def c6_call_pairs(spark, d):
    """Who calls what: the called function by name, the calling one as of the import's line."""
    return graph.call_pairs(A.part_imports(spark, d), A.symbols(spark, d))


_PLAN = """covered AS (
  SELECT lang, relative_path, chk, priority FROM (SELECT language AS lang, relative_path FROM files) JOIN targets ON scope_root <> '' AND (relative_path = scope_root OR starts_with(relative_path, scope_root || '/'))
)"""


@add(
    """SELECT lang AS request_id, coalesce(req, []) AS required_checks, coalesce(rec, []) AS recommended_checks, coalesce(gaps, 0) AS gaps, coalesce(len(req), 0) = 0 AS stop
FROM (SELECT DISTINCT language AS lang FROM files)
LEFT JOIN (SELECT lang, list_sort(list(DISTINCT chk) FILTER (priority = 'required')) AS req, list_sort(list(DISTINCT chk) FILTER (priority = 'recommended')) AS rec FROM covered GROUP BY lang) USING (lang)
LEFT JOIN (SELECT language AS lang, count(*) AS gaps FROM files WHERE relative_path NOT IN (SELECT relative_path FROM covered) GROUP BY 1) USING (lang)""",
    (A.FILES, A.TARGETS, _PLAN),
)
def c9_verification_plan(spark, d):
    """Checks and uncovered paths of each language's files; the target of the whole tree left out."""
    paths = A.files(spark, d).select(F.col("language").alias("request_id"), "relative_path")
    plan = graph.verification_plan(paths, A.targets(spark).where("scope_root <> ''"))
    return plan.select("request_id", "required_checks", "recommended_checks", F.size("coverage_gaps").cast("long").alias("gaps"), "stop")


@add(
    """SELECT lang AS request_id, CASE WHEN contains(chk, ' test') OR contains(chk, 'unittest') OR contains(chk, 'pytest') THEN 'tests' ELSE 'builds' END AS kind, 'file:' || relative_path AS src, 'check:' || chk AS dst
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY place, relative_path) AS n
  FROM (SELECT language AS lang, relative_path FROM files), (SELECT chk, row_number() OVER (ORDER BY priority DESC, chk) AS place FROM targets)) WHERE n <= 24""",
    (A.FILES, A.TARGETS),
)
def c7_check_edges(spark, d):
    """Every check of a whole-tree plan with the files of each language, 24 edges each."""
    paths = A.files(spark, d).select(F.col("language").alias("request_id"), "relative_path")
    t = A.targets(spark).withColumn("check", X.render_check("command", "working_directory"))
    pick = lambda p: F.array_sort(F.collect_set(F.when(F.col("priority") == p, F.col("check")))).alias(f"{p}_checks")
    plan = paths.select("request_id").distinct().join(F.broadcast(t.agg(pick("required"), pick("recommended"))))  # one row
    return graph.check_edges(paths, plan).select("request_id", "kind", "src", "dst")


@add(
    """SELECT request_id, kind, src, dst, row_number() OVER (PARTITION BY request_id ORDER BY CASE kind WHEN 'defines' THEN 2 WHEN 'imports' THEN 3 ELSE 4 END, src, dst, summary) AS place
FROM (SELECT DISTINCT * FROM (
  SELECT relative_path AS request_id, 'defines' AS kind, 'file:' || relative_path AS src, 'symbol:' || name || '@' || relative_path AS dst, relative_path || ' defines symbol:' || name || '@' || relative_path AS summary FROM symbols
  UNION ALL SELECT p, kind, 'file:' || importer_path, 'file:' || resolved_path, importer_path || ' ' || kind || ' ' || resolved_path || ' via `' || import_spec || '`'
  FROM (SELECT DISTINCT relative_path AS p FROM symbols) JOIN imports ON p = importer_path OR p = resolved_path, (VALUES ('references'), ('imports')) k(kind) WHERE resolved_path IS NOT NULL))""",
    (A.SYMBOLS, A.PART_IMPORTS),
)
def c10_relationships(spark, d):
    """Definitions, references and imports around every brand, in the order of kinds."""
    s, i = A.symbols(spark, d), A.part_imports(spark, d)
    seeds = s.select(F.col("relative_path").alias("request_id"), "relative_path").distinct()
    edges = graph.relationships(graph.define_edges(graph.defined_symbols(seeds, s)), graph.reference_edges(graph.touching_imports(seeds, i)))
    return edges.select("request_id", "kind", "src", "dst", "place")


@add(
    """SELECT request_id, node, max(score) AS score FROM (
  SELECT request_id, 'file:' || p AS node, 1.0 AS score FROM seeds UNION ALL SELECT request_id, 'file:' || b, 0.8 FROM seeds JOIN edges ON p = a UNION ALL SELECT request_id, 'file:' || a, 0.8 FROM seeds JOIN edges ON p = b
) GROUP BY ALL""",
    (A.EDGES, _SEEDS),
)
def c11_traverse(spark, d):
    out = graph.traverse(A.nation_seeds(spark, d), A.symbols(spark, d), A.edges(spark, d), ["contains", "imports", "references", "calls"])
    return out.select("request_id", "node", F.col("score").cast("decimal(2,1)").alias("score"))


@add(
    """both_ways AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges),
walk(request_id, node, hop) AS (SELECT request_id, p, 0 FROM seeds UNION SELECT request_id, b, hop + 1 FROM walk JOIN both_ways ON node = a WHERE hop < 2)
SELECT request_id, node AS relative_path, min(hop) AS hop FROM walk GROUP BY ALL""",
    (A.EDGES, _SEEDS),
)
def c13_bounded_expansion(spark, d):
    """All nodes within two hops of each nation, and their distance."""
    return graph.expand(A.nation_seeds(spark, d), A.edges(spark, d), 2)


@add(
    """hop1 AS (
  SELECT request_id, node, row_number() OVER (PARTITION BY request_id ORDER BY d, node) AS place FROM (
    SELECT request_id, node, min(d) AS d FROM (SELECT request_id, b AS node, 0 AS d FROM seeds JOIN edges ON p = a UNION ALL SELECT request_id, a, 1 FROM seeds JOIN edges ON p = b) GROUP BY ALL)
)
SELECT request_id, node AS relative_path, place FROM hop1 WHERE place <= 40""",
    (A.EDGES, _SEEDS),
)
def c13_ordered_expansion(spark, d):
    """The first 40 neighbours of each nation in the order of a queue."""
    return graph.expand_ordered(A.nation_seeds(spark, d), A.edges(spark, d), 1, 40).select("request_id", "relative_path", "place")


# --- D: full text ----------------------------------------------------------------------------------------------------

_TEXTS = ("license", "the and", "copyright license", "de la", "und der", "src1 en", "über", "no such words")
_INDEX = r"""docs AS (
  SELECT relative_path, list_filter(regexp_split_to_array(lower(strip_accents(relative_path || chr(10) || text)), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS terms FROM files
), posting AS (SELECT relative_path, term, count(*) AS tf FROM (SELECT relative_path, unnest(terms) AS term FROM docs) GROUP BY ALL),
stats AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM docs), spread AS (SELECT term, count(*) AS df FROM posting GROUP BY term),
asked AS (SELECT * FROM (VALUES ('license'), ('the and'), ('copyright license'), ('de la'), ('und der'), ('src1 en'), ('über'), ('no such words')) q(q)),
words AS (SELECT q, unnest(list_distinct(list_filter(regexp_split_to_array(translate(q, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z]'), lambda t: octet_length(encode(t)) >= 2))) AS term FROM asked),
hits AS (
  SELECT q, relative_path, sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(terms) / mean))) AS bm25
  FROM words JOIN posting USING (term) JOIN spread USING (term) JOIN docs USING (relative_path), stats GROUP BY q, relative_path HAVING count(*) = (SELECT count(*) FROM words w WHERE w.q = words.q)
)"""


@add("SELECT q AS request_id, relative_path, round(bm25, 6) AS bm25, 1.0 AS score, place FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(bm25, 9) DESC, relative_path) AS place FROM hits) WHERE place <= 10", (A.FILES, _INDEX))
def d3_full_text(spark, d):
    """The ten best documents of each query by BM25; all words must occur."""
    f = A.files(spark, d)
    index = lexical.build_index(f.select("snapshot_id", "relative_path", lexical.body("relative_path", "text").alias("body")))
    asked = spark.createDataFrame([(t, t, "", 10) for t in _TEXTS], "request_id string, text string, scope string, limit int")
    return lexical.search(index, asked).select("request_id", "relative_path", F.round("bm25", 6).alias("bm25"), F.col("score").cast("decimal(2,1)").alias("score"), "place")


@add("SELECT term, count(*) AS docs, CAST(sum(tf) AS BIGINT) AS uses FROM posting GROUP BY term", (A.FILES, _INDEX))
def d8_postings(spark, d):
    """The index itself: documents and uses of every word."""
    f = A.files(spark, d)
    index = lexical.build_index(f.select("snapshot_id", "relative_path", lexical.body("relative_path", "text").alias("body")))
    return index["postings"].groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("uses"))


@add(r"SELECT item_id, list_sort(list_distinct(list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z]'), lambda t: octet_length(encode(t)) >= 2))) AS tokens FROM benchmark")
def d1_query_tokens(spark, d):
    return A.table(spark, d, "benchmark").select("item_id", X.query_tokens("text").alias("tokens"))


@add(
    """SELECT coalesce(r.relative_path, t.relative_path) AS relative_path, CASE WHEN r.relative_path IS NULL THEN 'insert' WHEN t.relative_path IS NULL THEN 'delete' ELSE 'replace' END AS action
FROM ref r FULL JOIN tgt t ON r.relative_path = t.relative_path WHERE r.content_hash IS DISTINCT FROM t.content_hash""",
    (A.FILES, A.TWO),
)
def d7_sync_plan(spark, d):
    ref, tgt = A.two_snapshots(spark, d)
    return lexical.sync_plan(ref, tgt).select("relative_path", "action")


@add("SELECT q AS request_id, relative_path, max(s) AS score FROM (SELECT q, relative_path, 1.0 AS s FROM hits UNION ALL SELECT q, relative_path, 0.5 FROM hits) GROUP BY ALL", (A.FILES, _INDEX))
def d11_merge_hits(spark, d):
    f = A.files(spark, d)
    index = lexical.build_index(f.select("snapshot_id", "relative_path", lexical.body("relative_path", "text").alias("body")))
    asked = spark.createDataFrame([(t, t, "", 0) for t in _TEXTS], "request_id string, text string, scope string, limit int")
    hits = lexical.search(index, asked).select("request_id", "relative_path", "score")
    return lexical.merge_hits(hits, hits.withColumn("score", F.lit(0.5).cast("double")), 0).select("request_id", "relative_path", F.col("score").cast("decimal(2,1)").alias("score"))


@add("SELECT DISTINCT q AS request_id, 'ev_lexical_hit_' || regexp_replace(lower(relative_path), '[^0-9a-z]', '_', 'g') AS id FROM hits", (A.FILES, _INDEX))
def d12_hit_receipts(spark, d):
    f = A.files(spark, d)
    index = lexical.build_index(f.select("snapshot_id", "relative_path", lexical.body("relative_path", "text").alias("body")))
    asked = spark.createDataFrame([(t, t, "", 0) for t in _TEXTS], "request_id string, text string, scope string, limit int")
    return lexical.hit_receipts(lexical.search(index, asked)).select("request_id", "id").distinct()


# --- E, F: signatures, windows and rankings --------------------------------------------------------------------------


@add("SELECT importer_path AS relative_path, array_to_string(list_sort(list(DISTINCT language || ':' || import_spec || '->' || coalesce(resolved_path, '<unresolved>')))[:24], '|') AS import_signature FROM imports GROUP BY 1", (A.PART_IMPORTS,))
def e3_import_signatures(spark, d):
    return align.import_signatures(A.part_imports(spark, d))


@add("SELECT resolved_path AS relative_path, array_to_string(list_sort(list(DISTINCT language || ':' || importer_path || '->' || import_spec))[:24], '|') AS reverse_import_signature FROM imports WHERE resolved_path IS NOT NULL GROUP BY 1", (A.PART_IMPORTS,))
def e4_reverse_signatures(spark, d):
    return align.reverse_signatures(A.part_imports(spark, d))


@add("SELECT relative_path, string_agg(kind || ':' || n, '|' ORDER BY kind || ':' || n) AS symbol_context_signature FROM (SELECT relative_path, kind, count(*) AS n FROM symbols GROUP BY ALL) GROUP BY relative_path", (A.SYMBOLS,))
def e5_symbol_contexts(spark, d):
    return align.symbol_contexts(A.symbols(spark, d))


_SHAPE = """shaped AS (SELECT *, 'tokens=2;pattern=' || array_to_string(list_transform(string_split(name, ' '), lambda t: CASE WHEN length(t) <= 3 THEN 's' WHEN length(t) <= 6 THEN 'm' ELSE 'l' END), '') || ';extra=0;digits=0' AS shape FROM symbols)"""


@add(
    """SELECT fact_id, count(*) OVER (PARTITION BY relative_path) AS function_count, coalesce(lag(shape) OVER w, 'none') AS previous, coalesce(lead(shape) OVER w, 'none') AS "next"
FROM shaped WHERE kind = 'function' WINDOW w AS (PARTITION BY relative_path ORDER BY line_number, name, fact_id)""",
    (A.SYMBOLS, _SHAPE),
)
def f1_neighbours(spark, d):
    return align.neighbours(A.symbols(spark, d)).select("fact_id", "function_count", "previous", "next")


@add(
    r"""SELECT relative_path, regexp_matches(lower(text), 'license|copyright') AS marked, 'doc ' || regexp_extract(relative_path, 'doc_(\d+)', 1) AS title FROM files
  WHERE NOT regexp_matches(text, '(^|\n)\s*#')""",
    (A.FILES,),
)
def e18_scan_documents(spark, d):
    """Marks and titles of all documents that have no heading."""
    f = A.files(spark, d).where(~F.col("text").rlike(r"(^|\n)\s*#"))
    return decisions.scan_documents(f, ("license", "copyright")).select("relative_path", "marked", "title")


@add(
    """terms AS (SELECT DISTINCT language AS lang, unnest(list_filter(regexp_split_to_array(relative_path, '[^0-9a-z]'), lambda t: length(t) >= 3)) AS term FROM files WHERE starts_with(relative_path, 'src7/')),
good AS (SELECT relative_path, lower(text) AS t FROM files WHERE regexp_matches(lower(text), 'license') AND size_bytes <= 262144), lists AS (SELECT lang, list(term) AS terms FROM terms GROUP BY lang),
scored AS (SELECT lang, relative_path, CASE WHEN contains(relative_path, lang) THEN 24 ELSE 0 END + CASE WHEN contains(t, lang) THEN 18 ELSE 0 END
    + 6 * len(list_filter(terms, lambda x: contains(relative_path, x))) + 4 * len(list_filter(terms, lambda x: contains(t, x))) AS score FROM good, lists)
SELECT lang AS request_id, relative_path, score, place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, relative_path) AS place FROM scored) WHERE place <= 4""",
    (A.FILES,),
)
def f2_rank_documents(spark, d):
    """The best licensed documents for each language's files of one source."""
    f = A.files(spark, d)
    near = f.where(F.startswith("relative_path", F.lit("src7/"))).select(F.col("language").alias("request_id"), "relative_path")
    asked = near.select("request_id", F.col("request_id").alias("target")).distinct()
    return decisions.rank_documents(asked, f, near, markers=("license",)).select("request_id", "relative_path", "score", "place")


@add(
    """SELECT url, CASE WHEN contains(p, 'intent') OR contains(p, 'spec') THEN 10 ELSE 0 END + CASE WHEN contains(p, 'adr') THEN 40 ELSE 0 END + CASE WHEN contains(p, 'decision') THEN 25 ELSE 0 END + CASE WHEN starts_with(p, 'docs/') THEN 6 ELSE 0 END
  + CASE WHEN starts_with(p, 'plans/') THEN 5 ELSE 0 END + CASE WHEN starts_with(p, 'research/') THEN 4 ELSE 0 END AS score FROM (SELECT url, translate(replace(regexp_replace(url, '^https?://[^/]*/', ''), 'en/', 'docs/adr-'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS p FROM pages)"""
)
def f3_path_priority(spark, d):
    return A.table(spark, d, "pages").select("url", decisions.path_priority(F.replace(F.regexp_replace("url", "^https?://[^/]*/", ""), F.lit("en/"), F.lit("docs/adr-"))).alias("score"))


@add(
    """best AS (SELECT relative_path FROM files WHERE size_bytes <= 262144 ORDER BY relative_path LIMIT 64), a AS (SELECT language AS lang, relative_path FROM files WHERE starts_with(relative_path, 'src7/')),
both_ AS (SELECT lang, relative_path, 4 AS s FROM a UNION ALL SELECT lang, best.relative_path, 0 FROM (SELECT DISTINCT lang FROM a), best)
SELECT lang AS request_id, relative_path, score, place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, relative_path) AS place FROM (SELECT lang, relative_path, max(s) AS score FROM both_ GROUP BY ALL)) WHERE place <= 4""",
    (A.FILES,),
)
def f6_fast_candidates(spark, d):
    f = A.files(spark, d)
    near = f.where(F.startswith("relative_path", F.lit("src7/"))).select(F.col("language").alias("request_id"), "relative_path")
    return decisions.fast_candidates(near, near, f).select("request_id", "relative_path", "score", "place")


# --- The same over whole tables: the SQL of the ones above is bound to one source, or to documents without headings. --------


@add(
    r"""SELECT relative_path, regexp_matches(lower(text), 'license|copyright') AS marked,
  coalesce(nullif(trim(regexp_replace(list_filter(regexp_split_to_array(text, '\r?\n'), lambda x: starts_with(trim(x), '#'))[1], '^[# ]+', '')), ''), 'doc ' || regexp_extract(relative_path, 'doc_(\d+)', 1)) AS title FROM files""",
    (A.FILES,),
)
def e18_scan_all_documents(spark, d):
    """Marks and titles of all documents, those with a heading too."""
    return decisions.scan_documents(A.files(spark, d), ("license", "copyright")).select("relative_path", "marked", "title")


def _by_source(files):
    """Every file as one of the request of its source and language."""
    return files.select(F.substring_index("relative_path", "/", 2).alias("request_id"), F.col("language").alias("target"), "relative_path")


_REQUESTS = "asked AS (SELECT regexp_extract(relative_path, '^[^/]*/[^/]*') AS request_id, language AS lang, relative_path FROM files)"


@add(
    """terms AS (SELECT DISTINCT request_id, lang, unnest(list_filter(regexp_split_to_array(relative_path, '[^0-9a-z]'), lambda t: length(t) >= 3)) AS term FROM asked),
good AS (SELECT relative_path, lower(text) AS t FROM files WHERE regexp_matches(lower(text), 'license') AND size_bytes <= 262144), lists AS (SELECT request_id, lang, list(term) AS terms FROM terms GROUP BY ALL),
scored AS (SELECT request_id, relative_path, CASE WHEN contains(relative_path, lang) THEN 24 ELSE 0 END + CASE WHEN contains(t, lang) THEN 18 ELSE 0 END
    + 6 * len(list_filter(terms, lambda x: contains(relative_path, x))) + 4 * len(list_filter(terms, lambda x: contains(t, x))) AS score FROM good, lists)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, relative_path) AS place FROM scored) WHERE place <= 4""",
    (A.FILES, _REQUESTS),
)
def f2_rank_documents_by_source(spark, d):
    """The best licensed documents for the files of each source and language."""
    f = A.files(spark, d)
    near = _by_source(f)
    return decisions.rank_documents(near.select("request_id", "target").distinct(), f, near, markers=("license",)).select("request_id", "relative_path", "score", "place")


@add(
    """best AS (SELECT relative_path FROM files WHERE size_bytes <= 262144 ORDER BY relative_path LIMIT 64),
near AS (SELECT request_id, relative_path, 4 AS s FROM asked SEMI JOIN (SELECT relative_path FROM files WHERE size_bytes <= 262144) USING (relative_path)
  UNION ALL SELECT request_id, best.relative_path, 0 FROM (SELECT DISTINCT request_id FROM asked), best)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, relative_path) AS place FROM (SELECT request_id, relative_path, max(s) AS score FROM near GROUP BY ALL)) WHERE place <= 4""",
    (A.FILES, _REQUESTS),
)
def f6_fast_candidates_by_source(spark, d):
    f = A.files(spark, d)
    near = _by_source(f).select("request_id", "relative_path")
    return decisions.fast_candidates(near, near, f).select("request_id", "relative_path", "score", "place")
