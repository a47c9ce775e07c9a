"""Queries over two snapshots: deltas, merges, alignment and obligations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align, delta, obligations
from ..operators.graph import cut
from ..sources import replay
from ..sources.shared import scratch
from . import adapters as A
from .registry import Registry

add = Registry()
QUERIES, ORACLES = add.queries, add.oracles

_CHANGES = """changes AS (
  SELECT coalesce(r.relative_path, t.relative_path) AS relative_path, CASE WHEN r.relative_path IS NULL THEN 'added' WHEN t.relative_path IS NULL THEN 'removed' ELSE 'modified' END AS change
  FROM ref r FULL JOIN tgt t ON r.relative_path = t.relative_path WHERE r.content_hash IS DISTINCT FROM t.content_hash
)"""


@add("SELECT * FROM changes", (A.FILES, A.TWO, _CHANGES))
def g1_file_changes(spark, d):
    return delta.file_changes(*A.two_snapshots(spark, d))


@add(
    "SELECT DISTINCT fact_id, 'removed' AS change FROM sref WHERE fact_id NOT IN (SELECT fact_id FROM stgt) UNION ALL SELECT DISTINCT fact_id, 'added' FROM stgt WHERE fact_id NOT IN (SELECT fact_id FROM sref)",
    (A.SYMBOLS, A.SYMBOLS_TWO),
)
def g2_symbol_changes(spark, d):
    return delta.symbol_changes(*A.changed_symbols(spark, d)).select("fact_id", "change")


_IMPORTS_TWO = "iref AS (SELECT * FROM imports WHERE importer_path <> 'Brand#3'), itgt AS (SELECT * FROM imports WHERE importer_path <> 'Brand#4')"


def _imports_two(spark, d):
    i = A.part_imports(spark, d)
    return i.where("importer_path <> 'Brand#3'"), i.where("importer_path <> 'Brand#4'")


@add(
    "SELECT DISTINCT fact_id, importer_path, resolved_path, 'removed' AS change FROM iref WHERE fact_id NOT IN (SELECT fact_id FROM itgt) UNION ALL SELECT DISTINCT fact_id, importer_path, resolved_path, 'added' FROM itgt WHERE fact_id NOT IN (SELECT fact_id FROM iref)",
    (A.PART_IMPORTS, _IMPORTS_TWO),
)
def g3_import_changes(spark, d):
    return delta.import_changes(*_imports_two(spark, d))


@add(
    """, asked AS (SELECT * FROM (VALUES ('src1'), ('src2/en'), ('src'), ('nowhere/x.rs')) a(input) UNION SELECT relative_path FROM files WHERE language = 'de')
SELECT input, f.relative_path, CASE WHEN f.relative_path IS NULL THEN 'unresolved' WHEN f.relative_path = input THEN 'exact' ELSE 'prefix' END AS how FROM asked LEFT JOIN files f ON f.relative_path = input OR starts_with(f.relative_path, input || '/')""".lstrip(", "),
    (A.FILES,),
)
def g7_resolve_changed(spark, d):
    f = A.files(spark, d)
    asked = spark.createDataFrame([("src1",), ("src2/en",), ("src",), ("nowhere/x.rs",)], "relative_path string").union(f.where("language = 'de'").select("relative_path"))
    return delta.resolve_changed(asked, f)


def _sides(spark, d):
    files, symbols, imports, t = A.two_snapshots(spark, d), A.changed_symbols(spark, d), _imports_two(spark, d), A.targets(spark)
    return [{"files": files[k], "symbols": symbols[k], "imports": imports[k], "verification_targets": t} for k in (0, 1)]


@add(
    """SELECT count(*) FILTER (change = 'added') AS added_files, count(*) FILTER (change = 'removed') AS removed_files, count(*) FILTER (change = 'modified') AS modified_files,
  (SELECT count(DISTINCT fact_id) FROM stgt WHERE fact_id NOT IN (SELECT fact_id FROM sref)) AS added_symbols, (SELECT count(DISTINCT fact_id) FROM sref WHERE fact_id NOT IN (SELECT fact_id FROM stgt)) AS removed_symbols,
  (SELECT count(DISTINCT fact_id) FROM itgt WHERE fact_id NOT IN (SELECT fact_id FROM iref)) AS added_imports, (SELECT count(DISTINCT fact_id) FROM iref WHERE fact_id NOT IN (SELECT fact_id FROM itgt)) AS removed_imports, true AS has_changes FROM changes""",
    (A.FILES, A.TWO, _CHANGES, A.SYMBOLS, A.SYMBOLS_TWO, A.PART_IMPORTS, _IMPORTS_TWO),
)
def h1_semantic_delta(spark, d):
    counts = ("added_files", "removed_files", "modified_files", "added_symbols", "removed_symbols", "added_imports", "removed_imports", "has_changes")
    return delta.semantic_delta(*_sides(spark, d))["summary"].select(*counts)


@add("SELECT false AS has_changes, 0 AS scope")
def h2_no_changes(spark, d):
    """A snapshot against itself."""
    side = _sides(spark, d)[0]
    found = delta.semantic_delta(side, side)
    return found["summary"].select("has_changes").join(F.broadcast(found["scope"].agg(F.count("*").alias("scope"))))  # one row each


@add(
    """, changed AS (SELECT relative_path FROM changes WHERE starts_with(relative_path, 'src1'))
SELECT relative_path, content_hash FROM ref WHERE relative_path NOT IN (SELECT relative_path FROM changed) UNION SELECT relative_path, content_hash FROM tgt WHERE relative_path IN (SELECT relative_path FROM changed)""".lstrip(", "),
    (A.FILES, A.TWO, _CHANGES),
)
def h3_merge_snapshot(spark, d):
    """The reference's files with those that changed in some sources as in the target."""
    base, target = _sides(spark, d)
    changed = delta.file_changes(base["files"], target["files"]).where(F.startswith("relative_path", F.lit("src1"))).select("relative_path")
    return delta.merge_snapshot(base, target, changed)["files"].select("relative_path", "content_hash")


@add(
    """SELECT fact_id FROM imports WHERE importer_path NOT IN (SELECT importer_path FROM imports WHERE resolved_path = 'Brand#7') AND importer_path <> 'Brand#7'
UNION SELECT fact_id FROM imports WHERE importer_path IN (SELECT importer_path FROM imports WHERE resolved_path = 'Brand#7') OR importer_path = 'Brand#7'""",
    (A.PART_IMPORTS,),
)
def h3_merge_imports(spark, d):
    """Imports merged for one changed brand: those of every brand that refers to it are taken anew."""
    i = A.part_imports(spark, d)
    s, f, t = A.symbols(spark, d), A.files(spark, d), A.targets(spark)
    side = {"files": f, "symbols": s, "imports": i, "verification_targets": t}
    changed = spark.createDataFrame([("Brand#7",)], "relative_path string")
    return delta.merge_snapshot(side, side, changed)["imports"].select("fact_id").distinct()


@add("SELECT count(*) AS \"full\", count(*) FILTER (language = 'es') AS covered, floor(count(*) FILTER (language = 'es') * 100 / count(*))::BIGINT AS percent FROM files WHERE language IN ('es', 'de')", (A.FILES,))
def e21_scope_coverage(spark, d):
    f = A.files(spark, d)
    return delta.scope_coverage(f.where("language = 'es'"), f.where("language in ('es', 'de')")).select("full", "covered", "percent")


@add("SELECT list_sort(list(DISTINCT language)) AS languages FROM files", (A.FILES,))
def e2_languages(spark, d):
    return delta.languages(A.files(spark, d))


# --- alignment -------------------------------------------------------------------------------------------------------


def _signals_sql(side: str, imports: str, symbols: str) -> str:
    shape = """'tokens=' || len(string_split(name, ' ')) || ';pattern=' || array_to_string(list_transform(string_split(name, ' '), lambda t: CASE WHEN length(t) <= 3 THEN 's' WHEN length(t) <= 6 THEN 'm' ELSE 'l' END), '') || ';extra=0;digits=0'"""
    w = "OVER (PARTITION BY relative_path ORDER BY line_number, name, fact_id)"
    return f"""{side}_i AS (SELECT importer_path AS p, array_to_string(list_sort(list(DISTINCT language || ':' || import_spec || '->' || coalesce(resolved_path, '<unresolved>')))[:24], '|') AS s,
    array_to_string(list_sort(list_distinct(list_transform(list_sort(list(DISTINCT language || ':' || import_spec || '->' || coalesce(resolved_path, '<unresolved>')))[:24], lambda x: lower(regexp_extract(regexp_extract(x, '^[^:]*:(.*?)->', 1), '([^:/.]+)$', 1)))))[:16], '|') AS calls
  FROM {imports} GROUP BY 1),
{side}_r AS (SELECT resolved_path AS p, array_to_string(list_sort(list(DISTINCT language || ':' || importer_path || '->' || import_spec))[:24], '|') AS s FROM {imports} WHERE resolved_path IS NOT NULL GROUP BY 1),
{side}_c AS (SELECT relative_path AS p, string_agg(kind || ':' || n, '|' ORDER BY kind || ':' || n) AS s FROM (SELECT relative_path, kind, count(*) AS n FROM {symbols} GROUP BY ALL) GROUP BY 1),
{side} AS (
  SELECT f.*, coalesce(i.s, '') AS imports, coalesce(r.s, '') AS reverse, coalesce(c.s, '') AS context, 'kind=function|language=part|name_shape=' || shape AS declaration, coalesce(i.calls, '') AS calls,
    'function_count=' || cnt || ';prev=' || coalesce(prev, 'none') || ';next=' || coalesce(nxt, 'none') AS control, 'evidence=lexical_confirmed;line_bucket=' || line_number // 10 AS literals, lower(name) AS name_key, name || '@' || relative_path || ':' || line_number AS id
  FROM (SELECT *, {shape} AS shape, count(*) OVER (PARTITION BY relative_path) AS cnt, lag({shape}) {w} AS prev, lead({shape}) {w} AS nxt FROM {symbols} WHERE kind = 'function') f
  LEFT JOIN {side}_i i ON i.p = relative_path LEFT JOIN {side}_r r ON r.p = relative_path LEFT JOIN {side}_c c ON c.p = relative_path
)"""


_SIGNALS = (A.SYMBOLS, A.SYMBOLS_TWO, A.PART_IMPORTS, _IMPORTS_TWO, _signals_sql("rs", "iref", "sref"), _signals_sql("ts", "itgt", "stgt"))


def _signals(spark, d):
    (sr, st), (ir, it) = A.changed_symbols(spark, d), _imports_two(spark, d)
    return cut(align.function_signals(sr, ir), "signals"), cut(align.function_signals(st, it), "signals")


@add('SELECT id, declaration, calls, control, literals, imports AS import_signature, reverse AS reverse_import_signature, context AS symbol_context_signature, name_key FROM rs', _SIGNALS)
def h4_function_signals(spark, d):
    return _signals(spark, d)[0].select("id", "declaration", "calls", "control", "literals", "import_signature", "reverse_import_signature", "symbol_context_signature", "name_key")


# the window hash follows from the other signatures, so equality of behaviour needs none of it
_ORDER = "ORDER BY relative_path, line_number, name, fact_id"
_BEHAVIOUR = "language || '|' || declaration || '|' || calls || '|' || control || '|' || literals || '|' || imports || '|' || context"
_TIERS = f"""r1 AS (SELECT *, row_number() OVER (PARTITION BY relative_path, language, name {_ORDER}) AS n FROM rs), t1 AS (SELECT *, row_number() OVER (PARTITION BY relative_path, language, name {_ORDER}) AS n FROM ts),
p1 AS (SELECT r1.fact_id AS ref_id, t1.fact_id AS tgt_id FROM r1 JOIN t1 USING (relative_path, language, name, n)),
r2 AS (SELECT *, {_BEHAVIOUR} AS b, row_number() OVER (PARTITION BY {_BEHAVIOUR} {_ORDER}) AS n FROM rs WHERE fact_id NOT IN (SELECT ref_id FROM p1)), t2 AS (SELECT *, {_BEHAVIOUR} AS b, row_number() OVER (PARTITION BY {_BEHAVIOUR} {_ORDER}) AS n FROM ts WHERE fact_id NOT IN (SELECT tgt_id FROM p1)),
p2 AS (SELECT r2.fact_id AS ref_id, t2.fact_id AS tgt_id FROM r2 JOIN t2 USING (b, n)),
r3 AS (SELECT *, row_number() OVER (PARTITION BY language, name_key {_ORDER}) AS n FROM rs WHERE fact_id NOT IN (SELECT ref_id FROM p1 UNION ALL SELECT ref_id FROM p2)), t3 AS (SELECT *, row_number() OVER (PARTITION BY language, name_key {_ORDER}) AS n FROM ts WHERE fact_id NOT IN (SELECT tgt_id FROM p1 UNION ALL SELECT tgt_id FROM p2)),
p3 AS (SELECT r3.fact_id AS ref_id, t3.fact_id AS tgt_id FROM r3 JOIN t3 USING (language, name_key, n)),
pairs AS (SELECT *, 'exact_path_name' AS strategy, 100 AS score FROM p1 UNION ALL SELECT *, 'behavioral_profile_exact', 96 FROM p2 UNION ALL SELECT *, 'same_name_language', 85 FROM p3)"""


@add("SELECT * FROM pairs", (*_SIGNALS, _TIERS))
def h5_align_functions(spark, d):
    return align.align(*_signals(spark, d))


_SIMILARITY = """CAST(least(100, (CASE WHEN r.declaration = t.declaration THEN 24 ELSE 0 END) + (CASE WHEN r.calls <> '' AND r.calls = t.calls THEN 20 ELSE 0 END) + (CASE WHEN r.control = t.control THEN 10 ELSE 0 END)
  + (CASE WHEN r.literals = t.literals THEN 8 ELSE 0 END) + (CASE WHEN r.declaration = t.declaration AND r.calls = t.calls AND r.control = t.control AND r.literals = t.literals AND r.context = t.context THEN 16 ELSE 0 END)
  + (CASE WHEN r.imports <> '' AND r.imports = t.imports THEN 10 ELSE 0 END) + (CASE WHEN r.reverse <> '' AND r.reverse = t.reverse THEN 4 ELSE 0 END) + (CASE WHEN r.context <> '' AND r.context = t.context THEN 6 ELSE 0 END)
  + (CASE WHEN r.relative_path = t.relative_path THEN 4 ELSE 0 END) + 2 + (len(list_intersect(list_distinct(string_split(r.name_key, ' ')), list_distinct(string_split(t.name_key, ' ')))) * 20 + len(list_distinct(list_concat(string_split(r.name_key, ' '), string_split(t.name_key, ' ')))) // 2)
    // len(list_distinct(list_concat(string_split(r.name_key, ' '), string_split(t.name_key, ' '))))
  + (CASE WHEN abs(r.line_number - t.line_number) <= 3 THEN 3 WHEN abs(r.line_number - t.line_number) <= 12 THEN 2 ELSE 0 END)) AS INTEGER)"""
# every left-over function against every other of its language, then one pass in order over what scores enough
_BY_SCORE = f"""scored AS (
  SELECT r.fact_id AS ref_id, t.fact_id AS tgt_id, r.id AS ref_key, t.id AS tgt_key, {_SIMILARITY} AS score FROM rs r JOIN ts t ON r.language = t.language
  WHERE r.fact_id NOT IN (SELECT ref_id FROM pairs) AND t.fact_id NOT IN (SELECT tgt_id FROM pairs)
), candidate AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score DESC, ref_key, tgt_key, ref_id, tgt_id) AS k FROM scored WHERE score >= 65
), pass AS (
  SELECT CAST(0 AS BIGINT) AS k, CAST([] AS VARCHAR[]) AS refs, CAST([] AS VARCHAR[]) AS tgts, false AS paired
  UNION ALL
  SELECT k, CASE WHEN free THEN list_append(refs, ref_id) ELSE refs END, CASE WHEN free THEN list_append(tgts, tgt_id) ELSE tgts END, free
  FROM (SELECT c.k, refs, tgts, ref_id, tgt_id, NOT list_contains(refs, ref_id) AND NOT list_contains(tgts, tgt_id) AS free FROM pass JOIN candidate c ON c.k = pass.k + 1)
), all_pairs AS (SELECT *, 1 AS tier FROM pairs UNION ALL SELECT ref_id, tgt_id, 'signature_similarity', score, 2 FROM candidate JOIN pass USING (k) WHERE paired)"""


@add("SELECT ref_id, tgt_id, strategy, score FROM all_pairs", (*_SIGNALS, _TIERS, _BY_SCORE))
def h5_align_by_similarity(spark, d):
    """With the last, greedy tier over all left-over functions."""
    return align.align(*_signals(spark, d), signature_aware=True)


@add(
    "SELECT ref_id, tgt_id, 'exact_path_name' AS strategy, 100 AS score FROM p1 JOIN r1 ON ref_id = fact_id ORDER BY relative_path || '|' || language || '|' || name, n, ref_id, tgt_id LIMIT (SELECT count(*) // 4 FROM rs)",
    (*_SIGNALS, _TIERS),
)
def h5_align_at_most(spark, d):
    """The policy takes a quarter as many pairs as the reference has functions: the first of the first tier, which has more."""
    ref, tgt = _signals(spark, d)
    return align.align(ref, tgt, signature_aware=True, max_pairs=ref.count() // 4)


@add(
    f"SELECT ref_id, tgt_id, {_SIMILARITY} AS similarity FROM pairs JOIN rs r ON ref_id = r.fact_id JOIN ts t ON tgt_id = t.fact_id",
    (*_SIGNALS, _TIERS),
)
def h6_similarity(spark, d):
    """How alike the two functions of each pair are."""
    ref, tgt = _signals(spark, d)
    p = align.align(ref, tgt).alias("p").join(ref.alias("r"), F.col("p.ref_id") == F.col("r.fact_id")).join(tgt.alias("t"), F.col("p.tgt_id") == F.col("t.fact_id"))
    return p.select("ref_id", "tgt_id", align.similarity().alias("similarity"))


_REASONS = """reasons AS (SELECT ref_id, tgt_id, list_filter([CASE WHEN r.declaration <> t.declaration THEN 'declaration' END, CASE WHEN r.calls <> t.calls THEN 'calls' END, CASE WHEN r.control <> t.control THEN 'control' END, CASE WHEN r.literals <> t.literals THEN 'literals' END,
  CASE WHEN r.declaration <> t.declaration OR r.calls <> t.calls OR r.control <> t.control OR r.literals <> t.literals OR r.context <> t.context THEN 'window_hash' END, CASE WHEN r.imports <> t.imports THEN 'import_signature' END,
  CASE WHEN r.context <> t.context THEN 'symbol_context_signature' END, CASE WHEN r.relative_path = t.relative_path AND r.name_key = t.name_key AND t.relative_path = 'Brand#9' THEN 'modified_file' END], lambda x: x IS NOT NULL) AS reasons
FROM pairs JOIN rs r ON ref_id = r.fact_id JOIN ts t ON tgt_id = t.fact_id)"""


def _judged(spark, d):
    ref, tgt = _signals(spark, d)
    pairs = align.align(ref, tgt)
    return ref, tgt, pairs, align.difference_reasons(pairs, ref, tgt, spark.createDataFrame([("Brand#9",)], "relative_path string"))


@add("SELECT ref_id, tgt_id, reasons FROM reasons", (*_SIGNALS, _TIERS, _REASONS))
def h7_difference_reasons(spark, d):
    return _judged(spark, d)[3].select("ref_id", "tgt_id", "reasons")


@add(
    """SELECT count(*) AS pairs, count(*) FILTER (len(reasons) > 0) AS different, (SELECT count(*) FROM rs) - count(*) AS unmatched_reference, (SELECT count(*) FROM ts) - count(*) AS unmatched_target, 'observed_difference' AS status FROM reasons""",
    (*_SIGNALS, _TIERS, _REASONS),
)
def h8_relational_status(spark, d):
    ref, tgt, pairs, judged = _judged(spark, d)
    return align.relational_status(judged, align.unmatched(ref, pairs, "ref"), align.unmatched(tgt, pairs, "tgt"))


# --- obligations -----------------------------------------------------------------------------------------------------

_CONTRACT, _ENVIRONMENT = "contract-v1", ["a", "b"]
_PAIR_IDS = "ids AS (SELECT r.id AS ref, t.id AS tgt, strategy, score FROM pairs JOIN rs r ON ref_id = r.fact_id JOIN ts t ON tgt_id = t.fact_id)"
_OBLIGATIONS = """made AS (
  SELECT DISTINCT source_pair, why FROM (
    SELECT 'pair:' || ref || '=>' || tgt AS source_pair, 'alignment_strategy=' || strategy || '|alignment_score=' || score AS why FROM ids
    UNION ALL SELECT 'reference_only:' || id, 'target counterpart is missing under current alignment bounds' FROM rs WHERE fact_id NOT IN (SELECT ref_id FROM pairs)
    UNION ALL SELECT 'target_only:' || id, 'reference counterpart is missing under current alignment bounds' FROM ts WHERE fact_id NOT IN (SELECT tgt_id FROM pairs))
), seeds AS (SELECT *, 'contract=contract-v1;pair=' || source_pair || ';assumptions=a|b|' || why AS text FROM made)"""


def _fnv(text: str) -> str:
    return f"""lower(printf('%016x', list_reduce(list_prepend(14695981039346656037::HUGEINT, list_transform(range(1, octet_length(encode({text})) + 1), lambda i: ('0x' || substr(hex(encode({text})), 2 * i - 1, 2))::HUGEINT)),
    lambda h, b: (xor(h, b) * 1099511628211) % 18446744073709551616::HUGEINT)::UBIGINT))"""


def _made(spark, d):
    ref, tgt = _signals(spark, d)
    pairs = align.align(ref, tgt)
    ids = pairs.join(ref.select(F.col("fact_id").alias("ref_id"), F.col("id").alias("ref")), "ref_id").join(tgt.select(F.col("fact_id").alias("tgt_id"), F.col("id").alias("tgt")), "tgt_id")
    return ref, tgt, obligations.compile_obligations(ids, align.unmatched(ref, pairs, "ref"), align.unmatched(tgt, pairs, "tgt"), _CONTRACT, _ENVIRONMENT)


@add(f"SELECT source_pair, encoding_hash, 'thm_' || {_fnv('t2')} AS id FROM (SELECT source_pair, h AS encoding_hash, 'contract-v1|' || h AS t2 FROM (SELECT source_pair, {_fnv('text')} AS h FROM seeds))", (*_SIGNALS, _TIERS, _PAIR_IDS, _OBLIGATIONS))
def h12_h13_obligations(spark, d):
    """Obligations with the hash of what they say and their id."""
    return _made(spark, d)[2].select("source_pair", "encoding_hash", "id")


_PATH = lambda x: f"regexp_extract({x}, '^[^@]*@(.*):[^:]*$', 1)"
_SCHEDULED = f"""scheduled AS (SELECT source_pair, CASE WHEN starts_with(source_pair, 'pair:') THEN 1 ELSE 0 END AS priority,
  CASE WHEN starts_with(source_pair, 'pair:') THEN 'pair:' || least({_PATH("a")}, {_PATH("b")}) || '=>' || greatest({_PATH("a")}, {_PATH("b")})
    WHEN starts_with(source_pair, 'reference_only:') THEN 'reference:' || {_PATH("source_pair[16:]")} ELSE 'target:' || {_PATH("source_pair[13:]")} END AS partition
  FROM (SELECT source_pair, regexp_extract(source_pair, '^pair:(.*?)=>', 1) AS a, regexp_extract(source_pair, '=>(.*)$', 1) AS b FROM made))"""


@add("SELECT priority, partition, count(*) AS n FROM scheduled GROUP BY ALL", (*_SIGNALS, _TIERS, _PAIR_IDS, _OBLIGATIONS, _SCHEDULED))
def f11_schedule(spark, d):
    """All obligations in the order of their schedule, counted by priority and partition."""
    made = _made(spark, d)[2]
    return obligations.schedule(made, 10_000_000).groupBy("priority", "partition").agg(F.count("*").alias("n"))


@add(
    """SELECT source_pair, CASE WHEN NOT starts_with(source_pair, 'pair:') THEN 'refuted' WHEN r.declaration = t.declaration AND r.calls = t.calls AND r.control = t.control AND r.literals = t.literals AND r.imports = t.imports AND r.reverse = t.reverse
  AND r.context = t.context AND r.name_key = t.name_key THEN 'proved' ELSE 'refuted' END AS status
FROM made LEFT JOIN ids ON source_pair = 'pair:' || ref || '=>' || tgt LEFT JOIN (SELECT DISTINCT ON (id) * FROM rs) r ON r.id = ref LEFT JOIN (SELECT DISTINCT ON (id) * FROM ts) t ON t.id = tgt""",
    (*_SIGNALS, _TIERS, _PAIR_IDS, _OBLIGATIONS),
)
def h14_judge(spark, d):
    ref, tgt, made = _made(spark, d)
    return obligations.judge(made, ref, tgt).select("source_pair", "status")


@add(
    """SELECT source_pair, CAST(4 * close + 24 * de + 18 * ca + 10 * co + 8 * li + 16 * wi + 10 * im + 4 * re + 8 * cx + 12 * be + 6 * na AS INTEGER) AS model_score, 4 * close + 24 * de + 18 * ca + 10 * co + 8 * li + 16 * wi + 10 * im + 4 * re + 8 * cx + 12 * be + 6 * na >= 78 AND de = 1 AND wi = 1 AND be = 1 AND im + re > 0 AND close = 1 AS equivalent
FROM (SELECT *, CASE WHEN de + ca + co + li + cx = 5 THEN 1 ELSE 0 END AS wi, CASE WHEN de + ca + co + li + cx + im = 6 THEN 1 ELSE 0 END AS be FROM (
  SELECT 'pair:' || ref || '=>' || tgt AS source_pair, (abs(r.line_number - t.line_number) <= 12)::INT AS close, (r.declaration = t.declaration)::INT AS de, (r.calls = t.calls)::INT AS ca, (r.control = t.control)::INT AS co, (r.literals = t.literals)::INT AS li,
    (r.imports = t.imports)::INT AS im, (r.reverse = t.reverse)::INT AS re, (r.context = t.context)::INT AS cx, (r.name_key = t.name_key)::INT AS na
  FROM ids JOIN (SELECT DISTINCT ON (id) * FROM rs) r ON r.id = ref JOIN (SELECT DISTINCT ON (id) * FROM ts) t ON t.id = tgt))""",
    (*_SIGNALS, _TIERS, _PAIR_IDS),
)
def h15_pair_model(spark, d):
    ref, tgt, made = _made(spark, d)
    return obligations.pair_model(made, ref, tgt).join(made.select(F.col("id").alias("obligation_id"), "source_pair"), "obligation_id").select("source_pair", "model_score", "equivalent")


@add(
    """SELECT run, count(*) AS n, count(*) FILTER (status = 'proved') AS proved, count(*) FILTER (status = 'refuted') AS refuted, count(*) FILTER (status = 'inconclusive') AS inconclusive,
  CASE WHEN count(*) FILTER (status = 'refuted') > 0 THEN 'refuted_under_contract' WHEN count(*) FILTER (status = 'proved') = count(*) THEN 'proved_under_contract' ELSE 'inconclusive_under_contract' END AS run_status FROM certs GROUP BY run""",
    (A.CERTIFICATES,),
)
def e15_run_status(spark, d):
    return obligations.run_status(A.certificates(spark, d), ["run"])


@add(
    "SELECT run, count(*) FILTER (status = 'proved') AS proved, count(*) FILTER (status = 'refuted') AS refuted, count(*) FILTER (status = 'inconclusive') AS inconclusive, arg_min(witness, obligation_id) FILTER (witness IS NOT NULL) AS witness, 'rules' AS solver FROM certs GROUP BY run",
    (A.CERTIFICATES,),
)
def e17_stage_receipt(spark, d):
    return obligations.stage_receipt(A.certificates(spark, d), ["run"])


@add("SELECT run AS obligation_id, CASE WHEN count(DISTINCT status) = 1 THEN min(status) ELSE 'inconclusive' END AS status, count(DISTINCT status) > 1 AS flaky FROM certs GROUP BY run", (A.CERTIFICATES,))
def h17_stable_status(spark, d):
    """Runs of one source taken for repeated runs of one obligation."""
    return obligations.stable_status(A.certificates(spark, d).select(F.col("run").alias("obligation_id"), "status"))


@add(
    """SELECT base, translation, count(*) AS n, CASE WHEN translation = 'observed_difference' THEN 'refuted_under_contract' WHEN translation IN ('reference_snapshot_missing', 'inconclusive') AND base <> 'refuted_under_contract' THEN 'inconclusive_under_contract' ELSE base END AS status
FROM (SELECT status || '_under_contract' AS base, (['observed_difference', 'no_difference_observed', 'reference_snapshot_missing', 'inconclusive', NULL])[CAST(obligation_id AS BIGINT) % 5 + 1] AS translation FROM certs) GROUP BY base, translation""",
    (A.CERTIFICATES,),
)
def h18_with_translation(spark, d):
    """Statuses of runs with those of their translation, one of each for every certificate."""
    other = F.get(F.array(*[F.lit(x) for x in ("observed_difference", "no_difference_observed", "reference_snapshot_missing", "inconclusive")], F.lit(None).cast("string")), (F.col("obligation_id").cast("long") % 5).cast("int"))
    rows = A.certificates(spark, d).select(F.concat("status", F.lit("_under_contract")).alias("base"), other.alias("translation"))
    return rows.groupBy("base", "translation").agg(F.count("*").alias("n")).withColumn("status", obligations.with_translation("base", "translation"))


@add("SELECT obligation_id AS id, status FROM certs WHERE status <> 'inconclusive'", (A.CERTIFICATES,))
def a21_replay(spark, d):
    """Stored certificates joined to the obligations that are not inconclusive, each once."""
    c = A.certificates(spark, d)
    o = c.where("status <> 'inconclusive'").select(F.col("obligation_id").alias("id"), F.lit("h").alias("encoding_hash"))
    return obligations.replay(o, c.union(c)).select("id", "status")


@add(
    "SELECT obligation_id AS id, run AS source_pair, 'h' || obligation_id AS encoding_hash, status, status <> 'refuted' AS hash_matches FROM certs",
    (A.CERTIFICATES,),
)
def a20_a21_replayed_artifact(spark, d):
    """Obligations and certificates published as an artifact, read back and joined: refuted ones were certified by another hash."""
    c = A.certificates(spark, d)
    hashed = F.concat(F.lit("h"), "obligation_id")
    o = c.select(F.col("obligation_id").alias("id"), F.col("run").alias("source_pair"), F.lit("contract").alias("contract_id"), F.array(F.lit("a")).alias("assumptions"), hashed.alias("encoding_hash"))
    known = c.select("obligation_id", F.when(F.col("status") == "refuted", "other").otherwise(hashed).alias("encoding_hash"), "status", "solver", F.lit(5000).cast("long").alias("timeout_ms"), F.array().cast("array<string>").alias("assumptions"), "witness")
    root = scratch(spark, "artifacts")
    run = replay.write_replay(o, known, root, "reference", "target", "contract", {"max_obligations": 64}, "1")
    return obligations.replay(*replay.read_replay(spark, root, run)).select("id", "source_pair", "encoding_hash", "status", "hash_matches")
