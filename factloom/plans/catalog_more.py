"""Queries over receipts, documents, state, packs and bounded scopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import artifacts, brief, decisions, delta, evals, graph, lexical, lookup, obligations
from ..streaming import incremental
from . import adapters as A
from .registry import Registry

add = Registry()
QUERIES, ORACLES = add.queries, add.oracles


@add("SELECT language AS request_id, list_sort(list(DISTINCT relative_path)) AS receipt_ids FROM files WHERE contains(relative_path, 'doc_1') GROUP BY language", (A.FILES,))
def b19_matching_receipts(spark, d):
    """Receipts of each language's files whose locator holds a text."""
    f = A.files(spark, d)
    receipts = f.select(F.col("relative_path").alias("id"), F.lit("file_anchor").alias("source_type"), F.col("language").alias("source_ref"), F.col("relative_path").alias("locator"))
    wanted = f.select(F.col("language").alias("request_id"), F.col("language").alias("source_ref")).distinct().withColumn("source_type", F.lit("file_anchor")).withColumn("locator_part", F.lit("doc_1"))
    return lookup.matching_receipts(receipts, wanted)


@add(
    """SELECT lang AS request_id, kind, src, dst FROM (SELECT lang, 'documents' AS kind, 'file:' || doc AS src, 'file:' || relative_path AS dst FROM docs JOIN near USING (lang) UNION ALL SELECT lang, 'supports_decision', 'file:' || doc, 'scope:' || lang FROM docs)""",
    (A.FILES, "near AS (SELECT language AS lang, relative_path FROM (SELECT *, row_number() OVER (PARTITION BY language ORDER BY relative_path) AS n FROM files) WHERE n <= 3)", "docs AS (SELECT language AS lang, relative_path AS doc FROM files WHERE size_bytes > 9000)"),
)
def c8_document_edges(spark, d):
    """Long documents taken for decisions on their language's first files."""
    f = A.files(spark, d).withColumnRenamed("language", "request_id")
    requests = f.select("request_id", F.col("request_id").alias("target")).distinct()
    return graph.document_edges(f, f.where("size_bytes > 9000"), requests).select("request_id", "kind", "src", "dst")


@add("SELECT snapshot_id, sha256(concat_ws(':', snapshot_id, count(*), sum(('0x' || md5(relative_path || chr(0) || content_hash)[:15])::HUGEINT))) AS fingerprint FROM files GROUP BY snapshot_id", (A.FILES,))
def d6_fingerprint(spark, d):
    return lexical.fingerprint(A.files(spark, d))


@add(
    """SELECT relative_path, content_hash FROM tgt WHERE relative_path IN (SELECT relative_path FROM tgt) UNION SELECT relative_path, content_hash FROM ref WHERE relative_path NOT IN (SELECT relative_path FROM tgt)""",
    (A.FILES, A.TWO),
)
def a18_latest_wins(spark, d):
    """State by key: the target's rows over the reference's."""
    ref, tgt = A.two_snapshots(spark, d)
    return incremental.latest_wins(ref, tgt, ["relative_path"]).select("relative_path", "content_hash")


@add(
    """SELECT relative_path, (10 * 0) + 8 * len(list_filter(['src1', 'doc'], lambda t: contains(relative_path, t))) + 5 * len(list_filter(['en', 'fr'], lambda t: contains(relative_path, t))) + 3 * len(list_filter(['_1'], lambda t: contains(relative_path, t))) AS seed,
  25 * len(list_filter(['the', 'license'], lambda t: contains(lower(text), t))) + 10 * len(list_filter(['de'], lambda t: contains(lower(text), t))) AS score, len(list_filter(['src1', 'doc'], lambda t: contains(relative_path, t))) + len(list_filter(['_1'], lambda t: contains(relative_path, t))) > 0 AS keeps FROM files""",
    (A.FILES,),
)
def f4_f5_document_scores(spark, d):
    """Scores of every document by terms in its path and in its text."""
    f = A.files(spark, d)
    arr = lambda *v: F.array(*[F.lit(x) for x in v])
    text = F.lower("text")
    score = decisions.doc_score("relative_path", decisions.overlap(text, arr("the", "license")), decisions.overlap(text, arr("de")), F.lit(0))
    return f.select("relative_path", decisions.seed_score("relative_path", arr("src1", "doc"), arr("en", "fr"), arr("_1")).alias("seed"), score.alias("score"), decisions.keeps_fallback("relative_path", arr("src1", "doc"), arr("_1")).alias("keeps"))


_PACKS = """packs AS (SELECT language AS lang, list_sort(list(relative_path)) AS paths, (['weak_local_coder', 'medium_cloud_coder', 'frontier_agent', 'custom'])[1 + (ascii(language) % 4)] AS model FROM files GROUP BY language)"""


@add(
    """SELECT lang AS request_id, paths[:5] AS must_know, ['a', 'b', 'c'] AS verification_targets, CASE model WHEN 'weak_local_coder' THEN 'high' WHEN 'medium_cloud_coder' THEN 'medium' ELSE 'minimal' END AS scaffolding FROM packs""",
    (A.FILES, _PACKS),
)
def i13_compile_packs(spark, d):
    """Packs of each language's files, cut to five statements, with the scaffolding of a model's class."""
    model = F.get(F.array(*[F.lit(x) for x in ("weak_local_coder", "medium_cloud_coder", "frontier_agent", "custom")]), (F.ascii("request_id") % 4).cast("int"))
    packs = A.files(spark, d).groupBy(F.col("language").alias("request_id")).agg(F.array_sort(F.collect_list("relative_path")).alias("must_know")).withColumn("model_class", model).withColumn("max_items", F.lit(5))
    checks = packs.withColumn("required_checks", F.array(F.lit("a"), F.lit("b"))).withColumn("recommended_checks", F.array(F.lit("b"), F.lit("c")))
    return brief.compile_pack(checks).select("request_id", "must_know", "verification_targets", "scaffolding")


@add(
    """SELECT request_id, statement, confidence, freshness, row_number() OVER (PARTITION BY request_id ORDER BY n) AS place FROM (
  SELECT relative_path AS request_id, 0 AS n, 'Exact path `' || relative_path || '` is indexed as `en` at `' || relative_path || '` (' || size_bytes || ' bytes).' AS statement, 0.99 AS confidence, 'fresh' AS freshness FROM files WHERE language = 'en'
  UNION ALL SELECT relative_path, 1, 'Exact symbol `' || language || '` is defined in `' || relative_path || '`:7 as a `struct`.', 0.97, 'fresh' FROM files WHERE language IN ('en', 'de')
  UNION ALL SELECT relative_path, 3, 'Lexical anchors for `' || relative_path || '` matched 9 path(s): ' || content_hash || '.', 0.70, 'fresh' FROM files WHERE language NOT IN ('en', 'de')
  UNION ALL SELECT relative_path, 4, 'Direct structural adjacency from `' || relative_path || '` reaches 6 indexed file(s): 1, 2, 3, 4, and 2 more.', 0.82, 'fresh' FROM files WHERE size_bytes % 2 = 0
  UNION ALL SELECT relative_path, 5, 'Deterministic required checks are known for this scope: cargo test, cargo check.', 0.90, 'fresh' FROM files WHERE size_bytes > 2000
  UNION ALL SELECT relative_path, 6, 'Coverage audit for `bug_fix` is incomplete.', 0.72, 'unverified' FROM files WHERE size_bytes > 5000 UNION ALL SELECT relative_path, 7, 'no check', 0.88, 'unverified' FROM files WHERE size_bytes > 9000)""",
    (A.FILES,),
)
def f15_statements(spark, d):
    """What a reader of each file's brief must know, from signals that reach every rule."""
    none = F.array().cast("array<string>")
    many = lambda n: F.array(*[F.lit(str(k)) for k in range(1, n + 1)])
    f, size = A.files(spark, d), F.col("size_bytes")
    symbol = F.struct(F.col("language").alias("name"), "relative_path", F.lit(7).alias("line_number"), F.lit("struct").alias("kind"), F.col("relative_path").alias("fact_id"))
    signals = f.select(
        F.col("relative_path").alias("request_id"), F.col("relative_path").alias("scope"), F.when(F.col("language") == "en", F.struct("relative_path", "language", "size_bytes")).alias("path"), F.array_compact(F.array(F.when(F.col("language").isin("en", "de"), symbol))).alias("symbols"),
        F.array("content_hash").alias("hits"), F.lit(9).alias("n_hits"), F.when(size % 2 == 0, many(6)).otherwise(many(1)).alias("suggested"), F.when(size > 2000, F.array(F.lit("cargo test"), F.lit("cargo check"))).otherwise(none).alias("required_checks"),
        F.when(size > 9000, F.array(F.lit("no check"))).otherwise(none).alias("coverage_gaps"), F.lit("bug_fix").alias("classification"), (size <= 5000).alias("sufficient"), F.lit("fresh").alias("freshness"), none.alias("capsule_ids"),
    )
    return brief.statements(signals).select("request_id", "statement", F.col("confidence").cast("decimal(3,2)").alias("confidence"), "freshness", "place")


@add(
    """SELECT relative_path FROM (SELECT *, row_number() OVER (ORDER BY relative_path) AS n FROM (SELECT relative_path || '.rs' AS relative_path FROM changes)) WHERE n <= 96""",
    (A.FILES, A.TWO, "changes AS (SELECT coalesce(r.relative_path, t.relative_path) AS relative_path FROM ref r FULL JOIN tgt t ON r.relative_path = t.relative_path WHERE r.content_hash IS DISTINCT FROM t.content_hash)"),
)
def h9_bounded_scope(spark, d):
    """The first 96 changed files, taken for Rust sources."""
    ref, tgt = A.two_snapshots(spark, d)
    ends = lambda df: df.withColumn("relative_path", F.concat("relative_path", F.lit(".rs")))
    changed = delta.file_changes(ends(ref), ends(tgt))
    none = F.array().cast("array<string>")
    one = changed.agg(F.collect_list("relative_path").alias("changed_scope")).select("changed_scope", none.alias("modified_files"), none.alias("added_files"), none.alias("removed_files"))
    return artifacts.bounded_scope(one, A.symbols(spark, d), 96, 256)[0]


@add(
    r"""SELECT DISTINCT source AS manifest_path, regexp_extract(next, '^fn ([A-Za-z_]\w*)', 1) AS harness FROM (SELECT source, line, lead(line) OVER (PARTITION BY doc_id ORDER BY k) AS next FROM (
  SELECT doc_id, source, unnest(['#[kani::proof]', 'fn d' || doc_id || '() {}', 'fn other() {}']) AS line, unnest([1, 2, 3]) AS k FROM documents)) WHERE starts_with(line, '#[kani::proof')"""
)
def h10_harnesses(spark, d):
    """Proof harnesses of three made lines for each document."""
    doc = A.table(spark, d, "documents")
    lines = F.array(F.lit("#[kani::proof]"), F.concat(F.lit("fn d"), F.col("doc_id").cast("string"), F.lit("() {}")), F.lit("fn other() {}"))
    rows = doc.select(F.col("source").alias("manifest_path"), F.col("doc_id").cast("string").alias("relative_path"), F.posexplode(lines).alias("line_number", "line"))
    return obligations.harnesses(rows)


@add("SELECT run, round(CASE WHEN value <= 5 THEN CAST(k % 4 AS DOUBLE) ELSE (k % 4) / value END, 9) AS gain FROM obs", (A.OBSERVATIONS,))
def e14_gain_per_ms(spark, d):
    o = A.observations(spark, d)
    return o.select("run", F.round(evals.gain_per_ms(F.col("gained"), F.when(F.col("value") <= 5, 0.0).otherwise(F.col("value"))), 9).alias("gain"))


@add("SELECT name, relative_path, 'symbol:' || name || '@' || relative_path AS node, 'cargo test' || CASE WHEN relative_path = 'Brand#1' THEN '' ELSE ' (in ' || relative_path || ')' END AS chk FROM symbols", (A.SYMBOLS,))
def j15_render(spark, d):
    """Rendered nodes and checks of every symbol."""
    s = A.symbols(spark, d)
    where = F.when(F.col("relative_path") == "Brand#1", ".").otherwise(F.col("relative_path"))
    return s.select("name", "relative_path", graph.symbol_node("name", "relative_path").alias("node"), X.render_check(F.array(F.lit("cargo"), F.lit("test")), where).alias("chk"))
