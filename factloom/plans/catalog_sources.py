"""Queries over a source tree made from the documents, and SQL that says what its facts are.

Every document gives the files that its number's remainder names: sources of four languages that refer to each other, manifests,
and files that a scan leaves out. Nothing of the tree is in the test tables, so the SQL states each expected fact.
"""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import delta, graph, lexical, lookup
from ..sources import scan, store
from ..sources import tree as mounted
from ..sources.shared import scratch
from . import adapters as A
from . import reports as R
from .registry import Registry

add = Registry()
QUERIES, ORACLES = add.queries, add.oracles

# Paths and texts by remainder of the document's number; {n}, {n1}, {n8} are it, the one before or after, and that plus 8.
_RUST = "use crate::m{n8}::thing;\nmod m{n16};\n// fn hidden() {}\npub async fn f{n}() {\n}\npub(crate) struct S{n};\n#[cfg(test)]\nmod tests {\n    fn t{n}() {}\n}\n  const fn after_{n}() {}\npub enum E{n} { A }\n"
_PYTHON = "from .m{n8} import x\n# def no(): pass\nclass C{n}:\n    async def go_{n}(self):\n        return 1\n"
_TS = "import { a } from './m{n8}.js'\nexport interface I{n} {}\nexport default async function g{n}() {}\nconst q = require(\"./j{n1}\")\nexport const enum K{n} {}\n"
_JS = "class J{n} {}\nimport './m{n0}.ts'\n/* function no() {} */\n"
_FILES = (
    (0, "{s}/src/m{n}.rs", _RUST), (1, "{s}/src/pkg/m{n}.py", _PYTHON), (2, "{s}/web/m{n}.ts", _TS), (3, "{s}/web/j{n}.js", _JS),
    (4, "{s}/c{n}/Cargo.toml", '[package]\nname = "crate{n}"\n'), (5, "{s}/p{n}/package.json", '{"name": "web{n}", "scripts": {"typecheck": "tsc"}}'),
    (6, "{s}/y{n}/pyproject.toml", '[project]\n# name = "no"\nname = "lib{n}"\n[tool.mypy]\n[tool.ruff]\n'), (6, "{s}/y{n}/src/a.py", ""), (6, "{s}/y{n}/tests/t.py", ""),
    (7, "{s}/node_modules/x{n}.js", "function no() {}"), (7, "{s}/.env.{n}", "SECRET=1"), (7, "{s}/i{n}.PNG", "x"), (7, "{s}/docs/d{n}.md", "# d{n}\n"), (7, "{s}/bad{n}.rs", "\xff"),
)
_ROOT = (("Cargo.toml", "[workspace]\nmembers = []\n"), ("src/rust/xtask/Cargo.toml", '[package]\nname = "xtask"\n'), ("package.json", '{"scripts": {"quality:check": "x"}}'))


def tree(spark, d):
    """snapshot_id, relative_path, size_bytes and content of the made files, those left out among them."""
    n = F.col("doc_id")
    values = {"{s}": F.col("source"), "{n}": n, "{n0}": n - 1, "{n1}": n + 1, "{n8}": n + 8, "{n16}": n + 16}

    def filled(text: str):
        out = F.lit(text)
        for name, value in values.items():
            out = F.replace(out, F.lit(name), value.cast("string"))
        return out

    made = F.array(*[F.struct(F.lit(k).alias("k"), filled(path).alias("p"), (F.lit(b"\xff") if text == "\xff" else filled(text).cast("binary")).alias("c")) for k, path, text in _FILES])
    rows = A.table(spark, d, "documents").where("doc_id is not null and source is not null").select("doc_id", F.col("source"), F.explode(made).alias("x")).where("x.k = doc_id % 8").select(F.col("x.p").alias("relative_path"), F.col("x.c").alias("content"))
    root = spark.createDataFrame([(p, bytearray(t.encode())) for p, t in _ROOT], "relative_path string, content binary")
    return rows.union(root).select(F.lit("tree").alias("snapshot_id"), "relative_path", F.octet_length("content").cast("long").alias("size_bytes"), "content")


def facts(spark, d):
    rows = tree(spark, d)
    return scan.facts_of(rows.where(scan.included("relative_path", "size_bytes")))


def _kept_facts(spark, d):
    """The stored tables' facts, extracted once for all that is written from them."""
    found = facts(spark, d)
    return {n: graph.cut(found[n], n) for n in store.FACTS}


def _sql(text: str) -> str:
    """A path or text as SQL over doc (n, s)."""
    out = "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    for name, value in {"{s}": "s", "{n}": "n", "{n0}": "(n - 1)", "{n1}": "(n + 1)", "{n8}": "(n + 8)", "{n16}": "(n + 16)"}.items():
        out = out.replace(name, f"' || {value} || '")
    return out


_DOC = "doc AS (SELECT doc_id AS n, source AS s FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL)"
_KEPT = [(k, p, t) for k, p, t in _FILES if "node_modules" not in p and ".env" not in p and ".PNG" not in p]
_TREE = "tree AS (\n" + " UNION ALL ".join(f"SELECT {_sql(p)} AS relative_path, {1 if t == chr(255) else f'octet_length(encode({_sql(t)}))'} AS size_bytes FROM doc WHERE n % 8 = {k}" for k, p, t in _KEPT) + "".join(f" UNION ALL SELECT {_sql(p)}, octet_length(encode({_sql(t)}))" for p, t in _ROOT) + "\n)"
_LANGUAGES = "CASE extension WHEN 'js' THEN 'javascript' WHEN 'json' THEN 'json' WHEN 'md' THEN 'markdown' WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' WHEN 'toml' THEN 'toml' WHEN 'ts' THEN 'typescript' END"


@add(f"SELECT relative_path, extension, {_LANGUAGES} AS language, size_bytes FROM (SELECT *, regexp_extract(relative_path, '\\.([a-z]+)$', 1) AS extension FROM tree)", (_DOC, _TREE))
def a1_a2_a4_scan(spark, d):
    """The files of a scan: excluded folders, names and extensions left out, languages by extension."""
    return facts(spark, d)["files"].select("relative_path", "extension", "language", "size_bytes")


@add(f"SELECT relative_path, extension, {_LANGUAGES} AS language, size_bytes FROM (SELECT *, regexp_extract(relative_path, '\\.([a-z]+)$', 1) AS extension FROM tree)", (_DOC, _TREE))
def a1_a2_mounted_tree(spark, d):
    """The made files written to a folder by the tasks that make them, and scanned there by the source of trees."""
    root = mounted.local_path(scratch(spark, "tree"))

    def written(parts):
        for rows in parts:
            for path, content in zip(rows["relative_path"], rows["content"], strict=True):
                os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
                with open(f"{root}/{path}", "wb") as f:
                    f.write(content)
            yield rows[["relative_path"]]

    tree(spark, d).select("relative_path", "content").mapInPandas(written, "relative_path string").write.format("noop").mode("overwrite").save()
    return scan.scan(spark, root, "tree")["files"].select("relative_path", "extension", "language", "size_bytes")


# line, kind and name of every declaration, by remainder
_DECLARED = (
    (0, 2, "module", "m{n16}"), (0, 4, "function", "f{n}"), (0, 6, "struct", "S{n}"), (0, 11, "function", "after_{n}"), (0, 12, "enum", "E{n}"), (1, 3, "class", "C{n}"), (1, 4, "function", "go_{n}"),
    (2, 2, "interface", "I{n}"), (2, 3, "function", "g{n}"), (2, 5, "enum", "K{n}"), (3, 1, "class", "J{n}"),
)
_PATHS = {k: p for k, p, _ in _FILES[:4]}
_NAMES = {0: "rust", 1: "python", 2: "typescript", 3: "javascript"}
_SYMBOLS = "syms AS (\n" + " UNION ALL ".join(f"SELECT {_sql(_PATHS[k])} AS relative_path, '{_NAMES[k]}' AS language, {line} AS line_number, '{kind}' AS kind, {_sql(name)} AS name FROM doc WHERE n % 8 = {k}" for k, line, kind, name in _DECLARED) + "\n)"


@add("SELECT relative_path, language, line_number, kind, name, lower('sym_' || language || '_' || regexp_replace(relative_path, '[^0-9A-Za-z]', '_', 'g') || '_' || line_number || '_' || kind || '_' || name) AS fact_id FROM syms", (_DOC, _SYMBOLS))
def a6_j11_j14_m2_symbols(spark, d):
    """Declarations of four languages: comments, test modules and modifiers aside."""
    return facts(spark, d)["symbols"].select("relative_path", "language", "line_number", "kind", "name", F.lower("fact_id").alias("fact_id"))


# line, kind, spec and what it resolves to if that document is of the same source
_IMPORTED = (
    (0, 1, "use", "crate::m{n8}::thing", 8, "{s}/src/m{n8}.rs"), (0, 2, "module", "m{n16}", 16, "{s}/src/m{n16}.rs"), (0, 8, "module", "tests {", 0, ""), (1, 1, "python_from", ".m{n8}", 8, "{s}/src/pkg/m{n8}.py"),
    (2, 1, "js_import", "./m{n8}.js", 8, "{s}/web/m{n8}.ts"), (2, 4, "require", "./j{n1}", 1, "{s}/web/j{n1}.js"), (3, 2, "js_import", "./m{n0}.ts", -1, "{s}/web/m{n0}.ts"),
)
_IMPORTS = "imps AS (\n" + " UNION ALL ".join(
    f"SELECT {_sql(_PATHS[k])} AS importer_path, '{_NAMES[k]}' AS language, {line} AS line_number, '{kind}' AS kind, {_sql(spec)} AS import_spec, "
    + (f"CASE WHEN EXISTS (SELECT 1 FROM doc o WHERE o.n = doc.n + {at} AND o.s = doc.s) THEN {_sql(to)} END" if to else "CAST(NULL AS VARCHAR)")
    + f" AS resolved_path FROM doc WHERE n % 8 = {k}"
    for k, line, kind, spec, at, to in _IMPORTED
) + "\n)"


@add("SELECT * FROM imps", (_DOC, _IMPORTS))
def c19_j13_m3_imports(spark, d):
    """Imports of four languages, and the files that they resolve to."""
    return facts(spark, d)["imports"].select("importer_path", "language", "line_number", "kind", "import_spec", "resolved_path")


_CHECKS = (
    (4, "cargo tests for crate{n}", "{s}/c{n}", "cargo test", "test", "required"), (4, "cargo check for crate{n}", "{s}/c{n}", "cargo check", "typecheck", "recommended"), (5, "typecheck for web{n}", "{s}/p{n}", "pnpm typecheck", "typecheck", "required"),
    (6, "unit tests for lib{n}", "{s}/y{n}", "python -m unittest discover tests", "test", "required"), (6, "mypy for lib{n}", "{s}/y{n}", "python -m mypy --config-file pyproject.toml src tests", "typecheck", "recommended"),
    (6, "ruff for lib{n}", "{s}/y{n}", "python -m ruff check src tests", "quality", "recommended"),
)
_ROOT_CHECKS = (
    ("repo-native quality", "", "cargo xtask quality", "quality", "recommended"), ("repo-native full check", "", "cargo xtask check", "quality", "recommended"), ("root quality check", "", "pnpm quality:check", "quality", "recommended"),
    ("cargo tests for xtask", "src/rust/xtask", "cargo test", "test", "required"), ("cargo check for xtask", "src/rust/xtask", "cargo check", "typecheck", "recommended"),
)
_TARGETS = "goals AS (\n" + " UNION ALL ".join(f"SELECT {_sql(label)} AS label, {_sql(scope)} AS scope_root, {_sql(scope)} AS working_directory, '{command}' AS command, '{kind}' AS kind, '{priority}' AS priority FROM doc WHERE n % 8 = {k}" for k, label, scope, command, kind, priority in _CHECKS) + "".join(f" UNION ALL SELECT '{label}', '{scope}', '{scope or '.'}', '{command}', '{kind}', '{priority}'" for label, scope, command, kind, priority in _ROOT_CHECKS) + "\n)"


@add("SELECT * FROM goals", (_DOC, _TARGETS))
def a10_a16_j23_verification_targets(spark, d):
    """What the manifests say can be checked: workspace, crates, packages and projects."""
    return facts(spark, d)["verification_targets"].select("label", "scope_root", "working_directory", F.array_join("command", " ").alias("command"), "kind", "priority")


@add("SELECT 'files' AS part, count(*) AS n FROM tree UNION ALL SELECT 'symbols', count(*) FROM syms UNION ALL SELECT 'imports', count(*) FROM imps UNION ALL SELECT 'verification_targets', count(*) FROM goals", (_DOC, _TREE, _SYMBOLS, _IMPORTS, _TARGETS))
def a7_a8_snapshot_round_trip(spark, d):
    """A snapshot written and read again, next to another one that is not read."""
    root = scratch(spark, "snapshots")
    found = _kept_facts(spark, d)
    store.write_snapshot(found, root)
    store.write_snapshot({n: found[n].withColumn("snapshot_id", F.lit("other")) for n in store.FACTS}, root)
    back = store.read_snapshot(spark, root, "tree")
    out = None
    for n in store.FACTS:
        rows = back[n].agg(F.lit(n).alias("part"), F.count("*").alias("n"))
        out = rows if out is None else out.union(rows)
    return out


@add(
    """SELECT 'files' AS part, relative_path AS a, NULL AS b, NULL AS c, size_bytes AS n FROM tree UNION ALL SELECT 'symbols', relative_path, name, kind, line_number FROM syms
UNION ALL SELECT 'imports', importer_path, import_spec, resolved_path, line_number FROM imps UNION ALL SELECT 'verification_targets', scope_root, label, kind, NULL FROM goals""",
    (_DOC, _TREE, _SYMBOLS, _IMPORTS, _TARGETS),
)
def a7_a8_round_trip_by_value(spark, d):
    """Every fact of a snapshot that was written and read again, and written twice."""
    root = scratch(spark, "snapshots")
    found = _kept_facts(spark, d)
    for _ in range(2):
        store.write_snapshot(found, root)
    back = store.read_snapshot(spark, root, "tree")
    none = F.lit(None).cast("string")
    row = lambda part, *columns: back[part].select(F.lit(part).alias("part"), *[(F.col(c) if isinstance(c, str) else c).alias(x) for c, x in zip(columns, "abcn", strict=True)])
    out = row("files", "relative_path", none, none, "size_bytes").union(row("symbols", "relative_path", "name", "kind", "line_number"))
    return out.union(row("imports", "importer_path", "import_spec", "resolved_path", "line_number")).union(row("verification_targets", "scope_root", "label", "kind", F.lit(None).cast("long")))


@add(
    "SELECT 'files' AS part, relative_path AS key, CAST(1 AS BIGINT) AS n, true AS skips FROM (SELECT max(relative_path) AS relative_path FROM tree) UNION ALL SELECT 'symbols', name, n, true FROM (SELECT name, count(*) AS n FROM syms WHERE name = (SELECT max(name) FROM syms) GROUP BY name)",
    (_DOC, _TREE, _SYMBOLS),
)
def a23_b7_stored_lookups(spark, d):
    """The last path and the last name looked up in a stored snapshot, whose scans leave out what cannot hold them."""
    root = scratch(spark, "snapshots")
    store.write_snapshot(facts(spark, d), root, 16)
    out = None
    for name in ("files", "symbols"):
        all_ = store.read_snapshot(spark, root, "tree")[name]
        key = store.ORDER[name][0]
        found = store.lookup(spark, root, name, "tree", all_.agg(F.max(key)).first()[0])
        found.collect()
        one = found.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "key", "n", F.lit(store.rows_read(found) * 4 < all_.count()).alias("skips"))
        out = one if out is None else out.union(one)
    return out


@add(
    """SELECT 'cargo test (in ' || working_directory || ') [scope:' || scope_root || ']' AS target, 'removed' AS change FROM goals WHERE command = 'cargo test' UNION
SELECT 'cargo test (in ' || working_directory || ') [scope:' || scope_root || '/src]', 'added' FROM goals WHERE command = 'cargo test'""",
    (_DOC, _TARGETS),
)
def g4_target_changes(spark, d):
    """Checks of every manifest: in the target, tests of crates have a narrower scope."""
    t = facts(spark, d)["verification_targets"]
    tests = F.array_join("command", " ") == "cargo test"
    return delta.target_changes(t, t.withColumn("scope_root", F.when(tests, F.concat("scope_root", F.lit("/src"))).otherwise(F.col("scope_root"))))


@add("SELECT doc_id, regexp_replace(source || '/' || lang || '.' || doc_id, '[^0-9A-Za-z_-]', '_', 'g') AS label, 'root::' || coalesce(lang, 'worktree') AS snapshot, concat('root::', coalesce(lang, 'worktree'), CASE WHEN doc_id % 2 = 0 THEN '::overlay' ELSE '::base' END) AS fingerprint FROM documents")
def a9_i10_labels(spark, d):
    """Names of artifacts and snapshots from revisions."""
    doc = A.table(spark, d, "documents")
    revision = F.concat("source", F.lit("/"), "lang", F.lit("."), F.col("doc_id").cast("string"))
    return doc.select("doc_id", X.artifact_label(revision).alias("label"), X.snapshot_id(F.lit("root"), "lang").alias("snapshot"), X.snapshot_fingerprint(F.lit("root"), "lang", F.col("doc_id") % 2 == 0).alias("fingerprint"))


@add("SELECT relative_path, regexp_extract(relative_path, '[^/]+$') IN ('Cargo.toml', 'package.json', 'pyproject.toml') OR contains('/' || relative_path || '/', '/tests/') AS affects FROM tree", (_DOC, _TREE))
def b17_affects_verification(spark, d):
    f = facts(spark, d)["files"]
    return f.select("relative_path", lookup.affects_verification("relative_path").alias("affects"))


@add("SELECT relative_path FROM (SELECT DISTINCT relative_path FROM changes ORDER BY 1 LIMIT 50)", (A.FILES, A.TWO, "changes AS (SELECT coalesce(r.relative_path, t.relative_path) AS relative_path FROM ref r FULL JOIN tgt t ON r.relative_path = t.relative_path WHERE r.content_hash IS DISTINCT FROM t.content_hash)"))
def f19_scope_cap(spark, d):
    """The first 50 paths that two snapshots' differences touch."""
    files = delta.file_changes(*A.two_snapshots(spark, d))
    none = files.where("false")
    symbols = none.select("relative_path")
    imports = none.select(F.col("relative_path").alias("importer_path"), F.col("relative_path").alias("resolved_path"))
    return delta.changed_scope(files, symbols, imports, 50)


_WORDS = r"""words AS (SELECT relative_path, unnest(list_filter(regexp_split_to_array(lower(strip_accents(relative_path || chr(10) || text)), '[^\p{L}\p{N}]+'), lambda t: t <> '')) AS term FROM tgt)"""


@add("SELECT relative_path, count(DISTINCT term) AS terms, count(*) AS uses, count(*) AS length FROM words GROUP BY relative_path", (A.FILES, "tgt AS (SELECT * REPLACE (CASE WHEN language = 'es' THEN text || ' x' ELSE text END AS text) FROM files WHERE language <> 'fr')", _WORDS))
def d8_k2_synced_index(spark, d):
    """An index of one snapshot brought to another by what differs: inserted, replaced and deleted documents."""
    f = A.files(spark, d)
    old = f.where("language <> 'de'")
    new = f.where("language <> 'fr'").withColumn("text", F.when(F.col("language") == "es", F.concat("text", F.lit(" x"))).otherwise(F.col("text"))).withColumn("content_hash", F.md5(F.col("text").cast("binary")))
    docs = lambda x: x.select("snapshot_id", "relative_path", lexical.body("relative_path", "text").alias("body"))
    index = lexical.apply_sync(lexical.build_index(docs(old)), docs(new), lexical.sync_plan(old, new))
    uses = index["postings"].groupBy("relative_path").agg(F.count("*").alias("terms"), F.sum("tf").alias("uses"))
    return uses.join(index["lengths"].select("relative_path", "length"), "relative_path")


@add("SELECT count(*) AS postings FROM (SELECT DISTINCT relative_path, term FROM words)", (A.FILES, "tgt AS (SELECT * FROM files)", _WORDS))
def d10_invalidated_index(spark, d):
    """An index of two snapshots without one of them."""
    f = A.files(spark, d)
    docs = lambda x: x.select("snapshot_id", "relative_path", lexical.body("relative_path", "text").alias("body"))
    index = lexical.build_index(docs(f).union(docs(f.withColumn("snapshot_id", F.lit("gone")))))
    return lexical.invalidate(index, "gone")["postings"].agg(F.count("*").alias("postings"))


# --- reports ---------------------------------------------------------------------------------------------------------


def brand_facts(spark, d):
    """Brands as files, for reports: their symbols and imports, and a required check of the first brand."""
    s, i = A.symbols(spark, d), A.part_imports(spark, d)
    rows = [("parts", "all", "", ".", ["cargo", "xtask", "check"], "quality", "recommended"), ("parts", "one", "Brand#1", "Brand#1", ["cargo", "test"], "test", "required")]
    targets = spark.createDataFrame(rows, "snapshot_id string, label string, scope_root string, working_directory string, command array<string>, kind string, priority string")
    return {"files": s.select("relative_path").distinct(), "symbols": s, "imports": i, "verification_targets": targets}


def brand_requests(spark, d):
    """Every brand and every name as a target."""
    s = A.symbols(spark, d)
    return s.select(F.col("relative_path").alias("target")).union(s.select("name")).distinct().select(F.col("target").alias("request_id"), "target")


@add(
    R.PLACED,
    (A.SYMBOLS, A.PART_IMPORTS, R.CALLS, R.REPORT, R.RELATED),
)
def c12_report_relationships(spark, d):
    """Relationships of the blast radius of every brand and every name, in order."""
    report = graph.blast_radius(brand_requests(spark, d), brand_facts(spark, d))
    return report["relationships"].select("request_id", "kind", "src", "dst", "place")


@add(
    """SELECT t AS request_id, 'scope around `' || t || '` remains bounded to snapshot-confirmed direct imports and reverse importers' AS invariant FROM (SELECT DISTINCT t FROM seeds)
UNION SELECT t, 'symbol `' || name || '` remains defined at `' || relative_path || '`:' || line_number FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY relative_path, line_number, name, fact_id) AS n FROM named) WHERE n <= 4
UNION SELECT t, 'anchor path `' || p || '` remains part of the scoped change envelope' FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY p) AS n FROM seeds) WHERE n <= 4
UNION SELECT t, x FROM (SELECT *, row_number() OVER (PARTITION BY t ORDER BY x) AS n FROM (SELECT DISTINCT t, 'direct structural edge `' || importer_path || '` -> `' || resolved_path || '` remains intact' AS x FROM touching)) WHERE n <= 6
UNION SELECT t, 'required verification remains passing: `' || chk || '`' FROM checks WHERE part = 0""",
    (A.SYMBOLS, A.PART_IMPORTS, R.REPORT),
)
def f14_invariants(spark, d):
    """What must stay true around every brand and every name."""
    return graph.blast_radius(brand_requests(spark, d), brand_facts(spark, d), related=False)["invariants"]


_STEPS = "steps AS (SELECT t, list(summary ORDER BY CASE kind WHEN 'defines' THEN 2 WHEN 'imports' THEN 3 WHEN 'references' THEN 4 WHEN 'calls' THEN 5 WHEN 'builds' THEN 6 ELSE 7 END, src, dst, summary) AS xs FROM related GROUP BY t)"
_POINTS = "points AS (SELECT t, list_sort(list(DISTINCT 'symbol:' || name || '@' || relative_path)) AS es FROM named GROUP BY t), mods AS (SELECT t, list_sort(list(DISTINCT p)) AS ms FROM near GROUP BY t)"


@add(
    """SELECT t AS request_id, 'structural flow around `' || t || '`' AS name, coalesce(es, list_transform(ms, lambda m: 'file:' || m))[:4] AS entrypoints, ms[:6] AS core_modules, xs[:6] AS transitions,
  CASE WHEN req THEN [] ELSE ['no deterministic required checks were discovered for this blast radius; narrow scope or add manual verification'] END AS failure_modes, CASE WHEN req THEN ['cargo test (in Brand#1)'] ELSE [] END AS tests,
  len(ms) + coalesce(len(es), 0) AS impacted_nodes, len(xs) AS relationships, CASE WHEN req THEN ['cargo test (in Brand#1)', 'cargo xtask check'] ELSE ['cargo xtask check'] END AS verification_targets
FROM mods LEFT JOIN points USING (t) JOIN steps USING (t) JOIN (SELECT t, bool_or(part = 0) AS req FROM checks GROUP BY t) USING (t)""",
    (A.SYMBOLS, A.PART_IMPORTS, R.CALLS, R.REPORT, R.RELATED, _STEPS, _POINTS),
)
def f20_i19_explain_flow(spark, d):
    """The trace of every brand's and name's flow at standard depth."""
    found = graph.explain_flow(brand_requests(spark, d), brand_facts(spark, d))
    return found.select("request_id", "name", "entrypoints", "core_modules", "transitions", "failure_modes", "tests", "impacted_nodes", "relationships", "verification_targets")


@add(
    """SELECT t AS request_id, 'structural flow around `' || t || '`: ' || array_to_string(coalesce(es, list_transform(ms, lambda m: 'file:' || m)), ', ') || '; ' || array_to_string(CASE WHEN len(xs) > 2 THEN list_append(xs[:2], 'and ' || (len(xs) - 2) || ' more') ELSE xs END, ', ') AS line
FROM mods LEFT JOIN points USING (t) JOIN steps USING (t)""",
    (A.SYMBOLS, A.PART_IMPORTS, R.CALLS, R.REPORT, R.RELATED, _STEPS, _POINTS),
)
def i18_rendered_capsules(spark, d):
    """A line for the flow of every brand and name."""
    return graph.render_capsule(graph.blast_radius(brand_requests(spark, d), brand_facts(spark, d))["capsules"])


@add(
    """SELECT t AS request_id, t AS reference, 'Snapshot-backed exact and structural lookup suggests ' || len(ms) || ' indexed file(s) are relevant to `' || t || '`.' AS summary, ms AS changed_scope,
  CASE WHEN len(ms) <= 1 THEN 'none' WHEN len(ms) <= 4 THEN 'localized' WHEN len(ms) <= 8 THEN 'moderate' ELSE 'high' END AS freshness_impact FROM mods""",
    (A.SYMBOLS, A.PART_IMPORTS, R.REPORT, _POINTS),
)
def i18_impact_summaries(spark, d):
    from ..operators import brief

    asked, held = brand_requests(spark, d), brand_facts(spark, d)
    paths = graph.impacted_paths(lookup.seed_paths(held["files"], held["symbols"], asked), held["imports"])
    suggested = paths.groupBy("request_id").agg(F.array_sort(F.collect_set("relative_path")).alias("suggested_files"))
    return brief.impact_summary(suggested, asked.select("request_id", F.col("target").alias("scope")))


@add("SELECT language AS request_id, 'ev_' || relative_path AS id FROM files WHERE doc_no % 3 = 0 AND doc_no % 2 = 0", (A.FILES.replace("files AS (", "files AS (\n  SELECT *, CAST(regexp_extract(relative_path, '_(\\d+)\\.md$', 1) AS BIGINT) AS doc_no FROM (", 1)[:-1] + "))",))
def b20_check_receipts(spark, d):
    """Receipts of every third file taken for a check, of which half are of another type."""
    f = A.files(spark, d).withColumn("n", F.regexp_extract("relative_path", r"_(\d+)\.md$", 1).cast("long"))
    receipts = f.select(F.concat(F.lit("ev_"), "relative_path").alias("id"), F.when(F.col("n") % 2 == 0, "verification_target").otherwise("file_anchor").alias("source_type"), F.concat(F.lit(" "), "relative_path").alias("source_ref"))
    checks = f.where("n % 3 = 0").select(F.col("language").alias("request_id"), F.concat("relative_path", F.lit("  ")).alias("check"))
    return lookup.check_receipts(receipts, checks.union(checks))


@add(
    r"""SELECT p AS given, CASE WHEN error IS NULL THEN nullif(path, '') END AS path, error FROM (SELECT p, path, CASE WHEN outside THEN 'outside root' WHEN up THEN 'parent traversal' END AS error FROM (
  SELECT doc_id % 6 AS k, CASE doc_id % 6 WHEN 0 THEN '  /repo/src\d' || doc_id || '.rs ' WHEN 1 THEN './././a/d' || doc_id || '/' WHEN 2 THEN '/other/d' || doc_id WHEN 3 THEN 'a/../d' || doc_id WHEN 4 THEN '   ' ELSE '/repo' END AS p,
    CASE doc_id % 6 WHEN 0 THEN 'src/d' || doc_id || '.rs' WHEN 1 THEN 'a/d' || doc_id ELSE '' END AS path, doc_id % 6 = 2 AS outside, doc_id % 6 = 3 AS up FROM documents))"""
)
def j22_changed_paths(spark, d):
    """Paths as callers give them: absolute ones, other slashes, dots, nothing at all."""
    n = F.col("doc_id").cast("string")
    k = F.col("doc_id") % 6
    given = F.when(k == 0, F.concat(F.lit("  /repo/src\\d"), n, F.lit(".rs "))).when(k == 1, F.concat(F.lit("./././a/d"), n, F.lit("/"))).when(k == 2, F.concat(F.lit("/other/d"), n)).when(k == 3, F.concat(F.lit("a/../d"), n)).when(k == 4, F.lit("   ")).otherwise("/repo")
    return A.table(spark, d, "documents").select(given.alias("given")).select("given", X.changed_path("/repo/", "given").alias("x")).select("given", "x.path", "x.error")


@add("SELECT run AS event_id, value AS cost, CASE WHEN k % 3 = 0 THEN NULL ELSE k END AS n FROM obs", (A.OBSERVATIONS,))
def j18_detail_metrics(spark, d):
    """Numbers read back from detail texts; one in three has a count that is no number."""
    k = F.get_json_object("props", "$.k").cast("long")
    detail = F.concat(F.lit("mode=x; cost_ms="), F.col("value").cast("string"), F.lit(" ;n="), F.when(k % 3 == 0, F.lit("-1")).otherwise(k.cast("string")), F.lit("; n=x"))
    return A.table(spark, d, "events").select("event_id", X.detail_metric(detail, "cost_ms=").alias("cost"), X.detail_metric(detail, "n=", whole=True).alias("n"))


@add(
    r"""SELECT relative_path, CASE WHEN length(t) > 512 THEN t[:512] || '...' ELSE t END AS output, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[1] AS first
FROM (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t FROM (SELECT relative_path, replace(text, chr(13) || chr(10), chr(10)) AS text FROM files))""",
    (A.FILES,),
)
def j24_command_outputs(spark, d):
    """Every text taken for what a command said."""
    return A.files(spark, d).select("relative_path", X.command_output("text").alias("output"), X.first_line("text").alias("first"))


@add("SELECT language, array_to_string(list_append(ps[:3], '... +' || (len(ps) - 3)), ', ') AS preview, array_to_string(list_append(ps[:4], 'and ' || (len(ps) - 4) || ' more'), ', ') AS summary FROM (SELECT language, list_sort(list(relative_path)) AS ps FROM files GROUP BY language)", (A.FILES,))
def j25_previews(spark, d):
    """The first paths of each language in words."""
    lists = A.files(spark, d).groupBy("language").agg(F.array_sort(F.collect_list("relative_path")).alias("ps"))
    return lists.select("language", X.preview_paths("ps", 3).alias("preview"), X.summarize_paths("ps", 4).alias("summary"))
