"""Scans of small trees written to disk."""

import pytest
from pyspark.sql import functions as F

from factloom.sources import extract, scan, store
from factloom.sources.schema import ddl

TREE = {
    "src/lib.rs": "mod inner;\npub use crate::inner::helper;\npub struct RepositoryScanner {}\n\n#[cfg(test)]\nmod tests {\n    fn hidden() {}\n}\npub const fn after() {}\n",
    "src/inner.rs": "pub fn helper() {}\n// fn comment() {}\n",
    "src/nested/module.py": "from ..pkg import x\nclass Thing:\n    async def scan(self):\n        pass\n",
    "src/pkg.py": "def x(): pass\n",
    "web/app.ts": "import { a } from './contracts.js'\nexport interface Binding {}\nexport type State = 'r'\nexport async function go() {}\nconst q = require(\"./missing\")\n",
    "web/contracts.ts": "export class A {}\n",
    "docs/guide.md": "# Guide\nstatus: accepted\n",
    "Cargo.toml": '[workspace]\nmembers = []\n[package]\nname = "demo"\n',
    "src/rust/xtask/Cargo.toml": '[package]\nname = "xtask"\n',
    "package.json": '{"scripts": {"quality:check": "x"}}',
    "web/package.json": '{"name": "web", "scripts": {"typecheck": "tsc", "other": 1}}',
    "py/pyproject.toml": '[project]\n# name = "no"\nname = "lib"\n[tool.mypy]\n[tool.ruff]\n',
    "py/src/a.py": "",
    "py/tests/t.py": "",
    "pyproject.toml": '[project]\nname = "root"\n[tool.ruff]\n',
    ".env": "SECRET=1",
    "node_modules/p/index.js": "function no() {}",
    ".git/config": "x",
    "img.PNG": "x",
    "sub/.env.local": "x",
}


@pytest.fixture(scope="module")
def facts(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    (root / "bad.rs").write_bytes(b"\xff\xfe fn no() {}")
    return scan.scan(spark, str(root), "s1")


def test_files(facts):
    rows = {r.relative_path: r for r in facts["files"].collect()}
    assert set(rows) == {p for p in TREE if p not in (".env", "node_modules/p/index.js", ".git/config", "img.PNG", "sub/.env.local")} | {"bad.rs"}
    assert rows["src/lib.rs"].language == "rust" and rows["Cargo.toml"].language == "toml" and rows["docs/guide.md"].extension == "md"
    assert rows["py/src/a.py"].content_hash == "cbf29ce484222325" and rows["py/src/a.py"].size_bytes == 0


def test_symbols(facts):
    rows = {(r.relative_path, r.line_number, r.kind, r.name) for r in facts["symbols"].collect()}
    assert rows == {
        ("src/lib.rs", 1, "module", "inner"), ("src/lib.rs", 3, "struct", "RepositoryScanner"), ("src/lib.rs", 9, "function", "after"), ("src/inner.rs", 1, "function", "helper"), ("src/nested/module.py", 2, "class", "Thing"),
        ("src/nested/module.py", 3, "function", "scan"), ("src/pkg.py", 1, "function", "x"), ("web/app.ts", 2, "interface", "Binding"), ("web/app.ts", 3, "type_alias", "State"), ("web/app.ts", 4, "function", "go"), ("web/contracts.ts", 1, "class", "A"),
    }


def test_imports(facts):
    rows = {(r.importer_path, r.import_spec, r.kind, r.resolved_path) for r in facts["imports"].collect()}
    assert {
        ("src/lib.rs", "inner", "module", "src/inner.rs"), ("src/lib.rs", "crate::inner::helper", "use", "src/inner.rs"), ("src/nested/module.py", "..pkg", "python_from", "src/pkg.py"),
        ("web/app.ts", "./contracts.js", "js_import", "web/contracts.ts"), ("web/app.ts", "./missing", "require", None),
    } <= rows


def test_verification_targets(facts):
    rows = {(r.label, r.scope_root, r.working_directory, " ".join(r.command), r.kind, r.priority) for r in facts["verification_targets"].collect()}
    assert rows == {
        ("repo-native quality", "", ".", "cargo xtask quality", "quality", "recommended"), ("repo-native full check", "", ".", "cargo xtask check", "quality", "recommended"), ("cargo tests for demo", "", ".", "cargo test", "test", "required"),
        ("cargo check for demo", "", ".", "cargo check", "typecheck", "recommended"), ("cargo tests for xtask", "src/rust/xtask", "src/rust/xtask", "cargo test", "test", "required"),
        ("cargo check for xtask", "src/rust/xtask", "src/rust/xtask", "cargo check", "typecheck", "recommended"), ("root quality check", "", ".", "pnpm quality:check", "quality", "recommended"), ("typecheck for web", "web", "web", "pnpm typecheck", "typecheck", "required"),
        ("unit tests for lib", "py", "py", "python -m unittest discover tests", "test", "required"), ("mypy for lib", "py", "py", "python -m mypy --config-file pyproject.toml src tests", "typecheck", "recommended"),
        ("ruff for lib", "py", "py", "python -m ruff check src tests", "quality", "recommended"),
    }


def test_rust_paths():
    found = lambda path, kind, spec: extract._rust_candidates(path, kind, spec)
    assert found("crates/a/src/x/y.rs", "use", "crate::b::c::Kind")[:2] == ["crates/a/src/b/c.rs", "crates/a/src/b/c/mod.rs"]
    assert found("crates/a/src/x/y.rs", "use", "super::b::f")[-2:] == ["crates/a/src/b.rs", "crates/a/src/b/mod.rs"]
    assert found("src/y.rs", "use", "super::b") == [] and found("src/y.rs", "use", "std::fs") == [] and found("lib/y.rs", "use", "crate::b") == []
    assert extract._python_candidates("pkg/sub/consumer.py", "..module") == ["pkg/module.py", "pkg/module/__init__.py"]


def test_store_round_trip(spark, facts, tmp_path):
    root = str(tmp_path / "store")
    store.write_snapshot(facts, root)
    other = {n: facts[n].withColumn("snapshot_id", F.lit("s2")) for n in store.FACTS}
    store.write_snapshot(other, root)
    store.write_snapshot(other, root)
    back = store.read_snapshot(spark, root, "s1")
    for n in store.FACTS:
        assert sorted(map(str, back[n].select(facts[n].columns).collect())) == sorted(map(str, facts[n].dropDuplicates().collect()))
    assert store.read_snapshot(spark, root)["files"].count() == 2 * facts["files"].count()


def test_inventory_json_fills_in_ids(spark, tmp_path):
    path = tmp_path / "inventory.json"
    path.write_text('{"snapshot_id": "s", "files": [{"relative_path": "a.rs"}], "symbols": [{"name": "value", "kind": "function", "relative_path": "src/lib.rs", "language": "rust", "line_number": 1}], "imports": [{"importer_path": "a.ts", "import_spec": "./b", "line_number": 1, "language": "typescript", "kind": "j_s_import"}]}')
    out = store.read_inventory(spark, str(path))
    assert out["symbols"].first().fact_id == "sym_rust_src_lib_rs_1_function_value"
    r = out["imports"].first()
    assert (r.kind, r.fact_id) == ("js_import", "imp_typescript_a_ts_1_js_import___b") and out["files"].count() == 1 and out["verification_targets"].count() == 0


def test_a_lookup_reads_the_groups_that_may_hold_its_key(spark, tmp_path):
    root = str(tmp_path / "snapshots")
    n = 4000
    paths = [f"src/{k % 50:02}/f{k:05}.rs" for k in range(n)]
    made = {
        "files": spark.createDataFrame([("s", p, "rs", "rust", 1, "h") for p in paths] * 2, ddl("files")), "symbols": spark.createDataFrame([("s", f"sym{k}", f"name{k % 1000:04}", "function", p, "rust", 1, "x") for k, p in enumerate(paths)], ddl("symbols")),
        "imports": spark.createDataFrame([("s", f"imp{k}", p, "x", 1, "rust", "use", None, "x") for k, p in enumerate(paths)], ddl("imports")), "verification_targets": spark.createDataFrame([("s", "l", "", ".", ["c"], "test", "required")], ddl("verification_targets")),
    }
    store.write_snapshot(made, root, 20)
    for name, key, many in (("files", paths[1234], 1), ("symbols", "name0777", 4), ("imports", paths[7], 1)):
        found = store.lookup(spark, root, name, "s", key)
        assert len(found.collect()) == many and many <= store.rows_read(found) < n / 8
    assert store.read_snapshot(spark, root, "s")["files"].count() == n  # equal rows once
