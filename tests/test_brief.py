"""Whole briefs over a small tree: exact paths and symbols, full text, unknown scopes, budgets and readiness."""

import random

import pytest

from factloom.operators import brief, lexical
from factloom.sources.schema import ddl

REQUEST = "request_id string, scope_hint string, goal string, question string, task_type string, consumer_type string, depth string, token_budget int, latency_budget int, readiness string"


@pytest.fixture(scope="module")
def tree(spark):
    paths = ["src/lib.rs", "src/a.rs", "src/b.rs", "docs/adr-1.md"]
    files = spark.createDataFrame([("s", p, p.split(".")[-1], "markdown" if p.endswith("md") else "rust", 40 + k, "h") for k, p in enumerate(paths)], ddl("files"))
    symbols = spark.createDataFrame([("s", "sym_1", "Scanner", "struct", "src/lib.rs", "rust", 3, "x"), ("s", "sym_2", "Scanner", "trait", "src/a.rs", "rust", 5, "x"), ("s", "sym_3", "Scanner", "enum", "src/b.rs", "rust", 9, "x"), ("s", "sym_4", "run", "function", "src/a.rs", "rust", 1, "x")], ddl("symbols"))
    imports = spark.createDataFrame([("s", "imp_1", "src/a.rs", "crate::Scanner", 1, "rust", "use", "src/lib.rs", "x"), ("s", "imp_2", "src/b.rs", "crate::a", 1, "rust", "use", "src/a.rs", "x")], ddl("imports"))
    targets = spark.createDataFrame([("s", "cargo tests", "", ".", ["cargo", "test"], "test", "required"), ("s", "check", "", ".", ["cargo", "xtask", "check"], "quality", "recommended")], ddl("verification_targets"))
    texts = {"src/lib.rs": "the scanner walks folders", "src/a.rs": "walks", "src/b.rs": "other", "docs/adr-1.md": "a decision on walks"}
    docs = spark.createDataFrame([("s", p, f"{p}\n{t}") for p, t in texts.items()], "snapshot_id string, relative_path string, body string")
    return {"files": files, "symbols": symbols, "imports": imports, "verification_targets": targets}, lexical.build_index(docs)


def briefs(spark, tree, *rows):
    facts, index = tree
    return {r.request_id: r for r in brief.whole_brief(spark.createDataFrame(list(rows), REQUEST), facts, index).collect()}


def asked(name, scope, task="safe_edit", tokens=4096, ready="ready", goal="x"):
    return (name, scope, goal, "q", task, "human", "standard", tokens, 800, ready)


def test_statements_with_their_evidence(spark, tree):
    got = briefs(spark, tree, asked("path", "src/lib.rs"), asked("symbol", "Scanner", ready="stale"), asked("text", "walks", tokens=64_000), asked("none", "nowhere at all"), asked("short", "Scanner", tokens=2048))
    assert set(got) == {"path", "symbol", "text", "short"}
    said = {k: [(x.statement, round(x.confidence, 2), x.freshness, x.evidence_ids) for x in r.must_know] for k, r in got.items()}
    assert said["path"][0] == ("Exact path `src/lib.rs` is indexed as `rust` at `src/lib.rs` (40 bytes).", 0.99, "fresh", ["ev_file_anchor_src_lib_rs_path"])
    assert said["symbol"][0] == ("Exact symbol `Scanner` is defined in `src/a.rs`:5 as a `trait`.", 0.97, "stale", ["ev_symbol_definition_sym_2"])
    assert said["symbol"][1][0] == "Exact symbol `Scanner` is defined in `src/b.rs`:9 as a `enum`." and len(said["symbol"]) == 5
    adjacent = said["path"][1]
    assert adjacent[0] == "Direct structural adjacency from `src/lib.rs` reaches 3 indexed file(s): src/a.rs, src/lib.rs, src/b.rs." and "ev_reference_edge_imp_1" in adjacent[3]
    assert said["path"][2] == ("Deterministic required checks are known for this scope: cargo test.", 0.9, "fresh", ["ev_verification_target_cargo_test_planned"])
    lexical_ = said["text"][0]
    assert lexical_[0].startswith("Lexical anchors for `walks` matched 3 path(s): ") and lexical_[1] == 0.7 and len(lexical_[3]) == 3 and all(x.startswith("ev_lexical_hit_") for x in lexical_[3])
    assert len(said["short"]) == 3  # the budget of a short brief
    incomplete = ("Coverage audit for `safe_edit` is incomplete.", 0.72, "unverified", [])
    assert incomplete in said["symbol"] and incomplete not in said["path"]  # what is stale does not suffice
    assert got["path"].sufficient and not got["symbol"].sufficient and got["symbol"].readiness == "stale"


def test_zones_flows_and_invariants(spark, tree):
    got = briefs(spark, tree, asked("path", "src/lib.rs"), asked("why", "docs/adr-1.md", "query", goal="why is it so"))
    path = got["path"]
    assert path.fragile_zones == [f"direct structural neighbor `{p}` may require coordinated review" for p in ("src/a.rs", "src/b.rs")]
    assert len(path.relevant_flows) == 1 and path.relevant_flows[0].startswith("structural flow around `src/lib.rs`: ")
    assert "anchor path `src/lib.rs` remains part of the scoped change envelope" in path.do_not_break and "direct structural edge `src/a.rs` -> `src/lib.rs` remains intact" in path.do_not_break
    assert got["why"].classification == "decision_why" and got["why"].decision_docs == ["docs/adr-1.md"]


def grown(spark, draw, n):
    """A tree of n files that import each other at random, and its index."""
    paths = [f"src/m{k:02}.rs" for k in range(n)]
    files = [("s", p, "rs", "rust", 10 + k, f"h{k}") for k, p in enumerate(paths)]
    symbols = [("s", f"sym_{k}", f"Name{k % (n - 3)}", draw.choice(["struct", "function"]), p, "rust", 1 + k % 7, "x") for k, p in enumerate(paths)]
    imports = [("s", f"imp_{k}", a, f"crate::m{k}", 1, "rust", "use", b, "x") for k, (a, b) in enumerate((draw.choice(paths), draw.choice(paths)) for _ in range(n))]
    return {"files": files, "symbols": symbols, "imports": imports, "verification_targets": [("s", "cargo tests", "", ".", ["cargo", "test"], "test", "required")]}


def frames(spark, rows):
    facts = {name: spark.createDataFrame(x, ddl(name)) for name, x in rows.items()}
    docs = facts["files"].selectExpr("snapshot_id", "relative_path", "concat(relative_path, ' text of ', content_hash) AS body")
    return facts, lexical.build_index(docs)


@pytest.mark.parametrize("change", ["import", "symbol", "decision"])
def test_kept_briefs_are_those_of_a_full_run(spark, change):
    draw = random.Random(4)
    old = grown(spark, draw, 40)
    new = {name: list(x) for name, x in old.items()}
    if change == "import":
        new["imports"][3] = (*new["imports"][3][:7], "src/m17.rs", "x")
    elif change == "symbol":
        new["symbols"].append(("s", "sym_new", "Name5", "enum", "src/m30.rs", "rust", 2, "x"))
    elif change == "decision":
        new["files"].append(("s", "docs/adr-1.md", "md", "markdown", 5, "d"))
    rows = [asked(f"p{k}", f"src/m{k:02}.rs") for k in range(40)] + [asked(f"n{k}", f"Name{k}", ready="stale") for k in range(0, 37, 3)] + [asked("t", "text of h3"), asked("w", "Name1", "query", goal="why is it so")]
    requests = spark.createDataFrame(rows, REQUEST)
    (facts, index), (facts2, index2) = frames(spark, old), frames(spark, new)
    kept = brief.kept_briefs(requests, facts, index)
    got = brief.maintained(kept, requests, facts, facts2, index2)
    full = brief.kept_briefs(requests, facts2, index2)
    for name, df in full.items():
        assert sorted(map(str, got[name].select(df.columns).collect())) == sorted(map(str, df.collect()))
    redone = got["redone"].count()
    assert 0 < redone < len(rows) and brief.touched(full, requests, facts2, facts2).isEmpty()
    checks = facts2["verification_targets"].union(spark.createDataFrame([("s", "more", "", ".", ["cargo", "clippy"], "quality", "required")], ddl("verification_targets")))
    assert brief.touched(full, requests, facts2, facts2 | {"verification_targets": checks}).count() == len(rows)  # checks are planned for all


def test_keys_of_kept_briefs(spark):
    r = spark.createDataFrame([asked("a", None), asked("b", "x", tokens=1025)], REQUEST)
    assert [x.k for x in r.select(brief.cache_key(r).alias("k")).collect()] == ["safe_edit::x::q::global::4096", "safe_edit::x::q::x::2048"]
