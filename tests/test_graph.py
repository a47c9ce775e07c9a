"""Graph operators on a small tree, and against plain searches on random graphs."""

import random
from collections import deque

from factloom.operators import graph
from factloom.sources.schema import ddl


def facts(spark):
    files = [("s", p, p.rsplit(".", 1)[-1], lang, 10, "h") for p, lang in (("Cargo.toml", "toml"), ("src/lib.rs", "rust"), ("src/inner.rs", "rust"), ("docs/adr-0001-repository-scanner.md", "markdown"))]
    symbols = [("s", "f1", "RepositoryScanner", "struct", "src/lib.rs", "rust", 2, "x"), ("s", "f2", "run", "function", "src/lib.rs", "rust", 1, "x"), ("s", "f3", "inner", "function", "src/inner.rs", "rust", 1, "x")]
    imports = [("s", "i1", "src/lib.rs", "inner", 1, "rust", "module", "src/inner.rs", "x"), ("s", "i2", "src/lib.rs", "std::fs", 2, "rust", "use", None, "x")]
    targets = [("s", "t", "", ".", ["cargo", "test"], "test", "required"), ("s", "c", "", ".", ["cargo", "check"], "typecheck", "recommended"), ("s", "n", "web", "web", ["pnpm", "typecheck"], "typecheck", "required")]
    rows = {"files": files, "symbols": symbols, "imports": imports, "verification_targets": targets}
    return {n: spark.createDataFrame(r, ddl(n)) for n, r in rows.items()}


def test_blast_radius(spark):
    requests = spark.createDataFrame([(1, "RepositoryScanner"), (2, "src/inner.rs"), (3, "nothing")], "request_id long, target string")
    documents = spark.createDataFrame([(1, "docs/adr-0001-repository-scanner.md")], "request_id long, relative_path string")
    report = graph.blast_radius(requests, facts(spark), documents)
    nodes = [r.node for r in report["nodes"].where("request_id = 1").orderBy("place").collect()]
    assert nodes == ["symbol:RepositoryScanner@src/lib.rs", "file:src/inner.rs", "file:src/lib.rs"]
    edges = {(r.kind, r.src, r.dst) for r in report["relationships"].where("request_id = 1").collect()}
    assert {k for k, _, _ in edges} == {"defines", "references", "imports", "calls", "tests", "builds", "documents", "supports_decision"}
    assert ("calls", "symbol:run@src/lib.rs", "symbol:inner@src/inner.rs") in edges and ("supports_decision", "file:docs/adr-0001-repository-scanner.md", "scope:RepositoryScanner") in edges
    plan = {r.request_id: r for r in report["plan"].collect()}
    assert plan[1].required_checks == ["cargo test"] and plan[1].recommended_checks == ["cargo check"] and not plan[1].stop and plan[1].coverage_gaps == [] and set(plan) == {1, 2}
    capsule = report["capsules"].where("request_id = 1").first()
    # definitions are the target's own symbols, or those of the path that it names
    assert {e for e in edges if e[0] == "defines"} == {("defines", "file:src/lib.rs", "symbol:RepositoryScanner@src/lib.rs")}
    assert {(r.src, r.dst) for r in report["relationships"].where("request_id = 2 and kind = 'defines'").collect()} == {("file:src/inner.rs", "symbol:inner@src/inner.rs")}
    told = {r.invariant for r in report["invariants"].where("request_id = 1").collect()}
    assert "scope around `RepositoryScanner` remains bounded to snapshot-confirmed direct imports and reverse importers" in told
    assert {"anchor path `src/lib.rs` remains part of the scoped change envelope", "direct structural edge `src/lib.rs` -> `src/inner.rs` remains intact", "required verification remains passing: `cargo test`"} <= told
    assert report["invariants"].where("request_id = 3").count() == 0 and any(t.startswith("symbol `RepositoryScanner` remains defined at `src/lib.rs`:") for t in told)
    assert capsule.name == "structural flow around `RepositoryScanner`" and capsule.failure_modes == []
    assert graph.render_capsule(report["capsules"].where("request_id = 1")).first().line.startswith("structural flow around `RepositoryScanner`: symbol:RepositoryScanner@src/lib.rs; ")
    trace = graph.explain_flow(requests, facts(spark), "compact").where("request_id = 1").first()
    assert trace.impacted_nodes == 3 and len(trace.transitions) == 2 and trace.verification_targets == ["cargo test", "cargo check"]
    assert capsule.entrypoints == ["symbol:RepositoryScanner@src/lib.rs"] and capsule.core_modules == ["src/inner.rs", "src/lib.rs"] and capsule.tests == ["cargo test"] and len(capsule.transitions) == len(edges)


def plain(edges, seeds, max_hops, most):
    """A queue: edges out by line, spec and id before edges in by importer, line, spec and id."""
    out, into = {}, {}
    for fact, a, spec, line, b in edges:
        out.setdefault(a, []).append((line, spec, fact, b))
        into.setdefault(b, []).append((a, line, spec, fact))
    seen, queue, found = set(seeds), deque((s, 0) for s in sorted(seeds)), []
    while queue:
        node, hop = queue.popleft()
        if hop >= max_hops:
            continue
        for other in [x[3] for x in sorted(out.get(node, []))] + [x[0] for x in sorted(into.get(node, []))]:
            if other not in seen:
                seen.add(other)
                found.append((other, hop + 1))
                if len(found) >= most:
                    return found
                queue.append((other, hop + 1))
    return found


def test_expansion_is_that_of_a_queue(spark):
    draw = random.Random(7)
    edges = []
    for k in range(150):
        a, b = draw.randrange(40), draw.randrange(40)
        edges.append((f"f{k:03}", f"n{a:02}", f"s{draw.randrange(5)}", draw.randrange(9), f"n{b:02}"))
    imports = spark.createDataFrame([("s", f, a, spec, line, "rust", "use", b, "x") for f, a, spec, line, b in edges], ddl("imports"))
    seeds = {1: ["n01"], 2: ["n05", "n03"], 3: ["zz"]}
    df = spark.createDataFrame([(r, s) for r, ss in seeds.items() for s in ss], "request_id int, relative_path string")
    for hops, most in ((1, 100), (2, 7), (3, 100), (2, 0)):
        got = {r: [] for r in seeds}
        for r in graph.expand_ordered(df, imports, hops, most).orderBy("request_id", "place").collect():
            got[r.request_id].append((r.relative_path, r.hop))
        assert got == {r: plain(edges, s, hops, max(1, most)) for r, s in seeds.items()}
    for r in graph.expand(df, imports, 3).collect():
        assert r.hop <= 3 and (r.relative_path in seeds[r.request_id] if r.hop == 0 else (r.relative_path, r.hop) in plain(edges, seeds[r.request_id], 3, 1000))


def test_caps(spark):
    paths = spark.createDataFrame([(1, f"p{k:02}") for k in range(40)], "request_id int, relative_path string")
    plan = spark.createDataFrame([(1, ["cargo test"], ["cargo check"])], "request_id int, required_checks array<string>, recommended_checks array<string>")
    rows = graph.check_edges(paths, plan).collect()
    assert len(rows) == 24 and {r.kind for r in rows} == {"tests"} and min(r.src for r in rows) == "file:p00"
    docs = spark.createDataFrame([(1, "a.md"), (1, "b.md")], "request_id int, relative_path string")
    requests = spark.createDataFrame([(1, "x")], "request_id int, target string")
    assert graph.document_edges(paths, docs, requests).where("kind = 'documents'").count() == 6
