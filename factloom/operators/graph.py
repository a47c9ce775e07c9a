"""Operators over the dependency graph: neighbours, relationships, verification plans and bounded expansion.

All take a batch: frames of targets or paths carry request_id. Edges are the imports table; only resolved ones lead on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, import_leaf, receipt_id, render_check, summarize_paths
from ..sources.schema import EDGE_KINDS, PRIORITIES
from ..sources.shared import scratch
from . import lookup
from .lookup import ancestors, looks_like_test

MAX_CHECK_EDGES = 24
MAX_DOCUMENT_PATHS = 3
# How many invariants of each kind a report names.
MAX_SYMBOL_INVARIANTS, MAX_PATH_INVARIANTS, MAX_EDGE_INVARIANTS, MAX_CHECK_INVARIANTS = 4, 4, 6, 4
# How much of a capsule a trace shows: entry points, modules, transitions, failures, tests, evidence.
TRACE_LIMITS = {"compact": (2, 3, 2, 2, 2, 2), "standard": (4, 6, 6, 4, 4, 6)}
STOP_CONDITION = "no deterministic required checks were discovered for this blast radius; narrow scope or add manual verification"


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """df written to the shared folder and read again: the plan of an iteration does not grow, and lost executors cost
    nothing that was done."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ends(imports: DataFrame) -> DataFrame:
    """The two ends of resolved imports, each pair once: what is asked of paths alone meets these, not every import."""
    return imports.where("resolved_path is not null").select("importer_path", "resolved_path").distinct()


def related_requests(seeds: DataFrame, named: DataFrame, plan: DataFrame, facts: dict[str, DataFrame]) -> DataFrame:
    """Requests (request_id) that have any of `blast_radius`' relationships, without making these: their target names a symbol, or
    one of their paths has symbols or resolved imports on either end, or there is a check."""
    held = ends(facts["imports"]).select(F.explode(F.array("importer_path", "resolved_path")).alias("relative_path")).union(facts["symbols"].select("relative_path")).distinct()
    checked = plan.where(F.size("required_checks") + F.size("recommended_checks") > 0)
    return named.select("request_id").union(seeds.join(held, "relative_path", "left_semi").select("request_id")).union(checked.select("request_id")).distinct()


def impacted_paths(seeds: DataFrame, imports: DataFrame) -> DataFrame:
    """Seeds, what they import, and what imports them: one hop."""
    edges = ends(imports)
    out = seeds.join(edges, seeds.relative_path == edges.importer_path).select("request_id", F.col("resolved_path").alias("relative_path"))
    into = seeds.join(edges, seeds.relative_path == edges.resolved_path).select("request_id", F.col("importer_path").alias("relative_path"))
    return seeds.select("request_id", "relative_path").union(out).union(into).distinct()


def defined_symbols(paths: DataFrame, symbols: DataFrame) -> DataFrame:
    return paths.select("request_id", "relative_path").join(symbols, "relative_path")


def touching_imports(seeds: DataFrame, imports: DataFrame) -> DataFrame:
    """Imports out of the seeds (resolved ones) and into them, each fact once for a request."""
    resolved = imports.where("resolved_path is not null")
    out = seeds.select("request_id", F.col("relative_path").alias("importer_path")).join(resolved, "importer_path")
    into = seeds.select("request_id", F.col("relative_path").alias("resolved_path")).join(resolved, "resolved_path")
    return out.unionByName(into).dropDuplicates(["request_id", "fact_id"])


def symbol_node(name: Column | str, path: Column | str) -> Column:
    return F.concat(F.lit("symbol:"), F.col(name) if isinstance(name, str) else name, F.lit("@"), F.col(path) if isinstance(path, str) else path)


def file_node(path: Column | str) -> Column:
    return F.concat(F.lit("file:"), F.col(path) if isinstance(path, str) else path)


_EDGE = ("request_id", "kind", "src", "dst", "summary", "evidence_ids")


def define_edges(symbols: DataFrame) -> DataFrame:
    """defines: a file and each symbol in it."""
    node = symbol_node("name", "relative_path")
    return symbols.select("request_id", F.lit("defines").alias("kind"), file_node("relative_path").alias("src"), node.alias("dst"), F.concat("relative_path", F.lit(" defines "), node).alias("summary"), F.array(receipt_id("symbol_definition", "fact_id")).alias("evidence_ids"))


def reference_edges(imports: DataFrame) -> DataFrame:
    """Each resolved import as a reference and as an import."""
    kinds = imports.where("resolved_path is not null").withColumn("kind", F.explode(F.array(F.lit("references"), F.lit("imports"))))
    summary = F.concat("importer_path", F.lit(" "), "kind", F.lit(" "), "resolved_path", F.lit(" via `"), "import_spec", F.lit("`"))
    return kinds.select("request_id", "kind", file_node("importer_path").alias("src"), file_node("resolved_path").alias("dst"), summary.alias("summary"), F.array(receipt_id("reference_edge", "fact_id")).alias("evidence_ids"))


def call_pairs(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    """For each import (fact_id) the function that it calls and the one that calls.

    Called: the first function of the resolved file, by line, name and id, whose name is the import's last part, case not
    counting. Calling: as of the import's line, the last function of the importer that begins at or before it, or else
    the importer's first. The first is an equi-join, the second a window: no range join.
    """
    functions = symbols.where("kind = 'function'").select("relative_path", "name", "line_number", "fact_id")
    order = F.struct("line_number", "name", "fact_id")
    keyed = imports.select("fact_id", "importer_path", "resolved_path", F.col("line_number").alias("at"), ascii_lower(import_leaf("import_spec")).alias("leaf"))
    named = functions.groupBy(F.col("relative_path").alias("called_path"), ascii_lower("name").alias("leaf")).agg(F.min(order).alias("called"))
    called = keyed.join(named, (F.col("resolved_path") == F.col("called_path")) & (keyed.leaf == named.leaf)).select("fact_id", "called", "called_path")
    # functions and imports of a file in one order: the last function so far is the calling one
    none = F.lit(None)
    steps = functions.select("relative_path", F.col("line_number").alias("at"), F.lit(0).alias("later"), order.alias("f"), none.cast("string").alias("id"))
    steps = steps.union(keyed.select("importer_path", "at", F.lit(1), none.cast(steps.schema["f"].dataType), "fact_id"))
    file = W.partitionBy("relative_path")
    before = F.last("f", ignorenulls=True).over(file.orderBy("at", "later", "f").rowsBetween(W.unboundedPreceding, W.currentRow))
    calling = steps.select("relative_path", "id", F.coalesce(before, F.min("f").over(file)).alias("calling")).where("id is not null and calling is not null")
    both = called.join(calling.select(F.col("id").alias("fact_id"), "calling", F.col("relative_path").alias("calling_path")), "fact_id")
    return both.select("fact_id", F.col("calling.name").alias("caller"), "calling_path", F.col("calling.line_number").alias("caller_line"), F.col("called.name").alias("callee"), "called_path", F.col("called.line_number").alias("callee_line"))


def call_edges(imports: DataFrame, symbols: DataFrame) -> DataFrame:
    pairs = call_pairs(imports.drop("request_id").dropDuplicates(["fact_id"]), symbols)
    joined = imports.select("request_id", "fact_id", "import_spec").join(pairs, "fact_id")
    src, dst = symbol_node("caller", "calling_path"), symbol_node("callee", "called_path")
    summary = F.concat(src, F.lit(" calls "), dst, F.lit(" via `"), "import_spec", F.lit("`"))
    return joined.select("request_id", F.lit("calls").alias("kind"), src.alias("src"), dst.alias("dst"), summary.alias("summary"), F.array(receipt_id("reference_edge", "fact_id")).alias("evidence_ids"))


def verification_matches(paths: DataFrame, targets: DataFrame) -> DataFrame:
    """(request_id, path, target) where the target's scope holds the path, as an equi-join on the path's ancestors."""
    up = paths.select("request_id", "relative_path", F.explode(ancestors("relative_path")).alias("scope_root"))
    return up.join(targets, "scope_root").withColumn("check", render_check("command", "working_directory"))


def verification_plan(paths: DataFrame, targets: DataFrame) -> DataFrame:
    """A row for each request: required and recommended checks, paths that no target covers, and whether to stop."""
    found = verification_matches(paths, targets)
    pick = lambda p: F.array_sort(F.collect_set(F.when(F.col("priority") == p, F.col("check")))).alias(f"{p}_checks")
    checks = found.groupBy("request_id").agg(*[pick(p) for p in PRIORITIES])
    open_ = paths.select("request_id", "relative_path").distinct().join(found.select("request_id", "relative_path").distinct(), ["request_id", "relative_path"], "left_anti")
    gaps = open_.groupBy("request_id").agg(F.array_sort(F.collect_list("relative_path")).alias("coverage_gaps"))
    none = F.array().cast("array<string>")
    out = paths.select("request_id").distinct().join(checks, "request_id", "left").join(gaps, "request_id", "left")
    out = out.select("request_id", *[F.coalesce(c, none).alias(c) for c in ("required_checks", "recommended_checks", "coverage_gaps")])
    return out.withColumn("stop", F.size("required_checks") == 0)


def check_edges(paths: DataFrame, plan: DataFrame, most: int = MAX_CHECK_EDGES) -> DataFrame:
    """tests or builds: every check with every impacted path, required checks first, `most` for a request."""
    checks = plan.select("request_id", F.posexplode(F.concat("required_checks", "recommended_checks")).alias("place", "check"))
    # what lies beyond the cap can be left out before the join
    near = paths.withColumn("p", F.row_number().over(W.partitionBy("request_id").orderBy("relative_path"))).where(F.col("p") <= most)
    order = F.row_number().over(W.partitionBy("request_id").orderBy("place", "relative_path"))
    pairs = checks.where(F.col("place") < most).join(near, "request_id").withColumn("n", order).where(F.col("n") <= most)
    kind = F.when(looks_like_test("check"), "tests").otherwise("builds")
    summary = F.concat("relative_path", F.lit(" "), kind, F.lit(" via `"), "check", F.lit("`"))
    return pairs.select("request_id", kind.alias("kind"), file_node("relative_path").alias("src"), F.concat(F.lit("check:"), "check").alias("dst"), summary.alias("summary"), F.array(receipt_id("verification_target", "check", "_planned")).alias("evidence_ids"))


def document_edges(paths: DataFrame, documents: DataFrame, requests: DataFrame, most: int = MAX_DOCUMENT_PATHS) -> DataFrame:
    """documents: each decision document and the first impacted paths; supports_decision: it and the request's target."""
    place = F.row_number().over(W.partitionBy("request_id").orderBy("relative_path"))
    near = paths.withColumn("n", place).where(F.col("n") <= most)
    docs = documents.select("request_id", F.col("relative_path").alias("doc"))
    ids = F.array(receipt_id("decision_document", "doc")).alias("evidence_ids")
    first = docs.join(near, "request_id").select("request_id", F.lit("documents").alias("kind"), file_node("doc").alias("src"), file_node("relative_path").alias("dst"), F.concat("doc", F.lit(" documents decisions relevant to "), "relative_path").alias("summary"), ids)
    scope = docs.join(requests.select("request_id", "target"), "request_id")
    second = scope.select("request_id", F.lit("supports_decision").alias("kind"), file_node("doc").alias("src"), F.concat(F.lit("scope:"), "target").alias("dst"), F.concat("doc", F.lit(" supports decision context for `"), "target", F.lit("`")).alias("summary"), ids)
    return first.union(second)


def edge_rank(kind: Column | str) -> Column:
    return F.array_position(F.array(*[F.lit(k) for k in EDGE_KINDS]), F.col(kind) if isinstance(kind, str) else kind)


def relationships(*edges: DataFrame) -> DataFrame:
    """All edges, one for each kind, ends and summary, with its place in the order of kinds, ends and summary."""
    both = edges[0].select(*_EDGE)
    for e in edges[1:]:
        both = both.union(e.select(*_EDGE))
    both = both.repartition("request_id")  # as the window needs it: equal edges are then found without another shuffle
    one = both.groupBy("request_id", "kind", "src", "dst", "summary").agg(F.min("evidence_ids").alias("evidence_ids"))
    return one.withColumn("place", F.row_number().over(W.partitionBy("request_id").orderBy(edge_rank("kind"), "src", "dst", "summary")))


def traverse(seeds: DataFrame, symbols: DataFrame, imports: DataFrame, kinds: list[str]) -> DataFrame:
    """One-hop hits of the seeds by kind: what they contain, define, import, and what refers to them; the best score of
    each node stays."""
    into = seeds.join(imports, seeds.relative_path == imports.resolved_path)
    out = seeds.join(imports.where("resolved_path is not null"), seeds.relative_path == F.col("importer_path"))
    parts = {
        "contains": seeds.select("request_id", file_node("relative_path").alias("node"), F.lit(1.0).alias("score")),
        "defines": defined_symbols(seeds, symbols).select("request_id", symbol_node("name", "relative_path").alias("node"), F.lit(1.0).alias("score")),
        "imports": out.select("request_id", file_node("resolved_path").alias("node"), F.lit(0.8).alias("score")),
        "references": into.select("request_id", file_node("importer_path").alias("node"), F.lit(0.8).alias("score")),
    }
    chosen = [parts[k] for k in kinds if k in parts]
    both = chosen[0]
    for x in chosen[1:]:
        both = both.union(x)
    return both.groupBy("request_id", "node").agg(F.max("score").alias("score"))


def expand(seeds: DataFrame, imports: DataFrame, max_hops: int) -> DataFrame:
    """All nodes within max_hops of a request's seeds, edges taken in both directions, and their least distance.

    A frontier of new nodes is joined with the edges once for each hop; nodes reached before are taken out by an anti-join.
    """
    edges = imports.where("resolved_path is not null").select(F.col("importer_path").alias("a"), F.col("resolved_path").alias("b")).distinct()
    both = edges.union(edges.select("b", "a"))
    reached = seeds.select("request_id", "relative_path").distinct().withColumn("hop", F.lit(0))
    frontier = reached
    for hop in range(1, max_hops + 1):
        step = frontier.join(both, frontier.relative_path == both.a).select("request_id", F.col("b").alias("relative_path")).distinct()
        frontier = step.join(reached.select("request_id", "relative_path"), ["request_id", "relative_path"], "left_anti").withColumn("hop", F.lit(hop))
        frontier = frontier if hop == max_hops else cut(frontier, "frontier")
        reached = reached.union(frontier)
    return reached


def expand_ordered(seeds: DataFrame, imports: DataFrame, max_hops: int, max_candidates: int) -> DataFrame:
    """Breadth-first expansion in the order of a queue, up to max_candidates nodes (one at least) for a request.

    A node's place is that of the edge that discovers it: by its parent's place, edges out before edges in, out by line,
    spec and id, in by importer, line, spec and id. The fact that discovers it is its evidence.
    """
    edges = imports.where("resolved_path is not null")
    out = edges.select(F.col("importer_path").alias("from"), F.col("resolved_path").alias("to"), F.struct(F.lit(0).alias("d"), F.lit("").alias("p"), F.col("line_number").alias("l"), F.col("import_spec").alias("s"), F.col("fact_id").alias("f")).alias("key"))
    into = edges.select(F.col("resolved_path").alias("from"), F.col("importer_path").alias("to"), F.struct(F.lit(1).alias("d"), F.col("importer_path").alias("p"), F.col("line_number").alias("l"), F.col("import_spec").alias("s"), F.col("fact_id").alias("f")).alias("key"))
    both = out.union(into)
    place = lambda *by: F.row_number().over(W.partitionBy("request_id").orderBy(*by))
    reached = seeds.select("request_id", "relative_path").distinct().withColumn("hop", F.lit(0)).withColumn("place", place("relative_path")).withColumn("fact_id", F.lit(None).cast("string"))
    frontier, found = reached, None
    for hop in range(1, max_hops + 1):
        step = frontier.join(both, frontier.relative_path == both["from"]).select("request_id", F.col("to").alias("relative_path"), F.struct("place", "key").alias("order"))
        step = step.groupBy("request_id", "relative_path").agg(F.min("order").alias("order"))
        step = step.join(reached.select("request_id", "relative_path"), ["request_id", "relative_path"], "left_anti")
        frontier = step.select("request_id", "relative_path", F.lit(hop).alias("hop"), place("order").alias("place"), F.col("order.key.f").alias("fact_id"))
        frontier = cut(frontier, "frontier")
        reached = reached.union(frontier)
        found = frontier if found is None else found.union(frontier)
    ordered = found.withColumn("place", place("hop", "place"))
    return ordered.where(F.col("place") <= max(1, max_candidates))


def first_of(rows: DataFrame, most: int, *order: str) -> DataFrame:
    """The first rows of each request."""
    place = F.row_number().over(W.partitionBy("request_id").orderBy(*order))
    return rows.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")


def invariants(requests: DataFrame, seeds: DataFrame, named: DataFrame, imports: DataFrame, plan: DataFrame) -> DataFrame:
    """(request_id, invariant): what must stay true around a target, each text once.

    That its scope stays bounded, where its symbols are defined, which paths anchor it, which edges touch it, and which
    checks must pass; the first few of each kind.
    """
    # The texts.
    text = lambda *parts: F.concat(*[F.lit(x) if k % 2 == 0 else F.col(x).cast("string") for k, x in enumerate(parts)]).alias("invariant")
    bounded = requests.join(seeds.select("request_id").distinct(), "request_id").select("request_id", text("scope around `", "target", "` remains bounded to snapshot-confirmed direct imports and reverse importers"))
    symbols = first_of(named, MAX_SYMBOL_INVARIANTS, "relative_path", "line_number", "name", "fact_id").select("request_id", text("symbol `", "name", "` remains defined at `", "relative_path", "`:", "line_number"))
    paths = first_of(seeds, MAX_PATH_INVARIANTS, "relative_path").select("request_id", text("anchor path `", "relative_path", "` remains part of the scoped change envelope"))
    edges = imports.where("resolved_path is not null").select("request_id", text("direct structural edge `", "importer_path", "` -> `", "resolved_path", "` remains intact")).distinct()
    edges = first_of(edges, MAX_EDGE_INVARIANTS, "invariant")
    checks = plan.select("request_id", F.explode(F.slice("required_checks", 1, MAX_CHECK_INVARIANTS)).alias("check")).select("request_id", text("required verification remains passing: `", "check", "`"))
    return bounded.union(symbols).union(paths).union(edges).union(checks).distinct()


def blast_radius(requests: DataFrame, facts: dict[str, DataFrame], documents: DataFrame | None = None, related: bool = True) -> dict[str, DataFrame]:
    """The parts of an impact report for a batch of targets: impacted nodes, relationships, plan, invariants, receipts and
    capsules. Definitions are those of the target's symbols, or, if it names none, of the paths where it is. Without related,
    the report has no relationships, nor the receipts and capsules that are made of them; `related` says which requests have any."""
    # every part below starts from these: they are written once
    seeds = cut(lookup.seed_paths(facts["files"], facts["symbols"], requests), "seeds")
    paths = cut(impacted_paths(seeds, facts["imports"]), "paths")
    named = cut(lookup.exact_symbol(facts["symbols"], requests), "named")
    nodes = named.select("request_id", F.lit(0).alias("part"), symbol_node("name", "relative_path").alias("node")).union(paths.select("request_id", F.lit(1), file_node("relative_path"))).distinct()
    nodes = nodes.withColumn("place", F.row_number().over(W.partitionBy("request_id").orderBy("part", "node")))
    plan = cut(verification_plan(paths, facts["verification_targets"]), "plan")
    pairs = ends(facts["imports"])
    near = seeds.join(pairs, seeds.relative_path == pairs.importer_path).union(seeds.join(pairs, seeds.relative_path == pairs.resolved_path))
    report = {"seeds": seeds, "paths": paths, "nodes": nodes, "plan": plan, "invariants": invariants(requests, seeds, named, near, plan), "related": related_requests(seeds, named, plan, facts)}
    if not related:
        return report
    imports = cut(touching_imports(seeds, facts["imports"]), "touching")
    unnamed = seeds.join(named.select("request_id").distinct(), "request_id", "left_anti")
    symbols = named.unionByName(defined_symbols(unnamed, facts["symbols"]))
    edges = [define_edges(symbols), reference_edges(imports), call_edges(imports, facts["symbols"]), check_edges(paths, plan)]
    if documents is not None:
        edges.append(document_edges(paths, documents, requests))
    found = cut(relationships(*edges), "relationships")
    receipts = found.select("request_id", F.explode("evidence_ids").alias("id")).distinct()
    return report | {"relationships": found, "receipts": receipts, "capsules": capsules(requests, named, paths, found, plan)}


def capsules(requests: DataFrame, named: DataFrame, paths: DataFrame, related: DataFrame, plan: DataFrame) -> DataFrame:
    """A flow capsule for each request with impacted paths: entry points, modules, transitions, failures, tests and evidence."""
    entry = named.groupBy("request_id").agg(F.array_sort(F.collect_set(symbol_node("name", "relative_path"))).alias("entry"))
    modules = paths.groupBy("request_id").agg(F.array_sort(F.collect_set("relative_path")).alias("core_modules"))
    steps = related.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("place", "summary"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_ids")))).alias("ids"))
    steps = steps.select("request_id", F.col("s.summary").alias("transitions"), F.filter("ids", lambda x: ~F.startswith(x, F.lit("ev_verification_target"))).alias("evidence_ids"))
    out = requests.select("request_id", "target").join(modules, "request_id").join(entry, "request_id", "left").join(steps, "request_id", "left").join(plan.select("request_id", "required_checks", "stop"), "request_id", "left")
    points = F.coalesce("entry", F.transform("core_modules", lambda p: F.concat(F.lit("file:"), p)))
    none = F.array().cast("array<string>")
    failures = F.when(F.col("stop"), F.array(F.lit(STOP_CONDITION))).otherwise(none)
    return out.select(
        "request_id", "target", F.concat(F.lit("structural flow around `"), "target", F.lit("`")).alias("name"), points.alias("entrypoints"), "core_modules", F.coalesce("transitions", none).alias("transitions"),
        failures.alias("failure_modes"), F.filter("required_checks", looks_like_test).alias("tests"), F.coalesce("evidence_ids", none).alias("evidence_ids"),
    )


def flow_trace(found: DataFrame, depth: Column | str) -> DataFrame:
    """Capsules cut to what a depth (compact, standard, or all of it) shows."""
    parts = ("entrypoints", "core_modules", "transitions", "failure_modes", "tests", "evidence_ids")
    depth = F.col(depth) if isinstance(depth, str) else depth

    def shown(k: int, c: str) -> Column:
        out = F.col(c)
        for name, limits in TRACE_LIMITS.items():
            out = F.when(depth == name, F.slice(c, 1, limits[k])).otherwise(out)
        return out.alias(c)

    return found.select("request_id", "name", *[shown(k, c) for k, c in enumerate(parts)])


def render_capsule(found: DataFrame) -> DataFrame:
    """A line for each capsule: its entry points, and its first transitions or, without any, its first modules."""
    rest = F.when(F.size("transitions") == 0, F.concat(F.lit("core modules "), summarize_paths("core_modules", 4))).otherwise(summarize_paths("transitions", 2))
    return found.select("request_id", F.concat("name", F.lit(": "), F.array_join("entrypoints", ", "), F.lit("; "), rest).alias("line"))


def explain_flow(requests: DataFrame, facts: dict[str, DataFrame], depth: str = "standard") -> DataFrame:
    """For each target the trace of its flow, with the sizes of the report behind it and its checks."""
    report = blast_radius(requests, facts)
    count = lambda part, name: report[part].groupBy("request_id").agg(F.count("*").alias(name))
    checks = report["plan"].select("request_id", F.concat("required_checks", "recommended_checks").alias("verification_targets"))
    out = flow_trace(report["capsules"], F.lit(depth)).join(checks, "request_id")
    for part, name in (("nodes", "impacted_nodes"), ("relationships", "relationships")):
        out = out.join(count(part, name), "request_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out
