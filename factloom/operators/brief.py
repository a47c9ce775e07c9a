"""Briefings: routing, anchors, expansion, decisions, audit and packing for a batch of requests.

A request: request_id, goal, question, task_type, consumer_type, depth, scope_hint, token_budget, latency_budget. The
loops of a single-request engine are joins on request_id here, and a stage that only some requests need gets these alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import receipt_id, summarize_paths
from . import decisions, graph, lexical, lookup

# Decisions of a brief, symbols and hits that a statement names, and paths that it lists.
MAX_DECISIONS, SHOWN_SYMBOLS, SHOWN_HITS, SHOWN_PATHS = 4, 2, 4, 4


def route(requests: DataFrame) -> DataFrame:
    """Requests with class, latency class, and budgets for candidates, hops and what is packed."""
    out = requests.withColumn("classification", rules.classify("task_type", "goal", "question"))
    out = out.withColumn("latency_class", rules.latency_class("consumer_type", "latency_budget", "task_type", "depth"))
    out = out.withColumn("max_candidates", rules.candidate_budget("latency_class", "task_type")).withColumn("max_hops", rules.hop_budget("latency_class"))
    out = out.withColumn("second_pass", rules.allows_second_pass("latency_class", "task_type", "depth")).withColumn("freshness_default", rules.default_freshness("task_type"))
    files, items, zones = rules.packing_budget("token_budget", "latency_class")
    return out.withColumn("max_files", files).withColumn("max_items", items).withColumn("max_zones", zones).withColumn("token_bucket", rules_bucket("token_budget"))


def rules_bucket(tokens: str) -> Column:
    from ..functions.text import bucket_token_budget

    return bucket_token_budget(tokens)


def required_slots(requests: DataFrame, table: dict | None = None) -> DataFrame:
    """A row for each slot that a request's class needs, in order."""
    slots = rules.case(F.col("classification"), table or rules.REQUIRED_SLOTS)
    return requests.select("request_id", "classification", F.posexplode(slots).alias("place", "slot"))


def audit(slots: DataFrame, signals: DataFrame) -> DataFrame:
    """Status of each required slot from a request's signals, and whether it suffices."""
    joined = slots.join(signals, "request_id")
    names = ("anchors", "suggested", "relationships", "capsules", "required", "recommended", "targets", "impact", "changed", "decisions", "decision_docs", "readiness")
    out = joined.withColumn("status", rules.slot_status(F.col("slot"), {n: F.col(n) for n in names}))
    return out.select("request_id", "classification", "place", "slot", "status", rules.is_sufficient(F.col("status")).alias("sufficient"))


def audit_summary(slots: DataFrame) -> DataFrame:
    """One row for each request: whether all suffices, missing slots, and whether a second look can help."""
    bad = F.when(~F.col("sufficient"), F.struct("place", "slot"))
    out = slots.groupBy("request_id", "classification").agg(F.bool_and("sufficient").alias("sufficient"), F.array_sort(F.collect_list(bad)).alias("bad"), F.bool_or(F.col("status") == "missing_retrievable").alias("retrievable"))
    again = F.col("retrievable") & (F.col("classification") != "entity_lookup")
    return out.select("request_id", "classification", "sufficient", F.col("bad.slot").alias("insufficient_slots"), "retrievable", again.alias("wants_second_pass"))


def second_pass_queries(requests: DataFrame, slots: DataFrame) -> DataFrame:
    """A query for each slot that is missing but can be retrieved: the scope, the question and the slot's words."""
    missing = slots.where("status = 'missing_retrievable'").select("request_id", "slot", "place")
    text = F.concat_ws(" ", F.coalesce("scope_hint", F.lit("")), "question", rules.case(F.col("slot"), rules.SECOND_PASS_WORDS))
    return missing.join(requests, "request_id").select("request_id", "place", "slot", text.alias("text"))


def suggested_files(impacted: DataFrame, hits: DataFrame, neighbours: DataFrame, budget: DataFrame) -> DataFrame:
    """Impacted files, then full-text hits, then neighbours: each path once, where it comes first, up to the budget."""
    parts = [impacted.select("request_id", "relative_path", F.lit(0).alias("part"), F.lit(0).alias("at")), hits.select("request_id", "relative_path", F.lit(1), "place"), neighbours.select("request_id", "relative_path", F.lit(2), F.col("hop"))]
    both = parts[0].union(parts[1]).union(parts[2])
    first = both.groupBy("request_id", "relative_path").agg(F.min(F.struct("part", "at")).alias("first"))
    place = F.row_number().over(W.partitionBy("request_id").orderBy("first", "relative_path"))
    out = first.withColumn("place", place).join(budget.select("request_id", "max_files"), "request_id")
    return out.where(F.col("place") <= F.col("max_files")).select("request_id", "relative_path", F.col("first.part").alias("part"), "place")


def merge_neighbours(a: DataFrame, b: DataFrame, limit: int) -> DataFrame:
    """The least hop of each path of both, by hop and path; limit 0: all."""
    both = a.select("request_id", "relative_path", "hop").union(b.select("request_id", "relative_path", "hop"))
    best = both.groupBy("request_id", "relative_path").agg(F.min("hop").alias("hop"))
    best = best.withColumn("place", F.row_number().over(W.partitionBy("request_id").orderBy("hop", "relative_path")))
    return best.where(F.col("place") <= limit) if limit else best


def merge_receipts(*parts: DataFrame) -> DataFrame:
    """Receipts of all parts, one for each id."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    keys = [c for c in both.columns if c not in ("request_id", "id")]
    return both.groupBy("request_id", "id").agg(F.min(F.struct(*keys)).alias("x")).select("request_id", "id", "x.*")


def fragile_zones(suggested: DataFrame, anchors: DataFrame, gaps: DataFrame, limit: int) -> DataFrame:
    """Suggested files that are no anchors, then paths that no check covers, up to the limit."""
    rest = suggested.join(anchors.select("request_id", "relative_path").distinct(), ["request_id", "relative_path"], "left_anti")
    both = rest.select("request_id", F.lit(0).alias("part"), F.col("relative_path").alias("zone")).union(gaps.select("request_id", F.lit(1), F.explode("coverage_gaps")))
    place = F.row_number().over(W.partitionBy("request_id").orderBy("part", "zone"))
    return both.withColumn("place", place).where(F.col("place") <= limit)


def statements(signals: DataFrame) -> DataFrame:
    """What a reader must know, in order: a row (request_id, place, statement, confidence, freshness, evidence_ids) for each
    statement that holds.

    signals: request_id, scope, path (struct of relative_path, language, size_bytes; null: none), symbols (array of structs
    of name, relative_path, line_number, kind, fact_id), hits (the first paths) and n_hits, suggested, required_checks,
    coverage_gaps, classification, sufficient, freshness, capsule_ids.
    """
    none = F.array().cast("array<string>")
    text = lambda *parts: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in parts])
    c = F.col

    def row(n: int, when: Column, statement: Column, trust: float, fresh: Column, ids: Column) -> Column:
        return F.when(when, F.struct(F.lit(n).alias("n"), statement.alias("statement"), F.lit(trust).alias("confidence"), fresh.alias("freshness"), ids.alias("evidence_ids")))

    def symbol(k: int) -> Column:
        x = F.get("symbols", F.lit(k))
        said = text("Exact symbol `", x["name"], "` is defined in `", x["relative_path"], "`:", x["line_number"], " as a `", x["kind"], "`.")
        return row(1 + k, F.size("symbols") > k, said, 0.97, c("freshness"), F.array(receipt_id("symbol_definition", x["fact_id"])))

    exact = c("path").isNotNull() | (F.size("symbols") > 0)
    shown = F.slice("hits", 1, SHOWN_HITS)
    # The texts, and how far each kind is to be trusted.
    rows = F.array_compact(F.array(
        row(0, c("path").isNotNull(), text("Exact path `", c("scope"), "` is indexed as `", F.coalesce("path.language", F.lit("unknown")), "` at `", c("path.relative_path"), "` (", c("path.size_bytes"), " bytes)."), 0.99, c("freshness"), F.array(receipt_id("file_anchor", "path.relative_path", "_path"))),
        *[symbol(k) for k in range(SHOWN_SYMBOLS)],
        row(3, ~exact & (F.size("hits") > 0), text("Lexical anchors for `", c("scope"), "` matched ", c("n_hits"), " path(s): ", F.array_join(shown, ", "), "."), 0.7, c("freshness"), F.transform(shown, lambda p: receipt_id("lexical_hit", p))),
        row(4, F.size("suggested") > 1, text("Direct structural adjacency from `", c("scope"), "` reaches ", F.size("suggested"), " indexed file(s): ", summarize_paths("suggested", SHOWN_PATHS), "."), 0.82, c("freshness"), F.coalesce("capsule_ids", none)),
        row(5, F.size("required_checks") > 0, text("Deterministic required checks are known for this scope: ", F.array_join("required_checks", ", "), "."), 0.9, c("freshness"), F.transform("required_checks", lambda x: receipt_id("verification_target", x, "_planned"))),
        row(6, ~c("sufficient"), text("Coverage audit for `", c("classification"), "` is incomplete."), 0.72, F.lit("unverified"), none),
        row(7, F.size("coverage_gaps") > 0, F.get("coverage_gaps", F.lit(0)), 0.88, F.lit("unverified"), none),
    ))
    return signals.select("request_id", F.posexplode(rows).alias("at", "x")).select("request_id", (F.col("at") + 1).alias("place"), "x.statement", "x.confidence", "x.freshness", "x.evidence_ids")


def brief(requests: DataFrame, facts: dict[str, DataFrame], index: dict[str, DataFrame], docs: DataFrame, readiness: str = "ready") -> DataFrame:
    """A briefing for each request that has a scope: anchors, suggested files, relationships, plan, decisions and audit.

    Requests whose scope names a path or symbol skip the full-text stage; the others go there alone. readiness holds for
    all requests, unless they have a column of that name.
    """
    return _parts(requests, facts, index, readiness)["brief"]


def whole_brief(requests: DataFrame, facts: dict[str, DataFrame], index: dict[str, DataFrame], readiness: str = "ready") -> DataFrame:
    """The same with what a reader must know (statements with their evidence, the first of the budget), fragile zones, flows
    and invariants. A scope that neither names anything nor has a hit gives no brief.

    Lists are made of bounded rows: statements from the first symbols and hits of a request, zones from its suggested files.
    """
    parts = _parts(requests, facts, index, readiness, related=True)
    routed, out, hits, report = parts["routed"], graph.cut(parts["brief"], "briefs"), parts["hits"], parts["report"]
    found = parts["anchors"].select("request_id").distinct()
    targets = routed.select("request_id", F.col("scope_hint").alias("target"))
    path = lookup.exact_path(facts["files"], targets).groupBy("request_id").agg(F.min(F.struct("relative_path", "language", "size_bytes")).alias("path"))
    named = graph.first_of(lookup.exact_symbol(facts["symbols"], targets), SHOWN_SYMBOLS, "relative_path", "line_number", "name", "fact_id")
    order = F.struct("relative_path", "line_number", "name", "fact_id", "kind")
    named = named.groupBy("request_id").agg(F.array_sort(F.collect_list(order)).alias("symbols"))
    shown = hits.groupBy("request_id").agg(F.count("*").alias("n_hits"), F.array_sort(F.collect_list(F.when(F.col("place") <= SHOWN_HITS, F.struct("place", "relative_path")))).alias("x")).select("request_id", "n_hits", F.col("x.relative_path").alias("hits"))
    capsules = report["capsules"].select("request_id", F.col("evidence_ids").alias("capsule_ids"))
    signals = out.join(found, "request_id", "left_semi").join(targets.withColumnRenamed("target", "scope"), "request_id")
    for part in (path, named, shown, capsules):
        signals = signals.join(part, "request_id", "left")
    no_symbols, none = F.array().cast(named.schema["symbols"].dataType), F.array().cast("array<string>")
    signals = signals.withColumns({"symbols": F.coalesce("symbols", no_symbols), "hits": F.coalesce("hits", none), "n_hits": F.coalesce("n_hits", F.lit(0)), "suggested": F.col("suggested_files"), "freshness": rules.freshness("readiness")})
    budget = routed.select("request_id", "max_items", "max_zones")
    told = statements(signals).join(budget, "request_id").where(F.col("place") <= F.col("max_items"))
    told = told.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("place", "statement", "confidence", "freshness", "evidence_ids"))).alias("must_know"))
    # The texts.
    rest = parts["suggested"].join(parts["anchors"].select("request_id", "relative_path").distinct(), ["request_id", "relative_path"], "left_anti")
    zones = rest.select("request_id", F.struct(F.lit(0).alias("part"), F.col("place").cast("long").alias("nth"), F.concat(F.lit("direct structural neighbor `"), "relative_path", F.lit("` may require coordinated review")).alias("zone")).alias("z"))
    gaps = out.select("request_id", F.posexplode("coverage_gaps").alias("nth", "zone")).select("request_id", F.struct(F.lit(1).alias("part"), F.col("nth").cast("long").alias("nth"), "zone").alias("z"))
    zones = zones.union(gaps).groupBy("request_id").agg(F.array_sort(F.collect_list("z")).alias("z")).join(budget, "request_id")
    zones = zones.select("request_id", F.slice(F.col("z.zone"), F.lit(1), F.col("max_zones").cast("int")).alias("fragile_zones"))
    flows = graph.render_capsule(report["capsules"]).groupBy("request_id").agg(F.array_sort(F.collect_list("line")).alias("relevant_flows"))
    kept = report["invariants"].groupBy("request_id").agg(F.array_sort(F.collect_set("invariant")).alias("do_not_break"))
    out = out.join(found, "request_id", "left_semi").join(told, "request_id", "left")
    for part in (zones, flows, kept):
        out = out.join(part, "request_id", "left")
    return out.withColumns({x: F.coalesce(x, none) for x in ("fragile_zones", "relevant_flows", "do_not_break")})


def _parts(requests: DataFrame, facts: dict[str, DataFrame], index: dict[str, DataFrame], readiness: str, related: bool = False) -> dict:
    """The stages that briefs are made of. A brief asks only whether there are relationships; with related, they are made too."""
    state = F.col("readiness") if "readiness" in requests.columns else F.lit(readiness)
    routed = graph.cut(route(requests.where("scope_hint is not null")), "routed")
    targets = routed.select("request_id", F.col("scope_hint").alias("target"))
    report = graph.blast_radius(targets, facts, related=related)
    seeds, paths, plan = report["seeds"], report["paths"], report["plan"]
    unknown = routed.join(seeds.select("request_id").distinct(), "request_id", "left_anti")
    queries = unknown.select("request_id", F.col("scope_hint").alias("text"), F.lit("").alias("scope"), F.col("max_candidates").alias("limit"))
    hits = graph.cut(lexical.search(index, queries), "hits")
    anchors = seeds.select("request_id", "relative_path").union(hits.select("request_id", "relative_path"))
    most = routed.agg(F.max("max_hops")).first()[0] or 0
    reached = graph.expand(anchors, facts["imports"], most).join(routed.select("request_id", "max_hops", "max_candidates"), "request_id").where("hop <= max_hops")
    reached = graph.cut(reached, "reached")
    near = reached.where("hop > 0")
    near = near.withColumn("n", F.row_number().over(W.partitionBy("request_id").orderBy("hop", "relative_path"))).where("n <= max_candidates").select("request_id", "relative_path", "hop")
    near = graph.cut(near, "near")
    suggested = graph.cut(suggested_files(paths, hits, near, routed), "suggested")
    documents = decisions.fast_candidates(anchors, suggested, facts["files"])
    listed = lambda df, c, name: df.groupBy("request_id").agg(F.array_sort(F.collect_list(F.struct("place", c))).alias("x")).select("request_id", F.col(f"x.{c}").alias(name))
    count = lambda df, name: df.groupBy("request_id").agg(F.count("*").alias(name))
    out = routed.join(listed(suggested, "relative_path", "suggested_files"), "request_id", "left").join(plan, "request_id", "left").join(listed(documents, "relative_path", "decision_docs"), "request_id", "left")
    for part, name in ((anchors, "anchors"), (report["related"], "relationships"), (paths, "changed"), (paths.select("request_id").distinct(), "capsules")):
        out = out.join(count(part, name), "request_id", "left")
    none = F.array().cast("array<string>")
    for c in ("suggested_files", "required_checks", "recommended_checks", "coverage_gaps", "decision_docs"):
        out = out.withColumn(c, F.coalesce(c, none))
    out = out.withColumn("decision_docs", F.when(F.col("classification") == "decision_why", F.slice("decision_docs", 1, MAX_DECISIONS)).otherwise(none))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    totals = facts["verification_targets"].agg(F.count("*").alias("targets")).join(F.broadcast(facts["files"].agg(F.count_if(lookup.looks_like_decision_doc("relative_path", "language", "extension")).alias("decision_files"))))
    signals = out.join(F.broadcast(totals)).select(  # one row
        "request_id", zero("anchors"), F.size("suggested_files").alias("suggested"), zero("relationships"), zero("capsules"), F.size("required_checks").alias("required"), F.size("recommended_checks").alias("recommended"),
        "targets", F.when(F.size("suggested_files") > 0, F.lit("impact")).alias("impact"), zero("changed"), F.size("decision_docs").alias("decisions"), F.col("decision_files").alias("decision_docs"), state.alias("readiness"),
    )
    checked = audit_summary(audit(required_slots(routed), signals))
    out = out.join(checked.select("request_id", "sufficient", "insufficient_slots", "wants_second_pass"), "request_id").withColumn("impact_level", rules.impact_level(F.coalesce("changed", F.lit(0))))
    out = out.select("request_id", "classification", "latency_class", "max_hops", "max_candidates", "suggested_files", "required_checks", "recommended_checks", "coverage_gaps", "decision_docs", "impact_level", "sufficient", "insufficient_slots", (F.col("wants_second_pass") & F.col("second_pass")).alias("second_pass"), state.alias("readiness"))
    return {"routed": routed, "report": report, "hits": hits, "anchors": anchors, "suggested": suggested, "reached": reached, "brief": out}


# --- briefs that are kept ----------------------------------------------------------------------------------------------


def cache_key(requests: DataFrame) -> Column:
    """What a brief is kept by: work, goal, question and scope (requests with model_class and max_context_tokens: these too), and
    the budget in steps of 1,024 tokens."""
    scope = F.coalesce("scope_hint", F.lit("global"))
    model = [F.concat("model_class", F.lit("-"), F.floor(F.col("max_context_tokens") / 1000).cast("string"), F.lit("k"))] if "model_class" in requests.columns else []
    return F.concat_ws("::", "task_type", "goal", "question", scope, *model, rules_bucket("token_budget").cast("string"))


def kept_briefs(requests: DataFrame, facts: dict[str, DataFrame], index: dict[str, DataFrame], readiness: str = "ready") -> dict[str, DataFrame]:
    """Briefs, and what each depends on: uses (request_id, relative_path), every path from which it may have taken a fact, and
    whole (request_id): briefs that depend on more than paths, for they came from full text."""
    parts = _parts(requests, facts, index, readiness)
    paths = [parts["reached"], parts["report"]["paths"], parts["report"]["seeds"], parts["anchors"]]
    uses = paths[0].select("request_id", "relative_path")
    for p in paths[1:]:
        uses = uses.union(p.select("request_id", "relative_path"))
    whole = parts["routed"].select("request_id").join(parts["report"]["seeds"].select("request_id"), "request_id", "left_anti")
    return {"briefs": graph.cut(parts["brief"], "briefs"), "uses": graph.cut(uses.distinct(), "uses"), "whole": graph.cut(whole, "whole")}


def _differs(old: DataFrame, new: DataFrame, *columns: str) -> DataFrame:
    a, b = old.select(*columns).distinct(), new.select(*columns).distinct()
    return a.subtract(b).union(b.subtract(a))


def touched(kept: dict[str, DataFrame], requests: DataFrame, old: dict[str, DataFrame], new: dict[str, DataFrame]) -> DataFrame:
    """Requests (request_id) whose brief a change of facts may touch.

    That is: it used a path of a file, symbol or import that differs, or its scope is such a path or name; it came from full
    text, whose statistics any file changes; it asks for decisions, and decision documents differ; or checks differ,
    which are planned for all. Also requests that have no brief yet.
    """
    files = _differs(old["files"], new["files"], "relative_path", "language", "extension", "size_bytes", "content_hash")
    symbols = _differs(old["symbols"], new["symbols"], "fact_id", "relative_path", "name", "kind", "line_number")
    imports = _differs(old["imports"], new["imports"], "fact_id", "importer_path", "import_spec", "resolved_path", "line_number")
    files, symbols, imports = (graph.cut(x, "differs") for x in (files, symbols, imports))
    ends = imports.select(F.explode(F.array_compact(F.array("importer_path", "resolved_path"))).alias("relative_path"))
    paths = files.select("relative_path").union(symbols.select("relative_path")).union(ends).distinct()
    scopes = paths.select(F.col("relative_path").alias("scope_hint")).union(symbols.select(F.col("name").alias("scope_hint"))).distinct()
    briefs = kept["briefs"]
    out = kept["uses"].join(paths, "relative_path", "left_semi").select("request_id")
    out = out.union(requests.join(scopes, "scope_hint", "left_semi").select("request_id"))
    out = out.union(requests.select("request_id").join(briefs.select("request_id"), "request_id", "left_anti"))
    if not files.isEmpty():
        out = out.union(kept["whole"].select("request_id"))
        if not files.where(lookup.looks_like_decision_doc("relative_path", "language", "extension")).isEmpty():
            out = out.union(briefs.where("classification = 'decision_why'").select("request_id"))
    if not _differs(old["verification_targets"], new["verification_targets"], *new["verification_targets"].columns).isEmpty():
        out = out.union(briefs.select("request_id"))
    return out.distinct()


def maintained(kept: dict[str, DataFrame], requests: DataFrame, old: dict[str, DataFrame], new: dict[str, DataFrame], index: dict[str, DataFrame], readiness: str = "ready") -> dict[str, DataFrame]:
    """kept briefs after facts changed from old to new (index: of new): those that the change touches are made anew, the others
    stay as they are; `redone` has the requests of the former."""
    redo = graph.cut(touched(kept, requests, old, new), "touched")
    fresh = kept_briefs(requests.join(redo, "request_id", "left_semi"), new, index, readiness)
    live = lambda df: df.join(redo, "request_id", "left_anti").join(requests.select("request_id"), "request_id", "left_semi")
    return {name: live(kept[name]).unionByName(fresh[name]) for name in ("briefs", "uses", "whole")} | {"redone": redo}


def impact_summary(suggested: DataFrame, scopes: DataFrame) -> DataFrame:
    """For each request with suggested files (request_id, suggested_files) and its scope: what they say of its impact."""
    both = suggested.join(scopes, "request_id").where(F.size("suggested_files") > 0)
    # The text.
    text = F.concat(F.lit("Snapshot-backed exact and structural lookup suggests "), F.size("suggested_files").cast("string"), F.lit(" indexed file(s) are relevant to `"), "scope", F.lit("`."))
    return both.select("request_id", F.col("scope").alias("reference"), text.alias("summary"), F.col("suggested_files").alias("changed_scope"), rules.impact_level(F.size("suggested_files")).alias("freshness_impact"))


#: Kinds of work after a change, with their urgency.
ALWAYS = (("update_exact_index", "immediate"), ("update_lexical_index", "immediate"), ("update_structural_index", "immediate"), ("mark_stale_records", "immediate"))
CODE = (("regenerate_flow_capsules", "soon"), ("regenerate_architecture_capsules", "soon"))


def refresh_jobs(changes: DataFrame) -> DataFrame:
    """Maintenance work for each change set (fingerprint, changed_files, changed_symbols): a row for each job."""
    markdown = lambda f: F.translate(f, "MD", "md").rlike(r"\.(md|markdown)$")
    jobs = lambda pairs: F.array(*[F.struct(F.lit(k).alias("job"), F.lit(u).alias("urgency")) for k, u in pairs])
    none = F.array().cast("array<struct<job:string,urgency:string>>")
    symbols = F.size("changed_symbols") > 0
    all_ = F.concat(
        jobs(ALWAYS), F.when(F.exists("changed_files", lambda f: ~markdown(f)), jobs(CODE)).otherwise(none),
        F.when(symbols | F.exists("changed_files", markdown), jobs([("regenerate_decision_records", "deferred")])).otherwise(none), F.when(symbols, jobs([("build_embeddings", "deferred")])).otherwise(none),
    )
    return changes.select("fingerprint", F.inline(all_))




# How much scaffolding models of each class get.
SCAFFOLDS = {"weak_local_coder": "high", "medium_cloud_coder": "medium", "frontier_agent": "minimal", "custom": "minimal"}


def compile_pack(packs: DataFrame) -> DataFrame:
    """Packs cut to their budget: the first max_items statements, and checks once each, required ones first."""
    checks = F.array_distinct(F.concat("required_checks", "recommended_checks"))
    return packs.withColumn("must_know", F.slice("must_know", F.lit(1), F.col("max_items").cast("int"))).withColumn("verification_targets", checks).withColumn("scaffolding", rules.case(F.col("model_class"), SCAFFOLDS, F.lit("minimal")))
