"""Rule tables as column expressions: classes of requests, routes, budgets, readiness and slots."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_lower, col, contains_any

# The words that decide a request's class.
BUG_WORDS = ("bug", "fix", "broken", "regression", "error", "failing", "failure")
FEATURE_WORDS = ("feature", "implement", "add ", "support ", "introduce", "build ")
WHY_WORDS = ("why", "reason", "rationale", "decision", "tradeoff")
ARCHITECTURE_WORDS = ("architecture", "flow", "how does", "how do", "overview", "explain")

# Slots that each class of request needs, in order.
REQUIRED_SLOTS = {
    "entity_lookup": ("exact_anchor",),
    "architecture_explanation": ("exact_anchor", "structural_context", "flow_summary"),
    "safe_edit": ("exact_anchor", "structural_context", "verification_targets"),
    "bug_fix": ("exact_anchor", "structural_context", "verification_targets", "impact_envelope"),
    "feature_implementation": ("exact_anchor", "structural_context", "flow_summary", "verification_targets", "impact_envelope"),
    "decision_why": ("exact_anchor", "decision_evidence"),
}
# The variant of the retrieval stage.
RETRIEVAL_SLOTS = {
    "entity_lookup": ("exact_anchor",),
    "architecture_explanation": ("structural_context", "flow_summary"),
    "safe_edit": ("exact_anchor", "structural_context", "verification_targets"),
    "bug_fix": ("exact_anchor", "structural_context", "verification_targets"),
    "feature_implementation": ("exact_anchor", "structural_context", "verification_targets"),
    "decision_why": ("exact_anchor", "decision_evidence"),
}
# What a second pass adds to the question for each missing slot.
SECOND_PASS_WORDS = {
    "decision_evidence": "adr decision rationale tradeoff history architecture record",
    "verification_targets": "test verify invariant regression coverage check",
    "structural_context": "import dependency caller callee module relationship",
    "flow_summary": "entrypoint flow path boundary runtime",
    "impact_envelope": "impact blast radius dependent files side effects",
    "exact_anchor": "symbol path declaration",
}


def case(value: Column, table: dict, otherwise=None) -> Column:
    """value looked up in a fixed table."""
    out = None
    for key, result in table.items():
        result = F.array(*[F.lit(x) for x in result]) if isinstance(result, tuple) else F.lit(result)
        out = F.when(value == key, result) if out is None else out.when(value == key, result)
    return out if otherwise is None else out.otherwise(otherwise)


def classify(task: Column | str, goal: Column | str, question: Column | str, bug=BUG_WORDS, feature=FEATURE_WORDS, why=WHY_WORDS, architecture=ARCHITECTURE_WORDS) -> Column:
    """A request's class; words count as substrings."""
    text = ascii_lower(F.concat(col(goal), F.lit(" "), col(question)))
    edit = F.when(contains_any(text, bug), "bug_fix").when(contains_any(text, feature), "feature_implementation").otherwise("safe_edit")
    ask = F.when(contains_any(text, why), "decision_why").when(contains_any(text, architecture), "architecture_explanation").otherwise("entity_lookup")
    task = col(task)
    return F.when(task.isin("repo_onboarding", "explain_flow"), "architecture_explanation").when(task.isin("safe_edit", "blast_radius", "semantic_diff"), edit).when(task == "query", ask)


def latency_class(consumer: Column | str, budget: Column | str, task: Column | str, depth: Column | str) -> Column:
    consumer, budget, task, depth = map(col, (consumer, budget, task, depth))
    by_task = F.when((task == "query") & (depth == "compact"), "instant").when(task.isin("repo_onboarding", "semantic_diff") | (depth == "deep"), "deep").otherwise("interactive")
    by_budget = F.when(budget <= 150, "instant").when(budget <= 800, "interactive").otherwise("deep")
    return F.when(consumer == "background_worker", "background").when(budget.isNotNull(), by_budget).otherwise(by_task)


def candidate_budget(latency: Column | str, task: Column | str) -> Column:
    latency, task = col(latency), col(task)
    return (
        F.when(latency == "instant", F.when(task == "query", 8).otherwise(10))
        .when(latency == "interactive", F.when(task.isin("safe_edit", "blast_radius"), 24).when(task == "explain_flow", 20).otherwise(16))
        .when(latency == "deep", F.when(task.isin("repo_onboarding", "semantic_diff"), 40).when(task == "query", 20).otherwise(32))
        .otherwise(0)
    )


def hop_budget(latency: Column | str) -> Column:
    return case(col(latency), {"instant": 1, "interactive": 2, "deep": 3}, F.lit(0))


def allows_second_pass(latency: Column | str, task: Column | str, depth: Column | str) -> Column:
    return F.when(col(latency) == "interactive", (col(task) != "query") & (col(depth) != "compact")).otherwise(col(latency) == "deep")


def default_freshness(task: Column | str) -> Column:
    return F.when(col(task).isin("safe_edit", "blast_radius", "semantic_diff"), "fresh_preferred").otherwise("any")


def packing_budget(tokens: Column | str, latency: Column | str) -> tuple[Column, Column, Column]:
    """Suggested files, items of a brief, and fragile zones: by tokens, under the caps of the latency class."""
    tokens, latency = col(tokens), col(latency)
    parts = F.ceil(tokens / 4096)
    files = F.when(tokens <= 2048, 4).when(tokens <= 4096, 6).otherwise(F.least(4 + 2 * parts, F.lit(512)))
    items = F.when(tokens <= 2048, 3).when(tokens <= 4096, 5).otherwise(F.least(5 + parts, F.lit(256)))
    cap = lambda a, b, c, d: case(latency, {"instant": a, "interactive": b, "deep": c, "background": d})
    return F.least(files, cap(4, 24, 96, 512)).cast("long"), F.least(items, cap(3, 16, 48, 256)).cast("long"), cap(2, 3, 4, 8).cast("long")


def freshness(readiness: Column | str) -> Column:
    return case(col(readiness), {"ready": "fresh", "stale": "stale"}, F.lit("unverified"))


def impact_level(n: Column | str) -> Column:
    n = col(n)
    return F.when(n <= 1, "none").when(n <= 4, "localized").when(n <= 8, "moderate").otherwise("high")


def readiness_state(availability: Column | str, health: Column | str, current: Column | str) -> Column:
    """Missing is cold and warming warming; what is available goes by health before freshness."""
    availability, health = col(availability), col(health)
    available = F.when(health == "overlay_only", "overlay_only").when(health == "bulk_refresh", "bulk_refresh").when(health == "degraded", "degraded").otherwise(F.when(col(current), "ready").otherwise("stale"))
    return F.when(availability == "missing", "cold").when(availability == "warming", "warming").otherwise(available)


def repo_shape(files: Column | str, imports: Column | str) -> Column:
    """By files and imports for each thousand files."""
    files, density = col(files), F.floor(col(imports) * 1000 / F.greatest(col(files), F.lit(1)))
    return F.when(files <= 64, "tiny").when((files <= 256) & (density < 1000), "small").when((files <= 1024) | (density < 1500), "medium").otherwise("large_dense")


def present(readiness: Column) -> Column:
    return F.when(readiness.isin("stale", "bulk_refresh"), "stale").otherwise("present")


def slot_status(slot: Column, s: dict[str, Column]) -> Column:
    """The status of a slot from a brief's signals.

    s: anchors, suggested, relationships, capsules, required, recommended, targets, impact (null: none), changed,
    decisions, decision_docs, readiness.
    """
    there = present(s["readiness"])
    beyond = s["suggested"] - F.least(s["anchors"], s["suggested"])
    return (
        F.when(slot == "exact_anchor", F.when(s["anchors"] > 0, there).otherwise("missing_retrievable"))
        .when(slot == "structural_context", F.when((beyond > 0) | (s["relationships"] > 0), there).when(s["suggested"] > 0, "not_observable").otherwise("missing_retrievable"))
        .when(slot == "flow_summary", F.when(s["capsules"] > 0, there).otherwise("missing_retrievable"))
        .when(slot == "verification_targets", F.when(s["required"] > 0, there).when((s["recommended"] > 0) | (s["targets"] == 0), "not_observable").otherwise("missing_retrievable"))
        .when(slot == "impact_envelope", F.when(s["impact"].isNull(), "missing_retrievable").when(s["changed"] == 0, "not_observable").otherwise(there))
        .when(slot == "decision_evidence", F.when(s["decisions"] > 0, there).when(s["decision_docs"] > 0, "missing_retrievable").otherwise("not_observable"))
    )


def is_sufficient(status: Column) -> Column:
    return status.isin("present", "not_applicable")


# --- the adaptive second pass ---------------------------------------------------------------------------------------


def threshold_base(cls: Column | str, latency: Column | str) -> Column:
    base = case(col(cls), {"entity_lookup": 0.03, "architecture_explanation": 0.01, "safe_edit": 0.015, "bug_fix": 0.015, "feature_implementation": 0.015, "decision_why": 0.008})
    return base * case(col(latency), {"instant": 1.3, "interactive": 1.0, "deep": 0.65, "background": 1.5})


def recommend_budget(shape: Column, base: Column, max_candidates: Column, hops: Column, observations: Column, missing: Column, healed: Column, ema: Column) -> tuple[Column, Column, Column]:
    """Candidates, hops and the least gain for a second pass, from what earlier ones of the class and shape healed."""
    first = F.least(F.greatest(2 * max_candidates, F.lit(8)), F.lit(96))
    start_hops = F.least(hops + 1, F.lit(3))
    scale = case(shape, {"tiny": 850, "small": 1000, "medium": 1150, "large_dense": 1300})
    shaped = F.when(shape == "tiny", F.greatest(start_hops - 1, F.lit(1))).when(shape == "small", start_hops).otherwise(F.least(start_hops + 1, F.lit(4)))
    known = F.coalesce(observations, F.lit(0)) >= 3
    ratio = F.when(F.coalesce(missing, F.lit(0)) > 0, healed / missing).otherwise(0.0)
    good, poor = known & (ratio >= 0.45), known & (ratio < 0.45) & ((ratio <= 0.15) | (ema < base * 0.5))
    scale = F.least(F.greatest(scale + F.when(good, 200).when(poor, -200).otherwise(0), F.lit(600)), F.lit(1800))
    out_hops = F.when(good, F.least(shaped + 1, F.lit(4))).when(poor, F.greatest(shaped - 1, F.lit(1))).otherwise(shaped)
    least = F.when(known, F.greatest(base, F.least(F.greatest(ema * 0.85, F.lit(0.003)), F.lit(0.08)))).otherwise(base)
    candidates = F.least(F.greatest(F.floor((first * scale + 500) / 1000), F.lit(8)), F.lit(160))
    return candidates.cast("long"), out_hops.cast("long"), least
