"""Queries over rules and roll-ups: classes, routes, audits, briefs, evaluation, string kernels and running state."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as X
from ..operators import brief, decisions, evals, graph, lexical, obligations
from ..streaming import incremental
from . import adapters as A
from . import reports as R
from .registry import Registry

add = Registry()
QUERIES, ORACLES = add.queries, add.oracles

_LOWER = "translate(goal || ' ' || question, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _class_sql(bug: str, feature: str, why: str, arch: str) -> str:
    return f"""classed AS (SELECT *, CASE WHEN task_type IN ('repo_onboarding', 'explain_flow') THEN 'architecture_explanation'
  WHEN task_type = 'query' THEN CASE WHEN regexp_matches({_LOWER}, '{why}') THEN 'decision_why' WHEN regexp_matches({_LOWER}, '{arch}') THEN 'architecture_explanation' ELSE 'entity_lookup' END
  WHEN regexp_matches({_LOWER}, '{bug}') THEN 'bug_fix' WHEN regexp_matches({_LOWER}, '{feature}') THEN 'feature_implementation' ELSE 'safe_edit' END AS classification FROM requests)"""


_CLASS = _class_sql("bug|fix|broken|regression|error|failing|failure", "feature|implement|add |support |introduce|build ", "why|reason|rationale|decision|tradeoff", "architecture|flow|how does|how do|overview|explain")


@add("SELECT request_id, classification FROM classed", (A.REQUESTS, _CLASS))
def i1_classify(spark, d):
    """The class of every request by the rules' words."""
    return A.requests(spark, d).select("request_id", rules.classify("task_type", "goal", "question").alias("classification"))


@add("SELECT request_id, classification FROM classed", (A.REQUESTS, _class_sql("stion|ück", "ation |para ", "thing|mente", "the |der |les ")))
def i1_classify_corpus_words(spark, d):
    """The same with words of the corpus, so that every branch is met."""
    return A.requests(spark, d).select("request_id", rules.classify("task_type", "goal", "question", **A.WORDS).alias("classification"))


_ROUTED = """routed AS (
  SELECT *, CASE latency_class WHEN 'instant' THEN CASE WHEN task_type = 'query' THEN 8 ELSE 10 END WHEN 'interactive' THEN CASE WHEN task_type IN ('safe_edit', 'blast_radius') THEN 24 WHEN task_type = 'explain_flow' THEN 20 ELSE 16 END
      WHEN 'deep' THEN CASE WHEN task_type IN ('repo_onboarding', 'semantic_diff') THEN 40 WHEN task_type = 'query' THEN 20 ELSE 32 END ELSE 0 END AS max_candidates,
    CASE latency_class WHEN 'instant' THEN 1 WHEN 'interactive' THEN 2 WHEN 'deep' THEN 3 ELSE 0 END AS max_hops,
    CASE latency_class WHEN 'interactive' THEN task_type <> 'query' AND depth <> 'compact' ELSE latency_class = 'deep' END AS second_pass,
    CASE WHEN task_type IN ('safe_edit', 'blast_radius', 'semantic_diff') THEN 'fresh_preferred' ELSE 'any' END AS freshness_default,
    least(CASE WHEN token_budget <= 2048 THEN 3 WHEN token_budget <= 4096 THEN 5 ELSE 5 + ceil(token_budget / 4096.0) END, CASE latency_class WHEN 'instant' THEN 3 WHEN 'interactive' THEN 16 WHEN 'deep' THEN 48 ELSE 256 END)::BIGINT AS max_items,
    least(CASE WHEN token_budget <= 2048 THEN 4 WHEN token_budget <= 4096 THEN 6 ELSE 4 + 2 * ceil(token_budget / 4096.0) END, CASE latency_class WHEN 'instant' THEN 4 WHEN 'interactive' THEN 24 WHEN 'deep' THEN 96 ELSE 512 END)::BIGINT AS max_files,
    CASE latency_class WHEN 'instant' THEN 2 WHEN 'interactive' THEN 3 WHEN 'deep' THEN 4 ELSE 8 END AS max_zones, (ceil(token_budget / 1024.0) * 1024)::BIGINT AS token_bucket
  FROM (SELECT *, CASE WHEN consumer_type = 'background_worker' THEN 'background' WHEN latency_budget <= 150 THEN 'instant' WHEN latency_budget <= 800 THEN 'interactive' WHEN latency_budget IS NOT NULL THEN 'deep'
      WHEN task_type = 'query' AND depth = 'compact' THEN 'instant' WHEN task_type IN ('repo_onboarding', 'semantic_diff') OR depth = 'deep' THEN 'deep' ELSE 'interactive' END AS latency_class FROM classed)
)"""


@add("SELECT request_id, latency_class, max_candidates, max_hops, second_pass, freshness_default, max_files, max_items, max_zones, token_bucket FROM routed", (A.REQUESTS, _CLASS, _ROUTED))
def i2_i4_f17_route(spark, d):
    """Latency class and all budgets of every request."""
    return brief.route(A.requests(spark, d)).select("request_id", "latency_class", "max_candidates", "max_hops", "second_pass", "freshness_default", "max_files", "max_items", "max_zones", "token_bucket")


_SLOTS = """slots AS (
  SELECT request_id, classification, unnest(s) AS slot, unnest(range(len(s))) AS place FROM (SELECT *, CASE classification WHEN 'entity_lookup' THEN ['exact_anchor'] WHEN 'architecture_explanation' THEN ['exact_anchor', 'structural_context', 'flow_summary']
    WHEN 'safe_edit' THEN ['exact_anchor', 'structural_context', 'verification_targets'] WHEN 'bug_fix' THEN ['exact_anchor', 'structural_context', 'verification_targets', 'impact_envelope']
    WHEN 'feature_implementation' THEN ['exact_anchor', 'structural_context', 'flow_summary', 'verification_targets', 'impact_envelope'] ELSE ['exact_anchor', 'decision_evidence'] END AS s FROM classed)
)"""
_CORPUS_CLASS = _class_sql("stion|ück", "ation |para ", "thing|mente", "the |der |les ")


def _classed(spark, d):
    return A.requests(spark, d).withColumn("classification", rules.classify("task_type", "goal", "question", **A.WORDS))


@add("SELECT request_id, slot, place FROM slots", (A.REQUESTS, _CORPUS_CLASS, _SLOTS))
def i6_required_slots(spark, d):
    return brief.required_slots(_classed(spark, d)).select("request_id", "slot", "place")


@add(
    """SELECT classification, slot, count(*) AS n FROM (SELECT classification, unnest(CASE classification WHEN 'entity_lookup' THEN ['exact_anchor'] WHEN 'architecture_explanation' THEN ['structural_context', 'flow_summary'] WHEN 'decision_why' THEN ['exact_anchor', 'decision_evidence']
  ELSE ['exact_anchor', 'structural_context', 'verification_targets'] END) AS slot FROM classed) GROUP BY ALL""",
    (A.REQUESTS, _CORPUS_CLASS),
)
def i7_retrieval_slots(spark, d):
    """The retrieval stage's own table of slots."""
    return brief.required_slots(_classed(spark, d), rules.RETRIEVAL_SLOTS).groupBy("classification", "slot").agg(F.count("*").alias("n"))


_SIGNALS = """signals AS (
  SELECT request_id AS r, length(goal) % 2 AS anchors, length(goal) % 4 AS suggested, length(goal) % 3 AS relationships, length(goal) % 5 AS capsules, length(goal) % 2 AS required, length(goal) % 3 AS recommended, length(goal) % 7 AS targets,
    CASE WHEN length(goal) % 3 > 0 THEN 'impact' END AS impact, length(goal) % 4 AS changed, length(goal) % 2 AS decisions, length(goal) % 3 AS decision_docs, (['ready', 'stale', 'bulk_refresh', 'warming'])[1 + length(goal) % 4] AS readiness FROM requests
)"""
_AUDIT = """audited AS (
  SELECT *, CASE slot WHEN 'exact_anchor' THEN CASE WHEN anchors > 0 THEN p ELSE 'missing_retrievable' END
    WHEN 'structural_context' THEN CASE WHEN suggested - least(anchors, suggested) > 0 OR relationships > 0 THEN p WHEN suggested > 0 THEN 'not_observable' ELSE 'missing_retrievable' END
    WHEN 'flow_summary' THEN CASE WHEN capsules > 0 THEN p ELSE 'missing_retrievable' END
    WHEN 'verification_targets' THEN CASE WHEN required > 0 THEN p WHEN recommended > 0 OR targets = 0 THEN 'not_observable' ELSE 'missing_retrievable' END
    WHEN 'impact_envelope' THEN CASE WHEN impact IS NULL THEN 'missing_retrievable' WHEN changed = 0 THEN 'not_observable' ELSE p END
    ELSE CASE WHEN decisions > 0 THEN p WHEN decision_docs > 0 THEN 'missing_retrievable' ELSE 'not_observable' END END AS status
  FROM (SELECT *, CASE WHEN readiness IN ('stale', 'bulk_refresh') THEN 'stale' ELSE 'present' END AS p FROM slots JOIN signals ON r = request_id)
)"""


def _audited(spark, d):
    n = F.char_length("goal")
    r = _classed(spark, d)
    signals = r.select(
        "request_id", (n % 2).alias("anchors"), (n % 4).alias("suggested"), (n % 3).alias("relationships"), (n % 5).alias("capsules"), (n % 2).alias("required"), (n % 3).alias("recommended"), (n % 7).alias("targets"), F.when(n % 3 > 0, "impact").alias("impact"),
        (n % 4).alias("changed"), (n % 2).alias("decisions"), (n % 3).alias("decision_docs"), F.get(F.array(*[F.lit(x) for x in ("ready", "stale", "bulk_refresh", "warming")]), n % 4).alias("readiness"),
    )
    return r, brief.audit(brief.required_slots(r), signals)


@add("SELECT request_id, slot, status, status = 'present' AS sufficient FROM audited", (A.REQUESTS, _CORPUS_CLASS, _SLOTS, _SIGNALS, _AUDIT))
def i5_slot_audit(spark, d):
    """The status of every required slot, over signals that reach each rule."""
    return _audited(spark, d)[1].select("request_id", "slot", "status", "sufficient")


@add(
    """SELECT request_id, bool_and(status = 'present') AS sufficient, coalesce(list(slot ORDER BY place) FILTER (status <> 'present'), []) AS insufficient_slots, bool_or(status = 'missing_retrievable') AND any_value(classification) <> 'entity_lookup' AS wants_second_pass FROM audited GROUP BY request_id""",
    (A.REQUESTS, _CORPUS_CLASS, _SLOTS, _SIGNALS, _AUDIT),
)
def i5_audit_summary(spark, d):
    return brief.audit_summary(_audited(spark, d)[1]).select("request_id", "sufficient", "insufficient_slots", "wants_second_pass")


@add(
    """SELECT request_id, slot, ' ' || question || ' ' || CASE slot WHEN 'decision_evidence' THEN 'adr decision rationale tradeoff history architecture record' WHEN 'verification_targets' THEN 'test verify invariant regression coverage check'
  WHEN 'structural_context' THEN 'import dependency caller callee module relationship' WHEN 'flow_summary' THEN 'entrypoint flow path boundary runtime' WHEN 'impact_envelope' THEN 'impact blast radius dependent files side effects' ELSE 'symbol path declaration' END AS text
FROM audited JOIN requests USING (request_id) WHERE status = 'missing_retrievable'""",
    (A.REQUESTS, _CORPUS_CLASS, _SLOTS, _SIGNALS, _AUDIT),
)
def i14_second_pass_queries(spark, d):
    r, audited = _audited(spark, d)
    return brief.second_pass_queries(r.withColumn("scope_hint", F.lit("")), audited).select("request_id", "slot", "text")


@add(
    """SELECT r.n AS readiness, c.n AS changed, CASE r.n WHEN 'ready' THEN 'fresh' WHEN 'stale' THEN 'stale' ELSE 'unverified' END AS freshness, CASE WHEN c.n <= 1 THEN 'none' WHEN c.n <= 4 THEN 'localized' WHEN c.n <= 8 THEN 'moderate' ELSE 'high' END AS level
FROM (VALUES ('ready'), ('stale'), ('warming'), ('cold')) r(n), (SELECT DISTINCT n_nationkey AS n FROM nation) c"""
)
def i8_freshness_impact(spark, d):
    n = A.table(spark, d, "nation").select(F.col("n_nationkey").alias("changed")).distinct()
    out = n.select("changed", F.explode(F.array(*[F.lit(x) for x in ("ready", "stale", "warming", "cold")])).alias("readiness"))
    return out.select("readiness", "changed", rules.freshness("readiness").alias("freshness"), rules.impact_level("changed").alias("level"))


@add(
    """, seen AS (SELECT (['missing', 'warming', 'available'])[k % 3 + 1] AS a, (['normal', 'overlay_only', 'bulk_refresh', 'degraded'])[k % 4 + 1] AS h, user_id % 2 = 0 AS c FROM obs)
SELECT a, h, c, count(*) AS n, CASE a WHEN 'missing' THEN 'cold' WHEN 'warming' THEN 'warming' ELSE CASE h WHEN 'overlay_only' THEN h WHEN 'bulk_refresh' THEN h WHEN 'degraded' THEN h ELSE CASE WHEN c THEN 'ready' ELSE 'stale' END END END AS state
FROM seen GROUP BY a, h, c""".lstrip(", "),
    (A.OBSERVATIONS,),
)
def i9_readiness(spark, d):
    """Availability, health and freshness that events tell, and the state that follows."""
    k = F.get_json_object("props", "$.k").cast("long")
    of = lambda n, *v: F.get(F.array(*[F.lit(x) for x in v]), (k % n).cast("int"))
    e = A.table(spark, d, "events").select(of(3, "missing", "warming", "available").alias("a"), of(4, "normal", "overlay_only", "bulk_refresh", "degraded").alias("h"), (F.col("user_id") % 2 == 0).alias("c"))
    return e.groupBy("a", "h", "c").agg(F.count("*").alias("n")).withColumn("state", rules.readiness_state("a", "h", "c"))


_SHAPES = """CASE WHEN files <= 64 THEN 'tiny' WHEN files <= 256 AND density < 1000 THEN 'small' WHEN files <= 1024 OR density < 1500 THEN 'medium' ELSE 'large_dense' END"""


@add(f"SELECT source, lang, files, {_SHAPES} AS shape FROM (SELECT source, lang, count(*) AS files, sum(length(text)) // 2000 * 1000 // count(*) AS density FROM documents GROUP BY GROUPING SETS ((source, lang), (source), (lang), ()))")
def e1_repo_shape(spark, d):
    """The shape of each source and language taken for a repository; two thousand characters taken for an import."""
    g = A.table(spark, d, "documents").groupingSets([["source", "lang"], ["source"], ["lang"], []], "source", "lang").agg(F.count("*").alias("files"), F.floor(F.sum(F.char_length("text")) / 2000).alias("imports"))
    return g.select("source", "lang", "files", rules.repo_shape("files", "imports").alias("shape"))


@add(
    """SELECT event_id, greatest(8, least(160, floor((first_c * scale + 500) / 1000)))::BIGINT AS candidates, hops, round(least_gain, 9) AS least_gain FROM (
  SELECT *, greatest(600, least(1800, CASE shape WHEN 'tiny' THEN 850 WHEN 'small' THEN 1000 WHEN 'medium' THEN 1150 ELSE 1300 END + CASE WHEN good THEN 200 WHEN poor THEN -200 ELSE 0 END)) AS scale,
    CASE WHEN good THEN least(shaped + 1, 4) WHEN poor THEN greatest(shaped - 1, 1) ELSE shaped END AS hops, CASE WHEN obs >= 3 THEN greatest(base, least(0.08, greatest(0.003, 0.85 * ema))) ELSE base END AS least_gain
  FROM (SELECT *, obs >= 3 AND ratio >= 0.45 AS good, obs >= 3 AND ratio < 0.45 AND (ratio <= 0.15 OR ema < 0.5 * base) AS poor,
      CASE shape WHEN 'tiny' THEN greatest(start_hops - 1, 1) WHEN 'small' THEN start_hops ELSE least(start_hops + 1, 4) END AS shaped
    FROM (SELECT *, CASE WHEN missing > 0 THEN healed / missing ELSE 0.0 END AS ratio, least(96, greatest(8, 2 * mc)) AS first_c, least(h + 1, 3) AS start_hops
      FROM (SELECT event_id, (['tiny', 'small', 'medium', 'large_dense'])[1 + user_id % 4] AS shape, user_id % 6 AS obs, k AS missing, k // 3 AS healed, value / 10000 AS ema, 0.015 AS base, k % 40 AS mc, k % 4 AS h FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)))))"""
)
def i15_adaptive_budget(spark, d):
    """Budgets of a second pass, over outcomes that events stand for."""
    k = F.get_json_object("props", "$.k").cast("long")
    e = A.table(spark, d, "events").select("event_id", F.get(F.array(*[F.lit(x) for x in ("tiny", "small", "medium", "large_dense")]), (F.col("user_id") % 4).cast("int")).alias("shape"), (F.col("user_id") % 6).alias("obs"), k.alias("missing"), F.floor(k / 3).alias("healed"), (F.col("value") / 10000).alias("ema"), (k % 40).alias("mc"), (k % 4).alias("h"))
    c, h, g = rules.recommend_budget(F.col("shape"), F.lit(0.015), F.col("mc"), F.col("h"), F.col("obs"), F.col("missing"), F.col("healed"), F.col("ema"))
    return e.select("event_id", c.alias("candidates"), h.alias("hops"), F.round(g, 9).alias("least_gain"))


@add(
    """SELECT doc_id, job, urgency FROM (SELECT doc_id, unnest([{'job': 'update_exact_index', 'urgency': 'immediate'}, {'job': 'update_lexical_index', 'urgency': 'immediate'}, {'job': 'update_structural_index', 'urgency': 'immediate'}, {'job': 'mark_stale_records', 'urgency': 'immediate'}], recursive := true) FROM documents)
UNION ALL SELECT doc_id, unnest(['regenerate_flow_capsules', 'regenerate_architecture_capsules']), 'soon' FROM documents WHERE lang IN ('en', 'de')
UNION ALL SELECT doc_id, 'regenerate_decision_records', 'deferred' FROM documents WHERE lang IN ('fr', 'es') OR length(text) > 500 UNION ALL SELECT doc_id, 'build_embeddings', 'deferred' FROM documents WHERE length(text) > 500"""
)
def i17_refresh_jobs(spark, d):
    """Maintenance work for each document taken for a change: code or markdown by language, symbols by length."""
    doc = A.table(spark, d, "documents")
    files = F.array(F.when(F.col("lang").isin("en", "de"), "a.rs").otherwise("a.md"))
    changes = doc.select(F.col("doc_id").alias("fingerprint"), files.alias("changed_files"), F.when(F.char_length("text") > 500, F.array(F.lit("s"))).otherwise(F.array().cast("array<string>")).alias("changed_symbols"))
    return brief.refresh_jobs(changes).withColumnRenamed("fingerprint", "doc_id")


# --- evaluation ------------------------------------------------------------------------------------------------------

_RATES = "count(*) FILTER (observed = 'a') / count(*) AS match_rate, count(*) FILTER (sufficient) / count(*) AS sufficient_rate, sum(len(good)) / sum(3) AS hit_rate, greatest(0.0, sum(len(good)) / sum(3) - count(*) FILTER (k % 2 = 0) / sum(3)) AS uplift"


@add(f"SELECT scenario, {_RATES} FROM obs GROUP BY scenario", (A.OBSERVATIONS,))
def e7_rates(spark, d):
    return evals.rates(A.observations(spark, d), ["scenario"])


@add(
    """, c AS (SELECT scenario, arg_min(good, run) AS cg, arg_min(ev, run) AS cev FROM obs WHERE mutation = 'canonical' GROUP BY scenario)
SELECT round(avg(CASE WHEN len(cg) = 0 THEN 1.0 ELSE len(list_intersect(cg, good)) / len(cg) END), 9) AS retention, round(avg(CASE WHEN len(cev) = 0 AND len(ev) = 0 THEN 1.0 ELSE len(list_intersect(cev, ev)) / len(list_distinct(list_concat(cev, ev))) END), 9) AS overlap
FROM obs JOIN c USING (scenario) WHERE mutation <> 'canonical'""".lstrip(", "),
    (A.OBSERVATIONS,),
)
def e6_mutation_robustness(spark, d):
    return evals.mutation_robustness(A.observations(spark, d)).select(F.round("retention", 9).alias("retention"), F.round("overlap", 9).alias("overlap"))


@add("SELECT scenario, list_sort(list(value))[1 + (count(*) - 1) * 50 // 100] AS p50, list_sort(list(value))[1 + (count(*) - 1) * 95 // 100] AS p95 FROM obs GROUP BY scenario", (A.OBSERVATIONS,))
def e8_percentiles(spark, d):
    """Exact percentiles by rank, rounded down."""
    return evals.percentile_by(A.observations(spark, d), ["scenario"], "value", [50, 95])


@add("SELECT user_id, list_sort(list(value) FILTER (value > 100))[1 + (count(*) FILTER (value > 100) - 1) * 95 // 100] AS p95 FROM obs WHERE value > 100 GROUP BY user_id", (A.OBSERVATIONS,))
def e11_cost_distribution(spark, d):
    """The same by user, over costs above a limit."""
    return evals.percentile_by(A.observations(spark, d).where("value > 100"), ["user_id"], "value", [95])


@add("SELECT scenario, floor(sum(elapsed_micros) / count(*))::BIGINT AS mean_micros, max(elapsed_micros) AS max_micros FROM obs GROUP BY scenario", (A.OBSERVATIONS,))
def e9_latency(spark, d):
    return evals.latency(A.observations(spark, d), ["scenario"])


@add("SELECT scenario, round(CASE WHEN sum(value) > 0 THEN sum(k % 4) / sum(value) END, 9) AS healed_per_ms FROM obs GROUP BY scenario", (A.OBSERVATIONS,))
def e10_healed_per_ms(spark, d):
    return evals.healed_per_ms(A.observations(spark, d), ["scenario"]).select("scenario", F.round("healed_per_ms", 9).alias("healed_per_ms"))


@add("SELECT round(avg(value / 500), 9) AS baseline, round(avg(value / 400), 9) AS uplifted, round(avg(value / 400 - value / 500), 9) AS delta, round(avg(elapsed_micros), 6) AS latency_ms FROM obs", (A.OBSERVATIONS,))
def e12_summary(spark, d):
    o = A.observations(spark, d).select((F.col("value") / 500).alias("baseline_score"), (F.col("value") / 400).alias("uplifted_score"), F.col("elapsed_micros").alias("latency_ms"))
    s = evals.summarize(o)
    return s.select(*[F.round(c, 9).alias(c) for c in ("baseline", "uplifted", "delta")], F.round("latency_ms", 6).alias("latency_ms"))


@add("SELECT request_id, count(*) FILTER (status <> 'present' AND p = 'present') AS gained, count(*) AS slots FROM audited GROUP BY request_id", (A.REQUESTS, _CORPUS_CLASS, _SLOTS, _SIGNALS, _AUDIT))
def e13_gained_slots(spark, d):
    """Slots gained if everything were present, or stale where the snapshot is."""
    _, before = _audited(spark, d)
    n = F.char_length("goal")
    fresh = A.requests(spark, d).select("request_id", F.when(n % 4 == 1, "stale").when(n % 4 == 2, "stale").otherwise("present").alias("status"))
    return evals.gained_slots(before, before.select("request_id", "slot").join(fresh, "request_id"))


@add(
    r"""SELECT item_id, m AS mutation, CASE m WHEN 'terse' THEN array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '')[:7], ' ') WHEN 'symbolic_noise' THEN text || ' (@_@)' ELSE replace(replace(replace(text, 'retrieval', 'retrival'), 'decision', CASE m WHEN 'typo' THEN 'decison' ELSE 'decision' END), 'retrival', CASE m WHEN 'typo' THEN 'retrival' ELSE 'retrieval' END) END AS question
FROM benchmark, (VALUES ('canonical'), ('terse'), ('typo'), ('symbolic_noise')) v(m)"""
)
def j17_mutations(spark, d):
    b = A.table(spark, d, "benchmark").select("item_id", "text", F.explode(F.array(*[F.lit(m) for m in evals.MUTATIONS])).alias("mutation"))
    return b.select("item_id", "mutation", evals.mutated_question(F.col("text"), F.col("mutation")).alias("question"))


@add("SELECT n_nationkey AS n, r_regionkey AS whole, CASE WHEN r_regionkey = 0 THEN 100 ELSE n_nationkey * 100 // r_regionkey END AS percent, CASE WHEN r_regionkey <> 0 THEN n_nationkey / r_regionkey END AS share FROM nation, region")
def e20_ratios(spark, d):
    n = A.table(spark, d, "nation").select(F.col("n_nationkey").alias("n")).join(F.broadcast(A.table(spark, d, "region").select(F.col("r_regionkey").alias("whole"))))  # five rows
    return n.select("n", "whole", F.when(F.col("whole") == 0, 100).otherwise(F.floor(F.col("n") * 100 / F.col("whole"))).alias("percent"), evals.ratio(F.col("n"), F.col("whole")).alias("share"))


# --- rankings --------------------------------------------------------------------------------------------------------


@add(
    """SELECT lang AS request_id, relative_path, part, place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY part, k, relative_path) AS place FROM (
  SELECT lang, relative_path, min(part) AS part, arg_min(k, (part, k)) AS k FROM (SELECT language AS lang, relative_path, 0 AS part, 0 AS k FROM files WHERE size_bytes > 5000 UNION ALL
    SELECT language, relative_path, 1, row_number() OVER (PARTITION BY language ORDER BY relative_path) FROM files WHERE size_bytes BETWEEN 1000 AND 8000 UNION ALL SELECT language, relative_path, 2, 1 FROM files) GROUP BY ALL)) WHERE place <= 200""",
    (A.FILES,),
)
def c14_suggested_files(spark, d):
    f = A.files(spark, d).withColumnRenamed("language", "request_id")
    hits = f.where("size_bytes between 1000 and 8000").withColumn("place", F.row_number().over(W.partitionBy("request_id").orderBy("relative_path")))
    budget = f.select("request_id").distinct().withColumn("max_files", F.lit(200))
    return brief.suggested_files(f.where("size_bytes > 5000"), hits, f.withColumn("hop", F.lit(1)), budget)


@add(
    """SELECT lang AS request_id, relative_path, hop, place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY hop, relative_path) AS place FROM (SELECT language AS lang, relative_path, min(h) AS hop FROM (SELECT language, relative_path, 2 AS h FROM files UNION ALL SELECT language, relative_path, 1 FROM files WHERE size_bytes > 3000) GROUP BY ALL)) WHERE place <= 50""",
    (A.FILES,),
)
def f13_merge_neighbours(spark, d):
    f = A.files(spark, d).withColumnRenamed("language", "request_id")
    return brief.merge_neighbours(f.withColumn("hop", F.lit(2)), f.where("size_bytes > 3000").withColumn("hop", F.lit(1)), 50)


@add(
    """, t AS (SELECT source AS r, doc_id, length(text) > 2000 AS hit, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS place FROM documents),
w AS (SELECT *, coalesce(sum(hit::INT) OVER b, 0) AS hits, coalesce(max(CASE WHEN hit THEN place END) OVER b, 0) AS last FROM t WHERE place <= 96 WINDOW b AS (PARTITION BY r ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s AS (SELECT *, coalesce(bool_or(hits >= 6 OR (hits >= 4 AND place - 1 - last >= 6)) OVER (PARTITION BY r ORDER BY place), false) AS stopped FROM w)
SELECT r AS request_id, place FROM s WHERE hit AND NOT stopped""".replace(", t AS", "WITH t AS", 1),
)
def f10_cut_off(spark, d):
    """A scan of each source's documents that stops early, long documents taken for hits."""
    doc = A.table(spark, d, "documents").select(F.col("source").alias("request_id"), (F.char_length("text") > 2000).alias("hit"), F.row_number().over(W.partitionBy("source").orderBy("doc_id")).alias("place"))
    return decisions.cut_off(doc, 4)


@add(
    """SELECT source AS id, CASE WHEN source < 'src12' THEN 4 WHEN source < 'src2' THEN 2 ELSE 1 END AS readiness, strategy_rank, score, source_pair FROM (SELECT doc_id, source, lang AS source_pair, length(text) AS score, doc_id % 5 AS strategy_rank, row_number() OVER (ORDER BY CASE WHEN source < 'src12' THEN 4 WHEN source < 'src2' THEN 2 ELSE 1 END DESC, doc_id % 5 DESC, length(text) DESC, lang, source) AS n FROM documents) WHERE n <= 32"""
)
def f12_translation_order(spark, d):
    """The 32 pairs that translation validation takes first, of pairs that documents stand for."""
    strategy = F.get(F.array(*[F.lit(x) for x in ("none", "signature_similarity", "same_name_language", "behavioral_profile_exact", "exact_path_name")]), (F.col("doc_id") % 5).cast("int"))
    rust = F.when(F.col("source") < "src2", "rust").otherwise("python")
    manifest = F.when(F.col("source") < "src12", "Cargo.toml")
    p = A.table(spark, d, "documents").select(F.col("source").alias("id"), F.col("lang").alias("source_pair"), F.char_length("text").alias("score"), strategy.alias("strategy"), rust.alias("ref_language"), rust.alias("tgt_language"), manifest.alias("ref_manifest"), manifest.alias("tgt_manifest"))
    return obligations.translation_order(p, 32).select("id", "readiness", "strategy_rank", "score", "source_pair")


@add(
    """SELECT lang AS request_id, part, zone, place FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY part, zone) AS place FROM (SELECT language AS lang, 0 AS part, relative_path AS zone FROM files WHERE size_bytes <= 5000 UNION ALL SELECT language, 1, relative_path FROM files WHERE size_bytes > 9000)) WHERE place <= 200""",
    (A.FILES,),
)
def f16_fragile_zones(spark, d):
    f = A.files(spark, d).withColumnRenamed("language", "request_id")
    gaps = f.where("size_bytes > 9000").groupBy("request_id").agg(F.collect_list("relative_path").alias("coverage_gaps"))
    return brief.fragile_zones(f, f.where("size_bytes > 5000"), gaps, 200)


# --- string kernels --------------------------------------------------------------------------------------------------


@add(r"SELECT url, trim(translate(regexp_replace(regexp_replace(url, '([A-Z])', ' \1', 'g'), '[^0-9A-Za-z]+', ' ', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS name, regexp_replace(lower(url), '[^0-9a-z]', '_', 'g') AS id FROM pages")
def j1_normalize_identifier(spark, d):
    return A.table(spark, d, "pages").select("url", X.normalize_identifier("url").alias("name"), X.sanitize_id("url").alias("id"))


@add(
    r"""SELECT url, 'tokens=' || len(t) || ';pattern=' || array_to_string(list_transform(t[:4], lambda x: CASE WHEN length(x) <= 3 THEN 's' WHEN length(x) <= 6 THEN 'm' ELSE 'l' END), '') || ';extra=' || greatest(0, len(t) - 4) || ';digits=' || length(regexp_replace(url, '[^0-9]', '', 'g')) AS shape
FROM (SELECT url, list_filter(regexp_split_to_array(regexp_replace(url, '([A-Z])', ' \1', 'g'), '[^0-9A-Za-z]+'), lambda x: x <> '') AS t FROM pages)"""
)
def j2_identifier_shape(spark, d):
    return A.table(spark, d, "pages").select("url", X.identifier_shape("url").alias("shape"))


@add(
    """SELECT p1.p_name AS a, p2.p_name AS b, (len(list_intersect(x, y)) * 20 + len(list_distinct(list_concat(x, y))) // 2) // len(list_distinct(list_concat(x, y))) AS score FROM (SELECT DISTINCT p_name, list_distinct(string_split(p_name, ' ')) AS x FROM part) p1 JOIN (SELECT DISTINCT p_name, list_distinct(string_split(p_name, ' ')) AS y FROM part) p2 ON split_part(p1.p_name, ' ', 1) = split_part(p2.p_name, ' ', 1)"""
)
def j3_identifier_similarity(spark, d):
    """Part names that share their first word."""
    n = A.table(spark, d, "part").select("p_name").distinct().withColumn("k", F.substring_index("p_name", " ", 1))
    return n.select("k", F.col("p_name").alias("a")).join(n.select("k", F.col("p_name").alias("b")), "k").select("a", "b", X.identifier_similarity("a", "b").cast("long").alias("score"))


_STOP = "'" + "', '".join(X.PROBE_STOP_WORDS) + "'"


@add(
    rf"""SELECT item_id, list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, '[A-Z]?[0-9a-z]+|[A-Z]'), lambda x: lower(x)), lambda x: length(x) >= 3 AND NOT list_contains([{_STOP}], x)))) AS terms FROM benchmark"""
)
def j4_camel_terms(spark, d):
    return A.table(spark, d, "benchmark").select("item_id", X.camel_terms("text").alias("terms"))


@add(
    """SELECT url, coalesce('ADR-' || nullif(regexp_extract(lower(u), 'adr-([0-9]+)', 1), ''), trim(translate(regexp_replace(regexp_extract(u, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1'), '_-', '  '))) AS title, coalesce('ADR-' || nullif(regexp_extract(lower(u), 'adr-([0-9]+)', 1), ''), '') AS adr
FROM (SELECT url, CASE WHEN contains(url, 'en/') THEN url ELSE replace(url, '/', '/adr-') END AS u FROM pages)"""
)
def j7_titles(spark, d):
    u = F.when(F.contains("url", F.lit("en/")), F.col("url")).otherwise(F.replace("url", F.lit("/"), F.lit("/adr-")))
    p = A.table(spark, d, "pages").select("url", u.alias("u"))
    adr = F.regexp_extract(F.lower("u"), "adr-([0-9]+)", 1)
    return p.select("url", F.when(adr != "", F.concat(F.lit("ADR-"), adr)).otherwise(X.title_from_path("u")).alias("title"), F.when(adr != "", F.concat(F.lit("ADR-"), adr)).otherwise(F.lit("")).alias("adr"))


@add(r"SELECT url, nullif(regexp_extract(url, '([^:/.]+)[:/.]*$', 1), '') AS leaf, regexp_extract(url, '^(.*)/[^/]*$', 1) AS parent FROM pages")
def j8_j10_paths(spark, d):
    return A.table(spark, d, "pages").select("url", X.import_leaf("url").alias("leaf"), X.parent_dir("url").alias("parent"))


@add("SELECT doc_id, CASE WHEN length(trim(text)) > 160 THEN trim(text)[:160] || '...' ELSE trim(text) END AS snippet FROM documents")
def j9_snippets(spark, d):
    return A.table(spark, d, "documents").select("doc_id", X.compact_snippet("text").alias("snippet"))


@add("SELECT n_name, array_to_string(list_filter([n_name, 'x', r_name], lambda s: true), '/') AS path FROM nation JOIN region ON n_regionkey = r_regionkey")
def j10_normalize_segments(spark, d):
    """Paths with dots, empty parts and steps up, as plain ones."""
    n, r = A.table(spark, d, "nation"), A.table(spark, d, "region")
    raw = F.concat(F.lit("/"), "n_name", F.lit("//./gone/../x/y/z/../../"), "r_name", F.lit("/."))
    return n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).select("n_name", X.normalize_segments(raw).alias("path"))  # five regions


@add("SELECT DISTINCT relative_path, 'ev_decision_document_' || regexp_replace(lower(relative_path), '[^0-9a-z]', '_', 'g') AS doc, 'ev_file_anchor_' || regexp_replace(lower(relative_path), '[^0-9a-z]', '_', 'g') || '_path' AS anchor, 'docs::worktree::overlay' AS fingerprint FROM files", (A.FILES,))
def j16_receipts(spark, d):
    f = A.files(spark, d)
    return f.select("relative_path", X.receipt_id("decision_document", "relative_path").alias("doc"), X.receipt_id("file_anchor", "relative_path", "_path").alias("anchor"), X.snapshot_fingerprint("snapshot_id", F.lit(None).cast("string"), F.lit(True)).alias("fingerprint"))


@add("SELECT id, count(*) AS parts FROM (SELECT relative_path AS id FROM files UNION ALL SELECT relative_path FROM files WHERE language = 'en') GROUP BY id HAVING count(*) >= 1", (A.FILES,))
def f18_receipt_union(spark, d):
    """Receipts of two parts, one for each id; how many there were."""
    f = A.files(spark, d).select(F.lit(0).alias("request_id"), F.col("relative_path").alias("id"), "language")
    one = brief.merge_receipts(f, f.where("language = 'en'"))
    n = f.unionByName(f.where("language = 'en'")).groupBy("id").agg(F.count("*").alias("parts"))
    return one.join(n, "id").select("id", "parts")


# --- running state ---------------------------------------------------------------------------------------------------

_EMA = "list_reduce(list(value ORDER BY ts, value), lambda a, x: 0.7 * a + 0.3 * x)"


@add(f"SELECT user_id, count(*) AS observations, CAST(sum(k) AS BIGINT) AS missing, CAST(sum(k // 3) AS BIGINT) AS healed, CAST(sum(k) - sum(k // 3) AS BIGINT) AS unresolved, round({_EMA}, 6) AS ema FROM obs GROUP BY user_id", (A.OBSERVATIONS,))
def k3_running_stats(spark, d):
    """State of each user's outcomes and the moving mean of gain by time."""
    e = A.table(spark, d, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    o = e.select("user_id", F.col("ts").alias("at"), F.col("value").alias("gain"), k.alias("missing"), F.floor(k / 3).alias("healed"))
    return incremental.running_stats(o, ["user_id"]).withColumn("ema", F.round("ema", 6))


@add(
    """, o AS (SELECT user_id, run, ts, value, list(value) OVER (PARTITION BY user_id ORDER BY ts, run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM obs)
SELECT user_id, run, round(CASE WHEN len(past) > 0 THEN list_reduce(past, lambda a, x: 0.7 * a + 0.3 * x) END, 6) AS forecast, coalesce(list_reduce(CASE WHEN len(past) > 0 THEN past END, lambda a, x: 0.7 * a + 0.3 * x) >= 60, true) AS goes_on FROM o""".lstrip(", "),
    (A.OBSERVATIONS,),
)
def k4_controller(spark, d):
    """Before each outcome the forecast from those before, and whether a controller goes on."""
    o = A.table(spark, d, "events").select("user_id", F.col("event_id").alias("run"), F.struct("ts", "event_id").alias("at"), F.col("value").alias("gain"))
    return incremental.controller(o, ["user_id"], 60.0).select("user_id", "run", F.round("forecast", 6).alias("forecast"), "goes_on")


# --- whole briefs ----------------------------------------------------------------------------------------------------


@add(
    """SELECT t AS request_id, 'safe_edit' AS classification, 'interactive' AS latency_class, 2 AS max_hops, 24 AS max_candidates, files AS suggested_files, [] AS required_checks, ['cargo xtask check'] AS recommended_checks, [] AS coverage_gaps, [] AS decision_docs,
  CASE WHEN n <= 1 THEN 'none' WHEN n <= 4 THEN 'localized' WHEN n <= 8 THEN 'moderate' ELSE 'high' END AS impact_level, false AS sufficient, ['verification_targets'] AS insufficient_slots, false AS second_pass, 'ready' AS readiness
FROM suggested JOIN (SELECT t, count(*) AS n FROM near GROUP BY t) USING (t)""",
    (A.SYMBOLS, A.PART_IMPORTS, R.ASKED, R.SEEDS, R.BRIEFS),
)
def i12_briefs(spark, d):
    """A brief for every brand and part name. All ask for the same kind of work, and no check is required, so that one slot stays open."""
    s, i = A.symbols(spark, d), A.part_imports(spark, d)
    files = s.select(F.lit("parts").alias("snapshot_id"), "relative_path").distinct().select("snapshot_id", "relative_path", F.lit("rs").alias("extension"), F.lit("rust").alias("language"), F.lit(10).cast("long").alias("size_bytes"), F.lit("h").alias("content_hash"))
    facts = {"files": files, "symbols": s, "imports": i, "verification_targets": A.targets(spark)}
    names = s.select("relative_path").union(s.select("name")).distinct().select(F.col("relative_path").alias("scope_hint"))
    asked = names.select(F.col("scope_hint").alias("request_id"), "scope_hint", F.col("scope_hint").alias("goal"), F.col("scope_hint").alias("question"), F.lit("safe_edit").alias("task_type"), F.lit("human").alias("consumer_type"), F.lit("standard").alias("depth"), F.lit(4096).alias("token_budget"), F.lit(800).alias("latency_budget"))
    docs = files.withColumn("text", F.col("relative_path"))
    index = lexical.build_index(docs.select("snapshot_id", "relative_path", lexical.body("relative_path", "text").alias("body")))
    return brief.brief(asked, facts, index, docs)


@add(R.PLACED, (A.SYMBOLS, A.PART_IMPORTS, R.CALLS, R.BRANDS, R.SEEDS, R.ONE_CHECK, R.RELATED))
def c12_blast_radius(spark, d):
    """Relationships of the blast radius of every brand: definitions, references, imports, calls and checks in one."""
    s, i = A.symbols(spark, d), A.part_imports(spark, d)
    files = s.select("relative_path").distinct()
    asked = files.select(F.col("relative_path").alias("request_id"), F.col("relative_path").alias("target"))
    report = graph.blast_radius(asked, {"files": files, "symbols": s, "imports": i, "verification_targets": A.targets(spark)})
    return report["relationships"].select("request_id", "kind", "src", "dst", "place")
