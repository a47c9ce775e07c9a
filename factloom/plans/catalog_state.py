"""Queries over what is kept: the stored index and its versions, ledgers and controllers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import lexical, lexical_store
from ..sources.shared import scratch
from ..streaming import stateful
from . import adapters as A
from .catalog_facts import _TEXTS
from .registry import Registry

add = Registry()
QUERIES, ORACLES = add.queries, add.oracles


# --- the stored index ------------------------------------------------------------------------------------------------


def _two(spark, d):
    """Documents before (without German ones) and after (without French ones, Spanish ones with a word more)."""
    f = A.files(spark, d)
    text = F.when(F.col("language") == "es", F.concat("text", F.lit(" x"))).otherwise(F.col("text"))
    docs = lambda x: x.withColumn("content_hash", F.md5(F.col("text").cast("binary"))).select("snapshot_id", "relative_path", "content_hash", lexical.body("relative_path", "text").alias("body"))
    return docs(f.where("language <> 'de'")), docs(f.where("language <> 'fr'").withColumn("text", text))


_BEFORE = "before AS (SELECT * FROM files WHERE language <> 'de')"
_AFTER = "after AS (SELECT * REPLACE (CASE WHEN language = 'es' THEN text || ' x' ELSE text END AS text) FROM files WHERE language <> 'fr')"
_WORDS = "words AS (SELECT q, unnest(list_distinct(list_filter(regexp_split_to_array(translate(q, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^0-9a-z]'), lambda t: octet_length(encode(t)) >= 2))) AS term FROM (VALUES " + ", ".join(f"('{t}')" for t in _TEXTS) + ") a(q))"


def _bm25(side: str) -> str:
    """The ten best of each query over the files of one side."""
    return f"""{side}_docs AS (SELECT relative_path, list_filter(regexp_split_to_array(lower(strip_accents(relative_path || chr(10) || text)), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '') AS terms FROM {side}),
{side}_posting AS (SELECT relative_path, term, count(*) AS tf FROM (SELECT relative_path, unnest(terms) AS term FROM {side}_docs) GROUP BY ALL),
{side}_stats AS (SELECT count(*) AS n, avg(len(terms)) AS mean FROM {side}_docs), {side}_spread AS (SELECT term, count(*) AS df FROM {side}_posting GROUP BY term),
{side}_hits AS (
  SELECT q, relative_path, sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(terms) / mean))) AS bm25
  FROM words JOIN {side}_posting USING (term) JOIN {side}_spread USING (term) JOIN {side}_docs USING (relative_path), {side}_stats GROUP BY q, relative_path HAVING count(*) = (SELECT count(*) FROM words w WHERE w.q = words.q)
), {side}_best AS (SELECT q, relative_path, round(bm25, 6) AS bm25, place FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(bm25, 9) DESC, relative_path) AS place FROM {side}_hits) WHERE place <= 10)"""


@add(
    "SELECT 1 AS version, false AS rebuilt, q AS request_id, relative_path, bm25, place FROM before_best UNION ALL SELECT 2, false, q, relative_path, bm25, place FROM after_best",
    (A.FILES, _BEFORE, _AFTER, _WORDS, _bm25("before"), _bm25("after")),
)
def d9_stored_index(spark, d):
    """An index that is built, pinned and brought up to date, then asked for again, which costs a fingerprint; both versions
    are searched as they are stored."""
    root = scratch(spark, "index")
    before, after = _two(spark, d)
    versions = [lexical_store.ensure(before, root)[0], lexical_store.ensure(after, root)[0]]
    again, rebuilt = lexical_store.ensure(after, root)
    assert again == versions[1]
    asked = spark.createDataFrame([(t, t, "", 10) for t in _TEXTS], "request_id string, text string, scope string, limit int")
    found = [lexical_store.search_stored(spark, root, asked, v).select(F.lit(v).alias("version"), F.lit(rebuilt).alias("rebuilt"), "request_id", "relative_path", F.round("bm25", 6).alias("bm25"), "place") for v in versions]
    return found[0].union(found[1])


_COUNTED = r"""counted AS (SELECT relative_path, language, list_filter(regexp_split_to_array(lower(strip_accents(relative_path || chr(10) || text)), '[^\p{L}\p{N}]+'), lambda t: t <> '') AS terms FROM after)"""


@add("SELECT relative_path, len(list_distinct(terms)) AS terms, len(terms) AS uses, len(terms) AS length, CASE WHEN language IN ('es', 'de') THEN 2 ELSE 1 END AS segment FROM counted", (A.FILES, _AFTER, _COUNTED))
def k2_index_epochs(spark, d):
    """The stored index kept up by two batches of changes, the second of which comes twice: what it has of every document, and
    which batch that is from."""
    root = scratch(spark, "index")
    before, after = _two(spark, d)
    keys = lexical_store.KEYS
    gone = before.join(after, keys, "left_anti").select(*keys, F.lit(None).cast("string").alias("content_hash"), F.lit(None).cast("string").alias("body"))
    lexical_store.apply_changes(before, root, 1)
    for _ in range(2):
        lexical_store.apply_changes(after.union(gone), root, 2)
    uses = lexical_store.postings(spark, root).groupBy("relative_path").agg(F.count("*").alias("terms"), F.sum("tf").alias("uses"))
    return uses.join(lexical_store.documents(spark, root).select("relative_path", "length", "segment"), "relative_path")


# --- ledgers and controllers -----------------------------------------------------------------------------------------

_SLOTS = ("exact_anchor", "structural_context", "flow_summary", "verification_targets")
_STAGES = """stage AS (SELECT user_id, ts, event_id, k, value, list_filter(['exact_anchor', 'structural_context', 'flow_summary', 'verification_targets'], lambda x, i: (k // i) % 2 = 0) AS slots,
  list_filter(['exact_anchor', 'structural_context', 'flow_summary', 'verification_targets'], lambda x, i: k % (i + 4) = 0) AS gained, CASE WHEN event_type = 'error' THEN -value ELSE value END AS elapsed_ms FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def stages(spark, d):
    """Events as stages of retrieval: what they looked for, how long they took (errors: nothing that counts), what they filled."""
    k = F.get_json_object("props", "$.k").cast("long")
    some = lambda fits: F.array_compact(F.array(*[F.when(fits(i), F.lit(x)) for i, x in enumerate(_SLOTS, 1)]))
    e = A.table(spark, d, "events")
    return e.select("user_id", F.col("ts").alias("at"), some(lambda i: F.floor(k / i) % 2 == 0).alias("slots"), F.when(F.col("event_type") == "error", -F.col("value")).otherwise(F.col("value")).alias("elapsed_ms"), some(lambda i: k % (i + 4) == 0).alias("gained"))


@add(
    """, cost AS (SELECT user_id, unnest(slots) AS slot, elapsed_ms / len(slots) AS cost, 0 AS gain FROM stage WHERE len(slots) > 0 AND elapsed_ms > 0 UNION ALL SELECT user_id, unnest(gained), 0, 1 FROM stage)
SELECT user_id, slot, round(sum(cost), 6) AS cost_ms, CAST(sum(gain) AS BIGINT) AS gains, CASE WHEN sum(cost) > 0 OR sum(gain) > 0 THEN '; slot_gains=' || CAST(sum(gain) AS BIGINT) ELSE '' END AS detail FROM cost GROUP BY user_id, slot""".lstrip(", "),
    (_STAGES,),
)
def i16_slot_costs(spark, d):
    """Each user's ledger: what every slot cost and how often it was filled, and the end of its detail."""
    found = stateful.slot_costs(stages(spark, d), ["user_id"])
    detail = F.regexp_replace(stateful.cost_suffix("cost_ms", "gains"), r"; retrieval_cost_ms=[0-9]+\.[0-9]{2}", "")
    return found.select("user_id", "slot", F.round("cost_ms", 6).alias("cost_ms"), F.col("gains").cast("long").alias("gains"), detail.alias("detail"))


_CLASSES, _LATENCIES = ("entity_lookup", "architecture_explanation", "safe_edit", "bug_fix", "feature_implementation", "decision_why"), ("instant", "interactive", "deep", "background")
_FLOORS = """step AS (SELECT user_id, ts, event_id, CASE WHEN event_type = 'error' THEN -value / 1000 ELSE value / 1000 END AS gain, CASE WHEN user_id % 2 = 0 THEN 0.02 END AS initial,
  least(greatest(([0.03, 0.01, 0.015, 0.015, 0.015, 0.008])[user_id % 6 + 1] * ([1.3, 1.0, 0.65, 1.5])[user_id % 4 + 1] * 0.8, 0.002), 0.05) AS floor FROM events)"""


@add(
    """, past AS (SELECT *, list_concat(CASE WHEN initial IS NULL THEN [] ELSE [initial::DOUBLE] END, coalesce(list(greatest(gain, 0)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), [])) AS seen FROM step)
SELECT user_id, event_id, round(CASE WHEN len(seen) > 0 THEN list_reduce(seen, lambda a, x: 0.7 * a + 0.3 * x) END, 6) AS forecast, coalesce(list_reduce(CASE WHEN len(seen) > 0 THEN seen END, lambda a, x: 0.7 * a + 0.3 * x) >= floor, true) AS goes_on FROM past""".lstrip(", "),
    (_FLOORS,),
)
def i16_frontier(spark, d):
    """Controllers of every user, with the floor of its class: the forecast before each gain, and whether it goes on."""
    of = lambda values: F.get(F.array(*[F.lit(x) for x in values]), (F.col("user_id") % len(values)).cast("int"))
    floor = stateful.frontier_floor(rules.threshold_base(of(_CLASSES), of(_LATENCIES)))
    gain = F.when(F.col("event_type") == "error", -F.col("value")).otherwise(F.col("value")) / 1000
    e = A.table(spark, d, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("at"), gain.alias("gain"), floor.alias("floor"), F.when(F.col("user_id") % 2 == 0, 0.02).alias("initial"))
    return stateful.frontier(e, ["user_id"]).select("user_id", "event_id", F.round("forecast", 6).alias("forecast"), "goes_on")
