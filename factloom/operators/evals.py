"""Roll-ups of evaluation runs.

Observations: scenario, mutation, expected and observed class, elapsed micros, sufficiency, slot counts, slots by
sufficiency (map), evidence ids, slot costs and gains (maps).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def percentile_by(df: DataFrame, keys: list[str], value: str, percents: list[int]) -> DataFrame:
    """The sorted values at (n - 1) * p / 100, rounded down, of each group with values; p: percents. Without keys 0 for none.

    Equal values are counted first; a running count over the different ones finds the wanted ranks.
    """
    from pyspark.sql import Window as W

    many = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__many"))
    w = W.partitionBy(*keys)
    ranked = many.withColumn("__to", F.sum("__many").over(w.orderBy(value))).withColumn("__n", F.sum("__many").over(w))
    at = lambda p: F.floor((F.col("__n") - 1) * p / 100)
    here = lambda p: (at(p) < F.col("__to")) & (at(p) >= F.col("__to") - F.col("__many"))
    return ranked.groupBy(*keys).agg(*[F.coalesce(F.max(F.when(here(p), F.col(value))), F.lit(0)).alias(f"p{p}") for p in percents])


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole != 0, part / whole)


def jaccard(a: Column, b: Column) -> Column:
    either = F.size(F.array_union(a, b))
    return F.when(either == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def slot_retention(canonical: Column, mutated: Column) -> Column:
    """The share of the canonical run's sufficient slots (maps of slot to boolean) that stay so."""
    kept = F.map_keys(F.map_filter(canonical, lambda k, v: v))
    still = F.size(F.filter(kept, lambda s: F.coalesce(F.try_element_at(mutated, s), F.lit(False))))
    return F.when(F.size(kept) == 0, F.lit(1.0)).otherwise(still / F.size(kept))


def mutation_robustness(obs: DataFrame) -> DataFrame:
    """Means over all mutated runs against their scenario's canonical run: slots retained, overlap of evidence."""
    c = obs.where("mutation = 'canonical'").groupBy("scenario").agg(F.min(F.struct("run", "evidence_ids")).alias("x"), F.min_by("slots", "run").alias("c_slots"))
    both = obs.where("mutation <> 'canonical'").join(c, "scenario")
    out = both.agg(F.avg(slot_retention(F.col("c_slots"), F.col("slots"))).alias("retention"), F.avg(jaccard(F.col("x.evidence_ids"), F.col("evidence_ids"))).alias("overlap"))
    return out.select(*[F.coalesce(c, F.lit(1.0)).alias(c) for c in ("retention", "overlap")])


def rates(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Match, sufficiency and hit rates; uplift is the hit rate over the baseline's, at least 0."""
    hit, base = ratio(F.sum("satisfied"), F.sum("required")), ratio(F.sum("baseline_hits"), F.sum("required"))
    return obs.groupBy(*keys).agg(
        ratio(F.count_if(F.col("expected") == F.col("observed")), F.count("*")).alias("match_rate"), ratio(F.count_if("sufficient"), F.count("*")).alias("sufficient_rate"),
        hit.alias("hit_rate"), F.greatest(hit - base, F.lit(0.0)).alias("uplift"),
    )


def healed_per_ms(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Slots gained for each millisecond spent; null where nothing was spent."""
    cost, gain = F.sum("cost_ms"), F.sum("gained")
    return obs.groupBy(*keys).agg(F.when(cost > 0, gain / cost).alias("healed_per_ms"))


def latency(obs: DataFrame, keys: list[str]) -> DataFrame:
    """Mean (whole microseconds) and largest elapsed time."""
    return obs.groupBy(*keys).agg(F.floor(F.sum("elapsed_micros") / F.count("*")).cast("long").alias("mean_micros"), F.max("elapsed_micros").alias("max_micros"))


def summarize(results: DataFrame) -> DataFrame:
    """Averages of baseline and uplifted scores, their difference and latency; zeros for none."""
    mean = lambda c, name: F.coalesce(F.avg(c), F.lit(0.0)).alias(name)
    return results.agg(mean("baseline_score", "baseline"), mean("uplifted_score", "uplifted"), mean(F.col("uplifted_score") - F.col("baseline_score"), "delta"), mean("latency_ms", "latency_ms"))


def gained_slots(before: DataFrame, after: DataFrame) -> DataFrame:
    """Slots that became sufficient between two audits (request_id, slot, status), and all slots, by request."""
    from ..functions.rules import is_sufficient

    a = before.select("request_id", "slot", is_sufficient(F.col("status")).alias("was"))
    b = after.select("request_id", "slot", is_sufficient(F.col("status")).alias("is"))
    return a.join(b, ["request_id", "slot"]).groupBy("request_id").agg(F.count_if(~F.col("was") & F.col("is")).alias("gained"), F.count("*").alias("slots"))


def gain_per_ms(gained: Column, elapsed: Column) -> Column:
    return F.when(elapsed <= 0, gained.cast("double")).otherwise(gained / elapsed)


# How questions are mutated, and the misspellings of the typo variant.
MUTATIONS = ("canonical", "terse", "typo", "symbolic_noise")
TYPOS = {"retrieval": "retrival", "decision": "decison", "verification": "verfication"}


def mutated_question(question: Column, mutation: Column) -> Column:
    """A question as asked, its first seven words, misspelt, or with signs behind it."""
    words = F.filter(F.split(question, r"\s+"), lambda w: w != "")
    typo = question
    for right, wrong in TYPOS.items():
        typo = F.replace(typo, F.lit(right), F.lit(wrong))
    return (
        F.when(mutation == "terse", F.array_join(F.slice(words, 1, 7), " "))
        .when(mutation == "typo", typo)
        .when(mutation == "symbolic_noise", F.concat(question, F.lit(" (@_@)")))
        .otherwise(question)
    )
