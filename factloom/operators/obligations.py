"""Equivalence obligations over aligned functions: making, scheduling, judging, and rolling up what was found.

External provers do not run here. What they would say comes in as tables, and rolls up like what the rules here say.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import col, fnv1a, fnv1a_sql
from .graph import cut

LEAST_ALIGNMENT = 70
MISSING_TARGET = "target counterpart is missing under current alignment bounds"
MISSING_REFERENCE = "reference counterpart is missing under current alignment bounds"
FILE_ONLY = "function-level alignment produced no candidates"

# Weights of the pair model, and what it takes.
WEIGHTS = {"declaration": 24, "calls": 18, "control": 10, "literals": 8, "window_hash": 16, "import_signature": 10, "reverse_import_signature": 4, "symbol_context_signature": 8, "behaviour": 12, "name_key": 6}
LINE_CLOSE, LINE_WEIGHT, LEAST_SCORE = 12, 4, 78
STRATEGY_RANK = {"exact_path_name": 4, "behavioral_profile_exact": 3, "same_name_language": 2, "signature_similarity": 1}


def valid_contracts(contracts: DataFrame) -> DataFrame:
    """Contracts with an id and at least one entry in each of their four lists."""
    lists = ("environment_assumptions", "input_domains", "observables", "equivalence_claims")
    good = F.trim("contract_id") != ""
    for c in lists:
        good = good & (F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0)
    return contracts.withColumn("valid", F.coalesce(good, F.lit(False)))


def encoding_hash(contract: Column, pair: Column, assumptions: Column) -> Column:
    return fnv1a(F.concat(F.lit("contract="), contract, F.lit(";pair="), pair, F.lit(";assumptions="), F.array_join(assumptions, "|")))


def obligation_id(contract: Column, hash_: Column) -> Column:
    return F.concat(F.lit("thm_"), fnv1a_sql(F.concat(contract, F.lit("|"), hash_)))  # a short text: no Python


def _made(rows: DataFrame, contract_id: str, environment: list[str]) -> DataFrame:
    """Obligations from source_pair, assumptions and rank."""
    contract = F.lit(contract_id)
    out = rows.withColumn("assumptions", F.concat(F.array(*[F.lit(x) for x in environment]).cast("array<string>"), "assumptions"))
    out = out.withColumn("encoding_hash", encoding_hash(contract, F.col("source_pair"), F.col("assumptions")))
    return out.select(obligation_id(contract, F.col("encoding_hash")).alias("id"), "source_pair", contract.alias("contract_id"), "assumptions", "encoding_hash", "rank")


def compile_obligations(pairs: DataFrame, only_ref: DataFrame, only_tgt: DataFrame, contract_id: str, environment: list[str], most: int | None = None) -> DataFrame:
    """An obligation for each pair (ref, tgt, strategy, score: signal ids), then for each unmatched signal (id)."""
    pair = F.concat(F.lit("pair:"), "ref", F.lit("=>"), "tgt")
    why = F.array(F.concat(F.lit("alignment_strategy="), "strategy"), F.concat(F.lit("alignment_score="), F.col("score").cast("string")))
    rows = pairs.select(pair.alias("source_pair"), why.alias("assumptions"), F.lit(0).alias("rank"))
    for df, prefix, text, rank in ((only_ref, "reference_only:", MISSING_TARGET, 1), (only_tgt, "target_only:", MISSING_REFERENCE, 2)):
        rows = rows.union(df.select(F.concat(F.lit(prefix), "id"), F.array(F.lit(text)), F.lit(rank)))
    out = _made(rows, contract_id, environment)
    # written once: whatever reads them starts no Python for their hashes again
    first = cut(out, "obligations").groupBy("id").agg(F.min_by(F.struct("source_pair", "contract_id", "assumptions", "encoding_hash", "rank"), "rank").alias("o")).select("id", "o.*")
    return first.drop("rank") if most is None else first.orderBy("rank", "source_pair").limit(most).drop("rank")


def file_obligations(paths: DataFrame, contract_id: str, environment: list[str]) -> DataFrame:
    """An obligation for each changed path, for when no function can be aligned."""
    rows = paths.select(F.concat(F.lit("file:"), "relative_path").alias("source_pair"), F.array(F.lit(FILE_ONLY)).alias("assumptions"), F.lit(0).alias("rank"))
    return _made(rows, contract_id, environment).drop("rank")


def pair_ids(pair: Column | str) -> tuple[Column, Column]:
    inner = F.regexp_extract(col(pair), "^pair:(.*)$", 1)
    return F.regexp_extract(inner, "^(.*?)=>", 1), F.regexp_extract(inner, "^.*?=>(.*)$", 1)


def signal_path(signal: Column) -> Column:
    """The path in name@path:line."""
    path = F.regexp_extract(signal, "^[^@]*@(.*):[^:]*$", 1)
    return F.when(path == "", F.lit("unknown")).otherwise(path)


def priority(pair: Column | str) -> Column:
    pair = col(pair)
    return F.when(F.startswith(pair, F.lit("pair:")), 1).when(pair.rlike("^(reference|target)_only:"), 0).when(F.startswith(pair, F.lit("file:")), 2).otherwise(3)


def partition_key(pair: Column | str) -> Column:
    pair = col(pair)
    a, b = (signal_path(x) for x in pair_ids(pair))
    alone = signal_path(F.regexp_extract(pair, "^[a-z]+_only:(.*)$", 1))
    return (
        F.when(F.startswith(pair, F.lit("pair:")), F.concat(F.lit("pair:"), F.least(a, b), F.lit("=>"), F.greatest(a, b)))
        .when(F.startswith(pair, F.lit("reference_only:")), F.concat(F.lit("reference:"), alone))
        .when(F.startswith(pair, F.lit("target_only:")), F.concat(F.lit("target:"), alone))
        .when(F.startswith(pair, F.lit("file:")), pair)
        .otherwise("unknown")
    )


def schedule(obligations: DataFrame, most: int) -> DataFrame:
    """The first `most` by priority, partition and id, with both noted among the assumptions and their place."""
    out = obligations.withColumn("priority", priority("source_pair")).withColumn("partition", partition_key("source_pair"))
    out = out.orderBy("priority", "partition", "id").limit(most)
    out = out.withColumn("place", F.row_number().over(W.orderBy("priority", "partition", "id")))  # `most` rows
    noted = F.concat("assumptions", F.array(F.concat(F.lit("obligation_partition="), "partition"), F.concat(F.lit("obligation_priority="), F.col("priority").cast("string"))))
    return out.withColumn("assumptions", noted)


REASONS = ("declaration", "calls", "control", "literals", "window_hash", "import_signature", "reverse_import_signature", "symbol_context_signature", "behaviour", "name_key")


def with_signals(obligations: DataFrame, ref: DataFrame, tgt: DataFrame) -> DataFrame:
    """Obligations with the signals of their pair, null where a side has none. Of equal signal ids the last counts."""
    a, b = pair_ids("source_pair")
    columns = [*REASONS, "line_number"]
    last = lambda df: df.groupBy("id").agg(F.max_by(F.struct(*columns), F.struct("relative_path", "line_number", "name", "fact_id")).alias("s"))
    r, t = last(ref).select(F.col("id").alias("ref_key"), F.col("s").alias("r")), last(tgt).select(F.col("id").alias("tgt_key"), F.col("s").alias("t"))
    keyed = obligations.withColumn("ref_key", a).withColumn("tgt_key", b)
    return keyed.join(r, "ref_key", "left").join(t, "tgt_key", "left")


def judge(obligations: DataFrame, ref: DataFrame, tgt: DataFrame) -> DataFrame:
    """Certificates by the relational rule: equal signatures prove, others refute, as does a function without its like."""
    out = with_signals(obligations, ref, tgt)
    reasons = F.array_compact(F.array(*[F.when(F.col(f"r.{c}") != F.col(f"t.{c}"), F.lit(c)) for c in REASONS]))
    pair = F.col("source_pair")
    is_pair, alone = F.startswith(pair, F.lit("pair:")), pair.rlike("^(reference|target)_only:")
    status = F.when(is_pair & (F.col("r").isNull() | F.col("t").isNull()), "inconclusive").when(is_pair & (F.size(reasons) == 0), "proved").when(is_pair | alone, "refuted").otherwise("inconclusive")
    return out.select(F.col("id").alias("obligation_id"), "encoding_hash", "source_pair", status.alias("status"), F.when(is_pair, reasons).alias("reasons"))


def pair_model(obligations: DataFrame, ref: DataFrame, tgt: DataFrame) -> DataFrame:
    """The weighted model of a pair: its score, and whether the pair counts as equivalent."""
    out = with_signals(obligations, ref, tgt).where("r is not null and t is not null")
    same = {c: F.col(f"r.{c}") == F.col(f"t.{c}") for c in WEIGHTS}
    close = F.abs(F.col("r.line_number") - F.col("t.line_number")) <= LINE_CLOSE
    score = F.when(close, LINE_WEIGHT).otherwise(0)
    for c, w in WEIGHTS.items():
        score = score + F.when(same[c], w).otherwise(0)
    good = (score >= LEAST_SCORE) & same["declaration"] & same["window_hash"] & same["behaviour"] & (same["import_signature"] | same["reverse_import_signature"]) & close
    return out.select(F.col("id").alias("obligation_id"), score.alias("model_score"), good.alias("equivalent"))


def stable_status(runs: DataFrame) -> DataFrame:
    """One status for each obligation from repeated runs: any disagreement is inconclusive."""
    one = F.count_distinct("status") == 1
    return runs.groupBy("obligation_id").agg(F.when(one, F.min("status")).otherwise("inconclusive").alias("status"), (~one).alias("flaky"))


def run_status(certificates: DataFrame, keys: list[str]) -> DataFrame:
    """Roll-up: any refuted refutes; all proved (and some) prove; anything else is inconclusive."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    out = certificates.groupBy(*keys).agg(F.count("*").alias("n"), n("proved"), n("refuted"), n("inconclusive"))
    status = F.when(F.col("refuted") > 0, "refuted_under_contract").when((F.col("n") > 0) & (F.col("proved") == F.col("n")), "proved_under_contract").otherwise("inconclusive_under_contract")
    return out.withColumn("run_status", status)


def with_translation(base: Column | str, translation: Column | str, override: bool = True, require_compiler_ir: bool = True) -> Column:
    """The run status after translation validation (null: none was run)."""
    base, translation = col(base), col(translation)
    if not override:
        return base
    refuted = base == "refuted_under_contract"
    weaker = F.when(refuted, base).otherwise("inconclusive_under_contract")
    return (
        F.when(translation == "observed_difference", "refuted_under_contract")
        .when(translation == "reference_snapshot_missing", weaker)
        .when(translation == "inconclusive", weaker if require_compiler_ir else base)
        .otherwise(base)
    )


def translation_order(pairs: DataFrame, most: int) -> DataFrame:
    """Pairs for translation validation: by readiness of their manifests, strategy, score, pair and id; the first `most`."""
    rust = (F.col("ref_language") == "rust") & (F.col("tgt_language") == "rust")
    readiness = (
        F.when(F.col("ref_language").isNull() | F.col("tgt_language").isNull(), 0).when(~rust, 1)
        .when(F.col("ref_manifest").isNull() | F.col("tgt_manifest").isNull(), 2).when(F.col("ref_manifest") == F.col("tgt_manifest"), 4).otherwise(3)
    )
    rank = F.lit(0)
    for k, v in STRATEGY_RANK.items():
        rank = F.when(F.col("strategy") == k, v).otherwise(rank)
    out = pairs.withColumn("readiness", readiness).withColumn("strategy_rank", rank)
    return out.orderBy(F.desc("readiness"), F.desc("strategy_rank"), F.desc("score"), "source_pair", "id").limit(most)


def replay(obligations: DataFrame, certificates: DataFrame) -> DataFrame:
    """Stored certificates with their obligations: of several for one obligation the first by hash, status and solver."""
    first = F.row_number().over(W.partitionBy("obligation_id").orderBy(F.coalesce("encoding_hash", F.lit("")), "status", F.coalesce("solver", F.lit(""))))
    certs = certificates.withColumn("n", first).where("n = 1").select(F.col("obligation_id").alias("id"), "status", "solver", F.col("encoding_hash").alias("certified_hash"))
    out = obligations.join(certs, "id")
    return out.withColumn("hash_matches", F.coalesce(F.col("certified_hash") == F.col("encoding_hash"), F.lit(True)))


def stage_receipt(certificates: DataFrame, keys: list[str]) -> DataFrame:
    """Counts by status and the first witness and solver, by obligation."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("obligation_id"))).alias(c)
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return certificates.groupBy(*keys).agg(n("proved"), n("refuted"), n("inconclusive"), first("witness"), first("solver"))


def harnesses(lines: DataFrame) -> DataFrame:
    """Proof harnesses: the next function after a line that begins with the proof attribute, once for each manifest.

    lines: manifest_path, relative_path, line_number, line.
    """
    order = W.partitionBy("manifest_path", "relative_path").orderBy("line_number")
    marked = F.trim("line").rlike(r"^#\[kani::proof")
    name = F.regexp_extract("line", r"\bfn\s+([A-Za-z_][A-Za-z0-9_]*)", 1)
    rows = lines.withColumn("mark", F.max(F.when(marked, F.col("line_number"))).over(order)).withColumn("fn", F.when(name != "", F.col("line_number")))
    rows = rows.withColumn("before", F.max("fn").over(order.rowsBetween(W.unboundedPreceding, -1))).withColumn("name", name)
    found = rows.where("fn is not null and mark is not null and (before is null or before < mark)")
    return found.select("manifest_path", F.col("name").alias("harness")).distinct()
