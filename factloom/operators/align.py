"""Alignment of functions across two snapshots by signatures of what surrounds them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, file_stem, fnv1a, identifier_shape, import_leaf, normalize_identifier, parent_dir, words_of, words_similarity
from .graph import cut

MAX_ITEMS, MAX_CALLS = 24, 16


def _joined(items: Column, most: int = MAX_ITEMS) -> Column:
    return F.array_join(F.slice(F.array_sort(F.collect_set(items)), 1, most), "|")


def import_signatures(imports: DataFrame) -> DataFrame:
    """For each importer its imports as lang:spec->path: distinct, sorted, the first 24."""
    item = F.concat("language", F.lit(":"), "import_spec", F.lit("->"), F.coalesce("resolved_path", F.lit("<unresolved>")))
    return imports.groupBy(F.col("importer_path").alias("relative_path")).agg(_joined(item).alias("import_signature"))


def reverse_signatures(imports: DataFrame) -> DataFrame:
    """For each path what imports it, as lang:importer->spec."""
    item = F.concat("language", F.lit(":"), "importer_path", F.lit("->"), "import_spec")
    return imports.where("resolved_path is not null").groupBy(F.col("resolved_path").alias("relative_path")).agg(_joined(item).alias("reverse_import_signature"))


def symbol_contexts(symbols: DataFrame) -> DataFrame:
    """For each path how many symbols of each kind it has, as kind:count."""
    n = symbols.groupBy("relative_path", "kind").agg(F.count("*").alias("n"))
    item = F.concat("kind", F.lit(":"), F.col("n").cast("string"))
    return n.groupBy("relative_path").agg(F.array_join(F.array_sort(F.collect_list(item)), "|").alias("symbol_context_signature"))


def neighbours(symbols: DataFrame) -> DataFrame:
    """For each function the number in its file and the name shapes before and after it, by line, name and id."""
    own = symbols.where("kind = 'function'")
    order = W.partitionBy("relative_path").orderBy("line_number", "name", "fact_id")
    shape = identifier_shape("name")
    return own.select(
        "fact_id", "relative_path", "name", "line_number", F.count("*").over(W.partitionBy("relative_path")).alias("function_count"),
        F.coalesce(F.lag(shape).over(order), F.lit("none")).alias("previous"), F.coalesce(F.lead(shape).over(order), F.lit("none")).alias("next"),
    )


def call_leaves(signature: Column | str) -> Column:
    """Last parts of the specs in an import signature: distinct, in lower case, the first 16."""
    items = F.split(signature, r"\|")
    spec = lambda x: F.regexp_extract(x, "^[^:]*:(.*?)->", 1)
    leaves = F.transform(items, lambda x: ascii_lower(import_leaf(spec(x))))
    return F.array_join(F.slice(F.array_sort(F.array_distinct(F.filter(leaves, lambda x: x.isNotNull() & (x != "")))), 1, MAX_CALLS), "|")


def function_signals(symbols: DataFrame, imports: DataFrame, changed: DataFrame | None = None, cap: int | None = None) -> DataFrame:
    """Signals of the functions in the changed paths (all by default), in the order of path, line, name and id."""
    own = symbols.where("kind = 'function'").dropDuplicates(["fact_id"])
    if changed is not None:
        own = own.join(changed.select("relative_path").distinct(), "relative_path", "left_semi")
    out = own.join(neighbours(symbols).select("fact_id", "function_count", "previous", "next").dropDuplicates(["fact_id"]), "fact_id")
    for part in (import_signatures(imports), reverse_signatures(imports), symbol_contexts(symbols)):
        out = out.join(part, "relative_path", "left")
    empty = [F.coalesce(c, F.lit("")).alias(c) for c in ("import_signature", "reverse_import_signature", "symbol_context_signature")]
    out = out.select("fact_id", "name", "relative_path", "language", "line_number", "evidence_class", "function_count", "previous", "next", *empty)
    out = out.withColumn("name_key", normalize_identifier("name"))
    out = out.withColumn("declaration", F.concat(F.lit("kind=function|language="), "language", F.lit("|name_shape="), identifier_shape("name")))
    out = out.withColumn("calls", call_leaves("import_signature"))
    out = out.withColumn("control", F.concat(F.lit("function_count="), "function_count", F.lit(";prev="), "previous", F.lit(";next="), "next"))
    out = out.withColumn("literals", F.concat(F.lit("evidence="), "evidence_class", F.lit(";line_bucket="), F.floor(F.col("line_number") / 10)))
    out = out.withColumn("window_hash", fnv1a(F.concat_ws("|", "declaration", "calls", "control", "literals", "symbol_context_signature")))
    behaviour = [("lang", "language"), ("decl", "declaration"), ("calls", "calls"), ("control", "control"), ("literals", "literals"), ("window_hash", "window_hash"), ("imports", "import_signature"), ("symbol_context", "symbol_context_signature"), ("evidence", "evidence_class")]
    out = out.withColumn("behaviour", F.concat_ws("|", *[F.concat(F.lit(f"{k}="), c) for k, c in behaviour]))
    out = out.withColumn("id", F.concat("name", F.lit("@"), "relative_path", F.lit(":"), F.col("line_number").cast("string")))
    if cap is not None:
        out = out.orderBy("relative_path", "line_number", "name", "fact_id").limit(cap)
    return out


def _derived(side: str = "") -> dict[str, Column]:
    """What `similarity` makes of a signal alone: its file's name and folder, and its words."""
    c = lambda name: F.col(f"{side}.{name}" if side else name)
    return {"stem": ascii_lower(file_stem(c("relative_path"))), "folder": ascii_lower(parent_dir(c("relative_path"))), "words": F.array_distinct(words_of(c("name_key")))}


def similarity(r: str = "r", t: str = "t", derived: bool = False) -> Column:
    """How alike two signals are, 0 to 100; derived: they have the columns of `_derived`."""
    a, b = (lambda c: F.col(f"{r}.{c}")), (lambda c: F.col(f"{t}.{c}"))
    x, y = ({c: F.col(f"{side}.{c}") for c in ("stem", "folder", "words")} if derived else _derived(side) for side in (r, t))
    same = lambda c: x[c] == y[c] if c in x else a(c) == b(c)
    total = _points(same, lambda c: same(c) & (a(c) != ""), F.abs(a("line_number") - b("line_number"))) + words_similarity(x["words"], y["words"])
    return F.when(same("language"), F.least(total, F.lit(100))).otherwise(0).cast("int")


def _points(same: Callable[[str], Column], same_filled: Callable[[str], Column], far: Column) -> Column:
    """The points of two signals but for those of their names' words."""
    points = lambda c, n: F.when(same(c), n).otherwise(0)
    filled = lambda c, n: F.when(same_filled(c), n).otherwise(0)
    return (
        points("declaration", 24) + filled("calls", 20) + points("control", 10) + points("literals", 8) + points("window_hash", 16)
        + filled("import_signature", 10) + filled("reverse_import_signature", 4) + filled("symbol_context_signature", 6)
        + points("stem", 4) + points("folder", 2) + F.when(far <= 3, 3).when(far <= 12, 2).otherwise(0)
    )


_ORDER = ("relative_path", "line_number", "name", "fact_id")
#: Candidates that one task takes at a time when rounds of mutually best pairs get slow.
BLOCK = 1 << 18
# Tiers of one-to-one pairs: strategy, score and what must be equal.
TIERS = (
    ("exact_path_name", 100, ("relative_path", "language", "name")),
    ("behavioral_profile_exact", 96, ("behaviour",)),
    ("same_name_language", 85, ("language", "name_key")),
)


def _zipped(ref: DataFrame, tgt: DataFrame, tier: int) -> DataFrame:
    """The n-th signal of each key on one side with the n-th on the other."""
    strategy, score, keys = TIERS[tier]
    nth = F.row_number().over(W.partitionBy(*keys).orderBy(*_ORDER)).alias("nth")
    a = ref.select(*keys, nth, F.col("fact_id").alias("ref_id"))
    b = tgt.select(*keys, nth, F.col("fact_id").alias("tgt_id"))
    return a.join(b, [*keys, "nth"]).select("ref_id", "tgt_id", F.lit(strategy).alias("strategy"), F.lit(score).alias("score"), _place(tier, F.lit(0), F.concat_ws("|", *keys), F.lit(""), F.col("nth")).alias("place"))


def _place(tier: int, less: Column, first: Column, then: Column, nth: Column) -> Column:
    """Where a pair stands among all: by tier, then by key and number, or by score and ids."""
    return F.struct(F.lit(tier).alias("tier"), less.cast("int").alias("less"), first.alias("first"), then.alias("then"), nth.cast("int").alias("nth"))


def _in_order(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidates in their order: each whose two ends are still free is a pair."""
    left, right = set(), set()
    for rows in parts:
        kept = []
        for k, (a, b) in enumerate(zip(rows["ref_id"], rows["tgt_id"], strict=True)):
            if a not in left and b not in right:
                left.add(a)
                right.add(b)
                kept.append(k)
        yield rows.iloc[kept]


def greedy(candidates: DataFrame, block: int = BLOCK) -> DataFrame:
    """One-to-one pairs of scored candidates (ref_id, tgt_id, score): the highest score first, ties by the ref's key, then
    the tgt's (ref_key and tgt_key, by default the ids).

    A candidate that comes first at both of its ends is a pair whatever else is chosen, so every round takes all of these at
    once and drops what touches them; the order is total, so the result is that of one pass over all. Where ties make rounds
    slow (fewer than half of the candidates went), the first `block` of the order are passed over in one task, exactly
    and with bounded memory, before the next round.
    """
    ids = ("ref_id", "tgt_id")
    keys = [F.col(f"{x}_key" if f"{x}_key" in candidates.columns else f"{x}_id").alias(f"{x}_key") for x in ("ref", "tgt")]
    left = cut(candidates.select(*ids, "score", *keys), "candidates")
    order = [F.desc("score"), "ref_key", "tgt_key", *ids]
    first = F.min(F.struct((-F.col("score")).alias("less"), "ref_key", "tgt_key", *ids))
    found, many = None, left.count()
    taken = lambda rows, by: rows.join(by.select("ref_id"), "ref_id", "left_anti").join(by.select("tgt_id"), "tgt_id", "left_anti")
    while many:
        own = [left.groupBy(x).agg(first.alias("best")).select("best.ref_id", "best.tgt_id") for x in ids]
        pairs = cut(left.join(own[0].join(own[1], list(ids)), list(ids), "left_semi"), "matched")
        left = cut(taken(left, pairs), "candidates")
        before, many = many, left.count()
        if 2 * many > before:
            more = cut(left.orderBy(*order).limit(block).mapInPandas(_in_order, left.schema), "matched")
            left = cut(taken(left, more), "candidates")
            pairs, many = pairs.unionByName(more), left.count()
        found = pairs if found is None else found.unionByName(pairs)
    found = left if found is None else found
    return found.select(*ids, F.lit("signature_similarity").alias("strategy"), "score", "ref_key", "tgt_key")


#: The least score for which candidates are looked for by the keys of `_candidate_keys`.
FEW_KEYS_FROM = 65


def _candidate_keys(least: int) -> Column:
    """Keys of a signal; two that share none of them cannot reach the least score.

    From 65 on, by the points of `similarity`: a pair with neither window nor calls in common has at most 91. If it has no
    word in common either (71), it lacks at most 6, so declaration, control, literals and imports are equal. If it has a
    word in common but another declaration (67), it lacks at most 2: control, literals and all contexts are equal.
    If the declaration is equal too, control, literals or imports must be: without these three, 63 points are left. So a word
    is never a key by itself. Below 65 a shared declaration or word is enough, and pairs that share nothing of all this,
    47 points at most, are not looked for.
    """
    filled = lambda c, *parts: F.when(F.col(c) != "", F.concat_ws("|", *parts))
    keys = [F.concat(F.lit("w:"), "window_hash"), filled("calls", F.lit("c:"), "calls")]
    words = F.split("name_key", " ")
    if least < FEW_KEYS_FROM:
        return F.array_distinct(F.concat(F.array_compact(F.array(*keys, F.concat(F.lit("d:"), "declaration"))), F.transform(words, lambda x: F.concat(F.lit("n:"), x))))
    keys += [filled("import_signature", F.lit("d:"), "declaration", "control", "literals", "import_signature"), F.concat_ws("|", F.lit("o:"), "control", "literals", "import_signature", "reverse_import_signature", "symbol_context_signature")]
    by_word = lambda c: F.transform(words, lambda x: F.concat_ws("|", F.lit(f"{c}:"), x, "declaration", c))
    imports = F.when(F.col("import_signature") != "", by_word("import_signature")).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array_compact(F.array(*keys)), by_word("control"), by_word("literals"), imports))


#: Points that a name's words can give.
WORD_POINTS = 20
_CODED = ("declaration", "calls", "control", "literals", "window_hash", "import_signature", "reverse_import_signature", "symbol_context_signature")


def _near(ref: DataFrame, tgt: DataFrame, least: int) -> DataFrame:
    """Pairs (ref_id, tgt_id, rough) of one language that share a key, a row for each key, and may have at least that score: none
    has more than rough. Signatures are hashes here, which are equal where these are; an empty one is null."""

    def coded(df: DataFrame) -> DataFrame:
        codes = [F.when(F.col(c) != "", F.xxhash64(c)).alias(c) for c in _CODED] + [F.xxhash64(x).alias(c) for c, x in _derived().items() if c != "words"]
        return df.select("language", F.explode(_candidate_keys(least)).alias("key"), "fact_id", "line_number", _derived()["words"].alias("words"), *codes).withColumn("key", F.xxhash64("key"))

    # dealt out evenly: where all functions share a key, every task has its part of them
    tasks = int(ref.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r, t = coded(ref.repartition(tasks, "fact_id")).alias("r"), coded(tgt).alias("t")
    a, b = (lambda c: F.col(f"r.{c}")), (lambda c: F.col(f"t.{c}"))
    points = _points(lambda c: a(c).eqNullSafe(b(c)), lambda c: a(c) == b(c), F.abs(a("line_number") - b("line_number")))
    rough = F.least(points + words_similarity(a("words"), b("words")), F.lit(100)).cast("int")
    met = r.join(t, (a("language") == b("language")) & (a("key") == b("key")) & (points >= least - WORD_POINTS) & (rough >= least))
    return met.select(a("fact_id").alias("ref_id"), b("fact_id").alias("tgt_id"), rough.alias("rough"))


def similar(ref: DataFrame, tgt: DataFrame, least: int) -> DataFrame:
    """Candidates (ref_id, tgt_id, score, ref_key, tgt_key) of one language with at least that score."""
    near = _near(ref, tgt, least).select("ref_id", "tgt_id").distinct()
    ref, tgt = (df.withColumns(_derived()) for df in (ref, tgt))
    scored = near.join(ref.alias("r"), F.col("ref_id") == F.col("r.fact_id")).join(tgt.alias("t"), F.col("tgt_id") == F.col("t.fact_id"))
    return scored.select("ref_id", "tgt_id", similarity(derived=True).alias("score"), F.col("r.id").alias("ref_key"), F.col("t.id").alias("tgt_key")).where(F.col("score") >= least)


#: Candidates that are written at a time, unless more have the same score.
MANY = 1 << 20


def matched(ref: DataFrame, tgt: DataFrame, least: int, block: int = BLOCK, many: int = MANY) -> DataFrame:
    """The pairs of `greedy` over all candidates of at least that score.

    As the highest scores come first, candidates are made from the best scores down, so many at a time: what these pair takes no
    part later, so candidates of lower scores are those of the left-over alone. Scores are counted before, which writes nothing.
    """
    found, floor = None, None
    while True:
        counts = sorted(((x.rough, x["count"]) for x in _near(ref, tgt, least).groupBy("rough").count().collect() if floor is None or x.rough < floor), reverse=True)
        floor, total = least, 0
        for k, (_, n) in enumerate(counts):
            total += n
            if k and total > many:
                floor = counts[k - 1][0]
                break
        pairs = greedy(similar(ref, tgt, floor), block)
        found = pairs if found is None else found.unionByName(pairs)
        if floor == least:
            return found
        ref, tgt = (cut(df.join(pairs.select(F.col(x).alias("fact_id")), "fact_id", "left_anti"), "left_over") for df, x in ((ref, "ref_id"), (tgt, "tgt_id")))


def _first(rows: DataFrame, most: int, *order: str) -> DataFrame:
    """The first rows in an order, however many: ranges of the order are counted, and only the one in which the last row lies
    is sorted. A plain limit would take them all through one task."""
    ranged = cut(rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id()), "ranges")
    whole, left = [], most
    for n, many in sorted((r.range, r["count"]) for r in ranged.groupBy("range").count().collect()):
        if many > left:
            return ranged.where(F.col("range").isin(whole)).union(ranged.where(F.col("range") == n).orderBy(*order).limit(left)).drop("range")
        whole, left = [*whole, n], left - many
    return ranged.drop("range")


def align(ref: DataFrame, tgt: DataFrame, signature_aware: bool = False, least: int = 65, max_signals: int | None = None, max_pairs: int | None = None, block: int = BLOCK) -> DataFrame:
    """Pairs (ref_id, tgt_id, strategy, score): tier by tier over what earlier ones left; similarity last, if asked for.

    What a tier finds is written once. All left-over signals take part in the last tier, or with max_signals so many of each
    side and language. max_pairs, a policy: so many pairs at most, the first by tier, then by key and number, or by score and
    ids; what the others would have paired stays unmatched.
    """
    ref, tgt = cut(ref, "signals"), cut(tgt, "signals")
    pairs, many = None, 0
    enough = lambda: max_pairs is not None and many >= max_pairs
    for tier in range(len(TIERS)):
        if enough():  # what later tiers find stands behind these
            break
        found = cut(_zipped(ref, tgt, tier), "pairs")
        pairs = found if pairs is None else pairs.union(found)
        many += found.count() if max_pairs is not None else 0
        ref = ref.join(found.select(F.col("ref_id").alias("fact_id")), "fact_id", "left_anti")
        tgt = tgt.join(found.select(F.col("tgt_id").alias("fact_id")), "fact_id", "left_anti")
    if pairs is None:
        pairs = _zipped(ref, tgt, 0).where("false")
    if signature_aware and not enough():
        capped = lambda df: df if max_signals is None else df.withColumn("n", F.row_number().over(W.partitionBy("language").orderBy(*_ORDER))).where(F.col("n") <= max_signals).drop("n")
        r, t = (cut(capped(x), "left_over") for x in (ref, tgt))
        last = matched(r, t, least, block)
        pairs = pairs.union(last.select("ref_id", "tgt_id", "strategy", "score", _place(len(TIERS), -F.col("score"), F.col("ref_key"), F.col("tgt_key"), F.lit(0)).alias("place")))
    if max_pairs is not None:
        pairs = _first(pairs, max_pairs, "place", "ref_id", "tgt_id")
    return pairs.drop("place")


def unmatched(signals: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    return signals.join(pairs.select(F.col(f"{side}_id").alias("fact_id")), "fact_id", "left_anti")


REASONS = ("declaration", "calls", "control", "literals", "window_hash", "import_signature", "symbol_context_signature")


def difference_reasons(pairs: DataFrame, ref: DataFrame, tgt: DataFrame, modified: DataFrame) -> DataFrame:
    """Pairs with the signatures that differ; a function of the same path and name in a modified file always differs."""
    p = pairs.alias("p").join(ref.alias("r"), F.col("p.ref_id") == F.col("r.fact_id")).join(tgt.alias("t"), F.col("p.tgt_id") == F.col("t.fact_id"))
    p = p.join(modified.select(F.col("relative_path").alias("changed_path")).distinct(), F.col("t.relative_path") == F.col("changed_path"), "left")
    same = (F.col("r.relative_path") == F.col("t.relative_path")) & (F.col("r.name_key") == F.col("t.name_key"))
    reasons = F.array_compact(F.array(*[F.when(F.col(f"r.{c}") != F.col(f"t.{c}"), F.lit(c)) for c in REASONS], F.when(same & F.col("changed_path").isNotNull(), F.lit("modified_file"))))
    return p.select("ref_id", "tgt_id", "strategy", "score", reasons.alias("reasons"))


def relational_status(judged: DataFrame, unmatched_ref: DataFrame, unmatched_tgt: DataFrame) -> DataFrame:
    """One row: pairs, those that differ, unmatched functions, and the status that follows."""
    one = judged.agg(F.count("*").alias("pairs"), F.count_if(F.size("reasons") > 0).alias("different"))
    out = one.join(F.broadcast(unmatched_ref.agg(F.count("*").alias("unmatched_reference")))).join(F.broadcast(unmatched_tgt.agg(F.count("*").alias("unmatched_target"))))
    differs = (F.col("different") > 0) | (F.col("unmatched_reference") > 0) | (F.col("unmatched_target") > 0)
    return out.withColumn("status", F.when(differs, "observed_difference").when(F.col("pairs") == 0, "inconclusive").otherwise("no_difference_observed"))
