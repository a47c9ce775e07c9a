"""Two snapshots: what differs, and the merge of a scan of some paths into an older snapshot.

Frames of the two sides have the fact tables' columns; a side is one snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import render_target
from .lookup import affects_verification


def file_changes(ref: DataFrame, tgt: DataFrame) -> DataFrame:
    """relative_path and change: added, removed or modified (by content)."""
    a, b = ref.select("relative_path", F.col("content_hash").alias("old")), tgt.select("relative_path", F.col("content_hash").alias("new"))
    both = a.withColumn("in_ref", F.lit(True)).join(b.withColumn("in_tgt", F.lit(True)), "relative_path", "full")
    change = F.when(F.col("in_ref").isNull(), "added").when(F.col("in_tgt").isNull(), "removed").when(~F.col("old").eqNullSafe(F.col("new")), "modified")
    return both.select("relative_path", change.alias("change")).where("change is not null")


def _facts(ref: DataFrame, tgt: DataFrame, columns: list[str]) -> DataFrame:
    pick = lambda a, b, change: a.select("fact_id", *columns).dropDuplicates(["fact_id"]).join(b.select("fact_id"), "fact_id", "left_anti").withColumn("change", F.lit(change))
    return pick(tgt, ref, "added").union(pick(ref, tgt, "removed"))


def symbol_changes(ref: DataFrame, tgt: DataFrame) -> DataFrame:
    return _facts(ref, tgt, ["relative_path"])


def import_changes(ref: DataFrame, tgt: DataFrame) -> DataFrame:
    return _facts(ref, tgt, ["importer_path", "resolved_path"])


def target_changes(ref: DataFrame, tgt: DataFrame) -> DataFrame:
    """Rendered verification targets of one side alone."""
    text = render_target("command", "working_directory", "scope_root").alias("target")
    a, b = ref.select(text).distinct(), tgt.select(text).distinct()
    return b.subtract(a).withColumn("change", F.lit("added")).union(a.subtract(b).withColumn("change", F.lit("removed")))


def changed_scope(files: DataFrame, symbols: DataFrame, imports: DataFrame, cap: int | None = None) -> DataFrame:
    """Paths that any difference touches, in order, the first `cap` of them."""
    paths = files.select("relative_path").union(symbols.select("relative_path")).union(imports.select(F.explode(F.array_compact(F.array("importer_path", "resolved_path")))))
    paths = paths.distinct()
    return paths if cap is None else paths.orderBy("relative_path").limit(cap)


def semantic_delta(ref: dict[str, DataFrame], tgt: dict[str, DataFrame], cap: int | None = None) -> dict[str, DataFrame]:
    """What differs, as rows: files, symbols, imports and targets by change, the scope of paths they touch, and a summary of
    one row with their counts and whether there are any."""
    files, symbols, imports = file_changes(ref["files"], tgt["files"]), symbol_changes(ref["symbols"], tgt["symbols"]), import_changes(ref["imports"], tgt["imports"])
    targets = target_changes(ref["verification_targets"], tgt["verification_targets"])
    kinds = {"files": (files, ("added", "removed", "modified")), "symbols": (symbols, ("added", "removed")), "imports": (imports, ("added", "removed")), "targets": (targets, ("added", "removed"))}
    summary = None
    for name, (rows, changes) in kinds.items():
        part = rows.agg(*[F.count_if(F.col("change") == c).alias(f"{c}_{name}") for c in changes])
        summary = part if summary is None else summary.join(F.broadcast(part))  # one row each
    counts = [f"{c}_{name}" for name, (_, changes) in kinds.items() for c in changes]
    summary = summary.withColumn("has_changes", F.greatest(*counts) > 0)
    return {"files": files, "symbols": symbols, "imports": imports, "targets": targets, "scope": changed_scope(files, symbols, imports, cap), "summary": summary}


def delta_report(delta: dict[str, DataFrame], most: int = 1000) -> DataFrame:
    """The summary with lists to show: the first `most` of each kind of file, target and scope path, in order."""

    def listed(rows: DataFrame, c: str, change: str, name: str) -> DataFrame:
        some = rows.where(F.col("change") == change) if change else rows
        return some.orderBy(c).limit(most).agg(F.array_sort(F.collect_list(c)).alias(name))

    out = delta["summary"]
    for change in ("added", "removed", "modified"):
        out = out.join(F.broadcast(listed(delta["files"], "relative_path", change, f"{change}_file_list")))  # one row of `most` paths
    for change in ("added", "removed"):
        out = out.join(F.broadcast(listed(delta["targets"], "target", change, f"{change}_target_list")))
    return out.join(F.broadcast(listed(delta["scope"], "relative_path", "", "changed_scope")))


def resolve_changed(paths: DataFrame, known: DataFrame) -> DataFrame:
    """Each input path as the known path that it names, the known ones below it, or itself as unresolved.

    The prefix join is an equi-join on the folders above each known path.
    """
    asked = paths.select(F.col("relative_path").alias("input")).distinct()
    names = known.select("relative_path").distinct()
    exact = asked.join(names, asked.input == names.relative_path).select("input", "relative_path", F.lit("exact").alias("how"))
    parts = F.split("relative_path", "/")
    folders = names.select("relative_path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("input")).where("input <> relative_path")
    below = asked.join(exact.select("input"), "input", "left_anti").join(folders, "input").select("input", "relative_path", F.lit("prefix").alias("how"))
    rest = asked.join(exact.select("input"), "input", "left_anti").join(below.select("input").distinct(), "input", "left_anti")
    return exact.union(below).union(rest.select("input", F.lit(None).cast("string"), F.lit("unresolved")))


def merge_paths(base: DataFrame, target: DataFrame, changed: DataFrame, on: str = "relative_path") -> DataFrame:
    """Rows of base outside the changed paths and of target inside."""
    keys = changed.select(F.col("relative_path").alias(on)).distinct()
    return base.join(keys, on, "left_anti").unionByName(target.join(keys, on, "left_semi"))


def merge_snapshot(base: dict[str, DataFrame], target: dict[str, DataFrame], changed: DataFrame) -> dict[str, DataFrame]:
    """base with the changed paths taken from target. Imports of files that refer to a changed path, in either snapshot,
    come from target too; verification targets do if a changed path affects them."""
    into = base["imports"].unionByName(target["imports"]).join(changed.select(F.col("relative_path").alias("resolved_path")).distinct(), "resolved_path", "left_semi")
    importers = changed.select("relative_path").union(into.select("importer_path")).distinct()
    affected = changed.where(affects_verification("relative_path")).limit(1)
    flag = affected.agg((F.count("*") > 0).alias("affected"))
    targets = base["verification_targets"].join(F.broadcast(flag), ~F.col("affected"), "inner").drop("affected").unionByName(target["verification_targets"].join(F.broadcast(flag), F.col("affected"), "inner").drop("affected"))
    return {
        "files": merge_paths(base["files"], target["files"], changed).dropDuplicates(),
        "symbols": merge_paths(base["symbols"], target["symbols"], changed).dropDuplicates(),
        "imports": merge_paths(base["imports"], target["imports"], importers, "importer_path").dropDuplicates(),
        "verification_targets": targets.dropDuplicates(),
    }


def languages(files: DataFrame) -> DataFrame:
    return files.agg(F.array_sort(F.collect_set("language")).alias("languages"))


def scope_coverage(applied: DataFrame, full: DataFrame) -> DataFrame:
    """How much of the full scope an applied one covers: counts, percent (100 for none), and what is missing."""
    a, b = applied.select("relative_path").distinct(), full.select("relative_path").distinct()
    marked = b.join(a.withColumn("there", F.lit(True)), "relative_path", "left")
    out = marked.agg(F.count("*").alias("full"), F.count("there").alias("covered"), F.array_sort(F.collect_list(F.when(F.col("there").isNull(), F.col("relative_path")))).alias("missing"))
    return out.withColumn("percent", F.when(F.col("full") == 0, 100).otherwise(F.floor(F.col("covered") * 100 / F.col("full"))).cast("long"))


def normalise(facts: DataFrame, order: list[str]) -> DataFrame:
    """Equal rows once, with their place in the canonical order."""
    return facts.dropDuplicates().withColumn("place", F.row_number().over(W.partitionBy("snapshot_id").orderBy(*order)))
