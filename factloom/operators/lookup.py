"""Exact lookups over the fact tables, each for a batch of requests (request_id and what is looked up)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, col, contains_any, normalise_path


def exact_path(files: DataFrame, requests: DataFrame) -> DataFrame:
    """Files whose path is the request's target, slashes normalised; at most one for each request and snapshot."""
    asked = requests.select("request_id", normalise_path("target").alias("relative_path"))
    return asked.join(files, "relative_path")


def exact_symbol(symbols: DataFrame, requests: DataFrame) -> DataFrame:
    """Symbols of the target's name, case counting."""
    return requests.select("request_id", F.col("target").alias("name")).join(symbols, "name")


def symbol_by_fact_id(symbols: DataFrame, requests: DataFrame) -> DataFrame:
    """The symbol of a fact id; of equal ids the first by path, line and name."""
    first = F.row_number().over(W.partitionBy("request_id").orderBy("relative_path", "line_number", "name"))
    found = requests.select("request_id", F.col("target").alias("fact_id")).join(symbols, "fact_id")
    return found.withColumn("n", first).where("n = 1").drop("n")


def symbols_for_path(symbols: DataFrame, paths: DataFrame) -> DataFrame:
    """Symbols of each path with their place by line, name and id."""
    place = F.row_number().over(W.partitionBy("request_id", "relative_path").orderBy("line_number", "name", "fact_id"))
    return paths.join(symbols, "relative_path").withColumn("place", place)


def direct_imports(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges out of each path."""
    return paths.select("request_id", F.col("relative_path").alias("importer_path")).join(imports, "importer_path")


def reverse_imports(imports: DataFrame, paths: DataFrame) -> DataFrame:
    """Resolved edges into each path, with their place by importer, line, spec and id."""
    found = paths.select("request_id", F.col("relative_path").alias("resolved_path")).join(imports, "resolved_path")
    place = F.row_number().over(W.partitionBy("request_id", "resolved_path").orderBy("importer_path", "line_number", "import_spec", "fact_id"))
    return found.withColumn("place", place)


def seed_paths(files: DataFrame, symbols: DataFrame, requests: DataFrame) -> DataFrame:
    """Where a target is: its path, and the paths of symbols of that name."""
    by_path = requests.select("request_id", F.col("target").alias("relative_path")).join(files.select("relative_path"), "relative_path")
    by_name = exact_symbol(symbols, requests)
    return by_path.select("request_id", "relative_path").union(by_name.select("request_id", "relative_path")).distinct()


def path_matches(path: Column | str, scope: Column | str) -> Column:
    """A path is its scope or lies below it; the empty scope holds all paths."""
    path, scope = col(path), col(scope)
    return (scope == "") | (path == scope) | F.startswith(path, F.concat(scope, F.lit("/")))


def ancestors(path: Column | str) -> Column:
    """A path, the folders above it, and the empty root: the scopes that can hold it. With them a prefix join is an equi-join."""
    parts = F.split(col(path), "/")
    up = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    return F.array_distinct(F.concat(F.array(F.lit("")), up))


def nearest_manifest(files: DataFrame, manifests: DataFrame) -> DataFrame:
    """For each file the manifest in its folder or in the nearest one above; else the one at the root, if any.

    manifests: folder and manifest_path.
    """
    folders = files.select("relative_path", F.explode(ancestors(F.regexp_extract("relative_path", "^(.*)/[^/]*$", 1))).alias("folder"))
    best = folders.join(manifests, "folder").groupBy("relative_path").agg(F.max_by("manifest_path", F.length("folder")).alias("manifest_path"))
    return files.join(best, "relative_path", "left")


def scope_filter(path: Column | str, scope: Column | str) -> Column:
    """The full-text scope: a prefix in which case does not count and _ and % stand for any characters."""
    return F.call_function("ilike", col(path), F.concat(col(scope), F.lit("%")))


# What marks documents and lines that tell of decisions.
DECISION_PATHS = ("adr", "decision", "intent", "spec")
DECISION_MARKERS = ("decision", "rationale", "tradeoff", "status:", "intent")
BRIEF_MARKERS = (*DECISION_MARKERS, "why")


def looks_like_decision_doc(path: Column | str, language: Column | str, extension: Column | str) -> Column:
    markdown = (F.coalesce(ascii_lower(language), F.lit("")) == "markdown") | (F.coalesce(ascii_lower(extension), F.lit("")) == "md")
    return markdown | contains_any(ascii_lower(path), DECISION_PATHS)


def has_marker(text: Column | str, markers=DECISION_MARKERS) -> Column:
    return contains_any(ascii_lower(text), markers)


def looks_like_test(check: Column | str) -> Column:
    return contains_any(col(check), (" test", "unittest", "pytest"))


def affects_verification(path: Column | str) -> Column:
    """Manifests, and anything in folders of tests."""
    name = F.substring_index(col(path), "/", -1)
    return name.isin("Cargo.toml", "package.json", "pyproject.toml") | F.array_contains(F.split(col(path), "/"), "tests")


def matching_receipts(receipts: DataFrame, wanted: DataFrame) -> DataFrame:
    """Ids of receipts of a source type and ref whose locator holds a text, where one is given."""
    return (
        wanted.join(receipts, ["source_type", "source_ref"])
        .where(F.col("locator_part").isNull() | F.contains("locator", F.col("locator_part")))
        .groupBy("request_id")
        .agg(F.array_sort(F.collect_set("id")).alias("receipt_ids"))
    )


def check_receipts(receipts: DataFrame, checks: DataFrame) -> DataFrame:
    """Ids of the receipts of verification targets whose ref is one of a request's checks (request_id, check), white space
    around either aside."""
    asked = checks.select("request_id", F.trim("check").alias("ref")).where("ref <> ''").distinct()
    held = receipts.where("source_type = 'verification_target'").select(F.trim("source_ref").alias("ref"), "id")
    return asked.join(held, "ref").select("request_id", "id").distinct()
