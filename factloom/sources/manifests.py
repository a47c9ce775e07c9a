"""Verification targets from manifests, with SQL expressions over their lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import parent_dir

WORKSPACE_MEMBER = "src/rust/xtask/Cargo.toml"


def toml_string(text: Column | str, section: str, key: str) -> Column:
    """The string of key in [section], read line by line; null if the first such line holds no string."""
    lines = F.transform(F.split(text, r"\r?\n"), F.trim)
    start = F.struct(F.lit(False).alias("inside"), F.lit(None).cast("string").alias("found"))

    def step(acc: Column, line: Column) -> Column:
        header = F.startswith(line, F.lit("[")) & F.endswith(line, F.lit("]"))
        hit = acc["inside"] & acc["found"].isNull() & F.startswith(line, F.lit(f"{key} = "))
        inside = F.when(header, line == f"[{section}]").otherwise(acc["inside"])
        return F.struct(inside.alias("inside"), F.when(hit, line).otherwise(acc["found"]).alias("found"))

    line = F.aggregate(lines, start, step)["found"]
    value = F.regexp_extract(line, r'^[^=]*= *"([^"]*)"', 1)
    return F.when(line.rlike(r'^[^=]*= *"[^"]*"'), value)


def _target(label: Column, command: list[str], kind: str, priority: str, tests: Column | None = None) -> Column:
    words = F.array(*[F.lit(x) for x in command])
    words = words if tests is None else F.when(tests, F.array_append(words, F.lit("tests"))).otherwise(words)
    return F.struct(label.alias("label"), words.alias("command"), F.lit(kind).alias("kind"), F.lit(priority).alias("priority"))


def has_script(text: Column | str, name: str) -> Column:
    """The manifest has a script of that name whose value is a string."""
    found = F.try_variant_get(F.try_parse_json(text), f"$.scripts['{name}']", "variant")
    return F.schema_of_variant(found) == "STRING"


def verification_targets(sources: DataFrame) -> DataFrame:
    """Targets of the manifests among sources (snapshot_id, relative_path, text); a root pyproject is not read."""
    names = sources.select("snapshot_id", F.col("relative_path").alias("p"))
    manifests = sources.where(F.col("relative_path").rlike(r"(^|/)(Cargo\.toml|package\.json)$|/pyproject\.toml$") & F.col("text").isNotNull())
    scope = parent_dir("relative_path")
    m = manifests.select("snapshot_id", "relative_path", "text", scope.alias("scope_root"))
    # which folders of a manifest hold files, and whether the workspace has its helper
    folders = F.split("p", "/")
    deep = names.select("snapshot_id", F.explode(F.transform(F.sequence(F.lit(1), F.size(folders)), lambda k: F.struct(F.array_join(F.slice(folders, F.lit(1), k - 1), "/").alias("scope_root"), F.when(k < F.size(folders), F.get(folders, k - 1)).alias("d")))).alias("x")).select("snapshot_id", "x.*").where("d in ('tests', 'src')")
    held = deep.groupBy("snapshot_id", "scope_root").agg(F.bool_or(F.col("d") == "tests").alias("has_tests"), F.bool_or(F.col("d") == "src").alias("has_src"))
    helper = names.where(F.col("p") == WORKSPACE_MEMBER).select("snapshot_id", F.lit(True).alias("has_helper")).distinct()
    m = m.join(held, ["snapshot_id", "scope_root"], "left").join(helper, "snapshot_id", "left").fillna(False, ["has_tests", "has_src", "has_helper"])
    text, path = F.col("text"), F.col("relative_path")
    cargo, root = F.endswith(path, F.lit("Cargo.toml")), F.col("scope_root") == ""
    package, project = toml_string(text, "package", "name"), toml_string(text, "project", "name")
    json_name = F.try_variant_get(F.try_parse_json(text), "$.name", "string")
    is_json, python = F.endswith(path, F.lit("package.json")), F.endswith(path, F.lit("pyproject.toml")) & project.isNotNull()
    workspace = cargo & root & F.exists(F.split(text, r"\r?\n"), lambda x: F.trim(x) == "[workspace]") & F.col("has_helper")
    label = lambda prefix, name: F.concat(F.lit(prefix), name)
    tests, src = F.col("has_tests"), F.col("has_src")
    rows = F.array_compact(F.array(
        F.when(workspace, _target(F.lit("repo-native quality"), ["cargo", "xtask", "quality"], "quality", "recommended")),
        F.when(workspace, _target(F.lit("repo-native full check"), ["cargo", "xtask", "check"], "quality", "recommended")),
        F.when(is_json & root & has_script(text, "quality:check"), _target(F.lit("root quality check"), ["pnpm", "quality:check"], "quality", "recommended")),
        F.when(cargo & package.isNotNull(), _target(label("cargo tests for ", package), ["cargo", "test"], "test", "required")),
        F.when(cargo & package.isNotNull(), _target(label("cargo check for ", package), ["cargo", "check"], "typecheck", "recommended")),
        F.when(is_json & ~root & json_name.isNotNull() & has_script(text, "typecheck"), _target(label("typecheck for ", json_name), ["pnpm", "typecheck"], "typecheck", "required")),
        F.when(python & tests, _target(label("unit tests for ", project), ["python", "-m", "unittest", "discover", "tests"], "test", "required")),
        F.when(python & src & F.contains(text, F.lit("[tool.mypy]")), _target(label("mypy for ", project), ["python", "-m", "mypy", "--config-file", "pyproject.toml", "src"], "typecheck", "recommended", tests)),
        F.when(python & src & F.contains(text, F.lit("[tool.ruff]")), _target(label("ruff for ", project), ["python", "-m", "ruff", "check", "src"], "quality", "recommended", tests)),
    ))
    out = m.select("snapshot_id", "scope_root", F.when(root, F.lit(".")).otherwise(F.col("scope_root")).alias("working_directory"), F.inline(rows))
    return out.select("snapshot_id", "label", "scope_root", "working_directory", "command", "kind", "priority")
