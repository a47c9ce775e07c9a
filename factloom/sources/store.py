"""Snapshots as datasets: one Parquet folder for each fact table, partitioned by snapshot; JSON in and out.

A table is written without equal rows and in ranges of the key that it is looked up by, sorted in each file. So a lookup of one
key reads the files, and of these the groups of rows, whose range holds it, and a path's facts lie together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import import_fact_id, symbol_fact_id
from .schema import JSON_ALIASES, TABLES, ddl

FACTS = ("files", "symbols", "imports", "verification_targets")
#: The canonical order of each table, the key of its lookups first.
ORDER = {"files": ("relative_path",), "symbols": ("name", "relative_path", "line_number", "fact_id"), "imports": ("importer_path", "line_number", "import_spec", "fact_id"), "verification_targets": ("scope_root", "label", "kind", "command")}


def write_snapshot(facts: dict[str, DataFrame], root: str, ranges: int | None = None) -> None:
    """Each table below root; only the partitions of the snapshots written are replaced. ranges: of keys, and so files of a
    table; by default as many as its size asks for."""
    for name in FACTS:
        keys = ("snapshot_id", *ORDER[name])
        rows = facts[name].dropDuplicates()
        rows = rows.repartitionByRange(*keys) if ranges is None else rows.repartitionByRange(ranges, *keys)
        rows = rows.sortWithinPartitions(*keys)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(f"{root}/{name}")


def read_snapshot(spark: SparkSession, root: str, snapshot_id: str | None = None) -> dict[str, DataFrame]:
    """The fact tables; a snapshot_id reads its partitions alone."""
    out = {}
    for name in FACTS:
        rows = spark.read.schema(ddl(name)).parquet(f"{root}/{name}")
        out[name] = rows if snapshot_id is None else rows.where(F.col("snapshot_id") == snapshot_id)
    return out


def lookup(spark: SparkSession, root: str, name: str, snapshot_id: str, key: str) -> DataFrame:
    """Facts of a snapshot by the key of their table: files by path, symbols by name, imports by importer, targets by scope."""
    return read_snapshot(spark, root, snapshot_id)[name].where(F.col(ORDER[name][0]) == key)


def rows_read(df: DataFrame) -> int:
    """How many rows the scans of a plan have read, after it ran: rows of files and groups that were left out do not count."""
    leaves = df._jdf.queryExecution().executedPlan().collectLeaves()
    total = 0
    for k in range(leaves.size()):
        found = leaves.apply(k).metrics().get("numOutputRows")
        total += found.get().value() if found.isDefined() else 0
    return total


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_inventory(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Fact tables of inventory documents in JSON: missing fact ids are made, old names of kinds are read as new ones."""
    part = lambda name: f"{name} array<struct<{', '.join(x.strip().replace(' ', ':', 1) for x in TABLES[name].split(';') if not x.strip().startswith('snapshot_id'))}>>"
    raw = spark.read.schema("snapshot_id string, " + ", ".join(part(n) for n in FACTS)).option("multiLine", True).json(path)
    out = {n: raw.select("snapshot_id", F.inline(n)) for n in FACTS}
    kind = F.col("kind")
    for old, new in JSON_ALIASES.items():
        kind = F.when(F.col("kind") == old, F.lit(new)).otherwise(kind)
    out["imports"] = out["imports"].withColumn("kind", kind)
    out["symbols"] = out["symbols"].withColumn("fact_id", F.coalesce("fact_id", symbol_fact_id("language", "relative_path", "line_number", "kind", "name")))
    out["imports"] = out["imports"].withColumn("fact_id", F.coalesce("fact_id", import_fact_id("language", "importer_path", "line_number", "kind", "import_spec")))
    return {n: df.dropDuplicates() for n, df in out.items()}


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions of a table at path, which keeps them as folders v1, v2, ..."""
    marks = spark._jvm.org.apache.hadoop.fs
    root = marks.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = fs.listStatus(root) if fs.exists(root) else []
    return sorted(int(s.getPath().getName()[1:]) for s in found if fs.exists(marks.Path(s.getPath(), "_SUCCESS")))


def current(spark: SparkSession, path: str) -> DataFrame:
    """The newest complete version of such a table."""
    return spark.read.parquet(f"{path}/v{versions(spark, path)[-1]}")


def upsert_state(new: DataFrame, keys: list[str], path: str) -> int:
    """State rows by key in the table at path, the new ones winning: a new version beside the old, which readers see once
    it is complete. Gives its number."""
    spark = new.sparkSession
    found = versions(spark, path)
    rows = new
    if found:
        old = spark.read.schema(new.schema).parquet(f"{path}/v{found[-1]}")
        rows = old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)
    number = found[-1] + 1 if found else 1
    rows.write.mode("overwrite").parquet(f"{path}/v{number}")
    return number


def pinned(spark: SparkSession, path: str, number: int) -> DataFrame:
    """One version of such a table, whatever comes after it."""
    return spark.read.parquet(f"{path}/v{number}")
