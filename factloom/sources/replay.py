"""Artifacts of runs that can be replayed: a data source with one atomic publication.

An artifact is a folder named by its run: a header (`artifact.json`: version, snapshots, contract, policy, parts) and parts
with a JSON row on each line, an obligation or a certificate. Tasks write their parts beside it, in a folder of the attempt;
when all are there, one rename makes the artifact visible. A task or a job that fails leaves nothing that a reader sees,
and an artifact is never changed afterwards. The folder has to be mounted on the driver and all executors.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..functions.text import fnv1a
from .schema import ddl
from .tree import local_path

VERSION = "v1"


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int


class ReplayWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.root, self.run = local_path(options["path"]), options["run"]
        self.header = json.loads(options["header"])
        self.attempt = os.path.join(self.root, f"_attempt-{self.run}-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> Part:
        os.makedirs(self.attempt, exist_ok=True)
        name, n = f"part-{uuid.uuid4().hex}.jsonl", 0  # an attempt of a task that runs twice has a name of its own
        with open(os.path.join(self.attempt, name), "w", encoding="utf-8") as f:
            for row in iterator:
                f.write(json.dumps({"kind": row["kind"], "value": row["value"]}, ensure_ascii=False) + "\n")
                n += 1
            f.flush()
            os.fsync(f.fileno())
        return Part(name, n)

    def commit(self, messages: list) -> None:
        parts = sorted((m.name, m.rows) for m in messages if m is not None)
        os.makedirs(self.attempt, exist_ok=True)
        kept = {name for name, _ in parts}
        for name in os.listdir(self.attempt):
            if name not in kept:  # of an attempt that another one has overtaken
                os.remove(os.path.join(self.attempt, name))
        with open(os.path.join(self.attempt, "artifact.json"), "w", encoding="utf-8") as f:
            json.dump(self.header | {"artifact_version": VERSION, "parts": parts}, f, indent=2)
        target = os.path.join(self.root, self.run)
        if os.path.exists(target):
            self.abort(messages)
            raise FileExistsError(f"{target} is there already")
        os.rename(self.attempt, target)

    def abort(self, messages: list) -> None:
        shutil.rmtree(self.attempt, ignore_errors=True)


@dataclass
class PartOf(InputPartition):
    name: str
    rows: int


class ReplayReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.folder = os.path.join(local_path(options["path"]), options["run"])

    def partitions(self) -> list[PartOf]:
        return [PartOf(*x) for x in header(self.folder)["parts"]] or [PartOf("", 0)]

    def read(self, part: PartOf) -> Iterator[tuple[str, str]]:
        if not part.name:
            return
        n = 0
        with open(os.path.join(self.folder, part.name), encoding="utf-8") as f:
            for line in f:
                row = json.loads(line)
                n += 1
                yield row["kind"], row["value"]
        if n != part.rows:
            raise ValueError(f"{part.name} has {n} rows instead of {part.rows}")


class ReplaySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "replay_artifact"

    def schema(self) -> str:
        return "kind string, value string"

    def reader(self, schema) -> ReplayReader:
        return ReplayReader(self.options)

    def writer(self, schema, overwrite: bool) -> ReplayWriter:
        return ReplayWriter(self.options)


def header(folder: str) -> dict:
    with open(os.path.join(folder, "artifact.json"), encoding="utf-8") as f:
        found = json.load(f)
    if found["artifact_version"] != VERSION:
        raise ValueError(f"artifacts of version {found['artifact_version']} are not known")
    return found


def run_id(spark: SparkSession, reference_snapshot: str, target_snapshot: str, nonce: str) -> str:
    """The name of a run's artifact; the nonce tells runs of the same snapshots apart."""
    return spark.range(1).select(fnv1a(F.lit(f"{reference_snapshot}|{target_snapshot}|{nonce}"))).first()[0]


def write_replay(obligations: DataFrame, certificates: DataFrame, root: str, reference_snapshot: str, target_snapshot: str, contract_id: str, policy: dict, nonce: str) -> str:
    """Writes obligations and certificates of a run as an artifact below root and gives its name."""
    spark = obligations.sparkSession
    spark.dataSource.register(ReplaySource)
    run = run_id(spark, reference_snapshot, target_snapshot, nonce)
    about = {"snapshot_id": target_snapshot, "reference_snapshot_id": reference_snapshot, "contract_id": contract_id, "policy": policy}
    as_json = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*df.columns)).alias("value"))
    rows = as_json(obligations, "obligation").union(as_json(certificates, "certificate"))
    rows.write.format("replay_artifact").option("run", run).option("header", json.dumps(about)).mode("append").save(root)
    return run


def read_replay(spark: SparkSession, root: str, run: str) -> tuple[DataFrame, DataFrame]:
    """Obligations and certificates of an artifact."""
    spark.dataSource.register(ReplaySource)
    rows = spark.read.format("replay_artifact").option("run", run).load(root)
    part = lambda kind, schema: rows.where(F.col("kind") == kind).select(F.from_json("value", schema).alias("x")).select("x.*")
    return part("obligation", ddl("obligations")), part("certificate", ddl("certificates"))


def replay_command(path: str, obligation_id: str | None = None) -> str:
    """How a run, or one of its obligations, is replayed."""
    shown = path.replace("\\", "\\\\")
    return f'replay --artifact "{shown}"' + (f" --obligation-id {obligation_id}" if obligation_id else "")
