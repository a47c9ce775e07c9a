"""Incremental variants: running gains by key, upserts of snapshots and index, and maintenance work as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import lexical_store
from ..operators.brief import refresh_jobs
from ..operators.delta import merge_paths
from ..sources.store import current, versions

__all__ = ["controller", "current", "ema", "index_stream", "jobs_stream", "latest_wins", "running_stats", "running_stats_stream", "upsert_files"]

OLD, NEW = 0.7, 0.3


def ema(gains: Column) -> Column:
    """The moving mean of gains in order: the first as it is, then OLD of what was and NEW of each."""
    return F.aggregate(gains, F.lit(None).cast("double"), lambda acc, x: F.when(acc.isNull(), x).otherwise(OLD * acc + NEW * x))


def running_stats(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: observations, missing, healed and unresolved slots, and the moving mean of gain by time.

    outcomes: keys, at, missing, healed, gain. The mean is a weighted sum, by how many outcomes of the key are later: a
    window and an aggregate, no list of a key's gains.
    """
    w = W.partitionBy(*keys)
    later = F.row_number().over(w.orderBy(F.desc("at"), F.desc("gain"))) - 1
    rows = outcomes.withColumn("later", later).withColumn("n", F.count("*").over(w))
    weight = F.pow(F.lit(OLD), F.col("later")) * F.when(F.col("later") == F.col("n") - 1, 1.0).otherwise(NEW)
    return rows.groupBy(*keys).agg(F.count("*").alias("observations"), F.sum("missing").alias("missing"), F.sum("healed").alias("healed"), (F.sum("missing") - F.sum("healed")).alias("unresolved"), F.sum(weight * F.col("gain")).alias("ema"))


_STATE = "observations long, missing long, healed long, ema double"


def running_stats_stream(outcomes: DataFrame, keys: list[str]) -> DataFrame:
    """The same as state that grows with the stream; each batch gives the new values of the keys it touched.

    Rows of a batch are taken in order of `at`; a stream must deliver batches in that order.
    """
    types = dict(outcomes.dtypes)
    key_schema = ", ".join(f"{k} {types[k]}" for k in keys)

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, missing, healed, mean = state.get if state.exists else (0, 0, 0, None)
        rows = pd.concat(list(parts)).sort_values(["at", "gain"])
        for gain in rows["gain"]:
            mean = gain if mean is None else OLD * mean + NEW * gain
        n, missing, healed = n + len(rows), missing + int(rows["missing"].sum()), healed + int(rows["healed"].sum())
        state.update((n, missing, healed, mean))
        yield pd.DataFrame([(*key, n, missing, healed, missing - healed, mean)], columns=[*keys, "observations", "missing", "healed", "unresolved", "ema"])

    out = f"{key_schema}, observations long, missing long, healed long, unresolved long, ema double"
    return outcomes.groupBy(*keys).applyInPandasWithState(update, out, _STATE, "update", GroupStateTimeout.NoTimeout)


def controller(outcomes: DataFrame, keys: list[str], floor: float) -> DataFrame:
    """For each step of a key (at, gain) the forecast before it and whether the controller goes on.

    Rows of a key stream by in order of time and gain: what is held is one number.
    """
    schema = T.StructType([*outcomes.schema.fields, T.StructField("forecast", T.DoubleType())])

    def forecast(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, mean = None, None
        for rows in parts:
            out = []
            for key, gain in zip(rows[keys].itertuples(index=False, name=None), rows["gain"], strict=True):
                if key != now:
                    now, mean = key, None
                out.append(mean)
                mean = gain if mean is None else OLD * mean + NEW * gain
            yield rows.assign(forecast=pd.array(out, dtype="Float64"))

    ordered = outcomes.repartition(*keys).sortWithinPartitions(*keys, "at", "gain")
    out = ordered.mapInPandas(forecast, schema)
    return out.withColumn("goes_on", F.col("forecast").isNull() | (F.col("forecast") >= floor))


def latest_wins(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """State rows of new, and those of old whose key new lacks."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def upsert_files(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Scanned rows (with relative_path) merged into the table at path, batch by batch.

    A batch writes a new version beside the old one and then names it current, so a batch that runs again does no harm.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = max((v for v in versions(spark, path) if v < epoch + 1), default=None)
        merged = batch if before is None else merge_paths(spark.read.schema(batch.schema).parquet(f"{path}/v{before}"), batch, batch)
        merged.write.mode("overwrite").parquet(f"{path}/v{epoch + 1}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def index_stream(changes: DataFrame, root: str, checkpoint: str) -> DataStreamWriter:
    """Changed documents (snapshot_id, relative_path, content_hash, body, at) kept up in the index at root: a null hash deletes.

    Of a document's changes in a batch the last by `at` counts. Epoch N writes version N + 1 from version N, so a batch that
    runs again after a failure writes what it wrote before.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        last = F.max_by(F.struct("content_hash", "body"), F.struct("at", "content_hash")).alias("last")
        latest = batch.groupBy(*lexical_store.KEYS).agg(last).select(*lexical_store.KEYS, "last.content_hash", "last.body")
        lexical_store.apply_changes(latest, root, epoch + 1)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)


def jobs_stream(changes: DataFrame) -> DataFrame:
    """Maintenance work of a stream of change sets: stateless, as in a batch."""
    return refresh_jobs(changes)
