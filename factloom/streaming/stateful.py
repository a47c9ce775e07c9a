"""Keyed state over events that come late and out of order, with event-time timers; each has a batch twin.

A key's rows wait in its state until the watermark has passed them, and are then taken in the order of their time. So
batches may come in any order within the watermark's delay. What comes later than that is dropped, by the watermark's rule.
A key's state is bounded by the rows that wait: those of one delay.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .incremental import NEW, OLD

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _keyed(rows: DataFrame, keys: list[str], delay: str, processor: StatefulProcessor, out: str) -> DataFrame:
    """rows (with `at`) through the processor, by key: state of this kind needs the RocksDB store."""
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    return rows.withWatermark("at", delay).groupBy(*keys).transformWithStateInPandas(processor, out, "Update", "eventTime")


def _millis(at: pd.Timestamp) -> int:
    return int(at.value // 1_000_000)


class _InOrder(StatefulProcessor):
    """Rows wait in a list; a timer at the earliest of them takes those that the watermark has passed, in order."""

    row_schema: str

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row_schema)
        self.kept = handle.getValueState("kept", self.state_schema)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        earliest = None
        for part in rows:
            new = [self.waits(r) for r in part.itertuples(index=False)]
            if new:
                self.waiting.appendList(new)
                first = min(r[0] for r in new)
                earliest = first if earliest is None else min(earliest, first)
        if earliest is not None:
            self.handle.registerTimer(earliest // 1000 + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        due = [r for r in held if r[0] // 1000 < now]
        rest = held[len(due) :]
        if not due:
            yield pd.DataFrame()
            return
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(rest[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
        state = tuple(self.kept.get()) if self.kept.exists() else self.nothing
        for r in due:
            state = self.step(state, r)
        self.kept.update(state)
        yield self.shown(key, state)

    def close(self) -> None:
        pass


class _Running(_InOrder):
    row_schema, state_schema = "at long, gain double, missing long, healed long", "observations long, missing long, healed long, ema double"
    nothing = (0, 0, 0, 0.0)

    def __init__(self, keys: list[str]):
        self.keys = keys

    def waits(self, r: Any) -> tuple:
        return r.at.value // 1000, float(r.gain), int(r.missing), int(r.healed)

    def step(self, state: tuple, r: tuple) -> tuple:
        n, missing, healed, mean = state
        return n + 1, missing + r[2], healed + r[3], r[1] if not n else OLD * mean + NEW * r[1]

    def shown(self, key: tuple, state: tuple) -> pd.DataFrame:
        n, missing, healed, mean = state
        return pd.DataFrame([(*key, n, missing, healed, missing - healed, mean)], columns=[*self.keys, "observations", "missing", "healed", "unresolved", "ema"])


def _types(df: DataFrame, keys: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"{k} {kinds[k]}" for k in keys)


def running_stats_late(outcomes: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """`incremental.running_stats` of a stream (keys, at, missing, healed, gain) whose rows come late by `delay` at most; each
    row of the result is a key's state at a watermark."""
    out = f"{_types(outcomes, keys)}, observations long, missing long, healed long, unresolved long, ema double"
    return _keyed(outcomes.select(*keys, "at", "missing", "healed", "gain"), keys, delay, _Running(keys), out)


# --- the frontier controller -------------------------------------------------------------------------------------------


def frontier_floor(base: Column) -> Column:
    """The least forecast with which a class goes on, from its threshold (rules.threshold_base)."""
    return F.least(F.greatest(base * 0.8, F.lit(0.002)), F.lit(0.05))


def observed(forecast: float | None, gain: float) -> float | None:
    """The forecast after a gain: a gain that is not finite changes nothing, and none counts as less than zero."""
    if not math.isfinite(gain):
        return forecast
    gain = max(gain, 0.0)
    return gain if forecast is None else OLD * forecast + NEW * gain


def frontier(steps: DataFrame, keys: list[str]) -> DataFrame:
    """steps (keys, at, gain, floor, initial) with the forecast before each, and whether the controller goes on then.

    A forecast starts with the key's first `initial` (null: none), at least 0. Rows of a key stream by in order of time and
    gain: what is held is one number.
    """
    schema = T.StructType([*steps.schema.fields, T.StructField("forecast", T.DoubleType())])

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, forecast = None, None
        for rows in parts:
            out = []
            for key, gain, initial in zip(rows[keys].itertuples(index=False, name=None), rows["gain"], rows["initial"], strict=True):
                if key != now:
                    now, forecast = key, None if pd.isna(initial) else max(float(initial), 0.0)
                out.append(forecast)
                forecast = forecast if gain is None or pd.isna(gain) else observed(forecast, float(gain))
            yield rows.assign(forecast=pd.array(out, dtype="Float64"))

    out = steps.repartition(*keys).sortWithinPartitions(*keys, "at", "gain").mapInPandas(run, schema)
    return out.withColumn("goes_on", F.col("forecast").isNull() | (F.col("forecast") >= F.col("floor")))


class _Frontier(_InOrder):
    row_schema, state_schema = "at long, gain double, floor double, initial double", "forecast double, floor double, steps long"
    nothing = (None, 0.0, 0)

    def __init__(self, keys: list[str]):
        self.keys = keys

    def waits(self, r: Any) -> tuple:
        number = lambda x: None if x is None or pd.isna(x) else float(x)
        return r.at.value // 1000, number(r.gain) if number(r.gain) is not None else math.nan, float(r.floor), number(r.initial)

    def step(self, state: tuple, r: tuple) -> tuple:
        forecast, _, n = state
        if not n and r[3] is not None:
            forecast = max(r[3], 0.0)
        return observed(forecast, r[1]), r[2], n + 1

    def shown(self, key: tuple, state: tuple) -> pd.DataFrame:
        forecast, floor, n = state
        return pd.DataFrame([(*key, n, forecast, forecast is None or forecast >= floor)], columns=[*self.keys, "steps", "forecast", "goes_on"])


def frontier_late(steps: DataFrame, keys: list[str], delay: str) -> DataFrame:
    """The controllers of a stream of steps: by key the steps so far, the forecast after them, and whether it goes on."""
    out = f"{_types(steps, keys)}, steps long, forecast double, goes_on boolean"
    return _keyed(steps.select(*keys, "at", "gain", "floor", "initial"), keys, delay, _Frontier(keys), out)


def frontier_states(steps: DataFrame, keys: list[str]) -> DataFrame:
    """The batch twin of `frontier_late`: the state after a key's last step."""
    last = W.partitionBy(*keys).orderBy(F.desc("at"), F.desc("gain"))
    one = frontier(steps, keys).withColumns({"steps": F.count("*").over(W.partitionBy(*keys)), "n": F.row_number().over(last)}).where("n = 1")
    gain = F.greatest("gain", F.lit(0.0))
    counts = F.col("gain").isNotNull() & ~F.isnan("gain") & (F.abs("gain") < float("inf"))
    after = F.when(~counts, F.col("forecast")).when(F.col("forecast").isNull(), gain).otherwise(OLD * F.col("forecast") + NEW * gain)
    return one.withColumn("forecast", after).select(*keys, "steps", "forecast", (F.col("forecast").isNull() | (F.col("forecast") >= F.col("floor"))).alias("goes_on"))


# --- the ledger of what slots cost -------------------------------------------------------------------------------------


def slot_costs(stages: DataFrame, keys: list[str]) -> DataFrame:
    """For each key and slot what retrieval cost and how often it filled the slot, from stages (keys, slots, elapsed_ms,
    gained): a stage's time is shared by its slots; one without slots or time costs nothing."""
    many = F.size("slots")
    cost = stages.where((many > 0) & (F.col("elapsed_ms") > 0)).select(*keys, F.explode("slots").alias("slot"), (F.col("elapsed_ms") / many).alias("cost_ms"), F.lit(0).alias("gains"))
    gain = stages.select(*keys, F.explode("gained").alias("slot"), F.lit(0.0).alias("cost_ms"), F.lit(1).alias("gains"))
    return cost.union(gain).groupBy(*keys, "slot").agg(F.sum("cost_ms").alias("cost_ms"), F.sum("gains").alias("gains"))


def cost_suffix(cost_ms: Column | str, gains: Column | str) -> Column:
    """What a slot's detail says of its costs; nothing where there are none."""
    cost, n = (F.col(x) if isinstance(x, str) else x for x in (cost_ms, gains))
    return F.when((cost > 0) | (n > 0), F.format_string("; retrieval_cost_ms=%.2f; slot_gains=%d", cost, n.cast("long"))).otherwise("")


class _Ledger(StatefulProcessor):
    """A map from slot to cost and gains for each key. A key without a stage for `idle_ms` of event time is forgotten."""

    def __init__(self, keys: list[str], idle_ms: int):
        self.keys, self.idle = keys, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "slot string", "cost_ms double, gains long")
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        more: dict[str, list] = {}
        last = self.last.get()[0] if self.last.exists() else 0
        for part in rows:
            for r in part.itertuples(index=False):
                last = max(last, _millis(r.at))
                slots = [] if r.slots is None else list(r.slots)
                if slots and r.elapsed_ms is not None and r.elapsed_ms > 0:
                    for slot in slots:
                        more.setdefault(slot, [0.0, 0])[0] += r.elapsed_ms / len(slots)
                for slot in [] if r.gained is None else list(r.gained):
                    more.setdefault(slot, [0.0, 0])[1] += 1
        self.last.update((last,))
        self.handle.registerTimer(last + self.idle)
        out = []
        for slot, (cost, gains) in sorted(more.items()):
            if self.slots.containsKey((slot,)):
                before = self.slots.getValue((slot,))
                cost, gains = cost + before[0], gains + before[1]
            self.slots.updateValue((slot,), (cost, gains))
            out.append((*key, slot, cost, gains, False))
        yield pd.DataFrame(out, columns=[*self.keys, "slot", "cost_ms", "gains", "closed"])

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        """The last word on a key that went idle; a timer that a later stage has overtaken does nothing."""
        if not self.last.exists() or self.last.get()[0] + self.idle > timerValues.getCurrentWatermarkInMs():
            yield pd.DataFrame()
            return
        out = [(*key, slot[0], value[0], value[1], True) for slot, value in self.slots.iterator()]
        self.slots.clear()
        self.last.clear()
        yield pd.DataFrame(out, columns=[*self.keys, "slot", "cost_ms", "gains", "closed"])

    def close(self) -> None:
        pass


def slot_costs_stream(stages: DataFrame, keys: list[str], delay: str, idle_ms: int) -> DataFrame:
    """`slot_costs` of a stream of stages (keys, at, slots, elapsed_ms, gained): the slots that a batch changed, and all slots
    of a key, as closed, once it has been idle for `idle_ms` of event time; then the key's state goes."""
    out = f"{_types(stages, keys)}, slot string, cost_ms double, gains long, closed boolean"
    return _keyed(stages.select(*keys, "at", "slots", "elapsed_ms", "gained"), keys, delay, _Ledger(keys, idle_ms), out)
