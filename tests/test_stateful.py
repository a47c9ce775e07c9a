"""Event-time state against its batch twins, with batches out of order, through a restart."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import rules
from factloom.streaming import incremental, stateful

START = dt.datetime(2024, 1, 1)
SENTINEL = START + dt.timedelta(days=9)


def at(minutes):
    return START + dt.timedelta(minutes=minutes)


def streamed(spark, tmp_path, batches, schema, make, restart_after=None):
    """Rows of the query made by `make`, with one file for each batch; the query starts again after so many of them."""
    source, out, checkpoint = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def run(some):
        for rows in some:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
            query = make(stream).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: df.withColumn("batch", F.lit(n)).write.mode("append").parquet(out)).start()
            try:
                query.processAllAvailable()
            finally:
                query.stop()

    cut = len(batches) if restart_after is None else restart_after
    run(batches[:cut])
    run(batches[cut:])
    return spark.read.parquet(out).orderBy("batch").collect()


def test_shuffled_batches_give_the_state_of_a_batch(spark, tmp_path):
    schema = "key string, at timestamp, missing long, healed long, gain double"
    draw = random.Random(4)
    rows = [(f"k{draw.randrange(3)}", at(t), draw.randrange(5), draw.randrange(3), round(draw.random(), 3)) for t in range(60)]
    late = rows[:]  # out of order by up to 20 minutes, within the delay of 30
    late.sort(key=lambda r: r[1] + dt.timedelta(minutes=draw.randrange(20)))
    batches = [late[:25], late[25:40], late[40:], [("end", SENTINEL, 0, 0, 0.0)]]
    found = streamed(spark, tmp_path, batches, schema, lambda s: stateful.running_stats_late(s, ["key"], "30 minutes"), restart_after=2)
    last = {r.key: r for r in found}
    batch = {r.key: r for r in incremental.running_stats(spark.createDataFrame(rows, schema), ["key"]).collect()}
    assert set(last) == set(batch) and len(found) > 3
    for k, r in batch.items():
        assert (r.observations, r.missing, r.healed, r.unresolved, round(r.ema, 9)) == (last[k].observations, last[k].missing, last[k].healed, last[k].unresolved, round(last[k].ema, 9))


def test_what_comes_after_the_watermark_is_dropped(spark, tmp_path):
    schema = "key string, at timestamp, missing long, healed long, gain double"
    batches = [[("k", at(10), 1, 1, 1.0)], [("k", at(200), 1, 0, 0.5)], [("k", at(20), 9, 9, 9.0)], [("end", SENTINEL, 0, 0, 0.0)]]
    found = streamed(spark, tmp_path, batches, schema, lambda s: stateful.running_stats_late(s, ["key"], "30 minutes"))
    last = {r.key: r for r in found}["k"]
    assert (last.observations, last.missing, round(last.ema, 9)) == (2, 2, 0.85)


STEPS = "key string, at timestamp, gain double, floor double, initial double"


def test_a_controller_stops_when_its_forecast_drops_below_the_floor(spark):
    floor = spark.range(1).select(stateful.frontier_floor(rules.threshold_base(F.lit("safe_edit"), F.lit("interactive"))).alias("f")).first().f
    assert floor == pytest.approx(0.012)
    rows = [("halted", at(0), 0.0, floor, floor / 2), ("free", at(0), floor / 4, floor, None), ("free", at(1), 0.0, floor, None), ("odd", at(0), math.nan, floor, None), ("odd", at(1), -5.0, floor, 3.0), ("odd", at(2), 1.0, floor, None), ("odd", at(3), math.inf, floor, None), ("odd", at(4), None, floor, None)]
    got = {(r.key, r.at): r for r in stateful.frontier(spark.createDataFrame(rows, STEPS), ["key"]).collect()}
    assert not got["halted", at(0)].goes_on and got["free", at(0)].goes_on and not got["free", at(1)].goes_on
    assert [got["odd", at(k)].forecast for k in range(5)] == [None, None, 0.0, 0.3, 0.3]


def test_controllers_of_a_stream_are_those_of_a_batch(spark, tmp_path):
    draw = random.Random(8)
    rows = [(f"k{draw.randrange(4)}", at(t), draw.choice([0.0, 0.01, 0.03, -1.0, math.nan]), 0.012, None) for t in range(40)]
    rows = [(*r[:4], 0.02 if r[0] == "k1" else None) for r in rows]
    late = sorted(rows, key=lambda r: r[1] + dt.timedelta(minutes=draw.randrange(15)))
    batches = [late[:15], late[15:], [("end", SENTINEL, 0.0, 0.0, None)]]
    found = streamed(spark, tmp_path, batches, STEPS, lambda s: stateful.frontier_late(s, ["key"], "20 minutes"))
    last = {r.key: (r.steps, r.forecast and round(r.forecast, 9), r.goes_on) for r in found}
    batch = {r.key: (r.steps, r.forecast and round(r.forecast, 9), r.goes_on) for r in stateful.frontier_states(spark.createDataFrame(rows, STEPS), ["key"]).collect()}
    assert last == batch and len(batch) == 4


STAGES = "key string, at timestamp, slots array<string>, elapsed_ms double, gained array<string>"


def test_a_ledger_of_slots(spark, tmp_path):
    slots = ["exact_anchor", "structural_context", "flow_summary", "decision_evidence"]
    draw = random.Random(6)
    rows = [(f"k{draw.randrange(3)}", at(t), draw.sample(slots, draw.randrange(4)), draw.choice([0.0, -1.0, 12.5, 30.25]), draw.sample(slots, draw.randrange(3))) for t in range(50)]
    rows.append(("k0", at(51), None, 5.0, None))
    draw.shuffle(rows)
    batch = {(r.key, r.slot): (round(r.cost_ms, 9), r.gains) for r in stateful.slot_costs(spark.createDataFrame(rows, STAGES), ["key"]).collect()}
    found = streamed(spark, tmp_path, [rows[:20], rows[20:45], rows[45:], [("end", SENTINEL, [], 0.0, [])]], STAGES, lambda s: stateful.slot_costs_stream(s, ["key"], "2 hours", 60_000), restart_after=1)
    open_ = {(r.key, r.slot): (round(r.cost_ms, 9), r.gains) for r in found if not r.closed}
    closed = {(r.key, r.slot): (round(r.cost_ms, 9), r.gains) for r in found if r.closed}
    assert open_ == batch and closed == batch
    text = spark.createDataFrame([(1.005, 0), (0.0, 2), (0.0, 0)], "c double, g long").select(stateful.cost_suffix("c", "g").alias("t")).collect()
    assert [r.t for r in text][1:] == ["; retrieval_cost_ms=0.00; slot_gains=2", ""] and text[0].t.endswith("; slot_gains=0")


def test_an_idle_key_is_forgotten(spark, tmp_path):
    row = lambda k, t, ms: (k, at(t), ["flow_summary"], ms, [])
    batches = [[row("a", 0, 10.0)], [row("b", 300, 1.0)], [row("c", 301, 1.0)], [row("a", 302, 7.0)]]
    found = streamed(spark, tmp_path, batches, STAGES, lambda s: stateful.slot_costs_stream(s, ["key"], "5 minutes", 60_000))
    assert [(r.cost_ms, r.closed) for r in found if r.key == "a"] == [(10.0, False), (10.0, True), (7.0, False)]
