"""Streams against their batch twins."""

import random

from pyspark.sql import functions as F

from factloom.operators import brief, evals
from factloom.sources import store
from factloom.streaming import incremental

SCHEMA = "key string, at long, missing long, healed long, gain double"


def test_moving_mean(spark):
    rows = [(k, [1.0, 0.0, 1.0][:k]) for k in range(4)]
    got = spark.createDataFrame(rows, "n int, g array<double>").select("n", incremental.ema(F.col("g")).alias("x")).orderBy("n").collect()
    assert [None if r.x is None else round(r.x, 12) for r in got] == [None, 1.0, 0.7, 0.79]


def test_running_state_of_a_stream_is_that_of_a_batch(spark, tmp_path):
    draw = random.Random(2)
    rows = [(f"k{draw.randrange(4)}", t, draw.randrange(5), draw.randrange(3), round(draw.random(), 3)) for t in range(60)]
    source = str(tmp_path / "in")
    for part in range(3):
        spark.createDataFrame(rows[20 * part : 20 * part + 20], SCHEMA).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    query = incremental.running_stats_stream(stream, ["key"]).writeStream.outputMode("update").format("memory").queryName("running").start()
    query.processAllAvailable()
    query.stop()
    last = {}
    for r in spark.sql("select * from running").collect():
        if r.key not in last or r.observations > last[r.key].observations:
            last[r.key] = r
    batch = {r.key: r for r in incremental.running_stats(spark.createDataFrame(rows, SCHEMA), ["key"]).collect()}
    assert set(last) == set(batch)
    for k, r in batch.items():
        assert (r.observations, r.missing, r.healed, r.unresolved, round(r.ema, 9)) == (last[k].observations, last[k].missing, last[k].healed, last[k].unresolved, round(last[k].ema, 9))


def test_upserts_of_a_stream(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "relative_path string, content_hash string"
    for part in ([("a", "1"), ("b", "1")], [("a", "2")], [("c", "1")]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    query = incremental.upsert_files(stream, out, str(tmp_path / "ck")).start()
    query.processAllAvailable()
    query.stop()
    assert sorted(map(tuple, incremental.current(spark, out).collect())) == [("a", "2"), ("b", "1"), ("c", "1")]


def test_jobs_and_controller(spark):
    changes = spark.createDataFrame([("x", ["a.rs"], ["s"]), ("y", ["A.MD"], []), ("z", [], [])], "fingerprint string, changed_files array<string>, changed_symbols array<string>")
    jobs = {f: {r.job for r in brief.refresh_jobs(changes).collect() if r.fingerprint == f} for f in "xyz"}
    assert len(jobs["x"]) == 8 and len(jobs["y"]) == 5 and "regenerate_decision_records" in jobs["y"] and len(jobs["z"]) == 4
    steps = spark.createDataFrame([("k", t, g) for t, g in enumerate([0.5, 0.0, 0.9])], "key string, at long, gain double")
    rows = incremental.controller(steps, ["key"], 0.4).orderBy("at").collect()
    assert [r.goes_on for r in rows] == [True, True, False] and rows[0].forecast is None


def test_percentiles_and_summary(spark):
    rows = spark.createDataFrame([(float(x),) for x in (40, 10, 30, 20)], "x double")
    assert tuple(evals.percentile_by(rows, [], "x", [50, 95]).first()) == (20.0, 30.0)
    assert evals.percentile_by(rows.where("x > 99"), [], "x", [50]).first().p50 == 0
    many = spark.createDataFrame([("a", float(x % 7)) for x in range(100)] + [("b", 1.0)], "k string, x double")
    assert {r.k: (r.p50, r.p95) for r in evals.percentile_by(many, ["k"], "x", [50, 95]).collect()} == {"a": (sorted(x % 7 for x in range(100))[49], 6.0), "b": (1.0, 1.0)}
    results = spark.createDataFrame([(0.4, 0.6, 120), (0.5, 0.8, 180)], "baseline_score double, uplifted_score double, latency_ms long")
    assert [round(x, 9) for x in evals.summarize(results).first()] == [0.45, 0.7, 0.25, 150.0] and tuple(evals.summarize(results.limit(0)).first()) == (0.0, 0.0, 0.0, 0.0)


def test_state_is_written_beside_what_it_replaces(spark, tmp_path):
    path = str(tmp_path / "state")
    rows = lambda *r: spark.createDataFrame(list(r), "k string, v long")
    assert store.upsert_state(rows(("a", 1), ("b", 1)), ["k"], path) == 1
    assert store.upsert_state(rows(("b", 2), ("c", 2)), ["k"], path) == 2
    assert sorted(map(tuple, store.current(spark, path).collect())) == [("a", 1), ("b", 2), ("c", 2)]
    assert sorted(map(tuple, store.pinned(spark, path, 1).collect())) == [("a", 1), ("b", 1)]


def test_forecasts_of_many_keys_stream_by(spark):
    rows = [(k, t, float((k * 7 + t * 13) % 10)) for k in range(20) for t in range(30)]
    got = {(r.key, r.at): r.forecast for r in incremental.controller(spark.createDataFrame(rows, "key long, at long, gain double").repartition(5), ["key"], 1.0).collect()}
    for k in range(20):
        mean = None
        for key, t, gain in rows:
            if key == k:
                assert got[k, t] is None if mean is None else abs(got[k, t] - mean) < 1e-9
                mean = gain if mean is None else 0.7 * mean + 0.3 * gain
