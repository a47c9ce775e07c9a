"""The stored index against one that is built from scratch; its stream against a rebuild, through repeats and a restart."""

import os
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import lexical, lexical_store
from factloom.streaming import incremental

DOCS = "snapshot_id string, relative_path string, content_hash string, body string"
QUERIES = [("q1", "alpha beta", "", 0), ("q2", "gamma", "src/a", 3), ("q3", "omega alpha", "", 2), ("q4", "nothing", "", 0)]
WORDS = ["alpha", "beta", "gamma", "delta", "omega", "common"]


def document(k, seed):
    draw = random.Random(seed * 1000 + k)
    text = " ".join(["common", *(draw.choice(WORDS) for _ in range(draw.randrange(1, 12)))])
    return ("s", f"src/{'ab'[k % 2]}/f{k:03}.rs", str(hash((seed, k)) % 10**9), text)


def hits(df):
    return sorted((r.request_id, r.snapshot_id, r.relative_path, round(r.bm25, 9), r.place) for r in df.collect())


def asked(spark):
    return spark.createDataFrame(QUERIES, "request_id string, text string, scope string, limit int")


def rebuilt(spark, rows):
    return hits(lexical.search(lexical.build_index(spark.createDataFrame(rows, DOCS)), asked(spark)))


def files_of(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def test_an_index_is_written_once_and_synced_by_what_changed(spark, tmp_path):
    root = str(tmp_path / "index")
    rows = [document(k, 1) for k in range(40)]
    assert lexical_store.ensure(spark.createDataFrame(rows, DOCS), root) == (1, True)
    before = files_of(root)
    assert lexical_store.ensure(spark.createDataFrame(rows, DOCS).repartition(5), root) == (1, False)
    for _ in range(2):
        assert hits(lexical_store.search_stored(spark, root, asked(spark))) == rebuilt(spark, rows)
    assert files_of(root) == before  # neither ensure nor searches wrote anything
    changed = [document(k, 2) if k < 5 else r for k, r in enumerate(rows) if not 10 <= k < 14] + [document(99, 1)]
    assert lexical_store.ensure(spark.createDataFrame(changed, DOCS), root) == (2, True)
    assert lexical_store.documents(spark, root).where("segment = 2").count() == 6  # the others keep the postings they have
    assert hits(lexical_store.search_stored(spark, root, asked(spark))) == rebuilt(spark, changed)
    assert hits(lexical_store.search_stored(spark, root, asked(spark), version=1)) == rebuilt(spark, rows)
    assert {f: t for f, t in files_of(root).items() if f in before} == before
    assert lexical_store.compact(spark, root) == 3
    assert hits(lexical_store.search_stored(spark, root, asked(spark))) == rebuilt(spark, changed)
    assert lexical_store.documents(spark, root).select("segment").distinct().count() == 1


def test_a_search_reads_the_buckets_of_its_words(spark, tmp_path):
    root = str(tmp_path / "index")
    rows = [("s", f"f{k}", str(k), " ".join(f"word{k}x{j}" for j in range(20))) for k in range(30)]
    lexical_store.ensure(spark.createDataFrame(rows, DOCS), root)
    all_ = lexical_store.postings(spark, root)
    one = spark.createDataFrame([("q", "word3x7", "", 0)], "request_id string, text string, scope string, limit int")
    bucket = spark.range(1).select(lexical_store.bucket_of(F.lit("word3x7")).alias("b")).first().b
    plan = lexical_store.search_stored(spark, root, one)._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan and "PartitionFilters: [isnotnull(segment" in plan
    read = lexical_store.postings(spark, root, [bucket])
    assert 0 < read.count() < all_.count() / 10
    assert [r.relative_path for r in lexical_store.search_stored(spark, root, one).collect()] == ["f3"]


def test_snapshots_are_apart_and_one_can_be_invalidated(spark, tmp_path):
    root = str(tmp_path / "index")
    a, b = [document(k, 1) for k in range(12)], [("t", *document(k, 3)[1:]) for k in range(9)]
    assert lexical_store.ensure(spark.createDataFrame(a, DOCS), root)[1]
    assert lexical_store.ensure(spark.createDataFrame(b, DOCS), root)[1]
    assert not lexical_store.ensure(spark.createDataFrame(a, DOCS), root)[1]
    assert hits(lexical_store.search_stored(spark, root, asked(spark))) == rebuilt(spark, a + b)
    lexical_store.invalidate(spark, root, "t")
    assert hits(lexical_store.search_stored(spark, root, asked(spark))) == rebuilt(spark, a)
    assert not lexical_store.ensure(spark.createDataFrame(a, DOCS), root)[1]
    assert lexical_store.ensure(spark.createDataFrame(b, DOCS), root)[1]
    assert hits(lexical_store.search_stored(spark, root, asked(spark))) == rebuilt(spark, a + b)


def test_nothing_indexed_and_documents_without_a_body(spark, tmp_path):
    root = str(tmp_path / "index")
    assert lexical_store.search_stored(spark, root, asked(spark)).count() == 0
    rows = [("s", "a.rs", "1", "alpha beta"), ("s", "gone.rs", "2", None), ("s", "empty.rs", "3", "")]
    lexical_store.ensure(spark.createDataFrame(rows, DOCS), root)
    assert [r.relative_path for r in lexical_store.search_stored(spark, root, asked(spark)).collect()] == ["a.rs"]
    assert sorted(r.relative_path for r in lexical_store.documents(spark, root).collect()) == ["a.rs", "empty.rs"]


CHANGES = f"{DOCS}, at long"


def test_a_stream_keeps_the_index_up_through_repeats_and_a_restart(spark, tmp_path):
    source, root, checkpoint = (str(tmp_path / x) for x in ("in", "index", "checkpoint"))
    batches = [
        [(*document(k, 1), 1) for k in range(20)] + [(*document(3, 2), 0)],  # an older change of the same document, too
        [(*document(k, 4), 5) for k in range(4)] + [("s", document(7, 1)[1], None, None, 6), (*document(8, 1), 7)],
        [(*document(7, 9), 8), (*document(30, 1), 8), ("s", "never/there.rs", None, None, 9)],
    ]
    expected = {r[1]: r for r in (document(k, 1) for k in range(20))}
    expected |= {r[1]: r for r in (document(k, 4) for k in range(4))} | {r[1]: r for r in (document(7, 9), document(30, 1))}

    def run(batch):
        spark.createDataFrame(batch, CHANGES).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(CHANGES).option("maxFilesPerTrigger", 1).parquet(source)
        query = incremental.index_stream(stream, root, checkpoint).start()  # each batch is a start of its own
        query.processAllAvailable()
        query.stop()

    for batch in batches:
        run(batch)
    assert hits(lexical_store.search_stored(spark, root, asked(spark))) == rebuilt(spark, list(expected.values()))
    held = sorted(map(tuple, lexical_store.documents(spark, root).collect()))
    # the last batch once more, as after a failure between its write and its commit
    lexical_store.apply_changes(spark.createDataFrame([r[:4] for r in batches[-1]], DOCS), root, 3)
    assert sorted(map(tuple, lexical_store.documents(spark, root).collect())) == held
    assert hits(lexical_store.search_stored(spark, root, asked(spark))) == rebuilt(spark, list(expected.values()))


@pytest.mark.parametrize("crash", ["postings", "documents"])
def test_a_version_that_was_not_finished_is_not_seen(spark, tmp_path, crash):
    root = str(tmp_path / "index")
    rows = [document(k, 1) for k in range(8)]
    lexical_store.ensure(spark.createDataFrame(rows, DOCS), root)
    part = f"{root}/postings/segment=2/bucket=1" if crash == "postings" else f"{root}/documents/v2"
    left = spark.createDataFrame([("alpha", "s", "x.rs", 1)], "term string, snapshot_id string, relative_path string, tf long") if crash == "postings" else lexical_store.documents(spark, root).where("false")
    left.write.parquet(part)
    os.remove(f"{part}/_SUCCESS")
    assert hits(lexical_store.search_stored(spark, root, asked(spark))) == rebuilt(spark, rows)
    changed = [document(k, 2) for k in range(8)]
    assert lexical_store.ensure(spark.createDataFrame(changed, DOCS), root) == (2, True)
    assert hits(lexical_store.search_stored(spark, root, asked(spark))) == rebuilt(spark, changed)
