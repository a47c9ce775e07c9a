"""The source of trees and the sink of replay artifacts."""

import json
import os
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from factloom.sources import replay, scan, tree
from factloom.sources.schema import ddl


@pytest.fixture
def made(tmp_path):
    """Some thousand files, a third of them in folders that a scan leaves out."""
    root, draw = tmp_path / "tree", random.Random(7)
    files = {}
    for k in range(2500):
        top = draw.choice(["src", "docs", "web/app", "node_modules", "a/target", "deep/er/and/er", ".git/objects"])
        path = f"{top}/d{k % 40}/f{k}{draw.choice(['.rs', '.py', '', '.PNG', '.tar', '.md'])}"
        files[path] = b"" if k % 9 == 0 else f"text of {k}".encode()
    files |= {"README.md": b"x", ".env.local": b"s", "empty.rs": b"", "big.txt": b"y" * (tree.MAX_BYTES + 1), "edge.txt": b"z" * tree.MAX_BYTES, ".hidden": b"h", "é/ü.rs": b"u"}
    for path, content in files.items():
        os.makedirs(os.path.dirname(root / path), exist_ok=True)
        (root / path).write_bytes(content)
    os.symlink(root / "README.md", root / "link.md")
    os.symlink(root / "src", root / "linked")
    kept = {p: c for p, c in files.items() if not set(p.split("/")[:-1]) & set(tree.EXCLUDED_FOLDERS) and tree.takes(p.split("/")[-1], len(c))}
    return str(root), kept


def test_it_reads_what_a_scan_takes(spark, made):
    root, kept = made
    for parts in (1, 64):
        got = {r.relative_path: bytes(r.content) for r in tree.read(spark, root, parts=parts).collect()}
        assert got == kept
    assert tree.read(spark, f"file://{root}").where("size_bytes = 0").count() == sum(not c for c in kept.values()) > 100
    assert tree.read(spark, root, ("docs",)).count() == sum("docs" not in p.split("/")[:-1] for p in kept)
    found = scan.scan(spark, root, "s")["files"]
    assert {r.relative_path for r in found.collect()} == set(kept)


def test_excluded_folders_are_never_opened(made, monkeypatch):
    root, kept = made
    opened, scandir = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda path: opened.append(os.path.relpath(path, root)) or scandir(path))
    reader = tree.TreeReader({"path": root})
    parts = reader.partitions()
    top = len(opened)
    assert top < 40 and len(parts) == tree.PARTS  # the driver opens the top alone
    rows = sum(b.num_rows for p in parts for b in reader.read(p))
    assert rows == len(kept) and not any(set(p.split("/")) & set(tree.EXCLUDED_FOLDERS) for p in opened) and len(opened) == len(set(opened))


def test_a_prefix_opens_the_folders_on_its_way(spark, made, monkeypatch):
    root, kept = made
    for prefix in ("web/app/d3", "src/", "README", next(p for p in kept if p.startswith("src/")), "no/such"):
        assert {r.relative_path for r in tree.read(spark, root, prefix=prefix).collect()} == {p for p in kept if p.startswith(prefix)}
    opened, scandir = [], os.scandir
    monkeypatch.setattr(os, "scandir", lambda path: opened.append(os.path.relpath(path, root)) or scandir(path))
    reader = tree.TreeReader({"path": root, "prefix": "web/app/d3"})
    found = [r for p in reader.partitions() for b in reader.read(p) for r in b.column(0).to_pylist()]
    assert set(found) == {p for p in kept if p.startswith("web/app/d3")}
    assert all(p == "." or p in ("web", "web/app") or p.startswith("web/app/d3") for p in opened)


def test_two_filters_of_one_frame_do_not_meet(spark, made):
    root, kept = made
    all_ = tree.read(spark, root)
    a, b = (all_.where(F.startswith("relative_path", F.lit(x))) for x in ("src/", "docs/"))
    assert a.union(b).count() == sum(p.startswith(("src/", "docs/")) for p in kept) and all_.count() == len(kept)


def test_the_rule_is_the_scans(spark):
    draw = random.Random(1)
    rows = [("/".join(draw.choice(["src", "out", ".git", "a.b", "x", ".env"]) for _ in range(draw.randrange(3))) + "/" + draw.choice(["a.rs", "b.PNG", ".env", ".env.x", "noext", ".gif", "c.tar.gz", "d."]), draw.choice([0, 5, tree.MAX_BYTES, tree.MAX_BYTES + 1])) for _ in range(300)]
    rows = [(p.lstrip("/"), n) for p, n in rows]
    got = spark.createDataFrame(rows, "p string, n long").select("p", "n", scan.included("p", "n").alias("ok")).collect()
    assert all(r.ok == (not set(r.p.split("/")[:-1]) & set(tree.EXCLUDED_FOLDERS) and tree.takes(r.p.split("/")[-1], r.n)) for r in got)


def test_a_store_that_is_not_mounted_and_an_empty_tree(spark, tmp_path):
    with pytest.raises(ValueError, match="mounted"):
        tree.local_path("viewfs://store/in")
    assert tree.read(spark, str(tmp_path)).count() == 0


def obligations(spark, n):
    return spark.createDataFrame([(f"o{k}", f"pair:{k}", "c", ["a", 'é"\n'], f"h{k}") for k in range(n)], ddl("obligations")).repartition(3)


def certificates(spark, n):
    return spark.createDataFrame([(f"o{k}", f"h{k}", "proved", None, None, [], None) for k in range(n)], ddl("certificates")).repartition(2)


def write(spark, root, n, nonce="1", o=None):
    return replay.write_replay(obligations(spark, n) if o is None else o, certificates(spark, n), root, "r", "t", "c", {"timeout_ms": 5}, nonce)


def test_an_artifact_is_read_back_as_it_was_written(spark, tmp_path):
    root = str(tmp_path / "runs")
    for n, nonce in ((40, "1"), (0, "2")):
        run = write(spark, root, n, nonce)
        o, c = replay.read_replay(spark, root, run)
        assert sorted(o.collect()) == sorted(obligations(spark, n).collect()) and c.count() == n
        head = replay.header(f"{root}/{run}")
        assert (head["snapshot_id"], head["reference_snapshot_id"], head["contract_id"], head["policy"]) == ("t", "r", "c", {"timeout_ms": 5})
        assert len(run) == 16 and sum(rows for _, rows in head["parts"]) == 2 * n
    assert len([f for f in os.listdir(root) if not f.startswith("_")]) == 2


def test_a_failed_task_leaves_nothing_that_is_seen(spark, tmp_path):
    root = str(tmp_path / "runs")
    broken = obligations(spark, 30).withColumn("source_pair", F.when(F.col("id") == "o17", F.raise_error(F.lit("a task fails")).cast("string")).otherwise(F.col("source_pair")))
    with pytest.raises(PySparkException, match="a task fails"):
        write(spark, root, 30, o=broken)
    assert not os.path.exists(root) or not [f for f in os.listdir(root) if not f.startswith("_")]
    assert replay.read_replay(spark, root, write(spark, root, 30))[0].count() == 30  # the same run, once it works


def test_an_artifact_is_never_overwritten(spark, tmp_path):
    root = str(tmp_path / "runs")
    run = write(spark, root, 5)
    before = sorted(os.listdir(f"{root}/{run}"))
    with pytest.raises(PySparkException, match="there already"):
        write(spark, root, 6)
    assert sorted(os.listdir(f"{root}/{run}")) == before and os.listdir(root) == [run]


def test_a_part_that_lost_rows_is_an_error(spark, tmp_path):
    root = str(tmp_path / "runs")
    run = write(spark, root, 20)
    name, rows = next(x for x in json.load(open(f"{root}/{run}/artifact.json"))["parts"] if x[1] > 1)
    path = f"{root}/{run}/{name}"
    lines = open(path, encoding="utf-8").readlines()
    open(path, "w", encoding="utf-8").writelines(lines[:-1])
    with pytest.raises(PySparkException, match=f"instead of {rows}"):
        replay.read_replay(spark, root, run)[0].count()


def test_commands():
    assert replay.replay_command("a\\b") == 'replay --artifact "a\\\\b"' and replay.replay_command("x", "thm_1").endswith("--obligation-id thm_1")
