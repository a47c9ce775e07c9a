import numpy as np
import pytest

from factloom.llm import ann

SCHEMA = "vec_id long, embedding array<float>, label int, rep string"


def brute(rows, k, is_query):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float32).astype(float)
    out = {}
    for q, v in good.items():
        if is_query(q):
            near = sorted((float(np.sqrt(((v - x) ** 2).sum())), i) for i, x in good.items() if i != q and len(x) == len(v))
            out[q] = near[:k]
    return out


def searched(spark, rows, k=10, every=5, **more):
    df = spark.createDataFrame([(i, v, 0, "x") for i, v in rows], SCHEMA)
    out = {}
    for r in ann.nearest(df, f"vec_id % {every} = 0", k, **more).orderBy("query_id", "rank").collect():
        assert r.rank == len(out.setdefault(r.query_id, [])) + 1
        out[r.query_id].append((r.score, r.vec_id))
    return out


def test_recall_and_exact_scores(spark):
    draw = np.random.default_rng(2)
    centers = draw.normal(size=(30, 32))
    x = (centers[draw.integers(0, 30, 3000)] + 0.7 * draw.normal(size=(3000, 32))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    expected, got = brute(rows, 10, lambda i: i % 60 == 0), searched(spark, rows, every=60)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in near}) for q, near in expected.items())
    assert hits >= 0.9 * sum(map(len, expected.values()))
    for q, near in got.items():
        assert len(near) == 10 and near == sorted(near)
        assert all(s == pytest.approx(np.sqrt(((x[q].astype(float) - x[i].astype(float)) ** 2).sum()), abs=1e-12) for s, i in near)


def test_recall_on_vectors_spread_evenly(spark):
    """As hard as the test tables: no clusters, neighbours hardly nearer than others."""
    draw = np.random.default_rng(6)
    x = draw.normal(size=(4000, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    expected, got = brute(rows, 10, lambda i: i % 50 == 0), searched(spark, rows, every=50)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in near}) for q, near in expected.items())
    assert hits >= 0.9 * sum(map(len, expected.values()))


def test_a_missed_target_means_a_scan(spark):
    draw = np.random.default_rng(7)
    rows = [(i, draw.normal(size=16).astype(np.float32).tolist()) for i in range(400)]
    got, expected = searched(spark, rows, every=20, target=1.1, part_bytes=8192), brute(rows, 10, lambda i: i % 20 == 0)
    assert {q: [i for _, i in n] for q, n in got.items()} == {q: [i for _, i in n] for q, n in expected.items()}


def test_perturbations_come_in_the_order_of_their_distances():
    hasher = ann.Hasher(1.0, 40, 2, 6)
    x = np.random.default_rng(1).normal(size=(3, 8))
    at, keys = hasher.cells(x), hasher.visits(x)
    assert (keys[:, :, 0] == hasher.index(x)).all()
    for t in range(2):
        for row in range(3):
            assert len(set(keys[t, row].tolist())) == 40
            inside = at[t, row] - np.floor(at[t, row])
            near = np.floor(at[t, row])
            h = int(np.minimum(inside, 1 - inside).argmin())
            near[h] += -1 if inside[h] < 0.5 else 1
            assert keys[t, row, 1] == hasher.keys(near[None], np.array([t]), 8)[0]


def test_edge_cases_are_exact(spark):
    rows = [(i, [float(i), 1.0]) for i in range(8)] + [(20, [3.0, 1.0]), (21, None), (22, [0.0, 0.0]), (23, [None, 1.0]), (24, [float("nan"), 1.0]), (25, [float("inf"), 1.0]), (30, []), (None, [1.0, 1.0]), (40, [1.0, 2.0, 3.0]), (5, [5.0, 1.0])]
    got, expected = searched(spark, rows, k=3), {q: n for q, n in brute(rows, 3, lambda i: i % 5 == 0).items() if n}
    assert got == expected


def test_a_hot_vector_and_split_buckets(spark):
    draw = np.random.default_rng(4)
    same = [0.5] * 8
    rows = [(i, same if i % 3 else draw.normal(size=8).astype(np.float32).tolist()) for i in range(600)]
    got = searched(spark, rows, every=50, part_bytes=4096)
    expected = brute(rows, 10, lambda i: i % 50 == 0)
    for q, near in expected.items():
        if q % 3:
            assert got[q] == near
    hits = sum(len({i for _, i in got[q]} & {i for _, i in near}) for q, near in expected.items())
    assert hits >= 0.9 * sum(map(len, expected.values()))


def test_few_vectors_with_many_copies_give_as_many_rows_as_there_are(spark):
    rows = [(i, [float(i % 3 + 1), 1.0]) for i in range(24)]
    assert searched(spark, rows, every=4) == brute(rows, 10, lambda i: i % 4 == 0)


def test_empty(spark):
    assert searched(spark, []) == {}
