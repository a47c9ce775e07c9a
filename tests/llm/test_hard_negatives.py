import math

import numpy as np
import pytest
from pyspark.errors import PySparkException

from factloom.llm import hard_negatives as hn

SCHEMA = "vec_id long, embedding array<double>, label int, class string, group string"


def brute(rows, every, positives=5, negatives=10, low=30, high=90):
    good = {(i, y, tuple(math.floor(256 * x) for x in v)) for i, v, y in rows if None not in (i, v, y) and len(v) and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a in good:
        if a[0] % every:
            continue
        score = lambda b: sum(x * y for x, y in zip(a[2], b[2], strict=True))  # noqa: B023, E731
        others = sorted(((-score(b), b[0], b) for b in good if b != a and len(b[2]) == len(a[2])), key=lambda x: x[:2])
        for minus, p, _ in [x for x in others if x[2][1] == a[1]][:positives]:
            fits = [(s, i) for s, i, b in others if b[1] != a[1] and low * -minus <= 100 * -s <= high * -minus]
            out += [(a[0], p, k, i, -minus, -s) for k, (s, i) in enumerate(fits[:negatives], 1)]
    return sorted(out)


def mined(spark, rows, every, **more):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    out = hn.hard_negatives(df, f"vec_id % {every} = 0", **more)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in out.collect())


def clustered(n, dim, seed):
    draw = np.random.default_rng(seed)
    centers = draw.normal(size=(12, dim))
    of = draw.integers(0, 12, n)
    x = centers[of] + 0.4 * draw.normal(size=(n, dim))
    return [(k, (v / np.linalg.norm(v)).tolist(), int(c) % 5 if k % 6 else (int(c) + 1) % 5) for k, (v, c) in enumerate(zip(x, of, strict=True))]


def test_it_is_the_same_as_comparing_all(spark):
    rows = clustered(900, 24, 1)
    assert mined(spark, rows, 20) == brute(rows, 20)


def test_many_groups_and_pieces(spark, monkeypatch):
    monkeypatch.setattr(hn, "GROUP", 4)
    monkeypatch.setattr(hn, "BATCH", 64)
    monkeypatch.setattr(hn, "TILE", 8)
    rows = clustered(1200, 16, 2)
    assert mined(spark, rows, 15, piece_bytes=8192) == brute(rows, 15)


def test_bounds_leave_out_what_no_anchor_of_a_group_can_use():
    draw = np.random.default_rng(3)
    anchors, x = (draw.integers(-200, 200, (n, 8)) for n in (40, 500))
    longest = float(max((anchors**2).sum(axis=1).max(), (x**2).sum(axis=1).max()))
    cells = hn.Cells(x[:6], longest)
    scores = hn.products(anchors, x)
    least = np.sort(scores, axis=1)[:, -5]
    reach, near, far = hn.reach(anchors, least, longest), cells.distances(anchors, True), cells.distances(x, False)
    for a in range(len(anchors)):
        gap = np.abs(near[a] - far).max(axis=1)
        assert (gap[scores[a] >= least[a]] <= reach[a] * (1 + 1e-9) + 1e-3).all()


def test_nulls_ties_copies_and_lengths(spark):
    v = [0.5, 0.25, -0.125]
    rows = [(k, v, 1) for k in range(40)] + [(k, v, 1) for k in range(5)]  # one hot vector, some rows twice
    rows += [(100 + k, [0.3, 0.1, 0.0], 2) for k in range(30)] + [(100, [0.3, 0.1, 0.001], 2), (100, v, 3)]  # an id with other vectors
    rows += [(None, v, 1), (200, None, 1), (210, [], 1), (220, [0.1, None, 0.2], 1), (230, [float("nan"), 0.0, 0.0], 1), (240, [float("inf"), 0.0, 0.0], 1), (250, v, None)]
    rows += [(300 + k, [0.5, 0.5], k % 2) for k in range(12)] + [(400, [0.0, 0.0, 0.0], 1), (410, [-0.5, -0.25, 0.1], 7)]
    assert mined(spark, rows, 10) == brute(rows, 10)


def test_empty_and_alone(spark):
    assert mined(spark, [], 10) == []
    assert mined(spark, [(10, [1.0], 1)], 10) == []


def test_scores_beyond_a_long_raise(spark):
    with pytest.raises(PySparkException, match="too long"):
        mined(spark, [(10, [1e7], 1), (11, [1e300], 1)], 10)


def test_large_whole_numbers_are_exact():
    a = np.array([[2**26 + 1, 3]], np.int64)
    assert hn.products(a, a)[0, 0] == (2**26 + 1) ** 2 + 9
