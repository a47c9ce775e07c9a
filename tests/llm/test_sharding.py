import hashlib
import zlib

import pytest

from factloom.llm import sharding

SCHEMA = "doc_id long, text string, size string, shard string, key string, row string"


def plain(rows, shards, parts):
    """The same law as a loop over all rows in order."""
    made = []
    for i, text in rows:
        raw = (text or "").encode()
        made.append((len(raw) + 8, int(hashlib.md5(raw).hexdigest()[:15], 16), i is not None, i or 0, zlib.crc32(raw)))
    most_bytes, most_rows = sum(m[0] for m in made) // (shards * parts), len(made) // (shards * parts)
    out, loads, counts = [], [0] * shards, [0] * shards
    put = lambda m, at: out.append((m[3] if m[2] else None, m[0], m[4], at, counts[at]))
    for m in sorted((m for m in made if m[0] > most_bytes), key=lambda m: (-m[0], *m[1:])):
        at = loads.index(min(loads))
        put(m, at)
        loads[at] += m[0]
        counts[at] += 1
    rest = sorted((m for m in made if m[0] <= most_bytes), key=lambda m: m[1:])
    level, more = max(loads), sum(m[0] for m in rest)
    level = next(x for x in range(min(loads), level + more + 1) if sum(max(0, x - load) for load in loads) >= more) if rest else 0
    ends = [sum(max(0, level - load) for load in loads[: k + 1]) for k in range(shards - 1)]
    begin = 0
    for key in dict.fromkeys(m[1] for m in rest):
        unit = [m for m in rest if m[1] == key]
        whole = sum(m[0] for m in unit)
        apart = whole > most_bytes or len(unit) > most_rows
        upto = begin
        for m in unit:
            middle = 2 * upto + m[0] if apart else 2 * begin + whole
            at = sum(2 * e <= middle for e in ends)
            put(m, at)
            counts[at] += 1
            upto += m[0]
        begin += whole
    return sorted(out, key=repr)


def sharded(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in rows], SCHEMA)
    out = sharding.shard(df, **more)
    assert out.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    found = out.collect()
    assert all(r.law == "bytes" and r.grown_shard is None for r in found)
    return sorted(((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in found), key=repr)


def test_a_hot_text_ranges_in_pieces_and_long_rows(spark):
    rows = [(k, f"text {k} " * (1 + k % 7)) for k in range(400)]
    rows += [(1000 + k, "one text for a third of all rows") for k in range(300)]
    rows += [(None, "one text for a third of all rows")] * 60 + [(5, "one text for a third of all rows")] * 60
    rows += [(2000 + k, f"pair {k // 2}") for k in range(80)]
    rows += [(3000, "long " * 900), (3001, "long " * 700), (3002, "é" * 2000)]
    expected = plain(rows, 6, 8)
    assert sharded(spark, rows, shards=6, parts=8) == expected
    # few rows a range: nearly every range is overfull and subdivided
    assert sharded(spark, rows, shards=6, parts=8, ranges=4, range_rows=30) == expected
    sizes = [sum(e[1] for e in expected if e[3] == k) for k in range(6)]
    assert max(sizes) - min(sizes) <= sum(sizes) / 6 / 8 + 1
    slots = [sorted(e[4] for e in expected if e[3] == k) for k in range(6)]
    assert all(s == list(range(len(s))) for s in slots)


def test_equal_texts_stay_together_unless_large(spark):
    rows = [(k, f"group {k // 4} of four equal texts") for k in range(1200)]
    home = {}
    for (i, *_), (_, _, _, at, _) in zip(sorted(rows), sorted(sharded(spark, rows, shards=4, parts=8), key=lambda r: r[0]), strict=True):
        home.setdefault(i // 4, set()).add(at)
    assert all(len(x) == 1 for x in home.values())


def test_nulls_empty_texts_ties_and_few_rows(spark):
    rows = [(None, None), (None, None), (1, ""), (1, ""), (2, None), (3, "é"), (3, "a"), (-(2**63), "b"), (2**63 - 1, "c")]
    assert sharded(spark, rows) == plain(rows, 24, 32)
    assert sharded(spark, [(7, "x" * 200_000)]) == [(7, 200_008, zlib.crc32(b"x" * 200_000), 0, 0)]


def test_an_empty_table(spark):
    assert sharded(spark, []) == []


@pytest.mark.parametrize(("loads", "more"), [([0, 0, 0], 10), ([5, 0, 9], 3), ([4, 4], 0), ([0, 100], 7)])
def test_shards_are_filled_to_one_level(loads, more):
    ends = [0, *sharding.filled(loads, more), more]
    final = [load + max(0, min(b, more) - min(a, more)) for load, a, b in zip(loads, ends[:-1], ends[1:], strict=True)]
    assert sum(final) == sum(loads) + more
    low = [x for x, load in zip(final, loads, strict=True) if x > load]
    assert not low or max(low) - min(low) <= len(loads)


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(k, f"t{k}") for k in range(50)], "doc_id long, text string")
    plan = sharding.shard(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
