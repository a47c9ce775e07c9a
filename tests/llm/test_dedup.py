import random

import numpy as np
import pytest

from factloom.llm import line_dedup, near_dup
from factloom.llm.common import hash_ranges

SCHEMA = "doc_id long, text string, component_id string, n_lines string"
SPACE = " \t\n\x0b\x0c\r"


def words_of(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).translate(str.maketrans({c: " " for c in SPACE})).split(" ")


def shingles(text):
    w = [x for x in words_of(text) if x]
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """n_shingles and component of every row, for distinct ids."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both, either = len(sets[a] & sets[b]), len(sets[a] | sets[b])
            if both and 100 * both >= 85 * either:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def corpus(n, seed):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdeé") for _ in range(draw.randrange(2, 6)))
    base = [[word() for _ in range(draw.choice([3, 5, 20, 60, 200]))] for _ in range(n // 6)]
    passage = [word() for _ in range(60)]
    rows = []
    for i in range(n):
        w = list(draw.choice(base))
        for _ in range(draw.choice([0, 0, 1, 2, 6])):
            w[draw.randrange(len(w))] = word()
        if draw.random() < 0.3:
            w += passage
        text = " ".join(w)
        rows.append((i, text.upper() if draw.random() < 0.2 else text.replace(" ", "\n\t", 1)))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "É é É é"), (n + 4, "one two"), (n + 5, "ONE  two"), (n + 6, "long " * 30_000)]


@pytest.mark.parametrize("part_bytes", [near_dup.PART_BYTES, 2000])
def test_near_copies_are_those_of_all_pairs(spark, part_bytes):
    rows = corpus(240, 3)
    expected = brute(rows)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA).repartition(5)
    got = near_dup.near_duplicates(df, part_bytes=part_bytes).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == expected and len(got) == len(rows)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_a_group_around_one_text(spark):
    """Copies that are near to one text, but not all to each other, are one component."""
    draw = random.Random(9)
    center = [f"w{k}" for k in range(120)]
    rows = [(500, " ".join(center))]
    for i in range(120):
        w = list(center)
        for _ in range(2):
            w[draw.randrange(120)] = f"x{i}_{draw.random()}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(spark.createDataFrame([(i, t, "", "") for i, t in rows], SCHEMA)).collect()}
    assert got == brute(rows)


def long_pair(seed, words=1200, changed=96):
    """Two texts of 1,196 shingles each with a similarity of 0.8514."""
    a = [f"w{seed}x{k}" for k in range(words)]
    return " ".join(a), " ".join(a[: words - changed] + [f"y{seed}x{k}" for k in range(changed)])


def test_long_texts_near_the_threshold(spark):
    """Linked pairs near the threshold."""
    rows = [(10 * seed + k, t) for seed in (571, 1236, 1558, 1804, 1830) for k, t in enumerate(long_pair(seed))]
    got = near_dup.near_duplicates(spark.createDataFrame([(i, t, "", "") for i, t in rows], SCHEMA)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows) and sum(r.kept for r in got) == 5


def templated(n, words, changed, seed):
    """Texts that fill the same form, each with words of its own at places of its own."""
    draw = random.Random(seed)
    form = [f"f{k}" for k in range(words)]
    return [" ".join(f"x{i}y{k}" if k in places else w for k, w in enumerate(form)) for i in range(n) for places in [set(draw.sample(range(words), changed))]]


@pytest.mark.parametrize("part_bytes", [near_dup.PART_BYTES, 200_000, 20_000])
def test_a_templated_group_without_and_with_links(spark, part_bytes):
    """Most pairs meet in a bucket; parts of a bucket find what the whole finds."""
    for changed in (9, 11, 14):
        rows = [(3 * i % 301, t) for i, t in enumerate(templated(90, 600, changed, changed))]
        df = spark.createDataFrame([(i, t, "", "") for i, t in rows], SCHEMA).repartition(6)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df, part_bytes=part_bytes).collect()} == brute(rows)


def test_counts_by_matrices_are_those_of_sets():
    draw = np.random.default_rng(3)
    left, right = ([np.unique(draw.integers(0, 9000, n).astype(np.uint64)) for n in sizes] for sizes in ((0, 5, 300, 7000), (1, 9000, 40)))
    assert near_dup.common_counts(left, right).tolist() == [[len(np.intersect1d(x, y)) for y in right] for x in left]


def test_a_bucket_emits_fewer_links_than_members():
    sets = [np.arange(k, k + 400, dtype=np.uint64) for k in range(300)]
    members = np.arange(300), np.array([400] * 300), sets
    forest = near_dup.Forest()
    tiles = list(near_dup._tiles(members))
    links = [x for k, a in enumerate(tiles) for b in tiles[k:] for x in near_dup.new_links(a, b, 85, forest)]
    assert len(links) == 299 and len({forest.root(k) for k in range(300)}) == 1


def test_the_same_groups_however_rows_are_dealt(spark):
    """Repeated ids with several texts, in any number of partitions."""
    a, b = templated(2, 300, 0, 1)[0], " ".join(f"b{k}" for k in range(300))
    rows = [(1, a), (7, b), (7, changed(a, {3})), (7, "some words that stand alone here"), (2, changed(b, {9})), (3, changed(b, {90}))]
    for parts in (1, 2, 3, 4):
        got = near_dup.near_duplicates(spark.createDataFrame([(i, t, "", "") for i, t in rows], SCHEMA).repartition(parts)).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted([(1, 296, 1, True), (7, 296, 2, False), (7, 296, 1, False), (7, 2, 7, True), (2, 296, 2, True), (3, 296, 2, False)])


def thue_morse(n):
    out = "a"
    while len(out) < n:
        out += out.translate(str.maketrans("ab", "ba"))
    return out


def test_texts_that_cancel_out_in_sums_of_powers(spark):
    """A Thue-Morse word and its complement are different words, shingles and lines."""
    word = thue_morse(2048)
    other = word.translate(str.maketrans("ab", "ba"))
    tail = " one two three four"
    rows = [(1, word + tail), (2, other + tail), (3, word), (4, other)]
    got = near_dup.near_duplicates(spark.createDataFrame([(i, t, "", "") for i, t in rows], SCHEMA)).collect()
    assert all(r.component_id == r.doc_id for r in got)


def test_hashes_depend_on_the_bytes_alone():
    draw = np.random.default_rng(5)
    data = draw.integers(97, 99, 3000).astype(np.uint8)
    start = draw.integers(0, 2900, 5000)
    end = np.minimum(start + np.where(draw.random(5000) < 0.5, draw.integers(0, 12, 5000), draw.integers(0, 2500, 5000)), 3000)
    seen = {}
    for a, b, h in zip(start, end, hash_ranges(data, start, end).tolist(), strict=True):
        seen.setdefault(data[a:b].tobytes(), set()).add(h)
    assert all(len(h) == 1 for h in seen.values()) and len({min(h) for h in seen.values()}) == len(seen)


def test_nulls_repeats_and_empty_tables(spark):
    same = "a b c d e f g"
    rows = [(None, same), (7, same), (7, same), (None, None), (3, "other words that are not the same at all"), (None, "alone here with five words")]
    got = near_dup.near_duplicates(spark.createDataFrame([(i, t, "", "") for i, t in rows], SCHEMA)).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in got) == sorted([(-1, 3, 7, False), (7, 3, 7, True), (7, 3, 7, True), (-1, 0, -1, True), (3, 5, 3, True), (-1, 1, -1, True)])
    assert near_dup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def changed(text, places):
    w = text.split()
    return " ".join(f"new{k}" if k in places else x for k, x in enumerate(w))


def test_texts_without_an_id_and_texts_of_one_id_are_searched_each(spark):
    a, b, c, d = (" ".join(f"{x}{k}" for k in range(200)) for x in "abcd")
    rows = [(7, a), (None, changed(a, {3})), (None, b), (None, changed(b, {100})), (None, "nothing like the other texts of this table"), (9, c), (9, d), (4, changed(d, {50})), (12, changed(c, {60})), (9, changed(c, {61}))]
    for order in (rows, rows[::-1]):
        got = near_dup.near_duplicates(spark.createDataFrame([(i, t, "", "") for i, t in order], SCHEMA).repartition(3)).collect()
        shown = sorted((r.doc_id or -1, r.component_id or -1, r.n_shingles > 100) for r in got)
        assert shown == sorted([(7, 7, True), (-1, 7, True), (-1, -1, True), (-1, -1, True), (-1, -1, False), (9, 9, True), (9, 4, True), (4, 4, True), (12, 9, True), (9, 9, True)])
        # kept are all rows with the smallest id of their component, and one text of each that has none
        assert sorted((r.doc_id or -1, r.component_id or -1) for r in got if r.kept) == [(-1, -1), (-1, -1), (4, 4), (7, 7), (9, 9), (9, 9)]
        held = near_dup.drop_near_duplicates(spark.createDataFrame(order, "doc_id long, text string"))
        assert sorted(r.doc_id or -1 for r in held.collect()) == [-1, -1, 4, 7, 9]


def test_kept_is_the_smallest_id_also_for_the_largest_of_all_and_repeated_ones(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(200)) for x in "ab")
    last = 2**63 - 1
    rows = [(5, a), (5, changed(a, {3})), (last, b), (None, changed(b, {7})), (None, "words of its own in this one"), (-(2**63), "the smallest id of all stands here")]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.component_id, r.kept) for r in got), key=repr) == sorted([(5, 5, True), (5, 5, True), (last, last, True), (None, last, False), (None, None, True), (-(2**63), -(2**63), True)], key=repr)


def test_components_are_those_of_union_find(spark):
    draw = random.Random(4)
    links = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1040)]
    df = spark.createDataFrame([(min(a, b), max(a, b)) for a, b in links if a != b], "a long, b long").repartition(6)
    forest = near_dup.Forest()
    for a, b in links:
        forest.join(a, b)
    got = {r.did: r.comp for r in near_dup.components(df).collect()}
    assert got == {x: forest.root(x) for a, b in links if a != b for x in (a, b)} and got[1040] == 1000


def lines_brute(rows, least_docs=5, least_chars=40):
    key = lambda line: line.strip(SPACE).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders.setdefault(key(line), set()).add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) >= least_docs and max(holders[key(x)]) != i)]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("bits", [line_dedup.MOST_BITS, 0])
def test_lines_are_those_of_a_count(spark, bits):
    draw = random.Random(1)
    pool = [("Émile " if k % 3 else "Line ") + "".join(draw.choice("abc XYZ") for _ in range(draw.choice([20, 38, 40, 60]))) for k in range(40)]
    rows = []
    for i in range(120):
        lines = [draw.choice(pool) if draw.random() < 0.6 else f"own line of document {i} number {k} with some length" for k in range(draw.randrange(9))]
        rows.append((i, "\n".join(draw.choice(["", " ", "\t\r"]) + (x.upper() if draw.random() < 0.3 else x) + draw.choice(["", "  "]) for x in lines)))
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, "x" * 200_000), (504, (pool[0] + "\n") * 5_000)]
    df = spark.createDataFrame([(i, t, "keep", "n") for i, t in rows], SCHEMA).repartition(7)
    got = line_dedup.drop_repeated_lines(spark, df, most_bits=bits).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in got} == lines_brute(rows) and all(r.component_id == "keep" for r in got)
    assert sum(r.n_dropped for r in got) > 100


def test_lines_in_many_blocks(spark, monkeypatch):
    """Small blocks and few held hashes: every task sends often, and every hash meets its equals."""
    draw = random.Random(8)
    pool = [f"line {k} " + "x" * 40 for k in range(3000)]
    rows = [(i, "\n".join(draw.sample(pool, 40))) for i in range(400)]
    monkeypatch.setattr(line_dedup, "BLOCK", 1 << 7)
    monkeypatch.setattr(line_dedup, "HELD_HASHES", 500)
    df = spark.createDataFrame([(i, t, "", "") for i, t in rows], SCHEMA).repartition(5)
    got = line_dedup.drop_repeated_lines(spark, df).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in got} == lines_brute(rows) and sum(r.n_dropped for r in got) > 1000


def test_line_dedup_edges(spark):
    line = "the same line of more than forty characters, again and again"
    rows = [(None, line), (1, line), (2, line), (3, line), (3, line), (4, line + "\nrest")]
    got = line_dedup.drop_repeated_lines(spark, spark.createDataFrame([(i, t, "", "") for i, t in rows], SCHEMA)).collect()
    assert sorted((r.doc_id or -1, r.n_dropped, r.text) for r in got) == [(-1, 1, ""), (1, 1, ""), (2, 1, ""), (3, 1, ""), (3, 1, ""), (4, 0, line + "\nrest")]
    assert line_dedup.drop_repeated_lines(spark, spark.createDataFrame([], SCHEMA)).count() == 0
