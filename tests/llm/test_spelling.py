import re
import zlib
from collections import Counter

from factloom.llm import spelling

SCHEMA = "doc_id long, text string, word string, n string"


def near(a, b):
    """Whether one letter put in, left out or replaced makes b of a."""
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:k] + long[k + 1 :] == short for k in range(len(long)))


def brute(rows, slips=199, least=5):
    n = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % slips == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    n = {w: k for w, k in n.items() if len(w) >= 6 and k >= least}
    form, many = {}, {}
    for w in n:
        by = sorted((-n[x], x) for x in n if near(w, x))
        many[w] = len(by)
        if by and -by[0][0] >= 5 * n[w]:
            form[w] = by[0][1]
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], many[w], n[form[w]] if w in form else None))
    return sorted(out)


def found(spark, rows, **more):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    out = spelling.spelling_variants(df, **more)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in out.collect())


def test_it_is_the_same_as_comparing_all_words(spark):
    words = ["banana", "bananas", "anagram", "anagrams", "lettering", "letterings", "straße", "straßen", "ÀÉéçïñü", "abababab", "ababababa", "babababa", "aaaaaaa", "aaaaaaaa"]
    rows = []
    for k in range(60):
        w = words[k % len(words)]
        at = k * 7 % len(w)
        rows += [(k, f"{w} {w.upper()}, {w[:at]}x{w[at:]} {w[:at]}{w[at + 1 :]} {w[:at]}q{w[at + 1 :]}; " * (1 + k % 9))]
    for slips in (199, 3):
        got = found(spark, rows, slips=slips)
        assert got == brute(rows, slips) and sum(r[4] for r in got) > 100


def test_forms_lead_to_the_last(spark):
    counts = {"planet": 2000, "planets": 300, "planetss": 50, "planetsss": 9, "planeta": 9, "planetas": 8, "orange": 30, "orangu": 6, "orangi": 6, "orangs": 30}
    rows = [(k, " ".join([w] * n)) for k, (w, n) in enumerate(counts.items())]
    got = {r[0]: r for r in found(spark, rows, slips=10**9)}
    assert [got["planetsss"][2], got["planetss"][2], got["planets"][2]] == ["planet"] * 3 and got["planetsss"][1] == "planetss"
    assert got["orangu"][1] == got["orangi"][1] == "orange"  # of two equally frequent ones the first
    assert sorted(got.values()) == brute(rows, 10**9)


def test_the_rarest_bigrams_meet_for_every_near_pair():
    words = ["aaaaaa", "aaaaaaa", "abaaaa", "aabaaab", "aabaab", "ababab", "abababa", "bababa", "aaabaaa", "aaabaa"]
    n = Counter(w[i : i + 2] for w in words for i in range(len(w) - 1))
    order = {g: k for k, g in enumerate(sorted(n, key=lambda g: (n[g], g)))}
    for a in words:
        for b in words:
            if near(a, b):
                assert any(x == y and abs(i - j) <= 1 for x, i in spelling.rarest(a, order) for y, j in spelling.rarest(b, order))
                assert (spelling.letters(a) ^ spelling.letters(b)).bit_count() <= 2


def test_nulls_repeats_long_texts_and_pieces(spark, monkeypatch):
    rows = [(None, "letters Letters"), (None, "letters"), (1, None), (1, "letters"), (1, "letters"), (2, ""), (3, "12 34"), (4, "short " * 9), (5, "ab" * 30_000)] + [(6, "ab" * 30_000 + "a")] * 5
    assert found(spark, rows) == brute(rows)
    monkeypatch.setattr(spelling, "PIECE", 7)
    text = "one longer12wordstogether andother ÀÀÀÀÀÀÀ x"
    assert [w for some in spelling.runs(text, 6) for w in some] == ["longer", "wordstogether", "andother", "ÀÀÀÀÀÀÀ"]


def test_an_empty_table(spark):
    assert found(spark, []) == []
