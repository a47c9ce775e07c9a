"""Decision documents by content: the candidates' order, the scan and its early stop, and the best of all, against plain loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from factloom.operators import decisions

DOCS = "relative_path string, language string, extension string, size_bytes long, text string"
ASKED = "request_id string, scope string, anchors array<string>, suggested array<string>"
HITS = "request_id string, relative_path string, place int"
MARKERS = ("decision", "rationale", "tradeoff", "why", "intent", "status:")


def terms_of(text):
    return {t.lower() for t in re.split("[^0-9A-Za-z]", text) if len(t) >= 3}


def sets_of(r):
    return terms_of(r[1]), {t for p in r[2] for t in terms_of(p)}, {t for p in r[3] for t in terms_of(p)}


def priority(path):
    p = path.lower()
    return 40 * ("adr" in p) + 25 * ("decision" in p) + 10 * ("intent" in p or "spec" in p) + 6 * p.startswith("docs/") + 5 * p.startswith("plans/") + 4 * p.startswith("research/")


def held(text, sets):
    return [sum(t in text.lower() for t in s) for s in sets]


def ordered(r, docs, hits, most):
    sets = sets_of(r)
    out = [p for _, p, k in sorted((h for h in hits if h[0] == r[0]), key=lambda h: h[2]) if k <= 64] + sorted(r[2]) + r[3]
    seed = lambda p: priority(p) + sum(a * b for a, b in zip(held(p, sets), (8, 5, 3), strict=True))
    rest = [d[0] for d in docs if d[3] <= 262144 and (priority(d[0]) >= 10 or any(held(d[0], sets)))]
    out += sorted(rest, key=lambda p: (-seed(p), p))
    return list(dict.fromkeys(out))[:most]


def score(d, sets):
    return priority(d[0]) + sum(a * b for a, b in zip(held(d[4], sets), (25, 10, 6), strict=True))


def scanned(r, docs, hits, limit):
    by, found, misses, sets, looked = {d[0]: d for d in docs}, [], 0, sets_of(r), 0
    for p in ordered(r, docs, hits, 24 * limit):
        d = by.get(p)
        looked += d is not None
        if d is None or d[3] > 262144 or not any(m in d[4].lower() for m in MARKERS):
            misses += 1
            if len(found) >= limit and misses >= 6:
                break
            continue
        found.append((-score(d, sets), p))
        misses = 0
        if len(found) >= limit + limit // 2:
            break
    return [(p, -s) for s, p in sorted(found)[:limit]]


@pytest.fixture(scope="module")
def made():
    draw = random.Random(3)
    words = ["parser", "scanner", "ledger", "why", "status: done", "tradeoff", "plain", "words", "retrieval", "broker"]
    folders = ["docs/adr-", "docs/", "plans/", "src/docs/", "research/spec-", "notes/", "src/parser/", "decisions/"]
    docs = []
    for k in range(260):
        path = f"{draw.choice(folders)}{draw.choice(['parser', 'scanner', 'other', 'ledger'])}_{k:03}.md"
        text = "\n".join([draw.choice(["# Title of it", "no heading", "#"]), *(" ".join(draw.choice(words) for _ in range(4)) for _ in range(3))])
        docs.append((path, "markdown", "md", 300_000 if k % 41 == 0 else len(text), text))
    asked = [("q1", "ParserLedger", [docs[5][0], docs[9][0]], [docs[7][0], docs[5][0], "not/there.rs"]), ("q2", "scanner why", [], []), ("q3", "", [], []), ("q4", "broker retrieval", [docs[0][0]], [docs[1][0]])]
    hits = [("q1", docs[k][0], n) for n, k in enumerate((100, 40, 41, 5), 1)] + [("q2", docs[3][0], 1), ("q2", docs[2][0], 65)]
    # camel case: the parts of ParserLedger are terms, too
    return docs, asked, hits


def plain(r):
    return ("q1", "ParserLedger parser ledger", r[2], r[3]) if r[0] == "q1" else r


@pytest.mark.parametrize("limit", [1, 4])
def test_the_order_of_candidates_and_the_scan(spark, made, limit):
    docs, asked, hits = made
    d, a, h = spark.createDataFrame(docs, DOCS), spark.createDataFrame(asked, ASKED), spark.createDataFrame(hits, HITS)
    paths = {}
    for r in decisions.candidate_paths(a, d, h, decisions.term_sets(a), 24 * limit).orderBy("request_id", "place").collect():
        paths.setdefault(r.request_id, []).append(r.relative_path)
    assert paths == {r[0]: ordered(plain(r), docs, hits, 24 * limit) for r in asked}
    got = {}
    rows = decisions.scanned_decisions(a, d, h, limit).orderBy("request_id", "place").collect()
    for r in rows:
        got.setdefault(r.request_id, []).append((r.relative_path, r.score))
        assert re.fullmatch(rf"(# Title of it|{re.escape(r.relative_path)}) \[{re.escape(r.relative_path)}\]: .*({'|'.join(MARKERS)}).*", r.rendered)
    assert got == {r[0]: scanned(plain(r), docs, hits, limit) for r in asked}
    whole = sum(x[3] <= 262144 for x in docs)
    assert all(r.texts_read < whole for r in rows)


def test_the_best_of_all_without_reading_all(spark, made):
    docs, asked, _ = made
    few = [("q2", "scanner", [], []), ("q3", "", [], []), ("q5", "nowhere", [], [])]
    for requests, fewer in ((few, True), (asked, False)):
        a = spark.createDataFrame(requests, ASKED)
        got = {}
        for r in decisions.best_by_content(a, spark.createDataFrame(docs, DOCS), 3).orderBy("request_id", "place").collect():
            got.setdefault(r.request_id, []).append((r.relative_path, r.score))
            assert not fewer or r.texts_read < sum(x[3] <= 262144 for x in docs) / 2
        marked = [x for x in docs if x[3] <= 262144 and any(m in x[4].lower() for m in MARKERS)]
        assert got == {r[0]: [(x[0], score(x, sets_of(plain(r)))) for x in sorted(marked, key=lambda x: (-score(x, sets_of(plain(r))), x[0]))[:3]] for r in requests}


def test_what_has_candidates_by_path_needs_no_content(spark, made):
    docs, asked, hits = made
    d, h = spark.createDataFrame(docs, DOCS), spark.createDataFrame(hits, HITS)
    a = spark.createDataFrame([asked[0]], ASKED)
    got = [(r.relative_path, r.score) for r in decisions.relevant_decisions(a, d, h).orderBy("place").collect()]
    fast = decisions.fast_candidates(a.select("request_id", F.explode("anchors").alias("relative_path")), a.select("request_id", F.explode("suggested").alias("relative_path")), d)
    assert got == [(r.relative_path, r.score) for r in fast.orderBy("place").collect()] and len(got) == 4


def test_nothing_to_look_at(spark):
    none, a = spark.createDataFrame([], DOCS), spark.createDataFrame([("q", "x y z", [], [])], ASKED)
    assert decisions.scanned_decisions(a, none, spark.createDataFrame([], HITS)).count() == 0
    assert decisions.best_by_content(a, none).count() == 0
