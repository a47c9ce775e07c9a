"""What must not grow with the tables: rows that meet at requests, shuffled postings, single tasks."""

from pyspark.sql import functions as F

from factloom.operators import align, decisions, graph, lexical
from factloom.plans import catalog_briefs, catalog_pairs, catalog_sources
from factloom.sources import store


def _documents(spark, paths):
    rows = [(p, "markdown", "md", 10) for p in paths]
    return spark.createDataFrame(rows, "relative_path string, language string, extension string, size_bytes long")


def test_candidates_of_repeated_paths_count_a_term_once(spark):
    docs = _documents(spark, ["docs/alpha.md"] * 3 + ["docs/alpha-beta.md"])
    asked = spark.createDataFrame([("r", "alpha beta", [], [])], "request_id string, scope string, anchors array<string>, suggested array<string>")
    hits = spark.createDataFrame([], "request_id string, relative_path string, place int")
    got = decisions.candidate_paths(asked, docs, hits, decisions.term_sets(asked), 4).orderBy("place").collect()
    assert [r.relative_path for r in got] == ["docs/alpha-beta.md", "docs/alpha.md"]


def test_few_paths_of_equal_worth_meet_the_requests(spark):
    """Of 500 paths that hold the same terms only the first can be candidates, and only these are joined."""
    own = spark.range(500).select(F.format_string("docs/alpha-%03d.md", "id").alias("relative_path"), F.lit(6).alias("priority"), F.format_string("docs/alpha-%03d.md", "id").alias("lower"))
    terms = spark.createDataFrame([("r", "scope", "alpha"), ("s", "anchor", "docs"), ("s", "scope", "no")], "request_id string, kind string, term string")
    near, met = decisions._first_held(own, terms, "lower", decisions.SEED_POINTS, 4)
    first = [f"docs/alpha-{k:03d}.md" for k in range(4)]
    assert sorted(r.relative_path for r in near.collect()) == first
    assert sorted((r.request_id, r.relative_path, r.worth) for r in met.collect()) == [("r", p, 8) for p in first] + [("s", p, 5) for p in first]


def test_terms_in_several_passes(spark):
    docs = spark.createDataFrame([("a", "one two"), ("b", None), ("c", "two")], "relative_path string, lower string")
    terms = spark.createDataFrame([("one",), ("two",), ("three",), ("",)], "term string")
    for most in (100, 1):
        got = decisions._with_held(docs, terms, "lower", most).orderBy("relative_path").collect()
        assert [(r.relative_path, r.held) for r in got] == [("a", ["one", "two"]), ("b", []), ("c", ["two"])]


def test_words_are_counted_where_their_text_is(spark):
    """One exchange, that of the texts; also where all documents are of one snapshot."""
    docs = spark.range(20).select(F.lit("s").alias("snapshot_id"), F.format_string("p%d", F.col("id") % 19).alias("relative_path"), F.lit("a b a").alias("body"))
    index = lexical.build_index(docs)
    got = index["postings"]
    assert sorted({(r.relative_path, r.term, r.tf) for r in got.collect() if r.relative_path in ("p0", "p1")}) == [("p0", "a", 4), ("p0", "b", 2), ("p1", "a", 2), ("p1", "b", 1)]
    plan = index["postings"].select("*")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.index("Exchange ") > plan.index("Generate ")


def test_first_rows_are_found_by_ranges(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("a"), (F.col("id") % 3).alias("b")).repartition(5)
    for most in (0, 1, 250, 999, 1000, 2000):
        found = align._first(rows, most, "b", "a")
        want = sorted((r.b, r.a) for r in rows.collect())[:most]
        assert sorted((r.b, r.a) for r in found.collect()) == want
        assert "TakeOrderedAndProject" not in found._jdf.queryExecution().executedPlan().toString() or most < 1000


def test_no_later_tier_is_run_once_there_are_pairs_enough(spark, monkeypatch):
    columns = ("fact_id", "name", "relative_path", "language", "name_key", "behaviour", "id")
    signals = spark.createDataFrame([(*(f"{c}{k}" if c != "language" else "x" for c in columns), k) for k in range(4)], ", ".join(f"{c} string" for c in columns) + ", line_number long")

    def never(*_):
        raise AssertionError("similarity is not asked for")

    monkeypatch.setattr(align, "similar", never)
    got = align.align(signals, signals, signature_aware=True, max_pairs=3).collect()
    assert sorted((r.ref_id, r.tgt_id, r.score) for r in got) == [(f"fact_id{k}", f"fact_id{k}", 100) for k in range(3)]


def test_candidates_are_made_from_the_best_scores_down(spark, monkeypatch):
    """Of left-over functions alone: fewer than all pairs that score enough, and the same pairs are chosen."""
    r, t = catalog_pairs._signals(spark, "/root/testdata/sf0.001")
    every = align.similar(r, t, 65)
    want = {(x.ref_id, x.tgt_id, x.score) for x in align.greedy(every).collect()}
    rough = {(x.ref_id, x.tgt_id, x.rough) for x in align._near(r, t, 65).collect()}
    assert rough == {(x.ref_id, x.tgt_id, x.score) for x in every.collect()}
    made, greedy = [], align.greedy

    def counted(candidates, *block):
        made.append(candidates.count())
        return greedy(candidates, *block)

    monkeypatch.setattr(align, "greedy", counted)
    assert {(x.ref_id, x.tgt_id, x.score) for x in align.matched(r, t, 65, many=500).collect()} == want
    assert len(made) > 1 and sum(made) < every.count()


def test_obligations_are_hashed_once(spark):
    """What reads obligations, twice here, starts no Python: their hashes are written."""
    plan = catalog_pairs.h15_pair_model(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "fnv1a" not in plan and "EvalPython" not in plan


def test_a_snapshot_written_twice_is_extracted_once(spark, monkeypatch):
    plans, write = [], store.write_snapshot

    def noted(facts, root):
        plans.extend(facts[n]._jdf.queryExecution().optimizedPlan().toString() for n in store.FACTS)
        write(facts, root)

    monkeypatch.setattr(store, "write_snapshot", noted)
    assert catalog_sources.a7_a8_round_trip_by_value(spark, "/root/testdata/sf0.001").count() > 0
    assert plans and not any("MapInArrow" in p for p in plans)


def test_invariants_need_no_relationships(spark, monkeypatch):
    def never(*_):
        raise AssertionError("relationships are not asked for")

    monkeypatch.setattr(graph, "relationships", never)
    assert catalog_sources.f14_invariants(spark, "/root/testdata/sf0.001").count() > 0


def test_requests_with_relationships_are_known_without_them(spark):
    d = "/root/testdata/sf0.001"
    facts = catalog_sources.brand_facts(spark, d) | {"verification_targets": catalog_sources.A.targets(spark).where("label = 'none'")}
    facts["imports"] = facts["imports"].where("importer_path = 'Brand#1'")
    facts["symbols"] = facts["symbols"].where("relative_path < 'Brand#2'")
    asked = catalog_sources.brand_requests(spark, d)
    report = graph.blast_radius(asked, facts)
    ids = [{r.request_id for r in report[x].select("request_id").distinct().collect()} for x in ("related", "relationships", "seeds")]
    assert ids[0] == ids[1] and ids[0] < ids[2]


def test_briefs_need_no_relationships(spark, monkeypatch):
    def never(*_):
        raise AssertionError("relationships are not asked for")

    monkeypatch.setattr(graph, "relationships", never)
    monkeypatch.setattr(graph, "touching_imports", never)
    assert catalog_briefs.i11_kept_briefs(spark, "/root/testdata/sf0.001").columns


def test_edges_are_shuffled_once(spark):
    columns = ("request_id", "kind", "src", "dst", "summary")
    edges = spark.range(100).select(*[F.format_string(f"{c}%d", F.col("id") % 7).alias(c) for c in columns], F.array(F.lit("e")).alias("evidence_ids"))
    found = graph.relationships(edges)
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert found.count() == 7
