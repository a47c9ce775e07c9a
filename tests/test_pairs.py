"""Two snapshots: properties of deltas and merges, alignment of moved and renamed functions, obligations."""

import random

from pyspark.sql import functions as F

from factloom.operators import align, delta, obligations
from factloom.sources.schema import ddl


def side(spark, functions, hashes, imports=()):
    symbols = [("s", f"{path}:{line}:{name}", name, "function", path, "rust", line, "x") for name, path, line in functions]
    files = [("s", p, "rs", "rust", 1, h) for p, h in hashes.items()]
    facts = [("s", f"{a}>{b}", a, spec, 1, "rust", "use", b, "x") for a, spec, b in imports]
    return {"symbols": spark.createDataFrame(symbols, ddl("symbols")), "files": spark.createDataFrame(files, ddl("files")), "imports": spark.createDataFrame(facts, ddl("imports")), "verification_targets": spark.createDataFrame([], ddl("verification_targets"))}


def outcome(spark, ref, tgt, **more):
    a, b = (align.function_signals(x["symbols"], x["imports"]) for x in (ref, tgt))
    pairs = align.align(a, b, **more)
    modified = delta.file_changes(ref["files"], tgt["files"]).where("change = 'modified'")
    judged = align.difference_reasons(pairs, a, b, modified)
    return pairs.collect(), align.relational_status(judged, align.unmatched(a, pairs, "ref"), align.unmatched(b, pairs, "tgt")).first()


def test_delta_of_equal_snapshots_is_empty_and_merge_of_all_is_the_target(spark):
    a = side(spark, [("f", "a.rs", 1)], {"a.rs": "1", "b.rs": "1"}, [("a.rs", "b", "b.rs")])
    b = side(spark, [("f", "a.rs", 1), ("g", "c.rs", 1)], {"a.rs": "2", "c.rs": "1"}, [("c.rs", "a", "a.rs")])
    assert not delta.semantic_delta(a, a)["summary"].first().has_changes
    found = delta.semantic_delta(a, b)
    d = delta.delta_report(found).first()
    assert (d.added_files, d.removed_files, d.modified_files, d.added_symbols, d.added_imports, d.removed_imports) == (1, 1, 1, 1, 1, 1)
    assert (d.added_file_list, d.removed_file_list, d.modified_file_list) == (["c.rs"], ["b.rs"], ["a.rs"])
    assert d.changed_scope == ["a.rs", "b.rs", "c.rs"] and d.has_changes and sorted(r.relative_path for r in found["scope"].collect()) == d.changed_scope
    paths = a["files"].select("relative_path").union(b["files"].select("relative_path")).distinct()
    merged = delta.merge_snapshot(a, b, paths)
    for n in ("files", "symbols", "imports"):
        assert sorted(map(str, merged[n].select(b[n].columns).collect())) == sorted(map(str, b[n].collect()))
    part = delta.merge_snapshot(a, b, b["files"].where("relative_path = 'c.rs'").select("relative_path"))
    assert sorted(r.relative_path for r in part["files"].collect()) == ["a.rs", "b.rs", "c.rs"] and part["files"].where("relative_path = 'a.rs'").first().content_hash == "1"


def test_rename_in_a_modified_file_is_no_difference(spark):
    ref, tgt = side(spark, [("compute_total", "src/lib.rs", 1)], {"src/lib.rs": "1"}), side(spark, [("calculate_total", "src/lib.rs", 1)], {"src/lib.rs": "2"})
    pairs, status = outcome(spark, ref, tgt)
    assert [(p.strategy, p.score) for p in pairs] == [("behavioral_profile_exact", 96)] and status.status == "no_difference_observed"


def test_same_name_in_a_modified_file_differs(spark):
    ref, tgt = (side(spark, [("compute_total", "src/lib.rs", 1)], {"src/lib.rs": h}) for h in "12")
    assert outcome(spark, ref, tgt)[1].status == "observed_difference"


def test_a_move_with_a_rename_is_no_difference(spark):
    ref, tgt = side(spark, [("compute_total", "src/lib.rs", 1)], {"src/lib.rs": "1"}), side(spark, [("calculate_total", "src/new_logic.rs", 1)], {"src/new_logic.rs": "1"})
    assert outcome(spark, ref, tgt)[1].status == "no_difference_observed"


def test_a_new_import_differs(spark):
    hashes = {"src/lib.rs": "1", "src/helper.rs": "1"}
    ref = side(spark, [("f", "src/lib.rs", 1)], hashes)
    tgt = side(spark, [("f", "src/lib.rs", 1)], hashes | {"src/lib.rs": "2"}, [("src/lib.rs", "crate::helper::helper_value", "src/helper.rs")])
    assert outcome(spark, ref, tgt)[1].status == "observed_difference"


def test_similarity_is_asked_for(spark):
    ref = side(spark, [("compute_total_sum", "src/a.rs", 1), ("other_thing", "src/a.rs", 5)], {"src/a.rs": "1"})
    tgt = side(spark, [("compute_total_overall", "src/a.rs", 2), ("other_thing", "src/a.rs", 6)], {"src/a.rs": "1"})
    assert len(outcome(spark, ref, tgt)[0]) == 1
    pairs, _ = outcome(spark, ref, tgt, signature_aware=True, least=30)
    assert sorted(p.strategy for p in pairs) == ["exact_path_name", "signature_similarity"] and all(p.score >= 30 for p in pairs)


def in_order(rows):
    """One pass over (ref_id, tgt_id, score) in the order of the score, then the ids."""
    left, right, out = set(), set(), set()
    for a, b, score in sorted(rows, key=lambda x: (-x[2], x[0], x[1])):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            out.add((a, b, score))
    return out


def matched(spark, rows, **more):
    return {(r.ref_id, r.tgt_id, r.score) for r in align.greedy(spark.createDataFrame(rows, "ref_id string, tgt_id string, score int"), **more).collect()}


def test_greedy_is_one_pass_in_order(spark):
    rows = [(f"r{a}", f"t{b}", (a * 7 + b * 13) % 10) for a in range(12) for b in range(9)]
    got = matched(spark, rows)
    assert got == in_order(rows) and len({a for a, *_ in got}) == len(got) == 9
    assert matched(spark, []) == set()


def test_greedy_over_a_thousand_functions_a_side(spark):
    draw = random.Random(5)
    rows = list({(f"r{draw.randrange(1000):04}", f"t{draw.randrange(1000):04}"): 0 for _ in range(30_000)})
    rows = [(a, b, draw.choice([65, 70, 70, 80, 95])) for a, b in rows]
    assert matched(spark, rows) == in_order(rows)


def test_ties_are_passed_over_in_blocks(spark):
    """All scores equal: every round of mutually best pairs finds one, so blocks of the order do the work, each in one task."""
    rows = [(f"r{a:03}", f"t{b:03}", 70) for a in range(60) for b in range(50)]
    assert matched(spark, rows, block=400) == in_order(rows) == {(f"r{k:03}", f"t{k:03}", 70) for k in range(50)}


def test_similarity_looks_at_all_pairs_that_score_enough(spark):
    """The keys of candidates lose none: held against all pairs of functions that differ in few or many ways."""
    draw = random.Random(11)
    verbs, nouns = ["read", "write", "parse"], ["file", "tree", "node", "edge"]
    functions = lambda k: [(f"{draw.choice(verbs)}_{draw.choice(nouns)}_{draw.choice(nouns)}", f"src/{draw.choice('abcd')}{k}/{draw.choice('mn')}.rs", draw.randrange(1, 25)) for _ in range(70)]
    sides = []
    for k in "xy":
        made = sorted(set(functions(k)))
        paths = sorted({p for _, p, _ in made})
        imports = [(p, f"crate::{draw.choice(['one', 'two'])}", None) for p in paths if draw.random() < 0.7]
        found = side(spark, made, dict.fromkeys(paths, k), imports)
        sides.append(align.function_signals(found["symbols"], found["imports"]))
    r, t = sides
    both = r.alias("r").join(t.alias("t"), F.col("r.language") == F.col("t.language")).select(F.col("r.fact_id").alias("a"), F.col("t.fact_id").alias("b"), align.similarity().alias("score"))
    all_ = {(x.a, x.b, x.score) for x in both.where("score >= 65").collect()}
    assert {(x.ref_id, x.tgt_id, x.score) for x in align.similar(r, t, 65).collect()} == all_ and len(all_) > 50


def test_at_most_so_many_pairs(spark):
    ref = side(spark, [("b", "z.rs", 1), ("a", "a.rs", 1), ("moved_one", "m.rs", 1), ("total_sum_one", "q.rs", 1)], {})
    tgt = side(spark, [("b", "z.rs", 1), ("a", "a.rs", 1), ("moved_one", "n.rs", 20), ("total_sum_two", "q.rs", 2)], {})
    a, b = (align.function_signals(x["symbols"], x["imports"]) for x in (ref, tgt))
    order = ["a.rs:1:a", "z.rs:1:b", "q.rs:1:total_sum_one", "m.rs:1:moved_one"]  # alike in all but name, then alike in name
    for most in range(5):
        pairs = align.align(a, b, signature_aware=True, least=40, max_pairs=most)
        assert sorted(p.ref_id for p in pairs.collect()) == sorted(order[:most])
        assert align.unmatched(a, pairs, "ref").count() == 4 - most


def test_obligation_ids_and_schedule(spark):
    paths = spark.createDataFrame([("src/lib.rs",)], "relative_path string")
    made = obligations._made(paths.select(F.lit("file:src/lib.rs").alias("source_pair"), F.array().cast("array<string>").alias("assumptions"), F.lit(0).alias("rank")), "repo-equivalence-v1", ["a", "b"]).first()
    assert (made.encoding_hash, made.id) == ("15eca1e98756b33d", "thm_b87f9730f1d6fa1a")
    pairs = ["file:a.rs", "pair:f@b.rs:1=>f@a.rs:2", "target_only:g@z.rs:1", "reference_only:g@c.rs:1", "odd"]
    rows = spark.createDataFrame([(f"i{k}", p, "c", ["x"], "h") for k, p in enumerate(pairs)], ddl("obligations"))
    got = obligations.schedule(rows, 10).orderBy("place").collect()
    assert [(r.priority, r.partition) for r in got] == [(0, "reference:c.rs"), (0, "target:z.rs"), (1, "pair:a.rs=>b.rs"), (2, "file:a.rs"), (3, "unknown")]
    assert got[0].assumptions == ["x", "obligation_partition=reference:c.rs", "obligation_priority=0"]


def test_harnesses(spark):
    text = ["fn before() {}", "#[kani::proof]", "#[other]", "fn check_one() {}", "fn no() {}", "#[kani::proof_for_contract(x)]", "pub fn check_two() {}"]
    lines = spark.createDataFrame([("m", "a.rs", k, x) for k, x in enumerate(text)] + [("m", "b.rs", k, x) for k, x in enumerate(text)], "manifest_path string, relative_path string, line_number long, line string")
    assert sorted(r.harness for r in obligations.harnesses(lines).collect()) == ["check_one", "check_two"]


def test_contracts(spark):
    lists = "environment_assumptions array<string>, input_domains array<string>, observables array<string>, equivalence_claims array<string>"
    rows = [("c", ["a"], ["a"], ["a"], ["a"]), (" ", ["a"], ["a"], ["a"], ["a"]), ("d", ["a"], None, ["a"], ["a"]), (None, ["a"], ["a"], ["a"], ["a"])]
    assert [r.valid for r in obligations.valid_contracts(spark.createDataFrame(rows, f"contract_id string, {lists}")).collect()] == [True, False, False, False]


def test_all_renamed_functions_enter_the_similarity_tier(spark):
    word = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    paths = [f"src/f{i:03}.rs" for i in range(300)]
    ref = side(spark, [(f"gather_total_{word(i)}", p, 1) for i, p in enumerate(paths)], dict.fromkeys(paths, "1"))
    tgt = side(spark, [(f"obtain_total_{word(i)}", p, 11) for i, p in enumerate(paths)], dict.fromkeys(paths, "2"))
    a, b = (align.function_signals(x["symbols"], x["imports"]) for x in (ref, tgt))
    got = {(r.ref_id, r.tgt_id) for r in align.align(a, b, signature_aware=True, least=50).collect()}
    assert got == {(f"{p}:1:gather_total_{word(i)}", f"{p}:11:obtain_total_{word(i)}") for i, p in enumerate(paths)}
    assert align.align(a, b, signature_aware=True, least=50, max_signals=256).count() == 256
