"""Scalar kernels: fixed values, and twins in plain Python."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from factloom.functions import text as X
from factloom.operators import decisions, lexical

GOLDEN = [
    (X.fnv1a_sql, "", "cbf29ce484222325"), (X.fnv1a_sql, "hello", "a430d84680aabd0b"), (X.fnv1a_sql, "über", "a720359e11610baf"), (X.fnv1a, "", "cbf29ce484222325"), (X.fnv1a, "hello", "a430d84680aabd0b"), (X.fnv1a, "über", "a720359e11610baf"),
    (X.sanitize_id, "src/Foo-bar.rs", "src_foo_bar_rs"), (X.sanitize_id, "é::X", "___x"), (X.sanitize_id, "😀a", "_a"),
    (X.normalize_identifier, "computeTotalV2", "compute total v2"), (X.normalize_identifier, "HTTPServer", "h t t p server"), (X.normalize_identifier, "_a__b", "a b"), (X.normalize_identifier, "", ""),
    (X.identifier_shape, "compute_total", "tokens=2;pattern=lm;extra=0;digits=0"), (X.identifier_shape, "a_b_c_d_e9", "tokens=5;pattern=ssss;extra=1;digits=1"), (X.identifier_shape, "__", "tokens=0;pattern=none;digits=0"),
    (X.query_tokens, "Foo_bar9x a ü", ["bar9x", "foo"]), (X.text_terms, "src/lib.rs why", ["lib", "src", "why"]), (X.camel_terms, "RepositoryScanner", ["repository", "scanner"]),
    (X.adr_id, "docs/adr-0001-x.md", "ADR-0001"), (X.adr_id, "docs/adr-x/adr-7.md", None), (X.title_from_path, "docs/plan_a-b.md", "plan a b"), (X.import_leaf, "crate::symbols::SymbolKind", "SymbolKind"), (X.import_leaf, "./a/b.js", "js"),
    (decisions.path_priority, "docs/adr/adr-1-decision-spec.md", 81), (X.normalize_segments, "a/./b/../c//d", "a/c/d"), (X.normalize_segments, "../../x", "x"), (X.artifact_label, "feature/x", "feature_x"), (X.artifact_label, None, "worktree"),
    (X.compact_snippet, "  " + "x" * 161, "x" * 160 + "..."), (X.compact_snippet, " y ", "y"), (X.file_stem, "a/b.tar.gz", "b.tar"), (X.file_stem, ".env", ".env"), (X.parent_dir, "a/b/c", "a/b"), (X.parent_dir, "c", ""),
]


def test_fixed_values(spark):
    rows = spark.createDataFrame([(k, v) for k, (_, v, _) in enumerate(GOLDEN)], "k int, v string")
    got = {}
    for k, (f, _, _) in enumerate(GOLDEN):
        got[k] = rows.where(F.col("k") == k).select(f(F.col("v")).alias("x"))
    both = got[0].select(F.lit(0).alias("k"), F.to_json(F.struct("x")).alias("x"))
    for k in range(1, len(GOLDEN)):
        both = both.union(got[k].select(F.lit(k), F.to_json(F.struct("x"), {"ignoreNullFields": "false"})))
    import json

    for r in both.collect():
        assert json.loads(r.x)["x"] == GOLDEN[r.k][2], GOLDEN[r.k]


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_ids_and_similarity(spark):
    lit = F.lit
    assert one(spark, X.symbol_fact_id(lit("rust"), lit("src/lib.rs"), lit(1), lit("function"), lit("value"))) == "sym_rust_src_lib_rs_1_function_value"
    assert one(spark, X.import_fact_id(lit("rust"), lit("src/lib.rs"), lit(2), lit("use"), lit("crate::symbols::SymbolKind"))) == "imp_rust_src_lib_rs_2_use_crate__symbols__symbolkind"
    assert one(spark, X.identifier_similarity(lit("compute total"), lit("calculate total"))) == 7
    assert one(spark, X.identifier_similarity(lit("a b c"), lit("a b d e"))) == 8
    assert one(spark, X.bucket_token_budget(lit(1025))) == 2048
    assert one(spark, X.render_target(F.array(lit("cargo"), lit("test")), lit("."), lit(""))) == "cargo test [scope:<repo>]"
    assert one(spark, X.decision_probe(lit("RepositoryScannerTool"))) == "repository tool"
    assert one(spark, X.decision_probe(lit("the widget of gadgets"))) == "gadgets widget"


def test_index_words_fold_marks(spark):
    text = "Über Étude_x naïve ßtz 9a"
    plain = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if not unicodedata.combining(c))
    assert one(spark, lexical.index_terms(F.lit(text))) == [t for t in re.split(r"[\W_]+", plain) if t]


@pytest.mark.parametrize(("rank", "score"), [(-3.0, 1.0), (0.0, 1.0), (1.0, 0.5), (float("inf"), 1.0), (float("nan"), 1.0)])
def test_score_from_rank(spark, rank, score):
    assert one(spark, lexical.score_from_rank(F.lit(rank))) == score
