"""The whole pipeline against plain code, and which tests stand in for the SQL that some queries cannot have."""

import os
import random
import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from factloom.llm import quality_classifier as qc

public_tokenizers = pytest.importorskip("public_tokenizers")

#: For every query of the subpackage without SQL: the test that holds it against a plain version.
PLAIN = {
    "op2_sentencepiece": "test_tokens.test_encoding_is_that_of_the_library_with_the_same_scores", "op3_packing": "test_packing.test_every_id_lies_in_one_piece", "op4_pii": "test_pii.test_base_spans_are_those_of_the_plain_patterns",
    "op5_quality_classifier": "test_quality.test_scores_are_sums_over_features", "op6_nearest_neighbours": "test_ann.test_recall_on_vectors_spread_evenly", "op7_token_counts": "test_tokens.test_counts_are_those_of_the_wordpiece_library",
    "pipeline": "test_pipeline_plain.test_the_pipeline_is_plain_code_in_a_row",
}


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def without_lines(rows):
    """Lines of 40 characters and more that five documents hold stay in the one with the largest id."""
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))
    holders = {}
    for i, text in rows.items():
        for line in text.split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(i)
    common = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    return {i: "\n".join(x for x in text.split("\n") if common.get(key(x), i) == i) for i, text in rows.items()}


def without_copies(rows):
    """One of each group at 0.8 stays, the smallest id."""
    sets, kept, group = {i: shingles(t) for i, t in rows.items()}, {}, {}
    for i in sorted(rows):
        near = [j for j in group if sets[i] and sets[j] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])]
        joined, first = {group[j] for j in near}, min((group[j] for j in near), default=i)
        group = {j: first if g in joined else g for j, g in group.items()} | {i: first}
    for i, text in rows.items():
        if group[i] == i:
            kept[i] = text
    return kept


def test_the_pipeline_is_plain_code_in_a_row(spark, tmp_path):
    from tokenizers import Tokenizer

    draw = random.Random(12)
    word = lambda: "".join(draw.choice("etaoinshrdlu") for _ in range(draw.randrange(2, 9)))
    good = [[word() for _ in range(70)] for _ in range(60)]
    line = "this very line stands in many documents, and only one of them may keep it"
    rows = {i: " ".join(w[:35]) + "\n" + " ".join(w[35:]) for i, w in enumerate(good)}
    for i in range(0, 60, 5):
        rows[i] += "\n" + line
    for k in range(12):  # near copies of several degrees
        w = list(good[k])
        for at in range(k):
            w[at * 5] = word()
        rows[100 + k] = " ".join(w[:35]) + "\n" + " ".join(w[35:])
    rows[200], rows[201] = rows[20] + " write to ann.lee@mail.example.com today", rows[41] + " and to bob@example.org"
    rows |= {300 + k: " ".join(x.upper() + "!!" for x in good[k]) for k in range(12)}
    made = [(i, t, "en", "s", len(t)) for i, t in rows.items()]
    spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")

    # the model is the one that the rows give; what it says of each text is added up in plain code elsewhere
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    judged = {r.doc_id: r.kept for r in qc.score(docs.select("doc_id", "text"), qc.fit(docs)).collect()}
    assert not any(judged[300 + k] for k in range(12)) and all(judged[i] for i in range(60))
    expected = without_copies(without_lines({i: t for i, t in rows.items() if judged[i]}))
    expected = {i: re.sub(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "[EMAIL]", t) for i, t in expected.items()}
    assert 60 < len(expected) < 75 and sum("[EMAIL]" in t for t in expected.values()) >= 1

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    ids, at = {}, {}
    for r in sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda r: (r.doc_id, r.start)):
        assert r.start == at.get(r.doc_id, 0)
        at[r.doc_id] = r.start + r.length
        ids.setdefault(r.doc_id, []).extend(r.ids)
    assert ids == {i: [*library.encode(t, add_special_tokens=False).ids, 0] for i, t in expected.items()}


def test_what_has_no_sql_has_a_plain_version():
    own = [n for n in entry.queries() if re.match(r"op\d+_|pipeline$", n) and n not in entry.oracle_sql()]
    assert set(own) == set(PLAIN)
    for where in PLAIN.values():
        module, test = where.split(".")
        assert f"def {test}(" in open(os.path.join(os.path.dirname(__file__), f"{module}.py"), encoding="utf-8").read()
