import __spark_entry__ as entry


def test_whole_tables_are_asked(spark, tmp_path):
    """No file lies in src7; some have headings."""
    texts = ["# A title\nlicense", "no heading, license", "\r\n  ## \r\nlicense", "text\r\n # Second line #\n# third", None, "##"]
    rows = [(i, t, "en", f"src{i % 3}", 1) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: entry.queries()[name](spark, str(tmp_path)).collect()
    titles = {r.relative_path: r.title for r in run("e18_scan_all_documents")}
    assert titles == {f"src{i % 3}/en/doc_{i}.md": t for i, t in enumerate(["A title", "doc 1", "doc 2", "Second line #", "doc 4", "doc 5"])}
    for name, count in (("f2_rank_documents_by_source", 3), ("f6_fast_candidates_by_source", 4)):
        got = run(name)
        assert {(r.request_id, r.place) for r in got} == {(f"src{s}/en", p + 1) for s in range(3) for p in range(count)}
