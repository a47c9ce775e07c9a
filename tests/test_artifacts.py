"""Functions of modules, their best matches, and bounded scopes."""

from factloom.operators import artifacts

MODULE = """; ModuleID
define i32 @plain(i32 %x) {
  ret i32 %x
}
  define internal void @"quoted name"() !dbg !5 {
    br label %a ; { not { closed
  } }
  }
define i32 @_ZN4demo5totalE(i32 %0) !dbg !7 {
  ret i32 1
}
!1 = !DIFile(filename: "src/lib.rs", directory: "/work/demo")
!2 = !DIFile(filename: "/abs/other.rs", directory: "/x")
!5 = distinct !DISubprogram(name: "quoted", scope: !1, file: !2, line: 3)
!7 = distinct !DISubprogram(name: "total", file: !1, line: 12, type: !9)
"""


def test_functions_of_a_module():
    found = artifacts.module_functions(MODULE)
    assert [x[:4] for x in found] == [("plain", None, None, None), ("quoted name", "quoted", "/abs/other.rs", 3), ("_ZN4demo5totalE", "total", "/work/demo/src/lib.rs", 12)]
    assert found[0][4] == "define i32 @plain(i32 %x) {\n  ret i32 %x\n}\n" and found[1][4].endswith("  } }\n  }\n")
    assert artifacts.module_functions("") == []


def plain_best(signals, functions):
    out = {}
    for id_, name, path, line in signals:
        best = None
        for k, (symbol, sub, source, at, _) in enumerate(functions):
            score, fits = 0, False
            if sub == name:
                score, fits = 120, True
            elif name in symbol:
                score, fits = 40, True
            if source and source.lower().endswith(path.lower()):
                score, fits = score + 80, True
            if at is not None:
                far = abs(at - line)
                score += 25 if far <= 2 else 16 if far <= 8 else 8 if far <= 20 else 0
            if fits and (best is None or score > best[0]):
                best = score, k
        if best:
            out[id_] = best
    return out


def test_best_matches_are_those_of_all_pairs(spark):
    functions = artifacts.extract_functions(spark.createDataFrame([("m", MODULE), ("none", None)], "module string, text string"))
    signals = [("a", "total", "src/lib.rs", 10), ("b", "plain", "src/lib.rs", 40), ("c", "demo", "nowhere.rs", 12), ("d", "absent", "nowhere.rs", 1), ("e", "q", "OTHER.rs", 3), ("f", "pl", "x.rs", 1)]
    got = {r.id: (r.score, r.place) for r in artifacts.best_functions(spark.createDataFrame(signals, "id string, name string, relative_path string, line_number long"), functions).collect()}
    assert got == plain_best(signals, artifacts.module_functions(MODULE))


def test_bounded_scope(spark):
    lists = "changed_scope array<string>, modified_files array<string>, added_files array<string>, removed_files array<string>"
    delta = spark.createDataFrame([(["a.md"], ["b.rs", "a.RS", ".rs"], ["z.rs"], [])], lists)
    symbols = spark.createDataFrame([("f", "function", "b.rs", 2), ("e", "function", "b.rs", 1), ("g", "function", "z.rs", 1), ("h", "struct", "b.rs", 3)], "name string, kind string, relative_path string, line_number long")
    files, functions = artifacts.bounded_scope(delta, symbols, 8, 1)
    assert [r.relative_path for r in files.collect()] == ["a.RS", "b.rs"] and [r.name for r in functions.collect()] == ["e"]


def test_artifact_messages(spark):
    lines = ['{"reason":"compiler-artifact","manifest_path":"m","filenames":["t/a.ll","t/a.rlib"],"target":{"name":"a","kind":["lib"]}}', '{"reason":"other"}', "no json", '{"reason":"compiler-artifact","manifest_path":"n","filenames":["b.ll"]}']
    got = artifacts.llvm_artifacts(spark.createDataFrame([(x,) for x in lines], "value string"), "m").collect()
    assert [(r.path, r.target) for r in got] == [("t/a.ll", "a")]
