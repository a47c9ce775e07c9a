"""What compiler artifacts and deltas give to later stages: module functions, best matches and bounded scopes."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, normalise_path

_FILE = re.compile(r"^\s*!(\d+).*!DIFile\(")
_SUBPROGRAM = re.compile(r"^\s*!(\d+).*!DISubprogram\(")
_SYMBOL = re.compile(r'@(?:"([^"]*)"|([^(]*)\()')


def _field(line: str, pattern: str) -> str | None:
    found = re.search(pattern, line)
    return found[1] if found else None


def module_functions(text: str) -> list[tuple[str, str | None, str | None, int | None, str]]:
    """(symbol, name, source path, line, text) of each function defined in a module's text; the middle three come from
    its debug records. A definition ends where its braces are closed."""
    files: dict[str, str] = {}
    programs: dict[str, tuple[str, str | None, int | None]] = {}
    lines = text.split("\n")
    for line in lines:
        if m := _FILE.match(line):
            name, folder = _field(line, r'filename: "([^"]*)"'), _field(line, r'directory: "([^"]*)"')
            if name is not None:
                whole = ":" in name or name[:1] in ("/", "\\") or not folder
                files[m[1]] = (name if whole else f"{folder}/{name}").replace("\\", "/")
    for line in lines:
        if m := _SUBPROGRAM.match(line):
            name, at = _field(line, r'name: "([^"]*)"'), _field(line, r"line: (\d+)")
            if name is not None:
                programs[m[1]] = name, files.get(_field(line, r"file: !(\d+)") or ""), int(at) if at else None
    out, k = [], 0
    while k < len(lines):
        head = lines[k].lstrip()
        if not head.startswith("define "):
            k += 1
            continue
        first, depth, opened = k, 0, False
        while k < len(lines):
            depth, opened = depth + lines[k].count("{"), opened or "{" in lines[k]
            depth -= lines[k].count("}") if opened else 0
            k += 1
            if opened and depth <= 0:
                break
        m = _SYMBOL.search(head)
        symbol = (m[1] if m[1] is not None else m[2].strip()) if m else ""
        name, path, at = programs.get(_field(head, r"!dbg !(\d+)") or "", (None, None, None))
        out.append((symbol, name, path, at, "\n".join(lines[first:k]) + "\n"))
    return out


_FUNCTIONS = "module string, place long, symbol_name string, subprogram_name string, source_path string, line_number long, ir string"


def extract_functions(modules: DataFrame) -> DataFrame:
    """A row for each function of modules (module, text), in order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()]
        for batch in batches:
            rows = [(name, k, *f) for name, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, f in enumerate(module_functions(text or ""))]
            if rows:
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in _FUNCTIONS.split(", ")])

    return modules.select("module", "text").mapInArrow(run, _FUNCTIONS)


def best_functions(signals: DataFrame, functions: DataFrame, root: str = "") -> DataFrame:
    """For each signal (id, name, relative_path, line_number) the function of the module that fits best.

    Points: its debug name is the signal's (120) or its symbol holds it (40); its path ends with the signal's (80); its line is
    near (25, 16 or 8). Name or path must fit; of equal scores the first function counts. Candidates come from equi-joins
    on the name, on parts of the symbol and on the file's name; no signal meets every function.
    """
    path = ascii_lower(normalise_path("source_path"))
    f = functions.withColumn("p", path).withColumn("file", F.substring_index("p", "/", -1))
    s = signals.select("id", "name", F.col("line_number").alias("at"), ascii_lower(normalise_path("relative_path")).alias("sp")).withColumn("file", F.substring_index("sp", "/", -1))
    key = ["module", "place"]
    by_name = s.join(f.select(*key, F.col("subprogram_name").alias("name")), "name").select("id", *key)
    by_file = s.join(f.select(*key, "file"), "file").select("id", *key)
    # a symbol that holds a name holds the name's first three characters, or all of a shorter one
    of = lambda n: F.transform(F.sequence(F.lit(1), F.length("symbol_name")), lambda i: F.substring("symbol_name", i, F.lit(n)))
    piece = F.explode(F.array_distinct(F.flatten(F.array(of(1), of(2), of(3)))))
    pieces = f.where("symbol_name <> ''").select(*key, "symbol_name", piece.alias("piece"))
    by_symbol = s.withColumn("piece", F.substring("name", 1, 3)).join(pieces, "piece").where(F.contains("symbol_name", F.col("name"))).select("id", *key)
    met = by_name.union(by_file).union(by_symbol).distinct().join(s.drop("file"), "id").join(f, key)
    named, held = F.coalesce(F.col("subprogram_name") == F.col("name"), F.lit(False)), F.contains("symbol_name", F.col("name"))
    there = F.coalesce(F.endswith("p", F.col("sp")), F.lit(False))
    far = F.abs(F.col("line_number") - F.col("at"))
    score = F.when(named, 120).when(held, 40).otherwise(0) + F.when(there, 80).otherwise(0) + F.when(far <= 2, 25).when(far <= 8, 16).when(far <= 20, 8).otherwise(0)
    rows = met.where(named | held | there).withColumn("score", score)
    first = F.row_number().over(W.partitionBy("id").orderBy(F.desc("score"), "module", "place"))
    return rows.withColumn("n", first).where("n = 1").select("id", "module", "place", "symbol_name", "score")


def bounded_scope(delta: DataFrame, symbols: DataFrame, max_files: int, max_functions: int) -> tuple[DataFrame, DataFrame]:
    """Rust files of the first part of a delta (one row) that has any: changed scope, modified, added or removed files; and
    the functions in them, by name, path and line; both capped."""
    parts = ("changed_scope", "modified_files", "added_files", "removed_files")
    rust = lambda c: F.filter(F.col(c), lambda p: p.rlike(r"(?i)[^/]\.rs$"))
    first = F.lit(None)
    for c in reversed(parts):
        first = F.when(F.size(rust(c)) > 0, rust(c)).otherwise(first)
    files = delta.select(F.explode(F.slice(F.array_sort(F.array_distinct(first)), 1, max_files)).alias("relative_path"))
    inside = symbols.where("kind = 'function'").join(files, "relative_path", "left_semi")
    return files, inside.orderBy("name", "relative_path", "line_number").limit(max_functions)


def llvm_artifacts(messages: DataFrame, manifest: str) -> DataFrame:
    """Paths of IR files in a build's JSON lines (value): artifacts of the manifest, in order, each once."""
    schema = "reason string, manifest_path string, filenames array<string>, target struct<name:string,kind:array<string>>"
    rows = messages.select(F.from_json("value", schema).alias("m")).where("m.reason = 'compiler-artifact'").select("m.*").where(F.col("manifest_path") == manifest)
    return rows.select(F.explode("filenames").alias("path"), F.col("target.name").alias("target")).where(F.endswith("path", F.lit(".ll"))).distinct()
