"""Symbols and imports of source files.

One pass over each file's lines in Arrow batches gives symbols, imports, and for each import the ordered list of paths that
it may mean. Which of them exist is a join with the files table, so no task needs to know all paths.
"""

from __future__ import annotations

import posixpath
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import import_fact_id, symbol_fact_id

_NAME = r"(?:r#)?([A-Za-z0-9_$]+)"
_RUST_KINDS = {"fn": "function", "struct": "struct", "enum": "enum", "trait": "trait", "type": "type_alias", "const": "constant", "static": "constant", "mod": "module"}
_TS_KINDS = {"function": "function", "class": "class", "interface": "interface", "type": "type_alias", "enum": "enum"}

_RUST = re.compile(rf"(?:(?:pub(?:\([^\s]*)?|async|default|unsafe)\s+)*(?:const\s+(fn)|(fn|struct|enum|trait|type|const|static|mod))\s+{_NAME}")
_PYTHON = re.compile(rf"(?:async\s+)?(def|class)\s+{_NAME}")
_TS = re.compile(rf"(?:(?:abstract|declare|default|export)\s+)*(?:async\s+(function)|const\s+(enum)|(function|class|interface|type|enum))\s+{_NAME}")

_RUST_IMPORT = re.compile(r"(?:pub |unsafe |async )*(mod|use) ([^;]*)")
_PYTHON_IMPORT = re.compile(r"from (.*?) import ")
_TS_FROM = re.compile(r""".*? from (["'])(.*?)\1""")
_TS_BARE = re.compile(r"""import (["'])(.*?)\1""")
_TS_REQUIRE = re.compile(r""".*?require\((["'])(.*?)\1""")

_COMMENTS = {"python": ("#",), "rust": ("//", "/*", "*"), "typescript": ("//", "/*", "*"), "javascript": ("//", "/*", "*")}


def lines_of(text: str) -> list[str]:
    """Lines without their ends; a last empty one does not count."""
    lines = text.split("\n")
    if lines[-1] == "":
        lines.pop()
    return [x[:-1] if x.endswith("\r") else x for x in lines]


def _shown(lines: list[str], language: str) -> Iterator[tuple[int, str]]:
    """Number and text of lines that are neither empty nor comments, without indentation."""
    marks = _COMMENTS[language]
    for k, line in enumerate(lines, 1):
        line = line.lstrip()
        if line and not line.startswith(marks):
            yield k, line


def test_lines(lines: list[str]) -> set[int]:
    """Numbers of lines in Rust test modules, by counting braces; a depth never falls below 0."""
    skipped: set[int] = set()
    depth, pending, outside = 0, False, None
    for k, line in enumerate(lines, 1):
        line = line.lstrip()
        after = max(0, depth + line.count("{") - line.count("}"))
        if outside is not None:
            skipped.add(k)
            outside = None if after == outside else outside
        elif line.startswith("#[cfg(test)]"):
            pending = True
            skipped.add(k)
        elif pending and line.startswith("mod tests") and "{" in line:
            outside, pending = depth, False
            skipped.add(k)
        elif line and not line.startswith("#["):
            pending = False
        depth = after
    return skipped


def symbols_of(language: str, text: str) -> list[tuple[str, str, int]]:
    """(name, kind, line) of a file's declarations."""
    if language not in _COMMENTS:
        return []
    lines, out = lines_of(text), []
    skipped = test_lines(lines) if language == "rust" else ()
    for k, line in _shown(lines, language):
        if k in skipped:
            continue
        if language == "rust":
            if m := _RUST.match(line):
                out.append((m[3], _RUST_KINDS[m[1] or m[2]], k))
        elif language == "python":
            if m := _PYTHON.match(line):
                out.append((m[2], "class" if m[1] == "class" else "function", k))
        elif m := _TS.match(line):
            out.append((m[4], _TS_KINDS[m[1] or m[2] or m[3]], k))
    return out


def join(base: str, child: str) -> str:
    """Both parts as one path; `..` above the root goes nowhere."""
    out: list[str] = []
    for part in f"{base}/{child}".split("/"):
        if part == "..":
            out = out[:-1]
        elif part not in ("", "."):
            out.append(part)
    return "/".join(out)


def _crate(path: str) -> str | None:
    """The source folder of a file's crate."""
    if path.startswith("src/"):
        return "src"
    head, found, _ = path.partition("/src/")
    return f"{head}/src" if found else None


def _rust_candidates(path: str, kind: str, spec: str) -> list[str]:
    if kind == "module":
        return [join(posixpath.dirname(path), f"{spec}{end}") for end in (".rs", "/mod.rs")]
    parts: list[str] = []
    for part in spec.split("::"):
        if not part or part in ("self", "Self") or not ("a" <= part[0] <= "z"):
            break
        parts.append(part)
    base = _crate(path)
    if not parts or base is None:
        return []
    if spec.startswith("crate::"):
        parts = parts[1:]
    elif spec.startswith("super::"):
        _, found, inner = path.partition("/src/")
        if not found:
            return []
        inner = posixpath.dirname(inner)
        while parts and parts[0] == "super":
            inner, parts = posixpath.dirname(inner), parts[1:]
        base = join(base, inner)
    else:
        return []
    # the longest module path first; what is left over names things inside it
    return [join(base, "/".join(parts[:n]) + end) for n in range(len(parts), 0, -1) for end in (".rs", "/mod.rs")]


def _python_candidates(path: str, spec: str) -> list[str]:
    rest = spec.lstrip(".")
    dots = len(spec) - len(rest)
    base = ""
    if dots:
        base = posixpath.dirname(path)
        for _ in range(dots - 1):
            base = posixpath.dirname(base)
    module = join(base, rest.replace(".", "/"))
    return [f"{module}.py", join(module, "__init__.py")]


def _ts_candidates(path: str, spec: str) -> list[str]:
    if not spec.startswith(("./", "../")):
        return []
    module, own = join(posixpath.dirname(path), spec), posixpath.splitext(path)[1]
    stem, end = posixpath.splitext(module)
    out = []
    if end:
        out.append(module)
        if end in (".js", ".jsx", ".ts", ".tsx"):
            out += [stem + e for e in (".ts", ".tsx", ".js", ".jsx")]
    order = ("js", "jsx", "ts", "tsx") if own in (".js", ".jsx") else ("ts", "tsx", "js", "jsx")
    return out + [c for e in order for c in (f"{module}.{e}", join(module, f"index.{e}"))]


def imports_of(path: str, language: str, text: str) -> list[tuple[str, str, int, list[str]]]:
    """(kind, spec, line, candidates) of a file's imports."""
    if language not in _COMMENTS:
        return []
    out = []
    for k, line in _shown(lines_of(text), language):
        if language == "rust":
            if m := _RUST_IMPORT.match(line):
                kind, spec = ("module" if m[1] == "mod" else "use"), m[2].strip()
                out.append((kind, spec, k, _rust_candidates(path, kind, spec)))
        elif language == "python":
            if m := _PYTHON_IMPORT.match(line):
                out.append(("python_from", m[1].strip(), k, _python_candidates(path, m[1].strip())))
        elif m := _TS_FROM.match(line) or _TS_BARE.match(line):
            out.append(("js_import", m[2], k, _ts_candidates(path, m[2])))
        elif m := _TS_REQUIRE.match(line):
            out.append(("require", m[2], k, _ts_candidates(path, m[2])))
    return out


_FACTS = "part string, snapshot_id string, relative_path string, language string, name string, kind string, line_number long, candidates array<string>"


def _extracted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.string()] * 6 + [pa.int64(), pa.list_(pa.string())]
    for batch in batches:
        rows: list[tuple] = []
        for snapshot, path, language, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows += [("symbol", snapshot, path, language, name, kind, line, None) for name, kind, line in symbols_of(language, text)]
            rows += [("import", snapshot, path, language, spec, kind, line, found) for kind, spec, line, found in imports_of(path, language, text)]
        if rows:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[x.split()[0] for x in _FACTS.split(", ")])


def extract(sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The symbols and imports tables of sources (snapshot_id, relative_path, language, text)."""
    known = sources.where(F.col("language").isin(*_COMMENTS) & F.col("text").isNotNull())
    facts = known.select("snapshot_id", "relative_path", "language", "text").mapInArrow(_extracted, _FACTS)
    symbols = facts.where("part = 'symbol'").select(
        "snapshot_id", symbol_fact_id("language", "relative_path", "line_number", "kind", "name").alias("fact_id"), "name", "kind", "relative_path", "language", "line_number", F.lit("lexical_confirmed").alias("evidence_class")
    )
    imports = facts.where("part = 'import'")
    fact = import_fact_id("language", "relative_path", "line_number", "kind", "name")
    imports = imports.select("snapshot_id", fact.alias("fact_id"), F.col("relative_path").alias("importer_path"), F.col("name").alias("import_spec"), "line_number", "language", "kind", "candidates")
    # the first candidate that is a file of the snapshot
    wanted = imports.select("snapshot_id", "fact_id", F.posexplode("candidates").alias("at", "relative_path"))
    there = wanted.join(sources.select("snapshot_id", "relative_path").distinct(), ["snapshot_id", "relative_path"])
    best = there.groupBy("snapshot_id", "fact_id").agg(F.min_by("relative_path", "at").alias("resolved_path"))
    imports = imports.drop("candidates").dropDuplicates(["snapshot_id", "fact_id"]).join(best, ["snapshot_id", "fact_id"], "left")
    return symbols.dropDuplicates(), imports.withColumn("evidence_class", F.lit("lexical_confirmed"))
