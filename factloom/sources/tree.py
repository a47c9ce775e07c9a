"""A source tree on a mounted folder as a data source: `spark.read.format("source_tree").load(root)`.

The folders below the root are listed on the cluster: the driver opens only the top of the tree, until it has a folder or
more for every part, and a part walks its folders. What a scan leaves out is not opened at all, empty files are rows like
others, and a condition on the path (equal, or begins with) opens only the folders on its way. Rows: relative_path,
size_bytes, content; a file that goes meanwhile is left out, links are not followed.
"""

from __future__ import annotations

import json
import os
import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# What a scan leaves out.
EXCLUDED_FOLDERS = (".git", ".idea", ".mypy_cache", ".pytest_cache", ".ruff_cache", ".venv", ".vscode", "__pycache__", "build", "dist", "node_modules", "out", "target")
EXCLUDED_EXTENSIONS = ("bin", "class", "dll", "dylib", "exe", "gif", "gz", "ico", "jpeg", "jpg", "pdf", "png", "so", "tar", "zip")
EXCLUDED_PREFIX = ".env"
MAX_BYTES = 2_097_152

#: Parts of a tree, and bytes of contents in a batch.
PARTS, BATCH_BYTES = 64, 4 << 20
SCHEMA = pa.schema([("relative_path", pa.string()), ("size_bytes", pa.int64()), ("content", pa.binary())])


def local_path(path: str) -> str:
    """A path without the scheme of files; a store that is not mounted has none."""
    if re.match(r"(?!file:)[A-Za-z][A-Za-z0-9+.-]+:", path):
        raise ValueError(f"{path} is not on a mounted folder")
    return re.sub("^file:/+", "/", path).rstrip("/") or "/"


def extension_of(name: str) -> str:
    found = re.search(r"[^/]\.([^./]*)$", name)
    return found[1].lower() if found else ""


def takes(name: str, size: int) -> bool:
    """Whether a scan takes a file of that name and size."""
    return not name.startswith(EXCLUDED_PREFIX) and extension_of(name) not in EXCLUDED_EXTENSIONS and size <= MAX_BYTES


@dataclass
class TreePart(InputPartition):
    """Folders to walk, and single files."""

    folders: list[str]
    files: list[str]


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = local_path(options["path"])
        self.parts = int(options.get("parts", PARTS))
        self.excluded = {*EXCLUDED_FOLDERS, *json.loads(options.get("more_folders", "[]"))}
        self.prefix = options.get("prefix", "")

    def _leads_on(self, folder: str) -> bool:
        """Whether files that are asked for may lie in a folder (relative, with a slash at its end)."""
        return self.prefix.startswith(folder) or folder.startswith(self.prefix)

    def _entries(self, folder: str) -> tuple[list[str], list[tuple[str, int]]]:
        """Folders and files of a folder that are to be read; paths are relative."""
        folders, files = [], []
        try:
            with os.scandir(os.path.join(self.root, folder)) as found:
                for e in found:
                    path = f"{folder}{e.name}"
                    if e.is_dir(follow_symlinks=False):
                        if e.name not in self.excluded and self._leads_on(f"{path}/"):
                            folders.append(f"{path}/")
                    elif e.is_file(follow_symlinks=False) and path.startswith(self.prefix):
                        size = e.stat(follow_symlinks=False).st_size
                        if takes(e.name, size):
                            files.append((path, size))
        except FileNotFoundError:
            if not folder:
                raise
        return folders, files

    def partitions(self) -> list[TreePart]:
        folders, files = deque([""]), []
        while folders and len(folders) < self.parts:
            more, found = self._entries(folders.popleft())
            folders.extend(more)
            files += [path for path, _ in found]
        parts = [TreePart([], []) for _ in range(max(1, min(self.parts, len(folders) + len(files))))]
        for k, folder in enumerate(sorted(folders)):
            parts[k % len(parts)].folders.append(folder)
        for k, path in enumerate(sorted(files)):
            parts[k % len(parts)].files.append(path)
        return parts

    def read(self, part: TreePart) -> Iterator[pa.RecordBatch]:
        rows: list[tuple[str, int, bytes]] = []
        held = 0
        waiting = list(part.folders)
        done = lambda: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SCHEMA.types, strict=True)], schema=SCHEMA)
        files = iter(part.files)
        while True:
            path = next(files, None)
            if path is None:
                if not waiting:
                    break
                more, found = self._entries(waiting.pop())
                waiting += more
                files = iter([p for p, _ in found])
                continue
            try:
                with open(os.path.join(self.root, path), "rb") as f:
                    content = f.read(MAX_BYTES + 1)
            except FileNotFoundError:
                continue
            if len(content) > MAX_BYTES:  # it grew after it was listed
                continue
            rows.append((path, len(content), content))
            held += len(content)
            if held >= BATCH_BYTES:
                yield done()
                rows, held = [], 0
        if rows:
            yield done()


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return "relative_path string, size_bytes long, content binary"

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)


def read(spark: SparkSession, root: str, more_folders: tuple[str, ...] = (), prefix: str = "", parts: int = PARTS) -> DataFrame:
    """relative_path, size_bytes and content of the files that a scan takes; prefix: of those whose path begins with it."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("source_tree").option("more_folders", json.dumps(more_folders)).option("prefix", prefix).option("parts", parts).load(root)
