"""A source tree as fact tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, fnv1a
from . import manifests, tree
from .extract import extract
from .tree import EXCLUDED_EXTENSIONS, EXCLUDED_FOLDERS, EXCLUDED_PREFIX, MAX_BYTES

# Languages by extension.
LANGUAGES = {"js": "javascript", "jsx": "javascript", "json": "json", "md": "markdown", "py": "python", "rs": "rust", "toml": "toml", "ts": "typescript", "tsx": "typescript", "yaml": "yaml", "yml": "yaml"}


def extension(path: Column | str) -> Column:
    """In lower case; null if there is none. A dot that leads a name begins none."""
    found = ascii_lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))
    return F.when(found != "", found)


def language(ext: Column | str) -> Column:
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(table, F.col(ext) if isinstance(ext, str) else ext)


def included(path: Column | str, size: Column | str, more_folders: tuple[str, ...] = ()) -> Column:
    """Folders match whole names, case counting; extensions do not count case; files over the limit stay out."""
    path, size = (F.col(c) if isinstance(c, str) else c for c in (path, size))
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    name = F.element_at(parts, -1)
    bad = F.arrays_overlap(folders, F.array(*[F.lit(x) for x in (*EXCLUDED_FOLDERS, *more_folders)])) | F.startswith(name, F.lit(EXCLUDED_PREFIX))
    return ~bad & ~F.coalesce(extension(path), F.lit("")).isin(*EXCLUDED_EXTENSIONS) & (size <= MAX_BYTES)


def empty_files(spark: SparkSession, root: str) -> list[tuple[str, int, bytes]]:
    """Files without a byte, which the reader of binary files leaves out: from the listing, which the driver has to make
    for the reader as well."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    listing = place.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(place, True)
    out = []
    while listing.hasNext():
        status = listing.next()
        if status.getLen() == 0:
            out.append((status.getPath().toString(), 0, b""))
    return out


def read_tree(spark: SparkSession, root: str, snapshot_id: str, more_folders: tuple[str, ...] = ()) -> DataFrame:
    """Files below root with their bytes: a mounted folder by the source of trees, other stores by Spark's reader of binary
    files, whose listing is filtered by size and path before contents are read."""
    place = spark._jvm.org.apache.hadoop.fs.Path(root)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme() == "file":
        return tree.read(spark, root, more_folders).select(F.lit(snapshot_id).alias("snapshot_id"), "relative_path", "size_bytes", "content")
    base = place.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(place).toString().rstrip("/")
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    relative = F.substring(plain(F.col("path")), F.length(plain(F.lit(base))) + 2, F.length("path"))
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    raw = listed.where(F.col("length") <= MAX_BYTES).where(included(relative, "length", more_folders)).select("path", "length", "content")
    raw = raw.union(spark.createDataFrame(empty_files(spark, root), "path string, length long, content binary"))
    rows = raw.select(F.lit(snapshot_id).alias("snapshot_id"), relative.alias("relative_path"), F.col("length").alias("size_bytes"), "content")
    return rows.where(included("relative_path", "size_bytes", more_folders))


def scan(spark: SparkSession, root: str, snapshot_id: str, more_folders: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """files, symbols, imports and verification targets of a tree. Files that are no UTF-8 have no text and no facts."""
    return facts_of(read_tree(spark, root, snapshot_id, more_folders))


def facts_of(rows: DataFrame) -> dict[str, DataFrame]:
    """The same of rows (snapshot_id, relative_path, size_bytes, content), whatever store they come from."""
    rows = rows.withColumn("extension", extension("relative_path")).withColumn("language", language("extension"))
    rows = rows.withColumn("text", F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")))
    files = rows.select("snapshot_id", "relative_path", "extension", "language", "size_bytes", fnv1a(F.col("content").cast("binary").cast("string")).alias("content_hash"))
    sources = rows.select("snapshot_id", "relative_path", "language", "text")
    symbols, imports = extract(sources)
    return {"files": files, "symbols": symbols, "imports": imports, "verification_targets": manifests.verification_targets(sources), "texts": sources}
