"""A full-text index that outlives a query: postings written once, documents by version, pins by fingerprint.

Below a root lie three kinds of Parquet tables. `postings/segment=N/bucket=B` has the postings of what version N added, by
bucket of the term and sorted by term inside its files; they are never changed. `documents/vN` lists the documents of
version N, each with the segment its postings are in; a posting counts only if its document's row names its segment, so
replacing or deleting a document rewrites no posting. `pins/vN` says at which version and fingerprint a snapshot was last
indexed. documents/vN is written last and is complete once its mark is there: until then readers see the version before,
and a write that failed or runs again puts the same files in the same place.

A search reads the buckets of its words in the segments of its version, nothing else of the postings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import query_tokens
from ..sources.store import versions
from .graph import cut
from .lexical import build_index, fingerprint, search, sync_plan

BUCKETS = 64
KEYS = ["snapshot_id", "relative_path"]
_POSTINGS = "term string, snapshot_id string, relative_path string, tf long, segment int, bucket int"
_DOCUMENTS = "snapshot_id string, relative_path string, content_hash string, length long, segment int"
_PINS = "snapshot_id string, fingerprint string, version int"


def bucket_of(term: Column | str) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def documents(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The documents of a version, the newest by default; none where nothing is indexed yet."""
    found = versions(spark, f"{root}/documents")
    at = (found[-1] if found else None) if version is None else version
    return spark.createDataFrame([], _DOCUMENTS) if at is None else spark.read.schema(_DOCUMENTS).parquet(f"{root}/documents/v{at}")


def postings(spark: SparkSession, root: str, buckets: list[int] | None = None, version: int | None = None) -> DataFrame:
    """Postings of a version's documents; buckets: of these alone."""
    found = versions(spark, f"{root}/documents")
    if not found:
        return spark.createDataFrame([], _POSTINGS).drop("bucket")
    at = found[-1] if version is None else version
    rows = spark.read.schema(_POSTINGS).parquet(f"{root}/postings").where(F.col("segment") <= at)
    if buckets is not None:
        rows = rows.where(F.col("bucket").isin(buckets))
    return rows.drop("bucket").join(documents(spark, root, at).select(*KEYS, "segment"), [*KEYS, "segment"], "left_semi")


def _written(root: str, number: int, fresh: DataFrame, kept: DataFrame) -> int:
    """Version `number`: what is kept, and fresh documents (snapshot_id, relative_path, content_hash, body) with their postings."""
    spark = fresh.sparkSession
    index = build_index(fresh.where("body is not null"))
    rows = index["postings"].withColumn("bucket", bucket_of("term"))
    # each task sorts and writes what its documents have, in a file for each bucket; `compact` brings them into ranges
    rows = rows.sortWithinPartitions("bucket", "term", *KEYS)
    rows.select("term", *KEYS, "tf", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/postings/segment={number}")
    made = fresh.select(*KEYS, "content_hash").join(index["lengths"], KEYS).withColumn("segment", F.lit(number))
    columns = [x.split()[0] for x in _DOCUMENTS.split(", ")]
    kept.select(*columns).unionByName(made.select(*columns)).write.mode("overwrite").parquet(f"{root}/documents/v{number}")
    return versions(spark, f"{root}/documents")[-1]


def _next(spark: SparkSession, root: str) -> int:
    found = versions(spark, f"{root}/documents")
    return found[-1] + 1 if found else 1


def sync(docs: DataFrame, root: str) -> int:
    """Brings the snapshots of docs (snapshot_id, relative_path, content_hash, body: all that each shall have) up to date in a
    new version: documents with another hash are indexed anew, others that docs lacks go, equal ones are not read again."""
    spark = docs.sparkSession
    old, number = documents(spark, root), _next(spark, root)
    mine = old.join(docs.select("snapshot_id").distinct(), "snapshot_id", "left_semi")
    plan = cut(sync_plan(mine, docs), "plan")
    fresh = docs.join(plan.where("action <> 'delete'"), KEYS, "left_semi")
    return _written(root, number, fresh, old.join(plan, KEYS, "left_anti"))


def apply_changes(changes: DataFrame, root: str, number: int) -> int:
    """Version `number` from the one before it and changes (snapshot_id, relative_path, content_hash, body): a null hash deletes,
    and a hash that the document has already is nothing new. Doing it again gives the same version."""
    spark = changes.sparkSession
    before = max((v for v in versions(spark, f"{root}/documents") if v < number), default=None)
    old = documents(spark, root, before) if before is not None else spark.createDataFrame([], _DOCUMENTS)
    same = changes.join(old.select(*KEYS, "content_hash"), [*KEYS, "content_hash"], "left_anti")
    changed = cut(same.select(*KEYS, "content_hash", "body"), "changed")
    return _written(root, number, changed.where("content_hash is not null"), old.join(changed, KEYS, "left_anti"))


def pins(spark: SparkSession, root: str) -> DataFrame:
    found = versions(spark, f"{root}/pins")
    return spark.read.schema(_PINS).parquet(f"{root}/pins/v{found[-1]}") if found else spark.createDataFrame([], _PINS)


def _pin(rows: DataFrame, root: str, gone: DataFrame) -> None:
    spark = rows.sparkSession
    found = versions(spark, f"{root}/pins")
    kept = pins(spark, root).join(gone.select("snapshot_id"), "snapshot_id", "left_anti")
    kept.unionByName(rows).write.mode("overwrite").parquet(f"{root}/pins/v{found[-1] + 1 if found else 1}")


def ensure(docs: DataFrame, root: str) -> tuple[int, bool]:
    """The version in which the snapshots of docs are as docs has them, and whether it had to be written for that: a snapshot
    whose fingerprint is pinned costs only the fingerprint."""
    spark = docs.sparkSession
    now = cut(fingerprint(docs), "fingerprints")
    held = now.join(pins(spark, root), ["snapshot_id", "fingerprint"])
    missing, version = now.join(held, "snapshot_id", "left_anti").isEmpty(), held.agg(F.max("version")).first()[0]
    if missing and version is not None:
        return version, False
    version = sync(docs, root)
    _pin(now.withColumn("version", F.lit(version)), root, now)
    return version, True


def invalidate(spark: SparkSession, root: str, snapshot: str) -> int:
    """A version without a snapshot's documents; its pin goes too, so that the next `ensure` indexes it anew."""
    rows = documents(spark, root)
    gone = spark.createDataFrame([(snapshot,)], "snapshot_id string")
    number = _written(root, _next(spark, root), rows.where("false").withColumn("body", F.lit("")), rows.where(F.col("snapshot_id") != snapshot))
    _pin(spark.createDataFrame([], _PINS), root, gone)
    return number


def compact(spark: SparkSession, root: str) -> int:
    """A version with the postings of all its documents in one segment, for fewer files after many small changes. Older
    versions keep theirs."""
    number, old = _next(spark, root), documents(spark, root)
    rows = postings(spark, root).drop("segment").withColumn("bucket", bucket_of("term"))
    # ranges of (bucket, term, document): a word that most documents have is many tasks' work
    rows = rows.repartitionByRange("bucket", "term", *KEYS).sortWithinPartitions("bucket", "term", *KEYS)
    rows.select("term", *KEYS, "tf", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/postings/segment={number}")
    old.withColumn("segment", F.lit(number)).write.mode("overwrite").parquet(f"{root}/documents/v{number}")
    return number


def search_stored(spark: SparkSession, root: str, queries: DataFrame, version: int | None = None, stats_by_snapshot: bool = False) -> DataFrame:
    """Hits as of `lexical.search`, from the stored index. The numbers of the queries' buckets, BUCKETS at most, are all that
    the driver sees."""
    words = queries.select(F.explode(query_tokens("text")).alias("term"))
    buckets = sorted(r.bucket for r in words.select(bucket_of("term").alias("bucket")).distinct().collect())
    index = {"postings": postings(spark, root, buckets, version), "lengths": documents(spark, root, version)}
    return search(index, queries, stats_by_snapshot, stored=True)


__all__ = ["apply_changes", "compact", "documents", "ensure", "invalidate", "pins", "postings", "search_stored", "sync"]
