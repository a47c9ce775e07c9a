"""Full-text retrieval: an index of three tables (postings, lengths, statistics) and BM25 over it.

All query words must occur. Statistics cover every indexed snapshot by default, as one store holds them all; with
stats_by_snapshot each snapshot has its own.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import query_tokens, receipt_id
from .graph import cut
from .lookup import scope_filter

K1, B = 1.2, 0.75


def _folding() -> tuple[str, str]:
    """Letters with marks and what they are without, by the rule of canonical decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_MARKED, _PLAIN = _folding()


def body(path: Column | str, text: Column | str) -> Column:
    """A document: its path, so that parts of it can be found, and its text."""
    return F.concat_ws("\n", path, text)


def index_terms(text: Column | str) -> Column:
    """Words of letters and digits of any script, in lower case and without marks."""
    plain = F.translate(F.lower(F.col(text) if isinstance(text, str) else text), _MARKED, _PLAIN)
    return F.array_remove(F.split(plain, r"[^\p{L}\p{N}]+"), "")


#: Text, in bytes, whose words one task counts.
TASK_BYTES = 32 << 20


def build_index(docs: DataFrame) -> dict[str, DataFrame]:
    """Postings (snapshot_id, relative_path, term, tf) and lengths of docs (snapshot_id, relative_path, body).

    Texts are brought together by document, a bounded number of bytes for each task, and words are counted where their text
    is: no word is shuffled. Lengths are written once.
    """
    terms = index_terms("body").alias("terms")
    sized = cut(docs.select("snapshot_id", "relative_path", F.size(terms).cast("long").alias("length"), F.octet_length("body").cast("long").alias("bytes")), "lengths")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(sized.agg(F.sum("bytes")).first()[0] or 0) // TASK_BYTES))
    # by path alone: a constant snapshot_id is taken out of what is grouped by, and then rows would be shuffled again
    own = docs.select("snapshot_id", "relative_path", "body").repartition(tasks, "relative_path").select("snapshot_id", "relative_path", terms)
    postings = own.select("snapshot_id", "relative_path", F.explode("terms").alias("term")).groupBy("snapshot_id", "relative_path", "term").agg(F.count("*").alias("tf"))
    return {"postings": postings, "lengths": sized.drop("bytes")}


def search(index: dict[str, DataFrame], queries: DataFrame, stats_by_snapshot: bool = False, stored: bool = False) -> DataFrame:
    """Hits of queries (request_id, text, scope, limit; limit 0: all): bm25 (higher is better), score and place.

    score is what a store makes of a negative rank, always 1; the order is that of bm25, then path. The query's words are
    joined to the postings, so that only their lists are counted and, unless they are stored, written, once; statistics are one row, or one for each
    snapshot.
    """
    keys = ["snapshot_id"] if stats_by_snapshot else []
    stats = index["lengths"].groupBy(*keys).agg(F.count("*").alias("n"), F.avg("length").alias("mean"))
    asked = queries.select("request_id", F.coalesce("scope", F.lit("")).alias("scope"), F.col("limit"), query_tokens("text").alias("tokens"))
    words = asked.select("request_id", F.size("tokens").alias("words"), F.explode("tokens").alias("term"))
    # written, so that their size is known: where they fit, they go to every task and leave out other words before these are counted
    few = cut(words.select("term").distinct(), "words")
    listed = index["postings"].join(few, "term", "left_semi")
    listed = listed if stored else cut(listed, "listed")
    spread = listed.groupBy("term", *keys).agg(F.count("*").alias("df"))
    found = words.join(listed, "term").join(spread, ["term", *keys]).join(index["lengths"], ["snapshot_id", "relative_path"])
    found = found.join(stats, keys) if keys else found.join(F.broadcast(stats))  # one row
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    hits = found.groupBy("request_id", "snapshot_id", "relative_path").agg(F.sum(part).alias("bm25"), F.count("*").alias("met"), F.first("words").alias("words")).where("met = words")
    hits = hits.join(asked.select("request_id", "scope", "limit"), "request_id").where((F.col("scope") == "") | scope_filter("relative_path", "scope"))
    # sums of doubles differ in their last digits with the order of addition; ties are ties to 9 places
    place = F.row_number().over(W.partitionBy("request_id", "snapshot_id").orderBy(F.round("bm25", 9).desc(), "relative_path"))
    hits = hits.withColumn("place", place).where((F.col("limit") == 0) | (F.col("place") <= F.col("limit")))
    return hits.select("request_id", "snapshot_id", "relative_path", "bm25", score_from_rank(-F.col("bm25")).alias("score"), "place")


def score_from_rank(rank: Column) -> Column:
    return F.when((rank <= 0) | F.isnan(rank) | (F.abs(rank) == float("inf")), F.lit(1.0)).otherwise(1 / (1 + rank))


def fingerprint(files: DataFrame) -> DataFrame:
    """One value for each snapshot that changes with any path or content: a sum of row hashes, which adds up in any order
    and on the map side, and the number of rows."""
    digits = F.substring(F.md5(F.concat_ws("\0", "relative_path", "content_hash").cast("binary")), 1, 15)
    total = F.sum(F.conv(digits, 16, 10).cast("decimal(38,0)")).cast("string")
    return files.groupBy("snapshot_id").agg(F.sha2(F.concat_ws(":", "snapshot_id", F.count("*").cast("string"), total), 256).alias("fingerprint"))


def sync_plan(indexed: DataFrame, desired: DataFrame) -> DataFrame:
    """What has to be done for an index: insert, replace or delete by (snapshot_id, relative_path); unchanged rows are left out."""
    old = indexed.select("snapshot_id", "relative_path", F.col("content_hash").alias("old"))
    new = desired.select("snapshot_id", "relative_path", F.col("content_hash").alias("new"))
    both = old.join(new, ["snapshot_id", "relative_path"], "full")
    action = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), "delete").when(F.col("old") != F.col("new"), "replace")
    return both.select("snapshot_id", "relative_path", action.alias("action")).where("action is not null")


def apply_sync(index: dict[str, DataFrame], docs: DataFrame, plan: DataFrame) -> dict[str, DataFrame]:
    """The index after the plan: rows of changed documents go, those of inserted and replaced ones are made anew."""
    keys = ["snapshot_id", "relative_path"]
    fresh = build_index(docs.join(plan.where("action <> 'delete'"), keys, "left_semi"))
    return {name: part.join(plan, keys, "left_anti").unionByName(fresh[name]) for name, part in index.items()}


def invalidate(index: dict[str, DataFrame], snapshot: str) -> dict[str, DataFrame]:
    return {name: part.where(F.col("snapshot_id") != snapshot) for name, part in index.items()}


def merge_hits(a: DataFrame, b: DataFrame, limit: int) -> DataFrame:
    """Hits (request_id, relative_path, score) of both, the best score of each path; order: score, then path; 0: all."""
    both = a.select("request_id", "relative_path", "score").union(b.select("request_id", "relative_path", "score"))
    best = both.groupBy("request_id", "relative_path").agg(F.max("score").alias("score"))
    best = best.withColumn("place", F.row_number().over(W.partitionBy("request_id").orderBy(F.col("score").desc(), "relative_path")))
    return best.where(F.col("place") <= limit) if limit else best


def hit_receipts(hits: DataFrame) -> DataFrame:
    return hits.select("request_id", receipt_id("lexical_hit", "relative_path").alias("id"), F.lit("lexical_hit").alias("source_type"), F.col("relative_path").alias("source_ref"), F.lit("fts").alias("locator"))


