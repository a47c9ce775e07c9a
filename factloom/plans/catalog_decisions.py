"""Queries over documents that tell of decisions, by what their texts say; SQL reads every text."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import decisions
from . import adapters as A
from .registry import Registry

add = Registry()
QUERIES, ORACLES = add.queries, add.oracles

_FOLDERS = ("docs/adr-", "docs/", "plans/", "research/spec-", "docs/decisions/", "", "src/docs/", "", "notes/", "")
MARKS = ("license", "copyright")


def _docs(spark, d):
    """Documents in folders of some worth, by their number."""
    folder = F.get(F.array(*[F.lit(x) for x in _FOLDERS]), (F.col("doc_id") % 10).cast("int"))
    doc = A.table(spark, d, "documents").where("doc_id is not null and source is not null")
    return doc.select("doc_id", "source", F.concat(folder, "source", F.lit("_doc_"), F.col("doc_id").cast("string"), F.lit(".md")).alias("relative_path"), F.lit("markdown").alias("language"), F.lit("md").alias("extension"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size_bytes"), F.coalesce("text", F.lit("")).alias("text"))


def _requests(docs, with_paths: bool):
    """One for each source, about its first and last paths."""
    some = lambda c: F.array(c) if with_paths else F.array().cast("array<string>")
    scope = F.when(F.length("source") % 2 == 0, "license").otherwise("copyright")
    return docs.groupBy("source").agg(F.min("relative_path").alias("a"), F.max("relative_path").alias("z")).select(F.col("source").alias("request_id"), scope.alias("scope"), some("a").alias("anchors"), some("z").alias("suggested"))


_MADE = f"""made AS (SELECT doc_id, source, ({list(_FOLDERS)!r})[doc_id % 10 + 1] || source || '_doc_' || doc_id || '.md' AS path, coalesce(text, '') AS text FROM documents WHERE doc_id IS NOT NULL AND source IS NOT NULL),
doc AS (SELECT *, lower(path) AS p, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t, octet_length(encode(text)) AS size,
  CASE WHEN contains(path, 'adr') THEN 40 ELSE 0 END + CASE WHEN contains(path, 'decision') THEN 25 ELSE 0 END + CASE WHEN contains(path, 'spec') THEN 10 ELSE 0 END + CASE WHEN starts_with(path, 'docs/') THEN 6 WHEN starts_with(path, 'plans/') THEN 5 WHEN starts_with(path, 'research/') THEN 4 ELSE 0 END AS prio FROM made)"""


def _request_sql(with_paths: bool) -> str:
    words = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^0-9a-z]'), lambda t: length(t) >= 3))"
    paths = f"{words.format('min(path)')} AS ta, {words.format('max(path)')} AS tz, min(path) AS a, max(path) AS z" if with_paths else "CAST([] AS VARCHAR[]) AS ta, CAST([] AS VARCHAR[]) AS tz"
    return f"req AS (SELECT source AS r, CASE WHEN length(source) % 2 = 0 THEN ['license'] ELSE ['copyright'] END AS ts, {paths} FROM made GROUP BY source)"


_HELD = lambda x, points: " + ".join(f"{n} * len(list_filter({c}, lambda w: contains({x}, w)))" for c, n in zip(("ts", "ta", "tz"), points, strict=True))


@add(
    f"""SELECT r AS request_id, path AS relative_path, CAST(score AS INTEGER) AS score, place, true AS fewer FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, path) AS place FROM (
  SELECT r, path, prio + {_HELD("t", (25, 10, 6))} AS score FROM req, doc WHERE size <= 262144 AND contains(text, ' '))) WHERE place <= 4""",
    (_MADE, _request_sql(False)),
)
def f8_best_by_content(spark, d):
    """The four best documents of each request by path and text; fewer texts are read than there are, as a level of paths
    that cannot win is left alone."""
    docs = _docs(spark, d)
    found = decisions.best_by_content(_requests(docs, False), docs, 4, (" ",))
    return found.select("request_id", "relative_path", "score", "place", (F.col("texts_read") < F.lit(docs.count())).alias("fewer"))


_CANDIDATES = f"""cand AS (
  SELECT source AS r, path, 0 AS rank, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS nth FROM made WHERE doc_id % 7 = 0 QUALIFY nth <= 8
  UNION ALL SELECT r, a, 1, 0 FROM req UNION ALL SELECT r, z, 2, 0 FROM req
  UNION ALL SELECT r, path, 3, -(prio + {_HELD("p", (8, 5, 3))}) FROM req, doc WHERE size <= 262144 AND (prio >= 10 OR {_HELD("p", (8, 5, 3))} > 0)
), ordered AS (SELECT r, path, row_number() OVER (PARTITION BY r ORDER BY first_at) AS place FROM (SELECT r, path, min((rank, nth, path)) AS first_at FROM cand GROUP BY r, path) QUALIFY place <= 96)"""


@add("SELECT r AS request_id, path AS relative_path, place FROM ordered", (_MADE, _request_sql(True), _CANDIDATES))
def f9_candidate_paths(spark, d):
    """What is looked at for each source, in order: some hits, its first and last paths, and then by what paths say."""
    docs = _docs(spark, d)
    asked = _requests(docs, True)
    return decisions.candidate_paths(asked, docs, _found(docs), decisions.term_sets(asked), 96)


def _found(docs):
    """Every seventh document of a source taken for hits of full text, the first eight."""
    place = F.row_number().over(W.partitionBy("source").orderBy("doc_id"))
    return docs.where("doc_id % 7 = 0").select(F.col("source").alias("request_id"), "relative_path", place.alias("place")).where("place <= 8")


_SCANNED = f"""looked AS (
  SELECT o.r, o.place, o.path, coalesce(size <= 262144 AND (contains(t, 'license') OR contains(t, 'copyright')), false) AS hit, prio + {_HELD("t", (25, 10, 6))} AS score FROM ordered o JOIN req USING (r) LEFT JOIN doc ON doc.path = o.path
), counted AS (SELECT *, coalesce(sum(hit::INT) OVER b, 0) AS hits, coalesce(max(CASE WHEN hit THEN place END) OVER b, 0) AS last FROM looked WINDOW b AS (PARTITION BY r ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), stopped AS (SELECT *, coalesce(bool_or(hits >= 6 OR (hits >= 4 AND place - 1 - last >= 6)) OVER (PARTITION BY r ORDER BY place), false) AS stop FROM counted)"""


@add(
    "SELECT r AS request_id, path AS relative_path, CAST(score AS INTEGER) AS score, n AS place FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, path) AS n FROM stopped WHERE hit AND NOT stop) WHERE n <= 4",
    (_MADE, _request_sql(True), _CANDIDATES, _SCANNED),
)
def f8_f10_scanned_decisions(spark, d):
    """The best marked documents among the candidates of each source, which are looked at until enough are found."""
    docs = _docs(spark, d)
    return decisions.scanned_decisions(_requests(docs, True), docs, _found(docs), 4, MARKS).select("request_id", "relative_path", "score", "place")


@add(
    f"""SELECT source AS request_id, path AS relative_path, contains(t, 'license') OR contains(t, 'copyright') AS marked, len(list_filter(ts, lambda w: contains(t, w))) AS scope, len(list_filter(ta, lambda w: contains(t, w))) AS anchor, len(list_filter(tz, lambda w: contains(t, w))) AS suggested
FROM doc JOIN req ON r = source""",
    (_MADE, _request_sql(True)),
)
def e18_content_profiles(spark, d):
    """What every document says to the request of its source: whether it is marked, and how many terms of each kind it has."""
    docs = _docs(spark, d)
    asked = _requests(docs, True)
    each = docs.select(F.col("source").alias("request_id"), "relative_path")
    return decisions.content_profile(each, docs, decisions.term_sets(asked), MARKS).select("request_id", "relative_path", "marked", "scope", "anchor", "suggested")
