"""Ranking of documents that tell of decisions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import ascii_lower, camel_terms, col, compact_snippet, contains_any, text_terms, title_from_path
from .graph import cut
from .lookup import BRIEF_MARKERS, DECISION_MARKERS, has_marker, looks_like_decision_doc

MAX_BYTES = 256 * 1024
#: Terms of an automaton that goes to every task.
MAX_TERMS = 200_000

# What parts of a path are worth, and the folders that it may begin with.
PATH_POINTS = (("adr", 40), ("decision", 25))
FOLDER_POINTS = (("docs/", 6), ("plans/", 5), ("research/", 4))
# How many hits of full text are candidates, how many candidates are looked at for each result, and how many
# in a row may miss once there are results enough.
MAX_LEXICAL, SCAN_BUDGET, MISSES = 64, 24, 6
NO_SNIPPET = "decision context is documented in this file"


def path_priority(path: Column | str) -> Column:
    lower = ascii_lower(path)
    out = F.when(contains_any(lower, ("intent", "spec")), 10).otherwise(0)
    for word, points in PATH_POINTS:
        out = out + F.when(F.contains(lower, F.lit(word)), points).otherwise(0)
    for folder, points in FOLDER_POINTS:
        out = out + F.when(F.startswith(lower, F.lit(folder)), points).otherwise(0)
    return out


def overlap(text: Column | str, terms: Column | str) -> Column:
    """How many of the terms a text holds."""
    text = col(text)
    return F.size(F.filter(col(terms), lambda t: F.contains(text, t)))


def seed_score(path: Column | str, scope_terms: Column, anchor_terms: Column, suggested_terms: Column) -> Column:
    lower = ascii_lower(path)
    return path_priority(path) + 8 * overlap(lower, scope_terms) + 5 * overlap(lower, anchor_terms) + 3 * overlap(lower, suggested_terms)


def doc_score(path: Column | str, scope_hits: Column, anchor_hits: Column, suggested_hits: Column) -> Column:
    return path_priority(path) + 25 * scope_hits + 10 * anchor_hits + 6 * suggested_hits


def keeps_fallback(path: Column | str, *terms: Column) -> Column:
    lower, out = ascii_lower(path), path_priority(path) >= 10
    for t in terms:
        out = out | (overlap(lower, t) > 0)
    return out


def scan_documents(docs: DataFrame, markers=DECISION_MARKERS) -> DataFrame:
    """For each document (relative_path, text): whether a line has a marker, its title, and the first such line.

    Higher-order functions over the text's lines: nothing is exploded or shuffled.
    """
    lines = F.split(F.coalesce("text", F.lit("")), r"\r?\n")
    marked = F.filter(lines, lambda x: has_marker(x, markers))
    titles = F.filter(lines, lambda x: F.startswith(F.trim(x), F.lit("#")))
    title = F.trim(F.regexp_replace(F.get(titles, F.lit(0)), "^[# ]+", ""))
    return docs.select("relative_path", (F.size(marked) > 0).alias("marked"), F.coalesce(F.when(title != "", title), title_from_path("relative_path")).alias("title"), compact_snippet(F.get(marked, F.lit(0))).alias("snippet"))


def term_hits(docs: DataFrame, terms: DataFrame, columns: tuple[str, ...], most: int = MAX_TERMS) -> DataFrame:
    """(relative_path, column, term) for every term (a frame of one column) that a column of docs holds anywhere.

    Up to `most` different terms go to every task as one automaton, which reads a text once; more are joined in blocks of
    as many, each a pass over docs.
    """
    different = terms.where("term <> ''").distinct()
    blocks = max(1, -(-different.count() // most))
    types = "relative_path string, column string, term string"
    parts = []
    for k in range(blocks):
        some = different if blocks == 1 else different.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == k)
        words = [r.term for r in some.collect()]  # a block is at most about `most` terms

        def found(batches: Iterable[pa.RecordBatch], words: list[str] = words) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for word in words:
                automaton.add_word(word, word)
            automaton.make_automaton()
            for batch in batches:
                rows = []
                for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for name, text in zip(columns, values[1:], strict=True):
                        rows += [(values[0], name, word) for word in {word for _, word in automaton.iter(text or "")}]
                if rows:
                    yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=["relative_path", "column", "term"])

        if words:
            parts.append(docs.select("relative_path", *columns).mapInArrow(found, types))
    out = parts[0] if parts else docs.sparkSession.createDataFrame([], types)
    for x in parts[1:]:
        out = out.union(x)
    return out


def rank_documents(requests: DataFrame, docs: DataFrame, impacted: DataFrame, limit: int = 4, markers=DECISION_MARKERS) -> DataFrame:
    """The best decision documents of each request (request_id, target), by score and path.

    docs: relative_path, language, extension, size_bytes, text. Points: what the path says, the target in path and text,
    terms of impacted paths in path and text; only documents with a marker count. A request's candidates are the documents
    that hold one of its terms, and the `limit` best by what their paths say: any other stands behind those.
    """
    good = docs.where(looks_like_decision_doc("relative_path", "language", "extension") & (F.col("size_bytes") <= MAX_BYTES) & has_marker("text", markers))
    points = F.when(F.contains("p", F.lit("adr")), 40).otherwise(0) + F.when(F.contains("p", F.lit("decision")), 30).otherwise(0)
    good = cut(good.select("relative_path", ascii_lower("relative_path").alias("p"), ascii_lower("text").alias("t")).withColumn("base", points), "decisions")
    asked = requests.select("request_id", ascii_lower("target").alias("term"))
    worth = impacted.select("request_id", F.explode(text_terms("relative_path")).alias("term")).distinct().withColumn("of_p", F.lit(6)).withColumn("of_t", F.lit(4))
    worth = cut(worth.union(asked.where("term <> ''").withColumn("of_p", F.lit(24)).withColumn("of_t", F.lit(18))), "terms")
    hits = cut(term_hits(good, worth.select("term"), ("p", "t")), "hits")
    gained = hits.join(worth, "term").groupBy("request_id", "relative_path").agg(F.sum(F.when(F.col("column") == "p", F.col("of_p")).otherwise(F.col("of_t"))).alias("gained"))
    # an empty target is in every path, and counts there alone
    always = asked.select("request_id", F.when(F.coalesce("term", F.lit("x")) == "", 24).otherwise(0).alias("always")).distinct()
    first = good.orderBy(F.desc("base"), "relative_path").limit(limit).select("relative_path")
    near = requests.select("request_id").distinct().join(F.broadcast(first)).withColumn("gained", F.lit(0).cast("long"))  # `limit` rows
    both = gained.unionByName(near).groupBy("request_id", "relative_path").agg(F.sum("gained").alias("gained"))
    ranked = both.join(good.select("relative_path", "base"), "relative_path").join(always, "request_id")
    ranked = ranked.select("request_id", "relative_path", (F.col("base") + F.col("gained") + F.col("always")).cast("int").alias("score"))
    place = F.row_number().over(W.partitionBy("request_id").orderBy(F.desc("score"), "relative_path"))
    return ranked.withColumn("place", place).where(F.col("place") <= limit)


def fast_candidates(anchors: DataFrame, suggested: DataFrame, files: DataFrame, baseline: int = 64, limit: int = 4) -> DataFrame:
    """Candidates by path alone: anchors and suggested files that look like decision documents (4 points more) and the
    best `baseline` paths of all; the best score of each path, ordered by score and path."""
    docs = files.where(looks_like_decision_doc("relative_path", "language", "extension") & (F.col("size_bytes") <= MAX_BYTES)).select("relative_path", path_priority("relative_path").alias("score"))
    best = docs.orderBy(F.desc("score"), "relative_path").limit(baseline)
    near = anchors.select("request_id", "relative_path").union(suggested.select("request_id", "relative_path")).distinct()
    near = near.join(docs, "relative_path").select("request_id", "relative_path", (F.col("score") + 4).alias("score"))
    base = near.select("request_id").union(anchors.select("request_id")).distinct().join(F.broadcast(best))  # `baseline` rows
    both = near.union(base.select("request_id", "relative_path", "score")).groupBy("request_id", "relative_path").agg(F.max("score").alias("score"))
    place = F.row_number().over(W.partitionBy("request_id").orderBy(F.desc("score"), "relative_path"))
    return both.withColumn("place", place).where(F.col("place") <= limit)


def cut_off(scored: DataFrame, limit: int) -> DataFrame:
    """The early stop of a scan over candidates in order (request_id, place, hit): at most 24 * limit are looked at; it stops
    at 1.5 * limit hits, or at limit hits once six in a row missed. Running counts by a window instead of a loop."""
    w = W.partitionBy("request_id").orderBy("place")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    hit = F.when(F.col("hit"), 1).otherwise(0)
    rows = scored.where(F.col("place") <= SCAN_BUDGET * limit).withColumn("hits", F.coalesce(F.sum(hit).over(before), F.lit(0)))
    last = F.coalesce(F.max(F.when(F.col("hit"), F.col("place"))).over(before), F.lit(0))
    stop = (F.col("hits") >= F.floor(F.lit(limit * 1.5))) | ((F.col("hits") >= limit) & (F.col("place") - 1 - last >= MISSES))
    rows = rows.withColumn("stopped", F.max(stop.cast("int")).over(w))
    return rows.where("stopped = 0 and hit").select("request_id", "place")




# --- by content ------------------------------------------------------------------------------------------------------

KINDS = ("scope", "anchor", "suggested")
# What a term of each kind is worth in a text, and in a path.
TEXT_POINTS, SEED_POINTS = (25, 10, 6), (8, 5, 3)


def term_sets(requests: DataFrame) -> DataFrame:
    """(request_id, kind, term) of requests (request_id, scope, anchors, suggested): words of the scope and parts of its camel
    case, and words of the paths."""
    paths = lambda c: F.array_distinct(F.flatten(F.transform(F.coalesce(c, F.array().cast("array<string>")), text_terms)))
    scope = F.array_union(text_terms(F.coalesce("scope", F.lit(""))), camel_terms(F.coalesce("scope", F.lit(""))))
    sets = F.array(*[F.struct(F.lit(kind).alias("kind"), terms.alias("terms")) for kind, terms in zip(KINDS, (scope, paths("anchors"), paths("suggested")), strict=True)])
    rows = requests.select("request_id", F.explode(sets).alias("x")).select("request_id", "x.kind", F.explode("x.terms").alias("term"))
    return rows.where("term <> ''").distinct()


def _hits(docs: DataFrame, terms: DataFrame, column: str) -> DataFrame:
    """(request_id, relative_path, scope, anchor, suggested): how many of a request's terms of each kind the column holds; only
    documents with any."""
    found = term_hits(docs, terms.select("term"), (column,)).select("relative_path", "term").join(terms, "term")
    return found.groupBy("request_id", "relative_path").agg(*[F.count_if(F.col("kind") == kind).alias(kind) for kind in KINDS])


def _with_held(docs: DataFrame, terms: DataFrame, column: str, most: int = MAX_TERMS) -> DataFrame:
    """docs (strings and numbers) with `held`, the different terms (a frame of one column) that the column holds, sorted.

    As `term_hits`, but a row stays one row: blocks of terms are passes in the same task, and nothing is shuffled.
    """
    different = terms.where("term <> ''").distinct()
    blocks = max(1, -(-different.count() // most))
    out = docs.withColumn("held", F.array().cast("array<string>"))
    at = docs.columns.index(column)
    for k in range(blocks):
        some = different if blocks == 1 else different.where(F.pmod(F.xxhash64("term"), F.lit(blocks)) == k)
        words = [r.term for r in some.collect()]  # a block is at most about `most` terms

        def found(batches: Iterable[pa.RecordBatch], words: list[str] = words) -> Iterator[pa.RecordBatch]:
            import ahocorasick

            automaton = ahocorasick.Automaton()
            for word in words:
                automaton.add_word(word, word)
            automaton.make_automaton()
            for batch in batches:
                held = [sorted({*old, *(word for _, word in automaton.iter(text or ""))}) for text, old in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(held, pa.list_(pa.string()))], names=batch.schema.names)

        if words:
            out = out.mapInArrow(found, out.schema)
    return out


def _first_held(docs: DataFrame, terms: DataFrame, column: str, points: tuple[int, ...], most: int) -> tuple[DataFrame, DataFrame]:
    """Of docs (relative_path, priority, column) those that can be among a request's first `most` by worth and path: near
    (relative_path, priority), and met (request_id, relative_path, worth, priority) where a term of the request is held.

    Paths of one priority that hold the same terms are worth the same to every request, so of these the first `most` are
    enough. Each task leaves out the others before anything is shuffled, and what meets the requests does not grow with docs.
    """
    own = _with_held(docs.select("relative_path", "priority", column), terms, column).drop(column)
    place = F.dense_rank().over(W.partitionBy("priority", "held").orderBy("relative_path"))
    near = cut(own.withColumn("place", place).where(F.col("place") <= most).drop("place").distinct(), "near")
    each = near.select("held").distinct().select("held", F.explode("held").alias("term")).join(terms, "term")
    worth = sum((F.count_if(F.col("kind") == kind) * n for kind, n in zip(KINDS, points, strict=True)), F.lit(0))
    met = each.groupBy("request_id", "held").agg(worth.alias("worth")).join(near, "held").groupBy("request_id", "relative_path", "priority").agg(F.max("worth").alias("worth"))
    place = F.row_number().over(W.partitionBy("request_id").orderBy(F.desc(F.col("worth") + F.col("priority")), "relative_path"))
    return near.select("relative_path", "priority").distinct(), met.withColumn("place", place).where(F.col("place") <= most).drop("place")


def _worth(points: tuple[int, ...]) -> Column:
    return sum((F.col(kind) * n for kind, n in zip(KINDS[1:], points[1:], strict=True)), F.col(KINDS[0]) * points[0])


def _decision_docs(docs: DataFrame) -> DataFrame:
    return docs.where(looks_like_decision_doc("relative_path", "language", "extension") & (F.col("size_bytes") <= MAX_BYTES))


def candidate_paths(requests: DataFrame, docs: DataFrame, hits: DataFrame, terms: DataFrame, most: int) -> DataFrame:
    """(request_id, relative_path, place): what is looked at for each request (request_id, scope, anchors, suggested), in
    order and the first `most`: hits of full text (request_id, relative_path, place), anchors, suggested files, and then
    decision documents whose path is worth 10 or holds a term, by what their path is worth.

    Paths are met by their terms; of those worth 10 without a term the best `most` can be among the first, and no others.
    """
    lists = [requests.select("request_id", F.posexplode(F.array_sort(F.array_distinct("anchors")) if name == "anchors" else F.col(name)).alias("nth", "relative_path"), F.lit(rank).alias("rank")) for rank, name in ((1, "anchors"), (2, "suggested"))]
    first = hits.where(F.col("place") <= MAX_LEXICAL).select("request_id", F.col("place").alias("nth"), "relative_path", F.lit(0).alias("rank"))
    named = first.unionByName(lists[0]).unionByName(lists[1]).withColumn("relative_path", F.translate("relative_path", "\\", "/"))
    own = _decision_docs(docs).select("relative_path", ascii_lower("relative_path").alias("lower"), path_priority("relative_path").alias("priority"))
    near, met = _first_held(own, terms, "lower", SEED_POINTS, most)
    strong = near.where("priority >= 10").orderBy(F.desc("priority"), "relative_path").limit(most)
    always = requests.select("request_id").distinct().join(F.broadcast(strong))  # `most` rows
    rest = met.unionByName(always.withColumn("worth", F.lit(0))).groupBy("request_id", "relative_path", "priority").agg(F.max("worth").alias("worth"))
    rest = rest.select("request_id", (-(F.col("worth") + F.col("priority"))).cast("int").alias("nth"), "relative_path", F.lit(3).alias("rank"))
    order = F.min(F.struct("rank", "nth", "relative_path"))
    each = named.unionByName(rest).groupBy("request_id", "relative_path").agg(order.alias("at"))
    place = F.row_number().over(W.partitionBy("request_id").orderBy("at"))
    return each.withColumn("place", place).where(F.col("place") <= most).select("request_id", "relative_path", "place")


def content_profile(candidates: DataFrame, docs: DataFrame, terms: DataFrame, markers=BRIEF_MARKERS) -> DataFrame:
    """For candidates (request_id, relative_path, ...): marked, title, snippet, and the terms of each kind that the text holds.

    A text is read once, however many requests look at it.
    """
    read = cut(docs.join(candidates.select("relative_path").distinct(), "relative_path", "left_semi").select("relative_path", "text"), "texts")
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), r"\r?\n"), F.trim)
    marked = F.filter(lines, lambda x: has_marker(x, markers))
    title = F.get(F.filter(lines, lambda x: F.startswith(x, F.lit("#")) & (F.length(x) > 1)), F.lit(0))
    shown = read.select("relative_path", (F.size(marked) > 0).alias("marked"), F.coalesce(title, "relative_path").alias("title"), F.coalesce(compact_snippet(F.translate(F.get(marked, F.lit(0)), "\t", " ")), F.lit(NO_SNIPPET)).alias("snippet"))
    held = _hits(read.select("relative_path", ascii_lower("text").alias("lower")), terms, "lower")
    out = candidates.join(shown, "relative_path").join(held, ["request_id", "relative_path"], "left")
    return out.withColumns({kind: F.coalesce(kind, F.lit(0)) for kind in KINDS})


def scanned_decisions(requests: DataFrame, docs: DataFrame, hits: DataFrame, limit: int = 4, markers=BRIEF_MARKERS) -> DataFrame:
    """(request_id, relative_path, score, rendered, place): the best documents among the candidates of each request, by content.

    Candidates are looked at in order, in blocks that double: a request whose scan has stopped (`cut_off`) asks for no more
    texts, and a text that several requests look at is read once in a block. texts_read: how many were.
    """
    terms = cut(term_sets(requests), "terms")
    good = _decision_docs(docs)
    candidates = cut(candidate_paths(requests, docs, hits, terms, SCAN_BUDGET * limit), "candidates")
    seen, read, upto, begin = None, 0, 2 * limit, 0
    going = requests.select("request_id").distinct()
    while begin < SCAN_BUDGET * limit:
        block = cut(candidates.where((F.col("place") > begin) & (F.col("place") <= upto)).join(going, "request_id", "left_semi"), "block")
        read += block.select("relative_path").distinct().join(good, "relative_path", "left_semi").count()
        found = content_profile(block, good, terms, markers)
        found = cut(block.select("request_id", "relative_path", "place").join(found.drop("place"), ["request_id", "relative_path"], "left").withColumn("hit", F.coalesce("marked", F.lit(False))), "profiles")
        seen = found if seen is None else seen.unionByName(found)
        w = W.partitionBy("request_id")
        so_far = seen.withColumns({"hits": F.count_if("hit").over(w), "last": F.max(F.when(F.col("hit"), F.col("place"))).over(w), "at": F.max("place").over(w)})
        enough = (F.col("hits") >= F.floor(F.lit(limit * 1.5))) | ((F.col("hits") >= limit) & (F.col("at") - F.col("last") >= MISSES))
        going = cut(so_far.groupBy("request_id").agg(F.max(enough.cast("int")).alias("enough"), F.max("at").alias("at")).where((F.col("enough") == 0) & (F.col("at") == upto)).select("request_id"), "going")
        begin, upto = upto, min(2 * upto, SCAN_BUDGET * limit)
        if going.isEmpty():
            break
    kept = cut_off(seen, limit).join(seen.drop("hit"), ["request_id", "place"]).drop("place")
    score = path_priority("relative_path") + _worth(TEXT_POINTS)
    rendered = F.concat("title", F.lit(" ["), "relative_path", F.lit("]: "), "snippet")
    out = kept.select("request_id", "relative_path", score.cast("int").alias("score"), rendered.alias("rendered"))
    place = F.row_number().over(W.partitionBy("request_id").orderBy(F.desc("score"), "relative_path"))
    return out.withColumn("place", place).where(F.col("place") <= limit).withColumn("texts_read", F.lit(read))


def relevant_decisions(requests: DataFrame, docs: DataFrame, hits: DataFrame, limit: int = 4) -> DataFrame:
    """(request_id, relative_path, score, place): candidates by path alone where a request has any, or else by content."""
    paths = lambda c: requests.select("request_id", F.explode(c).alias("relative_path"))
    fast = cut(fast_candidates(paths("anchors"), paths("suggested"), docs, limit=limit), "fast")
    rest = requests.join(fast.select("request_id").distinct(), "request_id", "left_anti")
    slow = scanned_decisions(rest, docs, hits.join(rest.select("request_id"), "request_id", "left_semi"), limit)
    return fast.unionByName(slow.select(*fast.columns))


def best_by_content(requests: DataFrame, docs: DataFrame, limit: int = 4, markers=BRIEF_MARKERS) -> DataFrame:
    """(request_id, relative_path, score, place, texts_read): the best `limit` of all marked decision documents by what their
    path and text are worth, ties by path.

    A document is worth at most its path's points and those of all terms of the request. Documents are read by falling
    points of their path, a level at a time (few values exist); a request that has `limit` documents which no text of the
    next level can beat is done, and when all are, the texts of the levels below are never read.
    """
    terms = cut(term_sets(requests), "terms")
    most = terms.groupBy("request_id").agg(sum((F.count_if(F.col("kind") == kind) * n for kind, n in zip(KINDS, TEXT_POINTS, strict=True)), F.lit(0)).alias("most"))
    most = cut(requests.select("request_id").distinct().join(most, "request_id", "left").select("request_id", F.coalesce("most", F.lit(0)).alias("most")), "most")
    good = _decision_docs(docs).withColumn("priority", path_priority("relative_path"))
    levels = sorted(((r.priority, r["count"]) for r in good.groupBy("priority").count().collect()), reverse=True)
    best, going, read = None, most, 0
    for k, (level, many) in enumerate(levels):
        read += many
        own = cut(good.where(F.col("priority") == level).where(has_marker("text", markers)).select("relative_path", ascii_lower("text").alias("lower")), "level")
        held = _hits(own, terms.join(going, "request_id", "left_semi"), "lower").select("request_id", "relative_path", (_worth(TEXT_POINTS) + level).alias("score"))
        plain = own.select("relative_path").orderBy("relative_path").limit(limit)
        none = going.select("request_id").join(F.broadcast(plain)).withColumn("score", F.lit(level))  # `limit` rows
        all_ = held.union(none).groupBy("request_id", "relative_path").agg(F.max("score").alias("score"))
        all_ = all_ if best is None else best.drop("place").unionByName(all_)
        place = F.row_number().over(W.partitionBy("request_id").orderBy(F.desc("score"), "relative_path"))
        best = cut(all_.withColumn("place", place).where(F.col("place") <= limit), "best")
        if k + 1 < len(levels):
            last = best.where(F.col("place") == limit).select("request_id", F.col("score").alias("last"))
            # an equal score may still win by its path
            going = cut(most.join(last, "request_id", "left").where(F.col("last").isNull() | (F.col("last") <= F.col("most") + levels[k + 1][0])).select("request_id", "most"), "going")
            if going.isEmpty():
                break
    if best is None:
        best = most.select("request_id", F.lit("").alias("relative_path"), F.lit(0).alias("score"), F.lit(0).alias("place")).where("false")
    return best.select("request_id", "relative_path", F.col("score").cast("int").alias("score"), "place", F.lit(read).alias("texts_read"))
