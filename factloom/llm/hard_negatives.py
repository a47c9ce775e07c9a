"""Hard negatives by a distributed kNN join over a Voronoi partition.

Vectors are made whole numbers, and each gets one more component that brings all to one length: the row with the largest
inner product is then the nearest one. Pivots are drawn from the vectors; an anchor belongs to its nearest pivot's group, and
a group keeps, for every pivot, between which distances its anchors lie from it. A sample of candidates gives each anchor a
score that its last wanted row reaches at least. A candidate goes only to the groups that it might serve: its distances
to the pivots bound, by the triangle inequality, how near it may come to any of a group's anchors. There it is joined
exactly, in batches, against the group's anchors; a group's candidates are dealt to several tasks, each of which
keeps the first few for each anchor.

The join runs twice: within labels for the positives, and, with the window of scores that each positive allows, against
other labels for the negatives. Rows with equal label and vector are one class before that, with their smallest ids, which
are all that can matter; anchors of a class are one until the result.

Defined results: rows with a null id, label or vector, an empty vector or a null or non-finite component take no part;
vectors of different lengths never meet; equal rows count once; a row with an anchor's id but another label or vector
is another row; vectors whose squared length in whole numbers reaches 2^55 raise an error, for their scores would leave
the range of a long; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import small_batches, stage

POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these parts (of 100) of its positive's.
LOW, HIGH = 30, 90
#: Anchors of a group on average, the most pivots, and rows of the sample from which pivots and first bounds come.
GROUP, MOST_PIVOTS, SAMPLE = 128, 64, 4096
#: Labels fall into so many kinds; for positives a group has anchors of one kind.
KINDS = 64
#: Bytes of vectors in a piece of a group's candidates, candidates compared at a time, and anchors (with a positive each).
PIECE_BYTES, BATCH, TILE = 16 << 20, 4096, 256
NONE = -(2**63)


def whole(vectors: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """For every length of vector, the rows that have it and their matrix of whole numbers."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    out = []
    for n in np.unique(sizes):
        at = np.flatnonzero(sizes == n)
        out.append((at, vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(at), -1)))
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole vectors: in doubles where these hold every sum."""
    most = float(np.sqrt((a.astype(float) ** 2).sum(axis=1).max(initial=0)) * np.sqrt((b.astype(float) ** 2).sum(axis=1).max(initial=0)))
    if most < 2.0**52:
        return np.rint(a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


class Cells:
    """Pivots of one length of vector: distances of lengthened vectors from each."""

    def __init__(self, pivots: np.ndarray, longest: float):
        self.longest = longest
        self.pivots = self.lengthened(pivots)

    def lengthened(self, x: np.ndarray) -> np.ndarray:
        x = x.astype(float)
        return np.c_[x, np.sqrt(np.maximum(self.longest - (x**2).sum(axis=1), 0))]

    def distances(self, x: np.ndarray, anchors: bool) -> np.ndarray:
        """Anchors have a zero as their last component, candidates what brings them to the common length."""
        x = np.c_[x.astype(float), np.zeros(len(x))] if anchors else self.lengthened(x)
        squares = (x**2).sum(axis=1)[:, None] - 2 * x @ self.pivots.T + (self.pivots**2).sum(axis=1)
        return np.sqrt(np.maximum(squares, 0))


def reach(anchors: np.ndarray, least: np.ndarray, longest: float) -> np.ndarray:
    """How far a candidate may lie from each anchor if its score is at least `least`."""
    return np.sqrt(np.maximum((anchors.astype(float) ** 2).sum(axis=1) + longest - 2 * least.astype(float), 0))


def first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties by the smaller id."""
    if len(scores) > 4 * k:
        near = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


_FOUND = "anchor long, wish long, class long, least_id long, score long"


def _joined(k: int, same: bool):
    """From rows sorted by group and piece, anchors first: for each wish (an anchor and the scores it takes) the k first.

    same: whether candidates are of the anchor's label or of others.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, made, best = None, [], {}, {}

        def ready() -> None:
            t = pa.Table.from_batches(held)
            for at, x in whole(t["vector"]):
                some = t.take(pa.array(at))
                made[x.shape[1]] = (x, *[some[c].to_numpy() for c in ("class", "wish", "label", "low", "high")])
                best[x.shape[1]] = [[np.zeros(0, np.int64)] * 3 for _ in at]

        def results() -> Iterator[pa.RecordBatch]:
            for n, rows in best.items():
                _, anchor, wish, *_ = made[n]
                sizes = [len(x[0]) for x in rows]
                if sum(sizes):
                    flat = [pa.array(np.concatenate([x[c] for x in rows])) for c in range(3)]
                    yield pa.record_batch([pa.array(np.repeat(anchor, sizes)), pa.array(np.repeat(wish, sizes)), *flat], names=["anchor", "wish", "class", "least_id", "score"])

        def met(rows: pa.RecordBatch) -> None:
            for at, y in whole(rows.column("vector")):
                n = y.shape[1]
                if n not in made:
                    continue
                names, ids, labels = (rows.column(c).to_numpy()[at] for c in ("class", "least_id", "label"))
                x, anchor, _, own, low, high = made[n]
                for a in range(0, len(x), TILE):
                    b = a + TILE
                    _, one, of = np.unique(anchor[a:b], return_index=True, return_inverse=True)
                    score = products(x[a:b][one], y)[of]
                    floor = np.array([kept[2][-1] if len(kept[2]) == k else NONE for kept in best[n][a:b]])
                    fits = (own[a:b, None] == labels) if same else (own[a:b, None] != labels)
                    fits &= (score >= np.maximum(low[a:b], floor)[:, None]) & (score <= high[a:b, None])
                    for row in np.flatnonzero(fits.any(axis=1)):
                        here = np.flatnonzero(fits[row])
                        kept = [np.concatenate([old, new]) for old, new in zip(best[n][a + row], (names[here], ids[here], score[row, here]), strict=True)]
                        chosen = first(kept[2], kept[1], k)
                        best[n][a + row] = [c[chosen] for c in kept]

        for batch in batches:
            keys = np.stack([batch.column("group").to_numpy(), batch.column("piece").to_numpy()])
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if tuple(keys[:, a]) != key:
                    yield from results()
                    key, held, made, best = tuple(keys[:, a]), [], {}, {}
                rows = batch.slice(a, b - a)
                m = int((rows.column("side").to_numpy() == 0).sum())
                if m:
                    held.append(rows.slice(0, m))
                if m < rows.num_rows:
                    if held:
                        ready()
                        held = []
                    for at in range(m, rows.num_rows, BATCH):
                        met(rows.slice(at, BATCH))
        yield from results()

    return run


class Partition:
    """Pivots by length of vector, and a sample of candidates, drawn alike from all classes."""

    def __init__(self, classes: DataFrame, many: int, longest: float):
        sample = classes.orderBy(F.xxhash64("class"), "class").limit(SAMPLE).select("vector", "label").toArrow()
        self.pivots = max(1, min(MOST_PIVOTS, -(-many // GROUP)))
        self.longest = longest
        self.of: dict[int, tuple[Cells, np.ndarray, np.ndarray]] = {}
        for at, x in whole(sample["vector"]):
            self.of[x.shape[1]] = Cells(x[: self.pivots], longest), x, sample["label"].to_numpy()[at]

    def cells(self, x: np.ndarray, anchors: bool) -> np.ndarray | None:
        return self.of[x.shape[1]][0].distances(x, anchors) if x.shape[1] in self.of else None


def _grouped(partition: Partition, k: int, same: bool):
    """Anchors with their group, and with the score that their k-th row reaches at least, as the sample tells."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in whole(batch.column("vector")):
                rows = batch.take(pa.array(at))
                label, low, high = (rows.column(c).to_numpy() for c in ("label", "low", "high"))
                group, least = (x.shape[1] << 20) + (label % KINDS * same << 8), low.copy()
                far = partition.cells(x, True)
                bounds: list[list[float]] = [[] for _ in at]
                if far is not None:
                    cell = far.argmin(axis=1)
                    group = cell + (x.shape[1] << 20) + (label % KINDS * same << 8)
                    _, sample, labels = partition.of[x.shape[1]]
                    for first_row in range(0, len(x), TILE):
                        part = slice(first_row, first_row + TILE)
                        score = products(x[part], sample)
                        fits = (label[part, None] == labels) if same else (label[part, None] != labels)
                        score[~fits | (score > high[part, None]) | (score < low[part, None])] = NONE
                        if score.shape[1] >= k:
                            least[part] = np.maximum(low[part], np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k])
                    bounds = far.tolist()
                distance = np.where(least > NONE, reach(x, np.maximum(least, -(2**62)), partition.longest), np.inf)
                yield pa.record_batch([pa.array(group), *[rows.column(c) for c in ("class", "wish", "label")], pa.array(least), rows.column("high"), rows.column("vector"), pa.array(distance), pa.array(bounds, pa.list_(pa.float64())), pa.array(np.full(len(x), x.shape[1]))], names=["group", "class", "wish", "label", "low", "high", "vector", "reach", "far", "length"])

    return run


def _served(partition: Partition, groups: list[tuple], same: bool):
    """Candidates with the groups that they might serve; groups: (group, length, reach, nearest, farthest) each."""
    by_length: dict[int, tuple] = {}
    for n in {g[1] for g in groups}:
        mine = [g for g in groups if g[1] == n]
        nearest, farthest = (np.array([g[i] for g in mine], float).reshape(len(mine), -1) for i in (3, 4))
        by_length[n] = np.array([g[0] for g in mine]), np.array([g[2] for g in mine], float), nearest, farthest

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, y in whole(batch.column("vector")):
                if y.shape[1] not in by_length:
                    continue
                names, most, nearest, farthest = by_length[y.shape[1]]
                far = partition.cells(y, False)
                kind = batch.column("label").to_numpy()[at] % KINDS
                for k in range(len(names)):
                    fits = kind == names[k] >> 8 & 0xFFF if same else np.ones(len(at), bool)
                    if far is not None and nearest.shape[1]:
                        gap = np.maximum(np.maximum(nearest[k] - far, far - farthest[k]), 0).max(axis=1)
                        fits &= gap <= most[k] * (1 + 1e-9) + 1e-3  # rounding never loses a candidate
                    chosen = batch.take(pa.array(at[fits]))
                    if chosen.num_rows:
                        yield pa.record_batch([pa.array(np.full(chosen.num_rows, names[k])), *[chosen.column(c) for c in ("class", "least_id", "label", "vector")]], names=["group", "class", "least_id", "label", "vector"])

    return run


def knn_join(wishes: DataFrame, classes: DataFrame, partition: Partition, k: int, same: bool, piece_bytes: int, width: int) -> DataFrame:
    """(anchor, wish, class, least_id, score): for each row of wishes (class, wish, label, low, high, vector) its k first
    classes of the same label, or of others, with a score from low to high: the largest scores, ties by the smaller id."""
    asked = wishes.select("class", "wish", "label", "low", "high", "vector").mapInArrow(_grouped(partition, k, same), "group long, class long, wish long, label long, low long, high long, vector array<long>, reach double, far array<double>, length long")
    asked = stage(asked, "wishes")
    pivots = partition.pivots
    nearest, farthest = (F.array(*[f(F.get("far", F.lit(p))) for p in range(pivots)]) for f in (F.min, F.max))
    some = asked.groupBy("group", "length").agg(F.count("*").alias("many"), F.max("reach").alias("reach"), nearest.alias("nearest"), farthest.alias("farthest"))
    some = stage(some, "groups")
    # one group for each pivot, length and, for positives, kind of label
    groups = [(r["group"], r["length"], r["reach"], *([x for x in r[c] if x is not None] for c in ("nearest", "farthest"))) for r in some.collect()]
    sent = stage(classes.select("class", "least_id", "label", "vector").mapInArrow(_served(partition, groups, same), "group long, class long, least_id long, label long, vector array<long>"), "candidates")
    rows = max(BATCH, piece_bytes // (8 * width))
    counts = sent.groupBy("group").agg(F.count("*").alias("sent")).join(some.select("group", "many"), "group")
    pieces = stage(counts.select("group", F.ceil(F.col("sent") / F.greatest(F.lit(rows), "many")).cast("int").alias("pieces")), "dealt")
    dealt = sent.join(F.broadcast(pieces), "group").withColumn("piece", F.pmod(F.xxhash64("class"), F.col("pieces")).cast("int"))
    none = F.lit(None).cast("long")
    right = dealt.select("group", "piece", F.lit(1).alias("side"), "class", none.alias("wish"), "label", "least_id", none.alias("low"), none.alias("high"), "vector")
    left = asked.join(F.broadcast(pieces), "group").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    left = left.select("group", "piece", F.lit(0).alias("side"), "class", "wish", "label", none.alias("least_id"), "low", "high", "vector")
    found = left.union(right).repartition("group", "piece").sortWithinPartitions("group", "piece", "side").mapInArrow(_joined(k, same), _FOUND)
    order = W.partitionBy("anchor", "wish").orderBy(F.col("score").desc(), "least_id", "class")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def hard_negatives(vectors: DataFrame, is_anchor, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for vectors (vec_id, label, embedding);
    is_anchor: a condition on vec_id. Components x count as floor(256 * x)."""
    small_batches(vectors.sparkSession)
    v = F.col("embedding")
    good = F.expr("vec_id is not null and label is not null and embedding is not null") & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), v).where(good)
    numbers = F.transform(v, lambda x: F.floor(x.cast("double") * 256))
    square = F.aggregate(numbers, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    fits = F.when(square < 2.0**55, numbers).otherwise(F.raise_error(F.lit("a vector is too long for scores in a long")).cast("array<long>"))
    rows = stage(rows.select("vec_id", "label", fits.alias("vector"), square.alias("square"), F.size(v).alias("length")), "rows")

    same = W.partitionBy("label", "vector").orderBy("vec_id")
    ranked = rows.withColumn("r", F.dense_rank().over(same)).where(F.col("r") <= max(positives + 1, negatives))
    classes = ranked.groupBy("label", "vector").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    classes = stage(classes.select(F.monotonically_increasing_id().alias("class"), F.col("ids")[0].alias("least_id"), "ids", "label", "vector"), "classes")
    anchors = rows.where(is_anchor).select("vec_id", "label", "vector").distinct().join(classes.select("class", "label", "vector"), ["label", "vector"])
    anchors = stage(anchors.select(F.col("vec_id").alias("anchor_id"), "class"), "anchors")
    asked = stage(classes.join(anchors.select("class").distinct(), "class", "left_semi").select("class", "label", "vector"), "asked")
    longest, width = rows.agg(F.coalesce(F.max("square"), F.lit(0.0)), F.coalesce(F.max("length"), F.lit(1))).first()
    partition = Partition(classes, asked.count(), longest)

    # one more than asked for: an anchor is not its own positive
    wishes = asked.select("class", F.lit(0).cast("long").alias("wish"), "label", F.lit(NONE).alias("low"), F.lit(-(NONE + 1)).alias("high"), "vector")
    found = knn_join(wishes, classes, partition, positives + 1, True, piece_bytes, width)
    likely = found.join(classes.select("class", "ids"), "class").select("anchor", "class", "score", F.explode("ids").alias("positive_id"))
    likely = likely.withColumn("r", F.row_number().over(W.partitionBy("anchor").orderBy(F.col("score").desc(), "positive_id", "class"))).where(F.col("r") <= positives + 1)
    likely = stage(likely.select("anchor", F.col("class").alias("of"), "positive_id", F.col("score").alias("positive_score"), "r"), "likely")

    # the whole numbers from low/100 to high/100 of a positive's
    scores = likely.select("anchor", F.col("positive_score").alias("wish")).distinct()
    wishes = scores.withColumnRenamed("anchor", "class").join(asked, "class")
    wishes = wishes.select("class", "wish", "label", F.expr(f"-((-{low} * wish) div 100) + if(wish > 0 and {low} * wish % 100 != 0, 1, 0)").alias("low"), F.expr(f"({high} * wish) div 100 - if(wish < 0 and {high} * wish % 100 != 0, 1, 0)").alias("high"), "vector")
    found = knn_join(wishes.where("low <= high"), classes, partition, negatives, False, piece_bytes, width)
    each = found.join(classes.select("class", "ids"), "class").select("anchor", "wish", "class", "score", F.explode("ids").alias("negative_id"))
    each = each.withColumn("rank", F.row_number().over(W.partitionBy("anchor", "wish").orderBy(F.col("score").desc(), "negative_id", "class"))).where(F.col("rank") <= negatives)
    each = stage(each.select("anchor", F.col("wish").alias("positive_score"), "rank", "negative_id", F.col("score").alias("negative_score")), "negatives")

    mine = anchors.withColumnRenamed("class", "anchor").join(likely, "anchor").where("not (anchor = of and anchor_id = positive_id)")
    mine = mine.withColumn("place", F.row_number().over(W.partitionBy("anchor_id", "anchor").orderBy("r"))).where(F.col("place") <= positives)
    out = mine.join(each, ["anchor", "positive_score"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
