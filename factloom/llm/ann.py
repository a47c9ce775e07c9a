"""Approximate nearest neighbours by multiprobe p-stable hashing, reranked by exact distance.

Each of several tables cuts some random directions (Gaussian, made orthogonal) into cells of one width. A vector lies in
one bucket of a table; a query also visits buckets whose cells lie next to its own, in the order of estimated success:
the sum of squared distances to the borders crossed. How many buckets are visited is calibrated on SAMPLE_QUERIES vectors,
whose true neighbours among all vectors one scan finds. Every vector is indexed.

Buckets are dealt to parts of at most `part_bytes`, a bucket that is larger to several. A part gets its rows of the index,
and from each query that visits any of them its vector once, with the numbers of the buckets; queries stream by. Equal
vectors are one before anything else, with their k + 1 smallest ids, which are all that can matter. Queries that find
too few, and all of them should the calibration miss its target, go over all vectors, part by part.

Defined results: rows with a null id take no part, nor do vectors that are null, empty or zero or that have null or
non-finite components; vectors of different lengths never meet; equal rows count once; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import mix, small_batches, stage

K = 10
TABLES, HASHES = 8, 12
#: Cell width, as a share of the mean distance of sampled vectors.
WIDTH = 2.0
SAMPLE_ROWS, SAMPLE_QUERIES = 2000, 64
TARGET = 0.95
#: Numbers of visits in a table to choose from, and how many times as many are ranked by a query's own distances.
PROBES, RANKED = (1, 2, 5, 10, 20, 35, 50, 75, 100, 150, 200, 300, 400, 600, 1000), 2
#: Bytes of vectors (as doubles) that a part holds, and queries that it takes at a time.
PART_BYTES, QUERIES_AT_ONCE = 8 << 20, 32


def directions(dim: int, tables: int, hashes: int) -> np.ndarray:
    """Directions by table: (tables, dim, hashes), Gaussian, orthogonal as far as dim allows, each of length sqrt(dim)."""
    draw = np.random.default_rng(dim)
    out = np.empty((tables, dim, hashes))
    for t in range(tables):
        for first in range(0, hashes, dim):
            n = min(dim, hashes - first)
            q, r = np.linalg.qr(draw.normal(size=(dim, dim)))
            out[t, :, first : first + n] = (q * np.sign(np.diag(r)))[:, :n] * np.sqrt(dim)
    return out


class Hasher:
    def __init__(self, width: float, probes: int, tables: int = TABLES, hashes: int = HASHES):
        self.width, self.probes, self.tables, self.hashes = width, probes, tables, hashes
        self._made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def cells(self, x: np.ndarray) -> np.ndarray:
        """Positions in units of cells: (tables, rows, hashes)."""
        dim = x.shape[1]
        if dim not in self._made:
            shift = np.random.default_rng(dim + 1).uniform(0, 1, (self.tables, 1, self.hashes))
            self._made[dim] = directions(dim, self.tables, self.hashes), shift
        a, b = self._made[dim]
        return np.einsum("nd,tdh->tnh", x, a) / self.width + b

    def keys(self, cells: np.ndarray, table: np.ndarray, dim: int) -> np.ndarray:
        """64-bit bucket keys of whole cells (rows x hashes)."""
        h = mix(table.astype(np.uint64) + np.uint64(dim << 16))
        for k in range(cells.shape[1]):
            h = mix(h * np.uint64(31) + cells[:, k].astype(np.int64).view(np.uint64))
        return h.view(np.int64)

    def index(self, x: np.ndarray) -> np.ndarray:
        """(tables, rows) bucket keys."""
        cells = np.floor(self.cells(x))
        return np.stack([self.keys(cells[t], np.full(len(x), t), x.shape[1]) for t in range(self.tables)])

    def visits(self, x: np.ndarray) -> np.ndarray:
        """(tables, rows, probes) keys of the buckets to visit, the likeliest first."""
        at = self.cells(x)
        cells = np.floor(at)
        inside = at - cells
        borders = np.concatenate([inside, 1 - inside], axis=2)  # one below, one above, by hash
        order = np.argsort(borders, axis=2, kind="stable")
        cost = np.take_along_axis(borders, order, 2) ** 2
        sets = perturbations(self.hashes, RANKED * self.probes)
        best = np.argsort(cost @ sets.T.astype(float), axis=2, kind="stable")[:, :, : self.probes]
        out = np.empty(best.shape, np.int64)
        for t in range(self.tables):
            for row in range(len(x)):
                moves = np.zeros((best.shape[2], 2 * self.hashes))
                moves[:, order[t, row]] = sets[best[t, row]]
                moved = cells[t, row] - moves[:, : self.hashes] + moves[:, self.hashes :]
                out[t, row] = self.keys(moved, np.full(len(moved), t), x.shape[1])
        return out


@functools.cache
def perturbations(hashes: int, many: int) -> np.ndarray:
    """Sets of borders to cross (sets x 2 * hashes, by a border's place in the order of distances), by ascending sum of what
    the squared distances are expected to be; no set holds both borders of a cell, as far as the expectation shows."""
    j = np.arange(1, 2 * hashes + 1)
    near = j * (j + 1) / (4 * (hashes + 1) * (hashes + 2))
    k = 2 * hashes + 1 - j
    z = np.where(j <= hashes, near, 1 - k / (hashes + 1) + k * (k + 1) / (4 * (hashes + 1) * (hashes + 2))).tolist()
    out, heap = [()], [(z[0], (0,))]
    while heap and len(out) < many:
        score, chosen = heapq.heappop(heap)
        if all(2 * hashes - 1 - x not in chosen for x in chosen):
            out.append(chosen)
        last = chosen[-1]
        if last + 1 < len(z):
            heapq.heappush(heap, (score + z[last + 1], (*chosen, last + 1)))
            heapq.heappush(heap, (score - z[last] + z[last + 1], (*chosen[:-1], last + 1)))
    sets = np.zeros((len(out), 2 * hashes), np.int8)
    for row, chosen in enumerate(out):
        sets[row, list(chosen)] = 1
    return sets


def matrix(vectors: pa.Array) -> np.ndarray:
    """Vectors of one length as rows of doubles."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.empty((len(q), len(x)))
    for a in range(0, len(q), 16):
        out[a : a + 16] = np.sqrt(((q[a : a + 16, None] - x[None]) ** 2).sum(axis=-1))
    return out


def best(ids: np.ndarray, d: np.ndarray, k: int) -> np.ndarray:
    """Places of the k smallest by distance, then id."""
    if len(d) > 4 * k:
        near = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1])
        return near[np.lexsort((ids[near], d[near]))[:k]]
    return np.lexsort((ids, d))[:k]


def calibrated(sample: np.ndarray, queries: np.ndarray, near: list[np.ndarray], target: float, tables: int, hashes: int, width: float) -> Hasher | None:
    """The hasher with the fewest visits that meets the share `target` of the true neighbours (near, by query), or None."""
    spread = distances(queries, sample)
    hasher = Hasher(width * float(spread[spread > 0].mean()) if (spread > 0).any() else 1.0, PROBES[-1], tables, hashes)
    if not sum(map(len, near)):
        return hasher
    keys, visits = hasher.index(np.concatenate(near)), hasher.visits(queries)
    owner = np.repeat(np.arange(len(near)), [len(x) for x in near])
    first = np.full(len(owner), PROBES[-1])
    for t in range(tables):
        same = visits[t][owner] == keys[t][:, None]
        first = np.minimum(first, np.where(same.any(axis=1), same.argmax(axis=1), PROBES[-1]))
    for probes in PROBES:
        if (first < probes).mean() >= target:
            hasher.probes = probes
            return hasher
    return None


_HITS = "qrep long, rep long, score double"


class _Part:
    """The index rows of a part with vectors of one length: each vector once, and which buckets it lies in."""

    def __init__(self, buckets: np.ndarray, ids: np.ndarray, x: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.starts = np.flatnonzero(np.r_[True, np.diff(ids[order]) != 0])
        self.ids, self.x = ids[order][self.starts], x[order][self.starts]
        self.buckets, self.of = np.unique(buckets[order], return_inverse=True)
        self.squares = (self.x**2).sum(axis=1)

    def hits(self, q: np.ndarray, visits: list[np.ndarray], k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each query its number, and ids and exact distances of the k nearest in the buckets that it visits."""
        seen = np.zeros((len(q), len(self.buckets)), bool)
        for row, keys in enumerate(visits):
            at = np.minimum(np.searchsorted(self.buckets, keys), len(self.buckets) - 1)
            seen[row, at[self.buckets[at] == keys]] = True
        met = np.logical_or.reduceat(seen[:, self.of], self.starts, axis=1)
        some = np.flatnonzero(met.any(axis=0))
        if not len(some):
            return
        # products order the candidates; those within rounding of the k-th are measured exactly
        about = self.squares[some] - 2 * (q @ self.x[some].T) + (q**2).sum(axis=1)[:, None]
        about[~met[:, some]] = np.inf
        slack = 1e-9 * (float(self.squares[some].max()) + float((q**2).sum(axis=1).max()))
        for row in range(len(q)):
            d = about[row]
            limit = np.partition(d, k - 1)[k - 1] if len(d) > k else np.inf
            near = some[np.flatnonzero((d <= limit + slack) & (d < np.inf))]
            if len(near):
                exact = distances(q[row : row + 1], self.x[near])[0]
                chosen = best(self.ids[near], exact, k)
                yield row, self.ids[near][chosen], exact[chosen]


def _in_parts(k: int):
    """From rows sorted by part, index first: the k nearest in each part of each query that comes by."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, made = None, [], {}
        for batch in batches:
            parts = batch.column(0).to_numpy()
            edges = [0, *(np.flatnonzero(parts[1:] != parts[:-1]) + 1).tolist(), len(parts)] if len(parts) else []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if parts[a] != part:
                    part, held, made = parts[a], [], {}
                rows = batch.slice(a, b - a)
                m = int((rows.column(1).to_numpy() == 0).sum())
                if m:
                    held.append(rows.slice(0, m).select(["bucket", "id", "vector"]))
                if held and m < rows.num_rows:
                    t = pa.Table.from_batches(held)
                    for n, at in _by_length(t["vector"]):
                        some = t.take(pa.array(at))
                        made[n] = _Part(some["bucket"].to_numpy(), some["id"].to_numpy(), matrix(some["vector"]))
                    held = []
                for first in range(m, rows.num_rows, QUERIES_AT_ONCE):
                    asked = rows.slice(first, QUERIES_AT_ONCE)
                    found = []
                    for n, at in _by_length(asked.column("vector")):
                        if n in made:
                            some = asked.take(pa.array(at))
                            visits = [np.asarray(x.values) for x in some.column("buckets")]
                            names = some.column("id").to_numpy()
                            found += [(names[row], ids, d) for row, ids, d in made[n].hits(matrix(some.column("vector")), visits, k)]
                    if found:
                        q = np.repeat([x[0] for x in found], [len(x[1]) for x in found])
                        yield pa.record_batch([pa.array(q, pa.int64()), pa.array(np.concatenate([x[1] for x in found])), pa.array(np.concatenate([x[2] for x in found]))], names=["qrep", "rep", "score"])

    return run


def _by_length(vectors: pa.Array) -> list[tuple[int, np.ndarray]]:
    sizes = pc.list_value_length(vectors).to_numpy(zero_copy_only=False) if isinstance(vectors, pa.Array) else pc.list_value_length(vectors).to_numpy()
    return [(int(n), np.flatnonzero(sizes == n)) for n in np.unique(sizes)]


def searched(index: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qrep, rep, score): in each part the k nearest of each query, for an index (part, bucket, id, vector) and queries
    (part, id, vector, buckets)."""
    none = F.lit(None).cast("array<long>")
    left = index.select("part", F.lit(0).alias("side"), "bucket", "id", "vector", none.alias("buckets"))
    right = queries.select("part", F.lit(1).alias("side"), F.lit(0).cast("long").alias("bucket"), "id", "vector", "buckets")
    return left.union(right).repartition("part").sortWithinPartitions("part", "side").mapInArrow(_in_parts(k), _HITS)


def scanned(vectors: DataFrame, queries: DataFrame, k: int, parts: int) -> DataFrame:
    """The same over all vectors (rep, embedding), for queries (qrep, embedding): each goes by every part."""
    index = vectors.select(F.pmod(F.xxhash64("rep"), F.lit(parts)).alias("part"), F.lit(0).cast("long").alias("bucket"), F.col("rep").alias("id"), F.col("embedding").alias("vector"))
    asked = queries.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.col("qrep").alias("id"), F.col("embedding").alias("vector"), F.array(F.lit(0).cast("long")).alias("buckets"))
    return searched(index, asked, k)


def nearest(vectors: DataFrame, is_query, k: int = K, tables: int = TABLES, hashes: int = HASHES, width: float = WIDTH, target: float = TARGET, part_bytes: int = PART_BYTES) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the k nearest found for each query among vectors (vec_id,
    embedding), nearest first, ties to the smaller id; is_query: a condition on vec_id."""
    small_batches(vectors.sparkSession)
    v = F.col("embedding")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("long"), v).where(good)
    ranked = rows.withColumn("r", F.dense_rank().over(W.partitionBy("embedding").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    apart = ranked.groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))
    apart = stage(apart.select(F.col("ids")[0].alias("rep"), "ids", "embedding"), "vectors")
    asked = rows.where(is_query).distinct().join(apart.select("rep", "embedding"), "embedding")
    asked = stage(asked.select(F.col("vec_id").alias("query_id"), F.col("rep").alias("qrep"), "embedding"), "queries")
    queries = asked.select("qrep", "embedding").dropDuplicates(["qrep"])
    many, length, rows_held = apart.agg(F.count("*"), F.max(F.size("embedding")), F.sum(F.size("ids"))).first()
    part_rows = max(64, part_bytes // (8 * (length or 1)))

    def top(found: DataFrame, of: DataFrame) -> DataFrame:
        """Rows by query id: its own left out, ranked."""
        near = found.groupBy("qrep", "rep").agg(F.min("score").alias("score"))
        near = near.withColumn("r", F.row_number().over(W.partitionBy("qrep").orderBy("score", "rep"))).where(F.col("r") <= k + 1)
        ids = near.join(apart.select("rep", "ids"), "rep").select("qrep", "score", F.explode("ids").alias("vec_id"))
        ids = ids.withColumn("r", F.row_number().over(W.partitionBy("qrep").orderBy("score", "vec_id"))).where(F.col("r") <= k + 1)
        mine = of.select("query_id", "qrep").join(ids, "qrep").where(F.col("vec_id") != F.col("query_id"))
        rank = F.row_number().over(W.partitionBy("query_id", "qrep").orderBy("score", "vec_id"))
        return mine.select("query_id", "qrep", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)

    # calibration: a bounded sample, whose queries' true neighbours among all vectors are few rows
    sample = apart.orderBy(F.xxhash64("rep"), "rep").limit(SAMPLE_ROWS).select("rep", "embedding").toArrow()
    sizes = np.array([len(x) for x in sample["embedding"]], np.int64)
    dim = int(np.bincount(sizes).argmax()) if len(sizes) else 1
    some = sample.take(pa.array(np.flatnonzero(sizes == dim)))
    few = some.slice(0, SAMPLE_QUERIES)
    wanted = few["rep"].to_pylist()
    trial = apart.where(F.col("rep").isin(wanted)).select(F.col("rep").alias("qrep"), "embedding")
    true = scanned(apart, trial, k + 1, -(-many // part_rows) or 1).where("qrep <> rep")
    true = true.withColumn("r", F.row_number().over(W.partitionBy("qrep").orderBy("score", "rep"))).where(F.col("r") <= k)
    true = true.join(apart.select("rep", "embedding"), "rep").select("qrep", "embedding").toArrow() if wanted else None
    near = [matrix(mine) if len(mine := true.filter(pc.equal(true["qrep"], q))["embedding"]) else np.zeros((0, dim)) for q in wanted]
    hasher = calibrated(matrix(some["embedding"]), matrix(few["embedding"]), near, target, tables, hashes, width) if wanted else None

    scan_parts = -(-many // part_rows) or 1
    if hasher is None:
        return top(scanned(apart, queries, k + 1, scan_parts), asked).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    kind = apart.schema["embedding"].dataType.simpleString()

    def indexed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, at in _by_length(batch.column(1)):
                part = batch.take(pa.array(at))
                for keys in hasher.index(matrix(part.column(1))):
                    yield pa.record_batch([pa.array(keys), *part.columns], names=["bucket", "id", "vector"])

    def visited(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, at in _by_length(batch.column(1)):
                for first in range(0, len(at), 16):
                    part = batch.take(pa.array(at[first : first + 16]))
                    keys = np.concatenate(list(hasher.visits(matrix(part.column(1)))), axis=1)
                    lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, keys.shape[1], dtype=np.int32), keys.reshape(-1))
                    yield pa.record_batch([part.column(0), lists], names=["id", "buckets"])

    index = apart.select("rep", "embedding").mapInArrow(indexed, f"bucket long, id long, vector {kind}")
    crowded = index.groupBy("bucket").count().where(F.col("count") > part_rows).select("bucket", F.ceil(F.col("count") / part_rows).cast("int").alias("pieces"))
    crowded = stage(crowded, "crowded")
    parts = max(1, -(-many * tables // part_rows))
    split = lambda df: df.join(crowded, "bucket", "left").withColumn("pieces", F.coalesce("pieces", F.lit(1)))
    part = lambda piece: F.pmod(F.xxhash64("bucket", piece), F.lit(parts))
    placed = split(index).select(part(F.pmod(F.xxhash64("id"), F.col("pieces")).cast("int")).alias("part"), "bucket", "id", "vector")
    visits = queries.repartition(F.col("qrep")).mapInArrow(visited, "id long, buckets array<long>").select("id", F.explode("buckets").alias("bucket"))
    visits = split(visits).withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    visits = visits.select("id", "bucket", part(F.col("piece")).alias("part")).groupBy("id", "part").agg(F.collect_set("bucket").alias("buckets"))
    visits = visits.join(queries.select(F.col("qrep").alias("id"), F.col("embedding").alias("vector")), "id")
    first = stage(top(searched(placed, visits, k + 1), asked), "found")

    # a query with fewer than k found is asked again over all vectors
    full = first.groupBy("query_id", "qrep").count().where(F.col("count") >= min(k, max((rows_held or 0) - 1, 0))).select("query_id", "qrep")
    poor = stage(asked.join(full, ["query_id", "qrep"], "left_anti"), "poor")
    result = first
    if not poor.isEmpty():
        again = top(scanned(apart, poor.select("qrep", "embedding").dropDuplicates(["qrep"]), k + 1, scan_parts), poor)
        result = first.join(poor, ["query_id", "qrep"], "left_anti").union(again)
    return result.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
