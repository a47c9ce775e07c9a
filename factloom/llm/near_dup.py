"""Near-duplicate groups by SuperMinHash signatures, banding, verification on full sets and union-find.

Copies with equal shingle sets are one class before anything else, so a group of a million copies costs as much as
one text. Classes that share a bucket of a band are compared there, in the task that holds the bucket, on their full
sets; a bucket never emits pairs, only links that join two of its components, so fewer than it has members. Buckets
with the same members are compared once. A bucket of many bytes is dealt to several tasks in parts: members of a part
are compared first, and then, from a component that is not the bucket's largest, with the other parts as they stream by.

Defined results: a null or wordless text has no shingles and is a component of its own; a null doc_id takes part but
is never the smallest id of a component, unless it has no other; equal rows give equal rows; where one doc_id has several
texts, or none is given, each text is searched for near copies on its own; all rows with a component's smallest id are
marked as kept, and of a component without ids the rows of one text (drop_near_duplicates keeps one text in either case);
an empty table gives an empty result; columns other than the two named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, buffer_of, chunks, hash_ranges, maybe_among, mix, stage, texts_of, words_of

SHINGLE = 5
PERCENT = 85
#: A pair at the threshold meets in none of so many bands of so many rows about once in 200,000.
BANDS, ROWS = 26, 6
LAST = 2**63 - 1
#: Added to the hash of a text (62 bits) whose id is null, so that the id 2^63 - 1 comes before a missing one.
MISSING = 1 << 62
#: Bytes of sets in a part of a bucket, sets that are compared at once, and columns of a step of the comparison.
PART_BYTES, TILE, STRIPE = 4 << 20, 256, 4096

_STEP = np.uint64(0x9E3779B97F4A7C15)
_PLACES = [np.uint64(pow(0xD1342543DE82EF95, k + 1, 2**64)) for k in range(16)]


def shingle_sets(data: np.ndarray, at: np.ndarray, width: int = SHINGLE) -> list[np.ndarray]:
    """For every text its distinct shingles, as sorted 64-bit hashes."""
    start, end, owner = words_of(LOWER[data], at)
    words = hash_ranges(LOWER[data], start, end) if len(start) else np.zeros(0, np.uint64)
    first = np.searchsorted(owner, np.arange(len(at)))
    n = max(0, len(words) - width + 1)
    rolled = np.zeros(n, np.uint64)
    for k in range(width):
        rolled += words[k : k + n] * _PLACES[k]
    rolled = mix(rolled)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= width:
            out.append(np.unique(rolled[a : b - width + 1]))
        elif b > a:
            short = (words[a:b] * np.array(_PLACES[: b - a])).sum(dtype=np.uint64, keepdims=True)
            out.append(mix(short + np.full(1, b - a, np.uint64) * _STEP))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def super_minhash(sets: list[np.ndarray], slots: int) -> np.ndarray:
    """Signatures (sets x slots) after Ertl's SuperMinHash: element x gets rank j + r(x, j) in the slot that step j of its
    own random permutation names; a set stops as soon as no later step can lower any of its slots."""
    best = np.full((len(sets), slots), np.inf)
    x = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    permuted = np.zeros((0, slots), np.uint8)
    flat = best.reshape(-1)
    for j in range(slots):
        if not len(x):
            break
        drawn = mix(x + np.full(1, j, np.uint64) * _STEP)
        rank = (drawn >> np.uint64(32)).astype(np.float64) / 2.0**32 + j
        pick = j + (((drawn & np.uint64(0xFFFFFFFF)) * np.uint64(slots - j)) >> np.uint64(32)).astype(np.int64)
        if j:
            rows = np.arange(len(x))
            slot = permuted[rows, pick]
            permuted[rows, pick] = permuted[rows, j]
            permuted[rows, j] = slot
        else:
            slot = pick
        np.minimum.at(flat, owner * slots + slot, rank)
        going = best.max(axis=1, initial=0) >= j + 1
        keep = going[owner]
        if not j:
            x, owner, pick = x[keep], owner[keep], pick[keep]
            permuted = np.tile(np.arange(slots, dtype=np.uint8), (len(x), 1))
            permuted[np.arange(len(x)), pick] = 0
            permuted[:, 0] = pick
        elif not keep.all():
            x, owner, permuted = x[keep], owner[keep], permuted[keep]
    return best


def _features(width: int, bands: int, rows: int):
    schema = pa.schema([("row", pa.int64()), ("did", pa.int64()), ("version", pa.int64()), ("n", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("bands", pa.list_(pa.int64()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        for part in chunks(batches):
            sets = shingle_sets(*buffer_of(part.column(1)), width)
            n = np.array([len(s) for s in sets], np.int64)
            bits = super_minhash(sets, bands * rows).view(np.uint64).reshape(len(sets), bands, rows)
            keys = np.zeros((len(sets), bands), np.uint64)
            for k in range(rows):
                keys = mix(keys ^ bits[:, :, k])
            keys = mix(keys + np.arange(bands, dtype=np.uint64) * _STEP).view(np.int64)
            d1 = np.array([mix(s ^ _STEP).sum(dtype=np.uint64) for s in sets], np.uint64).view(np.int64)
            d2 = np.array([np.bitwise_xor.reduce(mix(s + _STEP), initial=np.uint64(0)) for s in sets], np.uint64).view(np.int64)
            yield pa.record_batch([pa.array(np.arange(row, row + len(sets))), part.column(0), part.column(2), pa.array(n), pa.array(d1), pa.array(d2), pa.ListArray.from_arrays(np.arange(0, keys.size + 1, bands, dtype=np.int32), keys.reshape(-1))], schema=schema)
            row += len(sets)

    return run


class Forest:
    """Union-find over numbers that come up."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, a: int, b: int) -> bool:
        """Whether a and b were apart until now."""
        a, b = self.root(a), self.root(b)
        self.parent[max(a, b)] = min(a, b)
        return a != b


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sets of one list with sets of another: products of incidence matrices, in stripes."""
    out = np.zeros((len(left), len(right)), np.float32)
    x, y = np.concatenate(left), np.concatenate(right)
    both = np.intersect1d(x, y)
    if not len(both):
        return out
    cells = []
    for sets, flat in ((left, x), (right, y)):
        at = np.minimum(np.searchsorted(both, flat), len(both) - 1)
        hit = both[at] == flat
        owner, at = np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit], at[hit]
        order = np.argsort(at, kind="stable")
        cells.append((owner[order], at[order]))
    for first in range(0, len(both), STRIPE):
        width = min(STRIPE, len(both) - first)
        sides = []
        for (owner, at), n in zip(cells, out.shape, strict=True):
            a, b = np.searchsorted(at, [first, first + width])
            m = np.zeros((n, width), np.float32)
            m[owner[a:b], at[a:b] - first] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def new_links(left: tuple, right: tuple, percent: int, forest: Forest, tried=None) -> list[tuple[int, int]]:
    """Links between members (ids, sizes, sets) of two lists of at most TILE that join what was apart in forest.

    tried(i, j): which pairs are to be compared, as a matrix; by default those that are apart.
    """
    roots = [np.array([forest.root(x) for x in ids.tolist()], np.int64) for ids in (left[0], right[0])]
    apart = roots[0][:, None] != roots[1][None]
    a, b = left[1][:, None], right[1][None]
    apart &= 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
    if tried is not None:
        apart &= tried
    if not apart.any():
        return []
    i, j = np.flatnonzero(apart.any(axis=1)), np.flatnonzero(apart.any(axis=0))
    both = common_counts([left[2][k] for k in i], [right[2][k] for k in j]).astype(np.int64)
    linked = apart[np.ix_(i, j)] & (both > 0) & (100 * both >= percent * (a[i] + b[:, j] - both))
    out = []
    for p, q in zip(*np.nonzero(linked), strict=True):
        x, y = int(left[0][i[p]]), int(right[0][j[q]])
        if forest.join(x, y):
            out.append((min(x, y), max(x, y)))
    return out


def _members(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("set")]
    return batch.column("class").to_numpy(), np.array([len(s) for s in sets], np.int64), sets


def _tiles(members: tuple) -> Iterator[tuple]:
    """Members by size, a tile at a time."""
    order = np.argsort(members[1], kind="stable")
    for first in range(0, len(order), TILE):
        at = order[first : first + TILE]
        yield members[0][at], members[1][at], [members[2][k] for k in at]


def _keyed(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of rows with the same bucket and part, from rows sorted by these."""
    for batch in batches:
        keys = np.stack([batch.column("bucket").to_numpy(), batch.column("part").to_numpy()])
        if keys.size:
            edges = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), keys.shape[1]]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                yield tuple(keys[:, a]), batch.slice(a, b - a)


_LINK = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _links(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array([x for x, _ in pairs], pa.int64()), pa.array([x for _, x in pairs], pa.int64())], schema=_LINK)


def _inside(percent: int):
    """Links within each bucket, or part of one, from its members with their sets."""

    def found(held: list[pa.RecordBatch]) -> list[tuple[int, int]]:
        parts = [_members(x) for x in held]
        members = np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]), [s for x in parts for s in x[2]]
        forest, out, tiles = Forest(), [], list(_tiles(members))
        for k, tile in enumerate(tiles):
            for other in tiles[k:]:
                if 100 * int(tile[1].max()) < percent * int(other[1].min()):
                    break
                out += new_links(tile, other, percent, forest)
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        out: list[tuple[int, int]] = []
        key = None
        for now, rows in _keyed(batches):
            if now != key and held:
                out += found(held)
                held = []
            key = now
            held.append(rows)
            if len(out) > 10_000:
                yield _links(out)
                out = []
        if held:
            out += found(held)
        if out:
            yield _links(out)

    return run


def _between(percent: int):
    """Links of a part's members, which come first, with visitors from other parts of the bucket, which stream by.

    A pair of two visitors is compared in the part of the lower number, any other where the one that stays at home is.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, homes, forest = None, [], Forest()
        out: list[tuple[int, int]] = []
        for now, rows in _keyed(batches):
            if now != key:
                key, homes, forest = now, [], Forest()
            for first in range(0, rows.num_rows, TILE):
                some = rows.slice(first, TILE)
                for a, b in zip(some.column("class").to_pylist(), some.column("comp").to_pylist(), strict=True):
                    forest.join(a, b)
                visits = some.column("visits")
                own, guests = some.filter(pc.invert(visits)), some.filter(visits)
                if own.num_rows:
                    homes.append((_members(own), own.column("minor").to_numpy(zero_copy_only=False)))
                if guests.num_rows:
                    there, later = _members(guests), guests.column("home").to_numpy() > now[1]
                    for here, minor in homes:
                        out += new_links(here, there, percent, forest, ~minor[:, None] | later[None])
            if len(out) > 10_000:
                yield _links(out)
                out = []
        if out:
            yield _links(out)

    return run


def _union_find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forest.join(a, b)
    nodes = list(forest.parent)
    yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array([forest.root(x) for x in nodes], pa.int64())], names=["did", "comp"])


def components(links: DataFrame) -> DataFrame:
    """(did, comp): for every end of a link (a, b), the smallest id that it reaches.

    Each task first reduces its links to a forest by union-find; large-star and small-star steps then join the forests
    on the cluster until nothing changes.
    """
    forest = stage(links.mapInArrow(_union_find, "did long, comp long").where("did <> comp"), "forest")
    edges, before = forest.select(F.col("did").alias("v"), F.col("comp").alias("m")), None
    while True:
        both = edges.union(edges.select("m", "v"))
        low = both.groupBy("v").agg(F.min("m").alias("low")).select("v", F.least("v", "low").alias("low"))
        large = both.join(low, "v").where("m > v").select(F.col("m").alias("v"), F.col("low").alias("m")).where("v <> m").distinct()
        low = large.groupBy("v").agg(F.min("m").alias("low"))
        small = large.join(low, "v").select(F.col("m").alias("v"), F.col("low").alias("m")).where("v <> m").union(low).distinct()
        edges = stage(small, "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("v", "m").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("m").alias("v")).distinct().select("v", F.col("v").alias("m"))
    return edges.union(roots).groupBy("v").agg(F.min("m").alias("m")).select(F.col("v").alias("did"), F.col("m").alias("comp"))


def version_of(text, id_):
    return F.shiftrightunsigned(F.xxhash64(text), 2) + F.when(id_.isNull(), F.lit(MISSING)).otherwise(F.lit(0))


def grouped(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, part_bytes: int = PART_BYTES) -> DataFrame:
    """did, version, n, head for every row of docs (doc_id long, text string): its id or LAST, a hash of its text that also
    tells whether the id is null, the number of its shingles, and the smallest (did, version) of its component."""
    own = texts_of(docs, "doc_id", "text").select(F.coalesce("doc_id", F.lit(LAST)).alias("did"), "text", version_of(F.col("text"), F.col("doc_id")).alias("version"))
    feats = stage(own.mapInArrow(_features(width, bands, rows), "row long, did long, version long, n long, d1 long, d2 long, bands array<long>"), "signatures")
    full = feats.where("n > 0")
    # a class goes by the number of one of its rows: ids may be missing or have several texts
    classes = stage(full.groupBy("d1", "d2", "n").agg(F.min("row").alias("class"), F.min(F.struct("did", "version")).alias("low")), "classes")
    met = full.select(F.col("row").alias("class"), "n", "bands").join(classes.select("class"), "class", "left_semi").select("class", "n", F.explode("bands").alias("bucket"))
    shared = stage(met.groupBy("bucket").agg(F.count("*").alias("many")).where("many > 1").select("bucket"), "shared")
    met = stage(met.where(maybe_among(shared)("bucket")).join(shared, "bucket", "left_semi"), "met")
    crowd = met.groupBy("bucket").agg(F.count("*").alias("many"), F.sum("n").alias("total"), *[F.bit_xor(F.xxhash64(F.lit(k), "class")).alias(f"c{k}") for k in (1, 2)])
    once = crowd.groupBy("many", "total", "c1", "c2").agg(F.min("bucket").alias("bucket"))
    once = once.select("bucket", F.ceil(F.col("total") * 8 / part_bytes).cast("int").alias("parts"))
    some = met.join(once, "bucket").groupBy("class").agg(F.collect_list(F.struct("bucket", "parts")).alias("places"))  # one place for each band at most
    sought = stage(classes.join(some, "class").select("class", F.col("low.did").alias("of"), F.col("low.version").alias("of_version"), "places"), "sought")
    wanted = maybe_among(sought.select(F.xxhash64("of", "of_version").alias("key")))
    texts = own.where(wanted(F.xxhash64("did", "version"))).join(sought, F.expr("did = of and version = of_version")).dropDuplicates(["class"])
    held = texts.select("class", "text", "places").mapInArrow(_placed(width), "class long, bucket long, part int, parts int, set binary")
    held = stage(held, "sets")
    links = stage(held.repartition("bucket", "part").sortWithinPartitions("bucket", "part").mapInArrow(_inside(percent), "a long, b long").distinct(), "links")
    found = components(links)

    # buckets in several parts: members that are not of the bucket's largest component visit the other parts
    split = held.where("parts > 1").select("class", "bucket", F.col("part").alias("home"), "parts", "set")
    placed = split.join(found.withColumnRenamed("did", "class"), "class", "left").withColumn("comp", F.coalesce("comp", "class"))
    sizes = placed.groupBy("bucket", "comp").agg(F.count("*").alias("many"))
    main = stage(sizes.groupBy("bucket").agg(F.max(F.struct("many", "comp")).alias("x"), F.count("*").alias("apart")).where("apart > 1").select("bucket", F.col("x.comp").alias("main")), "main")
    moved = placed.join(main, "bucket").withColumn("minor", F.col("comp") != F.col("main"))
    to = F.when(F.col("minor"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array("home"))
    moved = moved.withColumn("part", F.explode(to)).withColumn("visits", F.col("part") != F.col("home"))
    moved = moved.select("bucket", "part", "visits", "home", "class", "comp", "minor", "set")
    more = moved.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "visits").mapInArrow(_between(percent), "a long, b long")
    if not main.isEmpty():
        found = components(links.union(stage(more.distinct(), "more")))
    final = found.withColumnRenamed("did", "class")

    # staged, as named below: plain inputs of joins, so that the side of a hot component or class can be split
    inside = stage(classes.join(final, "class").select("class", "comp", "low"), "inside")
    heads = inside.join(inside.groupBy("comp").agg(F.min("low").alias("head")), "comp").select("class", "head")
    named = classes.join(heads, "class", "left").select(F.col("d1").alias("c1"), F.col("d2").alias("c2"), F.col("n").alias("cn"), F.coalesce("head", "low").alias("head"))
    named = stage(named, "named")
    out = feats.select("did", "version", "n", "d1", "d2").join(named, F.expr("d1 = c1 and d2 = c2 and n = cn"), "left")
    return out.select("did", "version", "n", F.coalesce("head", F.struct("did", "version")).alias("head"))


def _placed(width: int):
    """A class's set in each of its buckets, in the part that its number names."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            sets = pa.array([s.tobytes() for s in shingle_sets(*buffer_of(part.column(1)), width)], pa.binary())
            places = part.column(2)
            of = places.value_parent_indices()
            flat = places.flatten()
            bucket, parts = flat.field("bucket"), flat.field("parts")
            number = part.column(0).take(of)
            home = (mix(number.to_numpy().view(np.uint64)) % parts.to_numpy().astype(np.uint64)).astype(np.int32)
            step = max(1, (8 << 20) // max(1, pc.max(pc.binary_length(sets)).as_py() or 1))
            for first in range(0, len(of), step):
                at = slice(first, first + step)
                yield pa.record_batch([number[at], bucket[at], pa.array(home[at]), parts[at], sets.take(of[at])], names=["class", "bucket", "part", "parts", "set"])

    return run


def near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id long, text string).

    Two texts are linked when 100 * |A and B| >= percent * |A or B| for their sets of `width`-word shingles. With the
    default bands a pair at the threshold of 85 meets in none of them about once in 200,000; all that meet are checked.
    """
    real = lambda of: F.when(F.col(f"{of}version") < MISSING, F.col(f"{of}did"))
    out = grouped(docs, width, percent, bands, rows, part_bytes)
    kept = F.when(real("").isNull(), F.struct("did", "version") == F.col("head")).otherwise(real("").eqNullSafe(real("head.")))
    return out.select(real("").alias("doc_id"), F.col("n").alias("n_shingles"), real("head.").alias("component_id"), kept.alias("kept"))


def drop_near_duplicates(docs: DataFrame, width: int = SHINGLE, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """docs without near copies: of each component the text of the smallest doc_id stays, a null one being the largest.

    A text's component decides, not its doc_id. Of rows with equal id and text one stays; rows without words all stay.
    All other columns stay as they are, whatever their names.
    """
    found = grouped(docs.select("doc_id", "text"), width, percent, bands, rows)
    kept = found.where(F.struct("did", "version") == F.col("head")).groupBy("did", "version").agg((F.max("n") > 0).alias("worded"))
    keyed = docs.select(F.struct(*docs.columns).alias("row")).withColumn("id", F.coalesce("row.doc_id", F.lit(LAST)))
    keyed = keyed.withColumn("of", version_of(F.coalesce(F.col("row.text").cast("string"), F.lit("")), F.col("row.doc_id")))
    held = keyed.join(kept, F.expr("id = did and of = version"))
    held = held.withColumn("number", F.when(~F.col("worded"), F.monotonically_increasing_id()))
    held = held.dropDuplicates(["id", "of", "number"])
    return held.select(*[F.col("row")[c].alias(c) for c in docs.columns])
