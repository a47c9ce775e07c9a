"""Shards of nearly equal bytes by sampled splitters: DataFrame and SQL functions alone.

Records are ordered by a hash of their text, then id, so that equal texts lie together. Size-weighted samples of these
keys are drawn, and their quantiles are the boundaries of RANGES ranges; every record goes to its range. A range with
more than RANGE_ROWS records is overfull and is subdivided at the quantiles of a sample of its own, so a key that holds a
third of all rows is many pieces. Sums over pieces say where each piece begins among all bytes, a running sum inside it
where each record does, and the shards are cut from that order by exact bytes.

Equal texts are one unit that no cut divides, as long as they hold at most 1/PARTS of a shard. Records longer than that
(at most shards * PARTS, whatever the input) cannot be cut: they are dealt first, the longest to the emptiest shard, and
the ranges fill the shards up to one level. So two shards differ by at most 1/PARTS of one, unless a single record
is longer than a shard.

Defined results: a null text is an empty one; null and repeated ids are rows like others; among equal rows any may come
first; with fewer records than shards some shards stay empty; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stage

SHARDS = 24
#: Parts of a shard: what is longer than one is dealt on its own.
PARTS = 32
#: Ranges of the first sample, rows that a range may have before it is subdivided, samples for each boundary.
RANGES, RANGE_ROWS, SAMPLES = 1024, 1 << 20, 16
#: Boundaries that one step of the search goes through.
STEP = 32


def _drawn(share: Column, seed: int) -> Column:
    """True with this probability, by a hash of the row's number."""
    return (F.xxhash64("row", F.lit(seed)).bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))) < share


def _quantiles(sample: DataFrame, many: Column, by: list[str]) -> DataFrame:
    """Boundaries (array of arrays of at most STEP) at the quantiles of the sample's weights, for each value of `by`.

    A boundary lies where a text begins, unless its copies may be divided.
    """
    order = W.partitionBy(*by).orderBy("key", "doc_id", "row")
    upto = F.sum("weight").over(order.rowsBetween(W.unboundedPreceding, 0))
    cut = F.floor(upto * many / F.sum("weight").over(W.partitionBy(*by)))
    cuts = sample.select(*by, "key", "doc_id", "row", "split", cut.alias("cut")).withColumn("last", F.lag("cut", 1, 0).over(order)).where("cut > last")
    begin = F.struct("key", F.when(F.col("split"), F.col("doc_id")).alias("doc_id"), F.when(F.col("split"), F.col("row")).otherwise(F.lit(-1)).alias("row"))
    flat = F.sort_array(F.collect_set(begin))
    return cuts.groupBy(*by).agg(flat.alias("flat")).select(*by, F.expr(f"transform(sequence(0, (size(flat) - 1) div {STEP}), i -> slice(flat, i * {STEP} + 1, {STEP}))").alias("bounds"))


def _place(bounds: Column) -> Column:
    """How many boundaries lie at or before a row: the group of boundaries first, then the place in it."""
    here = F.struct("key", "doc_id", "row")
    groups = F.size(F.filter(bounds, lambda g: g[0] <= here))
    inside = F.size(F.filter(F.get(bounds, groups - 1), lambda b: b <= here))
    return F.when(groups > 0, (groups - 1) * STEP + inside).otherwise(0)


def dealt(long: DataFrame, shards: int) -> DataFrame:
    """The rows of long with their shard and slot: the longest first, each to the shard with the fewest bytes so far.

    One row holds them all meanwhile; they are at most shards * PARTS.
    """
    items = F.sort_array(F.collect_list(F.struct((-F.col("size")).alias("less"), "key", "doc_id", "row", "text_crc32")))
    start = F.struct(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"), F.array().cast("array<int>").alias("at"))

    def step(held: Column, item: Column) -> Column:
        emptiest = F.array((F.array_position(held["loads"], F.array_min(held["loads"])) - 1).cast("int"))
        return F.transform(emptiest, lambda e: F.struct(F.transform(held["loads"], lambda load, k: F.when(k == e, load - item["less"]).otherwise(load)).alias("loads"), F.concat(held["at"], F.array(e)).alias("at")))[0]

    one = long.agg(items.alias("items")).select("items", F.aggregate("items", start, step)["at"].alias("at"))
    each = one.select(F.explode(F.arrays_zip("items", "at")).alias("x")).select("x.items.*", F.col("x.at").alias("shard"))
    slot = F.row_number().over(W.partitionBy("shard").orderBy("less", "key", "doc_id", "row")) - 1
    return each.select("doc_id", (-F.col("less")).alias("size"), "text_crc32", "shard", slot.cast("long").alias("slot"))


def filled(loads: list[int], more: int) -> list[int]:
    """Where each shard but the last ends when `more` bytes fill shards that hold `loads` up to one level."""
    lowest, below = sorted(loads), 0
    level = None
    for k, load in enumerate(lowest, 1):
        below += load
        level = min(x for x in (level, -(-(more + below) // k)) if x is not None)
    ends, end = [], 0
    for load in loads[:-1]:
        end += max(0, level - load)
        ends.append(end)
    return ends


def shard(docs: DataFrame, shards: int = SHARDS, parts: int = PARTS, ranges: int = RANGES, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, size (bytes and 8), text_crc32, law, shard, slot, grown_shard for every row of docs (doc_id, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    key = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    rows = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), key.alias("key"), F.monotonically_increasing_id().alias("row"))
    rows = stage(rows, "records")
    total, many = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    most_bytes, most_rows = total // (shards * parts), many // (shards * parts)

    long = stage(dealt(rows.where(F.col("size") > most_bytes), shards), "long")
    held = {r.shard: (r.bytes, r.rows) for r in long.groupBy("shard").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()}
    loads, before = ([held.get(k, (0, 0))[i] for k in range(shards)] for i in (0, 1))
    left_bytes, left_rows = max(1, total - sum(loads)), max(1, many - sum(before))

    rest = rows.where(F.col("size") <= most_bytes)
    large = rest.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).where((F.col("bytes") > most_bytes) | (F.col("rows") > most_rows))
    large = stage(large.select("key", F.lit(True).alias("large")), "large")
    # at most 2 * shards * parts keys can be large
    weight = F.col("size") / F.lit(float(left_bytes)) + F.lit(1.0 / left_rows)
    rest = rest.join(F.broadcast(large), "key", "left").withColumn("split", F.coalesce("large", F.lit(False))).drop("large").withColumn("weight", weight)

    share = F.least(F.lit(1.0), F.col("weight") * (ranges * SAMPLES / 2))
    bounds = _quantiles(rest.where(_drawn(share, 1)).withColumn("weight", F.col("weight") / share), F.lit(ranges), [])
    bounds = stage(bounds, "bounds")
    ranged = rest.withColumn("bounds", bounds.scalar()).withColumn("range", _place(F.col("bounds"))).drop("bounds")

    full = ranged.groupBy("range").agg(F.count("*").alias("rows"), F.sum("weight").alias("whole")).where(F.col("rows") > range_rows)
    full = stage(full.select("range", F.ceil(F.col("rows") * 2 / range_rows).alias("pieces"), "whole"), "overfull")
    inside = ranged.join(F.broadcast(full), "range")  # at most `ranges` of them
    share = F.least(F.lit(1.0), F.col("weight") / F.col("whole") * F.col("pieces") * SAMPLES)
    within = _quantiles(inside.where(_drawn(share, 2)).withColumn("weight", F.col("weight") / share), F.max("pieces").over(W.partitionBy("range")), ["range"])
    within = stage(within, "within")
    pieced = ranged.join(within, "range", "left").withColumn("piece", F.when(F.col("bounds").isNull(), 0).otherwise(_place(F.col("bounds")))).drop("bounds", "weight")
    pieced = stage(pieced, "pieces")

    cells = pieced.groupBy("range", "piece").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    so_far = W.orderBy("range", "piece").rowsBetween(W.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    cells = stage(cells.select("range", "piece", F.coalesce(F.sum("bytes").over(so_far), zero).alias("from_byte"), F.coalesce(F.sum("rows").over(so_far), zero).alias("from_row")), "cells")

    cell = W.partitionBy("range", "piece")
    order = cell.orderBy("key", "doc_id", "row")
    run = pieced.withColumns({"upto": F.sum("size").over(order.rowsBetween(W.unboundedPreceding, 0)), "number": F.row_number().over(order)})
    unit = W.partitionBy("range", "piece", "key")
    run = run.withColumns({"unit": F.sum("size").over(unit), "begin": F.min(F.col("upto") - F.col("size")).over(unit)}).join(cells, ["range", "piece"])
    # twice the middle of the row, or of the unit that stays whole
    middle = F.col("from_byte") * 2 + F.when(F.col("split"), F.col("upto") * 2 - F.col("size")).otherwise(F.col("begin") * 2 + F.col("unit"))
    at = reduce(add, [(F.lit(2 * end) <= F.col("middle")).cast("int") for end in filled(loads, total - sum(loads))], F.lit(0))
    placed = run.withColumn("middle", middle).select("doc_id", "size", "text_crc32", at.alias("shard"), (F.col("from_row") + F.col("number")).alias("number"))
    placed = stage(placed, "placed")
    first = placed.groupBy("shard").agg(F.min("number").alias("first"))
    own = F.get(F.array(*[F.lit(n).cast("long") for n in before]), F.col("shard"))
    short = placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("number") - F.col("first") + own).alias("slot"))
    out = long.unionByName(short)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
