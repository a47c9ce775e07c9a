"""Removal of lines that many documents share, by two Bloom filters and exact confirmation of what they suspect.

The filters, of hashes seen once and of those seen twice, are sized by the number of lines and cut into blocks that
never lie in one place: a hash's block is named by the hash. Tasks send a block the different hashes that they met, a hot
line once each; where a block's hashes come together, those that its once-filter holds already go into its
twice-filter, and all hashes that this one then holds are suspects. Equal lines are never missed, and a chance hit only sends a
line to the exact count. Suspects' lines alone are shuffled: they are found by a filter that goes to all tasks, sized by the
number of suspects, or by a join on the hash where that filter would be beyond `most_bits`.

Defined results: a null or empty text is one empty line; a row with null doc_id counts as one document below all
others and gets null back; equal rows get equal results; an empty table gives an empty result; further columns of docs
are kept as they are, but for its own ones of the added names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BITS_EACH, BLOCK, MOST_BITS, NO_ID, chunks, filter_of, hash_strings, holds, mix, put, small_batches, stage

LEAST_CHARS = 40
LEAST_DOCS = 5
#: Hashes that a task holds before it sends them.
HELD_HASHES = 1 << 20


def keys_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Of every line of every text: its key, the number of its text and its number there."""
    lines = pc.split_pattern(texts, "\n")
    owner = pc.list_parent_indices(lines).to_numpy()
    key = pc.ascii_lower(pc.ascii_trim(lines.flatten(), characters=" \t\n\x0b\x0c\r"))
    first = np.searchsorted(owner, np.arange(len(texts)))
    return key, owner, np.arange(len(owner)) - first[owner]


def long_keys(texts: pa.Array, least_chars: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    key, owner, number = keys_of(texts)
    keep = np.flatnonzero(pc.utf8_length(key).to_numpy() >= least_chars)
    return key.take(pa.array(keep)), owner[keep], number[keep]


def _seen(blocks: int, least_chars: int):
    """The different hashes that a task has met, by block, and which of them it met in two texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        many = 0

        def sent() -> pa.RecordBatch:
            h, times = np.unique(np.concatenate(held), return_counts=True)
            block = mix(h) % np.uint64(blocks)
            order = np.argsort(block, kind="stable")
            h, twice, block = h[order], times[order] > 1, block[order].astype(np.int64)
            edge = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            ends = [*edge[1:].tolist(), len(h)]
            columns = [[h[a:b].tobytes() for a, b in zip(edge, ends, strict=True)], [np.packbits(twice[a:b]).tobytes() for a, b in zip(edge, ends, strict=True)]]
            return pa.record_batch([pa.array(block[edge]), *[pa.array(c, pa.binary()) for c in columns]], names=["block", "hashes", "twice"])

        for part in chunks(batches):
            key, owner, _ = long_keys(part.column(0), least_chars)
            if len(key):
                h = hash_strings(key)
                order = np.lexsort((owner, h))
                h, owner = h[order], owner[order]
                held.append(h[np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])]])
                many += len(held[-1])
            if many >= HELD_HASHES:
                yield sent()
                held, many = [], 0
        if held:
            yield sent()

    return run


def _repeated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every block, whose rows come together, the hashes that its twice-filter holds."""

    def suspects(parts: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
        once, twice = np.zeros(BLOCK, np.uint8), np.zeros(BLOCK, np.uint8)
        seen = []
        for raw, flags in parts:
            h = np.frombuffer(raw, np.uint64)
            put(twice, h[np.unpackbits(np.frombuffer(flags, np.uint8), count=len(h)).astype(bool) | holds(once, h)])
            put(once, h)
            seen.append(h)
        h = np.unique(np.concatenate(seen))
        return pa.record_batch([pa.array(h[holds(twice, h)].view(np.int64))], names=["h"])

    block, parts = None, []
    for batch in batches:
        for k, hashes, flags in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if k != block and parts:
                yield suspects(parts)
                parts = []
            block = k
            parts.append((hashes, flags))
    if parts:
        yield suspects(parts)


def suspect_hashes(texts: DataFrame, least_chars: int) -> DataFrame:
    """Hashes (h) of the keys that two texts hold, and few others."""
    most = texts.agg(F.sum(F.floor((F.char_length("text") + 1) / (least_chars + 1)))).first()[0] or 0
    blocks = max(1, -(-int(most) * BITS_EACH // (8 * BLOCK)))
    seen = texts.mapInArrow(_seen(blocks, least_chars), "block long, hashes binary, twice binary")
    return seen.repartition("block").sortWithinPartitions("block").mapInArrow(_repeated, "h long")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, most_bits: int = MOST_BITS) -> DataFrame:
    """docs with text replaced by the lines that stay, and n_lines (before) and n_dropped.

    A line's key is the line without white space at both ends and with A-Z in lower case. Keys of least_chars code points
    that least_docs documents hold lose all their lines except those in the largest doc_id holding them.
    """
    small_batches(spark)
    extra = [c for c in docs.columns if c not in ("doc_id", "text", "n_lines", "n_dropped")]
    own = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("__id"), F.coalesce("text", F.lit("")).alias("__text"), F.struct(F.lit(0).alias("__none"), *extra).alias("__rest"))
    hashes = stage(suspect_hashes(own.select(F.col("__text").alias("text")), least_chars), "hashes")
    whole = filter_of(hashes, most_bits)
    shared = None if whole is None else spark.sparkContext.broadcast(whole)

    def suspect(key: pa.Array) -> np.ndarray:
        h = hash_strings(key)
        return np.ones(len(h), bool) if shared is None else holds(shared.value, mix(h))

    def suspects(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            key, owner, number = long_keys(part.column(2), least_chars)
            at = np.flatnonzero(suspect(key))
            if len(at):
                key, of = key.take(pa.array(at)), pa.array(owner[at])
                yield pa.record_batch([part.column(0).take(of), part.column(1).take(of), key.cast(pa.string()), pa.array(hash_strings(key).view(np.int64)), pa.array(number[at].astype(np.int32))], names=["id", "version", "key", "h", "line"])

    @F.arrow_udf(T.BooleanType())
    def suspected(texts: pa.Array) -> pa.Array:
        out = np.zeros(len(texts), bool)
        first = 0
        for part in chunks([pa.record_batch([texts], names=["text"])]):
            key, owner, _ = long_keys(part.column(0), least_chars)
            out[first + owner[suspect(key)]] = True
            first += part.num_rows
        return pa.array(out)

    version = F.xxhash64("__text")
    found = own.select(F.col("__id").alias("id"), version.alias("version"), F.col("__text").alias("text")).mapInArrow(suspects, "id long, version long, key string, h long, line int")
    if shared is None:
        found = found.join(hashes, "h", "left_semi")
    found = stage(found.drop("h"), "suspects")
    common = found.groupBy("key").agg(F.countDistinct("id").alias("docs"), F.max("id").alias("keeper")).where(F.col("docs") >= least_docs)
    common = stage(common, "common")  # a plain input of the join, so that a hot line's side can be split
    lost = found.join(common, "key").where("id <> keeper").groupBy(F.col("id").alias("__of"), F.col("version").alias("__version")).agg(F.collect_set("line").alias("__lost"))

    flagged = own.withColumn("__flag", suspected("__text"))
    clean = flagged.where(~F.col("__flag")).withColumn("__lost", F.lit(None).cast("array<int>"))
    marked = flagged.where("__flag")
    marked = marked.join(lost, (F.col("__id") == F.col("__of")) & (version == F.col("__version")), "left")
    columns = ["__id", "__text", "__rest", "__lost"]
    both = clean.select(columns).union(marked.select(columns)).withColumn("__lines", F.split("__text", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__lost")
    kept = F.when(F.col("__lost").isNull(), F.col("__text")).otherwise(F.array_join(F.transform(stay, lambda i: F.get("__lines", i)), "\n"))
    return both.select(
        F.when(F.col("__id") != NO_ID, F.col("__id")).alias("doc_id"), kept.alias("text"), *[F.col("__rest")[c].alias(c) for c in extra],
        F.size("__lines").cast("long").alias("n_lines"), F.coalesce(F.size("__lost"), F.lit(0)).cast("long").alias("n_dropped"),
    )
