"""Helpers that the operators of this subpackage share: Arrow buffers, vectorised hashing, staged tables."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Stands for a null id inside an operator; results have null again.
NO_ID = -(2**63)
#: Bytes of text that a kernel works on at a time, and bytes of an Arrow batch on its way to it.
CHUNK_BYTES, BATCH_BYTES = 1 << 20, 4 << 20
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words of 8 bytes that one step of a hash folds into one.
FOLD = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which every executor sees. Only a local master, where the driver is the one
    executor, may go without it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES and a row, so that long texts don't fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written once as Parquet to the shared folder and read again: lost executors cost no recomputation.

    The files go when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return spark.read.schema(df.schema).parquet(path)


def texts_of(docs: DataFrame, *columns: str) -> DataFrame:
    """The named columns, for a kernel; a null text is an empty one."""
    small_batches(docs.sparkSession)
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c == "text" else F.col(c) for c in columns])


def buffer_of(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all strings in a row, and where each begins (one more offset than strings)."""
    if isinstance(strings, pa.ChunkedArray):
        strings = strings.combine_chunks()
    strings = strings.cast(pa.large_binary())
    _, offsets, data = strings.buffers()
    if not len(strings):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64)[strings.offset : strings.offset + len(strings) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def chunks(batches: Iterable[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that column has about `most` bytes in each part; a longer text is a part of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = buffer_of(batch.column(batch.schema.get_field_index(column)))
        first = 0
        while first < batch.num_rows:
            last = max(first + 1, int(np.searchsorted(at, at[first] + most, "right")) - 1)
            yield batch.slice(first, last - first)
            first = last


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def hash_ranges(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of data[start:end] for every pair; it depends on these bytes alone.

    Every step mixes a word of 8 bytes into its range's hash; a range of more than FOLD words is cut into parts of as many,
    whose hashes are the words of the next round. No sum of powers: inputs cannot cancel out by their structure.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    words = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    size = (end - start).astype(np.int64)

    def word(at: np.ndarray, left: np.ndarray) -> np.ndarray:
        x = words[at]
        short = left < 8
        if short.any():
            x[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        return x

    h = _folded(lambda at, k: word(start[at] + 8 * k, size[at] - 8 * k), (size + 7) // 8)
    return mix(h ^ size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def _folded(word, many: np.ndarray) -> np.ndarray:
    """One hash for each row from its words; word(rows, numbers) gives words, many is how many each row has."""
    parts = np.maximum((many + FOLD - 1) // FOLD, 1)
    first = np.cumsum(parts) - parts
    row = np.repeat(np.arange(len(many)), parts)
    begin = (np.arange(len(row)) - first[row]) * FOLD
    held = np.minimum(many[row] - begin, FOLD)
    h = np.full(len(row), 0x9E3779B97F4A7C15, np.uint64)
    for k in range(int(held.max(initial=0))):
        at = np.flatnonzero(held > k) if k else np.flatnonzero(held > 0)
        h[at] = mix((h[at] ^ word(row[at], begin[at] + k)) + np.uint64((k + 1) * 0xA0761D6478BD642F % 2**64))
    if len(row) == len(many):
        return h
    long = np.flatnonzero(parts > 1)
    out = h[first]
    out[long] = _folded(lambda at, k: h[first[long[at]] + k], parts[long])
    return out


def hash_strings(strings: pa.Array) -> np.ndarray:
    data, at = buffer_of(strings)
    return hash_ranges(data, at[:-1], at[1:])


def words_of(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of texts that lie in a row: start, end, and number of the text."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = np.zeros(n + 2, bool)
    inside[1:-1] = ~SPACES[data]
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    edge = at[1:-1]
    edge = edge[(edge > 0) & (edge < n)]
    begins[edge] = inside[1:-1][edge]
    ends[edge - 1] = inside[1:-1][edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return start, end, np.searchsorted(at, start, "right") - 1


def code_points(data: np.ndarray) -> np.ndarray:
    """Code points that begin before each byte: one more entry than bytes."""
    out = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=out[1:])
    return out


#: Bytes of a block of a filter, bits for each entry, and the most bits of a filter that goes to every task.
BLOCK, BITS_EACH, MOST_BITS = 1 << 16, 12, 1 << 27


def filter_bits(entries: int) -> int:
    """Bits of a Bloom filter for so many entries: a power of two."""
    return 1 << max(13, (BITS_EACH * max(entries, 1) - 1).bit_length())


def places(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(bits - 1)).astype(np.int64), ((h >> np.uint64(32)) & np.uint64(bits - 1)).astype(np.int64)


def holds(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each hash may have been put into the Bloom filter; never False for one that was."""
    out = np.ones(len(h), bool)
    for at in places(h, len(filter_) * 8):
        out &= (filter_[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
    return out


def put(filter_: np.ndarray, h: np.ndarray) -> None:
    for at in places(h, len(filter_) * 8):
        np.bitwise_or.at(filter_, at >> 3, (1 << (at & 7)).astype(np.uint8))


def filter_of(ids: DataFrame, most_bits: int = MOST_BITS) -> np.ndarray | None:
    """A Bloom filter of the one long column of ids, sized by their number, or None where it would be beyond most_bits.

    Each task sends the places that it fills; the driver gets the filter alone, block by block.
    """
    bits = filter_bits(ids.count())
    if bits > most_bits:
        return None
    size = min(BLOCK, bits // 8)

    def filled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(np.concatenate(places(mix(batch.column(0).to_numpy().view(np.uint64)), bits)))
            block = at // (8 * size)
            edge = np.searchsorted(block, np.arange(bits // 8 // size + 1))
            some = np.flatnonzero(np.diff(edge))
            yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array([(at[edge[k] : edge[k + 1]] - k * 8 * size).astype(np.uint32).tobytes() for k in some], pa.binary())], names=["block", "at"])

    def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, own = None, np.zeros(8 * size, bool)
        done = lambda: pa.record_batch([pa.array([block], pa.int32()), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], names=["block", "bytes"])
        for batch in batches:
            for k, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != block:
                    if block is not None:
                        yield done()
                    block, own = k, np.zeros(8 * size, bool)
                own[np.frombuffer(raw, np.uint32)] = True
        if block is not None:
            yield done()

    whole = np.zeros(bits // 8, np.uint8)
    blocks = ids.mapInArrow(filled, "block int, at binary").repartition("block").sortWithinPartitions("block").mapInArrow(merged, "block int, bytes binary")
    for row in blocks.toLocalIterator():
        whole[row[0] * size : (row[0] + 1) * size] = np.frombuffer(bytes(row[1]), np.uint8)
    return whole


def maybe_among(ids: DataFrame):
    """A function from a long column to a condition, true for every value of the one column of ids and for few others.

    It thins out the large side of a join before its shuffle. For more ids than a filter of MOST_BITS serves it is
    always true, and the join alone decides.
    """
    whole = filter_of(ids)
    if whole is None:
        return lambda column: F.lit(True)
    shared = ids.sparkSession.sparkContext.broadcast(whole)

    @F.arrow_udf(T.BooleanType())
    def among(values: pa.Array) -> pa.Array:
        return pa.array(holds(shared.value, mix(values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))))

    return among
