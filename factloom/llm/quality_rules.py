"""Quality rules with cross-document line frequency.

Normalised lines are hashed, and the distinct documents of each host that hold them are counted. A line in more than
`most_docs` documents of a host is removed from all of them but the one with the smallest doc_id; a document that keeps
less than `least_left` of its words is depleted and rejected. Only hashes, ids and counts are shuffled.

Defined results: a null or empty text has no words and fails the base rules; a null source is a host like any other;
a null doc_id counts as one document above all others; equal rows get equal results; an empty table gives an empty
result; columns other than the three named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, buffer_of, chunks, code_points, hash_ranges, stage, texts_of, words_of

LEAST_WORDS = 50
#: A line in more documents of its host than this is boilerplate there.
MOST_DOCS = 20
#: A document that keeps a smaller share of its words is depleted.
LEAST_LEFT = 0.3
SYMBOLS = np.zeros(256, bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True
NO_DOC = 2**63 - 1


def per_text(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every line of every text, and the number of its text."""
    cut = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([at[:-1], cut + 1]), kind="stable")
    n = np.searchsorted(cut, at[1:]) - np.searchsorted(cut, at[:-1]) + 1
    owner = np.repeat(np.arange(len(at) - 1), n)
    end = np.empty(len(start), np.int64)
    last = np.cumsum(n) - 1
    end[:-1] = start[1:] - 1
    end[last] = at[1:]
    return start, end, owner


def _repeats(key: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Whether an earlier entry of the same owner has the same key."""
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key), bool)
    k, o = key[order], owner[order]
    same[order[1:]] = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    return same


def measures(part: pa.Array) -> dict[str, np.ndarray]:
    """The base measures of every text, and of its lines with words the normalised hash and the number of words."""
    data, at = buffer_of(part)
    texts = len(at) - 1
    start, end, owner = words_of(data, at)
    points = code_points(data)
    n_words = np.bincount(owner, minlength=texts)
    chars = points[end] - points[start]
    _, word = np.unique(hash_ranges(data, start, end), return_inverse=True)
    n = len(word)
    covered = np.zeros(n, bool)
    if n > 2:
        base = int(word.max()) + 1
        _, pair = np.unique(word[:-1].astype(np.int64) * base + word[1:], return_inverse=True)
        gram = pair[:-1].astype(np.int64) * base + word[2:]
        inside = np.flatnonzero(owner[:-2] == owner[2:])
        order = inside[np.argsort(gram[inside], kind="stable")]
        g, o = gram[order], owner[order]
        same = (g[1:] == g[:-1]) & (o[1:] == o[:-1])
        twice = np.zeros(n, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        for k in range(3):
            covered[k:] |= twice[: n - k]
    a, b, of = _lines(data, at)
    held = np.searchsorted(start, b) - np.searchsorted(start, a)
    number = np.arange(len(a)) - np.searchsorted(of, np.arange(texts))[of]
    worded = held > 0
    a, b, of, held, number = a[worded], b[worded], of[worded], held[worded], number[worded]
    again = _repeats(hash_ranges(data, a, b), of)
    # normalised: from the first to the last word, A-Z in lower case, digits as 0
    plain = LOWER[data]
    plain[(plain >= 48) & (plain <= 57)] = 48
    first = np.searchsorted(start, a)
    line = hash_ranges(plain, start[first], end[first + held - 1])
    return {
        "n_words": n_words, "word_chars": np.bincount(owner, chars, texts).astype(np.int64), "n_symbols": per_text(SYMBOLS[data], at),
        "n_dup_lines": np.bincount(of[again], minlength=texts), "n_repeat_words": np.bincount(owner[covered], minlength=texts),
        "line": line, "line_words": held, "line_of": of, "line_number": number,
    }


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = "row long, doc_id long, host string, " + ", ".join(f"{c} long" for c in _COUNTS) + ", lines array<long>, words array<int>"


def _measured(with_text: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 36
        for part in chunks(batches):
            m, n = measures(part.column(2)), part.num_rows
            at = pa.array(np.searchsorted(m["line_of"], np.arange(n + 1)).astype(np.int32))
            lists = [m["line"].view(np.int64), m["line_words"].astype(np.int32), m["line_number"].astype(np.int32)][: 2 + with_text]
            lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in lists] + [part.column(2)] * with_text
            yield pa.record_batch([pa.array(np.arange(row, row + n)), part.column(0), part.column(1), *[pa.array(m[c].astype(np.int64)) for c in _COUNTS], *lists], names=["row", "doc_id", "host", *_COUNTS, "lines", "words", "numbers", "text"][: 5 + len(_COUNTS) + 2 * with_text])
            row += n

    return run


def line_quality(docs: DataFrame, least_words: int = LEAST_WORDS, most_docs: int = MOST_DOCS, least_left: float = LEAST_LEFT, with_text: bool = False) -> DataFrame:
    """The base measures of every row of docs (doc_id, source, text), removed_words, base_failed, kept and, with_text, the
    text without the removed lines."""
    own = texts_of(docs, "doc_id", "source", "text")
    found = stage(own.mapInArrow(_measured(with_text), _SCHEMA + ", numbers array<int>, text string" * with_text), "measures")
    passed = (F.col("n_words") >= least_words) & (100 * F.col("n_repeat_words") <= 50 * F.col("n_words"))
    doc = F.coalesce("doc_id", F.lit(NO_DOC))
    lines = found.select("row", doc.alias("doc"), F.coalesce(F.concat(F.lit("s"), "host"), F.lit("")).alias("host"), F.explode(F.arrays_zip("lines", "words", *["numbers"] * with_text)).alias("x"))
    lines = lines.select("row", "doc", "host", F.col("x.lines").alias("line"), F.col("x.words").alias("words"), *[F.col("x.numbers").alias("number")] * with_text)
    common = lines.groupBy("host", "line").agg(F.countDistinct("doc").alias("docs"), F.min("doc").alias("first")).where(F.col("docs") > most_docs)
    common = stage(common, "common")  # a plain input of the join, so that a hot line's side can be split
    removed = lines.join(common, ["host", "line"]).where(F.col("doc") != F.col("first")).groupBy("row").agg(F.sum("words").alias("removed_words"), *[F.collect_set("number").alias("lost")] * with_text)
    out = found.drop("lines", "words", "numbers").join(removed, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)))
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("lost", i)), "\n")
    return out.select(
        "doc_id", *_COUNTS, "removed_words", (~passed).alias("base_failed"),
        (passed & (F.col("n_words") - F.col("removed_words") >= least_left * F.col("n_words"))).alias("kept"),
        *[F.when(F.col("lost").isNull(), F.col("text")).otherwise(left).alias("text")] * with_text,
    )
