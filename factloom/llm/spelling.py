"""Spelling variants by a rare-first prefix filter on positional bigrams.

One edit spoils at most two of a word's bigrams. So of the three rarest bigrams of a word at least one is in the other word
of a near pair too, moved by at most one place; and with one global order of bigrams, by frequency among all words, it is
among the rarest three of both, or of one and tied with the third of the other. Words are joined on these bigrams alone, with
positions at most one apart. The join compares lengths, letters and the first HEAD letters, so that hardly a row leaves it
that is not a near pair; what does is verified on whole words. A bigram's row has a word's number and head, so long words
cost no more than their bigrams. All words are counted first, inside each task and then over all; the bigrams of 90
letters are at most 8,100, whatever the texts.

Defined results: a null text has no words; a null id is an empty string in what is hashed; equal rows count each; a
run of letters may have any length; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage, texts_of

LEAST_LENGTH, LEAST_COUNT, RATIO = 6, 5, 5
#: One of so many runs loses a letter.
SLIPS = 199
#: Rarest bigrams that are joined, and how far they may move: for one edit of bigrams.
RAREST, MOVED = 3, 1
#: Letters of a word that the join compares, and rows that a task makes at a time.
HEAD, ROWS = 32, 50_000
#: Characters of a text that are searched at a time, and words that a task counts before it hands them on.
PIECE, HELD = 1 << 22, 200_000

LETTERS = "a-zÀ-ÿ"


def runs(text: str, least: int) -> Iterator[list[str]]:
    """The maximal runs of at least `least` letters, with A-Z in lower case, a piece of the text at a time."""
    text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    run, apart = re.compile(f"[{LETTERS}]{{{least},}}"), re.compile(f"[^{LETTERS}]")
    at = 0
    while at < len(text):
        gap = apart.search(text, at + PIECE)
        end = gap.start() if gap else len(text)
        yield run.findall(text, at, end)
        at = end


def slipped(run: str, crc: int, slips: int) -> str:
    """The run, without one letter if its hash says so; crc: of what stands before it."""
    h = zlib.crc32(run.encode(), crc)
    if h % slips:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(least: int, slips: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        done = lambda: pa.record_batch([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for number, text in zip(batch.column(0), batch.column(1), strict=True):
                crc = zlib.crc32(f"{'' if (i := number.as_py()) is None else i}:".encode())
                for some in runs(text.as_py(), least):
                    for word, n in Counter(some).items():
                        word = slipped(word, crc, slips)
                        if len(word) >= least:
                            found[word] += n
                if len(found) > HELD:
                    yield done()
                    found.clear()
        yield done()

    return run


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, slips: int = SLIPS) -> DataFrame:
    """(word, n): the words of docs (doc_id, text) that are long and frequent enough."""
    counted = texts_of(docs, "doc_id", "text").mapInArrow(_counted(least_length, slips), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _grams(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter[str] = Counter()
    for batch in batches:
        for word in batch.column(0).to_pylist():
            found.update(word[i : i + 2] for i in range(len(word) - 1))
    yield pa.record_batch([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["gram", "n"])


def rarest(word: str, order: dict[str, int]) -> Iterator[tuple[int, int]]:
    """(place of the bigram in the global order, position in the word) of the RAREST rarest, and of what ties with the last."""
    of = lambda i: order[word[i : i + 2]]
    last = heapq.nsmallest(RAREST, map(of, range(len(word) - 1)))[-1]
    return ((place, i) for i in range(len(word) - 1) if (place := of(i)) <= last)


def letters(word: str) -> int:
    """A bit for each letter of the word; the accented ones share some."""
    bits = 0
    for c in set(word):
        k = ord(c) - 97 if c < "{" else 26 + (ord(c) - 0xC0) % 37
        bits |= 1 << k
    return bits


def _signed(order: dict[str, int]):
    names = ["id", "head", "size", "letters", "gram", "position"]
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        done = lambda: pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            for id_, word in zip(batch.column(0), batch.column(1), strict=True):
                id_, word = id_.as_py(), word.as_py()
                own = (id_, word[:HEAD], len(word), letters(word))
                for found in rarest(word, order):
                    rows.append((*own, *found))
                    if len(rows) >= ROWS:
                        yield done()
                        rows = []
        if rows:
            yield done()

    return run


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) for every two words (id, word, n) that differ by one letter put in, left out or replaced, both ways."""
    grams = words.select("word").mapInArrow(_grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    order = {r.gram: k for k, r in enumerate(grams.orderBy("n", "gram").collect())}  # of at most 8,100
    signed = stage(words.select("id", "word").mapInArrow(_signed(order), "id long, head string, size int, letters long, gram int, position int"), "rarest")
    left = signed.withColumn("position", F.explode(F.array(*[F.col("position") + k for k in range(-MOVED, MOVED + 1)])))
    right = signed.select("gram", "position", *[F.col(c).alias(f"other_{c}") for c in ("id", "head", "size", "letters")])
    # heads of near words are two edits apart at most, and whole words that are no longer one
    alike = f"id < other_id and abs(size - other_size) <= 1 and bit_count(letters ^ other_letters) <= 2 and levenshtein(head, other_head, 2) between 0 and if(greatest(size, other_size) <= {HEAD}, 1, 2)"
    met = stage(left.where("position >= 0").join(right, ["gram", "position"]).where(alike).select("id", "other_id").distinct(), "met")
    near = met.join(words, "id").join(words.select(F.col("id").alias("other_id"), F.col("word").alias("other"), F.col("n").alias("other_n")), "other_id")
    near = stage(near.where("levenshtein(word, other, 1) = 1").select("word", "n", "other", "other_n"), "near")
    return near.union(near.select("other", "other_n", "word", "n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the last word that forms lead to. Every round follows twice as many forms as the one
    before, and a form is RATIO times as frequent as its word, so few rounds suffice."""
    known = stage(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        step = known.select(F.col("word").alias("of"), F.col("root").alias("next"))
        further = known.join(step, F.col("root") == F.col("of"), "left")
        known = stage(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if known.where("moved").isEmpty():
            return known.select("word", "root")


def spelling_variants(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, ratio: int = RATIO, slips: int = SLIPS) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word of docs (doc_id, text) that is long and frequent enough."""
    words = stage(word_counts(docs, least_length, least_count, slips).withColumn("id", F.monotonically_increasing_id()), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), "other"))
    near = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    all_ = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= F.col("n") * ratio, F.col("best")).alias("best"))
    all_ = stage(all_.select("word", "n", "n_near", F.col("best.other").alias("form"), (-F.col("best.less")).alias("form_n")), "variants")
    last = roots(all_.where("form is not null"))
    return all_.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
