"""A quality classifier without labelled rows: a weak-label model and a hashed linear scorer.

Overlapping heuristic labellers vote good, bad or nothing on every document. The counts of vote patterns over all
documents (at most 3^7 rows) are what expectation-maximisation needs to estimate how often each labeller is right. Its
posterior labels then train a logistic scorer on hashed features: pairs of bytes, and the labellers' measures in steps.
The scorer is fitted on `train_rows` documents (a bound, chosen by hash, all of them in a small table); votes are counted
on all.

Every text is measured and scored alike; shares of a short one are taken of LEAST_WORDS words, of which it shows but a part.

Defined results: a null or empty text is scored like one without faults; null ids and equal rows are scored like others; an
empty table gives an empty result; all columns of docs are kept as they are (its own ones of the added names are replaced).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import buffer_of, chunks, hash_ranges, mix, small_batches, words_of
from .quality_rules import per_text

TRAIN_ROWS = 3000
BUCKETS = 1 << 12
#: A document is rejected when the scorer gives it less than this chance of being good.
LEAST_SCORE = 0.5
#: What is believed of a labeller's false votes on good documents before any are seen, as if on so many times all documents.
FALSE_VOTES, BELIEF = 0.002, 50
ROUNDS = 120

LABELLERS = ("symbols", "shouting", "exclamation", "tables", "runs", "repeats", "word_length")
#: Of each labeller's measure: at or below the first it votes good, at or above the second bad, between them nothing.
LIMITS = {"symbols": (0.05, 0.2), "shouting": (0.15, 0.4), "exclamation": (0.03, 0.15), "tables": (0.05, 0.2), "runs": (0.06, 0.25), "repeats": (0.2, 0.8), "word_length": (0.0, 1.0)}
#: Shares are taken of so many words at least, with so many letters each.
LEAST_WORDS, WORD_LETTERS = 5, 5
STEPS = 16
PAIR_SCALE, MEASURE_SCALE = 20.0, 1.5
#: So many pairs count in favour of no feature, as a short text shows little.
PAIR_PRIOR = 50


def _mask(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_SYMBOLS, _BANG, _BAR, _UPPER, _LOWER = _mask("#*$%&<>{}^~\\"), _mask("!"), _mask("|"), _mask("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _mask("abcdefghijklmnopqrstuvwxyz")


def measures(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For every text the labellers' measures (texts x labellers)."""
    texts = len(at) - 1
    start, end, owner = words_of(data, at)
    n = np.bincount(owner, minlength=texts)
    some = np.maximum(n, LEAST_WORDS)
    upper, lower = per_text(_UPPER[data], at), per_text(_LOWER[data], at)
    word = hash_ranges(data, start, end) if len(start) else np.zeros(0, np.uint64)
    run = np.zeros(len(word), bool)
    run[1:] = (word[1:] == word[:-1]) & (owner[1:] == owner[:-1])
    if len(word) > 2:
        gram = mix(word[:-2] + mix(word[1:-1] + mix(word[2:]))) ^ mix(owner[:-2].astype(np.uint64))
        gram = np.sort(gram[owner[:-2] == owner[2:]] >> np.uint64(24) | owner[:-2][owner[:-2] == owner[2:]].astype(np.uint64) << np.uint64(40))
        again = gram[1:][gram[1:] == gram[:-1]]
        repeats = np.bincount((again >> np.uint64(40)).astype(np.int64), minlength=texts)
    else:
        repeats = np.zeros(texts)
    # letters of scripts that put blanks between words: U+0000 to U+07FF
    narrow = np.zeros(len(data) + 1, np.int32)
    np.cumsum((data < 0x80) | ((data >= 0xC0) & (data < 0xE0)), out=narrow[1:])
    letters = narrow[end] - narrow[start]
    spaced = np.bincount(owner[letters > 0], minlength=texts)
    length = np.bincount(owner, letters, texts) / np.maximum(spaced, 1)
    odd = ((length < 2.5) | (length > 14)).astype(float) * np.minimum(spaced / LEAST_WORDS, 1)
    out = np.stack([
        per_text(_SYMBOLS[data], at) / some, upper / np.maximum(upper + lower, LEAST_WORDS * WORD_LETTERS), per_text(_BANG[data], at) / some, per_text(_BAR[data], at) / some,
        np.bincount(owner[run], minlength=texts) / some, repeats / some, odd,
    ], axis=1)
    return out


def votes(found: np.ndarray) -> np.ndarray:
    """1 bad, 0 good, 2 nothing."""
    low, high = (np.array([LIMITS[k][i] for k in LABELLERS]) for i in (0, 1))
    return np.where(found >= high, 1, np.where(found <= low, 0, 2))


def pattern_of(v: np.ndarray) -> np.ndarray:
    return v @ (3 ** np.arange(len(LABELLERS)))


def features(data: np.ndarray, at: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse hashed features: text, bucket, value. Pairs of bytes by share, measures as one bucket for each step."""
    texts = len(at) - 1
    owner = np.repeat(np.arange(texts), np.diff(at))[:-1]
    pair = data[:-1].astype(np.int64) << 8 | data[1:]
    inside = owner == np.repeat(np.arange(texts), np.diff(at))[1:]
    cell, many = np.unique(owner[inside] << 16 | pair[inside], return_counts=True)
    of = cell >> 16
    value = PAIR_SCALE * many / (np.diff(at) + PAIR_PRIOR)[of]
    step = measure_buckets(found)
    k = step.shape[1]
    return np.concatenate([of, np.repeat(np.arange(texts), k)]), np.concatenate([PAIR_BUCKET[cell & 0xFFFF], step.reshape(-1)]), np.concatenate([value, np.full(texts * k, MEASURE_SCALE)])


PAIR_BUCKET = (mix(np.arange(1 << 16, dtype=np.uint64)) % np.uint64(BUCKETS)).astype(np.int64)


def measure_buckets(found: np.ndarray) -> np.ndarray:
    high = np.array([LIMITS[k][1] for k in LABELLERS])
    step = np.minimum(found / high * (STEPS // 2), STEPS - 1).astype(np.int64)
    return (mix((1 << 20) + step + STEPS * np.arange(len(LABELLERS))) % np.uint64(BUCKETS)).astype(np.int64)


@dataclass
class Model:
    posterior: dict[int, float]  # of being bad, by vote pattern
    accuracy: dict[str, float]
    weights: np.ndarray
    bias: float


def estimate(counts: dict[int, int], rounds: int = 60) -> tuple[dict[int, float], dict[str, float]]:
    """Posterior of bad for each vote pattern, and each labeller's accuracy, by expectation-maximisation.

    Hidden classes: good, and one kind of fault for each labeller to begin with, as a labeller that looks for one fault
    has nothing to say on another. Every class has its own chance of each labeller's votes. Expected counts have beliefs
    added to them: a labeller that votes bad on a good document is rare.
    """
    patterns = np.array(sorted(counts), np.int64)
    many = np.array([counts[p] for p in patterns], float)[:, None]
    v = patterns[:, None] // 3 ** np.arange(len(LABELLERS)) % 3
    fired = (v == 1).astype(float)
    share = np.hstack([np.where(fired.any(axis=1), 0.05, 1.0)[:, None], fired + 1e-6])
    share /= share.sum(axis=1, keepdims=True)
    prior, belief = np.r_[10.0, np.full(len(LABELLERS), 0.1)], np.full((2, len(LABELLERS) + 1, len(LABELLERS)), 0.1)
    belief[:, 0] = BELIEF * many.sum() * np.array([1 - FALSE_VOTES, FALSE_VOTES])[:, None]
    for _ in range(rounds):
        size = (share * many).sum(axis=0) + prior
        size /= size.sum()
        says = np.stack([(share * many).T @ (v == value) for value in (0, 1)]) + belief  # votes x classes x labellers
        seen = says / says.sum(axis=0)
        log = np.log(size)[None] + (v == 0) @ np.log(seen[0]).T + (v == 1) @ np.log(seen[1]).T
        share = np.exp(log - log.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
    spoken = says[0] + says[1] - belief.sum(axis=0)  # votes of each class and labeller, without beliefs
    right = np.vstack([seen[0][:1], seen[1][1:]])
    accuracy = (right * spoken).sum(axis=0) / np.maximum(spoken.sum(axis=0), 1e-9)
    return dict(zip(patterns.tolist(), (1 - share[:, 0]).tolist(), strict=True)), dict(zip(LABELLERS, accuracy.tolist(), strict=True))


def fit_scorer(rows: int, of: np.ndarray, bucket: np.ndarray, value: np.ndarray, bad: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic scorer for good, by gradient steps of AdaGrad on the posterior labels."""
    w, b = np.zeros(BUCKETS), 0.0
    gw, gb = np.full(BUCKETS, 1e-8), 1e-8
    good = 1 - bad
    # both classes weigh the same, as the rarer one would drown
    weight = np.where(good > 0.5, 0.5 / max((good > 0.5).sum(), 1), 0.5 / max((good <= 0.5).sum(), 1))
    for _ in range(rounds):
        z = np.bincount(of, w[bucket] * value, rows) + b
        slope = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - good)
        g = np.bincount(bucket, slope[of] * value, BUCKETS) + 1e-6 * w
        gw, gb = gw + g * g, gb + slope.sum() ** 2
        w, b = w - 0.5 * g / np.sqrt(gw), b - 0.5 * slope.sum() / np.sqrt(gb)
    return w, float(b)


def _parts(texts: pa.Array):
    for part in chunks([pa.record_batch([texts], names=["text"])]):
        yield buffer_of(part.column(0))


@F.arrow_udf(T.IntegerType())
def vote_pattern(texts: pa.Array) -> pa.Array:
    found = [pattern_of(votes(measures(*part))) for part in _parts(texts)]
    return pa.array(np.concatenate(found or [np.zeros(0)]).astype(np.int32))


def fit(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """The model for docs (text). Only vote counts and the features of some train_rows documents reach the driver.

    Rows are drawn by their number, so that missing or repeated ids and texts change nothing.
    """
    small_batches(docs.sparkSession)
    own = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.monotonically_increasing_id()).alias("h"))
    counted = own.select(vote_pattern("text").alias("pattern")).groupBy("pattern").count().collect()
    counts = {r["pattern"]: r["count"] for r in counted}
    posterior, accuracy = estimate(counts) if counts else ({}, {})
    share = min(1.0, train_rows / max(1, sum(counts.values())))

    def run(batches):
        for part in chunks(batches):
            data, at = buffer_of(part.column(0))
            found = measures(data, at)
            of, bucket, value = features(data, at, found)
            order = np.argsort(of, kind="stable")
            edge = pa.array(np.searchsorted(of[order], np.arange(len(at))).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edge, pa.array(x[order])) for x in (bucket.astype(np.int32), value.astype(np.float32))]
            yield pa.record_batch([pa.array(pattern_of(votes(found)).astype(np.int32)), *lists], names=["pattern", "bucket", "value"])

    # a chance of 2^-64 steps
    some = own if share == 1 else own.where(F.col("h") < F.lit(int(-(2**63) + share * (2**64 - 1))))
    got = some.select("text").mapInArrow(run, "pattern int, bucket array<int>, value array<float>").toArrow()
    if not got.num_rows:
        if counts:
            raise ValueError("no row was drawn to train on: ask for more train_rows")
        return Model(posterior, accuracy, np.zeros(BUCKETS), 1.0)
    of = np.repeat(np.arange(got.num_rows), [len(x) for x in got["bucket"]])
    bucket, value = (got[c].combine_chunks().flatten().to_numpy(zero_copy_only=False) for c in ("bucket", "value"))
    w, b = fit_scorer(got.num_rows, of, bucket, value.astype(float), np.array([posterior.get(p, 0.0) for p in got["pattern"].to_pylist()]))
    return Model(posterior, accuracy, w, b)


def score(docs: DataFrame, model: Model, least_score: float = LEAST_SCORE) -> DataFrame:
    """docs with weak_bad (posterior of the votes), quality_score (the scorer's chance of good) and kept."""
    weights, bias, pair_weight = model.weights, model.bias, PAIR_SCALE * model.weights[PAIR_BUCKET]
    posterior = np.zeros(3 ** len(LABELLERS))
    for p, x in model.posterior.items():
        posterior[p] = x

    @F.arrow_udf(T.StructType([T.StructField("bad", T.DoubleType()), T.StructField("score", T.DoubleType())]))
    def judged(texts: pa.Array) -> pa.Array:
        bad, scores = [], []
        for data, at in _parts(texts):
            found = measures(data, at)
            # the same sum as over features(), without counting equal pairs
            total = np.zeros(max(len(data), 1))
            np.cumsum(pair_weight[data[:-1].astype(np.int64) << 8 | data[1:]], out=total[1 : len(data)])
            last = np.maximum(at[1:] - 1, at[:-1])
            z = (total[np.minimum(last, len(total) - 1)] - total[np.minimum(at[:-1], len(total) - 1)]) / (np.diff(at) + PAIR_PRIOR)
            z += MEASURE_SCALE * weights[measure_buckets(found)].sum(axis=1) + bias
            scores.append(1 / (1 + np.exp(-np.clip(z, -50, 50))))
            bad.append(posterior[pattern_of(votes(found))])
        columns = [pa.array(np.concatenate(x or [np.zeros(0)]), pa.float64()) for x in (bad, scores)]
        return pa.StructArray.from_arrays(columns, names=["bad", "score"])

    small_batches(docs.sparkSession)
    own = [c for c in docs.columns if c not in ("weak_bad", "quality_score", "kept")]
    out = docs.select(F.struct(*own).alias("row"), judged(F.coalesce("text", F.lit(""))).alias("judged"))
    return out.select(*[F.col("row")[c].alias(c) for c in own], F.col("judged.bad").alias("weak_bad"), F.col("judged.score").alias("quality_score"), (F.col("judged.score") >= least_score).alias("kept"))


def classify_quality(docs: DataFrame, train_rows: int = TRAIN_ROWS, least_score: float = LEAST_SCORE) -> DataFrame:
    return score(docs, fit(docs, train_rows), least_score)
