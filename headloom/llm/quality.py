"""Quality classifier from weak labels.

Heuristic labellers look at whole texts and vote good, bad or nothing. How often each pattern of votes occurs
over all documents (a table bounded by three to the number of labellers) feeds expectation-maximisation,
which estimates how each labeller votes on good and on bad documents and how common good ones are; that
gives each pattern a posterior. Posteriors are the soft labels of a linear scorer over hashed features of
words and of word shapes, fitted to a bounded sample (``SAMPLE_DOCS`` distinct texts, in the order of a seeded hash
of the text, so ids and copies have no say). Every document is then scored, and those under ``THRESHOLD`` are rejected.

Few words are little evidence: under ``ENOUGH_WORDS`` words, shares are drawn to the middle between good and bad,
and the scorer's log odds to those of the text's votes, in proportion to the words that are missing. Words of over ``LONG_WORD`` bytes are
cut into units of ``UNIT`` bytes, so that texts without blanks are judged too.

Edge cases: a null text counts as empty; an empty or blank text has no words and is kept with a score of 1. Null ids and repeated rows are scored like others. An empty table
gives no rows. Only the text is read; all other columns, whatever their names, pass through.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headloom.llm.common import _SPACE, give_back, mix, read_table

SAMPLE_DOCS = 4000
THRESHOLD = 0.2  # four to one against: losing a good document costs more than keeping a poor one
FEATURES = 1024
LABELLERS = ("symbols", "shouting", "top_word", "separators", "short_words", "exclaiming", "repeats", "runs")
ENOUGH_WORDS = 20
LONG_WORD, UNIT = 64, 12
SEED = 20240229

_LOWER, _UPPER, _DIGIT, _HIGH, _STOP, _BANG, _SYMBOL = (1 << i for i in range(7))
_CLASS = np.zeros(256, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = _LOWER, _UPPER, _DIGIT, _HIGH
for _c in b".,;:?'\"()-":
    _CLASS[_c] = _STOP
for _c in b"!":
    _CLASS[_c] = _BANG
for _c in b"#$%&*+/<=>@[\\]^_`{|}~":
    _CLASS[_c] = _SYMBOL
_WORDY = _LOWER | _UPPER | _DIGIT | _HIGH


# Hashes of words for features and vote shares, where a collision is harmless: linear, and so one pass -----

_U = np.uint64
_TABLE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64) | _U(1)
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown by doubling and kept for the task's process."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (max(n, 2) - 1).bit_length())
        have = np.ones(size, np.uint64)
        done = 1
        while done < size:
            step = _U(pow(base, done, 2**64))
            have[done : 2 * done] = have[:done] * step
            done *= 2
        if size <= 1 << 22:
            _POWERS[base] = have
    return have[:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """S with S[i] = sum of t(data[j]) * base**j over j < i, modulo 2**64."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_TABLE[data] * powers(_BASE, len(data)), out=out[1:])
    return out


def range_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of bytes start..end of the data behind ``sums``, the same wherever those bytes stand."""
    raw = (sums[end] - sums[start]) * powers(_BASE_INV, len(sums))[start]
    return mix(raw ^ ((end - start).astype(np.uint64) * _U(0xD1B54A32D192ED03)))


class Words:
    """Hashes, lengths and character classes of the words of one text."""

    def __init__(self, data: np.ndarray):
        edge = np.diff(np.concatenate(([0], (~_SPACE[data]).view(np.int8), [0])))
        start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.cut = 0.0
        if len(start) and (end - start).max() > LONG_WORD:
            many = np.where(end - start > LONG_WORD, -(-(end - start) // UNIT), 1)
            nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            last, self.cut = np.repeat(end, many), float(many[many > 1].sum() / many.sum())
            start = np.repeat(start, many) + nth * UNIT
            end = np.where(np.repeat(many, many) > 1, np.minimum(start + UNIT, last), last)
        self.n = len(start)
        self.size = end - start
        kinds = _CLASS[data]
        self.kinds = np.bitwise_or.reduceat(kinds, start) if self.n else np.zeros(0, np.uint8)
        self.hash = range_hash(prefix_sums(data), start, end)
        if self.n:  # reduceat takes the blanks after a word along; they have no class
            self.upper = np.add.reduceat((kinds == _UPPER).view(np.int8), start, dtype=np.int64)
            self.lower = np.add.reduceat(((kinds & (_LOWER | _HIGH)) > 0).view(np.int8), start, dtype=np.int64)


def votes(w: Words) -> np.ndarray:
    """1 good, -1 bad, 0 nothing, for each of LABELLERS."""
    out = np.zeros(len(LABELLERS), np.int8)
    if not w.n:
        return out
    sure = min(1.0, w.n / ENOUGH_WORDS)

    def say(k: int, x: float, good: float, bad: float) -> None:
        x = sure * x + (1 - sure) * (good + bad) / 2
        out[k] = (1 if x <= good else -1 if x >= bad else 0) if good < bad else (1 if x >= good else -1 if x <= bad else 0)

    order = np.sort(w.hash)
    runs = np.diff(np.concatenate((np.flatnonzero(np.concatenate(([True], order[1:] != order[:-1]))), [w.n])))
    say(0, np.mean((w.kinds & _SYMBOL) > 0), 0.05, 0.2)
    letters = max(1, int(w.upper.sum() + w.lower.sum()))
    say(1, w.upper.sum() / letters, 0.15, 0.45)
    say(2, runs.max() / w.n, 0.15, 0.3)
    say(3, np.mean((w.kinds & _WORDY) == 0), 0.05, 0.25)
    if w.cut < 0.5:  # units have one length
        say(4, np.mean((w.size <= 3) & ((w.kinds & _WORDY) > 0)), 0.12, 0.04)
    say(5, np.mean((w.kinds & _BANG) > 0), 0.05, 0.3)
    if w.n == 1:
        return out
    pairs = np.unique(mix(w.hash[1:] * np.uint64(3) + w.hash[:-1]))
    say(6, len(pairs) / (w.n - 1), 0.5, 0.25)
    say(7, np.mean(w.hash[1:] == w.hash[:-1]), 0.1, 0.3)
    return out


def features(w: Words, size: int = FEATURES) -> np.ndarray:
    """Shares of hashed words, hashed shapes and repeats of the word before; a unit vector, with a constant."""
    out = np.zeros(size, np.float32)
    if w.n:
        half = size // 2
        shape = (w.kinds.astype(np.uint64) << np.uint64(4)) | np.minimum(w.size, 15).astype(np.uint64)
        out[:half] = np.bincount((w.hash % np.uint64(half)).astype(np.int64), minlength=half) / w.n * 0.5
        out[half:] = np.bincount((mix(shape) % np.uint64(size - half - 2)).astype(np.int64), minlength=size - half) / w.n
        out /= max(1e-9, np.linalg.norm(out))
        out[-2] = 2 * np.mean(w.hash[1:] == w.hash[:-1]) if w.n > 1 else 0
    out[-1] = 1
    return out


def _texts(column: pa.Array):
    for x in pc.cast(pc.fill_null(column, ""), pa.binary()):
        yield Words(np.frombuffer(x.as_buffer(), np.uint8))


def vote_pattern(text):
    """Column of the votes as one number in base three."""

    @F.arrow_udf("int")
    def pattern(column: pa.Array) -> pa.Array:
        base = 3 ** np.arange(len(LABELLERS))
        out = [int(((votes(w) + 1) * base).sum()) for w in _texts(column)]
        give_back()
        return pa.array(out, pa.int32())

    return pattern(text)


def estimate(counts: dict[int, int], rounds: int = 200) -> tuple[np.ndarray, float, dict[int, float]]:
    """From counts of vote patterns: P(vote | class) by labeller, class (bad, good) and vote; P(good); posterior
    of good by pattern. A document has one fault at a time as a rule, so any bad vote counts as bad at the start."""
    keys = sorted(counts)
    n = np.array([counts[k] for k in keys], float)
    v = (np.array(keys)[:, None] // 3 ** np.arange(len(LABELLERS))) % 3
    post = np.where((v == 0).any(1), 0.1, 0.9)
    table, prior = np.zeros((len(LABELLERS), 2, 3)), 0.5
    for _ in range(rounds):
        weight = np.stack([(1 - post) * n, post * n])
        for k, c in itertools.product(range(len(LABELLERS)), range(2)):
            seen = np.bincount(v[:, k], weights=weight[c], minlength=3) + 0.1
            table[k, c] = seen / seen.sum()
        prior = float(np.clip(weight[1].sum() / n.sum(), 0.01, 0.99))
        log = [np.log(p) + sum(np.log(table[k, c, v[:, k]]) for k in range(len(LABELLERS))) for c, p in ((0, 1 - prior), (1, prior))]
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -50, 50)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return table, prior, dict(zip(keys, post.tolist(), strict=True))


def fit_linear(x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 8.0, ridge: float = 1e-5) -> np.ndarray:
    """Logistic regression on soft labels, both classes of equal weight."""
    w, seen = np.zeros(x.shape[1], np.float64), np.zeros(x.shape[1], np.float64)
    share = np.clip(y.mean(), 0.02, 0.98)
    weight = np.where(y > 0.5, 0.5 / share, 0.5 / (1 - share))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.einsum("ij,j->i", x, w), -30, 30)))  # not a threaded product: see packing
        seen = 0.9 * seen + np.einsum("ij,i->j", x, weight * (p - y)) / len(y) + ridge * w
        w -= rate * seen * 0.1
    return w


def train(df: DataFrame, text_col: str = "text", sample: int = SAMPLE_DOCS) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of the scorer; log odds of good by labeller and vote, and before any vote. Vote counts cover all documents; the fit uses a bounded sample."""
    place = F.xxhash64(F.lit(SEED), F.coalesce(F.col(text_col), F.lit("")))
    pattern = df.select(vote_pattern(F.col(text_col)).alias("p"), place.alias("place")).groupBy("p").agg(F.count(F.lit(1)).alias("count"), F.approx_count_distinct("place").alias("texts"))
    found = pattern.collect()  # bounded by the patterns
    counts, total = {r["p"]: r["count"] for r in found}, sum(r["texts"] for r in found)
    silent = int((3 ** np.arange(len(LABELLERS))).sum())
    counts.pop(silent, None)  # no votes say nothing about the labellers
    if not counts:
        return np.zeros(FEATURES), np.zeros((len(LABELLERS), 3)), 0.0
    table, prior, posterior = estimate(counts)
    odds = np.log(table[:, 1] / table[:, 0])
    odds[:, 1] = 0  # a short text's silence says nothing
    even = float(np.log(prior / (1 - prior)))
    near = df.filter(place < int(min(1.0, 1.5 * sample / total) * 2.0**64 - 2.0**63 - (2048 if 1.5 * sample >= total else 0)))
    near = near.select(place.alias("place"), F.col(text_col).alias("text")).dropDuplicates(["place"])
    rows = near.orderBy("place").limit(sample).select("text", vote_pattern(F.col("text")).alias("p"))

    @F.arrow_udf("binary")
    def described(column: pa.Array) -> pa.Array:
        return pa.array([features(w).tobytes() for w in _texts(column)], pa.binary())

    taken = rows.filter(F.col("p") != silent).select("p", described("text").alias("x")).collect()
    if not taken:
        return np.zeros(FEATURES), odds, even
    x = np.stack([np.frombuffer(r["x"], np.float32) for r in taken]).astype(np.float64)
    return fit_linear(x, np.array([posterior[r["p"]] for r in taken])), odds, even


def log_odds(w: Words, weights: np.ndarray, odds: np.ndarray, even: float) -> float:
    """Of a good document."""
    z = float(np.clip(features(w) @ weights, -30, 30))
    if w.n < ENOUGH_WORDS or not weights.any():  # a scorer that could not be fitted leaves it to the votes
        sure = w.n / ENOUGH_WORDS if weights.any() else 0.0
        z = sure * z + (1 - sure) * float(np.clip(even + odds[np.arange(len(LABELLERS)), votes(w) + 1].sum(), -30, 30))
    return z


def with_quality(df: DataFrame, name: str, text_col: str = "text") -> DataFrame:
    """``df`` with the column ``name``: the scorer's probability of a good document; 1 where a text has no words."""
    model = train(df, text_col)

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        out = [1 / (1 + np.exp(-log_odds(w, *model))) if w.n else 1.0 for w in _texts(column)]
        give_back()
        return pa.array(out, pa.float64())

    return df.withColumn(name, score(F.col(text_col)))


def drop_low_quality(df: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns."""
    name = "_quality"
    while name in df.columns:
        name += "_"
    return with_quality(df, name, text_col).filter(F.col(name) >= threshold).drop(name)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, score, kept."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return with_quality(docs, "score").select("doc_id", F.round("score", 6).alias("score"), (F.col("score") >= THRESHOLD).alias("kept"))
