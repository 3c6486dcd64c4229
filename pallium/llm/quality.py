"""Quality: ordinal cumulative-link regression on graded ratings over hashed text features.

P(grade <= k) = sigmoid(threshold[k] - w . x) with one weight vector for all grades and increasing thresholds.
x holds hashed shares of the text's lower-case words and pairs of neighbours, of n-grams of its shape, and a few
hashed text-level buckets.  The weights are fitted on a bounded sample, FIT_ROWS labelled rows at most, chosen by a
hash of the id; the grades and their shares come from all labels.  A score depends on its own text alone, to the bit.

Defined results: a null text counts as empty; texts are read whole at any length; unrated rows teach nothing; of
repeated ratings of an id the smallest counts; repeated rows get equal scores; a single grade makes every row expect
that grade; without ratings the grade is null; an empty table gives an empty result; other columns are not read.
"""

import math
import zlib
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pallium.llm.common import bounded_sample

BITS = 16
SIZE = 1 << BITS
LOW_N, HIGH_N = 3, 5
#: Bound of the fitting sample: rated rows.
FIT_ROWS = 5_000
ROUNDS = 120
#: Features of rows, of all rows of a block together, for which a round of fitting makes temporary arrays.
BLOCK = 1 << 20
RATE = 0.05
DECAY = 1e-4
#: Most distinct grades; ratings beyond that are refused rather than binned.
MAX_GRADES = 32
#: Weights of the shares of shape n-grams and of words, and the value of a bucket.
SHAPES, WORDS, BUCKET = 12.0, 4.0, 0.5
#: Distinct words whose hashes a worker remembers; beyond them the memo starts anew.
MEMO = 100_000
#: Byte classes: small letters and all beyond ASCII, capitals, digits, blanks; other signs stand for themselves.
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[[*range(97, 123), *range(128, 256)]] = 97
_CLASS[65:91], _CLASS[48:58], _CLASS[[9, 10, 11, 12, 13]] = 65, 48, 32
_STEP, _MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def _crc(text: str) -> int:
    return zlib.crc32(text.encode("utf-8", "surrogatepass"))


def _number(text: str) -> int:
    return _crc(text) & (SIZE - 1)


def _fold(hashes: np.ndarray) -> np.ndarray:
    """Feature numbers of 32-bit hashes."""
    return ((hashes ^ (hashes >> np.uint32(15))) * _MIX >> np.uint32(32 - BITS)).astype(np.int32)


class Features:
    """Hashed features of texts: shares of shape n-grams, shares of words and pairs, and a few text-level buckets.

    The shape is the sequence of byte classes, a blank at either end, in which a class stands at most twice in a row.
    """

    def __init__(self):
        self.memo: dict[str, int] = {}

    @staticmethod
    def buckets(words: list[str], letters: int) -> np.ndarray:
        n = len(words)
        out = [_number(f"words={int(math.log2(n + 1))}")]
        if n:
            again = sum(map(eq, words, islice(words, 1, None)))
            out.append(_number(f"again={math.ceil(10 * again / n)}"))
            out.append(_number(f"distinct={int(10 * len(set(words)) / n)}"))
            out.append(_number(f"length={min(12, letters // n)}"))
        return np.array(out, np.int32)

    @staticmethod
    def shapes(text: str) -> np.ndarray:
        kinds = _CLASS[np.frombuffer(b" " + text.encode("utf-8", "surrogatepass") + b" ", np.uint8)]
        keep = np.ones(len(kinds), bool)
        keep[2:] = (kinds[2:] != kinds[1:-1]) | (kinds[2:] != kinds[:-2])
        kinds = kinds[keep]
        h, out = kinds.astype(np.uint32), [np.zeros(0, np.int32)]
        for n in range(2, min(HIGH_N, len(kinds)) + 1):
            h = h[:-1] * _STEP + kinds[n - 1 :]
            if n >= LOW_N:
                out.append(_fold(h))
        return np.concatenate(out)

    def words(self, words: list[str]) -> np.ndarray:
        """Numbers of the words and of the pairs of neighbours."""
        new = set(words).difference(self.memo)
        if len(self.memo) + len(new) > MEMO:
            self.memo, new = {}, set(words)
        self.memo.update((w, _crc(w)) for w in new)
        h = np.fromiter(map(self.memo.__getitem__, words), np.uint32, len(words))
        return _fold(np.concatenate((h, h[:-1] * _STEP + h[1:])))

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(shape numbers, word and pair numbers, bucket numbers) of a text."""
        text = text or ""
        words = text.lower().split()
        return self.shapes(text), self.words(words), self.buckets(words, len(text))

    def row(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(numbers, values) of a text."""
        numbers, values = [], []
        for found, weight in zip(self.of(text), (SHAPES, WORDS, None)):
            distinct, n = np.unique(found, return_counts=True)
            numbers.append(distinct)
            values.append(BUCKET * n if weight is None else weight * n / max(1, len(found)))
        return np.concatenate(numbers).astype(np.int32), np.concatenate(values).astype(np.float32)


@dataclass
class Model:
    grades: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, texts: list[str | None], features: Features) -> np.ndarray:
        """P(grade >= grades[k]) by text, for k from 1."""
        w, at = self.weights, np.zeros((len(texts), 1))
        for row, text in enumerate(texts):
            shapes, words, buckets = features.of(text)
            at[row] = SHAPES * w[shapes].sum() / max(1, len(shapes)) + WORDS * w[words].sum() / max(1, len(words)) + BUCKET * w[buckets].sum()
        return 1 / (1 + np.exp(np.clip(self.thresholds[None] - at, -500, 500)))

    def expected(self, tails: np.ndarray) -> np.ndarray:
        return self.grades[0] + tails @ np.diff(self.grades)


def fit(rows: Iterable[tuple[np.ndarray, np.ndarray]], rank: np.ndarray, grades: np.ndarray, shares: np.ndarray) -> Model:
    """Maximum likelihood by Adam; thresholds stay ordered as a first one plus exponentials.

    The driver holds eight bytes a feature of a row; what a round needs besides is made for BLOCK features at a time.
    """
    below = np.clip(np.cumsum(shares)[:-1], 1e-6, 1 - 1e-6)
    start = np.log(below / (1 - below))
    gaps = np.log(np.maximum(np.diff(start), 1e-3))
    numbers, values = map(list, zip(*rows))
    lengths, n = np.array([len(x) for x in numbers]), len(numbers)
    values, seen, place = np.concatenate(values), np.zeros(SIZE, bool), np.zeros(SIZE, np.int32)
    for x in numbers:
        seen[x] = True
    used = np.flatnonzero(seen)
    place[used] = np.arange(len(used))
    flat = np.concatenate([place[x] for x in numbers])
    del numbers
    ends = np.cumsum(lengths)
    bounds = [0, *np.searchsorted(ends, np.arange(BLOCK, ends[-1], BLOCK)).tolist(), n]
    blocks = [(a, b, slice(ends[a] - lengths[a], ends[b - 1])) for a, b in zip(bounds, bounds[1:]) if a < b]
    size, k = len(used), len(grades) - 1
    p = np.concatenate((np.zeros(size), [start[0]], gaps))
    first, second = np.zeros_like(p), np.zeros_like(p)
    row, at = np.arange(n), np.zeros(n)
    for t in range(1, ROUNDS + 1):
        steps = np.exp(p[size + 1 :])
        cut = np.concatenate(([-np.inf], p[size] + np.concatenate(([0.0], np.cumsum(steps))), [np.inf]))
        for a, b, part in blocks:
            at[a:b] = np.add.reduceat(values[part] * p[flat[part]], ends[a:b] - lengths[a:b] - part.start)
        with np.errstate(over="ignore"):
            up, low = 1 / (1 + np.exp(at - cut[rank + 1])), 1 / (1 + np.exp(at - cut[rank]))
        chance = np.maximum(up - low, 1e-12)
        d_up, d_low = up * (1 - up) / chance / n, low * (1 - low) / chance / n
        slope_at = d_up - d_low
        by_cut = np.zeros((n, k + 2))
        by_cut[row, rank + 1] -= d_up
        by_cut[row, rank] += d_low
        cuts = by_cut.sum(0)[1:-1]
        later = np.cumsum(cuts[::-1])[::-1]
        slope = DECAY * p
        for a, b, part in blocks:
            slope[:size] += np.bincount(flat[part], values[part] * np.repeat(slope_at[a:b], lengths[a:b]), size)
        slope[size:] = later
        slope[size + 1 :] *= steps
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        p -= RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    weights = np.zeros(SIZE)
    weights[used] = p[:size]
    return Model(grades, weights, p[size] + np.concatenate(([0.0], np.cumsum(np.exp(p[size + 1 :])))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "quality") -> Model:
    rated = labels.filter(F.col(grade_col).isNotNull() & F.col(id_col).isNotNull())
    rated = rated.groupBy(F.col(id_col).alias("_id")).agg(F.min(F.col(grade_col).cast("double")).alias("_grade"))
    held = rated.groupBy("_grade").count().orderBy("_grade").limit(MAX_GRADES + 1).collect()
    if len(held) > MAX_GRADES:
        raise ValueError(f"over {MAX_GRADES} grades")
    grades, n = np.array([r["_grade"] for r in held], float), np.array([r["count"] for r in held], float)
    if len(grades) < 2:
        return Model(grades if len(grades) else np.array([np.nan]), np.zeros(SIZE), np.zeros(0))
    sample = bounded_sample(rated, "_id", 2 * FIT_ROWS, int(n.sum()))  # ids without a document are passed over
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")
    found = sorted(rows.select("_grade", "_text", F.xxhash64("_id", "_text").alias("_o")).collect(), key=lambda r: r["_o"])[:FIT_ROWS]
    features = Features()
    if not found:
        return Model(grades, np.zeros(SIZE), np.log(np.cumsum(n)[:-1] / (n.sum() - np.cumsum(n)[:-1])))
    return fit((features.row(r["_text"]) for r in found), np.searchsorted(grades, [r["_grade"] for r in found]), grades, n / n.sum())


def score_column(docs: DataFrame, model: Model, cut: float | None = None):
    """A function of a text column that gives struct<expected, tail>: the expected grade, and the chance of `cut` (the highest by default) or more."""
    if not len(model.thresholds):
        only = None if math.isnan(model.grades[0]) else float(model.grades[0])
        tail = None if only is None else float(cut is None or only >= cut)
        return lambda text: F.struct(F.lit(only).cast("double").alias("expected"), F.lit(tail).cast("double").alias("tail"))
    at = len(model.grades) - 1 if cut is None else int(np.searchsorted(model.grades, cut))
    spread = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<expected:double,tail:double>")
    def score(texts: pd.Series) -> pd.DataFrame:
        return _score_series(spread.value, texts, at)

    return score


def _score_series(model: Model, texts, at: int):
    features = Features()
    parts = [model.tails(texts.iloc[i : i + 512].tolist(), features) for i in range(0, len(texts), 512)]
    tails = np.concatenate(parts) if parts else np.zeros((0, len(model.thresholds)))
    tail = np.ones(len(tails)) if at == 0 else tails[:, at - 1] if at <= tails.shape[1] else np.zeros(len(tails))
    return pd.DataFrame({"expected": model.expected(tails), "tail": tail})


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "quality") -> DataFrame:
    """(id_col, expected_grade, tail_probability, selected) for every row of docs."""
    score = score_column(docs, train(docs, labels, id_col, text_col, grade_col))
    out = docs.select(F.col(id_col), score(text_col).alias("_q")).select(id_col, F.col("_q.expected").alias("expected_grade"), F.col("_q.tail").alias("tail_probability"))
    return out.withColumn("selected", F.coalesce(F.col("tail_probability") >= 0.5, F.lit(False)))


def keep_good(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs whose chance of the highest grade is one half or more; all, when there are no ratings to judge by."""
    tail = score_column(docs, model)(text_col)["tail"]
    return docs.filter(F.coalesce(tail >= 0.5, F.lit(True)))
