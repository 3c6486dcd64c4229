"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A document's features are the hashed character n-grams of its lower-case words, each present or not; n-grams
run over UTF-8 bytes, may take the blank before or after a word, and never span two words.
The log-count ratios come from document frequencies over all labelled training rows.  The linear weights on the
scaled features are then fitted on a bounded sample, FIT_ROWS of each class at most, chosen by a hash of the id
and weighted back to the classes' shares.

Defined results: null and empty texts get the score of the bias alone; rows with a null id are scored and are
never held out; unlabelled or null-labelled rows teach nothing; of repeated labels the largest counts; without
both classes among the training labels, the score is the share of label 1 (one half without labels).
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pallium.llm.common import bounded_sample, slices

BITS = 18
SIZE = 1 << BITS
LOW_N, HIGH_N = 3, 5
MIN_DOCS = 4
#: Bound of the fitting sample: labelled rows of each class.
FIT_ROWS = 1_500
#: Features with a smaller log-count ratio tell nothing and are left out.
LEAST_RATIO = 0.1
ROUNDS = 60
RATE = 0.1
DECAY = 2e-4
FOLDS = 5
#: Labels are broadcast up to this many rows (16 MB); beyond it the join with them shuffles.
BROADCAST_LABELS = 1_000_000
#: Bytes of text that are hashed at once.
_BYTES = 1 << 18
_TO_BLANK = bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")


class Grams:
    """Distinct feature numbers of texts. Number SIZE stands for no feature."""

    def __init__(self):
        self.last = np.zeros(SIZE + 1, np.int64)

    @staticmethod
    def hashed(raw: bytes) -> list[np.ndarray]:
        """For each n the feature number at every byte, SIZE where an n-gram would span two words or the end."""
        text = np.frombuffer(raw, np.uint8)
        blank = np.concatenate(([0], np.cumsum(text == 32)))
        h, out = text.astype(np.uint32), []
        for n in range(2, HIGH_N + 1):
            h = h[:-1] * np.uint32(0x01000193) + text[n - 1 :]
            if n >= LOW_N:
                found = ((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)).astype(np.int32)
                found[blank[n - 1 : -1] - blank[1 : len(h) + 1] > 0] = SIZE
                out.append(found)
        return out

    def of_texts(self, texts: list[str | None]):
        """The distinct feature numbers of each text."""
        raws = [b" " + (t or "").lower().encode("utf-8", "surrogatepass").translate(_TO_BLANK) + b"  " for t in texts]
        start = 0
        while start < len(raws):
            end, size = start, 0
            while end < len(raws) and (end == start or size + len(raws[end]) <= _BYTES):
                size, end = size + len(raws[end]), end + 1
            hashed, at = self.hashed(b"".join(raws[start:end])), 0
            for raw in raws[start:end]:
                # the two blanks at the end of a text end its last n-grams
                numbers = np.concatenate([h[at : at + len(raw) - 1] for h in hashed])
                self.last[numbers] = place = np.arange(len(numbers))
                numbers = numbers[self.last[numbers] == place]
                yield numbers[numbers < SIZE]
                at += len(raw)
            start = end


@dataclass
class Model:
    weights: np.ndarray  # of present features, the ratio already multiplied in
    bias: float

    def scores(self, texts: list[str | None], grams: Grams) -> np.ndarray:
        margin = np.array([self.weights[n].sum() for n in grams.of_texts(texts)], np.float64) + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))


def held_out(id_col: str):
    """True for the fifth of the ids that no training sees; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit_weights(rows: list[np.ndarray], labels: np.ndarray, importance: np.ndarray, ratio: np.ndarray, bias: float) -> Model:
    """Weighted logistic regression on ratio-scaled present features, by Adam over all rows."""
    rows = [r if len(r) else np.zeros(1, np.int32) for r in rows]
    lengths = np.array([len(r) for r in rows])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    flat = np.concatenate(rows)
    used = np.flatnonzero(np.bincount(flat, minlength=len(ratio)))
    place = np.zeros(len(ratio), np.int32)
    place[used] = np.arange(len(used))
    flat = place[flat]
    scale = ratio[used]
    w, b = np.zeros(len(used)), bias
    first, second = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for t in range(1, ROUNDS + 1):
        margin = np.add.reduceat((w * scale).astype(np.float32)[flat], starts) + b
        residual = (1 / (1 + np.exp(-np.clip(margin, -500, 500))) - labels) * importance
        slope = np.append(np.bincount(flat, np.repeat(residual, lengths), len(used)) * scale + DECAY * w, residual.sum())
        first = 0.9 * first + 0.1 * slope
        second = 0.99 * second + 0.01 * slope**2
        step = RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-6)
        w, b = w - step[:-1], b - step[-1]
    weights = np.zeros(len(ratio), np.float32)
    weights[used] = w * scale
    return Model(weights, float(b))


def document_frequencies(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents of label 0 and 1 with each feature, and documents of each label, over all of labelled(text, label)."""

    def run(batches):
        grams, counts = Grams(), np.zeros((2, SIZE + 1), np.int64)
        for batch in batches:
            for part in slices(batch):
                for numbers, label in zip(grams.of_texts(part.column(0).to_pylist()), part.column(1).to_pylist()):
                    counts[label, numbers] += 1
                    counts[label, SIZE] += 1
        seen = np.flatnonzero(counts.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(counts[0, seen]), pa.array(counts[1, seen])], ["f", "n0", "n1"])

    sums = labelled.mapInArrow(run, "f int, n0 long, n1 long").groupBy("f").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    out = np.zeros((2, SIZE + 1), np.int64)
    held = sums.toArrow()  # at most 2 ** BITS + 1 rows
    rows = held.column("f").to_numpy()
    out[0, rows], out[1, rows] = held.column("n0").to_numpy(), held.column("n1").to_numpy()
    return out[0, :SIZE], out[1, :SIZE], out[:, SIZE]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """A model from all labelled rows that are not held out."""
    marks = labels.filter(F.col(label_col).isin(0, 1) & ~held_out(id_col) & F.col(id_col).isNotNull())
    marks = marks.groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(label_col).cast("int")).alias("_label"))
    held = marks
    if marks.count() <= BROADCAST_LABELS:
        marks = F.broadcast(marks)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(marks, "_id")
    n0, n1, total = document_frequencies(rows.select("_text", "_label"))
    zero = np.zeros(SIZE, np.float32)
    if not total.all():
        share = 0.5 if not total.sum() else float(np.clip(total[1] / total.sum(), 1e-6, 1 - 1e-6))
        return Model(zero, float(np.log(share / (1 - share))))
    common = n0 + n1 >= MIN_DOCS
    ratio = np.where(common, np.log((n1 + 1) / (total[1] + 2)) - np.log((n0 + 1) / (total[0] + 2)), 0.0)
    # ids first, twice as many as are needed since some may have no text: only the chosen texts reach the driver
    marked = {r["_label"]: r["count"] for r in held.groupBy("_label").count().collect()}
    chosen = [bounded_sample(held.filter(F.col("_label") == c), "_id", 2 * FIT_ROWS, marked.get(c, 0)) for c in (0, 1)]
    found = rows.join(F.broadcast(chosen[0].union(chosen[1]).select("_id")), "_id", "left_semi").select(F.xxhash64("_id", "_text").alias("_o"), "_text", "_label").collect()
    picked = [sorted((r for r in found if r["_label"] == c), key=lambda r: r["_o"])[:FIT_ROWS] for c in (0, 1)]
    common &= np.abs(ratio) >= LEAST_RATIO
    sample = [n[common[n]] for c in (0, 1) for n in Grams().of_texts([r["_text"] for r in picked[c]])]
    y = np.repeat([0.0, 1.0], [len(p) for p in picked])
    importance = np.repeat([total[c] / total.sum() / max(1, len(picked[c])) for c in (0, 1)], [len(p) for p in picked])
    if not any(map(len, sample)):
        return Model(zero, float(np.log(total[1] / total[0])))
    return fit_weights(sample, y, importance, ratio, float(np.log(total[1] / total[0])))


def score_column(docs: DataFrame, model: Model):
    """A function of a text column that gives the probability of label 1."""
    spread = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return _score_series(spread.value, texts)

    return score


def _score_series(model: Model, texts):
    grams = Grams()
    parts = [model.scores(texts.iloc[at : at + 512].tolist(), grams) for at in range(0, len(texts), 512)]
    return pd.Series(np.concatenate(parts) if parts else np.zeros(0))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of docs."""
    rows = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    score = score_column(docs, train(docs, labels, id_col, text_col, label_col))
    out = rows.withColumn("score", score("_text"))
    return out.select(id_col, held_out(id_col).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs whose score is below one half."""
    return docs.filter(score_column(docs, model)(text_col) < 0.5)
