"""LM scoring: the masked pseudo-likelihood of documents under a bidirectional window network.

Every token is predicted from the WINDOW tokens on both sides; a document's score is the sum of its tokens'
conditional log-probabilities.  Tokens are the strings between white space, as they are written.  The network gives
the probability of a token's class: each of the HEAD most frequent strings is a class, the rest falls into classes of
equal ending and capital.  What a class leaves open is filled in with figures of the whole corpus: the token's own
probability in its class, from its count and its spelling.  So no two strings share a score because of a class.

The figures come from one table of all distinct strings with their counts, written to the shared folder: the classes,
the counts by hashed string (2 ** BITS of them) and the spelling model (next byte after up to three bytes, contexts
hashed, ORDERS).  A string of probability p by spelling takes p / (p + 2 ** -BITS) of its count's probability: the
share it has among all strings that would meet there.  Counts that hold nothing share the mass of those that hold one.

Training: one task first trains the network on WARM_ROWS documents, chosen by a hash; from there each task makes one
pass over all its documents in numpy, and the weights are averaged by tokens.  Task results are deterministic, so
that a lost task gives the same weights when it runs again.

Defined results: null and wordless texts have 0 tokens, sum 0 and a null mean; texts are read whole at any length;
rows repeat as given; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pallium.llm.common import Numbers, saved, slices

WINDOW = 3
SIDE = 24
VOCAB = SIDE * SIDE
ENDINGS = 96
HEAD = VOCAB - ENDINGS
HIDDEN = 16
RATE = 0.1
#: Documents of the first training, about, and the tokens of a step there and in the pass over all documents.
WARM_ROWS = 4_000
WARM_BATCH, BATCH = 1_024, 8_192
SEED = 3
#: Counts of hashed strings, in parts of 2 ** PART_BITS.
BITS, PART_BITS = 24, 15
#: Contexts of one, two and three bytes, the latter hashed; the share of each in a byte's probability, and the bytes that smooth it.
ORDERS, SHARES, SMOOTH = (257, 4_096, 8_192), (0.1, 0.2, 0.7), 4.0
_END = 256
#: Tasks whose weights are averaged together at first.
GATHERED = 128
ROW = ["part", "task", "n", "w"]
_MEMO = 400_000


def words(text: str | None) -> list[str]:
    return (text or "").split()


def ending(word: str) -> str:
    """What a class of rarer strings has in common: the last two letters, and whether the first is a capital."""
    return ("A" if word[0].isupper() else "a") + word[-2:].lower()


def bucket(word: str) -> int:
    """The place of a string's count: the low bits of the hash that Spark's xxhash64 gives too."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42) & ((1 << BITS) - 1)


# Spelling ---------------------------------------------------------------------------------------------------------


def _cells(tokens: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """By order the cell (context, byte) of every byte of the tokens and of their ends, and where each token starts."""
    raws = [w.encode("utf-8", "surrogatepass") for w in tokens]
    flat = np.frombuffer(b"\0\0\0" + b"\0\0\0\0".join(raws) + b"\0", np.uint8).astype(np.int64)
    lengths = np.array([len(r) for r in raws]) + 1
    starts = np.cumsum(lengths) - lengths
    # three blanks stand before each token, and its end takes the place of the next one's first
    place = np.arange(int(lengths.sum())) + np.repeat(3 * (np.arange(len(raws)) + 1), lengths)
    last = np.cumsum(lengths) - 1
    byte = flat[place]
    byte[last] = _END
    context, out = np.zeros(len(place), np.int64), []
    for back, size in enumerate(ORDERS, 1):
        context = context * 257 + flat[place - back] + 1
        out.append((context if back == 1 else context * 0x9E3779B1 >> 7) % size * 257 + byte)
    return out, starts


class Spelling:
    """P(string) as the product of its bytes' probabilities, a mean over the orders, and of its end."""

    def __init__(self, tables: list[np.ndarray]):
        """tables: counts by cell for each order."""
        self.chances = []
        for table, size in zip(tables, ORDERS):
            n = table.reshape(size, 257).astype(np.float64)
            mean = n.sum(0, keepdims=True) + 1e-3
            chance = (n + SMOOTH * mean / mean.sum()) / (n.sum(1, keepdims=True) + SMOOTH)
            self.chances.append(chance.astype(np.float32).ravel())

    def log(self, tokens: list[str]) -> np.ndarray:
        if not tokens:
            return np.zeros(0)
        cells, starts = _cells(tokens)
        chance = sum(share * held[cell].astype(np.float64) for share, held, cell in zip(SHARES, self.chances, cells))
        return np.add.reduceat(np.log(chance), starts)


# Figures of the corpus -------------------------------------------------------------------------------------------


def distinct_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(w, n): every distinct string of all documents. Tasks count in bounded tables and hand on what they have; Spark makes the sums."""

    def rows(counts):
        return pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["w", "n"])

    def count(batches):
        counts: dict[str, int] = {}
        for batch in batches:
            for part in slices(batch):
                for text in part.column(0).to_pylist():
                    for w in words(text):
                        counts[w] = counts.get(w, 0) + 1
                if len(counts) > _MEMO:
                    yield rows(counts)
                    counts = {}
        yield rows(counts)

    return docs.select(text_col).mapInArrow(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))


def _quantised(n: np.ndarray) -> np.ndarray:
    """Counts as bytes: 0 for none, else one and eight times the binary logarithm."""
    return np.where(n > 0, np.minimum(255, 1 + np.rint(8 * np.log2(np.maximum(n, 1)))), 0).astype(np.uint8)


_SIZES = np.concatenate(([0.0], 2 ** (np.arange(255) / 8)))


@dataclass
class Figures:
    """What is known of all strings: classes, counts by hash, spelling."""

    head: dict[str, int]
    endings: dict[str, int]
    class_counts: np.ndarray  # (VOCAB,)
    counts: np.ndarray  # (2 ** BITS,) bytes
    tables: list[np.ndarray]  # spelling counts by cell

    def ready(self) -> "Figures":
        """Probabilities by byte of the counts, and the spelling model; made by each worker for itself."""
        held = np.bincount(self.counts, minlength=256)
        total = float((held * _SIZES).sum()) or 1.0
        unseen = min(0.5, max(float(held[1]), 1.0) / total)
        chance = (1 - unseen) * _SIZES / total
        chance[0] = unseen / max(1, held[0])
        self.chance, self.spelling = np.log(chance), Spelling(self.tables)
        tail = np.maximum(self.class_counts.astype(np.float64), 0.5)
        self.of_class = np.log(tail / max(1.0, tail[list(set(self.endings.values()) | {VOCAB - 1})].sum()))
        return self

    def class_of(self, word: str) -> int:
        found = self.head.get(word)
        return self.endings.get(ending(word), VOCAB - 1) if found is None else found

    def within(self, tokens: list[str], classes: np.ndarray | None = None) -> np.ndarray:
        """log P(string | class) of strings; 0 for those that are a class of their own."""
        out = np.zeros(len(tokens))
        if classes is None:
            classes = np.array([self.class_of(w) for w in tokens], np.int64)
        rare = [k for k, w in enumerate(tokens) if w not in self.head]
        for at in range(0, len(rare), 1 << 15):
            rows = rare[at : at + (1 << 15)]
            mine = [tokens[k] for k in rows]
            spelt = self.spelling.log(mine)
            share = -np.logaddexp(0, -BITS * np.log(2) - spelt)
            out[rows] = np.minimum(0, self.chance[self.counts[[bucket(w) for w in mine]]] + share - self.of_class[classes[rows]])
        return out


def figures(table: DataFrame) -> Figures:
    """The figures of a table of distinct strings (w, n). Only the classes and bounded tables of numbers reach the driver."""
    spark = table.sparkSession
    top = table.orderBy(F.col("n").desc(), "w").limit(HEAD).collect()
    # frequent strings spread over the groups of the softmax
    number = {r["w"]: k % SIDE * SIDE + k // SIDE for k, r in enumerate(top)}
    free = [k for k in range(VOCAB) if k % SIDE >= HEAD // SIDE]
    kinds = spark.createDataFrame([(w,) for w in number], "w string")
    rare = table.join(F.broadcast(kinds), "w", "left_anti")

    def count_endings(batches):
        for batch in batches:
            sums: dict[str, int] = {}
            for w, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[ending(w)] = sums.get(ending(w), 0) + n
            yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.string()), pa.array(sums.values(), pa.int64())], ["cell", "n"])

    common = saved(rare.select("w", "n").mapInArrow(count_endings, "cell string, n long").groupBy("cell").agg(F.sum("n").alias("n")), "endings")
    most = [(r["cell"], r["n"]) for r in common.orderBy(F.col("n").desc(), "cell").limit(ENDINGS - 1).collect()]
    endings = {kind: free[k] for k, (kind, _) in enumerate(most)}
    class_counts = np.zeros(VOCAB, np.int64)
    for r in top:
        class_counts[number[r["w"]]] = r["n"]
    for kind, n in most:
        class_counts[endings[kind]] = n
    class_counts[VOCAB - 1] = (common.agg(F.sum("n")).first()[0] or 0) - sum(n for _, n in most)

    bases = np.cumsum([0, *(257 * size for size in ORDERS)]).tolist()

    def count_cells(batches):
        sums = np.zeros(bases[-1], np.int64)
        for batch in batches:
            cells, starts = _cells(batch.column(0).to_pylist()) if batch.num_rows else ([], [])
            weight = np.repeat(batch.column(1).to_numpy(), np.diff(np.append(starts, len(cells[0]) if batch.num_rows else 0)))
            for cell, base in zip(cells, bases):
                np.add.at(sums, cell + base, weight)
        held = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(sums[held])], ["cell", "n"])

    spelt = np.zeros(bases[-1] + (1 << PART_BITS), np.float32)
    for cell, n in _gathered(rare.select("w", "n").mapInArrow(count_cells, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")), np.float32):
        spelt[cell : cell + len(n)] = n
    counts = np.zeros(1 << BITS, np.uint8)
    places = rare.groupBy(F.xxhash64("w").bitwiseAND(F.lit((1 << BITS) - 1)).alias("cell")).agg(F.sum("n").alias("n"))
    for cell, n in _gathered(places, np.uint8):
        counts[cell : cell + len(n)] = n
    return Figures(number, endings, class_counts, counts, [spelt[a:b] for a, b in zip(bases, bases[1:])])


def _gathered(sums: DataFrame, kind):
    """(first cell, counts of its part) of a table (cell, n): tasks make parts of 2 ** PART_BITS cells dense; bytes hold quantised counts."""
    width = 1 << PART_BITS

    def dense(part: pa.Table) -> pa.Table:
        cells = part.column("cell").to_numpy()
        first = int(cells[0]) // width * width
        n = np.zeros(width, np.float64)
        n[cells - first] = part.column("n").to_numpy()
        held = _quantised(n) if kind == np.uint8 else n.astype(kind)
        return pa.table({"first": [first], "n": pa.array([held.tobytes()], pa.binary())})

    made = sums.groupBy(F.floor(F.col("cell") / width)).applyInArrow(dense, "first long, n binary")
    for r in made.collect():
        yield r["first"], np.frombuffer(r["n"], kind)


class Tokens:
    """Class numbers of words, and log P(word | class) where `within`; distinct words are remembered up to a bound."""

    def __init__(self, held: Figures, within: bool = False):
        self.held, self.within = held.ready() if within else held, within
        self.number = Numbers()
        self.classes, self.logs = np.zeros(1 << 12, np.int32), np.zeros(1 << 12)

    def of(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray | None]:
        if len(self.number) > _MEMO:
            self.number = Numbers()
        start, self.number.new = len(self.number), []
        rows = np.fromiter(map(self.number.__getitem__, tokens), np.int64, len(tokens))
        new, end = self.number.new, len(self.number)
        if end > len(self.classes):
            self.classes, self.logs = np.resize(self.classes, 2 * end), np.resize(self.logs, 2 * end)
        self.classes[start:end] = [self.held.class_of(w) for w in new]
        if self.within:
            self.logs[start:end] = self.held.within(new, self.classes[start:end])
        return self.classes[rows], self.logs[rows] if self.within else None

    def of_texts(self, texts: list[str | None]) -> tuple[list[np.ndarray], np.ndarray | None]:
        """The classes of each text, and the logs of all one after another."""
        lists = [words(t) for t in texts]
        classes, logs = self.of([w for tokens in lists for w in tokens])
        return np.split(classes, np.cumsum([len(tokens) for tokens in lists])[:-1]), logs


# The network ------------------------------------------------------------------------------------------------------

PLACES = [p for p in range(-WINDOW, WINDOW + 1) if p]


@dataclass
class Network:
    """Vectors of the classes, scaled by place, sum to the hidden layer; softmaxes over groups and over a group's classes."""

    vectors: np.ndarray  # (VOCAB + 1, HIDDEN); number VOCAB stands for the border
    scales: np.ndarray  # (2 * WINDOW, HIDDEN)
    start: np.ndarray  # (HIDDEN,)
    coarse: np.ndarray  # (HIDDEN + 1, SIDE)
    fine: np.ndarray  # (SIDE, HIDDEN + 1, SIDE)

    @classmethod
    def fresh(cls) -> "Network":
        rng = np.random.default_rng(SEED)
        draw = lambda mean, size, *shape: rng.normal(mean, size, shape).astype(np.float32)
        none = lambda *shape: np.zeros(shape, np.float32)
        return cls(draw(0, 0.3, VOCAB + 1, HIDDEN), draw(0.5, 0.2, 2 * WINDOW, HIDDEN), none(HIDDEN), none(HIDDEN + 1, SIDE), none(SIDE, HIDDEN + 1, SIDE))

    def parts(self) -> list[np.ndarray]:
        return [self.vectors, self.scales, self.start, self.coarse, self.fine]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    @classmethod
    def of(cls, flat: np.ndarray) -> "Network":
        shapes = [p.shape for p in cls.fresh().parts()]
        cuts = np.cumsum([int(np.prod(s)) for s in shapes])
        return cls(*(p.reshape(s).astype(np.float32) for p, s in zip(np.split(flat, cuts[:-1]), shapes)))

    def hidden(self, line: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Vectors, as columns, of a line that WINDOW classes begin and end, which places between hold a token, and their hidden layer and a one."""
        x = np.ascontiguousarray(self.vectors.T).take(line, axis=1)
        n = len(line) - 2 * WINDOW
        real = np.flatnonzero(line[WINDOW : WINDOW + n] != VOCAB)
        total = np.repeat(self.start[:, None], n, axis=1)
        for scale, p in zip(self.scales, PLACES):
            total += scale[:, None] * x[:, WINDOW + p : WINDOW + p + n]
        out = np.ones((len(real), HIDDEN + 1), np.float32)
        out[:, :-1] = np.tanh(total[:, real]).T
        return x, real, out

    def _softmaxes(self, hidden, tokens, chances: bool = True):
        """(group or None, rows, probabilities or None, targets, log-probability of the targets) of the coarse and each fine softmax."""
        group, inner = np.divmod(tokens.astype(np.uint16), np.uint16(SIDE))  # small numbers are ordered by counting
        yield None, *self._softmax(hidden, self.coarse, np.arange(len(tokens)), group, chances)
        order = np.argsort(group, kind="stable")
        edges = np.concatenate(([0], np.cumsum(np.bincount(group, minlength=SIDE))))
        for c in range(SIDE):
            rows = order[edges[c] : edges[c + 1]]
            if len(rows):
                yield c, *self._softmax(hidden[rows], self.fine[c], rows, inner[rows], chances)

    @staticmethod
    def _softmax(hidden, weights, rows, target, chances):
        logits = hidden @ weights
        np.minimum(logits, 60, out=logits)  # exp stays finite
        chance = np.exp(logits)
        total = chance.sum(1, keepdims=True)
        log = logits[np.arange(len(rows)), target] - np.log(total[:, 0])
        if chances:
            chance /= total
        return rows, chance if chances else None, target, log

    def log_probabilities(self, line: np.ndarray) -> np.ndarray:
        """Log-probability of each token of a line, see `hidden`."""
        _, real, hidden = self.hidden(line)
        out = np.zeros(len(real), np.float32)
        for _, rows, _, _, log in self._softmaxes(hidden, line[WINDOW : len(line) - WINDOW][real], False):
            out[rows] += log
        return out

    def learn(self, line: np.ndarray, sums: "Network", rate: float = RATE) -> None:
        """One step over a line's tokens; steps shrink with the squares of all slopes so far, which `sums` holds."""
        x, real, hidden = self.hidden(line)
        if not len(real):
            return
        n, places = len(line) - 2 * WINDOW, np.float32(1 / len(real))
        back, slopes = np.zeros_like(hidden), [None, None, None, np.zeros_like(self.coarse), np.zeros_like(self.fine)]
        for c, rows, slope, target, _ in self._softmaxes(hidden, line[WINDOW : WINDOW + n][real]):
            slope[np.arange(len(rows)), target] -= 1
            if c is None:
                back += slope @ self.coarse.T
                slopes[3] = hidden.T @ slope
            else:
                back[rows] += slope @ self.fine[c].T
                slopes[4][c] = hidden[rows].T @ slope
        down = np.zeros((HIDDEN, n), np.float32)
        down[:, real] = (back * (1 - hidden**2))[:, :-1].T
        slopes[2] = down.sum(1)
        slopes[1], spread = np.zeros_like(self.scales), np.zeros_like(x)
        for k, p in enumerate(PLACES):
            slopes[1][k] = np.einsum("ij,ij->i", down, x[:, WINDOW + p : WINDOW + p + n])
            spread[:, WINDOW + p : WINDOW + p + n] += self.scales[k][:, None] * down
        slopes[0] = np.stack([np.bincount(line, row, VOCAB + 1) for row in spread], axis=1).astype(np.float32)
        for weights, held, slope in zip(self.parts(), sums.parts(), slopes):
            slope *= places
            held += slope * slope
            weights -= rate * slope / np.sqrt(held + 1e-10)


def line_of(documents: list[np.ndarray]) -> np.ndarray:
    """The classes of documents one after another, WINDOW borders before, between and after them."""
    border = np.full(WINDOW, VOCAB, np.int64)
    return np.concatenate([x for d in documents for x in (border, d)] + [border])


def pieces(line: np.ndarray, size: int):
    """Parts of a line of `size` places each, with what stands beside them."""
    for at in range(0, len(line) - 2 * WINDOW, size):
        yield line[at : at + size + 2 * WINDOW]


def _empty_sums() -> Network:
    return Network.of(np.zeros_like(Network.fresh().flat()))


def train_on(net: Network, sums: Network, tokens: Tokens, batches, size: int) -> int:
    """net after one pass over Arrow batches of texts; the number of tokens."""
    seen = 0
    for batch in batches:
        for part in slices(batch, 128):
            documents, _ = tokens.of_texts(part.column(0).to_pylist())
            seen += sum(map(len, documents))
            for piece in pieces(line_of(documents), size):
                net.learn(piece, sums)
    return seen


def trained(docs: DataFrame, held: Figures, id_col: str = "doc_id", text_col: str = "text", warm_rows: int = WARM_ROWS) -> Network:
    """A network after a pass over all documents, averaged over the tasks by their tokens."""
    context = docs.sparkSession.sparkContext
    classes = Figures(held.head, held.endings, held.class_counts, np.zeros(0, np.uint8), [])
    fresh = np.concatenate((Network.fresh().flat(), _empty_sums().flat()))
    spread = context.broadcast((classes, fresh))

    def warm(batches):
        classes, state = spread.value
        net, sums = (Network.of(x.copy()) for x in np.split(state, 2))
        train_on(net, sums, Tokens(classes), batches, WARM_BATCH)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate((net.flat(), sums.flat())).tobytes()], pa.binary())], ["w"])

    share = min(1.0, warm_rows / max(1, docs.count()))
    mark = F.xxhash64(F.lit("warm"), id_col, text_col)
    some = docs.filter(F.pmod(mark, F.lit(1 << 40)) < int(share * (1 << 40))).select(text_col, mark.alias("_mark"))
    first = some.repartition(1).sortWithinPartitions("_mark").select(text_col).mapInArrow(warm, "w binary").collect()
    state = np.frombuffer(first[0]["w"], np.float32) if first else fresh
    spread_warm = context.broadcast((classes, state))
    parts = 64

    def run(batches):
        classes, state = spread_warm.value
        net, sums = (Network.of(x.copy()) for x in np.split(state, 2))
        seen = train_on(net, sums, Tokens(classes), batches, BATCH)
        cut = np.array_split(net.flat(), parts)
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(parts), pa.int32()), pa.array([task] * parts, pa.int64()), pa.array([seen] * parts, pa.int64()), pa.array([p.tobytes() for p in cut], pa.binary())], ROW
        )

    def average(table: pa.Table) -> pa.Table:
        """The mean of one part over some tasks, in the order of their numbers so that it always comes out the same."""
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("task", "n", "w"))))
        n = sum(k for _, k, _ in rows)
        mean = sum(np.frombuffer(w, np.float32).astype(np.float64) * (k / n if n else 1 / len(rows)) for _, k, w in rows)
        return pa.table({"part": table.column("part").slice(0, 1), "task": [rows[0][0]], "n": [n], "w": pa.array([mean.astype(np.float32).tobytes()], pa.binary())})

    schema = "part int, task long, n long, w binary"
    sent = docs.select(text_col).mapInArrow(run, schema)
    # by groups of tasks first: no group of a large cluster's thousands of tasks is gathered at once
    gathered = sent.groupBy("part", F.floor(F.col("task") / GATHERED)).applyInArrow(average, schema)
    means = {r["part"]: r["w"] for r in gathered.groupBy("part").applyInArrow(average, schema).collect()}
    return Network.of(np.concatenate([np.frombuffer(means[k], np.float32) for k in sorted(means)]) if means else np.split(state, 2)[0])


def score(texts: list[str | None], net: Network, tokens: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each text and the sum of their conditional log-probabilities."""
    documents, within = tokens.of_texts(texts)
    n = np.array([len(d) for d in documents])
    logs = [net.log_probabilities(piece) for piece in pieces(line_of(documents), BATCH)] or [np.zeros(0)]
    both = np.concatenate(logs).astype(np.float64) + within
    sums = np.concatenate(([0.0], np.cumsum(both)))
    ends = np.concatenate(([0], np.cumsum(n)))
    return n, np.diff(sums[ends])


def scored(docs: DataFrame, held: Figures, network: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_tokens, log_likelihood, mean_log_likelihood) for every row of docs."""
    spread = docs.sparkSession.sparkContext.broadcast((held, network.flat()))

    def run(batches):
        figures, flat = spread.value
        net, tokens = Network.of(flat), Tokens(figures, within=True)
        for batch in batches:
            for part in slices(batch, 128):
                n, sums = score(part.column(1).to_pylist(), net, tokens)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(sums)], ["id", "n_tokens", "log_likelihood"])

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = texts.mapInArrow(run, f"id {kind}, n_tokens long, log_likelihood double")
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return out.select(F.col("id").alias(id_col), "n_tokens", "log_likelihood", mean.alias("mean_log_likelihood"))


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    held = figures(saved(distinct_words(docs, text_col), "words"))
    return scored(docs, held, trained(docs, held, id_col, text_col), id_col, text_col)
