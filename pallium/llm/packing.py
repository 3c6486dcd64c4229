"""Best-fit packing of tokenised documents into sequences, planned on the histogram of lengths.

Token ids are needed once, for lengths and checksums.  The plan works on counts: `plan` places all documents of
one length at once, longest first, into the open sequences with the least room that still fits, so its size
follows the number of distinct lengths, not of documents.  Documents then take planned slots by their rank
within their length; ranks come from counts of hashed parts, so that no length is ordered in one task.

Defined results: a null or empty text is the closing id alone; longer documents than a sequence are cut into
full pieces after a shorter first one; repeated rows are packed as documents of their own; an empty table
gives an empty result.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pallium.llm.common import saved, slices

ROOM = 2048
CLOSING_ID = 0
#: Distinct strings that a worker remembers; beyond them the memo starts anew.
MEMO = 300_000
#: Rows of a part of a length, within which ranks are counted by ordering.
PART = 10_000
#: Fixed value: the pattern that splits text before the merges of such vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _bytes_of_characters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the rest as characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


_BYTE_OF = _bytes_of_characters()


class Encoder:
    """Ids of a byte-level BPE vocabulary as little-endian bytes.

    The vocabulary's pattern never joins a non-blank character with what follows a blank or line feed, so
    the strings between those encode independently; each distinct one is encoded once while the memo holds it.
    New ones are encoded together, a line feed between them: it is a token of its own that nothing merges with.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.feed = self.model.encode("\n", add_special_tokens=False).ids
        self.memo: dict[str, bytes] = {}
        self.many = self._fast()

    def raw(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.model.encode_batch(texts, add_special_tokens=False)]

    def _fast(self):
        """The same vocabulary in a quicker encoder for plain strings; its ranks are the model's ids."""
        import tiktoken

        added = {t.content for t in self.model.get_added_tokens_decoder().values()}
        ranks = {bytes(_BYTE_OF[c] for c in token): i for token, i in self.model.get_vocab().items() if token not in added}
        self.added = sorted(added)
        return tiktoken.Encoding("same", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def learn(self, new: list[str]) -> None:
        """Put strings without white space inside, but for a line feed in front, into the memo."""
        joined = "\n".join([w[1:] if w[0] == "\n" else " " + w for w in new])
        if any(a in joined for a in self.added):
            self.memo.update(zip(new, self.raw([w if w[0] == "\n" else " " + w for w in new])))
            return
        ids = np.array(self.many(joined), "<u4")
        feed, cuts = np.array(self.feed, "<u4").tobytes(), np.flatnonzero(ids == self.feed[0]).tolist()
        if len(cuts) != len(new) - 1:
            raise ValueError("the line feed is not a token of its own")
        data, at = ids.tobytes(), 0
        for w, cut in zip(new, [*cuts, len(ids)]):
            self.memo[w] = feed + data[at : 4 * cut] if w[0] == "\n" else data[at : 4 * cut]
            at = 4 * cut + 4

    def encode(self, texts: list[str]) -> list[bytes]:
        # A single blank stays with the string after it, as the pattern has it.
        split = [t.replace("\n", " \n").split(" ") if t.replace("\n", "").isprintable() else None for t in texts]
        seen = set().union(*(words[1:] for words in split if words))
        if "" in seen or "\n" in seen or any(words and words[0] == "" for words in split):
            split = [None if words and ("" in words or "\n" in words) and len(words) > 1 else words for words in split]
            seen = set().union(*(words[1:] for words in split if words))
        new = seen.difference(self.memo)
        if len(self.memo) + len(new) > MEMO:
            self.memo, new = {}, seen
        if new:
            self.learn(list(new))
        whole = iter(self.raw([t if words is None else words[0] for t, words in zip(texts, split)]))
        get = self.memo.__getitem__
        return [next(whole) if words is None else b"".join([next(whole), *map(get, words[1:])]) for words in split]


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", room: int = ROOM) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every document, longer ones cut after a shorter first piece."""

    def run(batches):
        of, closing = encoder(model_path), np.array([CLOSING_ID], "<u4").tobytes()
        for batch in batches:
            for part in slices(batch, 256):
                rows, out = [], []
                for row, ids in enumerate(of.encode([t or "" for t in part.column(1).to_pylist()])):
                    ids += closing
                    n = len(ids) // 4
                    cuts = [0, *range(n % room or room, n, room), n]
                    for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                        rows.append(row)
                        out.append((piece, a, b - a, zlib.crc32(memoryview(ids)[4 * a : 4 * b])))
                columns = list(zip(*out)) or [(), (), (), ()]
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                    ["id", "piece", "start", "length", "ids_crc32"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


def plan(histogram: dict[int, int], room: int = ROOM) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, count, first sequence, offset) that place every length of the histogram.

    A run puts documents of one length with consecutive ranks into consecutive sequences at one offset.
    """
    open_runs: list[list[tuple[int, int]]] = [[] for _ in range(room + 1)]  # by room left: (first sequence, count)
    runs, made = [], 0
    for length in sorted(histogram, reverse=True):
        if not 0 < length <= room:
            raise ValueError(f"length {length} doesn't fit a sequence of {room}")
        rank, n = 0, histogram[length]
        left = length
        while n:
            while left <= room and not open_runs[left]:
                left += 1
            if left > room:
                each = room // length  # new sequences take as many of this length as fit
                full, rest = divmod(n, each)
                for sequences, depth in ((full, each), (1 if rest else 0, rest)):
                    if sequences:
                        for k in range(depth):
                            runs.append((length, rank, sequences, made, k * length))
                            rank += sequences
                        open_runs[room - depth * length].append((made, sequences))
                        made += sequences
                n = 0
            else:
                first, count = open_runs[left].pop()
                each = left // length  # a sequence that takes one is the tightest for the next
                full, rest = divmod(n, each)
                if full >= count:
                    full, rest = count, 0
                at = first
                for sequences, depth in ((full, each), (1 if rest else 0, rest)):
                    if sequences:
                        for k in range(depth):
                            runs.append((length, rank, sequences, at, room - left + k * length))
                            rank, n = rank + sequences, n - sequences
                        open_runs[left - depth * length].append((at, sequences))
                        at += sequences
                if at < first + count:
                    open_runs[left].append((at, first + count - at))
    return runs


def ranked(rows: DataFrame, key: str, order: list[str], parts: int) -> DataFrame:
    """rows with `rank`, from 0 within each key, without ordering a whole key anywhere."""
    split = rows.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    counts = split.groupBy(key, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy(key, "_part").orderBy(*order)
    placed = split.withColumn("_row", F.row_number().over(within) - 1)
    return placed.join(starts, [key, "_part"]).withColumn("rank", F.col("_row") + F.col("_before")).drop("_part", "_row", "_before")


def pack(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", room: int = ROOM) -> DataFrame:
    """Every piece of every document with its place: sequence_id and offset."""
    spark = docs.sparkSession
    cut = saved(pieces(docs, model_path, id_col, text_col, room), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most `room` rows
    total = sum(histogram.values())
    runs = plan(histogram, room)
    schema = "length long, first_rank long, n long, first_sequence long, offset long"
    slots = spark.createDataFrame(runs, schema) if runs else spark.createDataFrame([], schema)
    rows = ranked(cut, "length", ["id", "piece", "start", "ids_crc32"], max(1, -(-total // PART)))
    if len(runs) <= 100_000:  # 5 MB at most; beyond it the join shuffles
        slots = F.broadcast(slots)
    at = (rows["length"] == slots["length"]) & (rows["rank"] >= slots["first_rank"]) & (rows["rank"] < slots["first_rank"] + slots["n"])
    return rows.join(slots, at).select(
        F.col("id").alias(id_col),
        "piece",
        "start",
        rows["length"],
        "ids_crc32",
        (F.col("first_sequence") + F.col("rank") - F.col("first_rank")).alias("sequence_id"),
        "offset",
    )
