"""Token counts of whole texts under a SentencePiece BPE vocabulary.

No vocabulary string has a word-start mark after another character (runs of marks alone aside) and none holds
a line feed, so no merge crosses the border before a mark or around a line feed: the pre-tokens between those
borders encode independently.  `whole_tokens` proves offline which strings encode alone as one token; those
count as one by a look-up, and only the rest is merged by the library, once for each distinct string that a
worker has in its bounded memo.  Texts with runs of blanks or with the mark itself go to the library whole.

Defined results: null and empty texts have 0 bytes and 0 tokens; repeated rows give repeated rows.
"""

from __future__ import annotations

import re
from functools import cache

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pallium.llm.common import slices

MARK = "▁"
LIMIT = 4096
#: Distinct strings that a worker remembers; beyond them the memo starts anew.
MEMO = 400_000
_ODD = re.compile(rf"  |{MARK}|\n\n| \n|\n |^[ \n]|[ \n]$")


def independent(pieces: list[str]) -> bool:
    """Whether pre-tokens of this vocabulary can be counted apart."""
    return not any((MARK in p[1:] and p.strip(MARK)) or "\n" in p or " " in p for p in pieces)


@cache
def load(path: str) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_file=path)


@cache
def whole_tokens(path: str) -> frozenset[str]:
    """The strings with a leading mark that encode alone as one token, without the mark; the text's start adds one.

    Empty when the vocabulary doesn't allow independent pre-tokens: then every text is merged whole.
    """
    model = load(path)
    pieces = [model.id_to_piece(i) for i in range(model.vocab_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    if not independent(pieces):
        return frozenset()
    words = [p[1:] for p in pieces if p.startswith(MARK) and p.strip(MARK)]
    return frozenset(w for w, ids in zip(words, model.encode(words, num_threads=1)) if len(ids) == 1)


class Counter:
    """Counts tokens; a pre-token that follows a line feed is looked up with that line feed."""

    def __init__(self, path: str):
        self.model = load(path)
        self.whole = dict.fromkeys(whole_tokens(path), 1)
        self.memo = dict(self.whole)

    def count(self, texts: list[str]) -> list[int]:
        memo, out, odd = self.memo, [], []
        split = []
        for text in texts:
            if not self.whole or _ODD.search(text):
                split.append(None)
                odd.append(text)
            else:
                split.append(text.replace("\n", " \n").split(" ") if text else ())
        new = {w for words in split if words for w in words if w not in memo}
        if new:
            if len(memo) + len(new) > MEMO:
                self.memo = memo = dict(self.whole)
                new = {w for words in split if words for w in words if w not in memo}
            rest = list(new)
            # A string after a line feed has no mark; encoding it gives the start's mark and the line feed besides.
            for w, ids in zip(rest, self.model.encode(rest, num_threads=1)):
                memo[w] = len(ids) - w.startswith("\n")
        whole = iter(self.model.encode(odd, num_threads=1))
        for words in split:
            out.append(len(next(whole)) if words is None else sum(map(memo.__getitem__, words)))
        return out


@cache
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) for every row of docs."""

    def run(batches):
        of = counter(model_path)
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(of.count(texts), pa.int64())], ["id", "n_tokens"]).append_column(
                    "n_bytes", pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64())
                )

    kind = docs.schema[id_col].dataType.simpleString()
    counted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, n_bytes long")
    return counted.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
