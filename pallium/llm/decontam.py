"""Benchmark decontamination: CGK embedding, bit-sampling LSH over windows, exact edit verification.

Texts become lower-case word tokens; in scripts that set no blanks each character is a token of its own.  From every
token of every document (and of every item) a CGK random walk starts: at step t it emits the token under its pointer,
and moves on if a random bit drawn from (t, token) says so.  Windows at small edit distance then agree in most steps,
so edit distance becomes Hamming distance; each of `WALKS` walks samples some of its steps as one LSH key.  So that
words with a typo can still agree, only WHOLE walks read whole words; the others read three letters of each, its head
or its tail, by the word's place from the start, in all ways for three words.  All windows from one start share its
walks, so a start is embedded once for items of every length; short items have shorter walks (`FAMILIES`), which are
only made where such items are.  One key met by an item is a candidate at a known alignment.  A lower bound of the
distance, for many candidates at a time, drops only what is beyond it for certain; the semi-global edit distance
between the item and the aligned passage decides on the rest.

Recall: measured, not proved; README.md and tests/llm/test_decontamination_recall.py hold it by item length and edits.

Defined results: null and wordless texts and items meet nothing; items under `MIN_WORDS` words are only found
as exact word sequences; repeated rows give repeated results; equal items are found one by one; empty tables of
documents or items give no row; texts of any length are read whole; other columns of docs are not read.
"""

from __future__ import annotations

import re
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pallium.llm.common import saved, slices

WALKS = 11
SIMILARITY = 0.8
MIN_WORDS = 3


class Family(NamedTuple):
    """Items from `words` words on: steps of their walks, how many a key samples, and how many different words, or parts of them, it must hold."""

    words: int
    steps: int
    sampled: int
    different: int


FAMILIES = (Family(10, 5, 4, 3), Family(6, 4, 3, 2), Family(MIN_WORDS, 3, 2, 2))
STEPS = max(f.steps for f in FAMILIES)
#: What a walk may read of a word: the whole, or PART letters of its head or tail. WHOLE walks read whole words, the others heads or tails.
PARTS = ("whole", "head", "tail")
PART = 3
WHOLE = 3
#: Letters of a piece of an item, one machine word of bits, and the alignments that are bounded together.
PIECE = 63
BOUNDED = 1024
SEED = 7
#: Items, and bytes of them, of one pass over the documents; more mean more passes, so that a task's tables stay small.
ITEMS_A_PASS = 20_000
BYTES_A_PASS = 1 << 25
#: Documents found that are dropped by a broadcast of their marks (8 MB); beyond them the join shuffles.
BROADCAST_MARKS = 1_000_000
#: Odd multipliers of the words' hashes, drawn once.
_BASE, *_MIX = np.random.default_rng(SEED + 1).integers(1, 1 << 63, 3, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Blocks of letters that are written without blanks (Thai to Tibetan, Myanmar, Khmer, kana, Han).
_SOLID = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(r"\w+")
_MIXED = re.compile(rf"[{_SOLID}]|[^\W{_SOLID}]+")
_HAS_SOLID = re.compile(f"[{_SOLID}]")
#: ASCII signs that no word holds, as blanks.
_BLANKS = {c: " " for c in range(128) if not _WORD.match(chr(c))}
_TABLE_BITS = 18


def spaced(text: str | None) -> str:
    """The words of a text in lower case, with nothing but blanks between them."""
    low = (text or "").lower()
    if low.isascii():
        return low.translate(_BLANKS)
    return " ".join((_MIXED if _HAS_SOLID.search(low) else _WORD).findall(low))


def words(text: str | None) -> list[str]:
    return spaced(text).split()


def spelled(tokens: list[str]) -> tuple[str, np.ndarray]:
    """The tokens as one text, a blank between two unless both are letters of their own, and where each starts."""
    joined = " ".join(tokens)
    if not joined.isascii() and _HAS_SOLID.search(joined):
        out, starts, at, solid = [], [], 0, False
        for w in tokens:
            mine = len(w) == 1 and bool(_HAS_SOLID.match(w))
            if out and not (solid and mine):
                out.append(" ")
                at += 1
            out.append(w)
            starts.append(at)
            at, solid = at + len(w), mine
        return "".join(out), np.array(starts)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    return joined, np.concatenate(([0], ends[:-1]))


@cache
def _draws(family: Family) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Multipliers of the walks, their sampled steps, and multipliers that mix a key."""
    rng = np.random.default_rng(SEED)
    odd = rng.integers(1, 1 << 63, WALKS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    steps = np.stack([np.sort(rng.choice(family.steps, family.sampled, replace=False)) for _ in range(WALKS)])
    return odd, steps, rng.integers(1, 1 << 63, family.sampled, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@cache
def _parts() -> np.ndarray:
    """Which of the PARTS each walk reads of the words from its start on: all ways to read three words, repeated."""
    ways = np.arange(WALKS)[:, None] - WHOLE >> np.arange(STEPS) % 3
    return np.where(np.arange(WALKS)[:, None] < WHOLE, 0, 1 + (ways & 1))


def _mixed(hashes: np.ndarray) -> np.ndarray:
    for odd, shift in zip(_MIX, (32, 29)):
        hashes *= odd
        hashes ^= hashes >> np.uint64(shift)
    return hashes


def hashed(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of each of the PARTS of all words of spaced texts, a row each, and the number of words up to the end of each text.

    A word's hash is a polynomial in its letters, those of a part are packed; no word becomes an object of its own.
    """
    joined = f" {' '.join(lines)}   "
    letters = np.frombuffer(joined.encode(), np.uint8) if joined.isascii() else np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = letters != 32
    edges = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    starts, stops = edges[::2], edges[1::2]
    out = np.zeros((len(PARTS), len(starts)), np.uint64)
    ends = np.searchsorted(starts, np.cumsum(np.fromiter(map(len, lines), np.int64, len(lines)) + 1))
    if not len(starts):
        return out, ends
    lengths = stops - starts
    offsets = np.cumsum(lengths) - lengths
    powers = np.cumprod(np.full(lengths.max(), _BASE))
    terms = powers[np.arange(lengths.sum(), dtype=np.int32) - np.repeat(offsets.astype(np.int32), lengths)]
    terms *= letters[letter]
    np.add.reduceat(terms, offsets, out=out[0])
    for row, first in ((1, starts), (2, np.maximum(starts, stops - PART))):
        for k in range(PART):
            out[row] |= np.where(first + k < stops, letters[np.minimum(first + k, len(letters) - 1)], 0).astype(np.uint64) << np.uint64(21 * k)
    return _mixed(out), ends


def embed(hashes: np.ndarray, walk: int, family: Family = FAMILIES[0], count: bool = False) -> tuple[np.ndarray, ...]:
    """For a window from every position: the walk's LSH key, the furthest position that the key saw, and
    with `count` how many different values it holds.

    hashes: of a token sequence that STEPS fillers end.
    """
    odd, steps, mix = _draws(family)
    parts, length = _parts()[walk], hashes.shape[1]
    n = length - STEPS
    if parts.any():
        rows, hashes = parts * length, hashes.ravel()
    else:
        rows, hashes = None, hashes[0]
    begin = np.arange(n)
    at = begin.copy()
    key = np.zeros(n, np.uint64)
    last = int(steps[walk][-1])
    taken, values = 0, []
    for t in range(last + 1):
        value = hashes[at if rows is None else rows[at - begin] + at]
        if t == steps[walk][taken]:
            key ^= value * mix[taken]
            key ^= key >> np.uint64(29)
            taken += 1
            if count:
                values.append(value)
        if t < last:
            at += ((value * odd[walk] >> np.uint64(63 - t)) & np.uint64(1)).view(np.int64)
    if not count:
        return key * odd[walk], at
    return key * odd[walk], at, 1 + (np.diff(np.sort(values, axis=0), axis=0) != 0).sum(0)


_FILL = np.zeros((len(PARTS), STEPS), np.uint64)


class Index:
    """The items of one pass: their keys by family and walk, and the shortest items by their whole sequence."""

    def __init__(self, items: list[tuple[object, str]]):
        self.ids = [i for i, _ in items]
        self.words = [words(t) for _, t in items]
        self.texts = [spelled(w)[0] for w in self.words]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.short: dict[int, dict[tuple, list[int]]] = {}
        keys: dict[tuple, list] = {}
        for k, tokens in enumerate(self.words):
            n = len(tokens)
            if 0 < n < MIN_WORDS:
                self.short.setdefault(n, {}).setdefault(tuple(tokens), []).append(k)
            if n < MIN_WORDS:
                continue
            family = next(f for f in FAMILIES if n >= f.words)
            line = np.concatenate((hashed([" ".join(tokens)])[0], _FILL), axis=1)
            for walk in range(WALKS):
                key, seen, different = embed(line, walk, family, True)
                # a key of too few different words cannot tell passages apart
                ok = np.flatnonzero((seen < n) & (different >= family.different))
                keys.setdefault((family, walk), []).append((key[ok], np.full(len(ok), k, np.int32), ok.astype(np.int32)))
        self.tables = []
        for (family, walk), found in keys.items():
            key, item, start = (np.concatenate(x) for x in zip(*found))
            if not len(key):
                continue
            order = np.argsort(key, kind="stable")
            seen = np.zeros(1 << _TABLE_BITS, bool)
            seen[(key >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = True
            self.tables.append((family, walk, key[order], item[order], start[order], seen))

    def slack(self, similarity: float) -> np.ndarray:
        """Words by which a passage may be longer or shorter than each item, and one more."""
        return np.ceil((1 - similarity) * self.lengths).astype(np.int64) + 1

    def candidates(self, hashes: np.ndarray):
        """(position, item, start in the item) of every key that a window meets."""
        line = np.concatenate((hashes, _FILL), axis=1)
        for family, walk, keys, items, starts, seen in self.tables:
            key, _ = embed(line, walk, family)
            at = np.flatnonzero(seen[(key >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)])
            low, high = np.searchsorted(keys, key[at], "left"), np.searchsorted(keys, key[at], "right")
            n = high - low
            if n.any():
                rows = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield np.repeat(at, n), items[rows].astype(np.int64), starts[rows].astype(np.int64)


def edit_distance_within(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance between pattern and any substring of text, and where the first such one ends (Myers' bit vectors)."""
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
        if score < best:
            best, end = score, j
    return best, end


def _codes(texts: list[str], width: int) -> np.ndarray:
    """Texts as rows of six-bit codes; letters may share one, and 64 fills the rows."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32) & 63
    lengths = np.array([len(t) for t in texts])
    out = np.full((len(texts), width), 64, np.uint8)
    out[np.arange(width) < lengths[:, None]] = flat
    return out


def _least(pieces: list[str], pair: np.ndarray, read: np.ndarray) -> np.ndarray:
    """Least edit distance between each piece and any substring of the text of its pair (Myers' bit vectors, side by side). read: places by texts."""
    zero, one, rows = np.uint64(0), np.uint64(1), np.arange(len(pieces))
    peq = np.zeros((len(pieces), 65), np.uint64)
    for j, column in enumerate(_codes(pieces, PIECE).T):
        peq[rows, column] |= one << np.uint64(j)
    peq[:, 64] = 0
    peq, rows = peq.ravel(), rows * 65
    score = np.array([len(p) for p in pieces], np.int8)
    top = one << (score.astype(np.uint64) - one)
    best, pv, mv = score.copy(), np.full(len(pieces), ~np.uint64(0)), np.zeros(len(pieces), np.uint64)
    eq, xv, xh, ph, mh = (np.empty_like(mv) for _ in range(5))
    place, bit, read = np.empty_like(rows), np.empty(len(pieces), bool), read.astype(np.int64)
    for column in read:
        np.take(column, pair, out=place, mode="clip")
        place += rows
        np.take(peq, place, out=eq, mode="clip")
        np.bitwise_or(eq, mv, out=xv)
        np.bitwise_and(eq, pv, out=xh)
        xh += pv
        xh ^= pv
        xh |= eq
        np.bitwise_or(xh, pv, out=ph)
        np.invert(ph, out=ph)
        ph |= mv
        np.bitwise_and(pv, xh, out=mh)
        np.not_equal(np.bitwise_and(ph, top, out=eq), zero, out=bit)
        score += bit.view(np.int8)
        np.not_equal(np.bitwise_and(mh, top, out=eq), zero, out=bit)
        score -= bit.view(np.int8)
        ph <<= one
        mh <<= one
        np.bitwise_or(xv, ph, out=pv)
        np.invert(pv, out=pv)
        pv |= mh
        np.bitwise_and(ph, xv, out=mv)
        np.minimum(best, score, out=best)
    return best


def may_match(patterns: list[str], texts: list[str], most: np.ndarray) -> np.ndarray:
    """False where each substring of the text is for certain further than `most` from the pattern.

    A pattern is cut into pieces of one machine word; each is sought in the text by itself, for all pairs at a time, and
    what the pieces need at least is needed in sum. Half of the pieces are enough to part most pairs.
    """
    bound, read = np.zeros(len(patterns)), np.ascontiguousarray(_codes(texts, max(map(len, texts))).T)
    for half in (0, 1):
        near = np.flatnonzero(bound <= most)
        cut = [(k, p[len(p) * j // n : len(p) * (j + 1) // n]) for k in near.tolist() for p in [patterns[k]] for n in [-(-len(p) // PIECE)] for j in range(half, n, 2)]
        if cut:
            pair = np.array([k for k, _ in cut])
            bound += np.bincount(pair, _least([p for _, p in cut], pair, read), len(patterns))
    return bound <= most


def _places(index: Index, hashes: np.ndarray, ends: np.ndarray, similarity: float):
    """(text, item, first token, last first token, slack) of the alignments to verify: wherever a text and an item share a key.

    Alignments within one slack of each other are verified together.
    """
    met = list(index.candidates(hashes))
    if not met:
        return
    at, item, start = (np.concatenate(x) for x in zip(*met))
    text = np.searchsorted(ends, at, "right")
    first = at - start - np.concatenate(([0], ends))[text]
    slack = index.slack(similarity)
    part = first // slack[item]
    order = np.lexsort((first, item, text))
    text, item, first, part = text[order], item[order], first[order], part[order]
    new = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (part[1:] != part[:-1]))))
    last = first[np.append(new[1:], len(first)) - 1]
    yield from zip(text[new].tolist(), item[new].tolist(), first[new].tolist(), last.tolist(), slack[item[new]].tolist())


def matches(index: Index, texts: list[str | None], similarity: float) -> list[tuple[int, int, int, int, int]]:
    """(text, item, distance, first token, tokens) of every text and item that verify, the best place of each."""
    spread = [spaced(t) for t in texts]
    hashes, ends = hashed(spread)
    if not hashes.size:
        return []
    found: dict[tuple[int, int], tuple[int, int, int]] = {}
    lines: dict[int, tuple[str, list[int]]] = {}
    # a similarity of just the threshold counts, however the product is rounded
    most = [len(t) - similarity * len(t) + 1e-9 for t in index.texts]

    def keep(text, k, distance, at):
        """Note a distance whose passage starts at a letter of the text."""
        found[text, k] = (distance, max(0, int(np.searchsorted(lines[text][1], at, "right")) - 1), len(index.words[k]))

    def verify(open_places):
        """Exact distances of what the lower bounds leave."""
        open_places = [p for p in open_places if found.get(p[:2], (1,))[0]]
        if not open_places:
            return
        patterns = [index.texts[k] for _, k, _, _ in open_places]
        near = may_match(patterns, [joined for *_, joined in open_places], np.array([most[k] for _, k, _, _ in open_places]))
        for at in np.flatnonzero(near).tolist():
            (text, k, low, joined), pattern = open_places[at], patterns[at]
            distance, end = edit_distance_within(pattern, joined)
            if distance <= most[k] and distance < found.get((text, k), (1 << 30,))[0]:
                keep(text, k, distance, low + max(0, end - len(pattern)))

    waiting = []
    for text, k, first, last, slack in _places(index, hashes, ends, similarity):
        if found.get((text, k), (1,))[0] == 0:
            continue
        if text not in lines:
            lines[text] = spelled(spread[text].split())
        line, starts = lines[text]
        high = last + len(index.words[k]) + slack
        low = starts[max(0, first - slack)]
        joined = line[low : starts[high] if high < len(starts) else len(line)]
        spot = joined.find(index.texts[k])
        if spot >= 0:
            keep(text, k, 0, low + spot)
        elif joined:
            waiting.append((text, k, low, joined))
        if len(waiting) >= BOUNDED:
            verify(waiting)
            waiting = []
    verify(waiting)
    for text, line in enumerate(spread if index.short else ()):
        tokens = line.split()
        for n, sequences in index.short.items():
            for p in range(len(tokens) - n + 1):
                for k in sequences.get(tuple(tokens[p : p + n]), ()):
                    found.setdefault((text, k), (0, p, n))
    return [(text, k, *rest) for (text, k), rest in sorted(found.items())]


def contaminated(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY
) -> DataFrame:
    """(id_col, item_id, distance, similarity, first_token, n_tokens) of every document and item that match.

    Items are a stated query set: each pass reads about ITEMS_A_PASS of them, or BYTES_A_PASS of their text, into every task.
    """
    listed = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).filter("t is not null")
    size = listed.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0)).alias("bytes")).first()
    passes = max(1, -(-size["n"] // ITEMS_A_PASS), -(-size["bytes"] // BYTES_A_PASS))
    part = F.pmod(F.xxhash64("i", "t"), F.lit(passes))
    out = None
    for k in range(passes):
        held = [(r["i"], r["t"]) for r in listed.filter(part == k).collect()]
        one = _pass(docs, held, id_col, text_col, items.schema[item_id].dataType.simpleString(), item_id, similarity)
        out = one if out is None else out.union(one)
    return out


def _pass(docs, held, id_col, text_col, item_kind, item_id, similarity) -> DataFrame:
    spread = docs.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        index = Index(spread.value)
        id_kind = pa.array(index.ids).type if index.ids else pa.int64()
        for batch in batches:
            for chunk in slices(batch, 128):
                rows = matches(index, chunk.column(1).to_pylist(), similarity)
                columns = [list(c) for c in zip(*rows)] or [[]] * 5
                share = [1 - d / max(1, len(index.texts[k])) for k, d in zip(columns[1], columns[2])]
                yield pa.RecordBatch.from_arrays(
                    [
                        chunk.column(0).take(pa.array(columns[0], pa.int64())),
                        pa.array([index.ids[k] for k in columns[1]], id_kind),
                        pa.array(columns[2], pa.int32()),
                        pa.array(share, pa.float64()),
                        pa.array(columns[3], pa.int32()),
                        pa.array(columns[4], pa.int32()),
                    ],
                    ["id", "item", "distance", "similarity", "first_token", "n_tokens"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, item {item_kind}, distance int, similarity double, first_token int, n_tokens int"
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
    return found.withColumnsRenamed({"id": id_col, "item": item_id})


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that hold a passage of an item; rows without id are judged by their text alone.

    What was found is written first; its marks are broadcast while they are few, so that texts don't move.
    """
    mark = F.xxhash64(F.coalesce(F.col(id_col).cast("string"), F.lit("")), text_col)
    found = contaminated(docs.select(mark.alias("mark"), F.col(text_col).alias("text")), items, "mark")
    bad = saved(found.select(F.col("mark").alias("_contaminated")).distinct(), "contaminated")
    if bad.count() <= BROADCAST_MARKS:
        bad = F.broadcast(bad)
    return docs.join(bad, mark == F.col("_contaminated"), "left_anti")
