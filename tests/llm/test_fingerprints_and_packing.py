import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pallium.llm import packing, simhash, token_counts

BYTE_MODEL = public_tokenizers.path("byte_bpe_50k.json")
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [None, "", " ", "\n", "a", "  two  blanks ", "a\nb", "a\n\n b", "tab\tin", "x" * 9000, "word " * 5000, "é ü ß", "▁ ▁a", "<s> <|endoftext|> x<|endoftext|>y", "3.14 don't", "a　b c", "​\x00", "🙂 ok"]
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards pack five dozen liquor jugs before noon on a hot day in the old town"


def plain_fingerprint(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aBc É\t\n\x0b", max_size=60))
def test_fingerprint_equals_the_plain_one(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_long_texts_are_counted_in_blocks(monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(PROSE) == plain_fingerprint(PROSE)


def plain_components(prints, radius=3):
    ids, root = list(prints), {i: i for i in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in ids:
        for j in ids:
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("tile", [8, 1024])
def test_links_lose_none(spark, tile):
    rng = np.random.default_rng(1)
    prints = [0, 1, 3, 7, 15, 31]  # a chain of single steps
    for _ in range(40):
        base = int(rng.integers(0, 1 << 62))
        prints += [base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(6)]
    centre = int(rng.integers(0, 1 << 62))
    prints += [centre ^ (1 << a) ^ (1 << b) for a in range(12) for b in range(a)]  # one dense group
    prints = sorted(set(prints))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = simhash.links(nodes, 3, tile)
    assert links.count() < 4 * len(prints)  # forests, not pairs
    found = {r["node"]: r["root"] for r in simhash.components(links).collect()}
    expect, got = plain_components(dict(enumerate(prints))), defaultdict(set)
    for k, fp in enumerate(signed):
        got[found.get(fp, fp)].add(k)
    want = defaultdict(set)
    for k, c in expect.items():
        want[c].add(k)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_near_duplicates_of_awkward_rows(spark):
    rows = [(1, PROSE, "x"), (2, PROSE, "y"), (2, PROSE, "y"), (3, None, "z"), (4, "", None), (None, PROSE, None), (5, PROSE.upper(), "q"), (6, "something else entirely here", "w")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == [(0, 1), (1, 1), (2, 1), (2, 1), (3, 3), (4, 3), (5, 1), (6, 6)]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 3, 6]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert packing.pack(docs, BYTE_MODEL).count() == 0
    assert token_counts.token_counts(docs, PIECE_MODEL).count() == 0


def test_token_counts_equal_the_library(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumnRenamed("doc_id", "n_tokens")
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE_MODEL)
    for r in token_counts.token_counts(docs, PIECE_MODEL, id_col="n_tokens").toDF("id", "n_bytes", "n", "over").collect():
        text = TEXTS[r["id"]] or ""
        assert (r["n"], r["n_bytes"], r["over"]) == (len(model.encode(text)), len(text.encode()), len(model.encode(text)) > 4096)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(max_size=30), max_size=5))
def test_token_counts_of_any_text(texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    model = token_counts.load(PIECE_MODEL)
    assert token_counts.counter(PIECE_MODEL).count(texts) == [len(x) for x in model.encode(texts)]


def test_whole_tokens_are_proved():
    model = token_counts.load(PIECE_MODEL)
    words = token_counts.whole_tokens(PIECE_MODEL)
    assert len(words) > 10_000 and all(len(model.encode(w)) == 1 for w in words)
    assert not token_counts.independent(["a▁b"]) and not token_counts.independent(["a\n"]) and token_counts.independent(["▁▁", "▁a"])


def test_memo_starts_anew(monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO", 5)
    model = token_counts.load(PIECE_MODEL)
    assert token_counts.Counter(PIECE_MODEL).count([PROSE, PROSE + " zqxj"]) == [len(x) for x in model.encode([PROSE, PROSE + " zqxj"])]
    monkeypatch.setattr(packing, "MEMO", 5)
    one = packing.Encoder(BYTE_MODEL)
    assert one.encode([PROSE, PROSE]) == one.raw([PROSE, PROSE])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=30), st.text(alphabet="ab \n\t.1'<|>", max_size=30)), max_size=5))
def test_encoder_equals_the_library(texts):
    texts = [t.encode("utf-8", "replace").decode() for t in texts] + ["x <|endoftext|> y"]
    one = packing.encoder(BYTE_MODEL)
    assert one.encode(texts) == one.raw(texts)


def test_packing_round_trip(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS + ["same text"] * 40)), "doc_id long, text string")
    rows = packing.pack(docs, BYTE_MODEL).collect()
    model, by_doc, by_sequence = Tokenizer.from_file(BYTE_MODEL), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    total = 0
    for doc_id, text in enumerate(TEXTS + ["same text"] * 40):
        ids, at = model.encode(text or "", add_special_tokens=False).ids + [0], 0
        parts = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        for r in parts:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids) and all(r["length"] == 2048 for r in parts[1:]) and (len(ids) > 2048 or len(parts) == 1)
        total += len(ids)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert len(by_sequence) <= -(-total // 2048) + 1


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plan_places_every_length_once(histogram):
    filled, placed = defaultdict(dict), defaultdict(list)
    for length, rank, n, first, offset in packing.plan(histogram, 64):
        for k in range(n):
            assert offset not in filled[first + k]
            filled[first + k][offset] = length
            placed[length].append(rank + k)
    assert {k: sorted(v) for k, v in placed.items()} == {k: list(range(n)) for k, n in histogram.items()}
    for places in filled.values():
        at = 0
        for offset in sorted(places):
            assert offset == at
            at += places[offset]
        assert at <= 64
    lengths = sorted((x for x, n in histogram.items() for _ in range(n)), reverse=True)
    rooms = []
    for x in lengths:  # best fit over documents gives as many sequences
        fit = [r for r in rooms if r >= x]
        if fit:
            rooms.remove(min(fit))
        rooms.append((min(fit) if fit else 64) - x)
    assert len(filled) == len(rooms)


@pytest.mark.parametrize("tile", [4, 64, 256])
def test_tiles_find_every_close_pair(tile):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = base[rng.integers(0, 40, 600)] ^ (np.uint64(1) << rng.integers(0, 64, 600, dtype=np.uint64)) * rng.integers(0, 2, 600, dtype=np.uint64)
    keys = np.where(rng.random(600) < 0.5, 7, rng.integers(0, 200, 600))
    order = np.lexsort((fps, np.bitwise_count(fps), keys))
    keys, fps = keys[order], fps[order]
    a, b = simhash.close_rows(keys, fps, 3, tile)
    want = {(i, j) for i in range(600) for j in range(i + 1, 600) if keys[i] == keys[j] and int(fps[i] ^ fps[j]).bit_count() <= 3}
    assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)


@pytest.mark.parametrize("few", [0, 1_000_000])
def test_keep_one_judges_rows_not_ids(spark, monkeypatch, few):
    monkeypatch.setattr(simhash, "BROADCAST_MARKS", few)
    same, other = " ".join(f"word{k}" for k in range(60)), " ".join(f"else{k}" for k in range(60))
    rows = [(1, same), (1, other), (2, same), (3, other), (4, "alone here"), (4, "alone here"), (None, same), (None, same), (5, None), (6, "")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _mark string")
    kept = simhash.keep_one(docs.withColumnRenamed("_mark", "fp"))
    key = lambda r: (r[0] or 0, r[1] or "")
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=key) == sorted([(None, same), (None, same), (1, other), (1, same), (4, "alone here"), (5, None)], key=key)


def test_a_fingerprint_of_many_rows(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT", 4)
    rows = [(i, "the same words over and over again here" if i % 3 else f"words of row {i} alone " * 3) for i in range(90)]
    found = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(found) == 90 and all(found[i] == 1 for i, _ in rows if i % 3) and all(found[i] <= i for i in found)
