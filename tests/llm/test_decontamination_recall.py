import random
import string

import numpy as np
import pytest

from pallium.llm import decontam


def word(rng):
    return "".join(rng.choices(string.ascii_lowercase, k=rng.randint(3, 9)))


def typo(rng, w):
    p, c, kind = rng.randrange(len(w)), rng.choice(string.ascii_lowercase), rng.random()
    return w[:p] + c + w[p + 1 :] if kind < 0.6 else w[:p] + c + w[p:] if kind < 0.8 else w[:p] + w[p + 1 :]


def edited(rng, tokens, kind, rate):
    at = set(rng.sample(range(len(tokens)), round(rate * len(tokens))))
    return [w if k not in at else typo(rng, w) if kind == "typos" else word(rng) for k, w in enumerate(tokens)]


@pytest.mark.parametrize("n", [10, 12, 16, 20, 30, 40])
@pytest.mark.parametrize("kind, rate", [("words", 0.1), ("words", 0.2), ("words", 0.25), ("typos", 0.3), ("typos", 0.5)])
def test_recall_by_length_and_edits(n, kind, rate):
    rng = random.Random(8)
    items = [[word(rng) for _ in range(n)] for _ in range(100)]
    index = decontam.Index([(i, " ".join(w)) for i, w in enumerate(items)])
    found = total = 0
    for i, tokens in enumerate(items):
        doc = " ".join([word(rng) for _ in range(20)] + edited(rng, tokens, kind, rate) + [word(rng) for _ in range(20)])
        if decontam.edit_distance_within(index.texts[i], doc)[0] <= 0.2 * len(index.texts[i]):
            total += 1
            found += any(k == i for _, k, *_ in decontam.matches(index, [doc], 0.8))
    assert found >= 0.9 * total


@pytest.mark.parametrize("n", [16, 20, 30, 40])
def test_recall_where_every_word_has_a_typo(n):
    rng = random.Random(9)
    items = [[word(rng) for _ in range(n)] for _ in range(60)]
    index = decontam.Index([(i, " ".join(w)) for i, w in enumerate(items)])
    docs = [" ".join(edited(rng, w, "typos", 1)) for w in items]
    near = [i for i, doc in enumerate(docs) if decontam.edit_distance_within(index.texts[i], doc)[0] <= 0.2 * len(index.texts[i])]
    met = {(t, k) for t, k, *_ in decontam.matches(index, docs, 0.8)}
    assert len(near) > 30 and sum((i, i) in met for i in near) >= 0.9 * len(near)


def test_a_similarity_of_just_the_threshold_counts():
    tokens = [f"{c}{c}{d}{d}" for c, d in zip("abcdefghij", "klmnopqrst")] + ["z"]  # 51 letters and spaces: 50 and a last one
    index = decontam.Index([(0, " ".join(tokens)[:-2] + "yz")])
    doc = " ".join(["xxxxx" if k == 4 else "xxxxx" if k == 8 else w for k, w in enumerate(index.words[0])])
    n, distance = len(index.texts[0]), decontam.edit_distance_within(index.texts[0], doc)[0]
    assert [r[:3] for r in decontam.matches(index, [doc], 1 - distance / n)] == [(0, 0, distance)]


def test_the_bound_drops_no_pair_within_the_distance():
    rng = random.Random(1)
    patterns, texts = ([("".join(rng.choices("ab cdé", k=rng.randint(1, 200)))) for _ in range(150)] for _ in range(2))
    most = np.array([decontam.edit_distance_within(p, t)[0] for p, t in zip(patterns, texts)])
    assert decontam.may_match(patterns, texts, most).all()
    assert not decontam.may_match(["abcdefgh" * 20], ["zyxw" * 60], np.array([32])).any()


@pytest.mark.parametrize("n", [4, 5, 6, 7, 8, 9])
@pytest.mark.parametrize("kind, rate", [("words", 0.15), ("typos", 0.34), ("typos", 0.6)])
def test_recall_of_short_items(n, kind, rate):
    rng = random.Random(10)
    items = [[word(rng) for _ in range(n)] for _ in range(150)]
    index = decontam.Index([(i, " ".join(w)) for i, w in enumerate(items)])
    docs = [" ".join([word(rng) for _ in range(30)] + edited(rng, w, kind, rate) + [word(rng) for _ in range(30)]) for w in items]
    near = [i for i, doc in enumerate(docs) if decontam.edit_distance_within(index.texts[i], doc)[0] <= 0.2 * len(index.texts[i])]
    met = {(t, k) for t, k, *_ in decontam.matches(index, docs, 0.8)}
    assert near and sum((i, i) in met for i in near) >= 0.9 * len(near)


@pytest.mark.parametrize("rate", [0, 0.1, 0.18])
def test_scripts_without_blanks(rate):
    rng = random.Random(11)
    letters = [chr(c) for c in range(0x4E00, 0x4F80)]
    items = ["".join(rng.choices(letters, k=rng.randint(12, 60))) for _ in range(60)]
    index = decontam.Index(list(enumerate(items)))
    assert index.texts == items
    change = lambda text: "".join(rng.choice(letters) if rng.random() < rate else c for c in text)
    docs = ["a " + "".join(rng.choices(letters, k=80)) + change(t) + "".join(rng.choices(letters, k=40)) + " z" for t in items]
    near = [i for i, doc in enumerate(docs) if decontam.edit_distance_within(items[i], doc)[0] <= 0.2 * len(items[i])]
    met = {(t, k) for t, k, *_ in decontam.matches(index, docs, 0.8)}
    assert len(near) > 30 and sum((i, i) in met for i in near) >= 0.9 * len(near)


def test_places_of_tokens_in_the_text():
    for text in ("one two  three", "漢字 mixed 漢 text字", ""):
        tokens = decontam.words(text)
        line, starts = decontam.spelled(tokens)
        assert [line[s : s + len(w)] for s, w in zip(starts, tokens)] == tokens
