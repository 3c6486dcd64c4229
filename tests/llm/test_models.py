import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pallium.llm import lm_score, quality, toxicity

CALM = "the river runs past the old mill and the children watch the boats drift by in the evening light number {}"


def rows(n):
    out = []
    for i in range(n):
        text = CALM.format(i * 7919 % 1000)
        out.append((i, text.replace("boats", "scumbags you idiots") if i % 3 == 0 else text, int(i % 3 == 0), i % 4))
    return out


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.createDataFrame([(i, t, "en") for i, t, _, _ in rows(300)] + [(900, None, None), (901, "", "x"), (None, "you idiots", "y"), (902, "idiots " * 30000, "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, x, q) for i, _, x, q in rows(300)] + [(1, 0, 1), (5, None, None), (None, 1, 1), (5000, 1, 0)], "doc_id long, toxic int, quality int")
    return docs.cache(), labels.cache()


def test_toxicity_holds_out_and_learns(tables):
    docs, labels = tables
    found = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(found) == docs.count()
    for i, _, toxic, _ in rows(300):
        assert found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert found[i]["predicted"] == toxic and 0 <= found[i]["score"] <= 1
    assert not found[None]["held_out"] and found[None]["predicted"] == 1 and found[902]["predicted"] == 1
    assert found[900]["score"] == found[901]["score"] < 0.5


def test_held_out_labels_are_never_read(tables):
    docs, labels = tables
    turned = labels.withColumn("toxic", F.when(toxicity.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (toxicity.train(docs, x) for x in (labels, turned))
    assert (a.weights == b.weights).all() and a.bias == b.bias


def test_grams_equal_the_plain_ones():
    texts = ["One two, one\tTHREE", "", None, "a", "ünï  code", "x" * 50]

    def plain(text):
        raw = b" " + (text or "").lower().encode().translate(bytes.maketrans(b"\t\n\x0b\x0c\r", b"     ")) + b"  "
        return {raw[i : i + n] for n in (3, 4, 5) for i in range(len(raw) - n + 1) if b" " not in raw[i + 1 : i + n - 1]}

    for text, numbers in zip(texts, toxicity.Grams().of_texts(texts)):
        assert len(set(numbers.tolist())) == len(numbers)
        assert len(numbers) <= len(plain(text)) and len(numbers) >= 0.9 * len(plain(text))


@pytest.mark.parametrize("one", [True, False])
def test_toxicity_without_both_classes(spark, tables, one):
    labels = spark.createDataFrame([(i, 1) for i in range(50)] if one else [], "doc_id long, toxic int")
    scores = {r["score"] for r in toxicity.toxicity(tables[0], labels).collect()}
    assert len(scores) == 1 and (min(scores) > 0.99 if one else min(scores) == 0.5)


def test_thresholds_are_ordered_and_grades_expected(spark):
    rng = np.random.default_rng(1)
    texts = {0: "BUY!!! NOW!!! ", 1: "buy it now; now; now; ", 2: "the calm river runs by the mill. "}
    made = [(i, texts[i % 3] * int(rng.integers(3, 9)), i % 3) for i in range(240)]
    docs = spark.createDataFrame([(i, t, "a") for i, t, _ in made] + [(900, None, None), (None, "x", "b")], "doc_id long, text string, expected_grade string")
    ratings = spark.createDataFrame([(i, float(q)) for i, _, q in made] + [(900, None), (None, 1.0)], "doc_id long, quality double")
    model = quality.train(docs, ratings)
    assert list(model.grades) == [0, 1, 2] and (np.diff(model.thresholds) > 0).all()
    found = {r["doc_id"]: r for r in quality.quality(docs.drop("expected_grade"), ratings).collect()}
    assert len(found) == 242
    for i, _, q in made:
        assert abs(found[i]["expected_grade"] - q) < 0.5 and found[i]["selected"] == (q == 2)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {i for i, _, q in made if q == 2}


def test_quality_with_one_grade_or_none(spark, tables):
    docs = tables[0]
    one = quality.quality(docs, spark.createDataFrame([(1, 4)], "doc_id long, quality int"))
    assert {(r["expected_grade"], r["selected"]) for r in one.collect()} == {(4.0, True)}
    none = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.keep_good(docs, none).count() == docs.count()


def test_repeated_words_are_seen():
    buckets = quality.Features.buckets
    assert buckets("a a a a".split(), 7).tolist() != buckets("a b a b".split(), 7).tolist()


def plain_features(text):
    """Every feature of a text and its value, one by one."""
    fold = lambda h: (((h ^ (h >> 15)) * 0x9E3779B1) & 0xFFFFFFFF) >> 16
    kind = lambda b: 97 if 97 <= b <= 122 or b >= 128 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 32 if b in b"\t\n\x0b\x0c\r" else b
    shape = []
    for b in map(kind, b" " + (text or "").encode() + b" "):
        shape.append(b)
    shape = [b for i, b in enumerate(shape) if i < 2 or not b == shape[i - 1] == shape[i - 2]]
    grams = []
    for n in (3, 4, 5):
        for i in range(len(shape) - n + 1):
            h = 0
            for b in shape[i : i + n]:
                h = (h * 0x01000193 + b) & 0xFFFFFFFF
            grams.append(fold(h))
    words = (text or "").lower().split()
    crc = [zlib.crc32(w.encode()) for w in words]
    tokens = [fold(h) for h in crc] + [fold((a * 0x01000193 + b) & 0xFFFFFFFF) for a, b in zip(crc, crc[1:])]
    found = [(g, 12 / len(grams)) for g in grams] + [(t, 4 / len(tokens)) for t in tokens]
    return found + [(b, 0.5) for b in quality.Features.buckets(words, len(text or "")).tolist()]


AWKWARD = ["The model was trained well", "zqx wvkjz qqq xxxzzyy jkkq", "", None, " ", "a", "漢字 文本 質量", "BUY!!  NOW\t\n", "word " * 5000, "The model was trained well"]


def test_quality_scores_equal_the_plain_ones_in_any_batching():
    rng = np.random.default_rng(7)
    model = quality.Model(np.arange(3.0), rng.normal(size=quality.SIZE), np.array([-0.5, 0.7]))
    whole = model.tails(AWKWARD, quality.Features())
    for text, got in zip(AWKWARD, whole):
        at = sum(model.weights[n] * v for n, v in plain_features(text))
        assert np.allclose(got, 1 / (1 + np.exp(model.thresholds - at)))
    for order in (range(10), [9, 3, 0, 5, 1, 8, 7, 2, 6, 4]):
        for k in (1, 2, 7):
            numbers = list(order)
            parts = np.concatenate([model.tails([AWKWARD[i] for i in numbers[at : at + k]], quality.Features()) for at in range(0, 10, k)])
            assert (parts == whole[numbers]).all()
    assert (whole[0] == whole[9]).all() and (whole[0] != whole[1]).all()


def test_quality_reads_words(spark):
    made = [(i, ("good words in calm order " if i % 2 else "spam pills for cheap sale ") * (2 + i % 5), i % 2) for i in range(200)]
    assert len({quality.Features.shapes(t[:25]).tobytes() for _, t, _ in made}) <= 2
    docs = spark.createDataFrame([r[:2] for r in made], "doc_id long, text string")
    ratings = spark.createDataFrame([(i, q) for i, _, q in made if i < 150], "doc_id long, quality int")
    found = {r["doc_id"]: r["selected"] for r in quality.quality(docs, ratings).collect()}
    assert all(found[i] == bool(q) for i, _, q in made)


def test_pseudo_likelihood_sums_conditional_log_probabilities(spark, tables):
    docs = tables[0]
    held = lm_score.figures(lm_score.distinct_words(docs))
    net = lm_score.trained(docs, held)
    found = {r["doc_id"]: r for r in lm_score.scored(docs, held, net).collect()}
    assert len(found) == docs.count()
    assert found[900]["n_tokens"] == found[901]["n_tokens"] == 0 and found[900]["mean_log_likelihood"] is None and found[900]["log_likelihood"] == 0
    assert found[902]["n_tokens"] == 30000
    tokens = lm_score.Tokens(held, within=True)
    words = lm_score.words(CALM.format(7919))
    classes, within = tokens.of(words)
    line = lm_score.line_of([classes])
    for t in range(3):  # the network's probabilities over all classes add up to one
        total = 0.0
        for every in range(lm_score.VOCAB):
            other = line.copy()
            other[lm_score.WINDOW + t] = every
            total += np.exp(float(net.log_probabilities(other)[t]))
        assert abs(total - 1) < 1e-3
    first = next(i for i, t, *_ in rows(300) if t == CALM.format(i * 7919 % 1000))
    n, alone = lm_score.score([rows(300)[first][1], None, ""], net, tokens)
    assert n.tolist()[1:] == [0, 0] and alone[1:].tolist() == [0, 0]
    assert abs(alone[0] - found[first]["log_likelihood"]) < 1e-2
    # the sum over tokens of network and of figures, one by one
    own, (classes, within) = lm_score.words(rows(300)[first][1]), tokens.of(lm_score.words(rows(300)[first][1]))
    line = lm_score.line_of([classes])
    assert abs(net.log_probabilities(line).sum() + sum(held.within([w])[0] for w in own) - alone[0]) < 1e-2
    assert all((held.within([w])[0] == 0) == (w in held.head) for w in own)


def plain_network(net, line, t):
    """The log-probability of one token, without batches."""
    at = lm_score.WINDOW + t
    total = net.start.astype(float).copy()
    for scale, p in zip(net.scales, lm_score.PLACES):
        total += scale.astype(float) * net.vectors[line[at + p]]
    hidden = np.append(np.tanh(total), 1.0)
    group, inner = divmod(int(line[at]), lm_score.SIDE)
    out = 0.0
    for weights, target in ((net.coarse, group), (net.fine[group], inner)):
        logits = hidden @ weights.astype(float)
        out += logits[target] - np.log(np.exp(logits).sum())
    return out


def test_the_network_equals_the_plain_one_and_its_slopes_are_right():
    rng = np.random.default_rng(5)
    net = lm_score.Network.fresh()
    net.coarse += rng.normal(0, 0.3, net.coarse.shape).astype(np.float32)
    net.fine += rng.normal(0, 0.3, net.fine.shape).astype(np.float32)
    line = lm_score.line_of([rng.integers(0, lm_score.VOCAB, 9), rng.integers(0, lm_score.VOCAB, 5)])
    got = net.log_probabilities(line)
    places = [t for t in range(len(line) - 2 * lm_score.WINDOW) if line[lm_score.WINDOW + t] != lm_score.VOCAB]
    assert np.allclose(got, [plain_network(net, line, t) for t in places], atol=1e-4)
    for part in range(5):  # one step of the sums' square roots is the slope: compare with differences
        before, sums = lm_score.Network.of(net.flat()), lm_score._empty_sums()
        lm_score.Network.of(net.flat()).learn(line, sums)
        slopes = np.sqrt(sums.parts()[part].ravel())
        for k in np.argsort(-slopes)[:3]:
            changed = []
            for step in (1e-2, -1e-2):
                other = lm_score.Network.of(before.flat())
                other.parts()[part].ravel()[k] += step
                changed.append(other.log_probabilities(line).astype(np.float64).mean())
            assert abs(abs(changed[0] - changed[1]) / 2e-2 - slopes[k]) < 0.05 * slopes[k] + 1e-4


def test_spelling_is_a_distribution():
    tokens = ["banana", "bandana", "an", "é", "漢字"] * 3
    tables = [np.zeros(257 * size) for size in lm_score.ORDERS]
    cells, _ = lm_score._cells(tokens)
    for table, cell in zip(tables, cells):
        np.add.at(table, cell, 1)
    model = lm_score.Spelling(tables)
    together = model.log(tokens)
    assert np.allclose(together, [model.log([w])[0] for w in tokens])
    assert model.log(["banana"])[0] > model.log(["nabana"])[0] > model.log(["qzxwvk"])[0]
    for chance, size in zip(model.chances, lm_score.ORDERS):
        assert np.allclose(chance.reshape(size, 257).sum(1), 1, atol=1e-3)


def test_counts_of_the_corpus_tell_strings_apart(spark):
    rng = np.random.default_rng(3)
    made = lambda: "".join(rng.choice(list("abcdefgh"), 7))
    common = [f"w{k}" for k in range(lm_score.HEAD)]
    twice, once = [made() for _ in range(40)], [made() for _ in range(40)]
    texts = [" ".join(common)] * 3 + [" ".join(twice)] * 2 + [" ".join(once)]
    held = lm_score.figures(lm_score.distinct_words(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).ready()
    assert set(held.head) == set(common)
    assert held.within(twice).mean() > held.within(once).mean() + 0.3


def language(rng, n):
    """Documents of two languages, whose words come in runs and whose sentences begin with capitals."""
    out = []
    for _ in range(n):
        low, text = (0, 40) if rng.random() < 0.5 else (40, 80), []
        while len(text) < 60:
            sentence = [f"v{int(low[0] + 40 * rng.random() ** 2)}" for _ in range(int(rng.integers(4, 9)))]
            text += [sentence[0].upper(), *sentence[1:-1], sentence[-1] + "."]
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("tasks", [1, 8, 32])
def test_the_model_uses_context_however_many_tasks_train_it(spark, tasks):
    rng = np.random.default_rng(9)
    train, held_out = language(rng, 600), language(rng, 60)
    docs = spark.createDataFrame(list(enumerate(train)), "doc_id long, text string").repartition(tasks)
    held = lm_score.figures(lm_score.distinct_words(docs))
    net = lm_score.trained(docs, held)
    tokens = lm_score.Tokens(held, within=True)
    mean = lambda texts: np.divide(*[x.sum() for x in lm_score.score(texts, net, tokens)[::-1]])
    counts = {}
    for w in (w for t in train for w in t.split()):
        counts[w] = counts.get(w, 0) + 1
    total = sum(counts.values())
    unigram = np.mean([np.log(counts.get(w, 0.5) / total) for t in held_out for w in t.split()])
    shuffled = [" ".join(rng.permutation(t.split())) for t in held_out]
    assert mean(held_out) > unigram + 0.5 and mean(held_out) > mean(shuffled) + 0.2


def test_training_repeats_and_empty_tables(spark, tables):
    docs = tables[0].filter("doc_id < 300")
    held = lm_score.figures(lm_score.distinct_words(docs))
    a, b = (lm_score.trained(docs, held) for _ in range(2))
    assert (a.flat() == b.flat()).all()
    assert lm_score.pseudo_likelihood(docs.filter("false")).count() == 0
