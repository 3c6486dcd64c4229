import random

import numpy as np
import pytest

from pallium.llm import decontam, topk

WORDS = ("alder brook candle dune ember fjord glade harbor inlet jetty kelp lagoon meadow nettle orchard pebble quarry ridge "
         "shoal thicket upland valley willow yarrow zephyr basin cedar delta estuary fern").split()  # fmt: skip


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS)[:3] for _ in range(n))


def plain_distance(pattern, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return min(row)


def test_edit_distance_equals_the_plain_one():
    rng = random.Random(2)
    for _ in range(60):
        p, t = ("".join(rng.choices("ab c", k=k)) for k in (rng.randint(1, 70), rng.randint(0, 90)))
        assert decontam.edit_distance_within(p, t)[0] == plain_distance(p, t)


def edited(rng, text, rate):
    out = []
    for w in text.split():
        r = rng.random()
        out += [] if r < rate / 3 else [rng.choice(WORDS)] if r < 2 * rate / 3 else [w, rng.choice(WORDS)] if r < rate else [w]
    return " ".join(out)


def test_recall_against_brute_force():
    rng = random.Random(3)
    items = [(i, prose(rng, rng.randint(15, 50))) for i in range(60)]
    index = decontam.Index(items)
    found = total = 0
    for rate in (0.0, 0.05, 0.1, 0.2):
        for i, text in items:
            doc = f"{prose(rng, 40)} {edited(rng, text, rate)} {prose(rng, 40)}"
            if plain_distance(index.texts[i], doc) <= 0.2 * len(index.texts[i]):
                total += 1
                found += any(k == i for _, k, *_ in decontam.matches(index, [doc], 0.8))
    assert total > 150 and found >= 0.95 * total


def test_contaminated_documents_of_awkward_rows(spark):
    rng = random.Random(4)
    item, other = prose(rng, 30), prose(rng, 20)
    items = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "tiny item"), (5, item), (6, other)], "item_id long, text string")
    rows = [
        (1, f"{prose(rng, 50)} {item.upper()}!! {prose(rng, 9000)}", 0),
        (2, prose(rng, 100), 0),
        (3, None, 0),
        (4, "", 0),
        (5, "a Tiny, item here", 0),
        (6, f"{item} {other}", 0),
        (6, f"{item} {other}", 0),
        (None, item, 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    found = decontam.contaminated(docs, items)
    got = sorted((r[0] or 0, r[1], r["distance"]) for r in found.collect())
    assert got == [(0, 1, 0), (0, 5, 0), (1, 1, 0), (1, 5, 0), (5, 4, 0), (6, 1, 0), (6, 1, 0), (6, 5, 0), (6, 5, 0), (6, 6, 0), (6, 6, 0)]
    kept = decontam.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4]


def test_passes_give_the_same(spark, monkeypatch):
    rng = random.Random(5)
    items = spark.createDataFrame([(i, prose(rng, 20)) for i in range(9)], "item_id long, text string")
    docs = items.selectExpr("item_id as doc_id", "concat('start ', text, ' end') as text")
    whole = sorted(map(tuple, decontam.contaminated(docs, items).collect()))
    monkeypatch.setattr(decontam, "ITEMS_A_PASS", 4)
    assert sorted(map(tuple, decontam.contaminated(docs, items).collect())) == whole and len(whole) == 9


def test_empty_tables_have_no_matches(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(none, items).count() == 0
    assert decontam.clean(none, items).count() == 0
    assert topk.top_k(*[spark.createDataFrame([], "vec_id long, embedding array<float>")] * 2).count() == 0


def brute(rows, asked, k):
    good = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.append((i, [int(np.floor(1024 * float(x))) for x in v]))
    out = []
    for at, (q, v) in enumerate(good):
        if q in asked:
            scores = [(-sum(a * b for a, b in zip(v, c)), i) for other, (i, c) in enumerate(good) if other != at and len(c) == len(v)]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.mark.parametrize("shard, block", [(40, 4), (100_000, 100_000)])
def test_top_k_equals_brute_force(spark, monkeypatch, shard, block):
    monkeypatch.setattr(topk, "SHARD_ROWS", shard)
    monkeypatch.setattr(topk, "BLOCK_QUERIES", block)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist()) for i in range(180)]
    rows += [(200 + i, rows[5][1]) for i in range(30)]  # one common vector
    rows += [(300, [1.0, 2.0]), (301, [0.5, 1.0]), (302, None), (303, [1.0, None, 2.0, 3.0]), (304, [float("nan"), 1.0, 1.0, 1.0]), (305, [float("inf"), 0.0, 0.0, 0.0]), (None, rows[3][1]), (7, rows[7][1]), (306, [])]
    rows += [(40, rows[40][1]), (40, rows[41][1]), (60, rows[60][1]), (60, rows[60][1])]  # repeated queries, and one id with two vectors
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = sorted(map(tuple, topk.top_k(df, df.filter("vec_id % 20 = 0"), k=6).collect()))
    assert got == brute(rows, range(0, 400, 20), 6)


def test_scores_beyond_doubles_are_exact_in_all_shards(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_ROWS", 50)
    rng = np.random.default_rng(8)
    base = float(1 << 18)
    # scores near 2 ** 58 that differ by less than a double's step there, with ties
    rows = [(i, [base, float(rng.integers(0, 3)) / 1024, float(rng.integers(0, 9)) / 1024]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = sorted(map(tuple, topk.top_k(df, df.filter("vec_id % 100 = 0"), k=10).collect()))
    want = brute(rows, range(0, 400, 100), 10)
    assert got == want and min(r[3] for r in want) > 1 << 55


def test_candidates_are_never_copied_by_block(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_QUERIES", 5)
    df = spark.range(60).selectExpr("id as vec_id", "array(cast(id as float), 1f) as embedding")
    plan = topk.top_k(df, df.filter("vec_id % 3 = 0"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "explode" not in plan.lower()
