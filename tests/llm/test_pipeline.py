import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from pallium.llm import simhash
from pallium.llm.queries import BYTE_MODEL

WORDS = "alder brook candle dune ember fjord glade harbor inlet jetty kelp lagoon meadow nettle orchard pebble quarry ridge shoal thicket".split()


def prose(rng, n=60):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS)[:3] for _ in range(n)) + "."


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, at = random.Random(1), tmp_path_factory.mktemp("sf")
    docs, labels, kind = [], [], {}
    item = prose(rng, 30)
    for i in range(260):
        kind[i] = "junk" if i % 5 == 1 else "toxic" if i % 5 == 2 else "good"
        text = prose(rng)
        if kind[i] == "junk":
            text = " ".join(w.upper() + "!!" for w in text.split())
        if kind[i] == "toxic":
            text = text.replace(" ", " you scumbag ", 3)
        docs.append((i, text))
        labels.append((i, int(kind[i] != "junk"), int(kind[i] == "toxic")))
    docs += [(1000, docs[0][1]), (1001, docs[0][1].upper().lower()), (1002, f"{prose(rng)} {item} {prose(rng)}"), (1003, prose(rng, 6000)), (1004, docs[3][1])]
    rows = [(i, t, "en", "s", len(t), 0.5) for i, t in docs] + [(1004, docs[3][1], None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), dict(docs), kind


def test_run_gives_what_the_stages_should_keep(spark, tables):
    path, docs, kind = tables
    expect = {i for i in docs if kind.get(i) == "good"} | {1003}  # not copies, nor the benchmark's passage
    rows = corpus_pipeline.run(spark, path).collect()
    assert {r["doc_id"] for r in rows} == expect
    model = Tokenizer.from_file(BYTE_MODEL)
    for i in expect:
        ids, at = model.encode(docs[i], add_special_tokens=False).ids + [0], 0
        for r in sorted((r for r in rows if r["doc_id"] == i), key=lambda r: r["piece"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(ids)


def test_stages_keep_the_columns(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, tables[0])
        assert kept.schema.names == docs.schema.names and kept.count() <= docs.count()


def test_stages_take_null_and_empty_tables(spark, tables):
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None, None), (5, None, None, None, None, None), (6, "", None, None, None, None)], docs.schema)
    for rows in (odd, docs.filter("false")):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, rows, tables[0]).count() <= 3


def test_near_copies_leave_one(spark):
    rng = random.Random(2)
    text = prose(rng, 400)
    near = text.replace(text.split()[200], "changed", 1)
    assert (simhash.fingerprint(text) ^ simhash.fingerprint(near)).bit_count() <= 3
    docs = spark.createDataFrame([(7, text), (3, near), (9, prose(rng))], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == [3, 9]
