import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F

from pallium.llm import chat_tools, warc
from pallium.llm.common import scratch_path

LONG = "<p>" + "text " * 40 + "\r\n\r\nWARC/1.1\r\n</p>"


def test_pages_round_trip(spark):
    rows = [(1, "http://a", LONG), (2, "http://b", LONG), (2, "http://b", LONG), (0, "http://c\r\nX: y", "short"), (3, None, "short"), (4, "http://d", None), (5, "http://e", ""), (None, "http://f", LONG), (6, "http://g", "é" * 100)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, record_type int")
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.page_captures(pages).collect()]
    want = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        again = html == LONG and page_id != 1
        want.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 1 if again else None))
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_captures_nest_what_belongs_together(spark):
    pages = spark.createDataFrame([(7, "http://a/x", LONG)], "page_id long, url string, html string")
    row = warc.captures(warc.archive(pages)).first()
    assert len(row["requests"]) == len(row["metadata"]) == 1
    assert row["block"].endswith(LONG.encode()) and row["target_uri"] == "http://a/x"
    assert b"GET http://a/x" in row["requests"][0]["block"] and row["metadata"][0]["block"] == b"page-id: 7\r\n"


def test_records_without_a_capture(spark):
    rows = [("r1", "response", None), ("q1", "request", "r1"), ("m1", "metadata", "r1"), ("m2", "metadata", "r1"), ("q2", "request", "gone"), ("m3", "metadata", None), ("r2", "response", None)]
    records = spark.createDataFrame([(a, b, "", c, None, None, None, b"") for a, b, c in rows], warc.RECORD)
    found = {r["record_id"]: ([x["record_id"] for x in r["requests"]], [x["record_id"] for x in r["metadata"]]) for r in warc.captures(records).collect()}
    assert found == {"r1": (["q1"], ["m1", "m2"]), "r2": ([], [])}
    assert {r["record_id"] for r in warc.unlinked(records).collect()} == {"q2", "m3"}


def test_parser_reads_gzip_members_and_refuses_cut_archives():
    record = b"WARC/1.1\r\nWARC-Type: metadata\r\nWARC-Record-ID: <a>\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    plain = list(warc.parse(record * 2))
    assert len(plain) == 2 and plain[0][:2] == ("<a>", "metadata") and plain[0][-1] == b"abcd"
    assert list(warc.parse(gzip.compress(record) + gzip.compress(record))) == plain
    assert list(warc.parse(b"")) == []
    try:
        list(warc.parse(record[:-7]))
    except ValueError:
        return
    raise AssertionError("a cut archive passed")


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_archives_and_empty_tables(spark, compression, monkeypatch):
    pages = spark.createDataFrame([(1, "u", LONG), (2, "u", LONG)], "page_id long, url string, html string")
    path = scratch_path(spark, "test")
    monkeypatch.setattr(warc, "BROADCAST_HEADS", 0)
    warc.write(warc.transactions(pages), path, compression)
    assert sorted(r["record_type"] for r in warc.read(spark, path).collect()) == ["metadata", "metadata", "request", "request", "response", "revisit"]
    pages = pages.filter("page_id = 1")
    assert warc.page_captures(pages.filter("page_id > 1")).count() == 0


def test_archives_are_checked_and_read_bit_by_bit(monkeypatch):
    body = b"<p>payload</p>"
    block = b"HTTP/1.1 200 OK\r\n\r\n" + body
    head = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <a>\r\nWARC-Payload-Digest: sha256:{}\r\nContent-Type: application/http\r\nContent-Length: {}\r\n\r\n"
    record = head.format(hashlib.sha256(body).hexdigest(), len(block)).encode() + block + b"\r\n\r\n"
    whole = list(warc.parse(record * 3))
    for size in (1, 7, 50):
        monkeypatch.setattr(warc, "STREAM_BYTES", size)
        assert list(warc.parse(record * 3)) == whole == list(warc.parse(gzip.compress(record * 2) + gzip.compress(record)))
    for bad in (record.replace(b"payload</p>", b"pay1oad</p>"), gzip.compress(record)[:-12]):
        with pytest.raises(ValueError):
            list(warc.parse(bad))


def test_size_classes_bound_files(spark, monkeypatch):
    monkeypatch.setattr(warc, "CLASSES", (200, 1000))
    monkeypatch.setattr(warc, "FILE_BYTES", 1000)
    rows = [(i, "u", "x" * n) for i, n in enumerate([10] * 12 + [500] * 6 + [5000] * 3 + [0])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r["page_id"]: (r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.page_captures(pages).collect()}
    first = {500: 12, 5000: 18}
    assert found == {i: (len(h), "revisit" if first.get(len(h), i) != i else "response", first[len(h)] if first.get(len(h), i) != i else None) for i, _, h in rows}


SCHEMAS = {"add": {"a": ("BIGINT", True), "b": ("BIGINT", True), "note": ("STRING", False)}, "stop": {}}
CALLS = [
    (1, "c1", 1, "add", '{"b": 2, "a": 1}'),
    (1, "c2", 3, "add", '{"a":"$result:c1","b":1}'),
    (1, "c3", 5, "add", '{"a":1,"b":2,"note":"$result:c2"}'),
    (1, "c4", 6, "stop", None),
    (1, "c4", 6, "stop", None),
    (1, "c5", 7, "stop", '{"x":1}'),
    (1, "c6", 8, "none", "{}"),
    (1, "c7", 9, "add", "[1]"),
    (1, "c8", 9, "add", '{"a":1,"a":2,"b":1}'),
    (2, "x", 1, "add", '{"a":1,"b":1,"note":"$result:y"}'),
    (2, "y", 2, "add", '{"a":1,"b":1,"note":"$result:x"}'),
    (2, "z", 3, "add", '{"a":1,"b":1,"note":"$result:y"}'),
    (2, "w", 3, "add", '{"a":1,"b":1,"note":"$result:gone"}'),
    (None, "c1", 1, "add", '{"a":1,"b":1}'),
    (1, None, 1, "stop", "{}"),
]
RESULTS = [(1, "c1", 2, "3"), (1, "c1", 4, "late"), (1, "c2", 4, 'say "é"'), (1, "lost", 4, "?"), (2, "x", 9, None)]


def linked(spark):
    calls = spark.createDataFrame(CALLS, "conv_id long, call_id string, turn long, name string, arguments string").withColumn("status", F.lit(1))
    results = spark.createDataFrame(RESULTS, "conv_id long, call_id string, turn long, content string")
    return chat_tools.link(calls, results, SCHEMAS)


def test_links_order_and_validation(spark):
    rows = linked(spark).collect()
    assert len(rows) == len(CALLS) + 1
    by = {(r["conv_id"], r["call_id"]): r for r in rows}
    assert [by[1, c]["depth"] for c in ("c1", "c2", "c3", "c4")] == [0, 1, 2, 0]
    assert [by[2, c]["depth"] for c in "xyzw"] == [None, None, None, 0]
    assert by[1, "c1"]["status"] == "linked" and by[1, "c1"]["n_results"] == 2 and by[1, "c1"]["result_turn"] == 2
    assert by[1, "lost"]["status"] == "orphan" and by[1, "c3"]["status"] == "unanswered" and by[2, "x"]["status"] == "linked"
    assert by[1, "c1"]["valid"] and by[1, "c3"]["valid"] and by[1, "c4"]["valid"]
    assert by[1, "c2"]["errors"] == "a is STRING, not BIGINT"
    assert by[1, "c5"]["errors"] == "unknown x" and by[1, "c6"]["errors"] == "unknown tool"
    assert by[1, "c7"]["errors"] == "arguments are not a JSON object" and by[1, "c8"]["errors"] == "arguments repeat a key"
    assert by[2, "w"]["errors"] == "unknown result gone"
    assert by[None, "c1"]["status"] == "unanswered"


def test_canonical_json(spark):
    by = {(r["conv_id"], r["call_id"]): r["message"] for r in linked(spark).collect()}
    assert by[1, "c1"] == '{"arguments":{"a":1,"b":2},"id":"c1","name":"add","result":"3"}'
    assert by[1, "c2"] == '{"arguments":{"a":"$result:c1","b":1},"id":"c2","name":"add","result":"say \\"é\\""}'
    for text in filter(None, by.values()):
        assert text == json.dumps(json.loads(text), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


def test_turns_of_plain_chats(spark):
    turns = [(1, t, "assistant" if t % 2 else "user", f"text {t}") for t in range(10)] + [(2, 0, None, None), (3, 0, "system", "s"), (3, 1, "user", "u"), (3, 2, "assistant", "a")]
    calls, results = chat_tools.turns_as_calls(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    rows = chat_tools.link(calls, results, chat_tools.TURN_TOOLS).collect()
    depth = {r["turn"]: r["depth"] for r in rows if r["conv_id"] == 1}
    assert depth == {0: 0, 2: 1, 4: 2, 6: 3, 8: 4}
    assert {r["status"] for r in rows if r["conv_id"] == 1} == {"linked"} and all(r["valid"] for r in rows if r["conv_id"] == 1)
    assert sorted((r["call_id"], r["name"], r["status"]) for r in rows if r["conv_id"] == 3) == [("t0", "set_system", "unanswered"), ("t1", "reply", "linked")]


def test_no_messages(spark):
    calls, results = chat_tools.turns_as_calls(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert chat_tools.link(calls, results, chat_tools.TURN_TOOLS).count() == 0


def test_bad_arguments_stay_in_the_message(spark):
    calls = spark.createDataFrame([(1, "a", 1, "add", '{"a":1,"a":2}'), (1, "b", 2, "add", '{"a":'), (1, "c", 3, "add", '{"a":1.0,"b":2e0}'), (1, "d", 4, "add", '{"a":1.5,"b":2}')], "conv_id long, call_id string, turn long, name string, arguments string")
    rows = {r["call_id"]: r for r in chat_tools.link(calls, calls.selectExpr("conv_id", "call_id", "turn", "name as content").filter("false"), SCHEMAS).collect()}
    assert [rows[c]["errors"] for c in "abc"] == ["arguments repeat a key", "arguments are not JSON", ""]
    assert rows["d"]["errors"] == "a is DECIMAL, not BIGINT"
    assert json.loads(rows["a"]["message"])["arguments"] == '{"a":1,"a":2}' and json.loads(rows["b"]["message"])["arguments"] == '{"a":'
    assert json.loads(rows["c"]["message"])["arguments"] == {"a": 1, "b": 2}


def test_nested_schemas(spark):
    schemas = {"book": {"who": ({"name": ("STRING", True), "age": ("BIGINT", False)}, True), "days": (["BIGINT"], True), "room": (frozenset(["sea", "park"]), False), "price": ("DOUBLE", False)}}
    good = {"who": {"name": "a", "age": 3}, "days": [1, 2.0], "room": "sea", "price": 1}
    cases = [
        (good, ""),
        (good | {"who": {"age": "x", "more": 1}}, "missing who.name; who.age is STRING, not BIGINT; unknown who.more"),
        (good | {"who": []}, "who is ARRAY, not OBJECT"),
        (good | {"days": [1, "x", 2.5]}, "days[] is STRING, not BIGINT; days[] is DECIMAL, not BIGINT"),
        (good | {"days": 3}, "days is BIGINT, not ARRAY"),
        (good | {"room": "cellar"}, 'room is "cellar", not one of "park", "sea"'),
        (good | {"price": "1"}, "price is STRING, not DOUBLE"),
        (good | {"days": []}, ""),
    ]
    rows = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)], "i int, arguments string")
    found = rows.select("i", F.array_join(chat_tools.argument_errors(F.lit("book"), F.col("arguments"), schemas), "; ").alias("e")).collect()
    assert sorted(((r["i"]), sorted(r["e"].split("; "))) for r in found) == [(i, sorted(e.split("; "))) for i, (_, e) in enumerate(cases)]


def test_references_anywhere(spark):
    texts = ['{"a":{"b":["$result:x","no"]},"$result:key":1,"c":"$result:y \\"z\\""}', '{"a":"say \\",\\"$result:q\\",\\""}', "[1", None]
    rows = spark.createDataFrame([(t,) for t in texts], "a string").select(F.array_sort(chat_tools.references(F.col("a"))).alias("r")).collect()
    assert [r["r"] for r in rows] == [["x", 'y "z"'], [], [], []]


def plain_depths(refs):
    known, out = set(refs), {}
    for _ in range(len(refs) + 1):
        for node, to in refs.items():
            mine = [t for t in to if t in known]
            if node not in out and all(t in out for t in mine):
                out[node] = 1 + max((out[t] for t in mine), default=-1)
    return {node: out.get(node) for node in refs}


def test_depths_of_long_chains_junctions_and_cycles(spark):
    import random

    rng = random.Random(3)
    graphs = {1: {f"c{i}": [f"c{i - 1}"] if i else [] for i in range(300)}}
    graphs[2] = {f"n{i}": rng.sample([f"n{j}" for j in range(i)], min(i, rng.choice([0, 1, 1, 1, 2, 3]))) for i in range(60)}
    graphs[3] = {"a": ["b"], "b": ["a"], "c": ["b"], "d": ["c", "e"], "e": [], "f": ["f"], "g": ["e", "gone"], "h": ["g", "d"], "i": ["gone"], "j": ["g", "e"], "k": ["j"], "l": ["k", "g"]}
    rows = [(conv, node, refs) for conv, graph in graphs.items() for node, refs in graph.items()]
    found = chat_tools.depths(spark.createDataFrame(rows, "conv_id long, call_id string, refs array<string>")).collect()
    assert len(found) == len(rows)
    got = {(r["conv_id"], r["call_id"]): r["depth"] for r in found}
    assert got == {(conv, node): depth for conv, graph in graphs.items() for node, depth in plain_depths(graph).items()}
