import random

import pytest
from pyspark.sql import functions as F

from pallium.functions import geometry
from pallium.operators import boxes, elements, evaluate, ner
from pallium.plans import actions
from pallium.sources import html, tables
from pallium.streaming import sessions


def test_windows_cover_the_text_and_go_on():
    rng = random.Random(1)
    for n in (0, 10, 1200, 1201, 5000):
        text = "".join(rng.choice("abc   ") for _ in range(n))
        found = list(ner.windows(text))
        assert all(text[o : o + len(w)] == w and len(w) <= 1200 for o, w in found)
        assert {i for o, w in found for i in range(o, o + len(w))} == set(range(n))
    assert list(ner.windows("x" * 3000))[1][0] == 1200 - 160


def test_packs_keep_every_text():
    items = [("a", "x" * 500), ("b", "y" * 600), ("c", ""), ("d", "z" * 300), ("e", "w" * 3000), ("f", "end")]
    packs = list(ner.packs_of(items))
    for text, members in packs:
        for key, start, source, length in members:
            assert text[start : start + length] == dict(items)[key][source : source + length]
    assert [[m[0] for m in ms] for _, ms in packs][:2] == [["a", "b"], ["d"]] and packs[-1][0] == "end"


def test_entity_groups(spark):
    texts = spark.createDataFrame([(1, "Ann Lee met Bob in <NAME_1> town Cy"), (2, "Zed")], "text_id int, text string")
    rows = [
        (1, 0, "B-PER", 0.99, 0, 3), (1, 1, "I-PER", 0.95, 4, 7), (1, 2, "O", 0.9, 8, 11), (1, 3, "I-PER", 0.93, 12, 15), (1, 4, "B-LOC", 0.99, 16, 18),
        (1, 5, "B-PER", 0.99, 19, 27), (1, 6, "B-PER", 0.5, 33, 35), (2, 0, "B-PER", 0.99, None, None),
    ]
    tokens = spark.createDataFrame(rows, "text_id int, idx int, tag string, score double, start int, end int")
    got = sorted((r["start"], r["length"], r["score"], r["text"]) for r in ner.entity_groups(tokens, texts).collect())
    assert got == [(0, 7, 0.95, "Ann Lee"), (12, 3, 0.93, "Bob")]


def test_entities_of_packs_return_to_their_text(spark):
    packs = spark.createDataFrame([(1, [("a", 0, 0, 5), ("b", 7, 100, 5)])], "pack int, members array<struct<key:string,start:int,source_start:int,length:int>>")
    entities = spark.createDataFrame([(1, 8, 3), (1, 4, 4)], "pack int, start int, length int")
    assert [(r["key"], r["start"]) for r in ner.unpacked(entities, packs, ["pack"]).collect()] == [("b", 101)]


PAGE = """<!doctype html><html><head><title>T</title><script>var t="</p><input>";</script></head><body>
<h2>Sign up</h2><form><label for=m>E-mail</label><input id=m type=email value="x@y.example"><div>Phone</div><div><input id=p></div>
<label>Full name <input id=n></label><p>short<p>A paragraph that is long enough to be kept, with 4111 1111 1111 1111 in it
<ul><li>one<li>two<ul><li>deep</ul></ul><div style="display:none"><button>gone</button></div><img src=x width=1 height=1><span>call a@b.example</span>
<a href="/l">link</a><div role=heading aria-level=3>Part</div><button id=b>Send</button><details><summary>More</summary><p>hidden paragraph, closed away from view</details></body></html>"""


@pytest.fixture(scope="module")
def nodes(spark):
    return html.nodes(spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>x")], "page_id long, html string")).cache()


def test_html_tree(nodes):
    rows = {r["node_id"]: r for r in nodes.filter("page_id = 1").collect()}
    by_tag = lambda t: [r for r in rows.values() if r["tag"] == t]
    assert [r["direct_text"] for r in by_tag("li")] == ["one", "two", "deep"]
    one, two, deep = by_tag("li")
    assert one["parent_id"] == two["parent_id"] and one["depth"] + 2 == deep["depth"] and deep["ancestor_tags"][:2] == ["ul", "li"]
    assert [r["text"] for r in by_tag("p")][:1] == ["short"] and len(by_tag("input")) == 3
    assert by_tag("button")[0]["hidden"] and not by_tag("button")[1]["hidden"] and by_tag("p")[-1]["hidden"]
    assert nodes.filter("page_id = 2").count() == 0 and nodes.filter("page_id = 3").count() == 1


def test_admitted_elements(nodes):
    found = elements.admitted(nodes.filter("page_id = 1"))
    rows = found.orderBy("pos").collect()
    by_id = {r["attrs"].get("id"): r for r in rows if r["attrs"].get("id")}
    assert by_id["m"]["name"] == "E-mail" and by_id["p"]["name"] == "Phone" and by_id["n"]["name"].startswith("Full name") and by_id["b"]["kind"] == "button"
    assert by_id["p"]["categories"] == ["phone"] and set(by_id["m"]["categories"]) == {"email"} and by_id["n"]["categories"] == ["person_name"]
    kinds = [(r["kind"], r["tag"]) for r in rows]
    assert ("image", "img") not in kinds and ("link", "a") in kinds and ("heading", "div") in kinds
    assert [r["heading_level"] for r in rows if r["kind"] == "heading"] == [2, 3]
    assert [r["tag"] for r in rows if r["admitted_by"] == "value"] == ["span"] and rows[-1]["tag"] == "span"
    assert [r["tag"] for r in rows].count("p") == 1
    counts = elements.snapshot_counts(nodes, found).filter("page_id = 1").first()
    assert counts["checksum_verified"] == 1 and counts["value_only"] == 1 and counts["found"] > counts["visible"] > 0
    assert elements.snapshots(found).first()["elements"][0]["pos"] == 1
    assert ("1", "m", "email", "field-purpose") in {(str(r[0]), r[1], r[2], r[3]) for r in elements.signals(found).collect()}
    assert elements.links(nodes).count() == 1 and elements.headings(nodes).count() == 2


def test_label_and_page_files(spark, tmp_path):
    (tmp_path / "a.html").write_text("<p>\nx</p>")
    (tmp_path / "b.html").write_text("<p>y</p>")
    (tmp_path / "a.json").write_text('{"note": "n",\n "expect": {"m": ["email/value/structure", "email/field-purpose"]}}')
    pages, files = tables.page_files(spark, str(tmp_path)), tables.label_files(spark, str(tmp_path))
    truth = evaluate.labels(files)
    assert sorted(map(tuple, truth.collect())) == [("a", "m", "email", "field-purpose", None), ("a", "m", "email", "value", "structure")]
    assert [r["page"] for r in evaluate.unlabelled(pages, truth).collect()] == ["b"]
    assert tables.page_files(spark, str(tmp_path), "a").first()["html"] == "<p>\nx</p>" and files.first()["mode"] == "visible"


def test_metrics_and_gate(spark, tmp_path):
    schema = "page string, element string, category string, via string, confidence string"
    predicted = spark.createDataFrame([("p", "a", "email", "value", "structure"), ("p", "a", "email", "value", "structure"), ("p", "b", "pan", "value", "structure"), ("p", "c", "email", "value", "shape")], schema)
    truth = spark.createDataFrame([("p", "a", "email", "value", "checksum"), ("p", "d", "phone", "value", None), ("p", "c", "email", "value", None)], schema)
    outcomes = evaluate.scored(predicted, truth)
    rows = {r["category"]: r for r in evaluate.by_category_and_overall(outcomes).collect()}
    assert (rows["overall"]["tp"], rows["overall"]["fp"], rows["overall"]["fn"], rows["overall"]["precision"]) == (2, 1, 1, 0.6667)
    assert rows["phone"]["precision"] == 1.0 and rows["phone"]["f1"] == 0.0 and rows["pan"]["recall"] == 1.0
    assert evaluate.confidence_warnings(outcomes).count() == 1
    shown = {r["category"]: r["precision_shown"] for r in evaluate.report(evaluate.metrics(outcomes, "category")).collect()}
    assert shown == {"phone": "n/a", "pan": "0.0", "email": "100.0"}
    metric_rows = evaluate.by_category_and_overall(outcomes)
    tables.write_baseline(metric_rows, str(tmp_path / "base"))
    stored = tables.baseline(spark, str(tmp_path / "base"))
    assert {r["status"] for r in evaluate.gate(metric_rows, stored).collect()} == {"same"}
    worse = metric_rows.withColumn("fp", F.col("fp") + 1)
    assert {r["status"] for r in evaluate.gate(worse, stored).collect()} == {"worse"}
    assert evaluate.last_of_key(predicted.withColumn("seq", F.monotonically_increasing_id()), "seq").count() == 3


def test_box_arithmetic(spark):
    one = spark.range(1)
    box = lambda *v: geometry.box(*map(F.lit, v))
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert tuple(get(geometry.clamp(box(-5.5, 2.2, 10, 10), F.lit(100), F.lit(8)))) == (0, 2, 5, 6)
    assert get(geometry.clamp(box(200, 0, 5, 5), F.lit(100), F.lit(100))) is None
    assert tuple(get(geometry.pad(box(50, 50, 10, 10), F.lit("email"), F.lit(100), F.lit(100)))) == (45, 45, 20, 20)
    assert tuple(get(geometry.to_image(box(10, 20, 30, 40), F.lit(200), F.lit(100), F.lit(100), F.lit(100), F.lit(5), F.lit(0)))) == (10, 20, 60, 40)
    assert abs(get(geometry.iou(box(0, 0, 2, 2), box(1, 0, 2, 2))) - 1 / 3) < 1e-12
    assert get(geometry.touches(box(0, 0, 2, 2), box(2, 0, 2, 2))) and not get(geometry.touches(box(0, 0, 2, 2), box(2.1, 0, 2, 2)))
    assert get(geometry.tile_starts(F.lit(2000), 1280)) == [0, 720] and get(geometry.tile_starts(F.lit(1000), 1280)) == [0]
    assert get(geometry.plausible_face(box(0, 0, 20, 25), F.lit(0.6), F.lit(100), F.lit(100))) and not get(geometry.plausible_face(box(0, 0, 20, 25), F.lit(0.5), F.lit(100), F.lit(100)))


def test_detections(spark):
    b = lambda x, y, w, h: (float(x), float(y), float(w), float(h))
    rows = [(1, 0, "face", "vision", "black", 0.9, b(0, 0, 10, 10)), (1, 1, "face", "vision", None, 0.8, b(1, 1, 10, 10)), (1, 2, "face", "vision", "black", 0.7, b(10, 10, 10, 10)), (1, 3, "face", "dom", "blur", 1.5, b(50, 50, 5, 5))]
    found = spark.createDataFrame(rows, f"image_id int, seq int, category string, source string, policy string, confidence double, box {geometry.BOX}")
    assert sorted(r["seq"] for r in boxes.non_maximum_suppression(found).collect()) == [0, 2, 3]
    merged = sorted((r["n"], tuple(r["box"])) for r in boxes.merged(found).collect())
    assert merged == [(1, (50, 50, 5, 5)), (3, (0, 0, 20, 20))]
    m = boxes.manifest(found).first()
    assert m["detections"] == 4 and m["black_regions"] == 2 and m["policies"] == {"black": 2, "blur": 1, "unknown": 1}
    images = spark.createDataFrame([(1, 100, 100)], "image_id int, width int, height int")
    kept = boxes.normalised(found, images).collect()
    assert len(kept) == 4 and max(r["confidence"] for r in kept) == 1.0
    assert boxes.texts_in_regions(found, found.filter("seq = 0")).count() == 2


def test_detector_outputs(spark):
    cells = spark.createDataFrame([(1, 32, 21, 1.2, 0.81, [0.5, 0.25, 0.0, 0.0]), (1, 32, 0, 0.1, 0.1, [0.0] * 4)], "image_id int, stride int, idx int, cls double, obj double, bbox array<double>")
    r = boxes.decoded_faces(cells).collect()
    assert len(r) == 1 and abs(r[0]["confidence"] - 0.9) < 1e-9 and tuple(r[0]["box"]) == (1.5 * 32 - 16, 1.25 * 32 - 16, 32, 32)
    assert boxes.plausible_faces(boxes.decoded_faces(cells), spark.createDataFrame([(1, 640, 640)], "image_id int, width int, height int")).count() == 1
    corners = spark.createDataFrame([(1.4, 2.0, 5.6, 1.0, None, None, None, None), (None, None, None, None, 1.0, 2.0, 3.0, 4.0)], "xmin double, ymin double, xmax double, ymax double, x double, y double, width double, height double")
    assert [tuple(r["box"]) for r in boxes.corner_boxes(corners).collect()] == [(1, 2, 4, 0), (1, 2, 3, 4)]
    line = "struct<text:string,confidence:double,bbox:struct<x0:int,y0:int,x1:int,y1:int>>"
    pages = spark.createDataFrame([(1, [([([(" hi ", 90.0, (1, 2, 4, 6)), (" ", 9.0, (0, 0, 1, 1))],)],)]), (2, None)], f"image_id int, blocks array<struct<paragraphs:array<struct<lines:array<{line}>>>>>")
    assert [(r["image_id"], r["text"], r["confidence"], tuple(r["box"])) for r in boxes.ocr_items(pages).collect()] == [(1, "hi", 0.9, (1, 2, 3, 4))]


def test_disabled_elements(spark):
    page = spark.createDataFrame([(1, "<fieldset disabled><input id=a></fieldset><input id=b aria-disabled=true><input id=c>")], "page_id long, html string")
    got = {r["attrs"]["id"]: r["disabled"] for r in elements.disabled(html.nodes(page)).filter("tag = 'input'").collect()}
    assert got == {"a": True, "b": True, "c": False}


def test_plans(spark):
    many = '{"actions":[' + ",".join(['{"type":"click","elementId":"element_1"}'] * 20) + '],"done":true}'
    raw = [
        ("a", 1, '{"actions":[{"type":"fill","elementId":"#User","text":"bob"}]}', "I am Bob"), ("a", 2, '{"actions":[{"type":"fill","elementId":2,"text":"bob"}]}', "bob"),
        ("a", 3, '{"actions":[{"type":"fill","elementId":1,"text":"eve"},{"type":"fill","elementId":1,"text":" "}]}', "bob"), ("a", 4, many, ""), ("a", 5, '{"actions":{}}', ""), ("a", 6, "[1]", ""),
        ("a", 7, '{"actions":[{"type":"click","elementId":1,"evil":2}]}', ""), ("a", 8, '{"actions":[{"type":"fill","elementId":1,"text":"<PROFILE_EMAIL>"}]}', ""), ("a", 9, '{"actions":[{"type":"wait","ms":"x"}]}', ""), ("a", 10, None, ""),
    ]
    plans = actions.parsed(spark.createDataFrame(raw, "session_id string, turn int, raw string, goal string"))
    got = {r["turn"]: (r["error"], r["done"], len(r["actions"]) if r["actions"] is not None else None) for r in plans.collect()}
    assert got[4] == (None, False, 16) and got[5][0] == "no actions array" and got[6][0] == "not an object" and got[7][0] == "unexpected action fields: evil" and got[10][0] == "not JSON"
    assert got[3] == (None, False, 1)
    page = plans.select("session_id", "turn").crossJoin(spark.createDataFrame([("element_1", "user", "u", "User", "username"), ("element_2", "pw", "p", "Password", "password")], "element_id string, name string, html_id string, text string, category string"))
    rows = {(r["turn"], r["idx"]): r for r in actions.validated(actions.actions(plans), page, spark.createDataFrame([("a", "<PROFILE_EMAIL>")], "session_id string, token string")).collect()}
    assert rows[1, 0]["status"] == "keep" and rows[1, 0]["element_id"] == "element_1"
    assert rows[2, 0]["status"] == "error" and rows[3, 0]["status"] == "drop" and rows[8, 0]["status"] == "keep" and rows[9, 0]["status"] == "error"
    ok = {r["turn"]: r["ok"] for r in actions.plan_status(actions.validated(actions.actions(plans), page)).collect()}
    assert ok[1] and not ok[2] and not ok[8] and not ok[9]


def test_plan_rewrites(spark):
    rows = spark.createDataFrame([("a", 2, 0, "click", "Inbox", "e1"), ("a", 2, 1, "wait", None, None), ("a", 2, 2, "click", "Send", "e2")], "session_id string, turn int, idx int, type string, text string, element_id string")
    assert [r["batch"] for r in actions.batches(rows).orderBy("idx").collect()] == [0, 0, 1]
    history = spark.createDataFrame([("a", 1, "click", "inbox", True), ("a", 1, "click", "Send", False)], "session_id string, turn int, type string, text string, ok boolean")
    assert sorted(r["idx"] for r in actions.without_repeated_clicks(rows, history).collect()) == [1, 2]
    results = spark.createDataFrame([("a", 1, i, i != 1) for i in range(4)], "session_id string, turn int, idx int, ok boolean")
    assert sorted(r["idx"] for r in actions.up_to_first_failure(results).collect()) == [0, 1]


def test_elements_that_moved(spark):
    schema = "session_id string, turn int, pos int, element_id string, html_id string, name string, text string, role string, kind string, category string"
    old = spark.createDataFrame([("a", 1, 1, "element_1", "", "", "Inbox (3)", "", "link", None), ("a", 1, 2, "element_2", "", "", "Gone", "", "button", None), ("a", 1, 3, "element_3", "", "", "Settings page", "", "link", None)], schema)
    new = spark.createDataFrame([("a", 2, 1, "element_7", "", "", "Inbox (4)", "", "link", None), ("a", 2, 2, "element_8", "", "", "Inbox", "", "button", None), ("a", 2, 3, "element_9", "", "", "My settings", "", "link", None)], schema)
    got = {(r["old_id"]): (r["new_id"], r["score"]) for r in actions.similar_elements(old, new).collect()}
    assert got == {"element_1": ("element_7", 5)}
    rows = spark.createDataFrame([("a", 2, "", 0, "click", "element_1"), ("a", 2, "", 1, "click", "element_2"), ("a", 2, "", 2, "wait", None), ("a", 2, "", 3, "click", "element_8")], "session_id string, turn int, goal string, idx int, type string, element_ref string")
    out = {r["idx"]: (r["element_id"], r["dropped"]) for r in actions.stabilised(rows, new, old).collect()}
    assert out == {0: ("element_7", False), 1: (None, True), 2: (None, False), 3: ("element_8", False)}


CHAT = """<html><head><title>(2) Anna - Chat</title></head><body><div id=main><header><span title="Anna Smith">Anna Smith online</span><span>search</span></header></div>
<div role=row><span>10:30</span><span>Bob</span><span>a long preview of what was said</span></div><div role=listitem title="Carl. last">x</div>
<div tabindex=0><p>Account A <b>verified</b></p><div>Account A verified</div></div><label>unverified thing</label>
<select id=s>{}</select></body></html>""".format("".join(f"<option>o{i}" for i in range(33)))


def test_chats_choosers_and_options(spark):
    nodes = html.nodes(spark.createDataFrame([(1, CHAT)], "page_id long, html string")).cache()
    assert elements.open_conversations(nodes).first()["candidates"] == ["Anna Smith", "Anna"]
    assert [r["label"] for r in elements.conversation_labels(nodes).orderBy("node_id").collect()] == ["Bob", "Carl"]
    picked = elements.choosers(nodes).join(nodes, ["page_id", "node_id"]).orderBy("node_id").collect()
    assert [r["tag"] for r in picked] == ["div", "label"] and picked[0]["attrs"] == {"tabindex": "0"}
    options = elements.select_options(nodes).first()["options"]
    assert len(options) == 31 and options[0] == "o0" and options[-1] == "… 3 more options omitted"
    shown = spark.createDataFrame([(1, 2, "element_2", "", "secret"), (1, 1, "element_1", "a", "secret")], "page_id int, pos int, element_id string, text string, value string")
    assert elements.compact_context(shown).first()["context"] == '{"redacted":true,"elements":[{"element_id":"element_1","text":"a"},{"element_id":"element_2"}]}'


def test_stream_equals_replay(spark, tmp_path):
    rng = random.Random(3)
    rows, at = [], 1_700_000_000_000
    for i in range(400):
        at += rng.choice([1000, 5000, 20_000, 700_000 if rng.random() < 0.02 else 3000])
        rows.append((i, at, i % 9, rng.choice(["click", "view", "buy", "error"]) if i % 3 else "view"))
    events = spark.createDataFrame(rows, "event_id long, ms long, user_id long, event_type string").select("event_id", F.timestamp_millis("ms").alias("ts"), "user_id", "event_type")
    events.write.parquet(str(tmp_path / "in"))
    stream = sessions.stream(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    run = stream.writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    got = sorted((r["session_id"], r["turn"], r["repeat"], r["state"]) for r in spark.table("states").collect())
    want = sorted((r["session_id"], r["turn"], r["repeat"], r["state"]) for r in sessions.replay(sessions.turns_of_events(events)).collect())
    assert got == want and len({r[3] for r in want}) >= 4


def test_history_and_resume(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert get(sessions.last_n(F.array(F.lit(1), F.lit(2)), 12)) == [1, 2] and get(sessions.last_n(F.sequence(F.lit(1), F.lit(20)), 3)) == [18, 19, 20]
    call = lambda ms, gate, same, asked, manual: get(sessions.should_resume(F.lit(ms), F.lit(gate), F.lit(same), F.lit(asked), F.lit(manual)))
    assert call(1, True, True, True, False) == "resume" and call(700_000, True, True, False, False) == "give up" and call(1, False, True, False, False) == "resume" and call(1, True, True, False, True) == "wait"


def test_registry_imports_without_optional_parts():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert len(names) >= 55 and set(__spark_entry__.oracle_sql()) <= set(names)


def test_placeholders_survive_later_values(spark):
    from pyspark.sql import functions as F

    from pallium.operators import leaks, redact

    vault = [("<EMAIL_1>", "a@b.example"), ("<USERNAME_1>", "EMAIL"), ("<PHONE_1>", "98765 43210")]
    rows = spark.createDataFrame([("mail a@b.example as EMAIL, <EMAIL_1> or 987-654-3210, $1", vault)], "t string, v array<struct<placeholder:string,value:string>>")
    assert rows.select(leaks.redact_against(F.col("t"), F.col("v"))).first()[0] == "mail <EMAIL_1> as <USERNAME_1>, <EMAIL_1> or 987-654-3210, $1".replace("987-654-3210", "<PHONE_1>")


def test_expansion_reads_the_text_only_once_and_refuses(spark):
    from pyspark.sql import functions as F

    from pallium.operators import redact

    rows = spark.createDataFrame(
        [(1, "to <A_1> > end"), (2, "use <PASSWORD_1>"), (3, "<C_1>"), (4, "<HOME_1>"), (5, "see secret value"), (6, "plain > text")], "i int, t string"
    )
    vault, profile = (F.create_map(*map(F.lit, x)) for x in (["<A_1>", "<B_1>", "<B_1>", "secret value"], ["<WORK_1>", "desk"]))
    assert rows.filter("i = 1").select(redact.expand(F.lit("<A_1><B_1> > <Z_9>"), vault)).first()[0] == "<B_1>secret value > <Z_9>"
    found = rows.select("i", redact.expand_checked(F.col("t"), vault, profile, F.array(F.lit("<HOME_1>"), F.lit("<WORK_1>"))).alias("e")).collect()
    got = {r["i"]: (r["e"]["ok"], r["e"]["skip"], r["e"]["text"]) for r in found}
    assert got == {1: (True, False, "to <B_1> > end"), 2: (False, False, None), 3: (False, False, None), 4: (True, True, None), 5: (False, False, None), 6: (True, False, "plain > text")}
    errors = {r["i"]: r["e"]["error"] for r in found}
    assert errors[2].startswith("credential") and errors[3].startswith("unknown") and errors[4].startswith("no value") and "already" in errors[5]


def test_elements_of_a_page_are_moved_once(spark):
    pages = html.nodes(spark.createDataFrame([(1, PAGE), (2, CHAT)], "page_id long, html string"))
    for df in (elements.admitted(pages), elements.snapshots(elements.admitted(pages)), elements.counted(pages)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1 and plan.count("MapInArrow") == 1
    held = elements.snapshot_counts(pages, elements.admitted(pages))
    assert sorted(map(tuple, elements.counted(pages).collect())) == sorted(map(tuple, held.collect()))


def test_names_by_their_sources(spark):
    page = """<body><b id=x>Ex</b><b id=x>later</b><b id=y>Why</b><input id=1 aria-labelledby=" y  x zz"><label for=2>One</label><input id=2><label for=2>Two</label>
    <label>out <label>in <input id=3></label></label><div>Near</div><section><div><textarea id=4></textarea></div></section><div>far<button>b</button></div><div contenteditable id=5></div>
    <div role=row id=6><span>9:15 h</span><strong>Row</strong></div>"""
    rows = {r["attrs"]["id"]: r for r in elements.named(html.nodes(spark.createDataFrame([(1, page)], "page_id long, html string"))).filter("attrs['id'] is not null").collect()}
    assert [rows[k]["name"] for k in "123456"] == ["Why Ex", "One Two", "in", "Near", "Near", "Row"]
    assert rows["2"]["before"] == "One" and rows["1"]["before"] == "Why" and rows["6"]["nearby"] is None
