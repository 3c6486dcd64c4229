import json

import pytest
from pyspark.sql import functions as F

from pallium.functions import geometry, payload
from pallium.operators import gates, hybrid, redact
from pallium.plans import goals
from pallium.sources import html

FIELDS = "page_id int, pos int, tag string, kind string, input_type string, autocomplete string, text string, placeholder string, name string, html_id string, aria_label string, categories array<string>, has_value boolean"


def field(page, pos, text="", kind="text", auto="", categories=(), filled=False, tag="input"):
    return (page, pos, tag, "input", kind, auto, text, "", "", "", "", list(categories), filled)


def test_gates(spark):
    rows = [
        field(1, 0, "E-mail"), field(1, 1, "Enter OTP"), field(1, 2, "cvv", categories=["cvv"], filled=True),
        field(2, 0, "Security PIN", "password"), field(3, 0, "Name"), field(4, 0, "Enter your 6 digit security PIN", tag="p"), field(4, 1, "", "password"),
        field(5, 0, "code", auto="one-time-code", filled=True), field(6, 0, "passcode", "password"), field(7, 0, "password", "password"),
    ]
    found = {r["page_id"]: (r["present"], r["blocking"], r["kind"], r["empty_count"], r["filled_count"]) for r in gates.gates(spark.createDataFrame(rows, FIELDS).withColumn("kind", F.when(F.col("tag") == "p", "text").otherwise("input"))).collect()}
    assert found[1] == (True, True, "otp", 1, 1) and found[2] == (True, True, "pin", 1, 0) and found[3] == (False, False, None, 0, 0)
    assert found[4] == (True, True, "pin", 1, 0) and found[5] == (True, False, "otp", 0, 1) and found[6][2] == "pin" and found[7][0] is False
    able = spark.createDataFrame([(2,)], "page_id int")
    assert not [r for r in gates.gates(spark.createDataFrame(rows, FIELDS), able).collect() if r["page_id"] == 2][0]["blocking"]


def test_pin_cues_and_digit_boxes(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    assert get(gates.pin_cue(F.lit("Enter your mPIN"))) and not get(gates.pin_cue(F.lit("Enter the OTP for login pin"))) and not get(gates.pin_cue(F.lit("pin code")))
    assert get(gates.digit_box(F.lit("text"), F.lit("1"), F.lit(""), F.lit(""), F.lit(False))) and not get(gates.digit_box(F.lit("email"), F.lit("1"), F.lit(""), F.lit(""), F.lit(True)))
    boxes = "".join("<span><input type=password></span>" for _ in range(6))
    nodes = html.nodes(spark.createDataFrame([(1, f"<div>{boxes}</div><div><input><input type=tel></div>")], "page_id long, html string"))
    assert gates.digit_clusters(nodes).count() == 6
    assert get(gates.gate_label(F.lit("cvv"))) == "security code (CVV)" and get(gates.gate_label(F.lit("?"))) == "your input"


def test_fields_accept_categories(spark):
    rows = spark.createDataFrame([field(1, 0, "ZIP"), field(1, 1, "x", "email"), field(1, 2, "Billing city"), field(1, 3, "login pin", categories=["otp"])], FIELDS)
    ask = {0: "pin_code", 1: "email", 2: "address", 3: "security_pin"}
    category = F.create_map(*(F.lit(x) for p in ask.items() for x in p))[F.col("pos")]
    assert {r["pos"]: r["ok"] for r in rows.select("pos", gates.accepts_category(category).alias("ok")).collect()} == {0: True, 1: True, 2: True, 3: False}


def test_hybrid_decisions(spark):
    rows = spark.createDataFrame([(1, "img", "image", "", ["x"]), (1, "input", "input", "password", None), (2, "p", "text", "", None), (4, "canvas", "canvas", "", None)], "page_id int, tag string, kind string, input_type string, categories array<string>")
    pages = spark.createDataFrame([(1,), (2,), (3,), (4,)], "page_id int")
    plan = {r["page_id"]: (r["run"], r["mode"]) for r in hybrid.ocr_plan(pages, hybrid.surfaces(rows)).collect()}
    assert plan == {1: (True, "automatic"), 2: (False, "skipped"), 3: (True, "automatic"), 4: (True, "automatic")}
    assert {r["mode"] for r in hybrid.ocr_plan(pages, hybrid.surfaces(rows), True).collect()} == {"forced"}
    detections, ocr = spark.createDataFrame([(1, "Face")], "page_id int, label string"), spark.createDataFrame([(4, "a@b.example")], "page_id int, text string")
    table = {(r["page_id"], r["signal"]): (r["dom"], r["vision"]) for r in hybrid.comparison(rows, detections, ocr).collect()}
    assert len(table) == 18 and table[1, "Person / face"] == ("NO", "YES") and table[1, "Password field"] == ("YES", "NO") and table[4, "Canvas text"] == ("YES (tag only)", "YES") and table[4, "Email field"] == ("NO", "MAYBE")


def test_pixel_findings(spark):
    box = lambda *v: tuple(map(float, v))
    items = spark.createDataFrame([(1, 0, "a@b.example", box(10, 10, 4, 4)), (1, 1, "plain", box(10, 10, 4, 4)), (1, 2, "pan ABCPE1234F", box(80, 80, 4, 4))], f"image_id int, seq int, text string, box {geometry.BOX}")
    elements = spark.createDataFrame([(1, "img", "image", box(0, 0, 10, 10)), (1, "p", "text", box(0, 0, 50, 50))], f"image_id int, tag string, kind string, box {geometry.BOX}")
    views = spark.createDataFrame([(1, 100, 100, 50, 50, 0, 0)], "image_id int, width int, height int, view_width int, view_height int, offset_x int, offset_y int")
    where = hybrid.regions(elements, views, ("img", "image", "canvas"))
    got = {r["seq"]: (r["categories"], r["level"]) for r in hybrid.annotated_items(items, where, where.filter("false")).collect()}
    assert got == {0: (["email", "image_embedded_text"], "potentially_sensitive"), 1: ([], "unknown"), 2: (["pan"], "sensitive")}
    seen = hybrid.annotated_detections(spark.createDataFrame([("Person",), ("car",)], "label string"))
    assert [r["categories"] for r in seen.collect()] == [["faces_people"], []]


def test_frames(spark):
    rows = [("a", 1, 1, None, None, 5), ("a", 2, 1, "after", None, 6), ("a", 3, 1, "observe", None, 7), ("a", 4, 2, "observe", 9, 8), ("a", 5, 3, "observe", 9, 9)]
    got = hybrid.frames(spark.createDataFrame(rows, "session_id string, seq int, step int, phase string, screen int, captured_at int")).orderBy("position").collect()
    assert [r["seq"] for r in got] == [3, 2, 5]
    one = spark.range(1)
    assert one.select(hybrid.frame_label(F.lit(2), F.lit("Inbox"), F.lit("after")).alias("x")).first()["x"] == "Step 2 · Inbox · after navigation"
    assert one.select(hybrid.data_url_bytes(F.lit("data:image/jpeg;base64,AAAA")).alias("x")).first()["x"] == 3


def base(**more):
    return {"sanitized": True, "goal": "g", "context": {"redacted": True, "elements": []}, "privacyManifest": {"sanitized": True, "categories": {"email": 1}}} | more


PICTURE = {"sanitized": True, "kind": "sanitized-screenshot-v1", "dataUrl": "data:image/jpeg;base64,AAAA", "width": 1, "height": 1, "byteLength": 3}


@pytest.mark.parametrize(
    "body,sent,taken",
    [
        (base(), None, None),
        (base(sanitized=False), "not sanitised", "not sanitised"),
        (base(context={"redacted": True, "elements": [{"a": {"VAULT": 1}}]}), "forbidden field", "forbidden field"),
        (base(goal='say "vault": now'), None, None),
        (base(screenshot={"kind": "x"}), "picture not branded", None),
        (base(screenshot=PICTURE), None, None),
        (base(extra=1), None, "unsupported fields"),
        (base(goal=""), None, "goal length"),
        (base(history=[1] * 13), None, "history"),
        (base(privacyManifest={"sanitized": True, "categories": {"email": -1}}), None, "manifest counts"),
        (base(profile={"tokens": {"email": "<EMAIL>"}, "available": {}}), None, "profile"),
        (base(profile={"tokens": {"email": "<PROFILE_EMAIL>"}, "available": {}}), None, None),
        ([1], "not sanitised", "not an object"),
    ],
)
def test_payload_gates(spark, body, sent, taken):
    row = spark.createDataFrame([(json.dumps(body),)], "j string").select(payload.payload_error(F.col("j")).alias("s"), payload.request_error(F.col("j")).alias("t")).first()
    assert (row["s"], row["t"]) == (sent, taken)


def test_retry_delays(spark):
    rows = [("3", None, 0, 3000), (None, '{"error":{"details":[{"x":1},{"retryDelay":"2.5s"}]}}', 0, 2500), (None, "oops", 1, 8000), ("x", None, 9, 20000)]
    for header, body, attempt, want in rows:
        df = spark.createDataFrame([(header, body, attempt)], "h string, b string, a int")
        assert df.select(payload.retry_delay_ms(F.col("h"), F.col("b"), F.col("a")).alias("x")).first()["x"] == want


def test_goals(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    name = lambda g: get(goals.contact_name(F.lit(g)))
    assert name("open the chat named Anna") == "anna" and name("write to Bob") == "bob" and name("message Carl hello") == "carl" and name("send a message") == "" and name("buy shoes") == ""
    assert get(goals.message_text(F.lit("type hello there and send"))) == "hello there" and get(goals.message_text(F.lit("buy"))) == ""
    title = lambda t, n: get(goals.title_is_contact(F.lit(t), F.lit(n)))
    assert title("Anna Smith online", "anna") and title("Anna", "anna") and not title("Bob", "anna") and not title("An", "an")
    assert get(goals.is_preview(F.lit("see you 10:30"), F.lit("anna"))) and not get(goals.is_preview(F.lit("Anna"), F.lit("anna")))
    assert get(goals.open_title(F.lit(None).cast("string"), F.lit("(3) Anna - Chat"))) == "Anna"
    assert get(goals.option_matches(F.lit("New Delhi"), F.lit("dl"), F.lit("delhi"))) and not get(goals.option_matches(F.lit("Delhigate"), F.lit("x"), F.lit("delhi")))


def test_search_turns_and_plan_keys(spark):
    rows = spark.createDataFrame([("a", 1, 0, "fill", "e1", "bob", "", ""), ("a", 1, 1, "click", "e2", None, "", ""), ("a", 1, 2, "wait", None, None, "", ""), ("a", 2, 0, "click", "e2", None, "button", "Go")], "session_id string, turn int, idx int, type string, element_id string, text string, role string, target_text string")
    page = spark.createDataFrame([("a", 1, "e1", "Search chats", "", ""), ("a", 1, "e2", "Go", "", "")], "session_id string, turn int, element_id string, text string, name string, html_id string")
    assert sorted((r["turn"], r["idx"], r["deferred"]) for r in goals.split_search_turns(rows, page).collect()) == [(1, 0, True), (1, 2, True), (2, 0, False)]
    keys = {r["turn"]: r["key"] for r in goals.plan_keys(rows).collect()}
    assert keys == {1: "fill|||bob;click|||;wait", 2: "click|button|Go|"}
    listed = spark.createDataFrame([("a", "row", "Anna online"), ("a", "row", "Bob"), ("a", "link", "Anna")], "session_id string, role string, text string")
    assert [r["text"] for r in goals.contact_rows(listed, spark.createDataFrame([("a", "write to Anna")], "session_id string, goal string")).collect()] == ["Anna online"]


def test_planner_without_a_model(spark):
    elements = spark.createDataFrame([("a", 1, "e1", "input", "Mail", ["email"], False), ("a", 2, "e2", "button", "Go", [], False), ("b", 1, "e1", "input", "Mail", ["email"], True), ("b", 2, "e2", "button", "Go", [], False), ("c", 1, "e1", "text", "x", [], False)], "session_id string, pos int, element_id string, kind string, text string, categories array<string>, has_value boolean")
    vault = spark.createDataFrame([("a", "<EMAIL_1>", "email"), ("b", "<EMAIL_1>", "email")], "session_id string, placeholder string, category string")
    done = spark.createDataFrame([("b", "click", "e2")], "session_id string, type string, element_id string")
    assert {r["session_id"]: (r["type"], r["element_id"], r["text"]) for r in goals.planned(elements, vault, done).collect()} == {"a": ("fill", "e1", "<EMAIL_1>"), "b": ("done", None, None), "c": ("done", None, None)}


def test_model_entities_get_a_second_round(spark):
    rows = spark.createDataFrame([(1, 0, 0, "Ann wrote a@b.example to Bob"), (1, 1, 0, "Ann again")], "page long, pos int, field_pos int, value string")
    first = redact.redact(rows, "page")
    entities = spark.createDataFrame([(1, 0, 0, "person_name", 0, 3, 0.99), (1, 0, 0, "person_name", 23, 3, 0.95), (1, 1, 0, "person_name", 0, 3, 0.95), (1, 1, 0, "unknown", 4, 5, 0.9)], "page long, pos int, field_pos int, category string, start int, length int, score double")
    done = redact.apply_entities(first, entities, "page")
    assert {r["pos"]: r["redacted"] for r in done.texts.collect()} == {0: "<NAME_2> wrote <EMAIL_1> to <NAME_1>", 1: "<NAME_2> again"}
    assert {r["placeholder"]: r["value"] for r in done.vault.collect()} == {"<EMAIL_1>": "a@b.example", "<NAME_1>": "Bob", "<NAME_2>": "Ann"}
    assert done.records.filter("reused").count() == 1


def test_texts_for_a_model(spark):
    rows = spark.createDataFrame([(1, 3, "Ann", "12", "http://x"), (1, 4, "<NAME_1>", None, None)], "page long, pos int, text string, alt string, href string")
    assert [(r["key"], r["value"]) for r in redact.texts_for_model(rows, "page").collect()] == [("el.3.text", "Ann")]
    found = redact.Redaction(spark.createDataFrame([(1, 3, 0, "<NAME_1>")], "page long, pos int, field_pos int, redacted string"), None, None)
    back = redact.fields_back(found, rows, "page").orderBy("pos").collect()
    assert back[0]["text"] == "<NAME_1>" and back[0]["href"] == "http://x" and back[1]["text"] == "<NAME_1>"
