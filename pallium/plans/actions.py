"""Action plans of a planner: strict parsing, validation against a page's elements, and rewrites, as columns and joins.

plans: (session_id, turn, raw, goal); elements: (session_id, turn, element_id, name, html_id, text, category).
An action row is (session_id, turn, idx, type, element_ref, text, key, x, y, ms, reason).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pallium.functions.text import placeholders_in, strip_fence

#: Limits of a reply, the closed set of actions, keys an action may carry, keyboard keys.
MAX_REPLY, MAX_ACTIONS, MAX_TEXT, MAX_WAIT_MS, MAX_SCROLL, MAX_NOTE, MAX_STEPS = 20000, 16, 500, 5000, 1600, 200, 12
TYPES = ("click", "fill", "select", "check", "uncheck", "press", "scroll", "wait", "done")
ACTION_KEYS = ("type", "action", "elementId", "id", "text", "value", "key", "x", "y", "ms", "reason")
KEYS = ("Enter", "Tab", "Escape", "Space")
#: Fixed value: likeness from which an element stands for one that is gone.
LEAST_LIKENESS = 3
#: Categories that are never filled automatically.
NEVER_FILLED = ("otp", "cvv", "authentication_secret", "password")
PLAN = ["session_id", "turn"]


def _field(action: Column, name: str, kind: str = "string") -> Column:
    return F.try_variant_get(action, f"$.{name}", kind)


def parsed(plans: DataFrame) -> DataFrame:
    """(PLAN, goal, done, error, actions): actions is an array of variants; error is null for a well-formed reply.

    One bad action refuses the whole reply; fills without text are left out; over MAX_ACTIONS the reply isn't done.
    """
    value = F.try_parse_json(strip_fence(F.col("raw")))
    kind = F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)
    rows = plans.withColumn("_v", value).withColumn("_kind", kind)
    rows = rows.withColumn("_actions", F.try_variant_get("_v", "$.actions", "array<variant>"))
    extra = F.array_except(F.json_object_keys(F.to_json("_v")), F.array(F.lit("actions"), F.lit("done")))
    kinds = F.transform("_actions", lambda a: F.regexp_extract(F.schema_of_variant(a), "^[A-Z]+", 0))
    names = F.transform("_actions", lambda a: action_type(a))
    spare = F.flatten(F.transform("_actions", lambda a: F.array_except(F.json_object_keys(F.to_json(a)), F.array(*map(F.lit, ACTION_KEYS)))))
    unknown = F.filter(names, lambda t: t.isNull() | ~t.isin(*TYPES))
    error = (
        F.when(F.length("raw") > MAX_REPLY, "too large")
        .when(F.col("_v").isNull(), "not JSON")
        .when(F.col("_kind") != "OBJECT", "not an object")
        .when(F.col("_actions").isNull(), "no actions array")
        .when(F.size(extra) > 0, F.concat(F.lit("unexpected fields: "), F.array_join(extra, ", ")))
        .when(F.exists(kinds, lambda k: k != "OBJECT"), "an action is not an object")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown action type: "), F.coalesce(F.get(unknown, 0), F.lit("none"))))
        .when(F.size(spare) > 0, F.concat(F.lit("unexpected action fields: "), F.array_join(F.array_distinct(spare), ", ")))
    )
    rows = rows.withColumn("error", error)
    idle = lambda a: action_type(a).isin("fill", "select") & (F.trim(F.coalesce(action_text(a), F.lit(""))) == "")
    kept = F.filter("_actions", lambda a: ~idle(a))
    many = F.size(kept) > MAX_ACTIONS
    done = F.coalesce(_field(F.col("_v"), "done", "boolean"), F.lit(False)) & ~F.coalesce(many, F.lit(False))
    ok = F.col("error").isNull()
    return rows.select(*PLAN, "goal", F.when(ok, done).alias("done"), "error", F.when(ok, F.slice(kept, 1, MAX_ACTIONS)).alias("actions"))


def action_type(a: Column) -> Column:
    named = F.coalesce(_field(a, "type"), _field(a, "action"))
    return F.when(named == "type", "fill").otherwise(named)


def action_text(a: Column) -> Column:
    return F.coalesce(_field(a, "text"), _field(a, "value"))


def element_id(ref: Column) -> Column:
    """A reference as an element id: bare numbers and loose spellings become element_<n>."""
    flat = F.trim(ref)
    number = F.regexp_extract(flat, r"(?i)^#?(?:element[_-])?([0-9]+)$", 1)
    return F.when(number != "", F.concat(F.lit("element_"), number)).otherwise(flat)


def actions(plans: DataFrame) -> DataFrame:
    """The action rows of the well-formed plans of `parsed`."""
    a = F.col("a")
    rows = plans.filter("error is null").select(*PLAN, "goal", F.posexplode("actions").alias("idx", "a"))
    ref = F.coalesce(F.nullif(_field(a, "elementId"), F.lit("")), _field(a, "id"))
    fields = {"text": action_text(a), "key": _field(a, "key"), "x": _field(a, "x", "double"), "y": _field(a, "y", "double"), "ms": _field(a, "ms")}
    reason = F.substring(_field(a, "reason"), 1, MAX_NOTE)
    return rows.select(*PLAN, "goal", "idx", action_type(a).alias("type"), element_id(ref).alias("element_ref"), *(c.alias(n) for n, c in fields.items()), reason.alias("reason"))


def resolved(rows: DataFrame, elements: DataFrame) -> DataFrame:
    """Action rows with `element_id`: by id, else by the only element with that html id, name or text."""
    e = elements.select(*PLAN, "element_id", "html_id", "name", F.lower("text").alias("text"))
    known = e.select(*PLAN, F.col("element_id").alias("element_ref"), F.col("element_id").alias("by_id")).distinct()
    out = rows.join(known, [*PLAN, "element_ref"], "left").withColumn("_needle", F.regexp_replace("element_ref", "^#", ""))
    picks = [F.col("by_id")]
    for column in ("html_id", "name", "text"):
        needle = F.lower("_needle") if column == "text" else F.col("_needle")
        one = e.filter(F.col(column) != "").groupBy(*PLAN, F.col(column).alias(f"_k_{column}")).agg(F.min("element_id").alias(f"_by_{column}"), F.count_distinct("element_id").alias("_n")).filter("_n = 1").drop("_n")
        out = out.withColumn(f"_k_{column}", needle).join(one, [*PLAN, f"_k_{column}"], "left").drop(f"_k_{column}")
        picks.append(F.col(f"_by_{column}"))
    return out.withColumn("element_id", F.coalesce(*picks)).drop("by_id", "_needle", "_by_html_id", "_by_name", "_by_text")


def wait_ms(raw: Column) -> Column:
    """Milliseconds of a wait, null when it isn't a number; at most MAX_WAIT_MS."""
    number = raw.try_cast("double")
    return F.when(number.isNotNull() & ~F.isnan(number), F.least(F.lit(MAX_WAIT_MS), F.floor(F.greatest(number, F.lit(0.0))).cast("int")))


def mentioned(text: Column, goal: Column) -> Column:
    """Whether a goal holds a text of two or more characters between word borders."""
    needle = F.trim(text)
    literal = F.concat(F.lit("\\Q"), F.replace(needle, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return (F.length(needle) >= 2) & F.rlike(F.coalesce(goal, F.lit("")), F.concat(F.lit("(?i)(?:^|[^A-Za-z0-9])"), literal, F.lit("(?:$|[^A-Za-z0-9])")))


def validated(rows: DataFrame, elements: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Action rows with `status` keep, drop or error, and `error`.

    profile: (session_id, token) advertised. Unknown elements, empty or ungrounded texts drop an action silently;
    bad numbers and keys, long texts, fills of credentials and unadvertised tokens are errors.
    """
    target = elements.groupBy(*PLAN, "element_id").agg(F.collect_set("category").alias("_categories"))
    joined = resolved(rows, elements).join(target, [*PLAN, "element_id"], "left")
    if profile is not None:
        joined = joined.join(profile.groupBy("session_id").agg(F.collect_set("token").alias("_tokens")), "session_id", "left")
    else:
        joined = joined.withColumn("_tokens", F.array().cast("array<string>"))
    t, text = F.col("type"), F.col("text")
    writes = t.isin("fill", "select")
    tokens = placeholders_in(F.coalesce(text, F.lit("")))
    spare = F.array_except(F.filter(tokens, lambda x: x.startswith("<PROFILE_")), F.coalesce("_tokens", F.array().cast("array<string>")))
    grounded = (F.size(tokens) > 0) | mentioned(text, F.col("goal"))
    far = (F.abs(F.coalesce("x", F.lit(0.0))) > MAX_SCROLL) | (F.abs(F.coalesce("y", F.lit(0.0))) > MAX_SCROLL)
    still = (F.coalesce("x", F.lit(0.0)) == 0) & (F.coalesce("y", F.lit(0.0)) == 0)
    secret = F.arrays_overlap(F.coalesce("_categories", F.array().cast("array<string>")), F.array(*map(F.lit, NEVER_FILLED)))
    verdict = (
        F.when((t == "wait") & wait_ms(F.col("ms")).isNull(), "error:wait is not a number")
        .when((t == "scroll") & (far | still), "error:scroll distance is invalid")
        .when(t.isin("wait", "scroll", "done"), "keep:")
        .when(F.col("element_id").isNull(), "drop:unknown element")
        .when((t == "fill") & secret, "error:credentials cannot be filled")
        .when(writes & text.isNull(), "error:text is not a string")
        .when(writes & (F.length(text) > MAX_TEXT), "error:text is too long")
        .when(writes & (F.trim(text) == ""), "drop:no text")
        .when(writes & ~grounded, "drop:text is not in the goal")
        .when(writes & (F.size(spare) > 0), "error:token is not in the profile")
        .when((t == "press") & ~F.coalesce(F.col("key").isin(*KEYS), F.lit(False)), "error:key is not allowed")
        .otherwise("keep:")
    )
    out = joined.withColumn("_verdict", verdict).withColumns(
        {"status": F.split_part("_verdict", F.lit(":"), F.lit(1)), "error": F.nullif(F.split_part("_verdict", F.lit(":"), F.lit(2)), F.lit("")), "ms": F.when(t == "wait", wait_ms(F.col("ms")))}
    )
    return out.drop("_verdict", "_categories", "_tokens")


def plan_status(validated_rows: DataFrame) -> DataFrame:
    """(PLAN, ok, kept, dropped, errors): any error refuses the plan."""
    counts = {s: F.count_if(F.col("status") == s) for s in ("keep", "drop", "error")}
    out = validated_rows.groupBy(PLAN).agg(counts["keep"].alias("kept"), counts["drop"].alias("dropped"), counts["error"].alias("errors"))
    return out.withColumns({"ok": F.col("errors") == 0, "kept": F.when(F.col("errors") == 0, F.col("kept")).otherwise(0)})


def fingerprint(rows: DataFrame) -> DataFrame:
    """(PLAN, fingerprint): the sequence of types and targets of a plan's actions."""
    one = F.struct("idx", F.concat_ws(":", "type", F.coalesce("element_id", "element_ref"), "text", "key").alias("k"))
    return rows.groupBy(PLAN).agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["k"]), "|").alias("fingerprint"))


def likeness(old: Column, new: Column) -> Column:
    """How alike two elements are, structs of text, role and kind: by their texts first, then role and kind."""
    a, b = F.trim(F.lower(F.coalesce(old["text"], F.lit("")))), F.trim(F.lower(F.coalesce(new["text"], F.lit(""))))
    first_a, first_b = F.get(F.split(a, r"\s+"), 0), F.get(F.split(b, r"\s+"), 0)
    word = F.length(first_a) >= 4
    by_text = (
        F.when(a == b, 5)
        .when(b.startswith(a) | a.startswith(b), 4)
        .when(word & (first_a == first_b), 4)
        .when(word & b.startswith(first_a), 3)
        .when(word & F.contains(b, first_a), 1)
        .otherwise(0)
    )
    same = lambda x: F.coalesce((old[x] != "") & (old[x] == new[x]), F.lit(False)).cast("int")
    return F.when((a == "") | (b == ""), 0).otherwise(by_text + same("role") + same("kind"))


def similar_elements(old: DataFrame, new: DataFrame, least: int = LEAST_LIKENESS) -> DataFrame:
    """(session_id, old_id, new_id, score): for each old element the likest element of its session's page, the first of equals.

    old and new: (session_id, pos, element_id, text, role, kind). Both sides are one page's elements, so pairs stay few.
    """
    fields = ("text", "role", "kind")
    a = old.select("session_id", F.col("element_id").alias("old_id"), F.struct(*fields).alias("_a"))
    b = new.select("session_id", F.col("pos").alias("_pos"), F.col("element_id").alias("new_id"), F.struct(*fields).alias("_b"))
    pairs = a.join(b, "session_id").withColumn("score", likeness(F.col("_a"), F.col("_b"))).filter(F.col("score") >= least)
    best = F.min_by(F.struct("new_id", "score"), F.struct((-F.col("score")).alias("s"), "_pos"))
    return pairs.groupBy("session_id", "old_id").agg(best.alias("m")).select("session_id", "old_id", "m.new_id", "m.score")


def stabilised(rows: DataFrame, elements: DataFrame, before: DataFrame) -> DataFrame:
    """Resolved action rows with `dropped`: ids that are gone move to the likest element, what has none is dropped.

    rows: of `actions`; elements and before: (PLAN, pos, element_id, html_id, name, text, role, kind) of this page and the last.
    """
    found = resolved(rows, elements)
    needs = ~F.col("type").isin("wait", "scroll", "done")
    stale = found.filter(needs & F.col("element_id").isNull()).select("session_id", F.col("element_ref").alias("element_id")).distinct()
    old = before.join(stale, ["session_id", "element_id"], "left_semi")
    moved = similar_elements(old, elements).select("session_id", F.col("old_id").alias("element_ref"), F.col("new_id").alias("_moved"))
    out = found.join(moved, ["session_id", "element_ref"], "left").withColumn("element_id", F.coalesce("element_id", "_moved")).drop("_moved")
    return out.withColumn("dropped", needs & F.col("element_id").isNull())


def up_to_first_failure(results: DataFrame) -> DataFrame:
    """Result rows (PLAN, idx, ok) of a plan up to and with its first failure."""
    before = Window.partitionBy(PLAN).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    failed = F.coalesce(F.max((~F.col("ok")).cast("int")).over(before), F.lit(0))
    return results.withColumn("_f", failed).filter("_f = 0").drop("_f")


def batches(rows: DataFrame) -> DataFrame:
    """Action rows with `batch`: groups that waits and ends close."""
    before = Window.partitionBy(PLAN).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("batch", F.coalesce(F.sum(F.col("type").isin("wait", "done").cast("int")).over(before), F.lit(0)))


def without_repeated_clicks(rows: DataFrame, history: DataFrame) -> DataFrame:
    """Action rows without clicks on a text that an earlier turn of the session clicked with success."""
    key = F.lower(F.substring(F.trim("text"), 1, 40))
    done = history.filter("type = 'click' and ok").select("session_id", key.alias("_key"), F.col("turn").alias("_turn"))
    keyed = rows.withColumn("_label", key)
    clash = (keyed["session_id"] == done["session_id"]) & (keyed["_label"] == done["_key"]) & (done["_turn"] < keyed["turn"]) & (keyed["type"] == "click")
    return keyed.join(done, clash, "left_anti").drop("_label")


def destructive(rows: DataFrame) -> Column:
    """Clicks and Enter presses on targets whose text speaks of deleting, paying, sending or submitting."""
    words = r"(?i)\b(?:delete|remove|pay|purchase|buy|order|transfer|send|submit|confirm)\b"
    return (F.col("type").isin("click") | ((F.col("type") == "press") & (F.col("key") == "Enter"))) & F.col("text").rlike(words)


def may_navigate(actions_column: Column) -> Column:
    return F.exists(actions_column, lambda a: (a["type"] == "click") | ((a["type"] == "press") & (a["key"] == "Enter")))
