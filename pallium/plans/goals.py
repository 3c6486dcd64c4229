"""What a goal asks for and whether a page shows it: names, titles, messages, and rewrites of plans around a search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words that are no name, endings of a chat's title, days, and longest title, rest and message.
NO_NAMES = "a the him her them this there named chat contact message hi hello hey please open send".split()
_LETTER = "A-Za-zऀ-ॿ"
_STATUS = r"(?i)\b(last seen|online|typing|click here for contact info|tap here for contact info|click here for group info).*$"
_DAYS = r"(?i)\b(yesterday|today|monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b"
MAX_TITLE, MAX_REST, MAX_MESSAGE = 48, 24, 200


def contact_name(goal: Column) -> Column:
    """The lower-case name of the person that a goal is about; empty without one."""
    find = lambda pattern: F.lower(F.regexp_extract(F.coalesce(goal, F.lit("")), pattern, 1))
    named = find(rf"(?i)\bnamed\s+([{_LETTER}][{_LETTER}0-9._-]{{1,40}})")
    to = find(rf"(?i)\b(?:to|chat|contact)\s+([{_LETTER}][{_LETTER}0-9._-]{{2,40}})")
    send = find(rf"(?i)\b(?:send|message|text|open|find)\s+([{_LETTER}][{_LETTER}0-9._-]{{2,40}})\b")
    good = lambda x: (x != "") & ~x.isin(*NO_NAMES)
    return F.when(named != "", named).when(good(to), to).when(good(send), send).otherwise("")


def message_text(goal: Column) -> Column:
    """What a goal asks to write; empty when that is shorter than two characters or too long."""
    said = F.regexp_extract(F.trim(F.coalesce(goal, F.lit(""))), r"(?i)(?:send(?:\s+\w+)?|type|message|text|say)\s+(?:him\s+|her\s+|them\s+)?(.+)$", 1)
    flat = F.trim(F.regexp_replace(F.regexp_replace(said, r"^[,\s]+", ""), r"(?i)\s+and\s+send$", ""))
    bare = F.regexp_replace(flat, r"(?i)^a\s+", "")
    return F.when(F.length(bare).between(2, MAX_MESSAGE), bare).otherwise("")


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, f"[^{_LETTER}0-9]+", "")


def title_is_contact(title: Column, name: Column) -> Column:
    """Whether an open chat's title is that of a contact: the same, starting with it, or the same first word."""
    n = F.trim(F.lower(F.coalesce(name, F.lit(""))))
    t = F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(title, F.lit("")), _STATUS, ""), r"\s+", " ")))
    first = _bare(F.get(F.split(t, r"\s+"), 0))
    same = (t == n) | t.startswith(F.concat(n, F.lit(" "))) | ((first != "") & (first == _bare(n))) | _bare(t).startswith(_bare(n))
    return (t != "") & (F.length(n) >= 3) & same


def is_preview(title: Column, name: Column) -> Column:
    """Whether a row's text is a message preview rather than a title."""
    t = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"\s+", " "))
    rest = F.regexp_replace(F.substring(t, F.length(name) + 1, F.length(t)), r"^[\s:,\-–|]+", "")
    busy = t.rlike(r"\d{1,2}:\d{2}") | t.rlike(_DAYS) | (F.length(t) > MAX_TITLE) | ((name != "") & (F.length(rest) > MAX_REST))
    return (t == "") | t.rlike(r"(?i)\breacted\b") | (~((name != "") & title_is_contact(t, name)) & busy)


def contact_rows(elements: DataFrame, goals: DataFrame) -> DataFrame:
    """Elements (session_id, role, text) that are list rows of the contact of their session's goal."""
    rows = elements.join(goals.select("session_id", contact_name(F.col("goal")).alias("contact")), "session_id").filter("contact <> ''")
    return rows.filter(F.col("role").isin("listitem", "row") & ~is_preview(F.lower("text"), F.col("contact")) & title_is_contact(F.col("text"), F.col("contact")))


def open_title(open_conversation: Column, page_title: Column) -> Column:
    """The title of the open chat: as extracted, else the page's title without counter and site."""
    title = F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(page_title, F.lit("")), r"^\(\d+\)\s*", ""), r"\s*[-–|].*$", ""))
    return F.coalesce(F.nullif(F.trim(F.regexp_replace(F.coalesce(open_conversation, F.lit("")), r"\s+", " ")), F.lit("")), F.when(~title.rlike("(?i)^whatsapp$"), title), F.lit(""))


def is_search(text: Column) -> Column:
    return F.coalesce(text.rlike(r"(?i)\bsearch\b"), F.lit(False))


def split_search_turns(rows: DataFrame, elements: DataFrame) -> DataFrame:
    """Action rows of plans that fill a search field keep waits, scrolls and actions on search fields; `deferred` marks such plans."""
    keys = ["session_id", "turn"]
    fields = elements.filter(is_search(F.concat_ws(" ", "text", "name", "html_id"))).select(*keys, "element_id", F.lit(True).alias("_search")).distinct()
    marked = rows.join(fields, [*keys, "element_id"], "left").withColumn("_search", F.coalesce("_search", F.lit(False)))
    plans = marked.groupBy(keys).agg(F.bool_or((F.col("type") == "fill") & F.col("_search")).alias("deferred"))
    return marked.join(plans, keys).filter(~F.col("deferred") | F.col("type").isin("wait", "scroll") | F.col("_search")).drop("_search")


def word_at_border(hay: Column, needle: Column) -> Column:
    """Whether the first place of needle in hay is between characters that are no small letter or digit."""
    at = F.instr(hay, needle)
    before, after = F.substring(hay, at - 1, F.lit(1)), F.substring(hay, at + F.length(needle), F.lit(1))
    return (at > 0) & ((at == 1) | ~before.rlike("[a-z0-9]")) & ~after.rlike("[a-z0-9]")


def option_matches(text: Column, value: Column, wanted: Column) -> Column:
    """Whether a select option is the wanted one, by text or value, whole or at word borders."""
    w = F.lower(wanted)
    return (text == wanted) | (value == wanted) | ((w != "") & (word_at_border(F.lower(text), w) | word_at_border(F.lower(value), w)))


def plan_keys(rows: DataFrame) -> DataFrame:
    """(session_id, turn, key): a plan's kinds, roles, target texts and typed texts, whatever its element ids."""
    one = F.when(F.col("type") == "wait", "wait").otherwise(F.concat_ws("|", "type", F.coalesce("role", F.lit("")), F.substring(F.coalesce("target_text", F.lit("")), 1, 40), F.coalesce("text", F.lit(""))))
    items = F.array_sort(F.collect_list(F.struct("idx", one.alias("k"))))
    return rows.groupBy("session_id", "turn").agg(F.array_join(F.transform(items, lambda x: x["k"]), ";").alias("key"))


def planned(elements: DataFrame, vault: DataFrame, done: DataFrame) -> DataFrame:
    """One action for each session from fixed rules, as a planner without a model gives it.

    elements: (session_id, pos, element_id, kind, text, categories, has_value); vault: (session_id, placeholder, category);
    done: (session_id, type, element_id) applied before. Empty fields of a category in the vault are filled, then the first
    button not yet clicked is clicked, then the session is done.
    """
    token = vault.groupBy("session_id", "category").agg(F.min("placeholder").alias("placeholder"))
    free = elements.join(done.select("session_id", "element_id", F.col("type").alias("_t")), ["session_id", "element_id"], "left_anti")
    wants = free.filter(F.col("kind").isin("input", "textarea") & ~F.coalesce("has_value", F.lit(False))).select("session_id", "pos", "element_id", F.explode("categories").alias("category"))
    fills = wants.join(token, ["session_id", "category"]).select("session_id", F.struct(F.lit(0).alias("o"), "pos", "element_id", F.lit("fill").alias("type"), F.col("placeholder").alias("text")).alias("a"))
    clicks = free.filter("kind = 'button'").select("session_id", F.struct(F.lit(1).alias("o"), "pos", "element_id", F.lit("click").alias("type"), F.lit(None).cast("string").alias("text")).alias("a"))
    ends = elements.select("session_id").distinct().select("session_id", F.struct(F.lit(2).alias("o"), F.lit(0).alias("pos"), F.lit(None).cast("string").alias("element_id"), F.lit("done").alias("type"), F.lit(None).cast("string").alias("text")).alias("a"))
    best = fills.unionByName(clicks).unionByName(ends.select("session_id", F.col("a").cast(fills.schema["a"].dataType).alias("a")))
    return best.groupBy("session_id").agg(F.min("a").alias("a")).select("session_id", "a.type", "a.element_id", "a.text")
