"""Elements of pages: which nodes are admitted, what they are, how they are called, and what they hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pallium.functions import catalog
from pallium.functions.text import blank_to_null, cut, empty_to_null, haystack, normalize, scan_window, truncate
from pallium.operators.spans import find_values
from pallium.sources.html import CONTROLS, ROWS, TITLE

#: Tags and roles that admit an element, containers that are scanned for values only, interactive roles.
TAGS = ("button", "input", "textarea", "select", "img", "canvas", "video", "h1", "h2", "h3", "h4", "h5", "h6", "p", "label", "summary")
ROLES = ("button", "link", "textbox", "searchbox", "checkbox", "radio", "combobox", "menuitem", "listitem", "row", "option", "gridcell", "tab", "heading", "img")
CARDS = ("div", "li", "article", "section")
CONTAINERS = ("div", "span", "dd", "dt", "td", "th", "li", "figcaption", "address", "output", "blockquote", "pre", "code", "small", "strong", "em", "b", "i")
INTERACTIVE_ROLES = ("button", "link", "textbox", "searchbox", "checkbox", "radio", "combobox", "menuitem", "listitem", "row", "option", "gridcell", "slider", "switch", "tab")
#: Budgets of paragraphs and of cards to choose from, the shortest paragraph.
PARAGRAPHS, CHOOSERS, SHORT = 12, 8, 24


def attr(name: str) -> Column:
    return F.coalesce(F.col("attrs")[name], F.lit(""))


def role() -> Column:
    return F.lower(attr("role"))


def input_type() -> Column:
    return F.lower(F.coalesce(empty_to_null(F.col("attrs")["type"]), F.when(F.col("tag") == "input", "text").otherwise("")))


def editable() -> Column:
    return F.map_contains_key("attrs", F.lit("contenteditable")) & (F.lower(attr("contenteditable")) != "false")


def focusable() -> Column:
    return F.coalesce(attr("tabindex").try_cast("int") >= 0, F.lit(False))


def kind() -> Column:
    """What an element is; the first rule that fits counts."""
    tag, r, t = F.col("tag"), role(), F.lower(attr("type"))
    card = focusable() & tag.isin(*CARDS) & (F.length("text") <= 200) & F.col("text").rlike(r"(?i)\b(?:verified|unverified)\b")
    rules = (
        (tag.rlike("^h[1-6]$") | (r == "heading"), "heading"),
        ((tag == "img") | (r == "img"), "image"),
        (tag == "canvas", "canvas"),
        (tag == "video", "video"),
        ((tag == "a") | (r == "link"), "link"),
        (r.isin("listitem", "row", "option", "menuitem", "tab"), "button"),
        (tag == "textarea", "textarea"),
        (tag == "select", "select"),
        (((tag == "input") & (t == "checkbox")) | (r == "checkbox"), "checkbox"),
        (((tag == "input") & (t == "radio")) | (r == "radio"), "radio"),
        (tag.isin("button", "summary") | (r == "button") | ((tag == "input") & t.isin("button", "submit", "reset", "image")), "button"),
        (tag == "label", "label"),
        ((tag == "input") | r.isin("textbox", "searchbox") | editable(), "input"),
        (card, "button"),
    )
    out = F.when(rules[0][0], rules[0][1])
    for test, name in rules[1:]:
        out = out.when(test, name)
    return out.otherwise("text")


def interactive(kind_col: Column) -> Column:
    by_kind = kind_col.isin("button", "link", "input", "textarea", "select", "checkbox", "radio")
    return by_kind | role().isin(*INTERACTIVE_ROLES) | editable() | (F.col("tag") == "summary") | (focusable() & F.col("tag").isin("div", "span"))


def heading_level() -> Column:
    named = F.regexp_extract("tag", "^h([1-6])$", 1)
    return F.coalesce(F.nullif(named, F.lit("")).try_cast("int"), F.when(role() == "heading", attr("aria-level").try_cast("int")))


def disabled(nodes: DataFrame, page: str = "page_id") -> DataFrame:
    """nodes with `disabled`: by their own attributes or a disabled fieldset above."""
    sets = nodes.filter((F.col("tag") == "fieldset") & F.map_contains_key("attrs", F.lit("disabled"))).groupBy(page).agg(F.collect_list("node_id").alias("_sets"))
    own = F.map_contains_key("attrs", F.lit("disabled")) | (attr("aria-disabled") == "true")
    return nodes.join(sets, page, "left").withColumn("disabled", own | F.coalesce(F.arrays_overlap("ancestors", "_sets"), F.lit(False))).drop("_sets")


def relevant() -> Column:
    tag = F.col("tag")
    link = (tag == "a") & F.map_contains_key("attrs", F.lit("href"))
    return link | tag.isin(*TAGS) | editable() | role().isin(*ROLES) | (tag.isin(*CARDS) & (attr("tabindex") == "0"))


def tracking_pixel() -> Column:
    return (F.col("tag") == "img") & (attr("width") == "1") & (attr("height") == "1")


def selector_hint() -> Column:
    return F.when(attr("id") != "", F.concat(F.lit("#"), attr("id"))).otherwise(F.concat(F.lit('[data-node="'), F.col("node_id").cast("string"), F.lit('"]')))


def named(nodes: DataFrame, page: str = "page_id") -> DataFrame:
    """nodes with `nearby`, `before` and `name`: the accessible name, by the first source that gives one.

    What the sources need from other nodes of the page comes with the node (`html.nodes`), so nothing is joined or moved.
    before is the own text of the sibling just before an element, which may say what a value in the element is; nearby
    the short text of the nearest earlier sibling of a control or of its ancestors.
    """
    context = F.col("tag").isin(*CONTROLS) | editable()
    plain = F.regexp_replace(F.regexp_replace(attr("name"), "^[0-9_]+", ""), "[_-]+", " ")
    own = F.when(F.col("tag").isin(*CONTROLS), plain).otherwise(F.col("text"))
    sources = [row_label(), attr("aria-label"), F.col("labelledby"), F.col("labels"), F.col("wrap"), F.when(context, F.col("nearby")), attr("alt"), attr("title"), attr("placeholder"), own]
    name = normalize(F.coalesce(*map(blank_to_null, sources), F.lit("")))
    # a column of its own first: cutting names it three times
    return nodes.withColumn("name", name).withColumn("name", cut(F.col("name"))).drop("labelledby", "labels", "wrap", "row_label")


def has_user_value() -> Column:
    value, hint = F.trim(attr("value")), F.trim(attr("placeholder"))
    excluded = input_type().isin("hidden", "submit", "button", "reset", "image", "file", "checkbox", "radio")
    typed = (value != "") & ~((hint != "") & (F.lower(value) == F.lower(hint)))
    return F.col("tag").isin("input", "textarea") & ~excluded & F.when(F.col("tag") == "textarea", F.col("direct_text") != "").otherwise(typed)


def classified(elements: DataFrame, policy: dict[str, bool] | None = None) -> DataFrame:
    """elements (with `relevant`) and their `purpose` (categories), `values` (hits of the text), `control` (hits of a typed value) and `level`."""
    is_field = F.col("tag").isin(*CONTROLS)
    hay = haystack(attr("name"), attr("id"), attr("placeholder"), attr("aria-label"), attr("autocomplete"), attr("type"), F.col("name"))
    # a container speaks for its own text only: what its children hold, they report themselves
    own = (F.length("direct_text") > F.length("name")) | ~F.col("relevant")
    text = F.when(is_field, F.lit("")).otherwise(F.when(own, F.col("direct_text")).otherwise(F.col("name")))
    typed = F.when(is_field & has_user_value() & (input_type() != "password"), F.coalesce(empty_to_null(attr("value")), F.col("direct_text"))).otherwise("")
    # columns of their own first: the matchers below name each of them a hundred times
    rows = elements.withColumns({"_hay": hay, "_low": F.lower(hay), "_text": scan_window(text), "_typed": scan_window(typed), "_field": is_field, "_type": input_type(), "_hint": attr("autocomplete")})
    rows = rows.withColumn("_context", F.concat_ws(" ", "_hay", "before"))
    purpose = catalog.matching(F.col("_field"), F.col("_type"), F.col("_hint"), F.col("_hay"), policy, F.col("_low"))
    values, control = (find_values(F.col(c), policy, F.col("_context"), scanned=True) for c in ("_text", "_typed"))
    rows = rows.withColumns({"purpose": purpose, "values": values, "control": control}).drop("_hay", "_low", "_text", "_typed", "_field", "_type", "_hint", "_context")
    rows = rows.withColumn("control", F.array_distinct(F.transform("control", lambda h: F.struct(h["category"].alias("category"), h["confidence"].alias("confidence")))))
    found = F.concat("purpose", F.transform("values", lambda h: h["category"]), F.transform("control", lambda h: h["category"]))
    return rows.withColumn("categories", F.array_distinct(found)).withColumn("level", catalog.level(F.col("categories")))


def _judged(nodes: DataFrame, page: str, mode: str, policy: dict[str, bool] | None) -> DataFrame:
    """Classified nodes with `_first` and `_second`: whether the first or the second pass may admit them, by themselves.

    What an element is said to be is settled here, before rows of a page are ordered, so that its attributes aren't moved.
    """
    rows = classified(nodes.withColumns({"kind": kind(), "relevant": relevant()}), policy)
    seen = ~F.col("hidden") if mode == "visible" else F.lit(True)
    long_p = (F.col("tag") == "p") & (F.length("text") >= SHORT)
    first = seen & F.col("relevant") & ~tracking_pixel() & ((F.col("tag") != "p") | long_p)
    second = seen & ~F.col("relevant") & F.col("tag").isin(*CONTAINERS) & (F.size("values") > 0)
    return rows.withColumns({"_first": first, "_second": second, "interactive": interactive(F.col("kind")), "heading_level": heading_level(), "selector": selector_hint()})


def _kept(rows: DataFrame, test: Column) -> DataFrame:
    """rows that pass a test of computed columns, each computed once: below an explode_outer no filter is pushed."""
    return rows.withColumn("_kept", F.explode_outer(F.when(test, F.array(F.lit(True))))).filter("_kept").drop("_kept")


def _within_budget(rows: DataFrame, page: str) -> DataFrame:
    """rows of `_judged` with `admitted_by`: of paragraphs only the first PARAGRAPHS of a page, in order."""
    so_far = Window.partitionBy(page).orderBy("node_id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_p", F.count_if(F.col("_first") & (F.col("tag") == "p")).over(so_far))
    first = F.col("_first") & ((F.col("tag") != "p") | (F.col("_p") <= PARAGRAPHS))
    return rows.withColumn("admitted_by", F.when(first, "relevant").when(F.col("_second"), "value")).drop("_p", "_first", "_second")


def admitted(nodes: DataFrame, page: str = "page_id", mode: str = "visible", policy: dict[str, bool] | None = None) -> DataFrame:
    """Classified elements with `pos` and `admitted_by`: relevant ones, then containers whose own text holds a value.

    Rows are moved once, those that may be admitted only, to be counted and numbered page by page.
    """
    seen = named(nodes, page).filter(~F.col("hidden")) if mode == "visible" else named(nodes, page)
    able = _kept(_judged(seen, page, mode, policy), F.col("_first") | F.col("_second"))
    rows = _within_budget(able, page).filter("admitted_by is not null")
    pos = F.row_number().over(Window.partitionBy(page).orderBy(F.col("admitted_by") == "value", "node_id"))
    return rows.withColumns({"pos": pos, "element_id": F.concat(F.lit("element_"), pos.cast("string"))})


def _holdings(among: Column) -> list[Column]:
    """Counts of the elements `among` a page's rows, and of what they hold."""
    counts = {
        "elements": F.lit(True),
        "interactive": F.col("interactive"),
        "sensitive": F.col("level") == "sensitive",
        "potentially_sensitive": F.col("level") == "potentially_sensitive",
        "value_matched": F.size("values") > 0,
        "checksum_verified": F.exists("values", lambda h: h["confidence"] == "checksum"),
        "value_only": F.col("admitted_by") == "value",
    }
    return [F.count_if(among & test).alias(name) for name, test in counts.items()]


def snapshot_counts(nodes: DataFrame, elements: DataFrame, page: str = "page_id") -> DataFrame:
    """Counts of each page: relevant nodes found and visible, elements admitted, and what they hold."""
    found = nodes.filter(relevant()).groupBy(page).agg(F.count("*").alias("found"), F.count_if(~F.col("hidden")).alias("visible"))
    return found.join(elements.groupBy(page).agg(*_holdings(F.lit(True))), page, "left").na.fill(0)


def counted(nodes: DataFrame, page: str = "page_id", mode: str = "visible", policy: dict[str, bool] | None = None) -> DataFrame:
    """`snapshot_counts` of nodes and the elements admitted of them, in one pass over the nodes."""
    rows = _kept(_judged(named(nodes, page), page, mode, policy), F.col("relevant") | F.col("_second"))
    rows = _within_budget(rows.select(page, "node_id", "tag", "relevant", "hidden", "_first", "_second", "interactive", "level", "values"), page)
    found = [F.count_if("relevant").alias("found"), F.count_if(F.col("relevant") & ~F.col("hidden")).alias("visible")]
    return rows.groupBy(page).agg(*found, *_holdings(F.col("admitted_by").isNotNull())).filter("found > 0")


def snapshots(elements: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, elements): one nested row for each page, elements in order."""
    one = F.struct("pos", "element_id", "kind", "tag", "name", "interactive", "level", "categories", "selector")
    return elements.groupBy(page).agg(F.array_sort(F.collect_list(one)).alias("elements"))


def links(nodes: DataFrame, page: str = "page_id") -> DataFrame:
    return nodes.filter((F.col("tag") == "a") & F.map_contains_key("attrs", F.lit("href"))).select(page, "node_id", attr("href").alias("href"), "text")


def headings(nodes: DataFrame, page: str = "page_id") -> DataFrame:
    return nodes.withColumn("level", heading_level()).filter("level is not null").select(page, "node_id", "level", "text")


def signals(elements: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, element, category, via, confidence) of every signal of elements with an html id."""
    purpose = F.transform("purpose", lambda c: F.struct(c.alias("category"), F.lit("field-purpose").alias("via"), F.lit("keyword").alias("confidence")))
    value = F.transform("values", lambda h: F.struct(h["category"].alias("category"), F.lit("value").alias("via"), h["confidence"].alias("confidence")))
    control = F.transform("control", lambda h: F.struct(h["category"].alias("category"), F.lit("control-value").alias("via"), h["confidence"].alias("confidence")))
    rows = elements.filter(attr("id") != "").select(page, attr("id").alias("element"), F.explode(F.concat(purpose, value, control)).alias("s"))
    return rows.select(page, "element", "s.*")


#: What a chat's title is not, roles of things to choose, options shown.
NOT_TITLES = r"(?i)^(search|menu|mute|video|voice|online|offline|typing|chats|status|about)$"
STATUS = r"(?i)\b(last seen|online|typing|click here for contact info|tap here for contact info|click here for group info).*$"
CHOOSABLE = ("button", "link", "option", "radio", "listitem")
OPTIONS = 30


def choosers(nodes: DataFrame, page: str = "page_id", hops: int = 8) -> DataFrame:
    """(page, node_id): the first CHOOSERS cards that speak of something verified, moved to the nearest clickable element above."""
    card = F.col("tag").isin("div", "li", "article", "section", "label") | (attr("tabindex") == "0")
    says = F.length("text").between(6, 200) & F.col("text").rlike(r"(?i)\b(verified|unverified)\b")
    cards = nodes.filter(card & says & ~F.col("hidden")).select(page, F.col("node_id").alias("_card"), F.posexplode(F.slice(F.concat(F.array("node_id"), "ancestors"), 1, hops)).alias("_hop", "node_id"))
    click = nodes.filter(focusable() | role().isin(*CHOOSABLE) | F.map_contains_key("attrs", F.lit("onclick"))).select(page, "node_id", F.lit(True).alias("_click"))
    up = cards.join(click, [page, "node_id"], "left").groupBy(page, "_card").agg(F.min_by(F.when(F.col("_click"), F.col("node_id")), F.when(F.col("_click"), F.col("_hop"))).alias("_target"))
    targets = up.groupBy(page, F.coalesce("_target", "_card").alias("node_id")).agg(F.min("_card").alias("_first"))
    order = Window.partitionBy(page).orderBy("_first")
    return targets.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= CHOOSERS).select(page, "node_id")


def row_label() -> Column:
    """A short title for a list row: its first fitting span, its title, or its text; null for what is no list row."""
    titled = F.when(F.length(attr("title")).between(2, 80) & ~attr("title").rlike(r"(?i)\breacted\b"), F.substring(F.trim(F.get(F.split(normalize(attr("title")), "[.•·]"), 0)), 1, TITLE))
    return F.when(role().isin(*ROWS), F.coalesce(F.col("row_label"), empty_to_null(titled), empty_to_null(F.substring("text", 1, TITLE)), F.lit("")))


def conversation_labels(nodes: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, node_id, label): a short title for each list row."""
    return nodes.filter(role().isin(*ROWS)).select(page, "node_id", row_label().alias("label"))


def open_title(text: Column) -> Column:
    """A text as the title of an open chat; null for menus, phone numbers and what is too long or short."""
    name = F.trim(F.regexp_replace(F.regexp_replace(normalize(text), STATUS, ""), r"\s+", " "))
    digits = F.length(F.regexp_replace(name, "[^0-9]", ""))
    phone = digits.between(10, 15) & name.rlike(r"^\+?[\d\s().-]{8,22}$")
    odd = name.rlike(NOT_TITLES) | name.rlike(r"(?i)\b(search or start|type a message)\b")
    return F.when(F.length(name).between(2, TITLE) & ~phone & ~odd, name)


def open_conversations(nodes: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, candidates): distinct titles that the open chat may have: from the header of #main, then from the page's title."""
    main = nodes.filter(attr("id") == "main").groupBy(page).agg(F.min("node_id").alias("_main"))
    headers = nodes.filter(F.col("tag") == "header").join(main, page).filter(F.array_contains("ancestors", F.col("_main")))
    header = headers.groupBy(page).agg(F.min("node_id").alias("_header"))
    inside = nodes.join(header, page).filter(F.array_contains("ancestors", F.col("_header")))
    by_title = inside.filter(attr("title") != "").select(page, F.lit(0).alias("o"), "node_id", attr("title").alias("t"))
    by_text = inside.filter(F.col("tag").isin("span", "strong", "h1", "h2") | (role() == "heading")).select(page, F.lit(1).alias("o"), "node_id", F.col("text").alias("t"))
    page_title = F.regexp_replace(F.regexp_replace("direct_text", r"^\(\d+\)\s*", ""), r"\s*[-–|].*$", "")
    titles = nodes.filter(F.col("tag") == "title").select(page, F.lit(2).alias("o"), "node_id", page_title.alias("t"))
    rows = by_title.union(by_text).union(titles).withColumn("t", open_title(F.col("t"))).filter("t is not null")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("o", "node_id", "t"))), lambda x: x["t"])
    return rows.groupBy(page).agg(F.array_distinct(ordered).alias("candidates"))


def select_options(nodes: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, node_id, options): the first labels of each select, and how many more there are."""
    boxes = nodes.filter(F.col("tag") == "select").select(page, "node_id")
    options = nodes.filter(F.col("tag") == "option").select(page, F.col("node_id").alias("_o"), truncate(F.col("text"), 80).alias("_t"), F.explode("ancestors").alias("node_id"))
    held = options.join(boxes, [page, "node_id"], "left_semi").groupBy(page, "node_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "_t"))), lambda x: x["_t"]).alias("_all"))
    more = F.when(F.size("_all") > OPTIONS, F.array(F.concat(F.lit("… "), (F.size("_all") - OPTIONS).cast("string"), F.lit(" more options omitted")))).otherwise(F.array().cast("array<string>"))
    shown = F.concat(F.filter(F.slice("_all", 1, OPTIONS), lambda t: t != ""), more)
    return boxes.join(held.select(page, "node_id", shown.alias("options")), [page, "node_id"], "left")


#: The fields of an element that a planner may see.
OUTBOUND = ("element_id", "kind", "tag", "text", "placeholder", "name", "html_id", "aria_label", "role", "input_type", "autocomplete", "href", "interactive", "disabled", "has_value", "value_placeholder", "checked", "heading_level", "level", "categories", "options")


def compact_context(elements: DataFrame, page: str = "page_id") -> DataFrame:
    """(page, context): the allowed fields of a page's elements as JSON; missing and empty ones are left out."""
    fields = [f for f in OUTBOUND if f in elements.columns]
    kinds = dict(elements.dtypes)
    kept = [F.nullif(F.col(f), F.lit("")).alias(f) if kinds[f] == "string" else F.when(F.size(f) > 0, F.col(f)).alias(f) if kinds[f].startswith("array") else F.col(f) for f in fields]
    rows = elements.groupBy(page).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.to_json(F.struct(*kept)).alias("j")))), lambda x: x["j"]).alias("_e"))
    return rows.select(page, F.concat(F.lit('{"redacted":true,"elements":['), F.array_join("_e", ","), F.lit("]}")).alias("context"))


def element_hints(elements: DataFrame) -> DataFrame:
    """What a later turn needs to find elements again."""
    return elements.select("page_id", "pos", "element_id", "kind", F.substring(F.coalesce("text", F.lit("")), 1, 80).alias("text"))
