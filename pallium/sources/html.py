"""HTML pages as a table of element nodes, parsed a page at a time in Arrow batches.

There is no layout: boxes are the stub's, and visibility follows hidden attributes, inline styles and closed details.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without content; elements that a start tag closes when they are open.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {
    "p": frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
}
#: An open element beyond which a start tag closes nothing.
FENCE = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "td": {"table"}, "th": {"table"}, "tr": {"table"}, "option": {"select"}, "p": set()}
UNSEEN = frozenset(["script", "style", "head", "title", "meta", "template", "noscript"])
_HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

#: Controls; longest label near one and levels looked through for it; roles of list rows, longest title of
#: one, and what is none (over texts with ASCII capitals made small).
CONTROLS = ("input", "select", "textarea")
LABEL, HOPS = 80, 6
ROWS = ("listitem", "row", "option", "gridcell")
TITLE = 48
_PREVIEW = re.compile(r"\breacted\b|^(yesterday|today|monday|tuesday|wednesday|thursday|friday|saturday|sunday)$|^[0-9]{1,2}:[0-9]{2}")
_SMALL = {k: k + 32 for k in range(65, 91)}

SCHEMA = (
    "node_id int, parent_id int, depth int, sib_idx int, tag string, attrs map<string,string>, "
    "ancestors array<int>, ancestor_tags array<string>, direct_text string, text string, hidden boolean, holds_control boolean, "
    "before string, nearby string, labelledby string, labels string, wrap string, row_label string"
)


class _Node:
    __slots__ = ("id", "parent", "sib", "tag", "attrs", "direct", "start", "end", "hidden", "kids", "control")

    def __init__(self, id, parent, tag, attrs, start, hidden):
        self.id, self.parent, self.tag, self.attrs, self.start, self.hidden = id, parent, tag, attrs, start, hidden
        self.direct, self.end, self.kids, self.control = [], start, 0, False
        self.sib = parent.kids if parent else 0


class Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.nodes: list[_Node] = []
        self.open: list[_Node] = []
        self.seen: list[str] = []  # visible text in order
        self.size = 0
        self.split = True  # whether a tag or comment came since the last text

    def handle_comment(self, data):
        self.split = True

    def handle_starttag(self, tag, attrs):
        for open_tag, by in CLOSES.items():
            if tag in by:
                self._close(open_tag, FENCE[open_tag])
        self.split = True
        values = {k: v or "" for k, v in attrs}
        above = self.open[-1] if self.open else None
        shut = above is not None and above.tag == "details" and "open" not in above.attrs and tag != "summary"
        own = "hidden" in values or values.get("type", "").lower() == "hidden" or tag in UNSEEN or bool(_HIDDEN_STYLE.search(values.get("style", "")))
        node = _Node(len(self.nodes), above, tag, values, self.size, own or shut or bool(above and above.hidden))
        if above:
            above.kids += 1
        self.nodes.append(node)
        if tag in ("input", "select", "textarea", "button"):
            for up in self.open:
                up.control = True
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1].tag == tag:
            self.open.pop().end = self.size

    def _close(self, tag, fence):
        self.split = True
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k].tag == tag:
                for node in self.open[k:]:
                    node.end = self.size
                del self.open[k:]
                return
            if self.open[k].tag in fence:
                return

    def handle_endtag(self, tag):
        self._close(tag, ())

    def handle_data(self, data):
        if not self.open:
            return
        if self.open[-1].direct and not self.split:
            self.open[-1].direct[-1] += data  # one run of text may come in parts
        else:
            self.open[-1].direct.append(data)
        self.split = False
        if self.open[-1].tag not in UNSEEN:
            self.seen.append(data)
            self.size += len(data)

    def rows(self):
        for node in self.open:
            node.end = self.size
        text = "".join(self.seen)
        # the page's own containers would only repeat its whole text
        inner = ["" if n.tag in ("html", "body") else " ".join(text[n.start : n.end].split()) for n in self.nodes]
        direct = [" ".join(" ".join(n.direct).split()) for n in self.nodes]
        chains = []
        for n in self.nodes:
            up, chain = n.parent, []
            while up:
                chain.append(up)
                up = up.parent
            chains.append(chain)
        for n, chain, own, whole, said in zip(self.nodes, chains, direct, inner, self._said(chains, direct, inner)):
            yield (
                n.id, n.parent.id if n.parent else None, len(chain), n.sib, n.tag, list(n.attrs.items()), [u.id for u in chain], [u.tag for u in chain],
                own, whole, n.hidden, n.control, *said,
            )

    def _said(self, chains, direct, inner):
        """What other nodes of the page say about each: (before, nearby, labelledby, labels, wrap, row_label)."""
        before, short, last, last_short = [], [], {}, {}  # by node; then of each parent's children so far
        by_id, marks, row_labels = {}, {}, {}
        for n, chain, own, whole in zip(self.nodes, chains, direct, inner):
            above = n.parent.id if n.parent else None
            before.append(last.get(above, ""))
            short.append(last_short.get(above) if n.parent else None)
            last[above] = own
            if whole and len(whole) <= LABEL and not n.control and n.tag not in CONTROLS and n.tag != "button":
                last_short[above] = whole
            if n.attrs.get("id"):
                by_id.setdefault(n.attrs["id"], whole)
            if n.tag == "label" and n.attrs.get("for") and whole:
                marks.setdefault(n.attrs["for"], []).append(whole)
            if n.tag in ("span", "strong") and 2 <= len(whole) <= TITLE and not _PREVIEW.search(whole.translate(_SMALL)):
                for up in chain:
                    if up.attrs.get("role", "").lower() in ROWS:
                        row_labels.setdefault(up.id, whole)
        for n, chain in zip(self.nodes, chains):
            nearby = labelledby = labels = wrap = None
            control = n.tag in CONTROLS
            if control or n.attrs.get("contenteditable", "false").lower() != "false":
                nearby = next((short[u.id] for u in [n, *chain[: HOPS - 1]] if u.tag not in ("body", "html") and short[u.id] is not None), None)
            if n.attrs.get("aria-labelledby"):
                named = [by_id[ref] for ref in re.split(r"[ \t\n\v\f\r]+", n.attrs["aria-labelledby"]) if by_id.get(ref)]
                labelledby = " ".join(named) if named else None
            if control:
                of = marks.get(n.attrs.get("id"))
                labels = " ".join(of) if of else None
                wrap = next((inner[u.id] for u in chain if u.tag == "label"), None)
            yield before[n.id], nearby, labelledby, labels, wrap, row_labels.get(n.id)


def parse(html: str | None) -> list[tuple]:
    builder = Builder()
    builder.feed(html or "")
    builder.close()
    return list(builder.rows())


def nodes(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id_col, node columns) of every element of every page; null pages have none."""
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.map_(pa.string(), pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.string(), pa.string(), pa.bool_(), pa.bool_(), *[pa.string()] * 6]
    names = ["id", *(part.split()[0] for part in SCHEMA.split(", "))]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                owner, rows = [], []
                for k, html in enumerate(part.column(1).to_pylist()):
                    found = parse(html)
                    owner += [k] * len(found)
                    rows += found
                columns = list(zip(*rows)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(owner, pa.int64())), *(pa.array(c, t) for c, t in zip(columns, kinds))], names)

    kind = pages.schema[id_col].dataType.simpleString()
    out = pages.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInArrow(run, f"id {kind}, {SCHEMA}")
    return out.withColumnRenamed("id", id_col)
