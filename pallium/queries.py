"""Registered queries over the standard tables, each beside its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pallium.functions import catalog, checksums, geometry, text
from pallium.functions.matchers import MATCHERS
from pallium.operators import boxes, elements, evaluate, leaks, ner, redact, spans
from pallium.plans import actions
from pallium.sources import html
from pallium.sources.tables import table
from pallium.streaming import sessions

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# SQL building blocks ---------------------------------------------------------------------------------------------

_WHITE = r"[\x{9}-\x{D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
_NORM = rf"trim(regexp_replace(coalesce(text, ''), '{_WHITE}+', ' ', 'g'))"
_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_CARD = r"\b\d(?:[\s-]?\d){12,18}\b"
_WORD = r"\p{L}+"
_LUHN = """(list_sum(list_transform(range(1, length(d) + 1), lambda i:
    CASE WHEN (length(d) - i) % 2 = 0 THEN CAST(d[i] AS INT)
         WHEN CAST(d[i] AS INT) > 4 THEN 2 * CAST(d[i] AS INT) - 9 ELSE 2 * CAST(d[i] AS INT) END)) % 10 = 0)"""


def _matches(pattern: str, name: str, scan: str = _NORM, source: str = "documents") -> str:
    """CTEs ending in `name` (doc_id, lang, source, start, length, raw): the pattern's matches with their places."""
    lens = lambda x: f"coalesce(list_sum(list_transform({x}, lambda s: length(s))), 0)"
    return f"""
        {name}_t AS (SELECT doc_id, lang, source, {scan} AS t FROM {source}),
        {name}_m AS (SELECT doc_id, lang, source, regexp_extract_all(t, '{pattern}') AS m, string_split_regex(t, '{pattern}') AS g FROM {name}_t),
        {name}_i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM {name}_m),
        {name} AS (SELECT doc_id, lang, source, CAST({lens('g[1:i]')} + {lens('m[1:i-1]')} AS INTEGER) AS start, CAST(length(m[i]) AS INTEGER) AS length, m[i] AS raw FROM {name}_i)"""


def _hits(scan: str = _NORM) -> str:
    """CTEs ending in `hits`: e-mail and card hits; in these texts no other identifiers occur, and these never overlap."""
    return f"""{_matches(_EMAIL, 'em', scan)}, {_matches(_CARD, 'ca', scan)},
        cd AS (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS d FROM ca),
        hits AS (SELECT doc_id, lang, source, 'email' AS category, 'structure' AS confidence, start, length, raw FROM em WHERE length(raw) <= 254
                 UNION ALL
                 SELECT doc_id, lang, source, 'payment_card', 'checksum', start, length, raw FROM cd WHERE length(d) BETWEEN 13 AND 19 AND {_LUHN})"""


# Texts -----------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, md5({_NORM}) AS digest, CAST(length({_NORM}) AS INTEGER) AS n FROM documents")
def normalize_text(spark, sf_dir):
    flat = text.normalize(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(flat).alias("digest"), F.length(flat).alias("n"))


@query(f"SELECT doc_id, CASE WHEN length({_NORM}) > 280 THEN substring({_NORM}, 1, 279) || '…' ELSE {_NORM} END AS short FROM documents")
def truncate_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.truncate(F.col("text")).alias("short"))


@query(f"SELECT lang, count(*) AS n, count(*) FILTER (length({_NORM}) > 4000) AS cut, CAST(sum(length(substring({_NORM}, 1, 4000))) AS BIGINT) AS scanned FROM documents GROUP BY lang")
def scan_window(spark, sf_dir):
    flat, part = text.normalize(F.col("text")), text.scan_window(F.col("text"))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(
        F.count("*").alias("n"), F.count_if(F.length(flat) > text.SCAN_LIMIT).alias("cut"), F.sum(F.length(part)).cast("long").alias("scanned")
    )


@query(r"SELECT doc_id, md5(regexp_replace(lower(text), '[^a-z0-9\x{900}-\x{97F}]', '', 'g')) AS digest FROM documents")
def compact_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.compact(F.col("text"))).alias("digest"))


@query("SELECT page_id, split_part(url, '#', 1) AS identity, regexp_matches(url, '^(https?|file):') AS injectable FROM pages")
def page_identity(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", F.split_part(url, F.lit("#"), F.lit(1)).alias("identity"), url.rlike("^(https?|file):").alias("injectable"))


# Detection -------------------------------------------------------------------------------------------------------


@query(f"WITH {_matches(_CARD, 'ca')} SELECT doc_id, start, length, raw FROM ca")
def card_candidates(spark, sf_dir):
    matcher = next(m for m in MATCHERS if m.category == "payment_card")
    loose = type(matcher)(matcher.category, matcher.confidence, matcher.pattern, matcher.normalise, lambda v: F.lit(True))
    hits = F.explode(spans.matches(text.scan_window(F.col("text"), None), loose, 0)).alias("h")
    return table(spark, sf_dir, "documents").select("doc_id", hits).select("doc_id", "h.start", "h.length", "h.raw")


@query(f"WITH {_hits()} SELECT doc_id, start, length, raw FROM hits WHERE category = 'payment_card'")
def card_hits(spark, sf_dir):
    return spans.matcher_hits(table(spark, sf_dir, "documents"), "doc_id", "payment_card", limit=None)


@query(f"WITH {_hits()} SELECT d.doc_id, count(h.start) AS n_cards FROM documents d LEFT JOIN hits h ON d.doc_id = h.doc_id AND category = 'payment_card' GROUP BY d.doc_id")
def cards_by_document(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = spans.find_values(F.col("text"), {c.id: c.id == "payment_card" for c in catalog.CATEGORIES}, scanned=True)
    return docs.select("doc_id", text.scan_window(F.col("text"), None).alias("text")).select("doc_id", F.size(found).cast("long").alias("n_cards"))


@query(f"WITH {_hits()} SELECT doc_id, start, length, raw FROM hits WHERE category = 'email'")
def email_hits(spark, sf_dir):
    return spans.matcher_hits(table(spark, sf_dir, "documents"), "doc_id", "email", limit=None)


@query(f"WITH {_hits()} SELECT split_part(raw, '@', 2) AS domain, count(*) AS n FROM hits WHERE category = 'email' GROUP BY 1 ORDER BY n DESC, domain LIMIT 10")
def email_domain_topk(spark, sf_dir):
    domain = F.split_part("raw", F.lit("@"), F.lit(2)).alias("domain")
    return email_hits(spark, sf_dir).groupBy(domain).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "domain").limit(10)


@query(f"""WITH {_matches(_CARD, 'ca')}, cd AS (SELECT *, regexp_replace(raw, '[^0-9]', '', 'g') AS d FROM ca)
    SELECT lang, count(*) AS candidates, count(*) FILTER ({_LUHN}) AS valid FROM cd GROUP BY lang""")
def luhn_stats(spark, sf_dir):
    digits = text.digits_only(F.col("raw"))
    rows = card_candidates(spark, sf_dir).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return rows.groupBy("lang").agg(F.count("*").alias("candidates"), F.count_if(checksums.luhn(digits)).alias("valid"))


@query(f"WITH {_hits()} SELECT doc_id, category, confidence, start, length, raw FROM hits")
def pii_spans_resolved(spark, sf_dir):
    return spans.spans(table(spark, sf_dir, "documents"), "doc_id", limit=None)


@query(f"WITH {_hits(_NORM)} SELECT doc_id, category, confidence, start, length, raw FROM hits")
def pii_spans_whole_text(spark, sf_dir):
    return spans.spans(table(spark, sf_dir, "documents"), "doc_id", limit=None)


def _span_rows(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    docs = docs.withColumn("text", text.scan_window(F.col("text"), None))
    return docs.select("doc_id", "lang", "source", F.explode(spans.find_values(F.col("text"), scanned=True)).alias("h")).select("doc_id", "lang", "source", "h.*")


def _count_query(name: str, column: str):
    @query(f"WITH {_hits()} SELECT {column}, count(*) AS hits, count(DISTINCT doc_id) AS documents FROM hits GROUP BY {column}")
    def run(spark, sf_dir):
        return _span_rows(spark, sf_dir).groupBy(column).agg(F.count("*").alias("hits"), F.count_distinct("doc_id").alias("documents"))

    QUERIES[name], ORACLE_SQL[name] = QUERIES.pop("run"), ORACLE_SQL.pop("run")


_count_query("pii_counts_by_category", "category")
_count_query("pii_counts_by_lang", "lang")
_count_query("pii_counts_by_source", "source")
_count_query("pii_counts_by_confidence", "confidence")


@query(f"WITH {_hits()} SELECT coalesce(category, 'overall') AS category, count(*) AS hits FROM hits GROUP BY GROUPING SETS ((category), ())")
def pii_category_rollup(spark, sf_dir):
    rows = _span_rows(spark, sf_dir).groupingSets([[F.col("category")], []], "category").agg(F.count("*").alias("hits"))
    return rows.select(F.coalesce("category", F.lit("overall")).alias("category"), "hits")


@query(f"WITH {_hits()} SELECT doc_id, category, start, length FROM hits WHERE category <> 'email'")
def policy_disabled_category(spark, sf_dir):
    policy = {c.id: c.id not in ("email", "upi") for c in catalog.CATEGORIES}  # without e-mail, its first half would pass for UPI
    return spans.spans(table(spark, sf_dir, "documents"), "doc_id", policy=policy, limit=None).select("doc_id", "category", "start", "length")


_VALUES = (
    "234567890124", "234567890123", "4111111111111111", "4111111111111112", "27AAPFU0939F1ZV", "27AAPFU0939F1ZW", "39AAPFU0939F1ZV",
    "ABCPE1234F", "ABCDE1234F", "SBIN0001234", "SBIN1001234", "123", "", "0", "00", "18", "6011000990139424", "378282246310005",
)
_VALUES_SQL = "(VALUES " + ", ".join(f"('{v}')" for v in _VALUES) + ") AS v(d)"


@query(f"""SELECT d AS value, (regexp_full_match(d, '[0-9]+') AND {_LUHN.replace('CAST(d[i] AS INT)', "coalesce(TRY_CAST(d[i] AS INT), 0)")}) AS luhn,
    (regexp_full_match(d, '[A-Z]{{3}}[ABCFGHJLPTK][A-Z][0-9]{{4}}[A-Z]')) AS pan, regexp_full_match(d, '[A-Z]{{4}}0[A-Z0-9]{{6}}') AS ifsc,
    (regexp_full_match(d, '[0-9A-Z]{{15}}') AND coalesce((36 - list_sum(list_transform(range(1, 15), lambda i:
        (CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END * (instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', d[i]) - 1)) // 36
        + (CASE WHEN i % 2 = 0 THEN 2 ELSE 1 END * (instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', d[i]) - 1)) % 36)) % 36) % 36 = instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', d[15]) - 1, false)) AS gstin_check
    FROM {_VALUES_SQL}""")
def identifier_validators(spark, sf_dir):
    rows = spark.createDataFrame([(v,) for v in _VALUES], "value string")
    v = F.col("value")
    return rows.select("value", checksums.luhn(v).alias("luhn"), checksums.pan(v).alias("pan"), checksums.ifsc(v).alias("ifsc"), checksums.gstin_check(v).alias("gstin_check"))


@query()
def verhoeff_validators(spark, sf_dir):
    """Every order key of twelve digits made from it, and whether it carries the check digit."""
    base = F.concat(F.lit("2"), F.lpad(F.col("o_orderkey").cast("string"), 11, "0"))
    return table(spark, sf_dir, "orders").select(base.alias("value"), checksums.aadhaar(base).alias("valid"))


_TEXTS = (
    (1, "password is hunter2, otp: 123456 and cvv 123", ""),
    (2, "cvv=123 security code: 9999", ""),
    (3, "Aadhaar 2345 6789 0124 or 2345-6789-0123", ""),
    (4, "GSTIN 27AAPFU0939F1ZV, PAN ABCPE1234F, IFSC SBIN0001234", ""),
    (5, "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSMeKKF and Bearer abcdefgh12345", ""),
    (6, "pay me@okbank or mail me@ok.example.com, call +91 98765 43210", ""),
    (7, "number ABC1234567", "voter card"),
    (8, "number ABC1234567", "nothing"),
    (9, "document K1234567", "passport"),
    (10, "आधार2345 6789 0124", ""),
    (11, "4111 1111 1111 1111", ""),
    (12, None, None),
)


@query()
def all_identifier_kinds(spark, sf_dir):
    rows = spark.createDataFrame(_TEXTS, "id int, text string, nearby string")
    hits = spans.find_values(F.col("text"), context=F.coalesce("nearby", F.lit("")))
    return rows.select("id", F.explode(hits).alias("h")).select("id", "h.category", "h.confidence", "h.start", "h.length", "h.raw")


@query(r"""SELECT id, category, start, length FROM (VALUES (7, 'voter_id', 7, 10), (9, 'passport', 9, 8)) AS v(id, category, start, length)""")
def corroborated_shapes(spark, sf_dir):
    return all_identifier_kinds(spark, sf_dir).filter("confidence = 'shape'").select("id", "category", "start", "length")


@query()
def category_dimension(spark, sf_dir):
    return catalog.table(spark)


@query()
def field_purposes(spark, sf_dir):
    """What common field labels announce."""
    labels = ["Password", "One-time code", "Security PIN", "Card number", "Name on card", "E-mail address", "Mobile", "Zip code", "zip file", "Job title", "Title", "Billing address", "IP address", "आधार संख्या", "Customer service phone", "Date of birth", "GST number", "Gender"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(labels)], "id int, label string")
    found = catalog.matching(F.lit(True), F.lit("text"), F.lit(""), F.col("label"))
    return rows.select("id", "label", F.array_join(found, ",").alias("categories"), catalog.level(found).alias("level"))


# Redaction -------------------------------------------------------------------------------------------------------

_MINT = f"""{_hits(_NORM)},
    tok AS (SELECT *, CASE category WHEN 'payment_card' THEN 'CARD' ELSE upper(category) END AS token FROM hits),
    fst AS (SELECT *, min(-start) OVER (PARTITION BY doc_id, category, raw) AS f FROM tok),
    minted AS (SELECT *, '<' || token || '_' || dense_rank() OVER (PARTITION BY doc_id, token ORDER BY f, category, raw) || '>' AS placeholder, (-start <> f) AS reused FROM fst)"""


def _redaction(spark, sf_dir) -> redact.Redaction:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("pos"), F.lit(0).alias("field_pos"), F.col("text").alias("value"))
    return redact.redact(rows, "doc_id")


@query(f"""WITH {_MINT}, o AS (SELECT *, coalesce(lag(start + length) OVER (PARTITION BY doc_id ORDER BY start), 0) AS prev FROM minted),
    p AS (SELECT doc_id, string_agg(substring(t, prev + 1, start - prev) || placeholder, '' ORDER BY start) AS head, max(start + length) AS last FROM o JOIN em_t USING (doc_id) GROUP BY doc_id)
    SELECT doc_id, md5(CASE WHEN head IS NULL THEN t ELSE head || substring(t, last + 1) END) AS digest FROM em_t LEFT JOIN p USING (doc_id)""")
def redacted_documents(spark, sf_dir):
    return _redaction(spark, sf_dir).texts.select("doc_id", F.md5("redacted").alias("digest"))


@query(f"WITH {_MINT} SELECT doc_id, start, category, placeholder, reused FROM minted")
def mint_placeholders(spark, sf_dir):
    return _redaction(spark, sf_dir).records.select("doc_id", "start", "category", "placeholder", "reused")


@query(f"WITH {_MINT} SELECT DISTINCT doc_id, placeholder, category, raw AS value FROM minted")
def vault_recoverable(spark, sf_dir):
    return _redaction(spark, sf_dir).vault


@query(f"""WITH {_MINT} SELECT doc_id, count(*) AS replacements, CAST(1 AS BIGINT) AS elements, count(DISTINCT placeholder) AS recoverable, count(DISTINCT placeholder) AS placeholders,
    count(*) FILTER (category = 'email') AS emails FROM minted GROUP BY doc_id""")
def redaction_summary(spark, sf_dir):
    out = redact.summary(_redaction(spark, sf_dir), "doc_id")
    return out.select("doc_id", "replacements", "elements", "recoverable", "placeholders", F.coalesce(F.col("categories")["email"], F.lit(0)).alias("emails"))


@query(f"WITH {_MINT} SELECT DISTINCT doc_id, placeholder, category, 'exact' AS kind FROM minted")
def leak_scan_exact(spark, sf_dir):
    """Every value of the vault is found in the texts before redaction."""
    docs = table(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("text"))
    return leaks.leaks(docs, _redaction(spark, sf_dir).vault, "doc_id")


@query(f"""WITH {_MINT} SELECT DISTINCT doc_id, placeholder, category, 'compact' AS kind FROM minted
    WHERE length(regexp_replace(lower(raw), '[^a-z0-9\\x{{900}}-\\x{{97F}}]', '', 'g')) >= 8""")
def leak_scan_compact(spark, sf_dir):
    """The same when each value's characters are set apart by blanks."""
    vault = _redaction(spark, sf_dir).vault
    apart = vault.groupBy("doc_id").agg(F.array_join(F.collect_list(F.array_join(F.split("value", ""), " ")), " / ").alias("text"))
    return leaks.leaks(apart, vault, "doc_id")


@query("SELECT 0 AS leaks, count(*) AS documents FROM documents")
def leak_scan_after_redaction(spark, sf_dir):
    """Redacted texts go out by way of the vault, as all do: values left there in another form are replaced, too."""
    done = _redaction(spark, sf_dir)
    # merged at any size, as it would be from some size on
    out = leaks.outbound(done.texts.select("doc_id", F.col("redacted").alias("text")).hint("merge"), done.vault, "doc_id")
    rows = out.select("doc_id", F.posexplode_outer("leaked").alias("at", "placeholder"))
    found = F.when(F.col("placeholder").isNotNull(), F.struct("doc_id", "placeholder"))
    return rows.agg(F.count_distinct(found).cast("int").alias("leaks"), F.count_if(F.coalesce("at", F.lit(0)) == 0).alias("documents"))


@query(f"""WITH {_MINT}, n AS (SELECT doc_id, count(*) AS replaced FROM minted GROUP BY doc_id)
    SELECT doc_id, 'ok' AS status, NOT (n.replaced IS NULL) AS changed FROM em_t LEFT JOIN n USING (doc_id)""")
def outbound_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", text.normalize(F.col("text")).alias("text"))
    out = leaks.outbound(docs, _redaction(spark, sf_dir).vault, "doc_id")
    return out.select("doc_id", "status", (F.col("safe") != F.col("text")).alias("changed"))


# Pages -----------------------------------------------------------------------------------------------------------

_TAGS = r"""t AS (SELECT page_id, unnest(regexp_extract_all(html, '<([a-z][a-z0-9]*)[ >]', 1)) AS tag FROM pages)"""


@query(f"WITH {_TAGS} SELECT page_id, tag, count(*) AS n FROM t GROUP BY page_id, tag")
def html_tag_counts(spark, sf_dir):
    return html.nodes(table(spark, sf_dir, "pages")).groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@query(f"""WITH {_TAGS} SELECT page_id, CASE WHEN tag = 'a' THEN 'link' WHEN regexp_full_match(tag, 'h[1-6]') THEN 'heading' WHEN tag = 'img' THEN 'image' ELSE 'text' END AS kind, count(*) AS n
    FROM t GROUP BY ALL""")
def element_kinds(spark, sf_dir):
    return html.nodes(table(spark, sf_dir, "pages")).groupBy("page_id", elements.kind().alias("kind")).agg(F.count("*").alias("n"))


@query(r"SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages")
def html_links(spark, sf_dir):
    return elements.links(html.nodes(table(spark, sf_dir, "pages"))).select("page_id", "href")


@query(r"SELECT page_id, 1 AS level, unnest(regexp_extract_all(html, '<h1>')) IS NOT NULL AS found FROM pages")
def html_headings(spark, sf_dir):
    return elements.headings(html.nodes(table(spark, sf_dir, "pages"))).select("page_id", "level", F.lit(True).alias("found"))


def _elements(spark, sf_dir) -> DataFrame:
    return elements.admitted(html.nodes(table(spark, sf_dir, "pages")))


@query()
def admitted_elements(spark, sf_dir):
    return _elements(spark, sf_dir).select("page_id", "pos", "element_id", "kind", "tag", "name", "interactive", "heading_level", "level", F.array_join("categories", ",").alias("categories"))


@query()
def snapshot_counts(spark, sf_dir):
    return elements.counted(html.nodes(table(spark, sf_dir, "pages")))


@query()
def page_snapshots(spark, sf_dir):
    return elements.snapshots(_elements(spark, sf_dir)).select("page_id", F.size("elements").alias("n"), F.to_json("elements").alias("elements"))


_FORM = (
    '<form><label for="m">E-mail</label><input id="m" type="email" value="a@b.example"><div>Phone</div><div><input id="p" type="tel"></div>'
    '<label>Name <input id="n" name="full_name"></label><table><tr><td>PAN</td><td><input id="t" value="ABCPE1234F"></td></tr></table>'
    '<input id="s" type="password" value="x"><input type="hidden" value="csrf"><p id="v">Card 4111 1111 1111 1111 is on file for you</p>'
    '<div hidden><span id="h">a@b.example</span></div><span id="w">a@b.example</span><button id="b">Send</button></form>'
)


@query()
def accessible_names(spark, sf_dir):
    page = spark.createDataFrame([(1, _FORM)], "page_id long, html string")
    found = elements.admitted(html.nodes(page))
    return found.select(elements.attr("id").alias("html_id"), "kind", "name", "nearby", F.array_join("categories", ",").alias("categories"), "level", "admitted_by")


@query()
def element_signals(spark, sf_dir):
    page = spark.createDataFrame([(1, _FORM)], "page_id long, html string")
    return elements.signals(elements.admitted(html.nodes(page)))


# Evaluation ------------------------------------------------------------------------------------------------------


def _outcomes(spark, sf_dir) -> DataFrame:
    """Outcomes of two plain rules against the labels: signs in a row for low quality, and a list of insults for toxic."""
    docs = table(spark, sf_dir, "documents")
    rules = {"low_quality": F.col("text").rlike(_JUNK), "toxic": F.lower("text").rlike(_INSULT)}
    rows = [docs.filter(rule).select(F.col("doc_id").alias("page"), F.lit("").alias("element"), F.lit(c).alias("category"), F.lit("rule").alias("via"), F.lit("keyword").alias("confidence")) for c, rule in rules.items()]
    predictions = reduce(DataFrame.union, rows)
    labels = table(spark, sf_dir, "labels")
    truth = [labels.filter(test).select(F.col("doc_id").alias("page"), F.lit("").alias("element"), F.lit(c).alias("category"), F.lit("rule").alias("via"), F.lit("keyword").alias("confidence")) for c, test in (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))]
    judged = predictions.join(labels.select(F.col("doc_id").alias("page")), "page", "left_semi")
    return evaluate.scored(judged, reduce(DataFrame.union, truth))


_JUNK = r"!!|%%%|\$\$\$|\*\*\*|###"
_INSULT = r"\b(?:idiot|moron|clown|worthless|stupid|trash|loser|scum)\b"
_OUTCOMES = f"""
    p AS (SELECT l.doc_id, 'low_quality' AS category, regexp_matches(text, '{_JUNK}') AS p, quality = 0 AS t FROM labels l LEFT JOIN documents d USING (doc_id)
          UNION ALL SELECT l.doc_id, 'toxic', regexp_matches(lower(text), '{_INSULT}'), toxic = 1 FROM labels l LEFT JOIN documents d USING (doc_id)),
    c AS (SELECT coalesce(category, 'overall') AS category, count(*) FILTER (p AND t) AS tp, count(*) FILTER (p AND NOT t) AS fp, count(*) FILTER (t AND NOT coalesce(p, false)) AS fn
          FROM p WHERE p OR t GROUP BY GROUPING SETS ((category), ())),
    r AS (SELECT *, CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END AS pr, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END AS re FROM c),
    m AS (SELECT category, tp, fp, fn, round(CAST(pr AS DOUBLE), 4) AS precision, round(CAST(re AS DOUBLE), 4) AS recall, round(CAST(CASE WHEN pr + re = 0 THEN 0.0 ELSE 2 * pr * re / (pr + re) END AS DOUBLE), 4) AS f1 FROM r)"""


@query(f"WITH {_OUTCOMES} SELECT * FROM m WHERE category <> 'overall'")
def pr_f1_by_category(spark, sf_dir):
    return evaluate.metrics(_outcomes(spark, sf_dir), "category")


@query(f"WITH {_OUTCOMES} SELECT * FROM m")
def pr_f1_with_overall(spark, sf_dir):
    return evaluate.by_category_and_overall(_outcomes(spark, sf_dir))


@query(f"""WITH {_OUTCOMES}, b(category, fp, fn, f1) AS (VALUES ('toxic', 0, 0, 1.0), ('low_quality', 0, 1000000, 0.1), ('gone', 0, 0, 1.0))
    SELECT category, CASE WHEN b.f1 IS NULL THEN 'new' WHEN m.f1 IS NULL THEN 'missing'
        WHEN round(m.f1 - b.f1, 4) < -0.0005 OR m.fp > b.fp OR m.fn > b.fn THEN 'worse' WHEN round(m.f1 - b.f1, 4) > 0.0005 THEN 'better' ELSE 'same' END AS status
    FROM m FULL JOIN b USING (category)""")
def baseline_gate(spark, sf_dir):
    stored = spark.createDataFrame([("toxic", 0, 0, 1.0), ("low_quality", 0, 1000000, 0.1), ("gone", 0, 0, 1.0)], "category string, fp long, fn long, f1 double")
    return evaluate.gate(pr_f1_with_overall(spark, sf_dir), stored).select("category", "status")


# Entities --------------------------------------------------------------------------------------------------------


@query("""WITH RECURSIVE w AS (
        SELECT doc_id, text AS t, 0 AS chunk, 0 AS off FROM documents WHERE length(text) > 0
        UNION ALL
        SELECT doc_id, t, chunk + 1, CAST(CASE WHEN e - 160 > off THEN e - 160 ELSE e END AS INTEGER) FROM (SELECT *, {end} AS e FROM w) WHERE e < length(t))
    SELECT doc_id, chunk, off AS \"offset\", md5(substring(t, off + 1, {end} - off)) AS digest FROM w""".replace("{end}", """(CASE WHEN off + 1200 >= length(t) THEN length(t)
        WHEN strpos(reverse(substring(t, off + 902, 300)), ' ') > 0 THEN off + 1201 - strpos(reverse(substring(t, off + 902, 300)), ' ') ELSE off + 1200 END)"""))
def chunk_windows(spark, sf_dir):
    return ner.chunked(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "chunk", "offset", F.md5("text").alias("digest"))


_NAMES = ("the", "and", "of", "der", "die", "que", "la")
_TOKENS = f"""{_matches(_WORD, 'wd', 'text')},
    k AS (SELECT *, raw IN {_NAMES} AS known FROM wd),
    b AS (SELECT *, known AND NOT coalesce(lag(known) OVER (PARTITION BY doc_id ORDER BY start), false) AS starts FROM k),
    i AS (SELECT *, sum(CASE WHEN starts OR NOT known THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY start) AS island FROM b),
    e AS (SELECT doc_id, min(start) AS start, max(start + length) - min(start) AS length FROM i WHERE known GROUP BY doc_id, island)"""


@query(f"WITH {_TOKENS} SELECT doc_id, start, CAST(length AS INTEGER) AS length FROM e")
def bio_islands(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("text_id"), "text")
    found = ner.entity_groups(ner.gazetteer_tokens(docs, list(_NAMES)), docs)
    return found.select(F.col("text_id").alias("doc_id"), "start", "length")


_ENTITIES = ((1, "person_name", 0, 5, 0.95), (1, "person_name", 0, 5, 0.97), (1, "person_name", 0, 9, 0.92), (1, "address", 2, 3, 0.99), (1, "person_name", 12, 4, 0.91), (2, "person_name", 0, 5, 0.95))


@query(f"""WITH e(text_id, category, start, length, score) AS (VALUES {', '.join(map(str, _ENTITIES))}),
    b AS (SELECT text_id, category, start, length, max(CAST(score AS DOUBLE)) AS score FROM e GROUP BY ALL)
    SELECT * FROM b WHERE NOT EXISTS (SELECT 1 FROM b o WHERE o.text_id = b.text_id AND o.category = b.category AND o.start <= b.start
        AND o.start + o.length >= b.start + b.length AND o.length > b.length)""")
def merge_entities(spark, sf_dir):
    return ner.merged(spark.createDataFrame(_ENTITIES, "text_id int, category string, start int, length int, score double"))


@query()
def pack_texts(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), F.concat(F.lit("t"), F.col("turn").cast("string")).alias("key"), "text")
    packs = ner.packed(turns, "conv_id")
    return packs.select("conv_id", "pack", F.length("text").alias("n"), F.to_json("members").alias("members"))


# Boxes: an order is an image of 2000 x 1000, its lines are detections ----------------------------------------------


def _boxes(spark, sf_dir) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    box = geometry.box(F.col("l_partkey") % 1900, F.col("l_suppkey") * 7 % 950, F.col("l_quantity") * 9, F.col("l_quantity") * 5)
    category = F.when(F.col("l_linestatus") == "F", "payment_card").otherwise("email")
    return line.select(
        F.col("l_orderkey").alias("image_id"), F.col("l_linenumber").alias("seq"), category.alias("category"), F.lit("dom").alias("source"),
        F.when(F.col("l_returnflag") == "R", "black").otherwise("pixelate").alias("policy"), (F.col("l_discount") * 10).alias("confidence"), box.alias("box"),
    )


_BOX = """b AS (SELECT l_orderkey AS image_id, l_linenumber AS seq, l_linestatus = 'F' AS high, l_partkey % 1900 AS x, l_suppkey * 7 % 950 AS y, l_quantity * 9 AS w, l_quantity * 5 AS h FROM lineitem)"""


@query(f"""WITH {_BOX}, p AS (SELECT *, CASE WHEN high THEN greatest(w * 0.12, 8) ELSE greatest(w * 0.07, 5) END AS px, CASE WHEN high THEN greatest(h * 0.12, 8) ELSE greatest(h * 0.07, 5) END AS py FROM b),
    c AS (SELECT image_id, seq, greatest(0, floor(x - px)) AS x0, greatest(0, floor(y - py)) AS y0, least(2000, ceil(x - px + w + 2 * px)) AS x1, least(1000, ceil(y - py + h + 2 * py)) AS y1 FROM p)
    SELECT image_id, seq, CAST(x0 AS BIGINT) AS x, CAST(y0 AS BIGINT) AS y, CAST(x1 - x0 AS BIGINT) AS width, CAST(y1 - y0 AS BIGINT) AS height FROM c WHERE x1 > x0 AND y1 > y0""")
def box_pad_clamp(spark, sf_dir):
    padded = geometry.pad(F.col("box"), F.col("category"), F.lit(2000), F.lit(1000))
    rows = _boxes(spark, sf_dir).select("image_id", "seq", padded.alias("b")).filter("b is not null")
    return rows.select("image_id", "seq", *(F.col(f"b.{k}").cast("long").alias(k) for k in ("x", "y", "width", "height")))


@query(f"""WITH {_BOX}, i AS (SELECT a.image_id, a.seq AS a, b.seq AS b, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS inter,
    a.w * a.h AS s, b.w * b.h AS t FROM b a JOIN b b ON a.image_id = b.image_id AND a.seq < b.seq)
    SELECT image_id, a, b, round(inter / (s + t - inter), 6) AS iou FROM i WHERE inter > 0""")
def iou_pairs(spark, sf_dir):
    rows = _boxes(spark, sf_dir)
    a, b = rows.select("image_id", F.col("seq").alias("a"), F.col("box").alias("p")), rows.select("image_id", F.col("seq").alias("b"), F.col("box").alias("q"))
    pairs = a.join(b, "image_id").filter("a < b").withColumn("iou", F.round(geometry.iou(F.col("p"), F.col("q")), 6))
    return pairs.filter("iou > 0").select("image_id", "a", "b", "iou")


@query()
def nms(spark, sf_dir):
    kept = boxes.non_maximum_suppression(_boxes(spark, sf_dir))
    return kept.select("image_id", "seq", "category", "confidence")


@query()
def merged_boxes(spark, sf_dir):
    return boxes.merged(_boxes(spark, sf_dir)).select("image_id", "category", "n", *(F.col(f"box.{k}").alias(k) for k in ("x", "y", "width", "height")))


@query("""SELECT l_orderkey AS image_id, count(*) AS detections, count(*) FILTER (l_returnflag = 'R') AS black_regions, count(*) FILTER (l_linestatus = 'F') AS cards FROM lineitem GROUP BY l_orderkey""")
def manifest_counts(spark, sf_dir):
    out = boxes.manifest(_boxes(spark, sf_dir))
    return out.select("image_id", "detections", "black_regions", F.coalesce(F.col("categories")["payment_card"], F.lit(0)).alias("cards"))


@query("""WITH p AS (SELECT p_partkey, p_size * 100 AS total FROM part)
    SELECT p_partkey, CASE WHEN total <= 1280 THEN '0' ELSE array_to_string(list_distinct(list_concat(list_filter(range(0, total + 1, 960), lambda s: s < total - 1280), [total - 1280])).list_sort(), ',') END AS starts FROM p""")
def tile_starts(spark, sf_dir):
    starts = geometry.tile_starts(F.col("p_size") * 100, 1280)
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(starts), ",").alias("starts"))


# Plans and sessions ----------------------------------------------------------------------------------------------

_PLANS = (
    ("s1", 1, '```json\n{"actions":[{"type":"fill","elementId":"element_1","text":"<EMAIL_1>"},{"type":"click","elementId":2}],"done":false}\n```', "sign in with my mail"),
    ("s1", 2, '{"actions":[{"action":"type","id":"user","value":"alice"},{"type":"press","elementId":"element_1","key":"Enter"}]}', "log in as alice"),
    ("s1", 3, '{"actions":[{"type":"fill","elementId":"element_3","text":"alice"}]}', "log in as alice"),
    ("s2", 1, '{"actions":[{"type":"hack"}]}', "x"),
    ("s2", 2, '{"actions":[],"extra":1}', "x"),
    ("s2", 3, "no json", "x"),
    ("s2", 4, '{"actions":[{"type":"wait","ms":"9000"},{"type":"scroll","y":300},{"type":"done","reason":"ok"}],"done":true}', "x"),
    ("s2", 5, '{"actions":[{"type":"scroll","y":9000},{"type":"click","elementId":"element_77"}]}', "x"),
)
_PAGE = (("element_1", "user", "user", "User", "username"), ("element_2", "go", "go", "Sign in", None), ("element_3", "pw", "pw", "Password", "password"))


def _plans(spark):
    plans = actions.parsed(spark.createDataFrame(_PLANS, "session_id string, turn int, raw string, goal string"))
    page = spark.createDataFrame(_PAGE, "element_id string, name string, html_id string, text string, category string")
    return plans, plans.select("session_id", "turn").join(F.broadcast(page), F.lit(True))  # a page of three elements


@query()
def plan_parsing(spark, sf_dir):
    return _plans(spark)[0].select("session_id", "turn", "done", "error", F.coalesce(F.size("actions"), F.lit(0)).alias("n"))


@query()
def plan_validation(spark, sf_dir):
    plans, page = _plans(spark)
    rows = actions.validated(actions.actions(plans), page)
    return rows.select("session_id", "turn", "idx", "type", "element_id", "ms", "status", "error")


@query()
def plan_statuses(spark, sf_dir):
    plans, page = _plans(spark)
    return actions.plan_status(actions.validated(actions.actions(plans), page))


_ISLANDS = """o AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS turn, ts, event_type AS f, event_type = 'error' AS blocks FROM events),
    g AS (SELECT *, CASE WHEN f IS DISTINCT FROM lag(f) OVER w OR turn = 1 THEN 1 ELSE 0 END AS new FROM o WINDOW w AS (PARTITION BY session_id ORDER BY turn)),
    i AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY turn) AS island FROM g),
    r AS (SELECT *, row_number() OVER (PARTITION BY session_id, island ORDER BY turn) - 1 AS repeat FROM i)"""


def _turns(spark, sf_dir) -> DataFrame:
    return sessions.turns_of_events(table(spark, sf_dir, "events"))


@query(f"WITH {_ISLANDS} SELECT session_id, CAST(turn AS INTEGER) AS turn, CAST(repeat AS INTEGER) AS repeat FROM r")
def repeated_plan_islands(spark, sf_dir):
    return sessions.repeats(_turns(spark, sf_dir)).select("session_id", "turn", "repeat")


@query(f"WITH {_ISLANDS} SELECT session_id, CAST(turn AS INTEGER) AS turn, f AS fingerprint FROM r WHERE new = 1")
def change_only_emission(spark, sf_dir):
    return sessions.changes(_turns(spark, sf_dir), "session_id", "turn", "fingerprint").select("session_id", "turn", "fingerprint")


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM conversations) SELECT conv_id, turn, role, CAST(back AS INTEGER) AS back FROM r WHERE back <= 4""")
def turn_history_window(spark, sf_dir):
    return sessions.last_turns(table(spark, sf_dir, "conversations"), "conv_id", 4).select("conv_id", "turn", "role", "back")


_REPLAY = f"""{_ISLANDS},
    t AS (SELECT *, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap, coalesce(lag(blocks) OVER w, false) AS parked FROM r WINDOW w AS (PARTITION BY session_id ORDER BY turn)),
    s AS (SELECT *, floor(sum(CASE WHEN parked THEN 0 ELSE coalesce(gap, 0) END) OVER w / 1000) AS running_ms, sum(CAST(blocks AS INT)) OVER w AS gates, CASE WHEN parked THEN coalesce(gap, 0) ELSE 0 END AS park
          FROM t WINDOW w AS (PARTITION BY session_id ORDER BY turn)),
    e AS (SELECT *, CASE WHEN park > 600000000 THEN 'gave_up' WHEN repeat >= 2 THEN 'repeated' WHEN turn > 12 THEN 'too_many_turns' WHEN running_ms > 90000 THEN 'timed_out' WHEN gates > 5 THEN 'too_many_gates' END AS final FROM s),
    f AS (SELECT *, first_value(final IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ended FROM e)"""


@query(f"WITH {_REPLAY} SELECT session_id, CAST(turn AS INTEGER) AS turn, coalesce(ended, CASE WHEN blocks THEN 'parked' ELSE 'running' END) AS state, CAST(running_ms AS BIGINT) AS running_ms FROM f")
def session_state_machine(spark, sf_dir):
    return sessions.replay(_turns(spark, sf_dir)).select("session_id", "turn", "state", "running_ms")


@query("""SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS started, event_type, count(*) AS n FROM events GROUP BY ALL""")
def event_windows(spark, sf_dir):
    return sessions.windowed_counts(table(spark, sf_dir, "events")).select(F.col("window.start").alias("started"), "event_type", "n")


@query(f"WITH {_hits()}, u AS (SELECT doc_id, category FROM hits) SELECT coalesce(category, 'unknown') AS category, count(*) AS n FROM documents d LEFT JOIN u USING (doc_id) GROUP BY 1")
def count_by_category(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(_span_rows(spark, sf_dir).select("doc_id", "category"), "doc_id", "left")
    return evaluate.count_by(rows, "category").withColumnRenamed("count", "n")
