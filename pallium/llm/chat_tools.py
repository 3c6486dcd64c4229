"""Tool-call linking in chats, with DataFrame functions only.

Calls meet their results by (conversation, call id) in a hash join; calls that refer to other calls' results are
ordered topologically; arguments are validated against schemas; messages become canonical JSON (sorted keys, no
blanks), by way of the variant type, whose objects hold their keys in order.

Order: a call that refers to one other call points at it.  Such pointers are doubled, each round joining them with
themselves, so a chain of n calls takes log2(n) rounds; only calls that refer to several others are then taken one
after another, by rounds over what the chains between them came to.

Defined results: a call without result is `unanswered`, a result without call `orphan`; of several results the
first by turn links and the rest are counted; repeated calls all link; arguments that do not parse, repeat a key or
are not a JSON object are invalid, each with its own cause, and what is no valid JSON stays in the message as a
string; null arguments count as {}; a reference to an unknown call is an error of the call and orders nothing; calls on
or behind a cycle have a null depth.  Null conversations and call ids link with nothing.  Arguments of any length are
read whole; empty tables give no row; other columns are not read.
"""

from __future__ import annotations

import json as _json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pallium.llm.common import saved

#: What a value has to be: a type as schema_of_variant names it (BIGINT also takes 1.0, DOUBLE any number), a dict of
#: fields for an object, a list of one kind for an array, or a frozenset of the values that are allowed.
Kind = "str | dict[str, tuple[Kind, bool]] | list | frozenset"
#: By tool: argument, its kind, and whether it is required.
Schemas = dict[str, dict[str, tuple]]
KEY = ["conv_id", "call_id"]
REFERENCE = "$result:"
#: A string value of canonical JSON that refers to a call; keys have a colon behind them, quotes inside strings a backslash before them.
_REFERENCE = r'(?<=[:\[,])"\$result:((?:[^"\\]|\\.)*)"(?=[,\]}])'
_WHOLE = ("BIGINT", "DECIMAL", "DOUBLE", "FLOAT")


def canonical(json: Column) -> Column:
    """Canonical JSON of a JSON text; null where it doesn't parse or repeats a key."""
    return F.to_json(F.try_parse_json(json))


def _kind(value: Column) -> Column:
    return F.regexp_extract(F.schema_of_variant(value), "^[A-Z]+", 0)


def _wrong(value: Column, wanted, path: str) -> list[Column]:
    """Arrays of what is wrong with a value; each is null or empty where nothing is."""
    kind = _kind(value)
    name = path or "value"
    if isinstance(wanted, str):
        number = F.try_variant_get(value, "$", "double")
        fits = kind == wanted
        if wanted == "BIGINT":
            fits = fits | (kind.isin(*_WHOLE) & (number == F.floor(number)))
        if wanted == "DOUBLE":
            fits = kind.isin(*_WHOLE)
        return [F.when(~F.coalesce(fits, F.lit(False)), F.array(F.concat(F.lit(f"{name} is "), kind, F.lit(f", not {wanted}"))))]
    if isinstance(wanted, frozenset):
        listed = sorted(_json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False) for v in wanted)
        return [F.when(~F.to_json(value).isin(*listed), F.array(F.concat(F.lit(f"{name} is "), F.to_json(value), F.lit(f", not one of {', '.join(listed)}"))))]
    if isinstance(wanted, list):
        inside = F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v: F.flatten(_filled(_wrong(v, wanted[0], f"{path}[]"))))
        return [F.when(kind != "ARRAY", F.array(F.concat(F.lit(f"{name} is "), kind, F.lit(", not ARRAY")))).otherwise(F.array_distinct(F.flatten(inside)))]
    keys = F.json_object_keys(F.to_json(value))
    spare = F.array_except(keys, F.array(*map(F.lit, sorted(wanted))) if wanted else F.array().cast("array<string>"))
    prefix = f"{path}." if path else ""
    checks = []
    for field, (kind_of, required) in sorted(wanted.items()):
        given = F.array_contains(keys, field)
        if required:
            checks.append(F.when(~given, F.array(F.lit(f"missing {prefix}{field}"))))
        inner = F.try_variant_get(value, f'$["{field}"]', "variant")
        checks += [F.when(given, w) for w in _wrong(inner, kind_of, prefix + field)]
    checks.append(F.when(F.size(spare) > 0, F.array(F.concat(F.lit("unknown "), F.array_join(F.transform(F.array_sort(spare), lambda k: F.concat(F.lit(prefix), k)), ", ")))))
    if not path:
        return checks
    return [F.when(kind != "OBJECT", F.array(F.concat(F.lit(f"{name} is "), kind, F.lit(", not OBJECT")))).otherwise(F.flatten(_filled(checks)))]


def _filled(checks: list[Column]) -> Column:
    none = F.array().cast("array<string>")
    return F.array(*(F.coalesce(c, none) for c in checks)) if checks else F.array(none)


def argument_errors(name: Column, arguments: Column, schemas: Schemas) -> Column:
    """An array of what is wrong with the arguments of a call; empty when they are valid."""
    value = F.try_parse_json(arguments)
    checks = [F.when(name == tool, c) for tool, fields in sorted(schemas.items()) for c in _wrong(value, fields, "")]
    known = F.coalesce(name.isin(*schemas), F.lit(False)) if schemas else F.lit(False)
    one = lambda text: F.array(F.lit(text))
    repeats = F.get_json_object(arguments, "$").isNotNull()
    return (
        F.when(value.isNull() & repeats, one("arguments repeat a key"))
        .when(value.isNull(), one("arguments are not JSON"))
        .when(_kind(value) != "OBJECT", one("arguments are not a JSON object"))
        .otherwise(F.flatten(_filled([F.when(~known, one("unknown tool")), *checks])))
    )


def references(arguments: Column) -> Column:
    """The call ids that string values anywhere in the arguments refer to."""
    found = F.regexp_extract_all(canonical(arguments), F.lit(_REFERENCE), F.lit(1))
    plain = F.transform(found, lambda r: F.element_at(F.from_json(F.concat(F.lit('["'), r, F.lit('"]')), T.ArrayType(T.StringType())), 1))
    return F.coalesce(F.array_distinct(plain), F.array().cast("array<string>"))


def depths(calls: DataFrame) -> DataFrame:
    """(conv_id, call_id, depth): the longest way from a call without references, null on or behind a cycle.

    calls: (conv_id, call_id, refs).  Each round's rows are written to the shared folder, and only counts reach the
    driver.  What is joined has one row for each call, or one for each reference of the calls that have several.
    """
    named = calls.filter("conv_id is not null and call_id is not null")
    nodes = saved(named.groupBy(KEY).agg(F.array_distinct(F.flatten(F.collect_set("refs"))).alias("refs")), "calls")
    ids = nodes.select("conv_id", F.col("call_id").alias("parent"))
    pairs = nodes.select(*KEY, F.explode("refs").alias("parent")).join(ids, ["conv_id", "parent"], "left_semi")
    parents = saved(pairs.groupBy(KEY).agg(F.collect_list("parent").alias("parents")), "references")
    # calls with one reference point at it; the others end the chains
    chain = parents.filter(F.size("parents") == 1).select(*KEY, F.col("parents")[0].alias("to"), F.lit(1).cast("long").alias("steps"))
    chain = saved(chain, "pointers")
    total, reach, still, closed = chain.count(), 1, chain, None
    left = total
    while left and reach <= 2 * total:
        # what points at an end is closed and joined no more, for many calls may end at one
        every = still.withColumn("_closed", F.lit(False))
        every = every if closed is None else every.union(closed.withColumn("_closed", F.lit(True)))
        on = every.select("conv_id", F.col("call_id").alias("to"), F.col("to").alias("_far"), F.col("steps").alias("_more"), "_closed")
        both = still.join(on, ["conv_id", "to"], "left")
        steps = (F.col("steps") + F.coalesce("_more", F.lit(0))).alias("steps")
        moved = saved(both.select(*KEY, F.coalesce("_far", "to").alias("to"), steps, F.coalesce("_closed", F.lit(True)).alias("_closed")), "pointers")
        ended = moved.filter("_closed").drop("_closed")
        closed = ended if closed is None else closed.union(ended)
        still, reach = moved.filter("not _closed").drop("_closed"), 2 * reach
        left = still.count()
    # a pointer that is still open after that many doublings goes round a cycle
    chain = chain if closed is None else closed
    several = parents.filter(F.size("parents") > 1)
    ends = saved(nodes.select(KEY).join(parents.select(KEY), KEY, "left_anti").withColumn("depth", F.lit(0).cast("long")), "depths")
    if several.count():
        # each reference leads over a chain to its end: a call without references or with several
        ways = several.select(*KEY, F.explode("parents").alias("parent"))
        over = chain.select("conv_id", F.col("call_id").alias("parent"), F.col("to"), "steps")
        round_about = parents.filter(F.size("parents") == 1).select("conv_id", F.col("call_id").alias("parent"), F.lit(True).alias("_inside"))
        ways = ways.join(over, ["conv_id", "parent"], "left").join(round_about, ["conv_id", "parent"], "left")
        ways = saved(ways.select(*KEY, F.when(F.col("to").isNotNull() | F.col("_inside").isNull(), F.coalesce("to", "parent")).alias("end"), (F.coalesce("steps", F.lit(0)) + 1).alias("steps")), "ways")
        open_ways, done, left = ways, ends, ways.count()
        best = None
        while left:
            newest = done.select("conv_id", F.col("call_id").alias("end"), "depth")
            met = saved(open_ways.join(newest, ["conv_id", "end"], "left"), "ways")
            known = met.filter("depth is not null").select(*KEY, (F.col("depth") + F.col("steps")).alias("depth"))
            best = saved((known if best is None else best.union(known)).groupBy(KEY).agg(F.max("depth").alias("depth")), "depths")
            open_ways = met.filter("depth is null").drop("depth")
            now = open_ways.count()
            if now == left:  # what remains waits for itself
                break
            left = now
            done = saved(best.join(open_ways.select(KEY), KEY, "left_anti").join(ends.select(KEY), KEY, "left_anti"), "depths")
            ends = ends.union(done)
    to_end = ends.select("conv_id", F.col("call_id").alias("to"), "depth")
    along = chain.join(to_end, ["conv_id", "to"]).select(*KEY, (F.col("depth") + F.col("steps")).alias("depth"))
    return nodes.select(KEY).join(ends.union(along), KEY, "left").withColumn("depth", F.col("depth").cast("int"))


def link(calls: DataFrame, results: DataFrame, schemas: Schemas) -> DataFrame:
    """One row for each call, and for each result without call.

    calls: (conv_id, call_id, turn, name, arguments); results: (conv_id, call_id, turn, content).
    """
    held = calls.select(*KEY, "turn", "name", F.coalesce("arguments", F.lit("{}")).alias("arguments"))
    held = saved(held.withColumns({"refs": references(F.col("arguments")), "errors": argument_errors(F.col("name"), F.col("arguments"), schemas)}), "held")
    first = F.struct(F.col("turn").alias("t"), F.col("content").alias("c"))
    answers = results.groupBy(KEY).agg(F.min(first).alias("r"), F.count("*").alias("n_results"))
    answers = answers.select(*KEY, F.col("r.t").alias("result_turn"), F.col("r.c").alias("result"), "n_results")
    known = held.filter("call_id is not null").select("conv_id", F.col("call_id").alias("ref")).distinct()
    wanted = held.select(*KEY, F.explode("refs").alias("ref")).distinct()
    missing = wanted.join(known, ["conv_id", "ref"], "left_anti").groupBy(KEY).agg(F.array_sort(F.collect_set("ref")).alias("missing"))
    order = depths(held.select(*KEY, "refs"))
    linked = held.join(order, KEY, "left").join(missing, KEY, "left").join(answers.hint("shuffle_hash"), KEY, "left")
    lost = F.transform(F.coalesce("missing", F.array().cast("array<string>")), lambda r: F.concat(F.lit("unknown result "), r))
    linked = linked.withColumns({"errors": F.concat("errors", lost), "status": F.when(F.col("n_results").isNull(), "unanswered").otherwise("linked")})
    orphans = answers.join(held.select(KEY).distinct(), KEY, "left_anti").withColumns({"status": F.lit("orphan"), "errors": F.array().cast("array<string>")})
    both = linked.unionByName(orphans, allowMissingColumns=True)
    message = F.struct(
        F.coalesce(F.try_parse_json("arguments"), F.col("arguments").cast("variant")).alias("arguments"),
        F.col("call_id").alias("id"),
        F.col("name"),
        F.col("result"),
    )
    return both.select(
        *KEY,
        "turn",
        "name",
        "depth",
        "status",
        "result_turn",
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"),
        (F.size("errors") == 0).alias("valid"),
        F.array_join("errors", "; ").alias("errors"),
        canonical(F.to_json(message)).alias("message"),
    )


#: The tools of `turns_as_calls`.
TURN_TOOLS: Schemas = {
    "reply": {"prompt": ("STRING", True), "turn": ("BIGINT", True), "after": ("STRING", False)},
    "set_system": {"prompt": ("STRING", True), "turn": ("BIGINT", True)},
}


def turns_as_calls(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and results for a table of plain chat turns (conv_id, turn, role, text).

    Each turn that is not an assistant's asks for a reply, call t<turn>; an assistant's turn answers the turn
    before it.  A reply depends on the call two turns before it, so that a conversation's calls are one chain.
    """
    at = F.col("turn")
    asks = messages.filter(F.coalesce(F.col("role") != "assistant", F.lit(True)))
    tool = F.when(F.col("role") == "system", "set_system").otherwise("reply")
    after = F.when((tool == "reply") & (at >= 2), F.concat(F.lit(f"{REFERENCE}t"), (at - 2).cast("string")))
    arguments = F.to_json(F.struct(F.col("text").alias("prompt"), at.alias("turn"), after.alias("after")))
    calls = asks.select("conv_id", F.concat(F.lit("t"), at.cast("string")).alias("call_id"), "turn", tool.alias("name"), arguments.alias("arguments"))
    answers = messages.filter(F.col("role") == "assistant")
    results = answers.select("conv_id", F.concat(F.lit("t"), (at - 1).cast("string")).alias("call_id"), "turn", F.col("text").alias("content"))
    return calls, results
