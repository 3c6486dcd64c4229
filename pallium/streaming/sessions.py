"""Agent sessions: the rules as a batch replay over ordered turns, and as a keyed state machine on a stream.

turns: (session_id, turn, ts, fingerprint, gate_kind, gate_blocking, signal).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Turns and milliseconds of a run, repeats that stop it, gates, waits at a gate and when paused, history kept.
MAX_TURNS, MAX_RUNTIME_MS, MAX_REPEATS, MAX_GATES = 12, 90_000, 2, 5
MAX_GATE_WAIT_MS, MAX_PAUSE_MS, HISTORY = 600_000, 1_200_000, 12


def repeats(turns: DataFrame, key: str = "session_id", value: str = "fingerprint") -> DataFrame:
    """turns with `repeat`: how many equal values in a row came just before."""
    order = Window.partitionBy(key).orderBy("turn")
    changed = F.coalesce(F.col(value) != F.lag(value).over(order), F.lit(True))
    islands = turns.withColumn("_island", F.sum(changed.cast("int")).over(order))
    return islands.withColumn("repeat", F.row_number().over(Window.partitionBy(key, "_island").orderBy("turn")) - 1).drop("_island")


def changes(rows: DataFrame, key: str, order_by: str, signature: str) -> DataFrame:
    """Rows whose signature differs from the one before in their key."""
    before = F.lag(F.struct(F.col(signature))).over(Window.partitionBy(key).orderBy(order_by))
    return rows.withColumn("_before", before).filter(F.col("_before").isNull() | ~F.col(signature).eqNullSafe(F.col("_before")[signature])).drop("_before")


def last_turns(turns: DataFrame, key: str, n: int = HISTORY, order_by: str = "turn") -> DataFrame:
    """The last n rows of each key, with `back` counting from 1 at the newest."""
    newest = Window.partitionBy(key).orderBy(F.col(order_by).desc())
    return turns.withColumn("back", F.row_number().over(newest)).filter(F.col("back") <= n)


def last_n(array: Column, n: int) -> Column:
    return F.slice(array, -F.least(F.lit(n), F.size(array)), F.lit(n))


def should_resume(parked_ms: Column, gate_present: Column, same_page: Column, asked: Column, manual: Column) -> Column:
    """What a parked session does next: resume, give up or wait."""
    limit = F.when(manual, MAX_PAUSE_MS).otherwise(MAX_GATE_WAIT_MS)
    return F.when(asked, "resume").when(parked_ms > limit, "give up").when(~manual & (~gate_present | ~same_page), "resume").otherwise("wait")


def replay(turns: DataFrame) -> DataFrame:
    """turns with `state`: running, parked, repeated, timed_out, too_many_turns, too_many_gates or stopped; final states last.

    Time that a session is parked, from a blocking turn to the next turn, doesn't count as running time.
    """
    order = Window.partitionBy("session_id").orderBy("turn")
    past = order.rowsBetween(Window.unboundedPreceding, 0)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = repeats(turns).withColumn("_at", F.col("ts").cast("timestamp"))
    gap = (F.unix_micros("_at") - F.unix_micros(F.lag("_at").over(order)))
    blocked_before = F.coalesce(F.lag("gate_blocking").over(order), F.lit(False))
    rows = rows.withColumn("_run", F.when(blocked_before, 0).otherwise(F.coalesce(gap, F.lit(0))))
    rows = rows.withColumn("_park", F.when(blocked_before, F.coalesce(gap, F.lit(0))).otherwise(0))
    rows = rows.withColumns(
        {
            "running_ms": F.floor(F.sum("_run").over(past) / 1000),
            "_gates": F.sum(F.coalesce("gate_blocking", F.lit(False)).cast("int")).over(past),
            "_turns": F.row_number().over(order),
        }
    )
    end = (
        F.when(F.col("signal") == "stop", "stopped")
        .when(F.col("_park") > MAX_GATE_WAIT_MS * 1000, "gave_up")
        .when(F.col("repeat") >= MAX_REPEATS, "repeated")
        .when(F.col("_turns") > MAX_TURNS, "too_many_turns")
        .when(F.col("running_ms") > MAX_RUNTIME_MS, "timed_out")
        .when(F.col("_gates") > MAX_GATES, "too_many_gates")
    )
    rows = rows.withColumn("_end", end)
    first = F.first("_end", ignorenulls=True)
    ended = first.over(before)
    state = F.coalesce(ended, F.col("_end"), F.when(F.coalesce("gate_blocking", F.lit(False)), F.lit("parked")).otherwise("running"))
    return rows.withColumn("state", state).drop("_run", "_park", "_gates", "_turns", "_end", "_at")


def turns_of_events(events: DataFrame) -> DataFrame:
    """Session turns of an event log (event_id, ts, user_id, event_type): a user is a session, an event a turn."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return events.select(
        F.col("user_id").alias("session_id"),
        F.row_number().over(order).alias("turn"),
        "ts",
        F.col("event_type").alias("fingerprint"),
        F.when(F.col("event_type") == "error", "manual").alias("gate_kind"),
        F.coalesce(F.col("event_type") == "error", F.lit(False)).alias("gate_blocking"),
        F.lit(None).cast("string").alias("signal"),
    )


STATE = "last string, repeat int, turns int, gates int, started long, parked long, blocked_at long, ended string"
OUTPUT = "session_id long, turn long, repeat int, state string"


def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    """The rules of `replay` for one session and micro-batch, for applyInPandasWithState."""
    last, repeat, n, gates, started, parked, blocked_at, ended = state.get if state.exists else (None, 0, 0, 0, None, 0, None, None)
    out = []
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"], kind="stable")
    for row in rows.itertuples():
        now = int(row.ts.timestamp() * 1000)
        started = now if started is None else started
        waited = 0 if blocked_at is None else now - blocked_at
        parked += waited
        blocking = row.event_type == "error"
        repeat = repeat + 1 if n and row.event_type == last else 0
        last, n, gates = row.event_type, n + 1, gates + blocking
        blocked_at = now if blocking else None
        if ended is None:
            ended = (
                "gave_up" if waited > MAX_GATE_WAIT_MS
                else "repeated" if repeat >= MAX_REPEATS
                else "too_many_turns" if n > MAX_TURNS
                else "timed_out" if now - started - parked > MAX_RUNTIME_MS
                else "too_many_gates" if gates > MAX_GATES
                else None
            )
        out.append((key[0], n, repeat, ended or ("parked" if blocking else "running")))
    state.update((last, repeat, n, gates, started, parked, blocked_at, ended))
    yield pd.DataFrame(out, columns=["session_id", "turn", "repeat", "state"])


def stream(events: DataFrame) -> DataFrame:
    """The state of every turn of a stream of events, keyed by user. Events of a user arrive in order of time."""
    rows = events.select("event_id", "ts", "user_id", "event_type")
    return rows.groupBy("user_id").applyInPandasWithState(step, OUTPUT, STATE, "append", "NoTimeout")


def windowed_counts(events: DataFrame, window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Events by type and time window behind a watermark; works on streams and tables."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def status_of(turns: DataFrame) -> DataFrame:
    """The last state of each session."""
    return turns.groupBy("session_id").agg(F.max_by("state", "turn").alias("state"), F.max("turn").alias("turns"))
