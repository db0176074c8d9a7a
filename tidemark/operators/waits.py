"""Timers and waits: due timers, inbox matching, the sequential fold with timeouts."""

from __future__ import annotations

import heapq
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def due_timers(timers: DataFrame, now: Column) -> DataFrame:
    return timers.where((F.col("status") == "pending") & (F.col("fire_at") <= now)).orderBy("fire_at", "timer_id")


def timer_status(timers: DataFrame, received: DataFrame, fired: DataFrame) -> DataFrame:
    """pending, fired, or discarded where the awaited event came; an event beats its timeout."""
    got = received.select("run_id", "identity").distinct().withColumn("_got", F.lit(True))
    went = fired.select("timer_id").distinct().withColumn("_fired", F.lit(True))
    status = F.when(F.col("_got"), "discarded").when(F.col("_fired"), "fired").otherwise("pending")
    return timers.join(got, ["run_id", "identity"], "left").join(went, "timer_id", "left").withColumn("status", status).drop("_got", "_fired")


def outstanding(waits: DataFrame, resolved: DataFrame) -> DataFrame:
    return waits.join(resolved.select("run_id", "identity"), ["run_id", "identity"], "left_anti")


def inbox_heads(inbox: DataFrame) -> DataFrame:
    """The earliest unconsumed event of each (event_type, key); null keys are a key of their own."""
    w = Window.partitionBy("event_type", "key").orderBy("received_at", "row_id")
    return inbox.where("not consumed").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def list_inbox(inbox: DataFrame, event_type: str | None = None, include_consumed: bool = False) -> DataFrame:
    out = inbox if event_type is None else inbox.where(F.col("event_type") == event_type)
    return (out if include_consumed else out.where("not consumed")).orderBy("received_at", "row_id")


def rank_match(waits: DataFrame, inbox: DataFrame) -> DataFrame:
    """Waits without timeouts meet events first in, first out: n-th wait and n-th event of an (event_type, key)."""
    a = waits.withColumn("_n", F.row_number().over(Window.partitionBy("event_type", "key").orderBy("started_at", "wait_id")))
    b = inbox.withColumn("_n", F.row_number().over(Window.partitionBy("event_type", "key").orderBy("received_at", "row_id")))
    on = a["event_type"].eqNullSafe(b["event_type"]) & a["key"].eqNullSafe(b["key"]) & (a["_n"] == b["_n"])
    return a.join(b, on).select(a["event_type"], a["key"], "wait_id", "row_id")


def fold_waits(rows: Iterable[tuple]) -> Iterator[tuple]:
    """(wait_id, row_id or None, at) for rows (at, order, is_wait, id, deadline) of one key in time order.

    A wait takes the oldest event that no other took, even one from before it; at its deadline it ends without one, but
    an event of the same instant still wins. What is left waiting without a deadline at the end gives nothing.
    """
    events: deque[int] = deque()
    waits: dict[int, int] = {}  # the open waits by place, oldest first
    ends: list[tuple[float, int, int]] = []
    for place, (at, _, is_wait, name, deadline) in enumerate(sorted(rows, key=lambda r: (r[0], r[1]))):
        while ends and ends[0][0] < at:
            end, p, w = heapq.heappop(ends)
            if waits.pop(p, None) is not None:
                yield w, None, end
        if is_wait and events:
            yield name, events.popleft(), at
        elif is_wait:
            waits[place] = name
            heapq.heappush(ends, (deadline, place, name))
        elif waits:
            yield waits.pop(next(iter(waits))), name, at
        else:
            events.append(name)
    for end, p, w in sorted(ends):
        if p in waits and end != float("inf"):
            yield w, None, end


def match_with_timeouts(waits: DataFrame, inbox: DataFrame) -> DataFrame:
    """event_type, key, wait_id, row_id (null: timed out), at: waits (started_us, deadline_us) meet events (received_us)."""
    w = waits.select("event_type", "key", F.col("started_us").alias("at"), F.lit(1).alias("ord"), F.lit(True).alias("is_wait"), F.col("wait_id").alias("id"), F.col("deadline_us").cast("double").alias("deadline"))
    e = inbox.select("event_type", "key", F.col("received_us").alias("at"), F.lit(0).alias("ord"), F.lit(False).alias("is_wait"), F.col("row_id").alias("id"), F.lit(None).cast("double").alias("deadline"))

    schema = pa.schema([("event_type", pa.string()), ("key", pa.string()), ("wait_id", pa.int64()), ("row_id", pa.int64()), ("at", pa.int64())])

    def fold(t: pa.Table) -> pa.Table:
        c = {n: t.column(n).to_pylist() for n in t.column_names}
        rows = [(a, (o, i), s, i, float("inf") if d is None else d) for a, o, s, i, d in zip(c["at"], c["ord"], c["is_wait"], c["id"], c["deadline"], strict=True)]
        return pa.Table.from_pylist([{"event_type": c["event_type"][0], "key": c["key"][0], "wait_id": w, "row_id": e, "at": int(at)} for w, e, at in fold_waits(rows)], schema=schema)

    return w.union(e).groupBy("event_type", "key").applyInArrow(fold, "event_type string, key string, wait_id bigint, row_id bigint, at bigint")
