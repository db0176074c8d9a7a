"""Structured Streaming forms of the waits and of sequence numbers: the same folds, with state between batches."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.waits import fold_waits
from tidemark.session import cut, shared_dir, ship

MATCH = "event_type string, key string, wait_id bigint, row_id bigint, at bigint"


def wait_rows(waits: DataFrame, inbox: DataFrame) -> DataFrame:
    """Waits and events as one stream of arrivals."""
    w = waits.select("event_type", "key", F.col("started_us").alias("at"), F.lit(True).alias("is_wait"), F.col("wait_id").alias("id"), F.col("deadline_us").alias("deadline"))
    return w.union(inbox.select("event_type", "key", F.col("received_us").alias("at"), F.lit(False).alias("is_wait"), F.col("row_id").alias("id"), F.lit(None).cast("bigint").alias("deadline")))


#: One open arrival of a key: a wait, or an event that nobody took yet.
KEPT = "kept array<struct<at:bigint,is_wait:boolean,id:bigint,deadline:bigint>>"


def match_stream(arrivals: DataFrame) -> DataFrame:
    """event_type, key, wait_id, row_id (null: timed out), at of a stream of arrivals.

    State of a key: what waits and what came unasked. A batch's events go before its deadlines, so an event that
    arrives with its deadline wins; a wait ends when an arrival of its key is past the deadline. An arrival without an
    id is the clock alone: it only ends waits.
    """

    def step(key, frames, state: GroupState):
        end = lambda d: float("inf") if pd.isna(d) else float(d)
        rows = [(a, (0, 0), w, i, end(d)) for a, w, i, d in (state.get[0] if state.exists else ())]
        now = max((r[0] for r in rows), default=0)
        for pdf in frames:
            now = max(now, int(pdf["at"].max()))
            known = pdf[pdf["id"].notna()]
            rows += [(int(a), (1 if w else 0, int(i)), bool(w), int(i), end(d)) for a, w, i, d in zip(known["at"], known["is_wait"], known["id"], known["deadline"], strict=True)]
        found = [x for x in fold_waits(rows) if x[1] is not None or x[2] < now]
        done = {(True, x[0]) for x in found} | {(False, x[1]) for x in found}
        state.update(([(a, w, i, None if d == float("inf") else int(d)) for a, _, w, i, d in rows if (w, i) not in done],))
        yield pd.DataFrame({"event_type": [key[0]] * len(found), "key": [key[1]] * len(found), "wait_id": [x[0] for x in found], "row_id": pd.Series([x[1] for x in found], dtype=object), "at": [int(x[2]) for x in found]})

    return arrivals.groupBy("event_type", "key").applyInPandasWithState(step, MATCH, KEPT, "append", GroupStateTimeout.NoTimeout)


def run_available(waits: DataFrame, inbox: DataFrame) -> DataFrame:
    """All there is, through the stream: arrivals are written to the shared folder and read as a stream.

    When the arrivals are through, the stream starts again from its state with one stroke of the clock for each key, past
    every deadline, as a clock source would send: waits that are still open end without an event.
    """
    spark = waits.sparkSession
    ship(spark)
    base = f"{shared_dir(spark)}/waits-{uuid.uuid4().hex}"
    rows = wait_rows(waits, inbox)
    rows.write.parquet(f"{base}/in")
    given = spark.read.schema(rows.schema).parquet(f"{base}/in")

    def drain():
        source = spark.readStream.schema(rows.schema).parquet(f"{base}/in")
        sink = match_stream(source).writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
        sink.awaitTermination()

    drain()
    last = F.greatest(F.max("at"), F.coalesce(F.max("deadline"), F.max("at"))) + 1
    strokes = cut(given.groupBy("event_type", "key").agg(last.alias("at")), "clock")
    empty = F.lit(None).cast("bigint")
    strokes.select("event_type", "key", "at", F.lit(True).alias("is_wait"), empty.alias("id"), empty.alias("deadline")).write.mode("append").parquet(f"{base}/in")
    drain()
    return spark.read.schema(MATCH).parquet(f"{base}/out")


def allocate_seq(events: DataFrame) -> DataFrame:
    """run_id, event_id, seq: dense numbers in each run in the order of `at`, the last one kept as state."""
    spark = events.sparkSession
    ship(spark)
    base = f"{shared_dir(spark)}/seq-{uuid.uuid4().hex}"
    events.select("run_id", "event_id", "at").write.parquet(f"{base}/in")
    source = spark.readStream.schema(spark.read.parquet(f"{base}/in").schema).parquet(f"{base}/in")

    def step(key, frames, state: GroupState):
        last = state.get[0] if state.exists else 0
        pdf = pd.concat(list(frames)).sort_values(["at", "event_id"])
        state.update((last + len(pdf),))
        yield pd.DataFrame({"run_id": key[0], "event_id": pdf["event_id"].to_numpy(), "seq": range(last + 1, last + 1 + len(pdf))})

    numbered = source.groupBy("run_id").applyInPandasWithState(step, "run_id string, event_id bigint, seq bigint", "last bigint", "append", GroupStateTimeout.NoTimeout)
    sink = numbered.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    sink.awaitTermination()
    return spark.read.schema("run_id string, event_id bigint, seq bigint").parquet(f"{base}/out")
