"""Starting runs and children, and what external events do to the inbox: set operations on whole tables of requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.functions.values import redact_json
from tidemark.sources.journal import next_seq, run_by_key

ENDED = ("completed", "failed", "cancelled")


def start_runs(requests: DataFrame, runs: DataFrame) -> DataFrame:
    """request_id, run_id, action of requests (request_id, run_id, idempotency_key; either may be null).

    runs: run_id, idempotency_key, created_at, status. A request means the run it names, else the earliest run of its
    key, else a new one: named by its key, so that requests of one key in one batch mean one run, or by its own id.
    action: create (the first request of a new run), resume, or none where the run has ended or was just created.
    """
    known = run_by_key(runs).select("idempotency_key", F.col("run_id").alias("_of_key"))
    new = F.concat(F.lit("run-"), F.substring(F.sha2(F.coalesce(F.concat(F.lit("k"), "idempotency_key"), F.concat(F.lit("r"), F.col("request_id").cast("string"))), 256), 1, 32))
    meant = requests.join(known, "idempotency_key", "left").select("request_id", F.coalesce("run_id", "_of_key", new).alias("run_id"))
    place = F.row_number().over(Window.partitionBy("run_id").orderBy("request_id"))
    found = meant.join(runs.select("run_id", "status"), "run_id", "left").withColumn("_n", place)
    action = F.when(F.col("status").isin(*ENDED), "none").when(F.col("status").isNotNull(), "resume").when(F.col("_n") == 1, "create").otherwise("none")
    return found.select("request_id", "run_id", action.alias("action"))


def start_children(calls: DataFrame, runs: DataFrame) -> DataFrame:
    """run_id, child_key, child_run_id, action of child calls (run_id, child_key): a child's id follows from its parent's
    and its key, so a parent that runs again finds it. runs: run_id, status."""
    child = F.substring(F.sha2(F.concat_ws("\0", "run_id", F.lit("child"), "child_key"), 256), 1, 32)
    made = calls.dropDuplicates(["run_id", "child_key"]).withColumn("child_run_id", child)
    status = runs.select(F.col("run_id").alias("child_run_id"), "status")
    action = F.when(F.col("status").isNull(), "create").when(F.col("status") == "failed", "raise").when(F.col("status") == "completed", "result").when(F.col("status") == "cancelled", "raise").otherwise("resume")
    return made.join(status, "child_run_id", "left").select("run_id", "child_key", "child_run_id", action.alias("action"))


def send_events(events: DataFrame, inbox: DataFrame | None = None, redact: bool = True) -> DataFrame:
    """Inbox rows of events (event_type, key, received_at, payload): row_id counts on within each (event_type, key),
    which is all that the order of the inbox needs; payloads are redacted on the way in."""
    payload = redact_json(F.col("payload")) if redact else F.col("payload")
    lane = F.concat_ws("\0", "event_type", F.coalesce(F.concat(F.lit("k"), "key"), F.lit("-")))
    held = None if inbox is None else inbox.select(lane.alias("_lane"), F.col("row_id").alias("seq"))
    numbered = next_seq(events.withColumn("_lane", lane), held, ["received_at", "payload"], run="_lane")
    return numbered.select("event_type", "key", F.col("seq").alias("row_id"), "received_at", payload.alias("payload"), F.lit(False).alias("consumed"))


def consume(inbox: DataFrame, taken: DataFrame) -> DataFrame:
    """The inbox with what was taken (event_type, key, row_id) marked."""
    t = taken.select(F.col("event_type").alias("_t"), F.col("key").alias("_k"), F.col("row_id").alias("_r")).distinct()
    on = (F.col("event_type") == F.col("_t")) & F.col("key").eqNullSafe(F.col("_k")) & (F.col("row_id") == F.col("_r"))
    rest = [c for c in inbox.columns if c != "consumed"]
    return inbox.join(t, on, "left").select(*rest, (F.col("consumed") | F.col("_r").isNotNull()).alias("consumed"))
