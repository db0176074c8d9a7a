"""The journal as DataFrames: fixed envelope, JSON payload at rest, typed projection, scans and appends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

ENVELOPE = "run_id string, seq bigint, event_id string, type string, ts timestamp, payload string"
#: Payload fields that operators use; *_ref slots stay JSON text, byte for byte.
FIELDS = "workflow_name string, code_version string, idempotency_key string, parent_run_id string, task_name string, ordinal int, key string, map_group string, attempt int, next_delay double, identity string, kind string, timer_id string, fire_at timestamp, event_type string, child_run_id string, source_run_id string, fork_point_seq bigint, reason string"
TERMINAL = {"WorkflowCompleted": "completed", "WorkflowFailed": "failed", "WorkflowCancelled": "cancelled"}
TASK_EVENTS = ("TaskScheduled", "TaskAttemptStarted", "TaskAttemptFailed", "TaskCompleted")


def typed(events: DataFrame) -> DataFrame:
    """Envelope and known payload fields side by side: one from_json; raw slots by path."""
    parsed = events.withColumn("_p", F.from_json("payload", FIELDS, {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX"}))
    slots = {s: F.get_json_object("payload", f"$.{s}") for s in ("input_ref", "output_ref", "event_ref", "source_input_ref", "usage")}
    errors = {f"error_{s}": F.get_json_object("payload", f"$.error.{s}") for s in ("type", "message", "traceback")}
    return parsed.select("run_id", "seq", "event_id", "type", "ts", "_p.*", *(c.alias(n) for n, c in (slots | errors).items()))


def read_events(events: DataFrame, run_id: str) -> DataFrame:
    return events.where(F.col("run_id") == run_id).orderBy("seq")


def next_seq(new: DataFrame, existing: DataFrame | None, order: list[str], run: str = "run_id") -> DataFrame:
    """Dense seq from 1 in each run, after what the journal holds."""
    place = F.row_number().over(Window.partitionBy(run).orderBy(*order)).cast("bigint")
    if existing is None:
        return new.withColumn("seq", place)
    last = existing.groupBy(run).agg(F.max("seq").alias("_last"))
    return new.join(last, run, "left").withColumn("seq", F.coalesce("_last", F.lit(0)) + place).drop("_last")


def insert_new(new: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Insert-or-ignore on a key: the new rows whose key is not there yet, one of each."""
    return new.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def run_by_key(runs: DataFrame, key: str = "idempotency_key") -> DataFrame:
    """The earliest run of every idempotency key."""
    return runs.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by("run_id", F.struct("created_at", "run_id")).alias("run_id"))


def parse_lines(lines: DataFrame, source: str = "source_id", text: str = "text") -> DataFrame:
    """source_id, line_no (from 1), record_id, body, error of each line `record_id,body` that is not blank."""
    split = lines.select(source, F.posexplode(F.split(text, "\n")).alias("_i", "_line")).where(F.trim("_line") != "")
    at, line = F.col("_i") + 1, F.trim("_line")
    comma = F.instr(line, ",")
    body = F.trim(F.expr("substring(trim(_line), instr(trim(_line), ',') + 1)"))
    bad = F.when(comma == 0, F.concat(F.lit("line "), at.cast("string"), F.lit(": no separator"))).when(body == "", F.concat(F.lit("line "), at.cast("string"), F.lit(": no body")))
    return split.select(source, at.cast("bigint").alias("line_no"), F.when(bad.isNull(), F.expr("trim(substring(trim(_line), 1, instr(trim(_line), ',') - 1))")).alias("record_id"), F.when(bad.isNull(), body).alias("body"), bad.alias("error"))
