"""Text forms for people."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The render kind of each event type; others are lifecycle.
EVENT_KINDS = {
    "WorkflowResumed": "resume",
    "TaskScheduled": "sched",
    "TaskAttemptStarted": "run",
    "TaskAttemptFailed": "fail",
    "TaskCompleted": "done",
    "TimerCreated": "timer",
    "TimerFired": "timer",
    "EventWaitStarted": "event",
    "ExternalEventReceived": "event",
    "WorkflowWaiting": "wait",
}


def event_kind(kind: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in EVENT_KINDS.items() for x in pair))
    return F.coalesce(F.try_element_at(table, kind), F.lit("lifecycle"))


def clock(ts: Column) -> Column:
    return F.date_format(ts, "HH:mm:ss")


def minute(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm")


def duration(seconds: Column) -> Column:
    """Whole milliseconds under a second, hundredths under a minute, else minutes and whole seconds; null as a dash."""
    ms = F.concat(F.floor(seconds * 1000 + 0.5).cast("string"), F.lit("ms"))
    m = F.concat(F.floor(seconds / 60).cast("string"), F.lit("m "), F.floor(seconds % 60 + 0.5).cast("string"), F.lit("s"))
    return F.when(seconds.isNull(), "—").when(seconds < 1, ms).when(seconds < 60, F.format_string("%.2fs", seconds)).otherwise(m)


def gap(a: Column, b: Column) -> Column:
    """Time between two timestamps, either way round."""
    s = F.floor(F.abs(F.timestamp_diff("MILLISECOND", a, b)) / 1000 + 0.5)
    return F.when(s >= 60, F.concat(F.floor(s / 60).cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s"))).otherwise(F.concat(s.cast("string"), F.lit("s")))


def age(ts: Column, now: Column) -> Column:
    m = F.floor(F.timestamp_diff("SECOND", ts, now) / 60 + 0.5)
    hours = F.concat(F.floor(m / 60).cast("string"), F.lit("h "), (m % 60).cast("string"), F.lit("m ago"))
    return F.when(m < 1, "just now").when(m < 60, F.concat(m.cast("string"), F.lit("m ago"))).otherwise(hours)


def short(value: Column, most: int = 80) -> Column:
    return F.when(F.length(value) > most, F.concat(F.left(value, F.lit(most - 1)), F.lit("…"))).otherwise(value)


def summary(e: dict[str, Column]) -> Column:
    """One line on an event from its fields; empty for types that have none."""
    kind = e["type"]
    named = F.concat(F.lit("task="), e["task_name"], F.when(e["key"].isNotNull(), F.concat(F.lit(" key="), e["key"])).otherwise(F.concat(F.lit(" ordinal="), e["ordinal"].cast("string"))))
    attempt = F.concat(F.lit(" attempt="), e["attempt"].cast("string"))
    error = F.concat(F.lit("error="), e["error_type"], F.lit(": "), e["error_message"])
    delay = F.when(e["next_delay"].isNull(), "").otherwise(F.format_string(" next_delay=%.3fs", e["next_delay"]))
    return (
        F.when(kind == "WorkflowCreated", F.concat(F.lit("workflow="), e["workflow_name"], F.lit(" code_version="), e["code_version"]))
        .when(kind == "ChildWorkflowScheduled", F.concat(F.lit("child="), e["workflow_name"], F.lit(" run_id="), e["child_run_id"]))
        .when(kind.isin("TaskScheduled", "TaskCompleted"), named)
        .when(kind == "TaskAttemptStarted", F.concat(named, attempt))
        .when(kind == "TaskAttemptFailed", F.concat(named, attempt, F.lit(" "), error, delay))
        .when(kind == "WorkflowFailed", error)
        .otherwise(F.lit(""))
    )
