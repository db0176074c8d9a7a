"""The task runtime, starts of runs and children, the inbox, and timed waits on small tables."""

import time

import pytest

from tidemark.operators import runs, tasks
from tidemark.operators.waits import match_with_timeouts
from tidemark.session import ship
from tidemark.streaming.waits import run_available

CALLS = "run_id string, pos bigint, key string, ordinal bigint, input string"
JOURNAL = "run_id string, identity string, type string, attempt int"


@pytest.fixture(autouse=True)
def shipped(spark):
    ship(spark)


def test_an_interrupted_call_goes_on(spark):
    """A start without an end raises the attempt's number and leaves the retries alone."""

    def body(attempt, text):
        attempt.record_usage("m", 3)
        raise ValueError(text)

    calls = spark.createDataFrame([("r", 0, "a", None, "x"), ("r", 1, "b", None, "y"), ("r", 2, None, 4, "z")], CALLS)
    journal = spark.createDataFrame([("r", "t:key:a", "TaskScheduled", None), ("r", "t:key:a", "TaskAttemptStarted", 1), ("r", "t:key:b", "TaskCompleted", None)], JOURNAL)
    events = tasks.run_tasks(calls, journal, tasks.Task("t", body, retries=1), wait=False)
    got = {i: [(r.type, r.attempt) for r in sorted(events.where(f"identity = '{i}'").collect(), key=lambda r: r.step)] for i in ("t:key:a", "t:key:b", "t:4")}
    started, failed = "TaskAttemptStarted", "TaskAttemptFailed"
    assert got == {"t:key:a": [(started, 2), (failed, 2), (started, 3), (failed, 3)], "t:key:b": [], "t:4": [("TaskScheduled", None), (started, 1), (failed, 1), (started, 2), (failed, 2)]}
    ends = sorted((r.identity, r.attempt, r.next_delay is None, r.usage[0].input_tokens) for r in events.where("type = 'TaskAttemptFailed'").collect())
    assert ends == [("t:4", 1, False, 3), ("t:4", 2, True, 3), ("t:key:a", 2, False, 3), ("t:key:a", 3, True, 3)]
    assert [tuple(r) for r in tasks.first_failures(events).select("run_id", "identity", "error.message").collect()] == [("r", "t:key:a", "x")]
    again = tasks.run_tasks(calls, journal.unionByName(events.select(*journal.columns)), tasks.Task("t", body, retries=1), wait=False)
    assert again.count() == 0


def test_timeouts_and_keys(spark):
    def body(attempt, text):
        if attempt.attempt == 1:
            time.sleep(5)
        return attempt.idempotency_key

    calls = spark.createDataFrame([("r", 0, "a", None, "x")], CALLS)
    events = tasks.run_tasks(calls, spark.createDataFrame([], JOURNAL), tasks.Task("t", body, retries=1, timeout=0.2), wait=False)
    rows = sorted(events.collect(), key=lambda r: r.step)
    assert [r.type for r in rows] == ["TaskScheduled", "TaskAttemptStarted", "TaskAttemptFailed", "TaskAttemptStarted", "TaskCompleted"]
    assert rows[2].error.type == "TimeoutError" and 0 <= rows[2].next_delay <= 1
    import hashlib

    assert rows[4].output_ref.strip('"') == hashlib.sha256(b"r\0t\0a").hexdigest()
    assert [r.status for r in tasks.outcomes(events).collect()] == ["completed"]


def test_effects():
    risky, guarded = tasks.Task("t", print, retries=1, side_effect=True), tasks.Task("t", print, side_effect=True, idempotent=True)
    with pytest.raises(tasks.EffectSafetyError):
        tasks.check_effects(risky, True, "strict")
    with pytest.warns(UserWarning):
        tasks.check_effects(risky, True)
    with pytest.warns(UserWarning):
        tasks.check_effects(guarded, False, "strict")
    tasks.check_effects(guarded, True, "strict")
    tasks.check_effects(risky, False, "off")

    @tasks.task(retries=2)
    def double(attempt, x):
        return 2 * x

    assert double(4) == 8 and double.retries == 2


def test_starts(spark):
    known = spark.createDataFrame([("r1", "k", 2, "running"), ("r0", "k", 1, "completed"), ("r2", None, 1, "waiting")], "run_id string, idempotency_key string, created_at int, status string")
    asked = spark.createDataFrame([(1, None, "k"), (2, "r2", None), (3, None, "new"), (4, None, "new"), (5, None, None), (6, "own", None)], "request_id bigint, run_id string, idempotency_key string")
    got = {r.request_id: (r.run_id, r.action) for r in runs.start_runs(asked, known).collect()}
    assert got[1] == ("r0", "none") and got[2] == ("r2", "resume") and got[6] == ("own", "create")
    assert got[3][0] == got[4][0] != got[5][0] and [got[i][1] for i in (3, 4, 5)] == ["create", "none", "create"]


def test_inbox_counts_on(spark):
    sent = spark.createDataFrame([("t", None, 1, '{"password":"x"}'), ("t", "a", 1, "{}")], "event_type string, key string, received_at int, payload string")
    first = runs.send_events(sent)
    more = runs.send_events(sent, first)
    assert sorted((r.key or "", r.row_id) for r in first.union(more).collect()) == [("", 1), ("", 2), ("a", 1), ("a", 2)]
    assert first.where("key is null").first().payload == '{"password":"***REDACTED***"}'
    taken = runs.consume(first, first.where("key is null"))
    assert sorted((r.key or "", r.consumed) for r in taken.collect()) == [("", True), ("a", False)]


def test_waits_open_at_the_end_of_the_stream_time_out(spark):
    waits = spark.createDataFrame([("t", "a", 1, 10, 20), ("t", "a", 2, 11, None), ("t", "a", 3, 12, 13), ("u", "b", 4, 5, 9)], "event_type string, key string, wait_id bigint, started_us bigint, deadline_us bigint")
    inbox = spark.createDataFrame([("t", "a", 7, 13), ("v", "c", 8, 1)], "event_type string, key string, row_id bigint, received_us bigint")
    said = [("t", "a", 1, 7, 13), ("t", "a", 3, None, 13), ("u", "b", 4, None, 9)]
    assert sorted(tuple(r) for r in match_with_timeouts(waits, inbox).collect()) == said
    assert sorted(tuple(r) for r in run_available(waits, inbox).collect()) == said
