"""Tasks: callables with a retry budget, a timeout and declared effects, run over a DataFrame of calls.

What a run of them gives is what it adds to the journal: one row an event, each attempt with its start, its failure or
its output, its delay and its bill. Calls that the journal shows as done or out of retries do not run; calls that were
cut off in the middle go on where they stopped.
"""

from __future__ import annotations

import json
import signal
import threading
import time
import warnings
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.identity import backoff_delay, call_identity, idempotency_key
from tidemark.session import cut

USAGE = "array<struct<model:string,input_tokens:bigint,output_tokens:bigint>>"
EVENTS = f"run_id string, pos bigint, identity string, step int, type string, attempt int, input_ref string, output_ref string, error struct<type:string,message:string>, next_delay double, usage {USAGE}"
COLUMNS = ["run_id", "pos", "identity", "step", "type", "attempt", "input_ref", "output_ref", "error", "next_delay", "usage"]


class EffectSafetyError(Exception):
    """A side effect may be repeated by a retry and nothing guards it."""


@dataclass
class Attempt:
    """What a task's body may see of the attempt it runs in, and where it books what it used."""

    run_id: str
    task_name: str
    identity: str
    attempt: int
    idempotency_key: str
    usage: list[dict] = field(default_factory=list)

    def record_usage(self, model: str, input_tokens: int | None = None, output_tokens: int | None = None) -> None:
        self.usage.append({"model": model, "input_tokens": input_tokens, "output_tokens": output_tokens})


@dataclass(frozen=True)
class Task:
    """body(attempt, input) gives a value that JSON can hold."""

    name: str
    body: Callable[[Attempt, str], object]
    retries: int = 0
    timeout: float | None = None
    side_effect: bool = False
    idempotent: bool = False

    def __call__(self, value: str) -> object:
        """Outside a run: the body alone, with nothing recorded."""
        return self.body(Attempt("", self.name, f"{self.name}:0", 1, ""), value)


def task(retries: int = 0, timeout: float | None = None, side_effect: bool = False, idempotent: bool = False) -> Callable[[Callable], Task]:
    if retries < 0 or timeout is not None and timeout <= 0:
        raise ValueError("retries are 0 or more and a timeout is above 0")
    return lambda body: Task(body.__name__, body, retries, timeout, side_effect, idempotent)


def check_effects(t: Task, run_is_keyed: bool, mode: str = "warn") -> None:
    """Unguarded effects that a retry repeats: an error if strict, else a warning; guarded ones in a run that no later
    start can name: a warning. mode off is silent."""
    if mode not in ("strict", "warn", "off"):
        raise ValueError(f"no such mode: {mode}")
    if mode == "off" or not t.side_effect:
        return
    if not t.idempotent:
        if t.retries and mode == "strict":
            raise EffectSafetyError(f"task {t.name!r} has a side effect and retries, but is not idempotent")
        if t.retries:
            warnings.warn(f"task {t.name!r} has a side effect and retries, but is not idempotent", stacklevel=2)
    elif not run_is_keyed:
        warnings.warn(f"task {t.name!r} keys its effect on a run without a key: another start repeats it", stacklevel=2)


@contextmanager
def time_limit(seconds: float | None, name: str):
    """TimeoutError in the body once the time is over; needs the main thread, in which Python workers run."""
    if seconds is None:
        yield
        return
    if threading.current_thread() is not threading.main_thread():
        raise RuntimeError("timeouts need the main thread")

    def ring(*_):
        raise TimeoutError(f"task {name!r} took more than {seconds} s")

    before = signal.signal(signal.SIGALRM, ring)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def progress(journal: DataFrame) -> DataFrame:
    """run_id, identity, scheduled, attempts, failures, completed of the calls in a journal.

    An attempt that started and never ended (its worker died) raises the number of attempts, not that of failures.
    """
    return journal.groupBy("run_id", "identity").agg(
        F.bool_or(F.col("type") == "TaskScheduled").alias("scheduled"),
        F.coalesce(F.max(F.when(F.col("type").isin("TaskAttemptStarted", "TaskAttemptFailed"), F.col("attempt"))), F.lit(0)).alias("attempts"),
        F.count_if(F.col("type") == "TaskAttemptFailed").alias("failures"),
        F.bool_or(F.col("type") == "TaskCompleted").alias("completed"),
    )


def open_calls(calls: DataFrame, journal: DataFrame, t: Task, seed: int = 0) -> DataFrame:
    """Calls (run_id, pos, key, ordinal, input) that have still to run, with what was tried and the delays to come."""
    named = calls.withColumn("identity", call_identity(F.lit(t.name), F.col("ordinal"), F.col("key")))
    named = named.withColumn("idempotency_key", idempotency_key(F.col("run_id"), F.lit(t.name), F.coalesce("key", F.col("ordinal").cast("string"))))
    delays = F.transform(F.sequence(F.lit(1), F.lit(t.retries)), lambda f: backoff_delay(F.concat_ws("\0", "run_id", "identity"), f, seed)) if t.retries else F.array().cast("array<double>")
    zero = {"scheduled": False, "completed": False, "attempts": 0, "failures": 0}
    left = named.join(progress(journal), ["run_id", "identity"], "left").fillna(zero)
    return left.where(~F.col("completed") & (F.col("failures") <= t.retries)).withColumn("delays", delays)


def run_tasks(calls: DataFrame, journal: DataFrame, t: Task, *, concurrency: int = 8, wait: bool = True, seed: int = 0) -> DataFrame:
    """The events that running the open calls adds, in the shared folder before anything reads them.

    calls: run_id, pos, key (or null), ordinal, input; journal: run_id, identity, type, attempt. Within a call, step
    orders the events. A failure books its error, its bill and, while retries are left, the seconds to the next attempt;
    with wait these pass before it. At most `concurrency` calls run at once. A lost executor's calls run again, as
    after any crash: effects belong under the attempt's idempotency_key.
    """

    def attempts(b) -> Iterator[tuple]:
        step = 0

        def event(kind, attempt=None, **more):
            nonlocal step
            step += 1
            slots = {"input_ref": None, "output_ref": None, "error": None, "next_delay": None, "usage": None} | more
            return (b.run_id, b.pos, b.identity, step - 1, kind, attempt, *slots.values())

        if b.scheduled:
            step = 1
        else:
            yield event("TaskScheduled", input_ref=json.dumps(b.input))
        n, failures = int(b.attempts), int(b.failures)
        while failures <= t.retries:
            n += 1
            yield event("TaskAttemptStarted", n)
            seen = Attempt(b.run_id, t.name, b.identity, n, b.idempotency_key)
            try:
                with time_limit(t.timeout, t.name):
                    out = json.dumps(t.body(seen, b.input), separators=(",", ":"))
            except Exception as e:
                failures += 1
                delay = float(b.delays[failures - 1]) if failures <= t.retries else None
                yield event("TaskAttemptFailed", n, error={"type": type(e).__name__, "message": str(e)}, next_delay=delay, usage=seen.usage or None)
                if wait and delay is not None:
                    time.sleep(delay)
            else:
                yield event("TaskCompleted", n, output_ref=out, usage=seen.usage or None)
                return

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [e for b in pdf.itertuples(index=False) for e in attempts(b)]
            made = pd.DataFrame(rows, columns=COLUMNS)
            made["attempt"] = made["attempt"].astype("Int32")
            yield made

    slots = ["run_id", "pos", "identity", "idempotency_key", "input", "scheduled", "attempts", "failures", "delays"]
    return cut(open_calls(calls, journal, t, seed).select(*slots).repartition(concurrency).mapInPandas(run, EVENTS), "task-events")


def outcomes(events: DataFrame) -> DataFrame:
    """run_id, identity, pos, status, output_ref, error of each call: its last outcome among these events."""
    done = F.col("type") == "TaskCompleted"
    lost = (F.col("type") == "TaskAttemptFailed") & F.col("next_delay").isNull()
    folded = events.groupBy("run_id", "identity").agg(F.max("pos").alias("pos"), F.bool_or(done).alias("ok"), F.bool_or(lost).alias("out"), F.max_by("output_ref", F.when(done, F.col("attempt"))).alias("output_ref"), F.max_by("error", F.when(lost, F.col("attempt"))).alias("error"))
    return folded.select("run_id", "identity", "pos", F.when(F.col("ok"), "completed").when(F.col("out"), "failed").otherwise("running").alias("status"), "output_ref", "error")


def first_failures(events: DataFrame) -> DataFrame:
    """run_id, identity, error of the failed call that comes first in each run: what a fail-fast run ends with."""
    failed = outcomes(events).where("status = 'failed'")
    return failed.groupBy("run_id").agg(F.min_by(F.struct("identity", "error"), "pos").alias("f")).select("run_id", "f.*")


def attempt_flags(journal: DataFrame) -> DataFrame:
    """run_id, identity, n_attempts, will_retry, exhausted, has_usage, billed_failed: counts of failures that come again
    or not, whether any attempt was billed, and whether a failed one was."""
    ended = journal.where(F.col("type").isin("TaskAttemptFailed", "TaskCompleted"))
    failed, billed = F.col("type") == "TaskAttemptFailed", F.col("usage_in").isNotNull()
    return ended.groupBy("run_id", "identity").agg(
        F.count("*").alias("n_attempts"),
        F.count_if(failed & F.col("next_delay").isNotNull()).alias("will_retry"),
        F.count_if(failed & F.col("next_delay").isNull()).alias("exhausted"),
        F.bool_or(billed).alias("has_usage"),
        F.bool_or(failed & billed).alias("billed_failed"),
    )
