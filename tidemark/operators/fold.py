"""Folds of the journal: statuses, attempts, counts, usage. Journal columns: see sources.journal.typed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from tidemark.sources.journal import TASK_EVENTS, TERMINAL


def by_seq():
    return Window.partitionBy("run_id").orderBy("seq")


def by_call():
    return Window.partitionBy("run_id", "identity").orderBy("seq")


def of(kind: str, value: str | Column = "seq") -> Column:
    """The value on events of a type, else null."""
    return F.when(F.col("type") == kind, F.col(value) if isinstance(value, str) else value)


def terminal_status() -> Column:
    return F.create_map(*(F.lit(x) for p in TERMINAL.items() for x in p))


def run_status(j: DataFrame) -> DataFrame:
    """run_id, status (the last terminal event's, else waiting or running), interrupted, n_events, last_error."""
    last = F.max_by(F.try_element_at(terminal_status(), F.col("type")), F.when(F.col("type").isin(*TERMINAL), F.col("seq")))
    waiting = F.max_by("type", "seq") == "WorkflowWaiting"
    error = F.max_by(of("WorkflowFailed", "error_message"), of("WorkflowFailed"))
    return j.groupBy("run_id").agg(F.coalesce(last, F.when(waiting, "waiting").otherwise("running")).alias("status"), F.bool_or(F.col("type") == "WorkflowResumed").alias("interrupted"), F.count("*").alias("n_events"), error.alias("last_error"))


def task_scan(j: DataFrame) -> DataFrame:
    """run_id, identity, first_seq, attempts, completed, exhausted, map_group of every call, in four task events."""
    failed = (F.col("type") == "TaskAttemptFailed") & F.col("next_delay").isNull()
    t = j.where(F.col("type").isin(*TASK_EVENTS))
    return t.groupBy("run_id", "identity").agg(F.min("seq").alias("first_seq"), F.coalesce(F.max(F.when(F.col("type").isin("TaskAttemptStarted", "TaskAttemptFailed"), F.col("attempt"))), F.lit(0)).alias("attempts"), F.bool_or(F.col("type") == "TaskCompleted").alias("completed"), F.bool_or(failed).alias("exhausted"), F.max(of("TaskScheduled", "map_group")).alias("map_group"))


def task_status(scan: DataFrame, runs: DataFrame) -> DataFrame:
    """completed, else failed (out of retries, or the run failed), else running."""
    run = runs.select("run_id", F.col("status").alias("run_status"))
    return scan.join(run, "run_id").withColumn("status", F.when(F.col("completed"), "completed").when(F.col("exhausted") | (F.col("run_status") == "failed"), "failed").otherwise("running")).drop("run_status")


def attempts(j: DataFrame) -> DataFrame:
    """Each start with the last outcome before the next start: started and ended times, seconds and status."""
    t = j.where(F.col("type").isin("TaskAttemptStarted", "TaskAttemptFailed", "TaskCompleted"))
    grouped = t.withColumn("n", F.sum(F.when(F.col("type") == "TaskAttemptStarted", 1).otherwise(0)).over(by_call())).where("n > 0")
    ended = F.when(F.col("type") != "TaskAttemptStarted", F.col("seq"))
    a = grouped.groupBy("run_id", "identity", F.col("n").cast("bigint").alias("attempt_no")).agg(F.min("seq").alias("start_seq"), F.min_by("ts", "seq").alias("started"), F.max_by("ts", ended).alias("ended"), F.max_by("type", ended).alias("outcome"))
    status = F.when(F.col("outcome").isNull(), "running").when(F.col("outcome") == "TaskCompleted", "completed").otherwise("failed")
    return a.select("run_id", "identity", "attempt_no", "start_seq", "started", "ended", seconds("started", "ended").alias("seconds"), status.alias("status"))


def seconds(a: str, b: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.col(a), F.col(b)) / 1e6


def task_detail(j: DataFrame) -> DataFrame:
    """Per call: input, output, attempts as an ordered array, usage of all attempts."""
    call = j.where(F.col("type").isin(*TASK_EVENTS)).groupBy("run_id", "identity").agg(F.max_by(of("TaskScheduled", "input_ref"), of("TaskScheduled")).alias("input"), F.max_by(of("TaskCompleted", "output_ref"), of("TaskCompleted")).alias("output"), F.sum(F.when(F.col("type").isin("TaskCompleted", "TaskAttemptFailed"), F.coalesce("usage_in", F.lit(0)))).alias("usage_in"))
    tries = attempts(j).groupBy("run_id", "identity").agg(F.sort_array(F.collect_list(F.struct("attempt_no", "status", "seconds"))).alias("attempts"))
    return call.join(tries, ["run_id", "identity"], "left")


def task_detail_full(j: DataFrame) -> DataFrame:
    """task_detail with each attempt's error, delay and usage, and the call's status and the run's error."""
    started = F.sum(F.when(F.col("type") == "TaskAttemptStarted", 1).otherwise(0)).over(by_call())
    ends = j.where(F.col("type").isin("TaskAttemptStarted", "TaskAttemptFailed", "TaskCompleted")).withColumn("n", started).where("n > 0 and type <> 'TaskAttemptStarted'")
    failed = of("TaskAttemptFailed", F.concat_ws(": ", "error_type", "error_message"))
    delay = of("TaskAttemptFailed", "next_delay")
    last = ends.groupBy("run_id", "identity", "n").agg(F.max_by(failed, F.when(failed.isNotNull(), F.col("seq"))).alias("error"), F.max_by(delay, F.when(delay.isNotNull(), F.col("seq"))).alias("next_delay"), F.sum("usage_in").alias("usage_in"), F.sum("usage_out").alias("usage_out"))
    tries = attempts(j).join(last.withColumnRenamed("n", "attempt_no"), ["run_id", "identity", "attempt_no"], "left")
    listed = tries.groupBy("run_id", "identity").agg(F.sort_array(F.collect_list(F.struct("attempt_no", "status", "seconds", "error", "next_delay", "usage_in", "usage_out"))).alias("attempts"))
    runs = run_status(j)
    calls = task_status(task_scan(j), runs).select("run_id", "identity", "status")
    return task_detail(j).drop("attempts").join(listed, ["run_id", "identity"], "left").join(calls, ["run_id", "identity"]).join(runs.select("run_id", F.col("last_error").alias("run_error")), "run_id")


def downtime(j: DataFrame) -> DataFrame:
    """Seconds between a resumption and the event before it; null for a first event."""
    before = j.withColumn("before", F.lag("ts").over(by_seq()))
    return before.where("type = 'WorkflowResumed'").select("run_id", "seq", seconds("before", "ts").alias("down_seconds"))


def call_ordinals(j: DataFrame) -> DataFrame:
    """n-th call of a task name in its run, from 0, for calls without a key."""
    w = Window.partitionBy("run_id", "task_name").orderBy("seq")
    return j.where("type = 'TaskScheduled' and key is null").select("run_id", "seq", "task_name", (F.row_number().over(w) - 1).cast("bigint").alias("call_ordinal"))


def schedule(j: DataFrame) -> DataFrame:
    """Place of each call without a key in its run's schedule, from 0."""
    return j.where("type = 'TaskScheduled' and key is null").select("run_id", "seq", "task_name", (F.row_number().over(by_seq()) - 1).cast("bigint").alias("position"))


def resume_numbers(j: DataFrame) -> DataFrame:
    """Next attempt number and failures so far of every call, as a resumed run goes on with them."""
    return j.where(F.col("identity").isNotNull()).groupBy("run_id", "identity").agg((F.coalesce(F.max(of("TaskAttemptStarted", "attempt")), F.lit(0)) + 1).cast("bigint").alias("next_attempt"), F.count_if(F.col("type") == "TaskAttemptFailed").alias("failures"))


def usage(j: DataFrame, failed_too: bool = True) -> DataFrame:
    """Usage entries of completed (and failed) attempts in journal order."""
    kinds = ["TaskCompleted", *(["TaskAttemptFailed"] if failed_too else [])]
    return j.where(F.col("type").isin(*kinds) & F.col("usage_in").isNotNull()).select("run_id", "seq", "identity", "usage_in", "usage_out")


def spend(j: DataFrame, by: list[str]) -> DataFrame:
    """Tokens, and price in millionths (3 for a token in, 15 for one out)."""
    return usage(j).groupBy(*by).agg(F.sum("usage_in").alias("tokens_in"), F.sum("usage_out").alias("tokens_out"), F.sum(F.col("usage_in") * 3 + F.col("usage_out") * 15).alias("micro_usd"))


def tally(j: DataFrame) -> DataFrame:
    """Events by run and type, with where the type first stands."""
    return j.groupBy("run_id", "type").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def group_status(items: DataFrame, by: list[str]) -> DataFrame:
    """Map groups: failed if any item failed, completed if all did, else running; with counts."""
    n = {s: F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("completed", "running", "failed")}
    status = F.when(F.bool_or(F.col("status") == "failed"), "failed").when(F.bool_and(F.col("status") == "completed"), "completed").otherwise("running")
    return items.groupBy(*by).agg(F.count("*").alias("total"), *n.values(), status.alias("status"))


def replay_facts(j: DataFrame) -> DataFrame:
    """What a replay needs of each call, in one aggregation: scheduled, attempts, failures, last output, outcome."""
    return j.where(F.col("identity").isNotNull()).groupBy("run_id", "identity").agg(F.bool_or(F.col("type") == "TaskScheduled").alias("scheduled"), F.coalesce(F.max(of("TaskAttemptStarted", "attempt")), F.lit(0)).alias("attempts"), F.count_if(F.col("type") == "TaskAttemptFailed").alias("failures"), F.max_by(of("TaskCompleted", "output_ref"), of("TaskCompleted")).alias("output"), F.bool_or(F.col("type") == "TaskFailed").alias("failed"), F.bool_or(F.col("type") == "TaskCompleted").alias("completed"))
