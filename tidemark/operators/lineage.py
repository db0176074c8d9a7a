"""Forks: where to cut a journal, the copied prefix, what ran above it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fold import of, usage


def fork_point_before(j: DataFrame, task: str, ordinal: int | None = None) -> DataFrame:
    """run_id, fork_point: the last seq before a task is first scheduled (or its call of that ordinal), in terminal runs."""
    chosen = (F.col("type") == "TaskScheduled") & (F.col("task_name") == task) & (F.lit(True) if ordinal is None else F.col("ordinal") == ordinal)
    at = j.groupBy("run_id").agg(F.min(F.when(chosen, F.col("seq"))).alias("at"), F.bool_or(F.col("type").isin("WorkflowCompleted", "WorkflowFailed", "WorkflowCancelled")).alias("done"))
    return at.where("done and at > 1").select("run_id", (F.col("at") - 1).alias("fork_point"))


def resolve_fork_point(j: DataFrame, run_id: str, *, before_task: str | None = None, before_ordinal: int | None = None, fork_point_seq: int | None = None) -> int:
    """The inclusive seq to fork at, from exactly one selector (an ordinal narrows a task); only of a run that has ended.

    Errors name what there is: the run's status, its last seq, the tasks and ordinals that it ran.
    """
    if (before_task is None) == (fork_point_seq is None):
        raise ValueError("name either a task or a seq to fork at")
    own = j.where(F.col("run_id") == run_id)
    ended = F.bool_or(F.col("type").isin("WorkflowCompleted", "WorkflowFailed", "WorkflowCancelled"))
    run = own.agg(F.max("seq").alias("last"), ended.alias("ended")).first()
    if run["last"] is None:
        raise ValueError(f"no run {run_id}")
    if not run["ended"]:
        raise ValueError(f"{run_id} has not ended, so it cannot be forked")
    if fork_point_seq is not None:
        if not 1 <= fork_point_seq <= run["last"]:
            raise ValueError(f"{run_id} has seq 1 to {run['last']}")
        return fork_point_seq
    found = fork_point_before(own, before_task, before_ordinal).first()
    if found is None:
        calls = own.where("type = 'TaskScheduled'").groupBy("task_name").agg(F.sort_array(F.collect_set("ordinal")).alias("ordinals")).orderBy("task_name").collect()
        raise ValueError(f"{run_id} has nothing before {before_task}, or never ran it; it ran " + ", ".join(f"{r['task_name']} {r['ordinals']}" for r in calls))
    return found["fork_point"]


def fork(j: DataFrame, points: DataFrame, suffix: str = "-fork") -> DataFrame:
    """Journals of forks: each run's prefix up to its (inclusive) point with new event ids, and a row of lineage."""
    copied = j.join(points, "run_id").where("seq <= fork_point")
    name = F.concat("run_id", F.lit(suffix))
    event = lambda seq: F.substring(F.sha2(F.concat_ws("#", name, seq.cast("string")), 256), 1, 32)
    prefix = copied.select(name.alias("run_id"), "seq", event(F.col("seq")).alias("event_id"), "type", F.lit(None).cast("string").alias("source_run_id"))
    marker = copied.groupBy("run_id").agg(F.max("seq").alias("fork_point")).select(name.alias("run_id"), (F.col("fork_point") + 1).alias("seq"), event(F.col("fork_point") + 1).alias("event_id"), F.lit("RunForked").alias("type"), F.col("run_id").alias("source_run_id"))
    return prefix.unionByName(marker)


def fork_journal(events: DataFrame, points: DataFrame, suffix: str = "-fork", input_override: str | None = None) -> DataFrame:
    """Whole journals of forks, ready to be appended: events (sources.journal.ENVELOPE) up to each run's fork point.

    points: run_id, fork_point. The copied events keep seq, type, time and payload under new event ids; a RunForked event
    with the lineage follows. input_override (JSON) replaces the input of the WorkflowCreated event.
    """
    name = F.concat("run_id", F.lit(suffix))
    event = lambda seq: F.substring(F.sha2(F.concat_ws("#", name, seq.cast("string")), 256), 1, 32)
    copied = events.join(points, "run_id").where("seq <= fork_point")
    payload = F.col("payload")
    if input_override is not None:
        text = F.concat(F.lit('{"input_ref":' + input_override + ","), F.substring_index(F.to_json(F.map_filter(F.from_json("payload", "map<string,string>"), lambda k, _: k != "input_ref")), "{", -1))
        payload = F.when(F.col("type") == "WorkflowCreated", F.regexp_replace(text, r",\}$", "}")).otherwise(payload)
    prefix = copied.select(name.alias("run_id"), "seq", event(F.col("seq")).alias("event_id"), "type", "ts", payload.alias("payload"))
    last = copied.groupBy("run_id").agg(F.max("seq").alias("seq"), F.max_by("ts", "seq").alias("ts"))
    lineage = F.to_json(F.struct(F.col("run_id").alias("source_run_id"), F.col("seq").alias("fork_point_seq")))
    marker = last.select(name.alias("run_id"), (F.col("seq") + 1).alias("seq"), event(F.col("seq") + 1).alias("event_id"), F.lit("RunForked").alias("type"), "ts", lineage.alias("payload"))
    return prefix.unionByName(marker)


def above_marker(j: DataFrame) -> DataFrame:
    """Events after a run's first fork marker; all events of runs without one."""
    mark = j.groupBy("run_id").agg(F.coalesce(F.min(of("RunForked")), F.lit(0)).alias("_mark"))
    return j.join(mark, "run_id").where("seq > _mark").drop("_mark")


def reuse(j: DataFrame) -> DataFrame:
    """Calls of a run, those executed above its fork marker, those reused, and tokens above and in all."""
    calls = lambda d: d.where("type = 'TaskScheduled'").groupBy("run_id").agg(F.countDistinct("identity").alias("n"))
    spent = lambda d: usage(d).groupBy("run_id").agg(F.sum("usage_in").alias("t"))
    own = above_marker(j)
    out = calls(j).withColumnRenamed("n", "calls").join(calls(own).withColumnRenamed("n", "executed"), "run_id", "left").join(spent(j).withColumnRenamed("t", "tokens"), "run_id", "left").join(spent(own).withColumnRenamed("t", "own_tokens"), "run_id", "left")
    out = out.fillna(0, ["executed", "tokens", "own_tokens"])
    return out.withColumn("reused", F.col("calls") - F.col("executed"))


def check(differences: int, policy: str, what: str) -> None:
    """Nondeterminism and version policies: strict raises, warn warns, off is silent."""
    import warnings

    if policy not in ("off", "warn", "strict"):
        raise ValueError(f"no policy {policy!r}")
    if differences and policy == "strict":
        raise RuntimeError(f"{differences} {what}")
    if differences and policy == "warn":
        warnings.warn(f"{differences} {what}", stacklevel=2)
