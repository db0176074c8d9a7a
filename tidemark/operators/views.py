"""Read views: run list, timeline, comparison of two runs, graphs of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.display import event_kind, summary
from tidemark.functions.values import MASK, redact_json, sensitive
from tidemark.session import cut

from .fold import of, run_status, seconds, task_scan, task_status


def run_list(j: DataFrame, current_version: str) -> DataFrame:
    """One row per run, oldest first: name, status, version mismatch, interrupted, own lineage (the last fork)."""
    head = j.groupBy("run_id").agg(F.max_by("workflow_name", F.when(F.col("workflow_name").isNotNull(), -F.col("seq"))).alias("workflow_name"), F.min("ts").alias("created_at"), F.max_by(of("WorkflowCreated", "code_version"), -of("WorkflowCreated")).alias("code_version"), F.max_by(of("RunForked", "source_run_id"), of("RunForked")).alias("source_run_id"), F.max_by(of("RunForked", "fork_point_seq"), of("RunForked")).alias("fork_point_seq"))
    return head.join(run_status(j), "run_id").withColumn("version_mismatch", F.coalesce(F.col("code_version") != current_version, F.lit(False))).orderBy("created_at", "run_id")


def timeline(j: DataFrame) -> DataFrame:
    """Ordered events with render kind, whether they mark an interruption, and a line of summary."""
    return j.select("run_id", "seq", "ts", "type", event_kind(F.col("type")).alias("kind"), (F.col("type") == "WorkflowResumed").alias("is_interruption"), summary({c: F.col(c) for c in j.columns}).alias("summary")).orderBy("run_id", "seq")


def timeline_text(j: DataFrame) -> DataFrame:
    """run_id, seq, part, line: the text timeline; a failure's traceback follows its line."""
    t = j.select("run_id", "seq", "type", "ts", "error_traceback", summary({c: F.col(c) for c in j.columns}).alias("s"))
    marker = F.when(F.col("type") == "WorkflowResumed", "⚡ ").otherwise("  ")
    place = F.when(F.length(F.col("seq").cast("string")) > 3, F.col("seq").cast("string")).otherwise(F.lpad(F.col("seq").cast("string"), 3, " "))
    line = F.concat(marker, place, F.lit("  "), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("  "), F.col("type"), F.when(F.col("s") != "", F.concat(F.lit("  "), F.col("s"))).otherwise(""))
    below = F.when((F.col("type") == "WorkflowFailed") & F.col("error_traceback").isNotNull(), F.transform(F.split(F.rtrim("error_traceback"), "\n"), lambda x: F.concat(F.lit("        "), x))).otherwise(F.array().cast("array<string>"))
    return t.select("run_id", "seq", F.posexplode(F.concat(F.array(line), below)).alias("part", "line"))


def compare_side(j: DataFrame) -> DataFrame:
    """Per call of each run: input, output, status, attempts, seconds from first start to last end."""
    t = j.where(F.col("identity").isNotNull())
    ended = F.when(F.col("type").isin("TaskCompleted", "TaskAttemptFailed"), F.col("seq"))
    side = t.groupBy("run_id", "identity").agg(F.max("task_name").alias("task_name"), F.max_by(of("TaskScheduled", "input_ref"), of("TaskScheduled")).alias("input"), F.max_by(of("TaskCompleted", "output_ref"), of("TaskCompleted")).alias("output"), F.min(of("TaskAttemptStarted", "ts")).alias("first_start"), F.max_by(F.when(ended.isNotNull(), F.col("ts")), ended).alias("last_end"))
    scan = task_status(task_scan(j), run_status(j)).select("run_id", "identity", "status", "attempts", "first_seq")
    return scan.join(side, ["run_id", "identity"]).withColumn("seconds", seconds("first_start", "last_end")).drop("first_start", "last_end")


def compare(j: DataFrame, left: str, right: str) -> DataFrame:
    """Full outer join of two runs' calls on identity, with a flag for each difference; seconds never count as a change."""
    two = compare_side(j.where(F.col("run_id").isin(left, right)))
    names = ("task_name", "input", "output", "status", "attempts", "seconds", "first_seq")

    def side(run: str, mark: str) -> DataFrame:
        return two.where(F.col("run_id") == run).select("identity", *(F.col(n).alias(f"{mark}_{n}") for n in names))

    both = side(left, "a").join(side(right, "b"), "identity", "full_outer")
    differs = {n: ~F.col(f"a_{n}").eqNullSafe(F.col(f"b_{n}")) for n in ("input", "output", "attempts", "seconds")}
    aligned = F.col("a_status").isNotNull() & F.col("b_status").isNotNull()
    return both.select("identity", F.coalesce("a_task_name", "b_task_name").alias("task_name"), aligned.alias("aligned"), *(c.alias(f"{n}_differs") for n, c in differs.items()), (~aligned | differs["input"] | differs["output"] | differs["attempts"]).alias("changed"), "a_status", "b_status", "a_first_seq", "b_first_seq")


def schedule_divergence(recorded: DataFrame, issued: DataFrame) -> DataFrame:
    """Places at which two schedules (run_id, position, task_name) name different tasks; first marks a run's first one."""
    both = recorded.alias("r").join(issued.alias("i"), ["run_id", "position"]).where("r.task_name <> i.task_name").select("run_id", "position", F.col("r.task_name").alias("recorded"), F.col("i.task_name").alias("issued"))
    first = both.groupBy("run_id").agg(F.min("position").alias("position"), F.lit(True).alias("first"))
    return both.join(first, ["run_id", "position"], "left").withColumn("first", F.coalesce("first", F.lit(False)))


def _paths(links: DataFrame) -> DataFrame:
    """start, end, depth of every path over links (start, end): each round doubles the reach, its paths go to the shared folder.

    A path longer than the reach is one of just that depth and one that begins where it ends, so each is made once. Only
    paths that begin at such an end are joined. A cycle has no last path and is an error.
    """
    made: list[DataFrame] = []
    new = links.select("start", "end", F.lit(1).alias("depth"))
    while True:
        new = cut(new, "paths")
        seen = new.agg(F.count("*").alias("n"), F.max(F.when(F.col("start") == F.col("end"), F.col("start"))).alias("cycle")).first()
        if seen["cycle"] is not None:
            raise ValueError(f"{seen['cycle']} is behind itself")
        made.append(new)
        if not seen["n"]:
            return reduce(DataFrame.union, made)
        reach = 1 << (len(made) - 1)
        longest = new.where(F.col("depth") == reach).select(F.col("start").alias("first"), F.col("end").alias("via"), F.col("depth").alias("before"))
        onward = reduce(DataFrame.union, made).join(longest.select(F.col("via").alias("start")).distinct(), "start", "left_semi")
        new = longest.join(onward, F.col("via") == F.col("start")).select(F.col("first").alias("start"), "end", (F.col("before") + F.col("depth")).alias("depth"))


def descendants(edges: DataFrame) -> DataFrame:
    """root, node, depth over parent -> child edges: transitive closure of a graph without cycles, of any depth."""
    return _paths(edges.select(F.col("parent").alias("start"), F.col("child").alias("end"))).toDF("root", "node", "depth")


def lineage_chain(forks: DataFrame) -> DataFrame:
    """run, ancestor, depth over run -> source links: the chain of forks behind each run, of any length."""
    return _paths(forks.select(F.col("run").alias("start"), F.col("source").alias("end"))).toDF("run", "ancestor", "depth")


def child_links(scheduled: DataFrame, runs: DataFrame) -> DataFrame:
    """Children with their runs' status; a child without a run is unknown."""
    known = runs.select(F.col("run_id").alias("child_run_id"), F.col("status").alias("child_status"))
    return scheduled.join(known, "child_run_id", "left").withColumn("child_status", F.coalesce("child_status", F.lit("unknown")))


def redacted(view: DataFrame, json_columns: tuple[str, ...] = ("input", "output", "input_ref", "output_ref", "payload")) -> DataFrame:
    """A view as readers see it: JSON columns redacted at any depth, columns of a sensitive name masked whole."""
    shown = {c: F.when(F.col(c).isNotNull(), F.lit(MASK)).alias(c) if sensitive(c) else redact_json(F.col(c)).alias(c) if c in json_columns else F.col(c) for c in view.columns}
    return view.select(*shown.values())


def timeline_header(j: DataFrame, current_version: str) -> DataFrame:
    """What stands above a run's timeline: its row of the run list, its span of seq, and versions side by side."""
    span = j.groupBy("run_id").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"))
    version = F.struct(F.col("code_version").alias("stamped"), F.lit(current_version).alias("current"), F.col("version_mismatch").alias("mismatch"))
    return run_list(j, current_version).join(span, "run_id").withColumn("version", version).drop("code_version", "version_mismatch")


def tree_nodes(j: DataFrame) -> DataFrame:
    """Nodes of the runs' trees: run_id, node, parent (null under the run), kind (map, task or child), name, status, seq.

    Map groups hold their items' calls; a child node names the run whose own nodes continue the tree. Nodes of a run are
    ordered by seq, the place at which each was first scheduled.
    """
    runs = run_status(j)
    calls = task_status(task_scan(j), runs)
    names = j.where("type = 'TaskScheduled'").groupBy("run_id", "identity").agg(F.max("task_name").alias("name"))
    grouped = F.when(F.col("map_group").isNotNull(), F.concat(F.lit("map:"), "map_group"))
    tasks = calls.join(names, ["run_id", "identity"], "left").select("run_id", F.concat(F.lit("task:"), "identity").alias("node"), grouped.alias("parent"), F.lit("task").alias("kind"), "name", "status", F.col("first_seq").alias("seq"))
    status = F.when(F.bool_or(F.col("status") == "failed"), "failed").when(F.bool_and(F.col("status") == "completed"), "completed").otherwise("running")
    groups = tasks.where("parent is not null").groupBy("run_id", "parent").agg(status.alias("status"), F.min("seq").alias("seq"))
    maps = groups.select("run_id", F.col("parent").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit("map").alias("kind"), F.regexp_replace("parent", "^map:", "").alias("name"), "status", "seq")
    children = j.where("type = 'ChildWorkflowScheduled'").groupBy("run_id", "child_run_id").agg(F.min("seq").alias("seq"), F.max("workflow_name").alias("name"))
    children = child_links(children, runs).select("run_id", F.concat(F.lit("child:"), "child_run_id").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit("child").alias("kind"), "name", F.col("child_status").alias("status"), "seq")
    return tasks.unionByName(maps).unionByName(children)
