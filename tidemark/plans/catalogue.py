"""Queries over the driver's tables, one for each operator group, with SQL twins for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from tidemark.functions import display, identity, prompts, values
from tidemark.operators import fanout, fold, lineage, runs, tasks, views, waits
from tidemark.session import ship
from tidemark.sources.journal import insert_new, next_seq, parse_lines, run_by_key

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# The journal bound to the events table: a user is a run; the event's type and number decide what it stands for.
_KIND = """CASE event_type
 WHEN 'signup' THEN CASE k % 6 WHEN 0 THEN 'WorkflowCreated' WHEN 1 THEN 'WorkflowResumed' WHEN 2 THEN 'WorkflowCompleted' WHEN 3 THEN 'WorkflowFailed' WHEN 4 THEN 'WorkflowCancelled' ELSE 'WorkflowWaiting' END
 WHEN 'view' THEN CASE k % 9 WHEN 0 THEN 'ChildWorkflowScheduled' WHEN 1 THEN 'RunForked' WHEN 2 THEN 'EventWaitStarted' ELSE 'TaskScheduled' END
 WHEN 'click' THEN CASE k % 9 WHEN 0 THEN 'TimerCreated' ELSE 'TaskAttemptStarted' END
 WHEN 'error' THEN CASE k % 9 WHEN 0 THEN 'TimerFired' WHEN 1 THEN 'TaskFailed' ELSE 'TaskAttemptFailed' END
 ELSE CASE k % 9 WHEN 0 THEN 'ExternalEventReceived' ELSE 'TaskCompleted' END END"""
_STEP1 = """SELECT cast(user_id AS {S}) AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_id, ts, user_id, k, cents, {KIND} AS type
FROM (SELECT *, cast({JSON} AS bigint) AS k, cast(floor(value * 100) AS bigint) AS cents FROM {EVENTS}) e"""
_STEP2 = """SELECT run_id, cast(seq AS bigint) AS seq, event_id, ts, type, k, cents, user_id,
 concat('wf_', cast(user_id % 3 AS {S})) AS workflow_name, concat('v', cast(user_id % 2 AS {S})) AS code_version,
 CASE WHEN type LIKE 'Task%' THEN concat('task_', cast(k % 5 AS {S})) END AS task_name,
 CASE WHEN type LIKE 'Task%' AND k % 2 = 1 THEN k % 3 END AS ordinal,
 CASE WHEN type LIKE 'Task%' AND k % 2 = 0 THEN concat('k', cast(k % 4 AS {S})) END AS key,
 CASE WHEN type LIKE 'Task%' THEN CASE WHEN k % 2 = 0 THEN concat('task_', cast(k % 5 AS {S}), ':key:k', cast(k % 4 AS {S})) ELSE concat('task_', cast(k % 5 AS {S}), ':', cast(k % 3 AS {S})) END END AS identity,
 CASE WHEN type = 'TaskScheduled' AND k % 2 = 0 THEN concat('map_', cast(k % 5 AS {S})) END AS map_group,
 1 + k % 3 AS attempt, CASE WHEN type = 'TaskAttemptFailed' AND k % 4 <> 3 THEN cast(k % 8 AS double) / 2 END AS next_delay,
 CASE WHEN k % 10 <> 0 THEN cents END AS usage_in, k AS usage_out,
 concat(chr(123), '"v":', cast(k AS {S}), chr(125)) AS input_ref, concat(chr(123), '"o":', cast(cents % 10 AS {S}), chr(125)) AS output_ref,
 'ValueError' AS error_type, concat('bad ', cast(k AS {S})) AS error_message, concat('Traceback', {NL}, '  line ', cast(k AS {S}), {NL}) AS error_traceback,
 cast((user_id + 1 + k) % 500 AS {S}) AS child_run_id, cast((user_id + k) % 500 AS {S}) AS source_run_id, cents % 7 AS fork_point_seq
FROM {STEP1}"""


def _text(s: str, json: str, nl: str, events: str, step1: str) -> tuple[str, str]:
    one = _STEP1.format(S=s, KIND=_KIND, JSON=json, EVENTS=events)
    return one, _STEP2.format(S=s, NL=nl, STEP1=step1)


_ONE, _TWO = _text("varchar", "json_extract_string(props, '$.k')", "chr(10)", "events", "step1")
J = f"WITH RECURSIVE step1 AS ({_ONE}), j AS ({_TWO})"
#: Tasks of a run and their statuses, for twins that build on them.
SCAN = """, st AS (SELECT run_id, coalesce(CASE arg_max(type, seq) FILTER (WHERE type IN ('WorkflowCompleted', 'WorkflowFailed', 'WorkflowCancelled')) WHEN 'WorkflowCompleted' THEN 'completed' WHEN 'WorkflowFailed' THEN 'failed' WHEN 'WorkflowCancelled' THEN 'cancelled' END,
 CASE WHEN arg_max(type, seq) = 'WorkflowWaiting' THEN 'waiting' ELSE 'running' END) AS status, bool_or(type = 'WorkflowResumed') AS interrupted, count(*) AS n_events, arg_max(error_message, seq) FILTER (WHERE type = 'WorkflowFailed') AS last_error FROM j GROUP BY run_id),
scan AS (SELECT run_id, identity, min(seq) AS first_seq, coalesce(max(attempt) FILTER (WHERE type IN ('TaskAttemptStarted', 'TaskAttemptFailed')), 0) AS attempts, bool_or(type = 'TaskCompleted') AS completed, bool_or(type = 'TaskAttemptFailed' AND next_delay IS NULL) AS exhausted, max(map_group) FILTER (WHERE type = 'TaskScheduled') AS map_group
 FROM j WHERE type IN ('TaskScheduled', 'TaskAttemptStarted', 'TaskAttemptFailed', 'TaskCompleted') GROUP BY run_id, identity),
ts AS (SELECT scan.*, CASE WHEN completed THEN 'completed' WHEN exhausted OR st.status = 'failed' THEN 'failed' ELSE 'running' END AS status FROM scan JOIN st USING (run_id))"""
_AT = "(SELECT *, sum(CASE WHEN type = 'TaskAttemptStarted' THEN 1 ELSE 0 END) OVER (PARTITION BY run_id, identity ORDER BY seq) AS n FROM j WHERE type IN ('TaskAttemptStarted', 'TaskAttemptFailed', 'TaskCompleted'))"
ATTEMPTS = f"""SELECT run_id, identity, n::BIGINT AS attempt_no, min(seq) AS start_seq, epoch_us(arg_min(ts, seq)) AS started, epoch_us(arg_max(ts, seq) FILTER (WHERE type <> 'TaskAttemptStarted')) AS ended,
 CASE coalesce(arg_max(type, seq) FILTER (WHERE type <> 'TaskAttemptStarted'), '') WHEN '' THEN 'running' WHEN 'TaskCompleted' THEN 'completed' ELSE 'failed' END AS status FROM {_AT} WHERE n > 0 GROUP BY run_id, identity, n"""


def journal(spark: SparkSession, sf_dir: str) -> DataFrame:
    one, two = _text("string", "get_json_object(props, '$.k')", "chr(10)", "{events}", "{step1}")
    step1 = spark.sql(one, events=table(spark, sf_dir, "events"))
    return spark.sql(two, step1=step1)


def us(c: str):
    return F.unix_micros(F.col(c).cast("timestamp")).alias(c)


@query(J + " SELECT run_id, seq, event_id FROM j")
def journal_seq(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), "ts", "event_id")
    return next_seq(e, None, ["ts", "event_id"]).select("run_id", "seq", "event_id")


@query(J + SCAN + " SELECT run_id, status, interrupted, n_events::BIGINT AS n_events, last_error FROM st")
def run_status(spark, d):
    return fold.run_status(journal(spark, d))


@query(J + SCAN + ", h AS (SELECT run_id, arg_min(workflow_name, seq) AS workflow_name, epoch_us(min(ts)) AS created_at, arg_min(code_version, seq) FILTER (WHERE type = 'WorkflowCreated') AS code_version, arg_max(source_run_id, seq) FILTER (WHERE type = 'RunForked') AS source_run_id, arg_max(fork_point_seq, seq) FILTER (WHERE type = 'RunForked') AS fork_point_seq FROM j GROUP BY run_id) SELECT h.*, status, interrupted, coalesce(code_version <> 'v1', false) AS version_mismatch FROM h JOIN st USING (run_id)")
def run_list(spark, d):
    return views.run_list(journal(spark, d), "v1").select("run_id", "workflow_name", us("created_at"), "code_version", "source_run_id", "fork_point_seq", "status", "interrupted", "version_mismatch")


_NAMED = "'task=' || task_name || CASE WHEN key IS NOT NULL THEN ' key=' || key ELSE ' ordinal=' || ordinal END"
_SUMMARY = f"""CASE type WHEN 'WorkflowCreated' THEN 'workflow=' || workflow_name || ' code_version=' || code_version WHEN 'ChildWorkflowScheduled' THEN 'child=' || workflow_name || ' run_id=' || child_run_id
 WHEN 'TaskScheduled' THEN {_NAMED} WHEN 'TaskCompleted' THEN {_NAMED} WHEN 'TaskAttemptStarted' THEN {_NAMED} || ' attempt=' || attempt
 WHEN 'TaskAttemptFailed' THEN {_NAMED} || ' attempt=' || attempt || ' error=' || error_type || ': ' || error_message || CASE WHEN next_delay IS NULL THEN '' ELSE printf(' next_delay=%.3fs', next_delay) END
 WHEN 'WorkflowFailed' THEN 'error=' || error_type || ': ' || error_message ELSE '' END"""


@query(J + f" SELECT run_id, seq, epoch_us(ts) AS ts, type, CASE {' '.join(f'''WHEN type = '{k}' THEN '{v}' ''' for k, v in display.EVENT_KINDS.items())} ELSE 'lifecycle' END AS kind, type = 'WorkflowResumed' AS is_interruption, {_SUMMARY} AS summary FROM j")
def timeline_rows(spark, d):
    return views.timeline(journal(spark, d)).select("run_id", "seq", us("ts"), "type", "kind", "is_interruption", "summary")


@query(J + f""", t AS (SELECT *, {_SUMMARY} AS s FROM j)
SELECT run_id, seq, 0 AS part, CASE WHEN type = 'WorkflowResumed' THEN '⚡ ' ELSE '  ' END || CASE WHEN seq > 999 THEN seq::VARCHAR ELSE lpad(seq::VARCHAR, 3, ' ') END || '  ' || strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '  ' || type || CASE WHEN s <> '' THEN '  ' || s ELSE '' END AS line FROM t
UNION ALL SELECT run_id, seq, 1, '        Traceback' FROM t WHERE type = 'WorkflowFailed' UNION ALL SELECT run_id, seq, 2, '          line ' || k FROM t WHERE type = 'WorkflowFailed'""")
def timeline_text(spark, d):
    return views.timeline_text(journal(spark, d).withColumn("error_traceback", F.rtrim("error_traceback", F.lit("\n"))))


@query(J + " SELECT run_id, seq, date_diff('microsecond', b, ts) / 1e6 AS down_seconds FROM (SELECT *, lag(ts) OVER (PARTITION BY run_id ORDER BY seq) AS b FROM j) WHERE type = 'WorkflowResumed'")
def downtime(spark, d):
    return fold.downtime(journal(spark, d))


@query(J + SCAN + " SELECT run_id, identity, first_seq, attempts::BIGINT AS attempts, completed, exhausted, map_group FROM scan")
def task_scan(spark, d):
    return fold.task_scan(journal(spark, d))


@query(J + SCAN + " SELECT run_id, identity, status FROM ts")
def task_status(spark, d):
    j = journal(spark, d)
    return fold.task_status(fold.task_scan(j), fold.run_status(j)).select("run_id", "identity", "status")


@query(J + f" SELECT *, (ended - started) / 1e6 AS seconds FROM ({ATTEMPTS})")
def attempts(spark, d):
    return fold.attempts(journal(spark, d)).withColumns({c: us(c) for c in ("started", "ended")})


@query(J + f""", a AS ({ATTEMPTS}), c AS (SELECT run_id, identity, arg_max(input_ref, seq) FILTER (WHERE type = 'TaskScheduled') AS input, arg_max(output_ref, seq) FILTER (WHERE type = 'TaskCompleted') AS output, coalesce(sum(coalesce(usage_in, 0)) FILTER (WHERE type IN ('TaskCompleted', 'TaskAttemptFailed')), 0)::BIGINT AS usage_in FROM j WHERE type IN ('TaskScheduled', 'TaskAttemptStarted', 'TaskAttemptFailed', 'TaskCompleted') GROUP BY run_id, identity),
l AS (SELECT run_id, identity, string_agg(attempt_no || ':' || status, ',' ORDER BY attempt_no) AS attempts FROM a GROUP BY run_id, identity)
SELECT c.*, l.attempts FROM c LEFT JOIN l USING (run_id, identity)""")
def task_detail(spark, d):
    t = fold.task_detail(journal(spark, d))
    return t.select("run_id", "identity", "input", "output", F.coalesce("usage_in", F.lit(0)).alias("usage_in"), F.array_join(F.transform("attempts", lambda a: F.concat(a["attempt_no"].cast("string"), F.lit(":"), a["status"])), ",").alias("attempts"))


@query(J + " SELECT run_id, seq, task_name, row_number() OVER (PARTITION BY run_id, task_name ORDER BY seq) - 1 AS call_ordinal FROM j WHERE type = 'TaskScheduled' AND key IS NULL")
def call_ordinals(spark, d):
    return fold.call_ordinals(journal(spark, d))


@query(J + " SELECT run_id, seq, task_name, row_number() OVER (PARTITION BY run_id ORDER BY seq) - 1 AS position FROM j WHERE type = 'TaskScheduled' AND key IS NULL")
def schedule_positions(spark, d):
    return fold.schedule(journal(spark, d))


@query(J + " SELECT run_id, identity, coalesce(max(attempt) FILTER (WHERE type = 'TaskAttemptStarted'), 0) + 1 AS next_attempt, count(*) FILTER (WHERE type = 'TaskAttemptFailed') AS failures FROM j WHERE identity IS NOT NULL GROUP BY ALL")
def resume_numbers(spark, d):
    return fold.resume_numbers(journal(spark, d))


@query(J + " SELECT run_id, identity, bool_or(type = 'TaskScheduled') AS scheduled, coalesce(max(attempt) FILTER (WHERE type = 'TaskAttemptStarted'), 0)::BIGINT AS attempts, count(*) FILTER (WHERE type = 'TaskAttemptFailed') AS failures, arg_max(output_ref, seq) FILTER (WHERE type = 'TaskCompleted') AS output, bool_or(type = 'TaskFailed') AS failed, bool_or(type = 'TaskCompleted') AS completed FROM j WHERE identity IS NOT NULL GROUP BY run_id, identity")
def replay_facts(spark, d):
    return fold.replay_facts(journal(spark, d))


@query(J + " SELECT run_id, seq, identity, usage_in, usage_out FROM j WHERE type IN ('TaskCompleted', 'TaskAttemptFailed') AND usage_in IS NOT NULL")
def usage_all(spark, d):
    return fold.usage(journal(spark, d))


@query(J + " SELECT run_id, seq, identity, usage_in, usage_out FROM j WHERE type = 'TaskCompleted' AND usage_in IS NOT NULL")
def usage_completed_only(spark, d):
    return fold.usage(journal(spark, d), failed_too=False)


@query(J + " SELECT run_id, sum(usage_in)::BIGINT AS tokens_in, sum(usage_out)::BIGINT AS tokens_out, sum(usage_in * 3 + usage_out * 15)::BIGINT AS micro_usd FROM j WHERE type IN ('TaskCompleted', 'TaskAttemptFailed') AND usage_in IS NOT NULL GROUP BY run_id")
def spend(spark, d):
    return fold.spend(journal(spark, d), ["run_id"])


@query(J + " SELECT run_id, type, count(*) AS n, min(seq) AS first_seq FROM j GROUP BY run_id, type")
def tally(spark, d):
    return fold.tally(journal(spark, d))


@query(J + " SELECT key, count(*) AS n FROM j WHERE type = 'TaskAttemptStarted' AND key IS NOT NULL GROUP BY key")
def attempts_per_key(spark, d):
    return journal(spark, d).where("type = 'TaskAttemptStarted'").select(identity.key_of(F.col("identity")).alias("key")).where("key is not null").groupBy("key").agg(F.count("*").alias("n"))


@query(J + " SELECT task_name, sum(coalesce(next_delay, 0)) AS total_delay, count(*) AS failures, max(attempt)::BIGINT AS last_attempt FROM j WHERE type = 'TaskAttemptFailed' GROUP BY task_name")
def backoff_total(spark, d):
    return journal(spark, d).where("type = 'TaskAttemptFailed'").groupBy("task_name").agg(F.sum(F.coalesce("next_delay", F.lit(0.0))).alias("total_delay"), F.count("*").alias("failures"), F.max("attempt").alias("last_attempt"))


@query(J + " SELECT run_id, sum(length(input_ref))::BIGINT AS chars, sum(cents)::BIGINT AS cents, count(*) FILTER (WHERE type = 'WorkflowResumed') AS resumes, count(DISTINCT key) AS n_keys FROM j GROUP BY run_id")
def simple_totals(spark, d):
    return journal(spark, d).groupBy("run_id").agg(F.sum(F.length("input_ref")).alias("chars"), F.sum("cents").alias("cents"), F.count_if(F.col("type") == "WorkflowResumed").alias("resumes"), F.countDistinct("key").alias("n_keys"))


_ITEMS = "SELECT l_orderkey, l_partkey, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'completed' END ELSE 'running' END AS status FROM lineitem JOIN orders ON o_orderkey = l_orderkey"


def _items(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    status = F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", F.when(F.col("l_returnflag") == "R", "failed").otherwise("completed")).otherwise("running")
    return table(spark, d, "lineitem").join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_partkey", status.alias("status"))


@query(f"SELECT l_orderkey, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS n_completed, count(*) FILTER (WHERE status = 'running') AS n_running, count(*) FILTER (WHERE status = 'failed') AS n_failed FROM ({_ITEMS}) GROUP BY l_orderkey")
def map_summary(spark, d):
    return fold.group_status(_items(spark, d), ["l_orderkey"]).drop("status")


@query(f"SELECT l_orderkey, CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_and(status = 'completed') THEN 'completed' ELSE 'running' END AS status FROM ({_ITEMS}) GROUP BY l_orderkey")
def map_status(spark, d):
    return fold.group_status(_items(spark, d), ["l_orderkey"]).select("l_orderkey", "status")


@query("SELECT l_suppkey, count(*) AS n_rows, count(DISTINCT l_partkey) AS n_parts FROM lineitem GROUP BY l_suppkey")
def ledger_counts(spark, d):
    return table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n_rows"), F.countDistinct("l_partkey").alias("n_parts"))


@query("SELECT source, cast(sum(n_chars) AS double) / count(*) AS mean_chars, arg_max(doc_id, n_chars * 1000000 - doc_id) AS longest, row_number() OVER (ORDER BY cast(sum(n_chars) AS double) / count(*) DESC, source) AS rank FROM documents GROUP BY source")
def fan_in_rank(spark, d):
    s = table(spark, d, "documents").groupBy("source").agg((F.sum("n_chars").cast("double") / F.count("*")).alias("mean_chars"), F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("longest"))
    return s.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("mean_chars"), "source")).cast("bigint"))  # a row for each source


@query("SELECT lang, arg_min(doc_id, -n_chars * 1000000 + doc_id) AS winner, max(n_chars) AS n_chars, max(quality) AS quality FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def argmax_first(spark, d):
    labels = table(spark, d, "labels").select("doc_id", "quality")
    return table(spark, d, "documents").join(labels, "doc_id", "left").groupBy("lang").agg(F.max_by("doc_id", F.struct("n_chars", -F.col("doc_id"))).alias("winner"), F.max("n_chars").alias("n_chars"), F.max("quality").alias("quality"))


@query("""SELECT doc_id, len(f)::BIGINT AS n_cited, len(list_filter(f, lambda x: NOT list_contains(['the', 'The', 'that'], x)))::BIGINT AS n_unknown, len(list_filter(f, lambda x: NOT list_contains(['the', 'The', 'that'], x))) = 0 AS clean FROM (SELECT doc_id, list_distinct(regexp_extract_all(text, 'th[a-z]*|The')) AS f FROM documents)""")
def citation_audit(spark, d):
    cited = F.array_sort(F.array_distinct(F.regexp_extract_all("text", F.lit("th[a-z]*|The"), 0)))
    known = F.array(*(F.lit(x) for x in ("the", "The", "that")))
    return table(spark, d, "documents").select("doc_id", F.size(cited).cast("bigint").alias("n_cited"), F.size(F.array_except(cited, known)).cast("bigint").alias("n_unknown"), (F.size(F.array_except(cited, known)) == 0).alias("clean"))


_SIDE = J + SCAN + """, side AS (SELECT run_id, identity, max(task_name) AS task_name, arg_max(input_ref, seq) FILTER (WHERE type = 'TaskScheduled') AS input, arg_max(output_ref, seq) FILTER (WHERE type = 'TaskCompleted') AS output,
 date_diff('microsecond', min(ts) FILTER (WHERE type = 'TaskAttemptStarted'), arg_max(ts, seq) FILTER (WHERE type IN ('TaskCompleted', 'TaskAttemptFailed'))) / 1e6 AS seconds FROM j WHERE identity IS NOT NULL GROUP BY run_id, identity),
two AS (SELECT ts.run_id, identity, status, attempts, first_seq, task_name, input, output, seconds FROM ts JOIN side USING (run_id, identity)),
cmp AS (SELECT coalesce(a.identity, b.identity) AS identity, coalesce(a.task_name, b.task_name) AS task_name, a.status IS NOT NULL AND b.status IS NOT NULL AS aligned, a.input IS DISTINCT FROM b.input AS input_differs, a.output IS DISTINCT FROM b.output AS output_differs, a.attempts IS DISTINCT FROM b.attempts AS attempts_differs, a.seconds IS DISTINCT FROM b.seconds AS seconds_differs, a.status AS a_status, b.status AS b_status, a.first_seq AS a_first_seq, b.first_seq AS b_first_seq
 FROM (SELECT * FROM two WHERE run_id = '1') a FULL OUTER JOIN (SELECT * FROM two WHERE run_id = '2') b ON a.identity = b.identity),
cc AS (SELECT *, NOT aligned OR input_differs OR output_differs OR attempts_differs AS changed FROM cmp)"""


@query(_SIDE + " SELECT * FROM cc")
def compare_runs(spark, d):
    return views.compare(journal(spark, d), "1", "2")


@query(_SIDE + " SELECT count(*) FILTER (WHERE changed) AS changed, count(*) AS calls FROM cc")
def compare_changed(spark, d):
    return views.compare(journal(spark, d), "1", "2").agg(F.count_if("changed").alias("changed"), F.count("*").alias("calls"))


@query(_SIDE + " SELECT row_number() OVER (ORDER BY a_first_seq NULLS LAST, identity) AS place, identity, changed FROM cc")
def compare_in_schedule_order(spark, d):
    w = Window.orderBy(F.col("a_first_seq").asc_nulls_last(), "identity")  # the calls of two runs
    return views.compare(journal(spark, d), "1", "2").select(F.row_number().over(w).cast("bigint").alias("place"), "identity", "changed")


@query(J + ", s AS (SELECT run_id, cast(run_id AS bigint) AS r, task_name, row_number() OVER (PARTITION BY run_id ORDER BY seq) - 1 AS position FROM j WHERE type = 'TaskScheduled' AND key IS NULL), x AS (SELECT a.run_id, a.position, a.task_name AS recorded, b.task_name AS issued FROM s a JOIN s b ON b.r = a.r + 1 AND a.position = b.position AND a.task_name <> b.task_name) SELECT *, position = min(position) OVER (PARTITION BY run_id) AS first FROM x")
def schedule_divergence(spark, d):
    s = fold.schedule(journal(spark, d))
    issued = s.withColumn("run_id", (F.col("run_id").cast("bigint") - 1).cast("string"))
    return views.schedule_divergence(s, issued)


_REQ = "(SELECT o_orderkey AS k, o_totalprice AS item FROM orders)"
_DONE = "(SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY l_orderkey)"


def _requests(spark, d):
    done = table(spark, d, "lineitem").where("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("k")).agg(F.count("*").alias("n"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("item")), done


@query(f"SELECT k, item, n FROM {_REQ} JOIN {_DONE} USING (k)")
def hits(spark, d):
    return fanout.hits(*_requests(spark, d), ["k"])


@query(f"SELECT k, item FROM {_REQ} ANTI JOIN {_DONE} USING (k)")
def misses(spark, d):
    return fanout.misses(*_requests(spark, d), ["k"])


def _map_items(spark, d):
    docs = table(spark, d, "documents")
    items = docs.select(F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("key"), F.coalesce("text", F.lit("")).alias("item"))
    return items, items.where("pos % 3 = 0").select("key", F.to_json(F.struct(F.length("item").alias("n"))).alias("output"))


def _count_chars(item: str) -> dict:
    if item[:1] in "AEIOU":
        raise ValueError(f"begins with {item[:1]}")
    return {"n": len(item)}


_MAP_TEXTS = """SELECT doc_id AS pos, doc_id::VARCHAR AS key, CASE WHEN doc_id % 3 = 0 THEN 'hit' WHEN bad THEN 'failed' ELSE 'completed' END AS status, CASE WHEN doc_id % 3 = 0 OR NOT bad THEN '{"n":' || length(item) || '}' END AS output, CASE WHEN doc_id % 3 <> 0 AND bad THEN 'ValueError: begins with ' || substring(item, 1, 1) END AS error, CASE WHEN doc_id % 3 = 0 THEN 0 WHEN bad THEN 3 ELSE 1 END::INT AS attempts
FROM (SELECT doc_id, coalesce(text, '') AS item, substring(coalesce(text, ''), 1, 1) IN ('A', 'E', 'I', 'O', 'U', '') AS bad FROM documents)"""


@query(_MAP_TEXTS)
def collect_map(spark, d):
    return fanout.memoised_map(*_map_items(spark, d), _count_chars, retries=2, collect=True, ordered=False)


@query("SELECT pos, key, status, CASE WHEN status = 'hit' THEN output ELSE '{\"bad\":' || bad || ',\"n\":' || length(item) || '}' END AS output, NULL::VARCHAR AS error, CASE WHEN status = 'hit' THEN 0 ELSE 1 END::INT AS attempts FROM (SELECT doc_id AS pos, doc_id::VARCHAR AS key, CASE WHEN doc_id % 3 = 0 THEN 'hit' ELSE 'completed' END AS status, coalesce(text, '') AS item, '{\"n\":' || length(coalesce(text, '')) || '}' AS output, substring(coalesce(text, ''), 1, 1) IN ('A', 'E', 'I', 'O', 'U', '') AS bad FROM documents)")
def memoised_map(spark, d):
    return fanout.memoised_map(*_map_items(spark, d), lambda item: {"bad": item[:1] in "AEIOU", "n": len(item)}, ordered=False)


@query(_MAP_TEXTS)
def collect_map_texts(spark, d):
    return fanout.memoised_map(*_map_items(spark, d), _count_chars, retries=2, collect=True)


@query("""SELECT doc_id AS pos, doc_id::VARCHAR AS key, CASE WHEN doc_id % 3 = 0 THEN 'hit' ELSE 'completed' END AS status, '{"n":' || length(coalesce(text, '')) || '}' AS output, NULL::VARCHAR AS error, CASE WHEN doc_id % 3 = 0 THEN 0 ELSE 1 END::INT AS attempts FROM documents""")
def memoised_map_texts(spark, d):
    return fanout.memoised_map(*_map_items(spark, d), lambda item: {"n": len(item)})


@query("SELECT min(doc_id) AS pos, 'ValueError: begins with ' || arg_min(text[1], doc_id) AS error FROM documents WHERE doc_id % 3 <> 0 AND substring(text, 1, 1) IN ('A', 'E', 'I', 'O', 'U', '')")
def fail_fast_map(spark, d):
    out = fanout.memoised_map(*_map_items(spark, d), _count_chars, collect=True)
    bad = F.when(F.col("status") == "failed", F.col("pos"))
    return out.agg(F.min(bad).alias("pos"), F.min_by("error", bad).alias("error"))


@query(J + " SELECT run_id, seq, least(60.0, pow(2.0, attempt - 1))::DOUBLE AS ceiling, true AS within FROM j WHERE type = 'TaskAttemptFailed'")
def retry_attempts(spark, d):
    j = journal(spark, d).where("type = 'TaskAttemptFailed'")
    top, delay = identity.backoff_ceiling(F.col("attempt")), identity.backoff_delay(F.col("identity"), F.col("attempt"))
    return j.select("run_id", "seq", top.alias("ceiling"), ((delay >= 0) & (delay <= top)).alias("within"))


@query(J + SCAN + ", c AS (SELECT run_id, seq, child_run_id FROM j WHERE type = 'ChildWorkflowScheduled') SELECT c.*, coalesce(st.status, 'unknown') AS child_status FROM c LEFT JOIN st ON st.run_id = child_run_id")
def child_links(spark, d):
    j = journal(spark, d)
    return views.child_links(j.where("type = 'ChildWorkflowScheduled'").select("run_id", "seq", "child_run_id"), fold.run_status(j))


_EDGES = "(SELECT 'r' || r_regionkey AS parent, 'n' || n_nationkey AS child FROM region JOIN nation ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"


def _edges(spark, d):
    n = table(spark, d, "nation").select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("parent"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("child"))
    c = table(spark, d, "customer").select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("parent"), F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("child"))
    return n.union(c)


_CLOSURE = f"WITH RECURSIVE t(root, node, depth) AS (SELECT parent, child, 1 FROM {_EDGES} UNION ALL SELECT t.root, e.child, t.depth + 1 FROM t JOIN {_EDGES} e ON e.parent = t.node) "


@query(_CLOSURE + "SELECT root, node, depth FROM t")
def descendants(spark, d):
    return views.descendants(_edges(spark, d))


@query(_CLOSURE + "SELECT root, max(depth) AS levels, count(*) AS n_nodes, min(node) AS first_node FROM t WHERE root LIKE 'r%' GROUP BY root")
def call_tree(spark, d):
    return views.descendants(_edges(spark, d)).where("root like 'r%'").groupBy("root").agg(F.max("depth").alias("levels"), F.count("*").alias("n_nodes"), F.min("node").alias("first_node"))


@query("WITH RECURSIVE f AS (SELECT o_orderkey AS run, o_orderkey // 3 AS source FROM orders WHERE o_orderkey > 0), t(run, ancestor, depth) AS (SELECT run, source, 1 FROM f UNION ALL SELECT t.run, f.source, t.depth + 1 FROM t JOIN f ON f.run = t.ancestor) SELECT run, ancestor, depth FROM t")
def lineage_chain(spark, d):
    return views.lineage_chain(table(spark, d, "orders").where("o_orderkey > 0").select(F.col("o_orderkey").alias("run"), F.expr("o_orderkey div 3").alias("source")))


_POINTS = ", p AS (SELECT run_id, min(seq) FILTER (WHERE type = 'TaskScheduled' AND task_name = 'task_2') - 1 AS fork_point FROM j GROUP BY run_id HAVING bool_or(type IN ('WorkflowCompleted', 'WorkflowFailed', 'WorkflowCancelled')) AND min(seq) FILTER (WHERE type = 'TaskScheduled' AND task_name = 'task_2') > 1)"


@query(J + _POINTS + " SELECT * FROM p")
def fork_point_before_task(spark, d):
    return lineage.fork_point_before(journal(spark, d), "task_2")


@query(J + _POINTS + ", f AS (SELECT j.run_id || '-fork' AS run_id, seq, type, NULL::VARCHAR AS source_run_id FROM j JOIN p USING (run_id) WHERE seq <= fork_point UNION ALL SELECT run_id || '-fork', fork_point + 1, 'RunForked', run_id FROM p) SELECT run_id, seq, substring(sha256(run_id || '#' || seq), 1, 32) AS event_id, type, source_run_id FROM f")
def fork_prefix(spark, d):
    j = journal(spark, d)
    return lineage.fork(j, lineage.fork_point_before(j, "task_2"))


@query(J + ", m AS (SELECT run_id, coalesce(min(seq) FILTER (WHERE type = 'RunForked'), 0) AS mark FROM j GROUP BY run_id) SELECT j.run_id, seq, type FROM j JOIN m USING (run_id) WHERE seq > mark")
def above_fork_marker(spark, d):
    return lineage.above_marker(journal(spark, d)).select("run_id", "seq", "type")


@query(J + ", m AS (SELECT run_id, coalesce(min(seq) FILTER (WHERE type = 'RunForked'), 0) AS mark FROM j GROUP BY run_id), x AS (SELECT j.*, seq > mark AS own FROM j JOIN m USING (run_id)), y AS (SELECT run_id, count(DISTINCT identity) FILTER (WHERE type = 'TaskScheduled') AS calls, count(DISTINCT identity) FILTER (WHERE type = 'TaskScheduled' AND own) AS executed, coalesce(sum(usage_in) FILTER (WHERE type IN ('TaskCompleted', 'TaskAttemptFailed')), 0)::BIGINT AS tokens, coalesce(sum(usage_in) FILTER (WHERE type IN ('TaskCompleted', 'TaskAttemptFailed') AND own), 0)::BIGINT AS own_tokens FROM x GROUP BY run_id) SELECT *, calls - executed AS reused FROM y WHERE calls > 0")
def reuse_ratio(spark, d):
    return lineage.reuse(journal(spark, d))


@query("SELECT o_orderkey, sha256(o_custkey || chr(0) || 'load' || chr(0) || o_orderkey) AS idem_key FROM orders")
def idempotency_keys(spark, d):
    return table(spark, d, "orders").select("o_orderkey", identity.idempotency_key(F.col("o_custkey").cast("string"), F.lit("load"), F.col("o_orderkey")).alias("idem_key"))


@query("SELECT o_custkey || '/' || o_orderpriority AS idempotency_key, arg_min(o_orderkey::VARCHAR, epoch(o_orderdate) * 10000000 + o_orderkey) AS run_id FROM orders GROUP BY 1")
def keyed_start(spark, d):
    o = table(spark, d, "orders")
    runs = o.select(F.concat_ws("/", "o_custkey", "o_orderpriority").alias("idempotency_key"), F.struct("o_orderkey").alias("run_id"), F.struct("o_orderdate", "o_orderkey").alias("created_at"))
    return run_by_key(runs).select("idempotency_key", F.col("run_id.o_orderkey").cast("string").alias("run_id"))


@query("SELECT l_orderkey || '#' || l_partkey AS load_key FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1 HAVING NOT list_contains((SELECT list(x) FROM (SELECT DISTINCT l_orderkey || '#' || l_partkey AS x FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 45)), load_key)")
def keyed_load(spark, d):
    li = table(spark, d, "lineitem").withColumn("load_key", identity.load_key(F.col("l_orderkey").cast("string"), F.col("l_partkey")))
    return fanout.keyed_load(li.where("l_returnflag = 'R'").select("load_key"), li.where("l_returnflag = 'N' and l_quantity > 45").select("load_key"), "load_key")


@query("SELECT load_key, count(*) AS n FROM (SELECT l_orderkey || '#' || l_partkey AS load_key FROM lineitem WHERE l_returnflag = 'R') GROUP BY load_key HAVING count(*) > 1")
def unkeyed_load(spark, d):
    li = table(spark, d, "lineitem").where("l_returnflag = 'R'").select(identity.load_key(F.col("l_orderkey").cast("string"), F.col("l_partkey")).alias("load_key"))
    return li.groupBy("load_key").agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT o_custkey, count(*) AS n_new FROM orders ANTI JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') USING (o_custkey) GROUP BY o_custkey")
def insert_or_ignore(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    taken = table(spark, d, "orders").where("o_orderstatus = 'P'").select("o_custkey").distinct()
    return o.join(insert_new(o.select("o_custkey").distinct(), taken, "o_custkey"), "o_custkey").groupBy("o_custkey").agg(F.count("*").alias("n_new"))


_TIMERS = ", tm AS (SELECT event_id AS timer_id, run_id, 'event#' || (k % 4) AS identity, ts + to_seconds(cents) AS fire_at FROM j WHERE type = 'TimerCreated'), got AS (SELECT DISTINCT run_id, 'event#' || (k % 4) AS identity FROM j WHERE type = 'ExternalEventReceived'), fired AS (SELECT DISTINCT event_id - 1 AS timer_id FROM j WHERE type = 'TimerFired')"


def _timers(spark, d):
    j = journal(spark, d)
    name = F.concat(F.lit("event#"), (F.col("k") % 4).cast("string")).alias("identity")
    t = j.where("type = 'TimerCreated'").select(F.col("event_id").alias("timer_id"), "run_id", name, (F.col("ts") + identity.as_interval(F.col("cents"))).alias("fire_at"))
    return t, j.where("type = 'ExternalEventReceived'").select("run_id", name), j.where("type = 'TimerFired'").select((F.col("event_id") - 1).alias("timer_id")), j


_STATUS = "SELECT tm.timer_id, tm.run_id, tm.identity, CASE WHEN got.run_id IS NOT NULL THEN 'discarded' WHEN fired.timer_id IS NOT NULL THEN 'fired' ELSE 'pending' END AS status, fire_at FROM tm LEFT JOIN got ON got.run_id = tm.run_id AND got.identity = tm.identity LEFT JOIN fired ON fired.timer_id = tm.timer_id"


@query(J + _TIMERS + f" SELECT timer_id, run_id, identity, status FROM ({_STATUS})")
def timer_status(spark, d):
    t, got, fired, _ = _timers(spark, d)
    return waits.timer_status(t, got, fired).select("timer_id", "run_id", "identity", "status")


@query(J + _TIMERS + f" SELECT timer_id, epoch_us(fire_at) AS fire_at FROM ({_STATUS}) WHERE status = 'pending' AND fire_at <= TIMESTAMP '2024-01-15 00:00:00'")
def due_timers(spark, d):
    t, got, fired, _ = _timers(spark, d)
    return waits.due_timers(waits.timer_status(t, got, fired), F.expr("timestamp_ntz '2024-01-15 00:00:00'")).select("timer_id", us("fire_at"))


@query(J + _TIMERS + ", w AS (SELECT run_id, seq, 'event#' || (k % 4) AS identity FROM j WHERE type = 'EventWaitStarted') SELECT w.* FROM w ANTI JOIN got USING (run_id, identity)")
def outstanding_waits(spark, d):
    _, got, _, j = _timers(spark, d)
    return waits.outstanding(j.where("type = 'EventWaitStarted'").select("run_id", "seq", F.concat(F.lit("event#"), (F.col("k") % 4).cast("string")).alias("identity")), got)


_INBOX = ", w AS (SELECT event_id AS wait_id, ts, user_id % 20 AS g, CASE WHEN k % 5 <> 0 THEN k % 5 END AS key FROM j WHERE type = 'EventWaitStarted'), b AS (SELECT event_id AS row_id, ts, user_id % 20 AS g, CASE WHEN k % 5 <> 0 THEN k % 5 END AS key, k % 7 = 0 AS consumed FROM j WHERE type = 'ExternalEventReceived')"


def _inbox(spark, d):
    j = journal(spark, d)
    group = [F.concat(F.lit("t"), (F.col("user_id") % 20).cast("string")).alias("event_type"), F.when(F.col("k") % 5 != 0, (F.col("k") % 5).cast("string")).alias("key")]
    w = j.where("type = 'EventWaitStarted'").select(F.col("event_id").alias("wait_id"), F.col("ts").alias("started_at"), *group)
    b = j.where("type = 'ExternalEventReceived'").select(F.col("event_id").alias("row_id"), F.col("ts").alias("received_at"), *group, (F.col("k") % 7 == 0).alias("consumed"))
    return w, b


@query(J + _INBOX + " SELECT 't' || g AS event_type, key::VARCHAR AS key, arg_min(row_id, epoch_us(ts) * 1.0) AS row_id FROM b WHERE NOT consumed GROUP BY g, key")
def inbox_match(spark, d):
    return waits.inbox_heads(_inbox(spark, d)[1]).select("event_type", "key", "row_id")


@query(J + _INBOX + ", x AS (SELECT *, row_number() OVER (PARTITION BY g, key ORDER BY ts, wait_id) AS n FROM w), y AS (SELECT *, row_number() OVER (PARTITION BY g, key ORDER BY ts, row_id) AS n FROM b) SELECT 't' || x.g AS event_type, x.key::VARCHAR AS key, wait_id, row_id FROM x JOIN y ON x.g = y.g AND x.key IS NOT DISTINCT FROM y.key AND x.n = y.n")
def fifo_rank_match(spark, d):
    return waits.rank_match(*_inbox(spark, d))


def timed(w: DataFrame, b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Waits with a deadline an hour after their start, and events, in microseconds."""
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    key = F.coalesce("key", F.lit("-")).alias("key")
    return w.select("event_type", key, "wait_id", micros("started_at").alias("started_us"), (micros("started_at") + 3_600_000_000).alias("deadline_us")), b.select("event_type", key, "row_id", micros("received_at").alias("received_us"))


#: The fold of waits in SQL: one arrival of every key a step, with lists for what waits and what came unasked.
_FOLD = J + _INBOX + """, arr AS (SELECT 't' || g AS event_type, coalesce(key::VARCHAR, '-') AS key, epoch_us(ts) AS tm, true AS is_wait, wait_id AS id, epoch_us(ts) + 3600000000 AS deadline FROM w UNION ALL SELECT 't' || g, coalesce(key::VARCHAR, '-'), epoch_us(ts), false, row_id, NULL FROM b),
a AS (SELECT *, row_number() OVER (PARTITION BY event_type, key ORDER BY tm, is_wait, id) AS n, count(*) OVER (PARTITION BY event_type, key) AS total FROM arr),
r AS (SELECT DISTINCT event_type, key, 0::BIGINT AS n, total, []::BIGINT[] AS ev, []::STRUCT(d BIGINT, i BIGINT)[] AS ws, []::STRUCT(i BIGINT, e BIGINT, t BIGINT)[] AS o FROM a
 UNION ALL SELECT event_type, key, n, total, CASE WHEN is_wait THEN ev[2:] WHEN len(live) > 0 THEN ev ELSE list_append(ev, id) END,
  CASE WHEN is_wait AND len(ev) > 0 THEN live WHEN is_wait THEN list_append(live, {'d': deadline, 'i': id}) ELSE live[2:] END,
  list_concat(list_transform(dead, lambda x: {'i': x.i, 'e': NULL::BIGINT, 't': x.d}), CASE WHEN is_wait AND len(ev) > 0 THEN [{'i': id, 'e': ev[1], 't': tm}] WHEN NOT is_wait AND len(live) > 0 THEN [{'i': live[1].i, 'e': id, 't': tm}] ELSE [] END)
 FROM (SELECT r.event_type, r.key, a.n, r.total, ev, is_wait, id, tm, deadline, list_filter(ws, lambda x: x.d >= tm) AS live, list_filter(ws, lambda x: x.d < tm) AS dead FROM r JOIN a ON a.event_type = r.event_type AND a.key = r.key AND a.n = r.n + 1)),
m AS (SELECT event_type, key, unnest(o) AS x FROM r UNION ALL SELECT event_type, key, unnest(list_transform(ws, lambda y: {'i': y.i, 'e': NULL::BIGINT, 't': y.d})) FROM r WHERE n = total)
SELECT event_type, key, x.i AS wait_id, x.e AS row_id, x.t AS "at" FROM m"""


@query(_FOLD)
def fifo_timeout_match(spark, d):
    return waits.match_with_timeouts(*timed(*_inbox(spark, d)))


@query(_FOLD)
def stream_wait_match(spark, d):
    from tidemark.streaming.waits import run_available

    return run_available(*timed(*_inbox(spark, d)))


@query(J + " SELECT run_id, event_id, seq FROM j")
def stream_seq(spark, d):
    from tidemark.streaming.waits import allocate_seq

    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("run_id"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return allocate_seq(e)


@query("SELECT event_id, '***REDACTED***' AS session_token, event_type, json_extract_string(props, '$.k') AS k, '***REDACTED***' AS inner_secret FROM events")
def redact_known_schema(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("session_token"), "event_type", F.struct(F.get_json_object("props", "$.k").alias("k"), F.lit("s").alias("Client_Secret")).alias("body"))
    return values.redact_frame(e).select("event_id", "session_token", "event_type", "body.k", F.col("body.Client_Secret").alias("inner_secret"))


@query("""SELECT event_id, '{"password":"***REDACTED***","list":[{"API_KEY":"***REDACTED***","k":' || json_extract_string(props, '$.k') || '}]}' AS payload FROM events""")
def redact_json(spark, d):
    text = F.concat(F.lit('{"password":{"a":1},"list":[{"API_KEY":["x"],"k":'), F.get_json_object("props", "$.k"), F.lit("}]}"))
    return table(spark, d, "events").select("event_id", values.redact_json(text).alias("payload"))


_BLOB = "SELECT doc_id, text, length(text) + 5 * length(regexp_replace(text, '[\\x00-\\x7F]+', '', 'g')) AS size FROM documents"


@query(f"SELECT sha256(text) AS blob_id, any_value(size)::BIGINT AS size, count(*) AS n FROM ({_BLOB}) GROUP BY text")
def blob_catalog(spark, d):
    return table(spark, d, "documents").groupBy(values.blob_id(F.col("text")).alias("blob_id")).agg(F.max(values.encoded_size(F.col("text"))).cast("bigint").alias("size"), F.count("*").alias("n"))


@query(f"""SELECT doc_id, CASE WHEN size > 4096 THEN '{{"$tide":"blobref","id":"' || sha256(text) || '","size":' || size || '}}' ELSE text END AS text FROM ({_BLOB})""")
def spill(spark, d):
    return values.spill(table(spark, d, "documents").select("doc_id", "text"), "text", 4096)[0]


@query("SELECT doc_id, text FROM documents")
def rehydrate_blobs(spark, d):
    small, blobs = values.spill(table(spark, d, "documents").select("doc_id", "text"), "text", 4096)
    return values.rehydrate_blobs(small, "text", blobs)


@query("""SELECT o_orderkey, '{"at":{"$tide":"datetime","v":"' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '"},"n":' || o_custkey || '}' AS text FROM orders""")
def encode_tagged(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("at"), F.col("o_custkey").alias("n"))

    def run(batches):
        for b in batches:
            out = next(values.encode_batches([b[["at", "n"]]]))
            yield out.assign(o_orderkey=b["o_orderkey"].to_numpy())

    return o.mapInPandas(run, "o_orderkey bigint, text string")


@query("SELECT o_orderkey, epoch_us(o_orderdate) AS at_us, o_custkey AS n FROM orders")
def decode_tagged(spark, d):
    text = encode_tagged(spark, d)
    at = F.to_timestamp(F.get_json_object("text", f"$.at['v']"))
    return text.select("o_orderkey", F.unix_micros(at).alias("at_us"), F.get_json_object("text", "$.n").cast("bigint").alias("n"))


@query("SELECT event_id, cast(json_extract_string(props, '$.k') AS bigint) AS k FROM events")
def rehydrate_typed(spark, d):
    return table(spark, d, "events").select("event_id", values.rehydrate(F.col("props"), T.StructType([T.StructField("k", T.LongType())]))["k"].alias("k"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'Rejected' ELSE 'Approved' END AS arm, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS approved, CASE WHEN event_type = 'error' THEN event_type END AS rejected FROM events")
def rehydrate_union(spark, d):
    arm = F.when(F.col("event_type") == "error", "Rejected").otherwise("Approved")
    text = F.to_json(F.struct(F.lit("dataclass").alias(values.TAG), arm.alias("type"), F.struct(F.col("event_type").alias("reason")).alias("fields")))
    reason = T.StructType([T.StructField("reason", T.StringType())])
    v = values.rehydrate_union(text, {"Approved": reason, "Rejected": reason})
    return table(spark, d, "events").select("event_id", v.alias("v")).select("event_id", F.col("v.type").alias("arm"), F.col("v.Approved.reason").alias("approved"), F.col("v.Rejected.reason").alias("rejected"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no FROM documents), t AS (SELECT doc_id, line_no, trim(line, ' ') AS line FROM l WHERE trim(line, ' ') <> ''), s AS (SELECT *, instr(line, ',') AS c, trim(substring(line, instr(line, ',') + 1), ' ') AS b FROM t)
SELECT doc_id, line_no, CASE WHEN c > 0 AND b <> '' THEN trim(substring(line, 1, c - 1), ' ') END AS record_id, CASE WHEN c > 0 AND b <> '' THEN b END AS body, CASE WHEN c = 0 THEN 'line ' || line_no || ': no separator' WHEN b = '' THEN 'line ' || line_no || ': no body' END AS error FROM s""")
def parse_records(spark, d):
    return parse_lines(table(spark, d, "documents").select("doc_id", "text"), "doc_id")


@query("""WITH e AS (SELECT event_id, ts, value, event_type, strftime(ts, '%H:%M:%S') AS clock, strftime(ts, '%Y-%m-%d %H:%M') AS minute FROM events) SELECT event_id, clock, minute, CASE WHEN value < 1 THEN floor(value * 1000 + 0.5)::BIGINT || 'ms' WHEN value < 60 THEN printf('%.2fs', value) ELSE floor(value / 60)::BIGINT || 'm ' || floor(value % 60 + 0.5)::BIGINT || 's' END AS duration, CASE WHEN length(event_type) > 6 THEN substring(event_type, 1, 5) || '…' ELSE event_type END AS short FROM e""")
def display_formats(spark, d):
    return table(spark, d, "events").select("event_id", display.clock(F.col("ts")).alias("clock"), display.minute(F.col("ts")).alias("minute"), display.duration(F.col("value")).alias("duration"), display.short(F.col("event_type"), 6).alias("short"))


@query(J + " SELECT run_id, arg_min(code_version, seq) <> 'v1' AS mismatch FROM j GROUP BY run_id")
def version_mismatch(spark, d):
    return journal(spark, d).groupBy("run_id").agg((F.min_by("code_version", "seq") != "v1").alias("mismatch"))


@query(J + " SELECT type AS command, seq, run_id, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS place FROM j WHERE type IN ('WorkflowCreated', 'WorkflowCancelled', 'ExternalEventReceived', 'RunForked')")
def command_log(spark, d):
    return journal(spark, d).where(F.col("type").isin("WorkflowCreated", "WorkflowCancelled", "ExternalEventReceived", "RunForked")).select(F.col("type").alias("command"), "seq", "run_id", F.row_number().over(fold.by_seq()).cast("bigint").alias("place"))


@query(J + SCAN + " SELECT run_id, n_events + 1 AS seq, 'WorkflowCancelled' AS type FROM st WHERE status NOT IN ('completed', 'failed', 'cancelled')")
def cancel_runs(spark, d):
    st = fold.run_status(journal(spark, d))
    return st.where(~F.col("status").isin("completed", "failed", "cancelled")).select("run_id", (F.col("n_events") + 1).alias("seq"), F.lit("WorkflowCancelled").alias("type"))


@query(J + " SELECT run_id, arg_min(code_version, seq) <> 'v1' AS mismatch FROM j GROUP BY run_id")
def version_mismatch_all(spark, d):
    return journal(spark, d).groupBy("run_id").agg((F.min_by("code_version", "seq") != "v1").alias("mismatch"))


def _cancels(j: DataFrame) -> DataFrame:
    """A WorkflowCancelled at the next free seq of each run that is open after its whole journal."""
    open_runs = fold.run_status(j).where(~F.col("status").isin("completed", "failed", "cancelled")).select("run_id")
    return j.join(open_runs, "run_id").groupBy("run_id").agg((F.max("seq") + 1).alias("seq")).withColumn("type", F.lit("WorkflowCancelled"))


@query(J + SCAN + " SELECT run_id, max(seq) + 1 AS seq, 'WorkflowCancelled' AS type FROM j WHERE run_id IN (SELECT run_id FROM st WHERE status NOT IN ('completed', 'failed', 'cancelled')) GROUP BY run_id")
def cancel_open_runs(spark, d):
    return _cancels(journal(spark, d))


@query(J + SCAN + """, t AS (SELECT ts.run_id, 'task:' || ts.identity AS node, CASE WHEN map_group IS NOT NULL THEN 'map:' || map_group END AS parent, 'task' AS kind, n.name, status, first_seq AS seq FROM ts LEFT JOIN (SELECT run_id, identity, max(task_name) AS name FROM j WHERE type = 'TaskScheduled' GROUP BY ALL) n USING (run_id, identity))
SELECT * FROM t UNION ALL SELECT run_id, parent AS node, NULL, 'map', substring(parent, 5), CASE WHEN bool_or(status = 'failed') THEN 'failed' WHEN bool_and(status = 'completed') THEN 'completed' ELSE 'running' END, min(seq) FROM t WHERE parent IS NOT NULL GROUP BY run_id, parent
UNION ALL SELECT c.run_id, 'child:' || child_run_id, NULL, 'child', c.name, coalesce(st.status, 'unknown'), c.seq FROM (SELECT run_id, child_run_id, max(workflow_name) AS name, min(seq) AS seq FROM j WHERE type = 'ChildWorkflowScheduled' GROUP BY ALL) c LEFT JOIN st ON st.run_id = child_run_id""")
def tree_nodes(spark, d):
    return views.tree_nodes(journal(spark, d))


@query(J + SCAN + """, h AS (SELECT run_id, arg_min(workflow_name, seq) AS workflow_name, arg_min(code_version, seq) FILTER (WHERE type = 'WorkflowCreated') AS stamped, min(seq) AS first_seq, max(seq) AS last_seq FROM j GROUP BY run_id)
SELECT run_id, workflow_name, status, stamped, 'v1' AS current, coalesce(stamped <> 'v1', false) AS mismatch, first_seq, last_seq FROM h JOIN st USING (run_id)""")
def timeline_header(spark, d):
    return views.timeline_header(journal(spark, d), "v1").select("run_id", "workflow_name", "status", "version.*", "first_seq", "last_seq")


@query(J + SCAN + f""", a AS ({ATTEMPTS}), e AS (SELECT run_id, identity, n, arg_max(CASE WHEN type = 'TaskAttemptFailed' THEN error_type || ': ' || error_message END, seq) AS error, arg_max(CASE WHEN type = 'TaskAttemptFailed' THEN next_delay END, seq) AS next_delay, sum(usage_in) AS usage_in, sum(usage_out) AS usage_out FROM {_AT} WHERE n > 0 AND type <> 'TaskAttemptStarted' GROUP BY ALL)
SELECT ts.run_id, ts.identity, ts.status, st.last_error AS run_error, string_agg(attempt_no || ' ' || a.status || ' ' || coalesce(error, '-') || ' ' || coalesce(e.usage_in::BIGINT::VARCHAR, '-') || ' ' || coalesce(e.usage_out::BIGINT::VARCHAR, '-'), ', ' ORDER BY attempt_no) AS attempts, sum(e.next_delay) AS delays
FROM ts JOIN st USING (run_id) LEFT JOIN a ON a.run_id = ts.run_id AND a.identity = ts.identity LEFT JOIN e ON e.run_id = a.run_id AND e.identity = a.identity AND e.n = a.attempt_no GROUP BY ts.run_id, ts.identity, ts.status, st.last_error""")
def task_detail_full(spark, d):
    t = fold.task_detail_full(journal(spark, d))
    dash = lambda c: F.coalesce(c.cast("string"), F.lit("-"))
    line = F.transform("attempts", lambda a: F.concat_ws(" ", a["attempt_no"].cast("string"), a["status"], dash(a["error"]), dash(a["usage_in"]), dash(a["usage_out"])))
    delays = F.transform(F.filter("attempts", lambda a: a["next_delay"].isNotNull()), lambda a: a["next_delay"])
    total = F.when(F.size(delays) > 0, F.aggregate(delays, F.lit(0.0), lambda s, x: s + x))
    return t.select("run_id", "identity", "status", "run_error", F.array_join(line, ", ").alias("attempts"), total.alias("delays"))


@query(J + _POINTS + """, f AS (SELECT j.run_id, j.run_id || '-fork' AS fork, seq, type, epoch_us(ts) AS ts, '{"k":' || k || '}' AS payload FROM j JOIN p USING (run_id) WHERE seq <= fork_point)
SELECT fork AS run_id, seq, substring(sha256(fork || '#' || seq), 1, 32) AS event_id, type, ts, payload FROM f
UNION ALL SELECT run_id || '-fork', max(seq) + 1, substring(sha256(run_id || '-fork#' || (max(seq) + 1)), 1, 32), 'RunForked', arg_max(ts, seq), '{"source_run_id":"' || run_id || '","fork_point_seq":' || max(seq) || '}' FROM f GROUP BY run_id""")
def fork_journal(spark, d):
    j = journal(spark, d)
    events = j.select("run_id", "seq", "event_id", "type", F.col("ts").cast("timestamp").alias("ts"), F.to_json(F.struct("k")).alias("payload"))
    return lineage.fork_journal(events, lineage.fork_point_before(j, "task_2")).withColumn("ts", F.unix_micros("ts"))


@query(J + """ SELECT run_id, identity, max(CASE WHEN type = 'TaskScheduled' THEN '{"api_token":"***REDACTED***","v":' || k || '}' END) AS input, max(CASE WHEN type = 'TaskCompleted' THEN '***REDACTED***' END) AS session_token FROM j WHERE identity IS NOT NULL GROUP BY run_id, identity""".replace("max(CASE WHEN type = 'TaskScheduled' THEN", "arg_max(CASE WHEN type = 'TaskScheduled' THEN").replace("END) AS input", "END, seq) FILTER (WHERE type = 'TaskScheduled') AS input"))
def redacted_views(spark, d):
    j = journal(spark, d).where("identity is not null")
    text = F.concat(F.lit('{"api_token":"x","v":'), F.col("k").cast("string"), F.lit("}"))
    view = j.groupBy("run_id", "identity").agg(F.max_by(fold.of("TaskScheduled", text), fold.of("TaskScheduled")).alias("input"), F.max(fold.of("TaskCompleted", "output_ref")).alias("session_token"))
    return views.redacted(view)


@query("""SELECT event_id, CASE WHEN k % 2 = 0 THEN '***REDACTED***' ELSE k::VARCHAR END AS value FROM (SELECT event_id, cast(json_extract_string(props, '$.k') AS bigint) AS k FROM events)""")
def redact_map(spark, d):
    k = F.get_json_object("props", "$.k").cast("bigint")
    name = F.when(k % 2 == 0, "user_password").otherwise("count")
    e = table(spark, d, "events").select("event_id", F.create_map(name, k).alias("body"), name.alias("name"))
    return values.redact_frame(e.select("event_id", "body", "name")).select("event_id", F.element_at("body", F.col("name")).alias("value"))


def _shout(attempt: tasks.Attempt, text: str) -> dict:
    attempt.record_usage("m", len(text), 1)
    if text[:1] in "AEIOU":
        raise ValueError(f"begins with {text[:1]}")
    return {"n": len(text)}


def _calls(spark, d):
    """One call a document; those of every third are recorded as done, every fifth of the others has failed once."""
    docs = table(spark, d, "documents").where("doc_id is not null")
    calls = docs.select((F.col("doc_id") % 50).cast("string").alias("run_id"), F.col("doc_id").alias("pos"), F.col("doc_id").cast("string").alias("key"), F.lit(None).cast("bigint").alias("ordinal"), F.coalesce("text", F.lit("")).alias("input"))
    i = F.col("pos")
    kinds = F.when(i % 3 == 0, F.array(F.lit("TaskScheduled"), F.lit("TaskAttemptStarted"), F.lit("TaskCompleted"))).when(i % 5 == 1, F.array(F.lit("TaskScheduled"), F.lit("TaskAttemptStarted"), F.lit("TaskAttemptFailed")))
    return calls, calls.select("run_id", F.concat(F.lit("shout:key:"), "key").alias("identity"), F.explode(kinds).alias("type"), F.lit(1).alias("attempt"))


@query("""WITH c AS (SELECT doc_id, coalesce(text, '') AS text, CASE WHEN doc_id % 5 = 1 THEN 1 ELSE 0 END AS tried, substring(coalesce(text, ''), 1, 1) IN ('', 'A', 'E', 'I', 'O', 'U') AS bad FROM documents WHERE doc_id % 3 <> 0),
n AS (SELECT *, unnest(range(tried + 1, CASE WHEN bad THEN 4 ELSE tried + 2 END)) AS attempt FROM c)
SELECT (doc_id % 50)::VARCHAR AS run_id, 'shout:key:' || doc_id AS identity, 0 AS step, 'TaskScheduled' AS type, NULL::INT AS attempt, NULL AS output, NULL AS error, NULL::BOOLEAN AS again, NULL::BIGINT AS billed FROM c WHERE tried = 0
UNION ALL SELECT (doc_id % 50)::VARCHAR, 'shout:key:' || doc_id, 2 * (attempt - tried) - 1, 'TaskAttemptStarted', attempt, NULL, NULL, NULL, NULL FROM n
UNION ALL SELECT (doc_id % 50)::VARCHAR, 'shout:key:' || doc_id, 2 * (attempt - tried), CASE WHEN bad THEN 'TaskAttemptFailed' ELSE 'TaskCompleted' END, attempt, CASE WHEN NOT bad THEN '{"n":' || length(text) || '}' END, CASE WHEN bad THEN 'ValueError: begins with ' || substring(text, 1, 1) END, CASE WHEN bad THEN attempt < 3 END, length(text) FROM n""")
def task_events(spark, d):
    e = tasks.run_tasks(*_calls(spark, d), tasks.Task("shout", _shout, retries=2), wait=False)
    again = F.when(F.col("type") == "TaskAttemptFailed", F.col("next_delay").isNotNull())
    return e.select("run_id", "identity", F.col("step").cast("bigint").alias("step"), "type", F.col("attempt").cast("bigint").alias("attempt"), F.col("output_ref").alias("output"), F.when(F.col("error").isNotNull(), F.concat_ws(": ", "error.type", "error.message")).alias("error"), again.alias("again"), F.get("usage", F.lit(0))["input_tokens"].alias("billed"))


@query(J + " SELECT run_id, identity, count(*) AS n_attempts, count(*) FILTER (WHERE type = 'TaskAttemptFailed' AND next_delay IS NOT NULL) AS will_retry, count(*) FILTER (WHERE type = 'TaskAttemptFailed' AND next_delay IS NULL) AS exhausted, bool_or(usage_in IS NOT NULL) AS has_usage, bool_or(type = 'TaskAttemptFailed' AND usage_in IS NOT NULL) AS billed_failed FROM j WHERE type IN ('TaskAttemptFailed', 'TaskCompleted') GROUP BY run_id, identity")
def attempt_flags(spark, d):
    return tasks.attempt_flags(journal(spark, d))


@query("""SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 7 = 0 THEN o_custkey::VARCHAR WHEN c.run_id IS NOT NULL THEN c.run_id ELSE 'run-' || substring(sha256('kc' || o_custkey), 1, 32) END AS run_id,
 CASE WHEN o_orderkey % 7 = 0 OR c.run_id IS NOT NULL THEN CASE WHEN o_custkey % 2 = 0 THEN 'none' ELSE 'resume' END WHEN row_number() OVER (PARTITION BY o_custkey, o_orderkey % 7 = 0 ORDER BY o_orderkey) = 1 THEN 'create' ELSE 'none' END AS action
FROM orders LEFT JOIN (SELECT c_custkey, c_custkey::VARCHAR AS run_id FROM customer WHERE c_custkey % 3 = 0) c ON c_custkey = o_custkey""")
def start_runs(spark, d):
    """A customer is a run, every third with a key; an order asks for its customer's run by id or by key."""
    c = F.col("c_custkey")
    known = table(spark, d, "customer").select(c.cast("string").alias("run_id"), F.when(c % 3 == 0, F.concat(F.lit("c"), c.cast("string"))).alias("idempotency_key"), c.alias("created_at"), F.when(c % 2 == 0, "completed").otherwise("running").alias("status"))
    o = F.col("o_custkey")
    asked = table(spark, d, "orders").select(F.col("o_orderkey").alias("request_id"), F.when(F.col("o_orderkey") % 7 == 0, o.cast("string")).alias("run_id"), F.concat(F.lit("c"), o.cast("string")).alias("idempotency_key"))
    return runs.start_runs(asked, known)


@query("""SELECT o_custkey::VARCHAR AS run_id, child_key, substring(sha256(o_custkey || chr(0) || 'child' || chr(0) || child_key), 1, 32) AS child_run_id, CASE child_key WHEN 'F' THEN 'result' WHEN 'O' THEN 'raise' ELSE 'create' END AS action FROM (SELECT DISTINCT o_custkey, o_orderstatus AS child_key FROM orders)""")
def start_children(spark, d):
    calls = table(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("run_id"), F.col("o_orderstatus").alias("child_key"))
    child = F.substring(F.sha2(F.concat_ws("\0", "run_id", F.lit("child"), "child_key"), 256), 1, 32)
    known = calls.distinct().where("child_key in ('F', 'O')").select(child.alias("run_id"), F.when(F.col("child_key") == "F", "completed").otherwise("failed").alias("status"))
    return runs.start_children(calls, known)


@query(J + _INBOX + """ SELECT 't' || g AS event_type, key::VARCHAR AS key, row_number() OVER (PARTITION BY g, key ORDER BY ts, row_id) AS row_id, '{"id":' || row_id || ',"token":"***REDACTED***"}' AS payload, row_number() OVER (PARTITION BY g, key ORDER BY ts, row_id) <= 2 AS consumed FROM b""")
def inbox_after_sends(spark, d):
    """Events arrive in the inbox, redacted; the first two of each (event_type, key) are taken."""
    _, b = _inbox(spark, d)
    sent = runs.send_events(b.select("event_type", "key", F.struct("received_at", "row_id").alias("received_at"), F.concat(F.lit('{"id":'), F.col("row_id").cast("string"), F.lit(',"token":"x"}')).alias("payload")))
    return runs.consume(sent, sent.where("row_id <= 2")).drop("received_at")


@query("""SELECT doc_id, trim(coalesce(regexp_extract('LANG: ' || coalesce(lang, '') || chr(10) || coalesce(text, ''), '^LANG: ([^\n\r]*)', 1), '')) AS lang, greatest(1, length(text) // 4)::BIGINT AS tokens, 0.5 + ('0x' || substring(sha256(doc_id::VARCHAR), 1, 2))::INT / 256.0::DOUBLE * 0.45 AS score, (greatest(1, length(text) // 4) * 3.0::DOUBLE + 15.0::DOUBLE) / 1000000 AS usd FROM documents""")
def prompt_fields(spark, d):
    docs = table(spark, d, "documents")
    prompt = F.concat(F.lit("LANG: "), F.coalesce("lang", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")))
    n = prompts.tokens(F.col("text"))
    return docs.select("doc_id", prompts.named_field(prompt, "LANG").alias("lang"), n.alias("tokens"), prompts.score(F.col("doc_id").cast("string")).alias("score"), prompts.price(n, F.lit(1), 3.0, 15.0).alias("usd"))
