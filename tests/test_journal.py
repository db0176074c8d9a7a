"""Small journals and values made by hand, and properties."""

import dataclasses
import datetime as dt
import pickle

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemark.functions import values
from tidemark.operators import fanout, lineage, views
from tidemark.operators.waits import fold_waits
from tidemark.sources.journal import ENVELOPE, next_seq, parse_lines, typed

JSON = st.recursive(st.none() | st.booleans() | st.integers(-(2**50), 2**50) | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=4).filter(lambda k: k != values.TAG), x, max_size=3), max_leaves=8)


@given(JSON)
def test_text_round_trip(value):
    assert values.from_text(values.to_text(value)) == value


@given(JSON)
def test_redaction_is_idempotent(value):
    assert values.redact_value(values.redact_value(value)) == values.redact_value(value)


@dataclasses.dataclass
class Row:
    key: str
    at: dt.datetime


def test_tags():
    row = Row("a", dt.datetime(2024, 1, 2, tzinfo=dt.UTC))
    assert values.from_text(values.to_text([row, dt.timedelta(seconds=2)])) == [{"key": "a", "at": row.at}, dt.timedelta(seconds=2)]
    with pytest.raises(values.EncodeError, match=r"\$\.a\.b\[0\]"):
        values.encode({"a": {"b": [b"x"]}})
    with pytest.raises(ValueError):
        values.decode({values.TAG: "other"})
    with pytest.raises(ValueError, match="without an object of fields"):
        values.decode({values.TAG: "dataclass", "type": "Row", "fields": values.MASK})


def test_decoded_objects_encode_as_they_came():
    text = values.to_text({"rows": [Row("a", dt.datetime(2024, 1, 2, tzinfo=dt.UTC))]})
    once = values.from_text(text)
    assert (once["rows"][0].kind, once["rows"][0].type_name) == ("dataclass", "Row")
    assert values.to_text(once) == values.to_text(pickle.loads(pickle.dumps(once))) == text


def test_event_beats_its_timeout():
    rows = [(0, (1, 1), True, 1, 10.0), (10, (0, 2), False, 7, float("inf")), (0, (1, 3), True, 3, 5.0)]
    assert sorted(fold_waits(rows), key=str) == [(1, 7, 10), (3, None, 5.0)]


def test_typed_projection_and_seq(spark):
    at = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([("r", 1, "e1", "TaskAttemptFailed", at, '{"task_name":"t","ordinal":0,"attempt":2,"next_delay":1.5,"error":{"type":"E","message":"m"},"input_ref":{"b":1,"a":1.0}}')], ENVELOPE)
    r = typed(e).first()
    assert (r.task_name, r.attempt, r.next_delay, r.error_type, r.input_ref) == ("t", 2, 1.5, "E", '{"b":1,"a":1.0}')
    new = spark.createDataFrame([("r", 5), ("r", 6), ("s", 1)], "run_id string, at int")
    assert sorted((x.run_id, x.seq) for x in next_seq(new, e, ["at"]).collect()) == [("r", 2), ("r", 3), ("s", 1)]


def test_parse_lines(spark):
    t = spark.createDataFrame([("s", "a,1\n\nbad\nc,")], "source_id string, text string")
    assert [(r.line_no, r.record_id, r.body, r.error) for r in parse_lines(t).orderBy("line_no").collect()] == [(1, "a", "1", None), (3, None, None, "line 3: no separator"), (4, None, None, "line 4: no body")]


def test_fan_out_keys_and_failures(spark):
    items = spark.createDataFrame([(0, "a", "1"), (1, "b", "x"), (2, "c", "y")], "pos bigint, key string, item string")
    done = spark.createDataFrame([("c", "9")], "key string, output string")
    out = fanout.memoised_map(items, done, int, retries=1, collect=True).collect()
    assert [(r.status, r.output, r.attempts) for r in out] == [("completed", "1", 1), ("failed", None, 2), ("hit", "9", 0)]
    with pytest.raises(RuntimeError, match="ValueError"):
        fanout.memoised_map(items, done, int)
    with pytest.raises(ValueError, match="occurs 2 times"):
        fanout.check_keys(items.union(items.limit(1)))


def test_policies():
    lineage.check(3, "off", "x")
    with pytest.warns(UserWarning):
        lineage.check(3, "warn", "x")
    with pytest.raises(RuntimeError):
        lineage.check(3, "strict", "x")


def test_each_miss_runs_once(spark):
    ran = spark.sparkContext.accumulator(0)

    def task(item):
        ran.add(1)
        return {"n": len(item)}

    items = spark.createDataFrame([(i, f"k{i}", "x" * i) for i in range(5)], "pos bigint, key string, item string")
    none = spark.createDataFrame([], "key string, output string")
    out = fanout.memoised_map(items, none, task)
    assert out.count() == 5 and [r.status for r in out.collect()] == ["completed"] * 5
    assert ran.value == 5
    again = fanout.memoised_map(items, out.select("key", "output"), task)
    assert {r.status for r in again.collect()} == {"hit"} and ran.value == 5


def test_redaction_of_maps_and_bad_json(spark):
    row = spark.sql("SELECT map('password', 5, 'n', 6) AS a, map('a', map('secret', 's', 'b', 'c')) AS b, map('x', named_struct('api_key', 'k', 'v', 1)) AS c")
    r = values.redact_frame(row).first()
    assert r.a == {"password": values.MASK, "n": "6"}
    assert "s" not in str(r.b).replace("secret", "").replace(values.MASK, "").replace("as", "") and values.MASK in r.b["a"] and '"b":"c"' in r.b["a"]
    assert values.MASK in r.c["x"] and '"k"' not in r.c["x"]
    assert values.redact_text("{bad") == f'"{values.MASK}"' and values.redact_text(None) is None


def test_forks_are_refused_while_a_run_goes_on(spark):
    j = spark.createDataFrame([("r", 1, "WorkflowCreated", None, None), ("r", 2, "TaskScheduled", "t", 0), ("s", 1, "WorkflowCreated", None, None), ("s", 2, "TaskScheduled", "t", 0), ("s", 3, "WorkflowCompleted", None, None)], "run_id string, seq bigint, type string, task_name string, ordinal int")
    for chosen in ({"fork_point_seq": 1}, {"before_task": "t"}):
        with pytest.raises(ValueError, match="not ended"):
            lineage.resolve_fork_point(j, "r", **chosen)
        assert lineage.resolve_fork_point(j, "s", **chosen) == 1
    for bad in ({"fork_point_seq": 4}, {"before_task": "u"}, {}):
        with pytest.raises(ValueError):
            lineage.resolve_fork_point(j, "s", **bad)


def test_fork_journal_replaces_the_input(spark):
    at = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([("r", 1, "e1", "WorkflowCreated", at, '{"workflow_name":"w","input_ref":{"a":1}}'), ("r", 2, "e2", "TaskScheduled", at, '{"task_name":"t"}'), ("r", 3, "e3", "WorkflowCompleted", at, "{}")], ENVELOPE)
    points = spark.createDataFrame([("r", 2)], "run_id string, fork_point bigint")
    out = typed(lineage.fork_journal(e, points, input_override='{"a":2}')).orderBy("seq").collect()
    assert [(r.type, r.ts) for r in out] == [("WorkflowCreated", at), ("TaskScheduled", at), ("RunForked", at)]
    assert (out[0].input_ref, out[0].workflow_name, out[1].task_name) == ('{"a":2}', "w", "t")
    assert (out[2].source_run_id, out[2].fork_point_seq) == ("r", 2)


def test_forks_of_any_number_and_depth(spark):
    chain = spark.range(1, 151).selectExpr("id as run", "id - 1 as source")
    assert {tuple(r) for r in views.lineage_chain(chain).collect()} == {(i, k, i - k) for i in range(151) for k in range(i)}
    wide = spark.range(2, 1_000_003).selectExpr("id as run", "1L as source").union(spark.createDataFrame([(1, 0)], "run long, source long"))
    found = views.lineage_chain(wide).groupBy("ancestor", "depth").count().collect()
    assert sorted(tuple(r) for r in found) == [(0, 1, 1), (0, 2, 1_000_001), (1, 1, 1_000_001)]
    with pytest.raises(ValueError, match="behind itself"):
        views.lineage_chain(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "run long, source long"))
    assert views.lineage_chain(chain.limit(0)).count() == 0


def test_descendants_of_any_number_and_depth(spark):
    chain = spark.range(150).selectExpr("id as parent", "id + 1 as child")
    assert {tuple(r) for r in views.descendants(chain).collect()} == {(i, k, k - i) for k in range(151) for i in range(k)}
    # two ways to a node are two rows, as a recursive UNION ALL has them
    found = views.descendants(spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), (None, "a")], "parent string, child string")).where("node = 'e'").collect()
    assert sorted(map(repr, (tuple(r) for r in found))) == sorted(map(repr, [("a", "e", 3), ("a", "e", 3), ("b", "e", 2), ("c", "e", 2), ("d", "e", 1), (None, "e", 4), (None, "e", 4)]))


def test_rows_without_a_reference_are_not_dealt_to_one_task(spark):
    texts = spark.range(2000, numPartitions=4).selectExpr("id", "if(id % 500 = 7, repeat('x', 50 + cast(id / 1000 as int)), concat('t', id)) as text", "map('a', id) as m")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        small, blobs = values.spill(texts.withColumn("text", F.when(F.col("id") != 9, F.col("text"))), "text", 40)
        found = values.rehydrate_blobs(small, "text", blobs)
        assert found.columns == small.columns
        assert {r.id: r.text for r in found.collect()} == {r.id: r.text if r.id != 9 else None for r in texts.collect()}
        assert found.where("length(text) < 40").select(F.spark_partition_id()).distinct().count() == 4
        with pytest.raises(Exception, match="no blob"):
            values.rehydrate_blobs(small, "text", blobs.limit(0)).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
