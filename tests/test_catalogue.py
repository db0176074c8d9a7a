"""Every catalogue query beside its SQL twin in DuckDB."""

import datetime
import math

import duckdb
import pytest

from tidemark.plans.catalogue import _cancels, ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool | str | datetime.datetime):
        return x
    return round(float(x), 6)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_twin(name, spark, sf_dir, duck):
    found = QUERIES[name](spark, sf_dir)
    said = duck.sql(ORACLE_SQL[name])
    columns = sorted(said.columns)
    assert columns == sorted(found.columns)
    a = sorted(repr([plain(r[c]) for c in columns]) for r in found.collect())
    b = sorted(repr([plain(r[said.columns.index(c)]) for c in columns]) for r in said.fetchall())
    assert a == b


def test_stream_and_batch_agree(spark, sf_dir):
    rows = lambda q: {r["wait_id"]: r["row_id"] for r in QUERIES[q](spark, sf_dir).collect()}
    batch, stream = rows("fifo_timeout_match"), rows("stream_wait_match")
    assert {k: v for k, v in batch.items() if v} == {k: v for k, v in stream.items() if v}


def test_maps_read_whole_texts(spark, tmp_path):
    texts = ["b" * 70, "A" + "c" * 50, "", "d" * 20, "E", "é" * 33, None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    n = lambda t: '{"n":%d}' % len(t or "")
    found = {r.pos: (r.status, r.output) for r in QUERIES["memoised_map_texts"](spark, str(tmp_path)).collect()}
    assert found == {i: ("completed" if i % 3 else "hit", n(t)) for i, t in enumerate(texts)}
    found = {r.pos: (r.status, r.output, r.error) for r in QUERIES["collect_map_texts"](spark, str(tmp_path)).collect()}
    bad = lambda i, t: i % 3 and (t or "")[:1] in "AEIOU"
    assert found == {i: ("failed", None, f"ValueError: begins with {(t or '')[:1]}") if bad(i, t) else ("completed" if i % 3 else "hit", n(t), None) for i, t in enumerate(texts)}


def test_cancels_read_the_whole_journal(spark):
    ended = [("a", i, "TaskScheduled", None) for i in range(1, 8)] + [("a", 8, "WorkflowCompleted", None)]
    still = [("b", i, "TaskScheduled", None) for i in range(1, 8)] + [("b", 10, "WorkflowWaiting", None)]
    j = spark.createDataFrame(ended + still, "run_id string, seq bigint, type string, error_message string")
    assert [tuple(r) for r in _cancels(j).collect()] == [("b", 11, "WorkflowCancelled")]


def test_version_of_every_run(spark, sf_dir):
    runs = {r.run_id for r in spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr("cast(user_id as string) as run_id").distinct().collect()}
    assert "7" in runs and {r.run_id for r in QUERIES["version_mismatch_all"](spark, sf_dir).collect()} == runs


def test_call_tree_is_not_bound_by_the_row_limit_of_recursive_queries(spark, sf_dir):
    want = sorted(QUERIES["call_tree"](spark, sf_dir).collect())
    spark.conf.set("spark.sql.cteRecursionRowLimit", "100")
    try:
        assert sorted(QUERIES["call_tree"](spark, sf_dir).collect()) == want and sum(r.n_nodes for r in want) > 100
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
