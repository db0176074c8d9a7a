"""Keyed, memoised fan-out: only calls without a recorded outcome run, with retries, in as many partitions as wanted."""

from __future__ import annotations

import json
import traceback
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut

OUT = "pos bigint, key string, status string, output string, error string, attempts int"


def hits(requests: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    """Requests whose outcome is recorded, with it."""
    return requests.join(recorded, keys)


def misses(requests: DataFrame, recorded: DataFrame, keys: list[str]) -> DataFrame:
    return requests.join(recorded, keys, "left_anti")


def check_keys(items: DataFrame) -> None:
    """Keys are unique, non-empty strings; checked by aggregates before anything runs."""
    bad = items.agg(F.count_if(F.col("key").isNull() | (F.col("key") == "")).alias("empty")).first()["empty"]
    if bad:
        raise ValueError(f"{bad} items without a key")
    again = items.groupBy("key").count().where("count > 1").orderBy("key").first()
    if again:
        raise ValueError(f"the key {again['key']!r} occurs {again['count']} times")


def ceiling(failure: int, base: float = 1.0, cap: float = 60.0) -> float:
    if failure < 1:
        raise ValueError("failures are counted from 1")
    return min(cap, base * 2 ** (failure - 1))


def memoised_map(items: DataFrame, recorded: DataFrame, task: Callable[[str], object], *, retries: int = 0, concurrency: int = 8, collect: bool = False, ordered: bool = True) -> DataFrame:
    """pos, key, status, output, error, attempts of items (pos, key, item), in the order of pos if that is wanted.

    recorded (key, output) are hits and do not run. A failing item is tried retries times more; then, with collect, its
    slot holds the error, else the first failure in the order of pos is raised. The outcomes are written to the shared
    folder before anything reads them, so whatever is done with the result, no task runs again.
    """
    check_keys(items)
    found = hits(items, recorded.select("key", "output"), ["key"]).select("pos", "key", F.lit("hit").alias("status"), "output", F.lit(None).cast("string").alias("error"), F.lit(0).alias("attempts"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for pos, key, item in zip(b["pos"], b["key"], b["item"], strict=True):
                for n in range(1, retries + 2):
                    try:
                        rows.append((pos, key, "completed", json.dumps(task(item), separators=(",", ":")), None, n))
                        break
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                        if n == retries + 1:
                            rows.append((pos, key, "failed", None, error, n))
                            traceback.clear_frames(e.__traceback__)
            yield pd.DataFrame(rows, columns=["pos", "key", "status", "output", "error", "attempts"])

    ran = cut(misses(items, recorded, ["key"]).select("pos", "key", "item").repartition(concurrency).mapInPandas(run, OUT), "outcomes")
    out = found.unionByName(ran)
    if not collect:
        first = ran.agg(F.min_by("error", F.when(F.col("status") == "failed", F.col("pos"))).alias("e")).first()["e"]
        if first:
            raise RuntimeError(first)
    return out.orderBy("pos") if ordered else out


def gather(*branches: DataFrame) -> DataFrame:
    """Branches side by side, each row tagged with its branch's place."""
    tagged = [b.withColumn("branch", F.lit(i)) for i, b in enumerate(branches)]
    out = tagged[0]
    for b in tagged[1:]:
        out = out.unionByName(b, allowMissingColumns=True)
    return out


def keyed_load(rows: DataFrame, target: DataFrame | None, key: str) -> DataFrame:
    """Rows to append so that each key is there once, however often the load runs."""
    new = rows.dropDuplicates([key])
    return new if target is None else new.join(target.select(key), key, "left_anti")
