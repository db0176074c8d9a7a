"""Identities of durable calls, idempotency keys and backoff."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def call_identity(task: Column, ordinal: Column, key: Column) -> Column:
    """task:key:<key> where there is a key, else task:<ordinal>."""
    return F.when(key.isNotNull(), F.concat_ws(":key:", task, key)).otherwise(F.concat_ws(":", task, ordinal.cast("string")))


def key_of(identity: Column) -> Column:
    """The key within a keyed identity; null for an ordinal one."""
    return F.when(F.contains(identity, F.lit(":key:")), F.split_part(identity, F.lit(":key:"), F.lit(2)))


def idempotency_key(run_id: Column, task: Column, ordinal_or_key: Column) -> Column:
    """SHA-256 of the parts, joined by NUL; arguments of the call take no part."""
    return F.sha2(F.concat_ws("\0", run_id, task, ordinal_or_key.cast("string")), 256)


def load_key(idempotency: Column, record: Column) -> Column:
    return F.concat(idempotency, F.lit("#"), record.cast("string"))


def backoff_ceiling(failure: Column, base: float = 1.0, cap: float = 60.0) -> Column:
    """min(cap, base * 2 ** (failure - 1)) for the failure-th failure, from 1 on."""
    return F.when(failure < 1, F.raise_error(F.lit("failures are counted from 1"))).otherwise(F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), failure - 1))).cast("double")


def backoff_delay(identity: Column, failure: Column, seed: int = 0, base: float = 1.0, cap: float = 60.0) -> Column:
    """Full jitter: a reproducible share of the ceiling, whatever the partitioning."""
    share = F.pmod(F.xxhash64(F.lit(seed), identity, failure), F.lit(1 << 53)).cast("double") / float(1 << 53)
    return share * backoff_ceiling(failure, base, cap)


def as_interval(seconds: Column) -> Column:
    """Seconds, whole or not, as a day-time interval."""
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)


def source_version(*sources: str, commit: str | None = None, dev: str | None = None) -> str:
    """git:<commit>, else dev:<name>, else src:<16 hex of the sources' SHA-256>."""
    import hashlib

    if commit:
        return f"git:{commit}"
    return f"dev:{dev}" if dev else "src:" + hashlib.sha256("\0".join(sources).encode()).hexdigest()[:16]
