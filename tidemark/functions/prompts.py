"""Fields, sizes, scores and prices of prompts, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def named_field(text: Column, name: str) -> Column:
    """What follows `name: ` on the first line that begins so, without white space around it; else empty."""
    start = F.lit(f"{name}: ")
    lines = F.filter(F.split(text, r"\r\n|[\n\r]"), lambda x: F.startswith(x, start))
    return F.coalesce(F.trim(F.substring(F.get(lines, F.lit(0)), len(name) + 3, 1 << 30)), F.lit(""))


def tokens(text: Column) -> Column:
    """About four characters a token, at least one."""
    return F.greatest(F.lit(1), F.floor(F.length(text) / 4)).cast("bigint")


def score(name: Column) -> Column:
    """A steady score in [0.5, 0.95) from the first byte of the name's SHA-256."""
    return 0.5 + F.conv(F.substring(F.sha2(name, 256), 1, 2), 16, 10).cast("double") / 256 * 0.45


def price(tokens_in: Column, tokens_out: Column, per_million_in: float, per_million_out: float) -> Column:
    return (tokens_in * per_million_in + tokens_out * per_million_out) / 1_000_000
