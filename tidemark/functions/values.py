"""Semi-structured values: tagged JSON, redaction, content-addressed large values."""

from __future__ import annotations

import dataclasses
import datetime as dt
import enum
import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAG = "$tide"
MASK = "***REDACTED***"
# Parts of field names whose values are masked.
SENSITIVE = ("password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "accesskey", "private_key", "credential", "authorization", "session_token")
SPILL_BYTES = 262_144


class EncodeError(TypeError):
    """A value with no encoded form; the message names its path."""


class Fields(dict):
    """The fields of a decoded data class or model: a plain object that knows its kind and type, so it encodes as it came."""

    def __init__(self, fields: dict, kind: str, type_name: str | None) -> None:
        super().__init__(fields)
        self.kind, self.type_name = kind, type_name

    def __reduce__(self):
        return Fields, (dict(self), self.kind, self.type_name)


def encode(value, path: str = "$"):
    """Plain JSON values stand for themselves; others become tagged objects."""
    if isinstance(value, enum.Enum):
        return {TAG: "enum", "type": type(value).__qualname__, "v": encode(value.value, path)}
    if value is None or isinstance(value, bool | int | float | str):
        return value
    if isinstance(value, dt.datetime):
        return {TAG: "datetime", "v": value.isoformat()}
    if isinstance(value, dt.timedelta):
        return {TAG: "timedelta", "v": value.total_seconds()}
    if isinstance(value, list | tuple):
        return [encode(x, f"{path}[{i}]") for i, x in enumerate(value)]
    if isinstance(value, dict):
        for k in value:
            if not isinstance(k, str):
                raise EncodeError(f"{path}: the key {k!r} is not a string")
        fields = {k: encode(x, f"{path}.{k}") for k, x in value.items()}
        return {TAG: value.kind, "type": value.type_name, "fields": fields} if isinstance(value, Fields) else fields
    if dataclasses.is_dataclass(value) and not isinstance(value, type):
        fields = {f.name: encode(getattr(value, f.name), f"{path}.{f.name}") for f in dataclasses.fields(value)}
        return {TAG: "dataclass", "type": type(value).__qualname__, "fields": fields}
    if callable(dump := getattr(value, "model_dump", None)):
        return {TAG: "model", "type": type(value).__qualname__, "fields": encode(dump(), path)}
    raise EncodeError(f"{path}: {type(value).__name__} has no encoded form")


def decode(data):
    """The value again; data classes and models come back as objects of their fields that keep their type."""
    if isinstance(data, list):
        return [decode(x) for x in data]
    if not isinstance(data, dict):
        return data
    if TAG not in data:
        return {k: decode(x) for k, x in data.items()}
    match data[TAG]:
        case "datetime":
            return dt.datetime.fromisoformat(data["v"])
        case "timedelta":
            return dt.timedelta(seconds=data["v"])
        case "enum":
            return decode(data["v"])
        case "dataclass" | "model" as kind:
            if not isinstance(data.get("fields"), dict):
                raise ValueError(f"a {kind} without an object of fields: damaged, or masked as a whole")
            return Fields({k: decode(x) for k, x in data["fields"].items()}, kind, data.get("type"))
        case other:
            raise ValueError(f"no value of tag {other!r} can be read")


def to_text(value) -> str:
    return json.dumps(encode(value), separators=(",", ":"))


def from_text(text: str):
    return decode(json.loads(text))


def matches(name: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(F.lower(name), F.lit(p)) for p in SENSITIVE))


def sensitive(name: str) -> bool:
    return any(p in name.lower() for p in SENSITIVE)


def redact_value(value):
    """A copy with what stands under a sensitive name masked whole."""
    if isinstance(value, dict):
        return {k: MASK if sensitive(k) else redact_value(x) for k, x in value.items()}
    return [redact_value(x) for x in value] if isinstance(value, list) else value


def redact_text(text: str | None) -> str | None:
    """JSON text, redacted; null stays null, and what is no JSON is masked whole, for nobody knows what it holds."""
    if text is None:
        return None
    try:
        value = json.loads(text)
    except ValueError:
        return json.dumps(MASK)
    return json.dumps(redact_value(value), separators=(",", ":"), ensure_ascii=False)


@F.pandas_udf(T.StringType())
def redact_json(texts: pd.Series) -> pd.Series:
    """redact_text of a column: JSON of any shape."""
    return texts.map(redact_text)


def redact_column(column: Column, kind: T.DataType, name: str = "") -> Column:
    """The same over a declared schema, without Python: rebuilds structs, arrays and maps around masked values.

    A map with a value to mask whose values are no text has no place for the mask: all its values become JSON texts.
    """
    if name and sensitive(name):
        return F.when(column.isNotNull(), F.lit(MASK))
    if isinstance(kind, T.StructType):
        return F.when(column.isNotNull(), F.struct(*(redact_column(column[f.name], f.dataType, f.name).alias(f.name) for f in kind)))
    if isinstance(kind, T.ArrayType):
        return F.transform(column, lambda x: redact_column(x, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform_values(column, lambda k, v: F.when(v.isNotNull() & matches(k.cast("string")), F.lit(MASK)).otherwise(_map_value(v, kind.valueType)))
    return column


def _map_value(value: Column, kind: T.DataType) -> Column:
    """A map's value beside masked ones: text as it is, anything else redacted and as JSON."""
    if isinstance(kind, T.StringType):
        return value
    if isinstance(kind, T.StructType | T.ArrayType | T.MapType):
        return F.to_json(redact_column(value, kind))
    return value.cast("string")


def redact_frame(df: DataFrame, slots_only: bool = False) -> DataFrame:
    """Every column redacted; with slots_only just those whose name ends in _ref."""
    return df.select(*(redact_column(F.col(f"`{f.name}`"), f.dataType, "" if slots_only else f.name).alias(f.name) if not slots_only or f.name.endswith("_ref") else F.col(f"`{f.name}`") for f in df.schema))


def encoded_size(text: Column) -> Column:
    """Bytes of a JSON text in which every character beyond ASCII is written as escapes (6 bytes, 12 beyond the BMP)."""
    wide = F.length(F.regexp_replace(text, r"[\x00-\x7F]+", ""))
    astral = F.length(F.regexp_replace(text, r"[\x{0}-\x{FFFF}]+", ""))
    return F.length(text) + 5 * wide + 6 * astral


def should_spill(text: Column, threshold: int = SPILL_BYTES) -> Column:
    return encoded_size(text) > threshold


def blob_id(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def blob_ref(text: Column) -> Column:
    return F.to_json(F.struct(F.lit("blobref").alias(TAG), blob_id(text).alias("id"), encoded_size(text).cast("long").alias("size")))


def is_blob_ref(text: Column) -> Column:
    return F.coalesce(F.get_json_object(text, f"$['{TAG}']") == "blobref", F.lit(False))


def spill(df: DataFrame, column: str, threshold: int = SPILL_BYTES) -> tuple[DataFrame, DataFrame]:
    """(df with oversized values replaced by references, the blobs, one row for each content)."""
    over = should_spill(F.col(column), threshold)
    blobs = df.where(over).select(blob_id(F.col(column)).alias("blob_id"), encoded_size(F.col(column)).cast("long").alias("size"), F.col(column).alias("data")).dropDuplicates(["blob_id"])
    return df.withColumn(column, F.when(over, blob_ref(F.col(column))).otherwise(F.col(column))), blobs


def put_blobs(blobs: DataFrame, stored: DataFrame) -> DataFrame:
    """The blobs that a store does not hold yet; to be appended."""
    return blobs.join(stored.select("blob_id"), "blob_id", "left_anti")


def rehydrate_blobs(df: DataFrame, column: str, blobs: DataFrame) -> DataFrame:
    """References replaced by their values; one that the store does not hold is an error. Other rows stay where they are."""
    # made by a generator, below which no filter goes: the filters would work the references out once more each
    named = df.withColumn("_blob", F.explode(F.array(F.when(is_blob_ref(F.col(column)), F.get_json_object(column, "$.id")))))
    plain = named.where(F.col("_blob").isNull()).select(df.columns)
    found = named.where(F.col("_blob").isNotNull()).join(blobs.select(F.col("blob_id").alias("_blob"), F.col("data").alias("_data")), "_blob", "left")
    missing = F.raise_error(F.concat(F.lit("no blob "), F.col("_blob")))
    return plain.union(found.withColumn(column, F.when(F.col("_data").isNotNull(), F.col("_data")).otherwise(missing)).select(df.columns))


def rehydrate(text: Column, schema: T.DataType) -> Column:
    """A value by declared type; null wins over the declaration."""
    return F.from_json(text, schema)


def rehydrate_union(text: Column, arms: dict[str, T.StructType]) -> Column:
    """A tagged union as STRUCT<type, one field for each arm>; an arm that is not declared is an error."""
    kind, fields = F.get_json_object(text, "$.type"), F.get_json_object(text, "$.fields")
    known = F.when(kind.isNull() | kind.isin(*arms), kind).otherwise(F.raise_error(F.concat(F.lit("no arm takes "), kind)))
    return F.when(text.isNotNull(), F.struct(known.alias("type"), *(F.when(kind == n, F.from_json(fields, s)).alias(n) for n, s in arms.items())))


def encode_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For mapInPandas: every row as one tagged JSON text."""
    for b in batches:
        yield pd.DataFrame({"text": [to_text({k: v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for k, v in r.items()}) for r in b.to_dict("records")]})
