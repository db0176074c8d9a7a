"""Chat formatting with offset-aligned loss masks (operator 10).

A conversation is rendered turn after turn as ``<|turn|>role<|text|>text<|end|>``; in roles and texts a backslash goes
before every backslash and into every control string, so no text can form a mark and the original can be read back.
The rendering is encoded once with character offsets, marks being special tokens of their own; sorted assistant spans
are intersected with the sorted token spans by binary search, and what lies under the mask is read back by offsets.

Rows come to a task sorted by conversation and turn, and a conversation is taken in blocks of turns: as marks are split
off before the vocabulary sees a text, blocks have the tokens of the whole, and a conversation of any length needs the
memory of one block.

Defined cases: a null text or role is empty; turns of one number are ordered by role, then text; a null conversation id
is a conversation of its own; an empty table gives no rows (but for those that the query adds).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# Strings that steer common chat templates.
CONTROL = ("<|", "|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
BLOCK_TURNS = 512
BLOCK_CHARS = 1 << 20
_ESCAPE = re.compile(r"\\|" + "|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROL))
_UNESCAPE = re.compile(r"\\(.)", re.S)
_READ = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END), re.S)


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: "\\\\" if m[0] == "\\" else m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(the formatted text, character spans of each turn's text in it)."""
    parts: list[str] = []
    spans = []
    at = 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{TEXT}", escape(text)
        parts += (head, body, END)
        spans.append((at + len(head), at + len(head) + len(body)))
        at += len(head) + len(body) + len(END)
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns again."""
    turns, at = [], 0
    for m in _READ.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn begins at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn begins at {at}")
    return turns


def mask_of(offsets: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Which tokens (sorted character offsets) lie in the sorted spans: two binary searches a span.

    A character of several bytes can be several tokens of the same offsets; all of them lie in the span.
    """
    mask = np.zeros(len(offsets), bool)
    starts, ends = np.ascontiguousarray(offsets[:, 0]), np.ascontiguousarray(offsets[:, 1])
    for s, e in spans:
        mask[np.searchsorted(starts, s, side="left") : np.searchsorted(ends, e, side="right")] = True
    return mask


_coder: dict[str, object] = {}


def coder(vocabulary: str):
    if vocabulary not in _coder:
        import public_tokenizers
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(vocabulary if "/" in vocabulary else public_tokenizers.path(vocabulary))
        t.add_special_tokens([TURN, TEXT, END])
        _coder[vocabulary] = t
    return _coder[vocabulary]


class Conversation:
    """Running digests of one conversation, fed block by block with what was read back from its rendering."""

    def __init__(self) -> None:
        self.turns, self.chars, self.loss_chars, self.tokens, self.loss_tokens = 0, 0, 0, 0, 0
        self.turn_hash, self.loss_hash = hashlib.sha256(), hashlib.sha256()

    def add(self, turns: list[tuple[str, str]], vocabulary: str, trained: str) -> tuple[list[int], np.ndarray, str]:
        """Format a block; gives its token ids, loss mask and text."""
        text, spans = render(turns)
        found = coder(vocabulary).encode(text, add_special_tokens=False)
        offsets = np.array(found.offsets, np.int64).reshape(-1, 2)
        own = [s for s, (role, _) in zip(spans, turns, strict=True) if role == trained]
        mask = mask_of(offsets, own)
        # read back: the turns from the text, the trained texts from the characters under the mask
        for role, body in parse(text):
            self.turns += 1
            self.turn_hash.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
        at = 0
        covered = []
        for s, e in offsets[mask].tolist():
            if e > at:
                covered.append(text[max(s, at) : e])
                at = e
        loss = unescape("".join(covered))
        self.loss_chars += len(loss)
        self.loss_hash.update(loss.encode("utf-8", "surrogatepass"))
        self.chars += len(text)
        self.tokens += len(found.ids)
        self.loss_tokens += int(mask.sum())
        return found.ids, mask, text


def format_chats(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", trained: str = "assistant", outputs: bool = False) -> DataFrame:
    """One row per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_tokens, n_loss_tokens.

    With outputs, one row per block instead: conv_id, block, formatted, ids, mask.
    """
    rows = rows.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    if outputs:
        schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("formatted", pa.string()), ("ids", pa.list_(pa.int32())), ("mask", pa.list_(pa.bool_()))])
        ddl = "conv_id long, block long, formatted string, ids array<int>, mask array<boolean>"
    else:
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_tokens", pa.int64()), ("n_loss_tokens", pa.int64())])
        ddl = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"

    def batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def every():
            for b in batches:
                yield from zip(b.column(0).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True)
            yield None

        now: Conversation | None = None
        conv, turns, size, block = None, [], 0, 0
        out: list[tuple] = []
        for row in every():
            new = now is not None and (row is None or row[0] != conv)
            if turns and (new or len(turns) >= BLOCK_TURNS or size >= BLOCK_CHARS):
                ids, mask, text = now.add(turns, vocabulary, trained)
                if outputs:
                    out.append((conv, block, text, ids, mask.tolist()))
                turns, size, block = [], 0, block + 1
            if new:
                if not outputs:
                    out.append((conv, now.turns, now.turn_hash.hexdigest(), now.loss_chars, now.loss_hash.hexdigest(), now.chars, now.tokens, now.loss_tokens))
                now = None
            if len(out) >= 1000:
                yield batch(out)
                out = []
            if row is not None:
                if now is None:
                    now, conv, block = Conversation(), row[0], 0
                turns.append((row[1], row[2]))
                size += len(row[2])
        if out:
            yield batch(out)

    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, ddl)


#: Conversation -1 of the query: control strings of a common template within its texts.
ADDED = ((-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"))


def with_added(conversations: DataFrame) -> DataFrame:
    spark = conversations.sparkSession
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return own.union(spark.createDataFrame(list(ADDED), own.schema))


def _sql() -> str:
    def extra(x: str) -> str:
        return f"(length({x}) - length(replace({x}, chr(92), '')))" + "".join(f" + (length({x}) - length(replace({x}, '{c}', ''))) // {len(c)}" for c in CONTROL)

    marks = len(TURN + TEXT + END)
    return rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')))
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum({marks} + length(role) + length(text) + {extra('role')} + {extra('text')})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id
"""


SQL = _sql()
