"""Conversations as training text with a loss mask aligned to token offsets.

A conversation is rendered whole and encoded once with offsets. The spans of assistant
texts are known from rendering, the spans of tokens from encoding; both are sorted, so a
binary search gives each token its turn. A token bears loss if it lies inside an
assistant's text. Turn markers are added tokens of the encoder, so no token spans the
border of a text.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from logloom.llm.arrow_text import quoted

OPEN, CLOSE = "<|turn|>", "<|close|>"
#: Conversations encoded at once, by characters.
ENCODE_CHARS = 1 << 20

FORMATTED = T.StructType([
    T.StructField("conv_id", T.LongType()), T.StructField("n_turns", T.LongType()), T.StructField("formatted", T.StringType()),
    T.StructField("token_ids", T.ArrayType(T.IntegerType())), T.StructField("token_starts", T.ArrayType(T.IntegerType())),
    T.StructField("token_ends", T.ArrayType(T.IntegerType())), T.StructField("loss_mask", T.ArrayType(T.BooleanType())),
])


def escape(text: str) -> str:
    """Text in which no marker occurs: a backslash stands before each backslash and inside each ``<|``."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The text of a conversation and the spans of its assistant texts, in code points."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = OPEN + escape(role).replace("\n", "\\\n") + "\n"
        body = escape(text)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, CLOSE, "\n"]
        at += len(head) + len(body) + len(CLOSE) + 1
    return "".join(parts), spans


_TURN = re.compile(re.escape(OPEN) + r"((?:[^\\\n]|\\.)*)\n((?:(?!" + re.escape(CLOSE) + r").)*+)" + re.escape(CLOSE) + "\n", re.S)


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """The turns read back from a rendered conversation."""
    return [(unescape(m[1]), unescape(m[2])) for m in _TURN.finditer(formatted)]


def token_mask(spans: list[tuple[int, int]], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which tokens lie inside a span; spans and tokens are sorted."""
    if not spans or not len(starts):
        return np.zeros(len(starts), bool)
    begin, end = np.array(spans).T
    at = np.searchsorted(begin, starts, "right") - 1
    return (at >= 0) & (ends <= end[np.maximum(at, 0)]) & (ends > starts)


def loss_text(formatted: str, starts: np.ndarray, ends: np.ndarray, mask: np.ndarray) -> str:
    """What lies under the mask, unescaped."""
    # Tokens of one character's bytes share its offsets; runs of masked tokens join.
    parts, lo, hi = [], None, None
    for s, e in zip(starts[mask].tolist(), ends[mask].tolist()):
        if hi is not None and s <= hi:
            hi = max(hi, e)
            continue
        if hi is not None:
            parts.append(formatted[lo:hi])
        lo, hi = s, e
    if hi is not None:
        parts.append(formatted[lo:hi])
    return unescape("".join(parts))


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import AddedToken, Tokenizer, processors

    made = Tokenizer.from_file(path)
    made.add_special_tokens([AddedToken(OPEN, normalized=False), AddedToken(CLOSE, normalized=False)])
    made.post_processor = processors.ByteLevel(trim_offsets=False)
    return made


def format_conversations(conversations: DataFrame, vocabulary: str) -> DataFrame:
    """One row a conversation: conv_id, n_turns, formatted, token_ids, token_starts, token_ends, loss_mask.

    Turns follow ``turn``, ties ``role`` and ``text``, nulls first; repeated rows are turns of their own. A null
    role or text is empty; rows without conv_id form one conversation without an id. Other
    columns are not looked at. Offsets are code points of ``formatted``. ``vocabulary`` is a
    byte-level vocabulary whose encoder keeps every character. A conversation is the unit
    of the result, so it is gathered whole, long or not.
    """
    grouped = conversations.select(quoted("conv_id").cast("long").alias("conv_id"), quoted("turn").cast("long").alias("turn"),
                                   quoted("role").cast("string").alias("role"), quoted("text").cast("string").alias("text"))
    grouped = grouped.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    grouped = grouped.select("conv_id", F.transform("turns", lambda t: F.coalesce(t["role"], F.lit(""))).alias("roles"),
                             F.transform("turns", lambda t: F.coalesce(t["text"], F.lit(""))).alias("texts"))

    def encoded(rows):
        batch = encoder(vocabulary).encode_batch([r[2] for r in rows], add_special_tokens=False)
        columns: list[list] = [[] for _ in FORMATTED.names]
        for (conv, n, formatted, spans), e in zip(rows, batch):
            offsets = np.array(e.offsets, np.int32).reshape(-1, 2)
            mask = token_mask(spans, offsets[:, 0], offsets[:, 1])
            for column, value in zip(columns, (conv, n, formatted, e.ids, offsets[:, 0], offsets[:, 1], mask)):
                column.append(value)
        kinds = [pa.int64(), pa.int64(), pa.string()] + [pa.list_(pa.int32())] * 3 + [pa.list_(pa.bool_())]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=FORMATTED.names)

    def run(batches):
        for batch in batches:
            rows, chars = [], 0
            for conv, roles, texts in zip(*(c.to_pylist() for c in batch.columns)):
                formatted, spans = render(list(zip(roles, texts)))
                rows.append((conv, len(texts), formatted, spans))
                chars += len(formatted)
                if chars > ENCODE_CHARS:
                    yield encoded(rows)
                    rows, chars = [], 0
            if rows:
                yield encoded(rows)

    return grouped.mapInArrow(run, FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_text, loss_text, formatted_chars`` read from the rendered text and the token mask alone."""

    def run(batches):
        for batch in batches:
            column = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            turns, loss, counts = [], [], []
            for row, text in enumerate(column["formatted"].to_pylist()):
                found = turns_of(text)
                counts.append(len(found))
                turns.append("".join(f"{role}\n{said}\n" for role, said in found))
                starts, ends, mask = (np.array(column[c][row].as_py(), kind) for c, kind in (
                    ("token_starts", np.int64), ("token_ends", np.int64), ("loss_mask", bool)))
                loss.append(loss_text(text, starts, ends, mask))
            yield pa.RecordBatch.from_arrays(
                [column["conv_id"], pa.array(counts, pa.int64()), pa.array(turns, pa.string()), pa.array(loss, pa.string()),
                 pa.array([len(t) for t in column["formatted"].to_pylist()], pa.int64())],
                names=["conv_id", "n_turns", "turns_text", "loss_text", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "token_starts", "token_ends", "loss_mask").mapInArrow(
        run, "conv_id long, n_turns long, turns_text string, loss_text string, formatted_chars long")
