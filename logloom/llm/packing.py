"""Documents as token windows of near-equal fill, by multiway differencing.

1. Texts become ids; every document's ids are cut: full windows first, the rest into
   pieces of at most ``max_piece`` ids. Checksums are taken where the ids are.
2. Pieces are dealt at random into groups of about ``group_windows`` windows, so that no
   group grows with the input. Full windows need no partner.
3. In each group the pieces are parted into m windows: every piece starts as a partial
   partition (one sum and m - 1 zeros); the two with the largest spread are merged, the
   largest sums of one on the smallest of the other, until one partition is left. m starts
   at the least number that could hold the group and rises while a window exceeds capacity.
"""

from __future__ import annotations

import functools
import heapq
import os
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from logloom.llm.arrow_text import WordTable, distinct_words, explode_texts, free_name, quoted, ragged, split_words
from logloom.session import stage

PIECE_FIELDS = [
    T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids_crc32", T.LongType()),
    T.StructField("doc_tokens", T.LongType()), T.StructField("piece_salt", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())),
]


#: Parts whose ids a worker remembers (about 20 MB), and the longest such part in characters.
REMEMBERED, SHORT = 600_000, 24
#: Text whose distinct parts are encoded together.
ENCODE_BYTES = 4 << 20
#: How every special string of the vocabularies begins.
SPECIAL = "<|"


@functools.lru_cache(maxsize=2)
def library(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.lru_cache(maxsize=2)
def word_ids(path: str) -> WordTable:
    """Ids of words; one table a worker process, of the first short words that it meets."""
    encode = library(path).encode_batch

    def made(words):
        # The library's results are large: a few thousand words at a time.
        for at in range(0, len(words), 4096):
            yield from [e.ids for e in encode(words[at:at + 4096], add_special_tokens=False)]

    return WordTable(made, REMEMBERED, SHORT)


def text_ids(texts: pa.Array, path: str, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after another, each text closed by ``end_id``, and ids before each text.

    This vocabulary's splitter never spans white space, nor a border of ASCII letters and
    punctuation, and its normaliser lowers case, so the ids of a text are those of its
    parts; each distinct part of the slice is encoded once. Where special strings may
    stand, only white space cuts.
    """
    special = bool(pc.any(pc.match_substring(texts, SPECIAL)).as_py())
    words, before = split_words(texts, finer=not special)
    distinct, codes = distinct_words(words)
    flat, starts = word_ids(path)(distinct)
    lengths = np.diff(starts)
    per_word = lengths[codes] if len(codes) else np.zeros(0, np.int64)
    ids = flat[ragged(starts[codes], per_word)] if len(codes) else flat
    ends = np.concatenate([[0], np.cumsum(per_word)])[before]
    return np.insert(ids, ends[1:], np.uint32(end_id)), ends + np.arange(len(ends))


def cut(docs: DataFrame, vocabulary: str, *, text: str, capacity: int, max_piece: int, end_id: int, keep_ids: bool) -> DataFrame:
    """One row a piece: the document's other columns and ``PIECE_FIELDS``."""

    def setup():
        def pieces(texts):
            ids, before = text_ids(texts, vocabulary, end_id)
            sizes = np.diff(before)
            full, rest = sizes // capacity, sizes % capacity
            counts = full + -(-rest // max_piece)
            rows = np.repeat(np.arange(len(sizes)), counts)
            nth = np.arange(len(rows)) - np.repeat(np.cumsum(counts) - counts, counts)
            over = np.maximum(nth - full[rows], 0)
            start = np.minimum(nth, full[rows]) * capacity + over * max_piece
            length = np.where(nth < full[rows], capacity, np.minimum(max_piece, sizes[rows] - start))
            raw, at = ids.astype("<u4"), before[rows] + start
            crc = np.fromiter((zlib.crc32(raw[a:a + n]) for a, n in zip(at.tolist(), length.tolist())), np.int64, len(rows))
            # Spreads repeated rows, too: the position in the slice takes part.
            salt = (crc * 0x9E3779B1 + np.arange(len(rows)) * 0x85EBCA77 + at) & 0x7FFFFFFFFFFF
            kept = pa.ListArray.from_arrays(pa.array(np.append(at, at[-1:] + length[-1:]).astype(np.int32)) if len(at) else pa.array([0], pa.int32()),
                                            pa.array(ids.astype(np.int32))) if keep_ids else pa.nulls(len(rows), pa.list_(pa.int32()))
            return rows, [pa.array(x.astype(np.int64)) for x in (start, length, crc, sizes[rows], salt)] + [kept]

        return pieces

    taken = {f.name for f in PIECE_FIELDS}
    return explode_texts(docs, setup, PIECE_FIELDS, text=text, keep=[c for c in docs.columns if c != text and c not in taken], most=ENCODE_BYTES)


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Indices of ``sizes`` in ``windows`` near-equal parts, by multiway differencing."""
    heap = []
    for i, size in enumerate(sizes):
        sums = np.zeros(windows, np.int64)
        sums[0] = size
        heap.append((-size, i, sums, [[i]] + [[] for _ in range(windows - 1)]))
    heapq.heapify(heap)
    turn = len(sizes)
    while len(heap) > 1:
        _, _, a, parts = heapq.heappop(heap)
        _, _, b, others = heapq.heappop(heap)
        sums = a + b[::-1]  # both fall: the largest meet the smallest
        joined = [x + y if x and y else x or y for x, y in zip(parts, reversed(others))]
        order = np.argsort(-sums, kind="stable")
        sums, turn = sums[order], turn + 1
        heapq.heappush(heap, (int(sums[-1] - sums[0]), turn, sums, [joined[k] for k in order]))
    return heap[0][3] if heap else []


def fill(sizes: list[int], capacity: int) -> list[list[int]]:
    """Windows of at most ``capacity``: one more window whenever some window is over it."""
    windows = max(1, -(-sum(sizes) // capacity))
    while True:
        parts = difference(sizes, windows)
        if all(sum(sizes[i] for i in p) <= capacity for p in parts):
            return [p for p in parts if p]
        windows += 1


def pack(docs: DataFrame, vocabulary: str, *, text: str = "text", capacity: int = 4096, max_piece: int = 512,
         group_windows: int = 48, end_id: int = 2, keep_ids: bool = False) -> DataFrame:
    """One row a piece: ``docs`` without its text, and start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of the library without added special tokens (strings of
    special tokens in a text become their ids, the library's default), then ``end_id``; a
    null or empty text is ``end_id`` alone. start counts the document's ids before the piece; offset is the
    piece's place in its sequence, without gaps from 0. ``keep_ids`` adds the ids
    themselves. Repeated rows are packed each; columns of ``docs`` that have the name of an
    output give way; an empty table gives an empty table. ``max_piece`` bounds the pieces
    of what is left after the full windows.
    """
    if not 0 < max_piece <= capacity:
        raise ValueError("max_piece must be between 1 and capacity")
    out = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * keep_ids
    others = [c for c in docs.columns if c != text and c.lower() not in {*out, "piece_salt", "ids"}]
    pieces = stage(cut(docs.select(*map(quoted, others), quoted(text)), vocabulary, text=text, capacity=capacity, max_piece=max_piece,
                       end_id=end_id, keep_ids=keep_ids), "pieces")
    total = pieces.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    groups = max(1, round(total / (capacity * group_windows)))
    group = free_name("pack_group", pieces.columns)
    pieces = pieces.withColumn(group, F.pmod(F.xxhash64("piece_salt", "start"), F.lit(groups)))
    schema = T.StructType([f for f in pieces.schema.fields if f.name not in ("piece_salt", group)] + [
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def windows(pdf: pd.DataFrame) -> pd.DataFrame:
        # An order of the rows' own, so that a repeated task gives the same windows.
        pdf = pdf.sort_values(["piece_salt", "start", "ids_crc32", "length"], kind="stable", ignore_index=True)
        sizes = pdf["length"].to_numpy()
        sequence, offset = np.zeros(len(pdf), np.int64), np.zeros(len(pdf), np.int64)
        whole = np.flatnonzero(sizes == capacity)
        sequence[whole] = np.arange(len(whole))
        rest = np.flatnonzero(sizes != capacity)
        for k, part in enumerate(fill(sizes[rest].tolist(), capacity) if len(rest) else []):
            at = rest[part]
            sequence[at] = len(whole) + k
            offset[at] = np.cumsum(sizes[at]) - sizes[at]
        pdf["sequence_id"] = (int(pdf[group].iloc[0]) << 24) + sequence
        pdf["offset"] = offset
        return pdf[schema.names]

    packed = pieces.groupBy(group).applyInPandas(windows, schema)
    return packed.select(*map(quoted, others), *out)
