"""Whole texts in Arrow batches: slicing by bytes, words as flat arrays, mapping over documents."""

from __future__ import annotations

import ctypes
import functools
import itertools
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Text handled at once inside a task; a longer text is handled alone and whole.
SLICE_BYTES = 4 << 20


def quoted(name: str) -> Column:
    """A column by its exact name, dots and back quotes included."""
    return F.col("`" + name.replace("`", "``") + "`")


def free_name(wanted: str, taken: Iterable[str]) -> str:
    """``wanted``, lengthened until no column has it (names compare without case, as in Spark)."""
    low = {t.lower() for t in taken}
    while wanted.lower() in low:
        wanted += "_"
    return wanted


def as_texts(column: pa.Array) -> pa.Array:
    """Strings with 64-bit offsets; null is the empty text."""
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of ``texts`` and where each text starts, as views."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and data.size else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the texts of the last column come to at most ``most`` bytes, or are one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, ends = buffers(as_texts(batch.column(batch.num_columns - 1)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to


#: What a byte is to ``split_words``: 0 space, 1 ASCII letter, 2 ASCII punctuation but the apostrophe, 3 other.
_BYTES = np.array([0 if b in b" \t\n\x0b\x0c\r" else 1 if chr(b).isalpha() and b < 128 else 2 if 33 <= b < 127 and b != 39 and not chr(b).isdigit() else 3
                   for b in range(256)], np.uint8)


def split_words(texts: pa.Array, finer: bool = False) -> tuple[pa.Array, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of all texts one after another, and the number of words before each text.

    ``finer`` cuts between ASCII letters and ASCII punctuation, too, the apostrophe left
    out, and lowers A-Z: fewer distinct words for encoders that do both themselves.
    """
    data, offsets = buffers(texts)
    kind = _BYTES[data]
    solid = kind > 0
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    if finer:
        first[1:] |= kind[1:] + kind[:-1] == 3
        first[1:] &= (kind[1:] > 0) & ((kind[1:] != 3) | (kind[:-1] == 0))
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    begin = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[begin] = solid[begin]
    before = np.searchsorted(np.flatnonzero(first), offsets)
    kept = data[solid]
    starts = np.append(np.flatnonzero(first[solid]), len(kept)).astype(np.int64)
    words = pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(kept)])
    return words, before


def distinct_words(words: pa.Array) -> tuple[list[str], np.ndarray]:
    """The distinct words and, for each word, the index of its distinct word."""
    encoded = words.dictionary_encode()
    return encoded.dictionary.to_pylist(), encoded.indices.to_numpy(zero_copy_only=False)


def word_hashes(words: pa.Array) -> np.ndarray:
    """A 64-bit hash of every word."""
    distinct, codes = distinct_words(words)
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w) for w in distinct), np.uint64, len(distinct))[codes] if distinct else np.zeros(0, np.uint64)


def sums_by_row(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sums of a flat array over the rows that ``before`` bounds; an empty row gives 0."""
    return np.diff(np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])[before])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices ``starts[i] .. starts[i]+lengths[i]-1`` for every i, one after another."""
    total = np.cumsum(lengths)
    return np.repeat(starts - np.concatenate([[0], total[:-1]]) if len(starts) else starts, lengths) + np.arange(total[-1] if len(total) else 0)


def joined_words(words: pa.Array, before: np.ndarray) -> pa.Array:
    """The words of each row, joined by one space."""
    lists = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), words.cast(pa.string()))
    return pc.binary_join(lists, " ")


@functools.lru_cache(maxsize=1)
def _trim() -> Callable[[int], int] | None:
    """glibc's malloc_trim, where the C library has it."""
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Hand freed memory back to the system: workers live on between tasks, and with them what they once needed."""
    pa.default_memory_pool().release_unused()
    if (trim := _trim()) is not None:
        trim(0)


def map_in_arrow(df: DataFrame, run: Callable, schema: T.StructType | str) -> DataFrame:
    """``mapInArrow`` whatever the columns are called, dots included; ``run`` goes by the order of columns. Memory is released when a task ends."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    given, plain = [f"c{i}" for i in range(len(df.columns))], [f"c{i}" for i in range(len(schema))]

    def unnamed(batches):
        try:
            for batch in run(batches):
                yield pa.RecordBatch.from_arrays(batch.columns, names=plain)
        finally:
            release()

    made = T.StructType([T.StructField(n, f.dataType) for n, f in zip(plain, schema)])
    return df.toDF(*given).mapInArrow(unnamed, made).toDF(*schema.names)


def _prepared(df: DataFrame, fields: list[T.StructField], text: str, keep: list[str] | None, extra: list[str]) -> tuple[DataFrame, list[T.StructField]]:
    """The columns a function over texts needs: those that pass through, the extra ones, the text last."""
    new = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in new and f.name not in extra and (keep is None or f.name in keep)]
    names = [f.name for f in kept] + [f.name for f in fields]
    inputs = []
    for name in [*extra, text]:
        inputs.append(free_name("given", [*names, *inputs]))
    columns = [quoted(c).alias(n) for c, n in zip(extra, inputs)] + [quoted(text).cast("string").alias(inputs[-1])]
    return df.select(*[quoted(f.name) for f in kept], *columns), kept


def map_texts(df: DataFrame, setup: Callable[[], Callable[..., list[pa.Array]]], fields: list[T.StructField], *, text: str = "text",
              keep: list[str] | None = None, extra: Sequence[str] = (), most: int = SLICE_BYTES) -> DataFrame:
    """Columns made from whole texts, in Arrow batches.

    ``setup`` runs once a task and gives the function from texts, and the columns named
    by ``extra``, to arrays, one array a field. Other columns of ``df`` (or those of
    ``keep``) pass through; one that has the name of a new field gives way to it.
    """
    source, kept = _prepared(df, fields, text, keep, list(extra))
    names, k = [f.name for f in kept] + [f.name for f in fields], len(kept)

    def run(batches):
        made = setup()
        for piece in slices(batches, most):
            columns = made(as_texts(piece.column(piece.num_columns - 1)), *piece.columns[k:-1])
            yield pa.RecordBatch.from_arrays([*piece.columns[:k], *columns], names=names)

    return map_in_arrow(source, run, T.StructType(kept + fields))


def explode_texts(df: DataFrame, setup: Callable[[], Callable[..., tuple[np.ndarray, list[pa.Array]]]], fields: list[T.StructField], *,
                  text: str = "text", keep: list[str] | None = None, extra: Sequence[str] = (), most: int = SLICE_BYTES) -> DataFrame:
    """As ``map_texts``, with any number of rows for a text: the function also gives the row of each made row."""
    source, kept = _prepared(df, fields, text, keep, list(extra))
    names, k = [f.name for f in kept] + [f.name for f in fields], len(kept)

    def run(batches):
        made = setup()
        for piece in slices(batches, most):
            rows, columns = made(as_texts(piece.column(piece.num_columns - 1)), *piece.columns[k:-1])
            rows = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*[c.take(rows) for c in piece.columns[:k]], *columns], names=names)

    return map_in_arrow(source, run, T.StructType(kept + fields))


def whole_groups(batches: Iterable[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by the first ``keys`` columns."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = [c.slice(batch.num_rows - 1) for c in batch.columns[:keys]]
        same = np.ones(batch.num_rows, bool)
        for column, last in zip(batch.columns[:keys], ends):
            same &= pc.equal(column, last[0]).to_numpy(zero_copy_only=False)
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        joins = bool(held) and all(h.column(j)[0].equals(batch.column(j)[0]) for h in held[:1] for j in range(keys))
        if held and not joins:
            yield pa.Table.from_batches(held)
            held = []
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


class WordTable:
    """Values of words, each a run of 32-bit numbers, under 128-bit hashes in sorted arrays: about 30 bytes a word.

    ``make`` gives the values of words that aren't remembered; words of at most ``longest``
    characters are remembered until there are ``most`` of them.
    """

    def __init__(self, make: Callable[[list[str]], Iterable[Sequence[int]]], most: int, longest: int):
        self.make, self.most, self.longest = make, most, longest
        self.high = self.low = np.zeros(0, np.uint64)
        self.starts, self.values = np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The values of all words one after another, and where each word's values start, the end included."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), np.uint64).reshape(-1, 2)
        at = np.searchsorted(self.high, hashes[:, 0])
        held = np.minimum(at, max(len(self.high) - 1, 0))
        known = (self.high[held] == hashes[:, 0]) & (self.low[held] == hashes[:, 1]) if len(self.high) else np.zeros(len(words), bool)
        new = np.flatnonzero(~known)
        made = list(self.make([words[i] for i in new.tolist()])) if len(new) else []
        lengths = np.zeros(len(words), np.int64)
        lengths[known] = np.diff(self.starts)[held[known]]
        lengths[new] = [len(m) for m in made]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        out = np.empty(ends[-1], np.uint32)
        out[ragged(ends[:-1][known], lengths[known])] = self.values[ragged(self.starts[held[known]], lengths[known])]
        flat = np.fromiter(itertools.chain.from_iterable(made), np.uint32, int(lengths[new].sum()))
        out[ragged(ends[new], lengths[new])] = flat
        short = np.fromiter((len(words[i]) <= self.longest for i in new.tolist()), bool, len(new))
        self._remember(hashes[new[short]], flat[ragged((np.cumsum(lengths[new]) - lengths[new])[short], lengths[new[short]])], lengths[new[short]])
        return out, ends

    def _remember(self, hashes: np.ndarray, values: np.ndarray, lengths: np.ndarray) -> None:
        room = max(self.most - len(self.high), 0)
        hashes, lengths = hashes[:room], lengths[:room]
        if not len(hashes):
            return
        starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths)])
        values = np.concatenate([self.values, values[:lengths.sum()]])
        high, low = np.concatenate([self.high, hashes[:, 0]]), np.concatenate([self.low, hashes[:, 1]])
        # Two words with the same first half are kept once: the other is made anew each time.
        high, order = np.unique(high, return_index=True)
        size = np.diff(starts)[order]
        self.high, self.low = high, low[order]
        self.values, self.starts = values[ragged(starts[order], size)], np.concatenate([[0], np.cumsum(size)])


def text_key(text: Column, names: tuple[str, str] = ("k1", "k2")) -> list[Column]:
    """128 bits of a text, as two columns."""
    return [F.xxhash64(text).alias(names[0]), F.xxhash64(F.lit("again"), text).alias(names[1])]
