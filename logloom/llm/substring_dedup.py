"""Word windows that occur more than once, removed wherever they occur.

The windows of all texts are sorted in groups, as no order of all of them fits anywhere. No
suffix tree is built; the README names this as a departure.

1. A window of ``window`` words has a least k-gram (by hash). Equal windows have the same
   one, so only windows whose least k-gram occurs elsewhere as a least k-gram can repeat.
   Neighbouring windows with the same least k-gram form one run.
2. Runs are grouped by that k-gram. Groups are dealt into parts that fit in memory; a group too
   large for one part has its windows counted by a hash of all their words.
3. A part ranks its suffixes by doubling prefixes: ranks of 1, 2, 4, ... words, up to
   ``window``. Suffixes with the same rank there start equal windows.

Equal runs are summed before the shuffle, so copies of a text cost one run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from logloom.llm.arrow_text import (
    distinct_words, explode_texts, free_name, joined_words, map_texts, quoted, ragged, split_words, sums_by_row, text_key, word_hashes)
from logloom.session import stage

#: Runs of one part on average, and of a group that is split further.
PART_RUNS, GROUP_RUNS = 1 << 13, 1 << 12


def gram_size(window: int) -> int:
    return max(1, window // 4)


def _least(values: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of every ``span`` neighbours and its leftmost place."""
    least, place, size = values, np.arange(len(values)), 1

    def joined(least, place, step):
        a, b = least[:-step], least[step:]
        right = b < a
        return np.where(right, b, a), np.where(right, place[step:], place[:-step])

    while size * 2 <= span:
        least, place = joined(least, place, size)
        size *= 2
    return joined(least, place, span - size) if span > size else (least, place)


def runs_of(hashes: np.ndarray, before: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with the same least k-gram: row, first window in its text, number of windows, k-gram, its places."""
    none = np.zeros(0, np.int64)
    if len(hashes) < window:
        return none, none, none, none.astype(np.uint64), none
    k = gram_size(window)
    grams = np.zeros(len(hashes) - k + 1, np.uint64)
    for j in range(k):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + hashes[j:len(hashes) - k + 1 + j]
    grams = (grams ^ (grams >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    grams ^= grams >> np.uint64(32)
    least, place = _least(grams, window - k + 1)
    starts = ragged(before[:-1], np.maximum(np.diff(before) - window + 1, 0))
    if not len(starts):
        return none, none, none, none.astype(np.uint64), none
    rows = np.searchsorted(before, starts, "right") - 1
    least, place = least[starts], place[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (least[1:] != least[:-1]) | (rows[1:] != rows[:-1])
    first = np.flatnonzero(new)
    moved = new.copy()
    moved[1:] |= place[1:] != place[:-1]
    counts = np.diff(np.append(first, len(starts)))
    places = np.add.reduceat(moved.astype(np.int64), first)
    return rows[first], starts[first] - before[rows[first]], counts, least[first], places


def repeated_starts(codes: np.ndarray, before: np.ndarray, weights: np.ndarray, window: int) -> np.ndarray:
    """For every word of the runs: does it start a window that is found twice?

    ``codes`` numbers the words, ``before`` bounds the runs, ``weights`` says how often a run occurs.
    """
    out = np.zeros(len(codes), bool)
    starts = ragged(before[:-1], np.maximum(np.diff(before) - window + 1, 0))
    if not len(starts):
        return out
    rank, size = codes.astype(np.int64), 1

    def paired(rank, a, b):
        return np.unique(rank[a] * (int(rank.max()) + 1) + rank[b], return_inverse=True)[1].reshape(-1)

    while size * 2 <= window:
        to = np.arange(len(rank) - size)
        rank, size = paired(rank, to, to + size), size * 2
    node = paired(rank, starts, starts + window - size)
    run = np.searchsorted(before, starts, "right") - 1
    out[starts[np.bincount(node, weights[run])[node] >= 2]] = True
    return out


def _ranges(flags: np.ndarray, before: np.ndarray) -> pa.Array:
    """Set flags of each row as [first, end) pairs, one list a row."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    cut = before[1:-1]
    lo, hi = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # A run of flags may go on into the next row.
    inside = cut[(cut > 0) & (cut < len(flags))]
    inside = inside[flags[inside - 1] & flags[inside]] if len(inside) else inside
    lo, hi = np.sort(np.concatenate([lo, inside])), np.sort(np.concatenate([hi, inside]))
    row = np.searchsorted(before, lo, "right") - 1
    values = np.stack([lo - before[row], hi - before[row]], 1).reshape(-1).astype(np.int32)
    counts = np.bincount(row, minlength=len(before) - 1) * 2
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(values))


RANGES = T.StructField("ranges", T.ArrayType(T.IntegerType()))


def _part_repeats(runs: DataFrame, window: int, parts: int) -> DataFrame:
    """``gram, run_key, ranges`` of the runs of each part: its windows ranked together."""

    def ranked(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        words, before = split_words(table.column("run").combine_chunks().cast(pa.large_string()) if table.num_rows else pa.array([], pa.large_string()))
        _, codes = distinct_words(words)
        flags = repeated_starts(codes, before, table.column("n").to_numpy().astype(np.float64), window)
        out = pa.table({"gram": table.column("gram"), "run_key": table.column("run_key"), "ranges": _ranges(flags, before)})
        return out.filter(pa.array(sums_by_row(flags.astype(np.int64), before) > 0))

    part = F.pmod(F.xxhash64("gram"), F.lit(parts))
    return runs.groupBy(part.alias("part")).applyInArrow(ranked, "gram long, run_key long, ranges array<int>")


def _window_repeats(runs: DataFrame, window: int) -> DataFrame:
    """The same for groups that are too large: their windows are counted by all their words."""

    def setup():
        def of(texts, n):
            words, before = split_words(texts)
            hashes = word_hashes(words)
            count = np.maximum(np.diff(before) - window + 1, 0)
            starts = ragged(before[:-1], count)
            keys = []
            for multiplier in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93):
                key = np.zeros(len(starts), np.uint64)
                for j in range(window):
                    key = key * np.uint64(multiplier) + hashes[starts + j]
                keys.append(pa.array(key.view(np.int64)))
            rows = np.repeat(np.arange(len(texts)), count)
            return rows, [*keys, pa.array((starts - before[rows]).astype(np.int32)), n.take(pa.array(rows))]

        return of

    fields = [T.StructField("w1", T.LongType()), T.StructField("w2", T.LongType()), T.StructField("at", T.IntegerType()), T.StructField("times", T.LongType())]
    windows = stage(explode_texts(runs, setup, fields, text="run", keep=["gram", "run_key"], extra=["n"]), "windows")
    twice = windows.groupBy("w1", "w2").agg(F.sum("times").alias("all")).where(F.col("all") >= 2).select("w1", "w2")
    # A run has few windows, unless it is one long repetition inside one text.
    return windows.join(twice, ["w1", "w2"]).groupBy("gram", "run_key").agg(F.sort_array(F.collect_set("at")).alias("ats")).select(
        "gram", "run_key", F.flatten(F.transform("ats", lambda a: F.array(a, a + 1))).alias("ranges"))


def repeats(docs: DataFrame, *, text: str = "text", window: int = 35, part_runs: int = PART_RUNS, group_runs: int = GROUP_RUNS) -> DataFrame:
    """``k1, k2, found``: for every text with repeats (by its key) the repeated windows, as a set of (first window of a run, ranges in it)."""
    keyed = docs.select(quoted(text).cast("string").alias("text"), *text_key(quoted(text).cast("string")))

    def least_grams():
        def of(texts):
            words, before = split_words(texts)
            rows, first, _, gram, places = runs_of(word_hashes(words), before, window)
            return rows, [pa.array(first.astype(np.int32)), pa.array(gram.view(np.int64)), pa.array(places)]

        return of

    fields = [T.StructField("first", T.IntegerType()), T.StructField("gram", T.LongType()), T.StructField("places", T.LongType())]
    anchors = stage(explode_texts(keyed, least_grams, fields, keep=["k1", "k2"]), "least-grams")
    shared = anchors.groupBy("gram").agg(F.sum("places").alias("all")).where(F.col("all") >= 2).select("gram")
    # Copies of a text give the same rows: one set a text.
    hits = anchors.join(shared, "gram").groupBy("k1", "k2").agg(F.collect_set("first").alias("firsts"))

    def run_texts():
        def of(texts, firsts):
            words, before = split_words(texts)
            rows, first, counts, gram, _ = runs_of(word_hashes(words), before, window)
            # Which of a text's runs were found to share their k-gram: rank both by (row, first).
            values = firsts.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            of_row = np.repeat(np.arange(len(texts)), firsts.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            keep = np.isin(rows << 32 | first, of_row << 32 | values)
            rows, first, counts, gram = rows[keep], first[keep], counts[keep], gram[keep]
            at, length = before[rows] + first, counts + window - 1
            taken = words.take(pa.array(ragged(at, length)))
            ends = np.concatenate([[0], np.cumsum(length)])
            return rows, [pa.array(first.astype(np.int32)), pa.array(gram.view(np.int64)), joined_words(taken, ends)]

        return of

    fields = [T.StructField("first", T.IntegerType()), T.StructField("gram", T.LongType()), T.StructField("run", T.StringType())]
    found = explode_texts(keyed.join(hits, ["k1", "k2"]), run_texts, fields, keep=["k1", "k2"], extra=["firsts"])
    found = stage(found.withColumn("run_key", F.xxhash64("run")), "runs", compression="zstd")
    runs = stage(found.groupBy("gram", "run_key", "run").agg(F.count(F.lit(1)).alias("n")), "distinct-runs", compression="zstd")
    large = stage(runs.groupBy("gram").agg(F.count(F.lit(1)).alias("runs")).where(F.col("runs") > group_runs).select("gram"), "large-grams")
    parts = max(1, -(-runs.count() // part_runs))
    repeated = _part_repeats(runs.join(large, "gram", "left_anti"), window, parts)
    if not large.isEmpty():
        repeated = repeated.unionByName(_window_repeats(runs.join(large, "gram", "left_semi"), window))
    members = found.select("k1", "k2", "first", "gram", "run_key")
    return members.join(stage(repeated, "repeats"), ["gram", "run_key"]).groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "ranges")).alias("found"))


def drop_repeats(docs: DataFrame, *, text: str = "text", window: int = 35, **sizes) -> DataFrame:
    """``docs`` without the words of windows that occur twice anywhere; and ``n_words, n_removed``.

    Words are ``[^\\x20\\x09-\\x0D]+``, unchanged; those kept come back joined by one space.
    Windows are judged on the input: all their occurrences go, the first one too. Repeated rows are repeats of each
    other. A null, empty or short text has no windows and keeps its words; a text that goes
    whole is empty. Columns named n_words or n_removed give way; an empty table gives an
    empty table.
    """
    found = repeats(docs, text=text, window=window, **sizes)
    k1, k2, at = (free_name(c, docs.columns) for c in ("text_key", "text_key_again", "repeats_found"))
    keyed = docs.select(*map(quoted, docs.columns), *text_key(quoted(text).cast("string"), (k1, k2)))
    keyed = keyed.join(found.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("found").alias(at)), [k1, k2], "left")

    def setup():
        def of(texts, found):
            words, before = split_words(texts)
            gone = np.zeros(len(words), bool)
            for row in np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False)):
                steps = np.zeros(before[row + 1] - before[row] + 1, np.int64)
                for run in found[int(row)].as_py():
                    ranges = run["ranges"]
                    for lo, hi in zip(ranges[::2], ranges[1::2]):
                        steps[run["first"] + lo] += 1
                        steps[run["first"] + hi - 1 + window] -= 1
                gone[before[row]:before[row + 1]] = np.cumsum(steps)[:-1] > 0
            kept = np.flatnonzero(~gone)
            text_kept = joined_words(words.take(pa.array(kept)), np.searchsorted(kept, before))
            return [text_kept, pa.array(np.diff(before)), pa.array(sums_by_row(gone.astype(np.int64), before))]

        return of

    fields = [T.StructField(text, T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())]
    return map_texts(keyed, setup, fields, text=text, keep=docs.columns, extra=[at])
