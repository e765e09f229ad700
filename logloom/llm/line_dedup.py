"""Lines that many documents share, dropped by probing a sharded minimal perfect hash.

1. Every text gives the 128-bit hashes of its distinct line keys; they are counted with
   partial sums, so a line of a third of all documents costs one row a task.
2. Keys of enough documents are dealt into shards of bounded size. Each shard becomes a
   minimal perfect hash (levels of bit arrays: a key stays at the first level where it is
   alone in its slot, its index is the number of set bits before it) with two compact
   arrays: 64-bit fingerprints and counts.
3. Documents probe: a task takes the hashes of a batch of lines, sorts them by shard and
   reads one shard after another from the shared folder. No line is shuffled or joined,
   no text leaves its task, and memory holds a few shards whatever their number.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from logloom.llm.arrow_text import explode_texts, map_texts, sums_by_row
from logloom.session import stage, staging_path

BLANK = b" \t\n\x0b\x0c\r"
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Keys of one shard on average: 3 MB of arrays.
SHARD_KEYS = 1 << 18
#: Shards that a task keeps.
SHARDS_KEPT = 16
#: Slots for a key at each level of the hash.
SLOTS = 2.0


def line_hashes(texts: pa.Array, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """128-bit hashes of the keys of all lines, whether each key is long enough, lines before each text."""
    digest, out, long_enough, before = xxhash.xxh3_128_digest, [], [], [0]
    for text in texts.cast(pa.large_binary()).to_pylist():
        for line in text.translate(LOWER).split(b"\n"):
            key = line.strip(BLANK)
            out.append(digest(key))
            long_enough.append(len(key) >= min_chars and (min_chars <= 1 or len(key.decode()) >= min_chars))
        before.append(len(out))
    return np.frombuffer(b"".join(out), np.uint64).reshape(-1, 2), np.array(long_enough, bool), np.array(before)


def line_counts(docs: DataFrame, *, text: str = "text", min_chars: int = 1) -> DataFrame:
    """``h1, h2, n_docs``: in how many rows each line key occurs."""

    def setup():
        def distinct(texts):
            hashes, usable, before = line_hashes(texts, min_chars)
            rows = np.repeat(np.arange(len(texts)), np.diff(before))[usable]
            hashes = hashes[usable]
            order = np.lexsort((hashes[:, 1], hashes[:, 0], rows))
            rows, hashes = rows[order], hashes[order]
            new = np.ones(len(rows), bool)
            new[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1]).any(axis=1)
            hashes = hashes[new].view(np.int64)
            return rows[new], [pa.array(hashes[:, 0]), pa.array(hashes[:, 1])]

        return distinct

    keys = explode_texts(docs, setup, [T.StructField("h1", T.LongType()), T.StructField("h2", T.LongType())], text=text, keep=[])
    return keys.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"))


def _mixed(keys: np.ndarray, level: int) -> np.ndarray:
    x = keys ^ np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys; a key outside them gets some index or -1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels  # packed bits
        ones = [np.unpackbits(bits, bitorder="little") for bits in levels]
        self.ranks, base = [], 0
        for bits in ones:
            self.ranks.append(base + np.concatenate([[0], np.cumsum(bits, dtype=np.int64)]))
            base += int(bits.sum())
        self.size = base

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels, level = [], 0
        while len(keys):
            slots = -(-int(len(keys) * SLOTS + 8) // 8) * 8
            at = _mixed(keys, level) % np.uint64(slots)
            alone = np.bincount(at.astype(np.int64), minlength=slots) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            keys, level = keys[~alone[at.astype(np.int64)]], level + 1
        return cls(levels)

    def index(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (bits, ranks) in enumerate(zip(self.levels, self.ranks)):
            at = (_mixed(keys[open_], level) % np.uint64(len(bits) * 8)).astype(np.int64)
            hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            out[open_[hit]] = ranks[at[hit]]
            open_ = open_[~hit]
        return out


SHARD_SCHEMA = "shard long, levels array<binary>, fingerprints binary, counts binary"


def build_index(counts: DataFrame, *, shard_keys: int = SHARD_KEYS) -> tuple[str, int]:
    """Write the index of ``h1, h2, n_docs``; gives its folder and the number of shards.

    h1 is hashed, h2 is the fingerprint. Keys with the same h1 share a slot: the index
    keeps the lowest such key only, the others count as not found (2^-64 a pair).
    """
    spark = counts.sparkSession
    counts = stage(counts, "line-counts")
    n_shards = max(1, -(-counts.count() // shard_keys))

    def shard(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["h1", "h2"]).drop_duplicates("h1")
        keys = pdf["h1"].to_numpy().view(np.uint64)
        hashed = PerfectHash.build(keys)
        at = hashed.index(keys)
        fingerprints, numbers = np.empty(len(keys), np.int64), np.empty(len(keys), np.uint32)
        fingerprints[at] = pdf["h2"].to_numpy()
        numbers[at] = np.minimum(pdf["n_docs"].to_numpy(), 0xFFFFFFFF)
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "levels": [[b.tobytes() for b in hashed.levels]],
                             "fingerprints": [fingerprints.tobytes()], "counts": [numbers.tobytes()]})

    path = staging_path(spark, "line-index")
    counts.withColumn("shard", F.pmod("h1", F.lit(n_shards)).cast("long")).groupBy("shard") \
        .applyInPandas(shard, SHARD_SCHEMA).withColumn("part", F.col("shard")).write.partitionBy("part").parquet(path)
    return path, n_shards


class ShardReader:
    """Shards from the shared folder, the last few kept. Any store that Arrow can open will do."""

    def __init__(self, path: str):
        self.fs, self.root = pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)
        self.kept: OrderedDict[int, tuple | None] = OrderedDict()

    def __getitem__(self, shard: int):
        if shard in self.kept:
            self.kept.move_to_end(shard)
            return self.kept[shard]
        found = [f.path for f in self.fs.get_file_info(pyarrow.fs.FileSelector(f"{self.root}/part={shard}", allow_not_found=True))
                 if f.path.endswith(".parquet")]
        rows = [r for f in found for r in pq.ParquetFile(self.fs.open_input_file(f)).read().to_pylist()]
        value = None
        if rows:
            hashed = PerfectHash([np.frombuffer(b, np.uint8) for b in rows[0]["levels"]])
            value = hashed, np.frombuffer(rows[0]["fingerprints"], np.int64), np.frombuffer(rows[0]["counts"], np.uint32)
        self.kept[shard] = value
        if len(self.kept) > SHARDS_KEPT:
            self.kept.popitem(last=False)
        return value


def prober(path: str, n_shards: int) -> Callable[[np.ndarray], np.ndarray]:
    """A function from 128-bit hashes to the count in the index, 0 where a key isn't in it."""
    reader = ShardReader(path)

    def probe(hashes: np.ndarray) -> np.ndarray:
        out = np.zeros(len(hashes), np.int64)
        shard = np.mod(hashes[:, 0].view(np.int64), n_shards) if len(hashes) else out
        order = np.argsort(shard, kind="stable")
        bounds = np.flatnonzero(np.diff(shard[order], prepend=-1, append=-1))
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            part = order[lo:hi]
            if (found := reader[int(shard[part[0]])]) is None:
                continue
            hashed, fingerprints, counts = found
            at = hashed.index(hashes[part, 0])
            same = (at >= 0) & (fingerprints[at] == hashes[part, 1].view(np.int64))
            out[part[same]] = counts[at[same]]
        return out

    return probe


def drop_shared_lines(docs: DataFrame, *, text: str = "text", min_docs: int = 10, min_chars: int = 1,
                      shard_keys: int = SHARD_KEYS, names: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with the lines of at least ``min_docs`` documents dropped, and ``n_lines, n_dropped`` (or the ``names`` given).

    A document is a row: repeated rows count each. A line's key is the line without blanks
    at its ends and with A-Z in lower case; keys under ``min_chars`` code points stay. A null
    or empty text is one empty line and comes back as the empty text. A text whose lines
    all go is empty. Columns with the new names give way to the new ones. An empty
    table gives an empty table.
    """
    counts = line_counts(docs, text=text, min_chars=min_chars).where(F.col("n_docs") >= min_docs)
    path, n_shards = build_index(counts, shard_keys=shard_keys)

    def setup():
        probe = prober(path, n_shards)

        def dropped(texts):
            hashes, usable, before = line_hashes(texts, min_chars)
            hit = usable & (probe(hashes) >= min_docs)
            out = texts.to_pylist()
            for row in np.unique(np.searchsorted(before, np.flatnonzero(hit), "right") - 1):
                mask = hit[before[row]:before[row + 1]]
                out[row] = "\n".join(line for line, gone in zip(out[row].split("\n"), mask) if not gone)
            return [pa.array(out, pa.string()), pa.array(np.diff(before)), pa.array(sums_by_row(hit.astype(np.int64), before))]

        return dropped

    fields = [T.StructField(text, T.StringType()), *[T.StructField(n, T.LongType()) for n in names]]
    made = map_texts(docs, setup, fields, text=text, most=8 << 20)
    return made
