"""Quality of texts by how well dictionaries of good and of bad text compress them.

Fitting takes a bounded sample of labelled documents, half for the dictionaries, half for
calibration. A text is cut into chunks, all of them compressed on their own with either
dictionary; what the bad dictionary needs more than the good one, per byte, is the
normalised difference. A logistic curve turns it into the probability of label 1.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zlib
from pyspark.sql import Column, DataFrame, functions as F, types as T

from logloom.llm.arrow_text import map_texts, quoted

#: Bytes compressed at once, of a dictionary, and chunks a document gives to it at most.
CHUNK, DICTIONARY, CHUNKS_KEPT, LEVEL = 512, 1 << 16, 8, 3
#: Bytes of neutral text that every document counts as having besides its own: short texts say little.
NEUTRAL = 64


def chunks(text: bytes) -> list[bytes]:
    return [text[i:i + CHUNK] for i in range(0, len(text), CHUNK)]


def train(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A dictionary of at most ``size`` bytes of the samples; too few for training are taken as they are."""
    import zstandard

    try:
        return zstandard.train_dictionary(size, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def compressor(dictionary: bytes):
    import zstandard

    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, write_content_size=False, write_dict_id=False).compress


@dataclass(frozen=True)
class Model:
    """``neutral`` is the difference of the middle document, ``slope`` and ``base`` the calibration."""

    good: bytes
    bad: bytes
    neutral: float
    slope: float
    base: float

    def differences(self):
        good, bad = (compressor(d) for d in (self.good, self.bad)) if self.good and self.bad else (None, None)

        def of(texts: list[bytes]) -> np.ndarray:
            out = np.full(len(texts), self.neutral)
            for i, text in enumerate(texts if good else []):
                gain = sum(len(bad(c)) - len(good(c)) for c in chunks(text))
                out[i] = (gain + NEUTRAL * self.neutral) / (len(text) + NEUTRAL)
            return out

        return of

    def scores(self, differences: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.base + self.slope * differences, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and base by Newton steps, with a little weight on a flat curve."""
    scale = float(x.std()) or 1.0
    a = np.stack([x / scale, np.ones(len(x))], 1)
    w = np.array([0.0, math.log((y.sum() + 1) / (len(y) - y.sum() + 1))])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) + np.array([1e-2, 0]) * w
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(hess, grad)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", usable: Column | None = None, per_label: int = 2000,
        chunks_kept: int = CHUNKS_KEPT, dictionary_bytes: int = DICTIONARY) -> Model:
    """Learn from at most ``per_label`` documents of each label, chosen by a hash of doc_id.

    Every other one of them goes to the dictionary of its label, with at most ``chunks_kept`` chunks of 512
    bytes, those of least crc32; a dictionary has at most ``dictionary_bytes``. The rest calibrates.

    ``usable`` says which rows of ``labels`` may be learned from. A document with both
    labels counts as 0; one with several rows gives its least text. With one label only, or
    none, every text gets the same score: the share of label 1, or 0.5.
    """
    marks = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    marks = (marks if usable is None else marks.where(usable)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r["quality"]: r["count"] for r in marks.groupBy("quality").count().collect()}
    chosen = [r for q in (0, 1) for r in marks.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label).collect()]
    if len({r["quality"] for r in chosen}) < 2:
        share = sum(r["quality"] for r in chosen) / len(chosen) if chosen else 0.5
        return Model(b"", b"", 0.0, 0.0, math.log((share + 1e-3) / (1 - share + 1e-3)))
    quality = {r["doc_id"]: r["quality"] for r in chosen}
    turn = {q: [r["doc_id"] for r in chosen if r["quality"] == q] for q in (0, 1)}
    first = {d for ids in turn.values() for d in ids[::2]}

    def sampled(ids: set) -> DataFrame:
        # The ids come to per_label rows a label at most.
        few = docs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(sorted(ids), pa.int64())}))
        found = docs.select(quoted("doc_id").cast("long").alias("doc_id"), quoted(text).cast("string").alias("text")).join(F.broadcast(few), "doc_id")
        return found.groupBy("doc_id").agg(F.min("text").alias("text"))

    def pick():
        def of(texts):
            out = []
            for t in texts.cast(pa.large_binary()).to_pylist():
                out.append(sorted((c for c in chunks(t) if len(c) >= 16), key=lambda c: (zlib.crc32(c), c))[:chunks_kept])
            return [pa.array(out, pa.list_(pa.binary()))]
        return of

    pieces = map_texts(sampled(first), pick, [T.StructField("pieces", T.ArrayType(T.BinaryType()))], keep=["doc_id"]).collect()
    pieces.sort(key=lambda r: r["doc_id"])
    dictionaries = [train([bytes(c) for r in pieces if quality[r["doc_id"]] == q for c in r["pieces"]], dictionary_bytes) for q in (1, 0)]
    rest = set(quality) - first if all(len(ids) > 1 for ids in turn.values()) else set(quality)
    plain = Model(*dictionaries, 0.0, 0.0, 0.0)

    def sizes():
        of = plain.differences()
        return lambda texts: [pa.array(np.stack([of(raw := texts.cast(pa.large_binary()).to_pylist())]).reshape(-1)), pa.array([len(t) for t in raw], pa.int64())]

    fields = [T.StructField("difference", T.DoubleType()), T.StructField("n", T.LongType())]
    rows = sorted(map_texts(sampled(rest), sizes, fields, keep=["doc_id"]).collect())
    if not all(dictionaries) or not rows:
        return Model(b"", b"", 0.0, 0.0, 0.0)
    raw, n, y = (np.array(c, float) for c in ([r["difference"] for r in rows], [r["n"] for r in rows], [quality[r["doc_id"]] for r in rows]))
    gain = raw * (n + NEUTRAL)
    neutral = float(np.median((gain / np.maximum(n, 1))[y == 1])) if (y == 1).any() else 0.0
    slope, base = logistic((gain + NEUTRAL * neutral) / (n + NEUTRAL), y)
    # The sample takes both labels alike; the score is about labels as they occur.
    drawn = math.log(max(y.sum(), 1) / max((1 - y).sum(), 1))
    return Model(*dictionaries, neutral, max(slope, 0.0), base - drawn + math.log(counts[1] / counts[0]))


def score(docs: DataFrame, model: Model, *, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score (0 to 1) of every whole text; null and empty texts get the neutral score.

    Only the text is looked at. A column with the new name gives way to it; repeated rows
    get equal scores; an empty table gives an empty table.
    """

    def setup():
        of = model.differences()
        return lambda texts: [pa.array(model.scores(of(texts.cast(pa.large_binary()).to_pylist())))]

    return map_texts(docs, setup, [T.StructField(name, T.DoubleType())], text=text)


def held_out() -> Column:
    """Rows that no model may learn from: crc32 of doc_id as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
