"""Benchmark passages in documents, found in a latent space and proven by common subsequences.

1. Words are numbered by the benchmark's vocabulary; what follows needs no text. Passages
   are blocks of words; document frequencies are counted over all passages.
2. A randomised SVD of the TF-IDF matrix of all passages: one pass gives A'(A O) for random
   O, its orthonormal basis Q; a second gives (AQ)'(AQ), whose eigenvectors turn Q into the
   leading right singular vectors. Divided by their singular values they weigh topics and
   languages, which all passages share, no more than what tells items apart. Tasks sum their own part; the driver sees matrices of
   the size of the vocabulary, never of the corpus.
3. Windows of several lengths, for each item one hardly longer than it and one with room for
   words put in, slide over every document. Places where two neighbours that
   are rare in the corpus stand as in the item are candidates at any cosine: an item of two words or more that stands
   unchanged is never missed. Prefix sums of latent word vectors
   give each window's vector in one subtraction; windows whose cosine with an item of
   their length is high are candidates.
4. A candidate is a leak if the longest common subsequence with the item covers enough of
   it, or covers less of it but as much of its answer (its last sentence), too.

The benchmark is the query set: it is collected, and documents meet it in blocks.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from logloom.llm.arrow_text import map_in_arrow, map_texts, quoted, ragged, split_words
from logloom.session import stage

PASSAGE, RANK, OVERSAMPLE = 64, 64, 8
#: Pairs of neighbours by which an item is looked for besides its windows.
ANCHORS = 4
#: Word occurrences that a task holds as latent vectors at once: 4 MB, which stay in a core's cache.
HELD = 1 << 13
#: Entries of a dense block of the TF-IDF matrix: small enough for a core's cache, large enough for one matrix product.
ENTRIES = 1 << 10
EDGES = ".,;:!?\"'()[]{}<>*#$%&|"


def as_terms(words: pa.Array) -> pa.Array:
    """Words in lower case, punctuation at their ends off."""
    return pc.utf8_lower(pc.utf8_trim(words, EDGES))


def terms_of(text: str) -> list[str]:
    return [t for t in as_terms(pa.array(re.findall(r"[^\x20\x09-\x0D]+", text), pa.large_string())).to_pylist() if t]


@dataclass(frozen=True)
class Item:
    item_id: int | None
    terms: list[int]
    answer: list[int]
    nth: int


def items_of(rows: list[tuple[int | None, str | None]]) -> tuple[list[Item], dict[str, int]]:
    """Items with numbered terms, and the numbers; an item without terms can't leak."""
    vocabulary: dict[str, int] = {}
    items = []
    for item_id, text in rows:
        number = lambda t: [vocabulary.setdefault(x, len(vocabulary)) for x in terms_of(t)]
        terms = number(text or "")
        if terms:
            sentences = [s for s in re.split(r"(?<=[.?!])\s+|\n+", text) if terms_of(s)]
            answer = number(sentences[-1]) if len(sentences) > 1 else terms[-max(1, len(terms) // 4):]
            items.append(Item(item_id, terms, answer, len(items)))
    return items, vocabulary


def bits_of(terms: list[int]) -> dict[int, int]:
    """Where each term stands, a bit a position."""
    places: dict[int, int] = {}
    for i, t in enumerate(terms):
        places[t] = places.get(t, 0) | 1 << i
    return places


def common_length(of: list[int], among: list[int], places: dict[int, int] | None = None) -> int:
    """Length of the longest common subsequence."""
    places = bits_of(of) if places is None else places
    full = (1 << len(of)) - 1
    open_ = full
    for t in among:
        if (here := places.get(t)) is not None:
            met = open_ & here
            open_ = (open_ + met | open_ - met) & full
    return len(of) - open_.bit_count()


def _coded(docs: DataFrame, vocabulary: dict[str, int], text: str, keep: list[str]) -> DataFrame:
    """``keep``, n_words, and for each word of the vocabulary its number and the gap to the one before."""

    def setup():
        known = pa.array(list(vocabulary), pa.large_string())  # in order of their numbers

        def of(texts):
            words, before = split_words(texts)
            encoded = words.dictionary_encode()
            numbers = pc.index_in(as_terms(encoded.dictionary), known).fill_null(-1).to_numpy(zero_copy_only=False)
            term = numbers[encoded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.int32)
            at = np.flatnonzero(term >= 0)
            bounds = np.searchsorted(at, before).astype(np.int32)
            some = np.diff(bounds) > 0
            gap = np.diff(at, prepend=0)
            gap[bounds[:-1][some]] = at[bounds[:-1][some]] - before[:-1][some]
            lists = [pa.ListArray.from_arrays(pa.array(bounds), pa.array(x.astype(np.int32))) for x in (term[at], gap)]
            return [pa.array(np.diff(before)), *lists]

        return of

    fields = [T.StructField("n_words", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("gaps", T.ArrayType(T.IntegerType()))]
    return map_texts(docs.select(*map(quoted, keep), quoted(text)), setup, fields, text=text, keep=keep)


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    return lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)


def _pieces(batches, k: int, pad: int = 0):
    """Documents of up to ``HELD`` occurrences: batch slice, terms, places on one line, row starts on that line, bounds.

    Columns k, k+1, k+2 are n_words, terms, gaps. Documents stand one after another, ``pad`` places apart.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        terms, bounds = _flat(batch.column(k + 1))
        gaps, _ = _flat(batch.column(k + 2))
        room = -(-(batch.column(k).to_numpy(zero_copy_only=False) + pad) // PASSAGE) * PASSAGE
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + HELD, "right")) - 1)
            own, cut = slice(bounds[at], bounds[to]), bounds[at:to + 1] - bounds[at]
            start = np.concatenate([[0], np.cumsum(room[at:to])]).astype(np.int64)
            total = np.concatenate([[0], np.cumsum(gaps[own], dtype=np.int64)])
            yield batch.slice(at, to - at), terms[own], np.repeat(start[:-1] - total[cut[:-1]], np.diff(cut)) + total[1:], start, cut
            at = to


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and how often each occurs."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1))
    return keys[first], np.diff(first, append=len(keys))


def _passages(terms: np.ndarray, places: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """TF-IDF entries of unit passages: passage (numbered from 0), term, value."""
    keep = weights[terms] > 0
    key, count = _runs((places[keep] // PASSAGE) << 32 | terms[keep])
    passage, term = np.cumsum(np.diff(key >> 32, prepend=key[:1] >> 32) > 0), key & 0xFFFFFFFF
    value = count * weights[term]
    norm = np.sqrt(np.bincount(passage, value * value)) if len(passage) else np.zeros(0)
    return passage, term, value / norm[passage] if len(passage) else value


def _blocks(terms: np.ndarray, places: np.ndarray, weights: np.ndarray):
    """The TF-IDF matrix of unit passages in dense blocks of whole passages, with about ``ENTRIES`` entries each: its terms, the block."""
    passage, term, value = _passages(terms, places, weights)
    at = 0
    while at < len(passage):
        to = int(np.searchsorted(passage, passage[min(at + ENTRIES, len(passage)) - 1], "right"))
        own, column = np.unique(term[at:to], return_inverse=True)
        block = np.zeros((passage[to - 1] - passage[at] + 1, len(own)), np.float32)
        block[passage[at:to] - passage[at], column] = value[at:to]
        yield own, block
        at = to


def _summed(coded: DataFrame, part, size: int, width: int) -> np.ndarray:
    """The sum over all documents of a ``size`` x ``width`` matrix, to which ``part(total, terms, places)`` adds; rows are summed by Spark."""

    def run(batches):
        total = np.zeros((size, width))
        for _, terms, places, _, _ in _pieces(batches, 0):
            part(total, terms, places)
        rows = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(rows), pa.ListArray.from_arrays(
            pa.array((np.arange(len(rows) + 1) * width).astype(np.int32)), pa.array(total[rows].reshape(-1)))], names=["r", "x"])

    out = np.zeros((size, width))
    sums = map_in_arrow(coded.select("n_words", "terms", "gaps"), run, T.StructType([T.StructField("r", T.LongType()), T.StructField("x", T.ArrayType(T.DoubleType()))]))
    for row in sums.groupBy("r").agg(F.array(*[F.sum(F.get("x", F.lit(j))) for j in range(width)]).alias("x")).collect():
        out[row["r"]] = row["x"]
    return out


def frequencies(coded: DataFrame, size: int) -> tuple[np.ndarray, int]:
    """In how many passages each term occurs, and the number of passages that hold any."""

    def part(total, terms, places):
        key, _ = _runs((places // PASSAGE) << 32 | terms)
        total[:size, 0] += np.bincount(key & 0xFFFFFFFF, minlength=size)
        total[size, 0] += len(_runs(key >> 32)[0])

    found = _summed(coded, part, size + 1, 1)[:, 0]
    return found[:size], int(found[size])


def inverse_frequencies(items: list[Item], counts: np.ndarray, total: int, *, max_share: float = 0.05, least_terms: int = 5) -> np.ndarray:
    """IDF weights; terms of more than ``max_share`` of the passages weigh nothing, unless an item has hardly any other."""
    weights = np.log((total + 1) / (counts + 1)) + 1e-3
    common = counts > max_share * max(total, 1)
    for item in items:
        own = sorted(set(item.terms), key=lambda t: (counts[t], t))
        if sum(not common[t] for t in own) < least_terms:
            common[own[:least_terms]] = False
    return np.where(common, 0.0, weights)


def latent_vectors(coded: DataFrame, weights: np.ndarray, *, rank: int = RANK, oversample: int = OVERSAMPLE, seed: int = 7) -> np.ndarray:
    """Leading right singular vectors (terms x rank) of the TF-IDF matrix of all passages, each divided by its singular value."""
    size = len(weights)
    width = min(rank + oversample, size)
    single = np.float32  # inside a task; sums over tasks are doubles

    def sketch(total, terms, places):
        for own, block in _blocks(terms, places, weights):
            total[own] += block.T @ (block @ start[own])

    def gram(total, terms, places):
        for own, block in _blocks(terms, places, weights):
            rows = block @ leading[own]
            total += rows.T @ rows

    start = np.random.default_rng(seed).standard_normal((size, width)).astype(single)
    basis = np.linalg.qr(_summed(coded, sketch, size, width))[0]
    leading = basis.astype(single)
    values, turn = np.linalg.eigh(_summed(coded, gram, width, width))
    kept = [j for j in np.argsort(-values)[:rank] if values[j] > 1e-6 * values.max()]
    return basis @ turn[:, kept] / np.sqrt(values[kept])


def running_sums(rows: np.ndarray) -> np.ndarray:
    """Sums of the first 0, 1, 2, ... rows, added as they are given and returned in single precision."""
    n, width = rows.shape
    # All groups of 32 rows advance at once: a running sum over a long axis goes entry by entry.
    groups = np.zeros((n // 32 + 1, 32, width), rows.dtype)
    flat = groups.reshape(32 * len(groups), width)
    flat[1:n + 1] = rows
    for j in range(1, 32):
        groups[:, j] += groups[:, j - 1]
    groups[1:] += np.cumsum(groups[:-1, -1], axis=0)[:, None]
    return flat[:n + 1].astype(np.float32)


def _scale(n: int) -> int:
    """Words of the window for an item of ``n`` words: a power of two."""
    s = 8
    while s < n:
        s *= 2
    return s


def _scales(n: int) -> set[int]:
    """The windows for an item of ``n`` words: the power of two, and the least of 5, 6 and 7 eighths of it that holds the item."""
    s = _scale(n)
    return {s, next((s * k // 8 for k in (5, 6, 7) if s * k // 8 >= n), s)} if s > 8 else {s}


def anchors_of(items: list[Item], counts: np.ndarray) -> list[tuple[int, int, int]]:
    """(key of two neighbours, item, place of the first in it), sorted: the pairs of each item whose rarer term is in the fewest passages."""
    out = []
    for i in items:
        pairs = sorted(range(len(i.terms) - 1), key=lambda j: (min(counts[i.terms[j]], counts[i.terms[j + 1]]), j))
        out += [(i.terms[j] << 32 | i.terms[j + 1], i.nth, j) for j in pairs[:ANCHORS]]
    return sorted(out)


def leaks(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item: str = "item_id", item_text: str = "text",
          least_cosine: float = 0.45, least_common: float = 0.7, least_with_answer: float = 0.6, rank: int = RANK) -> DataFrame:
    """``keep``, item_id, first_word, last_word, cosine, common, answer: a row for each document and item found in it.

    ``common`` is the share of the item's words (lower case, punctuation at the ends off) in
    the longest common subsequence with the place found, ``answer`` the same of its last
    sentence. A place is a leak from ``least_common`` on, or from ``least_with_answer`` of both. Null or empty
    texts and items match nothing; repeated rows and items each count; other columns are
    not looked at; an empty table gives an empty result. The window's words are numbered from 0.
    """
    rows = [tuple(r) for r in benchmark.select(quoted(item).cast("long"), quoted(item_text).cast("string")).collect()]
    items, vocabulary = items_of(sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")))
    names = [f for f in docs.schema.fields if f.name in keep]
    schema = T.StructType([*names, *[T.StructField(n, k) for n, k in (
        ("item_id", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()), ("cosine", T.DoubleType()), ("common", T.DoubleType()),
        ("answer", T.DoubleType()))]])
    if not items:
        return docs.sparkSession.createDataFrame(pa.table({f.name: pa.array([], pa.null()) for f in schema}), schema)
    coded = stage(_coded(docs, vocabulary, text, list(keep)), "coded", compression="zstd")
    counts, total = frequencies(coded, len(vocabulary))
    weights = inverse_frequencies(items, counts, total)
    vectors = latent_vectors(coded, weights, rank=rank) * weights[:, None]
    scales = sorted(set().union(*(_scales(len(i.terms)) for i in items)))
    of_scale = {s: [i for i in items if s in _scales(len(i.terms))] for s in scales}

    def unit(rows):
        rows = rows.astype(np.float32)
        return rows / np.maximum(np.sqrt(np.einsum("ij,ij->i", rows, rows)), 1e-12)[:, None]

    def in_eights(rows):
        return np.concatenate([rows, np.zeros((-len(rows) % 8, rows.shape[1]), rows.dtype)])

    # Columns of zeros fill each matrix up to a multiple of eight.
    wanted = {s: in_eights(unit(np.stack([vectors[i.terms].sum(axis=0) for i in group]))) for s, group in of_scale.items()}
    k = len(names)

    anchors = anchors_of(items, counts)
    anchor_keys, anchor_item, anchor_place = (np.array([x[j] for x in anchors], np.int64) for j in range(3))
    alone = unit(np.stack([vectors[i.terms].sum(axis=0) for i in items]))
    narrow = np.array([min(_scales(len(i.terms))) for i in items], np.int64)
    starts_anchor = np.zeros(len(vocabulary), bool)
    starts_anchor[anchor_keys >> 32] = True
    reach = np.zeros(scales[-1] + 1, np.int64)
    reach[scales] = [_scale(s) for s in scales]
    nths = {s: np.array([i.nth for i in group], np.int64) for s, group in of_scale.items()}
    bits = {i.nth: (bits_of(i.terms), bits_of(i.answer)) for i in items}
    # Words in common that a place needs at least, and how often a word stands in an item, by hash of the pair: perhaps too many, never too few.
    needed = np.array([np.ceil(least_with_answer * len(i.terms) - 1e-9) for i in items], np.int64)
    pairs, often = np.unique(np.concatenate([i.nth * len(vocabulary) + np.array(i.terms, np.int64) for i in items]), return_counts=True)
    slots = np.int64((1 << max(10, int(16 * len(pairs)).bit_length())) - 1)
    slot_of = lambda pair: (pair * np.int64(0x9E3779B1) >> np.int64(7)) & slots
    times = np.zeros(slots + 1, np.int32)
    np.maximum.at(times, slot_of(pairs), often)
    stands_in = times > 0

    def around(upto, place, s, row, cut):
        """The occurrences in a power of two of places on either side of a window's middle, inside the document."""
        lo, hi = (upto[np.clip(place + s // 2 + side * reach[s], 0, len(upto) - 1)] for side in (-1, 1))
        return np.maximum(lo, cut[row]), np.minimum(hi, cut[row + 1])

    def cells(close):
        """Rows and columns of what is true in a matrix whose width divides by eight, which is looked through by eights."""
        eights = np.flatnonzero(close.view(np.uint64))
        inner = np.flatnonzero(close.reshape(-1, 8)[eights])
        return np.divmod(eights[inner >> 3] * 8 + (inner & 7), close.shape[1])

    def candidates(terms, places, start, cut):
        """Arrays (row, place, scale, item, cosine) of windows close to an item, or where an anchor of it stands."""
        end = int(start[-1])
        held = weights[terms] > 0
        at, sums = places[held], running_sums(vectors.take(terms[held], axis=0))
        x = np.flatnonzero(starts_anchor[terms[:-1]])
        pair = terms[x].astype(np.int64) << 32 | terms[x + 1]
        first, last = np.searchsorted(anchor_keys, pair), np.searchsorted(anchor_keys, pair, "right")
        row = np.searchsorted(cut, x, "right") - 1
        one = np.flatnonzero((last > first) & (x + 1 < cut[row + 1]))
        count = last[one] - first[one]
        hit = ragged(first[one], count)
        x, row, nth = np.repeat(x[one], count), np.repeat(row[one], count), anchor_item[hit]
        place = np.maximum(places[x] - anchor_place[hit], start[row])
        lo, hi = np.searchsorted(at, place), np.searchsorted(at, place + narrow[nth])
        yield row, place, narrow[nth], nth, np.einsum("ij,ij->i", unit(sums[hi] - sums[lo]), alone[nth])
        upto = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=end + scales[-1]))]).astype(np.int32)
        for s in scales:
            for block in range(0, end, (s // 4) << 15):
                stop = min(end, block + ((s // 4) << 15))
                lo, hi = upto[block:stop:s // 4], upto[block + s:stop + s:s // 4]
                some = np.flatnonzero(hi > lo)
                own = sums.take(hi[some], axis=0)
                own -= sums.take(lo[some], axis=0)
                length = np.sqrt(np.einsum("ij,ij->i", own, own))
                product = own @ wanted[s].T
                close = product >= least_cosine * np.maximum(length, 1e-12)[:, None]
                close[:, len(nths[s]):] = False
                w, i = cells(close)
                place = block + some[w] * (s // 4)
                yield np.searchsorted(start, place, "right") - 1, place, np.full(len(w), s), nths[s][i], product[w, i] / length[w]

    def gathered(found):
        """Candidates of several scales together, 2^16 or more at a time."""
        held, size = [], 0
        for x in found:
            held.append(x)
            size += len(x[0])
            if size >> 16:
                yield [np.concatenate(c) for c in zip(*held)]
                held, size = [], 0
        if held:
            yield [np.concatenate(c) for c in zip(*held)]

    def possible(terms, upto, cut, found):
        """Candidates with enough words of their item around them: (row, place, scale, item, cosine, occurrences)."""
        row, place, s, nth, cosine = found
        a, b = around(upto, place, s, row, cut)
        order = np.flatnonzero(b - a >= needed[nth])
        order = order[np.lexsort((a[order], nth[order]))]
        row, place, s, nth, cosine, a, b = (x[order] for x in (row, place, s, nth, cosine, a, b))
        # 2^20 occurrences at a time.
        bounds = np.searchsorted(np.cumsum(b - a) >> 20, np.arange(int((b - a).sum() >> 20) + 2))
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            if lo == hi:
                continue
            # Candidates of one item that overlap are looked up once, as one stretch.
            line = nth[lo:hi] * (len(terms) + 1)
            ends = np.maximum.accumulate(line + b[lo:hi])
            new = np.append(True, line[1:] + a[lo + 1:hi] > ends[:-1])
            begin, item = a[lo:hi][new], nth[lo:hi][new]
            size = ends[np.append(np.flatnonzero(new)[1:], hi - lo) - 1] - line[new] - begin
            term = terms[ragged(begin, size)]
            own = stands_in[slot_of(np.repeat(item * len(vocabulary), size) + term)]
            shift = (np.cumsum(size) - size - begin)[np.cumsum(new) - 1]
            before = np.concatenate([[0], np.cumsum(own)])
            x, y = before[a[lo:hi] + shift], before[b[lo:hi] + shift]
            enough = np.flatnonzero(y - x >= needed[nth[lo:hi]])
            # Each word of the item counts as often as the item has it, however often it stands here.
            of = np.repeat(np.arange(len(enough)), (y - x)[enough])
            key, _ = _runs(of * len(vocabulary) + term[own][ragged(x[enough], (y - x)[enough])])
            of, term = key // len(vocabulary), key % len(vocabulary)
            part = lo + enough
            part = part[np.bincount(of, times[slot_of(nth[part][of] * len(vocabulary) + term)], minlength=len(part)) >= needed[nth[part]]]
            yield from zip(*(x[part].tolist() for x in (row, place, s, nth, cosine, a, b)))

    def run(batches):
        # A document's places are followed by more room than the longest window, so no window meets two.
        for part, terms, places, start, cut in _pieces(batches, k, 2 * scales[-1]):
            best: dict[tuple[int, int], tuple] = {}
            listed = terms.tolist()
            upto = np.concatenate([[0], np.cumsum(np.bincount(places))])  # occurrences before each place
            passing = (c for found in gathered(candidates(terms, places, start, cut)) for c in possible(terms, upto, cut, found))
            for row, place, s, nth, cosine, lo, hi in passing:
                found, near, (own, own_answer) = items[nth], listed[lo:hi], bits[nth]
                common = common_length(found.terms, near, own) / len(found.terms)
                if common < least_with_answer:
                    continue
                answer = common_length(found.answer, near, own_answer) / len(found.answer)
                if common >= least_common or answer >= least_with_answer:
                    at = int(place - start[row])
                    value = (common, cosine, -at, (found.item_id, at, min(at + s, int(part.column(k)[row].as_py())), cosine, common, answer))
                    best[row, found.nth] = max(best.get((row, found.nth), value), value, key=lambda v: v[:3])
            rows = pa.array([row for row, _ in best], pa.int64())
            made = [v[3] for v in best.values()]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(j).take(rows) for j in range(k)], *[pa.array([m[j] for m in made], kind) for j, kind in enumerate(
                    [pa.int64()] * 3 + [pa.float64()] * 3)]], names=schema.names)

    return map_in_arrow(coded.select(*[quoted(f.name) for f in names], "n_words", "terms", "gaps"), run, schema)
