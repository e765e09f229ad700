"""Documents whose word 5-grams overlap: a MinHash LSH forest proposes, exact counting decides.

1. Equal shingle sets are one set: copies cost nothing further.
2. A set's signature has ``trees`` x ``depth`` minima. In each tree the first k minima are
   hashed, and sets with the same hash meet: prefixes of one length for all sets, shortened
   from ``depth`` by the formula 1 - (1 - s^k)^trees until sets at the threshold meet in
   some tree with the target recall. No tries are stored or walked, and the length doesn't
   follow from what was found: the README names this as a departure from an LSH forest.
3. In each node sets are joined by the similarity that whole signatures estimate, with a
   margin of several standard errors below the threshold, and only edges that connect
   something are kept: as many as sets, not pairs. A node of many sets is worked in
   blocks that share its first set; what isn't close to that set meets every block.
4. Sets that hang together are compared exactly, block against block, by counting common
   shingles: links, and classes of sets linked to each other.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from logloom.llm.arrow_text import free_name, map_in_arrow, map_texts, quoted, ragged, split_words, text_key, whole_groups, word_hashes
from logloom.llm.components import components
from logloom.session import stage

SHINGLE, TREES, DEPTH = 5, 16, 8
#: Sets of one block inside a node, and of one block in exact comparison.
NODE_BLOCK, EXACT_BLOCK = 4096, 1024
#: Standard errors by which an estimate may miss.
MARGIN = 5.0


def shingles(hashes: np.ndarray, before: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of every text, sorted, one text after another, and shingles before each text.

    A text of fewer words is one shingle; a text without words has none.
    """
    n = np.diff(before)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    starts, rows = ragged(before[:-1], count), np.repeat(np.arange(len(n)), count)
    last = before[1:][rows]
    out = np.full(len(starts), size, np.uint64)
    for j in range(size):
        at = starts + j
        word = np.where(at < last, hashes[np.minimum(at, max(len(hashes) - 1, 0))] if len(hashes) else 0, np.uint64(0))
        out = (out ^ (out >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + word
    out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(27)
    order = np.lexsort((out, rows))
    out, rows = out[order], rows[order]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:] != out[:-1]) | (rows[1:] != rows[:-1])
    return out[new], np.concatenate([[0], np.cumsum(np.bincount(rows[new], minlength=len(n)))]).astype(np.int64)


def signatures(values: np.ndarray, before: np.ndarray, count: int) -> np.ndarray:
    """``count`` minima (16 bits of each) of every set; empty sets have zeros."""
    out = np.zeros((len(before) - 1, count), np.uint16)
    full = np.flatnonzero(np.diff(before) > 0)
    if len(full):
        draw = np.random.default_rng(5)
        factors = draw.integers(1, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        at = before[:-1][full]
        for k in range(count):
            mixed = values * factors[k]
            mixed ^= mixed >> np.uint64(32)
            mixed *= np.uint64(0xD6E8FEB86659FD93)
            least = np.minimum.reduceat(mixed, at)
            out[full, k] = (least ^ (least >> np.uint64(29))) & np.uint64(0xFFFF)
    return out


def prefix_length(threshold: float, target_recall: float, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix, the same for all sets, with which a pair at the threshold meets in some tree with the target recall."""
    k = depth
    while k > 1 and 1 - (1 - threshold ** k) ** trees < target_recall:
        k -= 1
    return k


def _members(docs: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep``, the text's key, ``set_id`` and the signature of every row."""

    def setup():
        def of(texts):
            words, before = split_words(texts)
            values, bounds = shingles(word_hashes(words), before)
            raw, digest = values.tobytes(), xxhash.xxh3_64_intdigest
            ids = np.array([digest(raw[a * 8:b * 8]) for a, b in zip(bounds[:-1], bounds[1:])], np.uint64)
            signed = signatures(values, bounds, TREES * DEPTH)
            return [pa.array(ids.view(np.int64)), pa.array([s.tobytes() for s in signed], pa.binary()), pa.array(np.diff(bounds))]

        return of

    fields = [T.StructField("set_id", T.LongType()), T.StructField("signature", T.BinaryType()), T.StructField("n_shingles", T.LongType())]
    whole = free_name("whole_text", keep)
    keyed = docs.select(*map(quoted, keep), quoted(text).cast("string").alias(whole), *text_key(F.coalesce(quoted(text).cast("string"), F.lit(""))))
    return map_texts(keyed, setup, fields, text=whole, keep=[*keep, "k1", "k2"])


def _tree_nodes(sets: DataFrame, k: int) -> DataFrame:
    """``tree, node, set_id``: the hash of the first ``k`` minima of every set in every tree."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            signed = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, TREES, DEPTH)
            node = np.zeros(signed.shape[:2], np.uint64)
            for level in range(k):
                node = (node ^ (node >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + signed[:, :, level]
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(ids))), pa.array(node.reshape(-1).view(np.int64)), pa.array(np.repeat(ids, TREES))],
                names=["tree", "node", "set_id"])

    return map_in_arrow(sets.select("set_id", "signature"), run, "tree int, node long, set_id long")


class Forest:
    """Union by least index, for one block."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = i = self.parent[self.parent[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = sorted((self.find(i), self.find(j)))
        self.parent[j] = i
        return i != j


def _signed(pdf: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(pdf["signature"]), np.uint16).reshape(len(pdf), -1)


def _close(signed: np.ndarray, one: np.ndarray, least: float) -> np.ndarray:
    return (signed == one).mean(axis=1) >= least


EDGE = "u long, v long, tree int, node long"


def _edges(nodes: DataFrame, sets: DataFrame, least: float, node_block: int) -> DataFrame:
    """``u, v``: sets of a node whose signatures agree enough, connecting edges only."""
    held = nodes.groupBy("tree", "node").agg(F.count(F.lit(1)).alias("sets"), F.min("set_id").alias("hub")).where(F.col("sets") > 1)
    inside = nodes.join(held, ["tree", "node"]).withColumn("blocks", F.ceil(F.col("sets") / node_block).cast("int"))
    inside = inside.withColumn("block", F.pmod(F.xxhash64("set_id", "tree"), F.col("blocks")).cast("int"))
    # The first set of a node goes to each of its blocks.
    inside = inside.withColumn("block", F.when(F.col("set_id") == F.col("hub"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block")))
    inside = inside.select("tree", "node", "set_id", "hub", "blocks", F.explode("block").alias("block")).join(sets.select("set_id", "signature"), "set_id")
    inside = stage(inside, "node-sets", compression="zstd")

    def connect(batches):
        for table in whole_groups(batches, 3):
            tree, node, block, ids, many = (table.column(j).to_numpy() for j in range(5))
            signed = np.frombuffer(b"".join(table.column(5).to_pylist()), np.uint16).reshape(len(ids), -1)
            first = np.flatnonzero(np.concatenate([[True], (tree[1:] != tree[:-1]) | (node[1:] != node[:-1]) | (block[1:] != block[:-1])]))
            hub = np.repeat(first, np.diff(np.append(first, len(ids))))  # the least set stands first
            near = np.concatenate([(signed[at:at + 8192] == signed[hub[at:at + 8192]]).mean(axis=1) >= least for at in range(0, len(ids), 8192)])
            joined = near & (hub != np.arange(len(ids)))
            u, v = [ids[hub[joined]]], [ids[joined]]
            # Sets apart from the first one meet all sets of their block.
            apart = np.flatnonzero(~near)
            for start in np.unique(hub[apart]):
                end = int(np.searchsorted(hub, start, "right"))
                forest = Forest(end - start)
                for i in np.flatnonzero(near[start:end]):
                    forest.join(0, int(i))
                for r in apart[(apart >= start) & (apart < end)] - start:
                    for i in np.flatnonzero(_close(signed[start:end], signed[start + r], least)):
                        if forest.join(int(r), int(i)):
                            u.append(ids[start + min(r, i)][None])
                            v.append(ids[start + max(r, i)][None])
            u, v, left = np.concatenate(u), np.concatenate(v), apart[many[apart] > 1]
            none = pa.nulls(len(u), pa.int64())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([u, ids[left]])), pa.concat_arrays([pa.array(v), pa.nulls(len(left), pa.int64())]),
                pa.concat_arrays([pa.nulls(len(u), pa.int32()), pa.array(tree[left], pa.int32())]), pa.concat_arrays([none, pa.array(node[left])])],
                names=["u", "v", "tree", "node"])

    keys = ("tree", "node", "block")
    dealt = inside.select(*keys, "set_id", "blocks", "signature").repartition(*keys).sortWithinPartitions(*keys, "set_id")
    made = stage(map_in_arrow(dealt, connect, EDGE), "edges")
    edges, apart = made.where("v is not null").select("u", "v"), made.where("v is null").select("tree", "node", F.col("u").alias("other"))
    if apart.isEmpty():
        return edges
    # Large nodes only: sets that are not close to the first one, against every block.
    others = apart.join(sets.select(F.col("set_id").alias("other"), F.col("signature").alias("other_signature")), "other")
    blocks = inside.select("tree", "node", "block").distinct()
    others = stage(others.join(blocks, ["tree", "node"]).withColumn("part", F.pmod(F.xxhash64("other"), F.lit(64))), "node-others")
    parts = stage(others.select("tree", "node", "block", "part").distinct(), "node-parts")
    left = inside.join(parts, ["tree", "node", "block"])

    def meet(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            signed, ids = _signed(a), a["set_id"].to_numpy()
            forest, at = Forest(len(a) + len(b)), {s: i for i, s in enumerate(ids)}
            for j, (other, raw) in enumerate(zip(b["other"], b["other_signature"])):
                mine = at.get(other, len(a) + j)
                for i in np.flatnonzero(_close(signed, np.frombuffer(raw, np.uint16), least)):
                    if forest.join(mine, int(i)):
                        out.append((min(other, ids[i]), max(other, ids[i])))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    keys = ["tree", "node", "block", "part"]
    return edges.union(left.groupBy(*keys).cogroup(others.groupBy(*keys)).applyInPandas(meet, "u long, v long"))


def common_counts(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Numbers of common elements of every set of ``a`` with every set of ``b`` (sorted distinct values), by inverted lists."""
    values = np.concatenate([*a, *b]) if a and b else np.zeros(0, np.uint64)
    out = np.zeros(len(a) * len(b), np.int64)
    if not len(values):
        return out.reshape(len(a), len(b))
    owner = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in [*a, *b]])
    order = np.argsort(values, kind="stable")  # owners rise inside a value: those of a first
    values, owner = values[order], owner[order]
    cut = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1], [True]]))
    first, end = cut[:-1], cut[1:]
    of_a = np.concatenate([[0], np.cumsum(owner < len(a))])
    na = of_a[end] - of_a[first]
    nb = end - first - na
    both = (na > 0) & (nb > 0)
    first, na, nb = first[both], na[both], nb[both]
    dense = na * nb > 4096
    for f, x, y in zip(first[dense], na[dense], nb[dense]):  # values that many sets hold: an outer sum
        rows, cols = owner[f:f + x], owner[f + x:f + x + y] - len(a)
        out.reshape(len(a), len(b))[np.ix_(rows, cols)] += 1
    first, na, nb = first[~dense], na[~dense], nb[~dense]
    step = max(1, int(4e6 // max(1, (na * nb).mean() if len(na) else 1)))
    for k in range(0, len(first), step):
        f, x, y = first[k:k + step], na[k:k + step], nb[k:k + step]
        which = np.repeat(np.arange(len(f)), x * y)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(x * y) - x * y, x * y)
        rows, cols = owner[f[which] + nth // y[which]], owner[f[which] + x[which] + nth % y[which]] - len(a)
        out += np.bincount(rows * len(b) + cols, minlength=len(out))
    return out.reshape(len(a), len(b))


def linked(a: list[np.ndarray], b: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs have Jaccard similarity of at least ``threshold``, exactly."""
    common = common_counts(a, b)
    union = np.array([len(x) for x in a])[:, None] + np.array([len(x) for x in b])[None, :] - common
    return (union > 0) & (common >= threshold * union - 1e-9)


def classes(docs: DataFrame, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), threshold: float = 0.8, target_recall: float = 0.9999,
            node_block: int = NODE_BLOCK, exact_block: int = EXACT_BLOCK) -> DataFrame:
    """One row a document: ``keep``, the key of its text (k1, k2), set_id, class_id and n_links.

    Shingles are five words ``[^\\x20\\x09-\\x0D]+``, unchanged; a shorter text is one shingle. Two
    texts are linked if their shingle sets have a Jaccard similarity of at least
    ``threshold``; class_id names the class of texts linked to each other, directly or not;
    n_links counts the other texts (by shingle set) linked to this one. Texts with equal
    sets, those without words included, are one text here. Nulls are empty texts; repeated rows
    share all results; other columns are not looked at; an empty table gives an empty table.
    """
    members = stage(_members(docs, text, list(keep)), "members")
    sets = stage(members.where("n_shingles > 0").groupBy("set_id").agg(
        F.first("signature").alias("signature"), F.min(F.struct("k1", "k2")).alias("text")), "sets")
    nodes = stage(_tree_nodes(sets, prefix_length(threshold, target_recall)), "nodes")
    least = threshold - MARGIN * math.sqrt(threshold * (1 - threshold) / (TREES * DEPTH))
    groups = stage(components(_edges(nodes, sets, least, node_block)), "groups")
    sizes = groups.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    # Every set once for each block it meets; a block is chosen by hash.
    told = groups.join(sizes, "component").withColumn("blocks", F.ceil(F.col("size") / exact_block).cast("int"))
    told = told.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).join(
        sets.select(F.col("set_id").alias("node"), "text.k1", "text.k2"), "node")

    def setup():
        def of(texts):
            words, before = split_words(texts)
            values, bounds = shingles(word_hashes(words), before)
            return [pa.array([values[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:])], pa.binary())]

        return of

    whole = docs.select(quoted(text).cast("string").alias("text"), *text_key(F.coalesce(quoted(text).cast("string"), F.lit("")))).join(told, ["k1", "k2"])
    held = map_texts(whole, setup, [T.StructField("shingles", T.BinaryType())], keep=["node", "component", "blocks", "block"])
    held = held.groupBy("node").agg(*[F.first(c).alias(c) for c in ("component", "blocks", "block", "shingles")])
    held = stage(held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("low", F.least("block", "other")).withColumn(
        "high", F.greatest("block", "other")).drop("other"), "compared")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "node"], ignore_index=True)
        sets = [np.frombuffer(s, np.uint64) for s in pdf["shingles"]]
        ids, first = pdf["node"].to_numpy(), int((pdf["block"] == pdf["low"]).sum())
        alone = bool((pdf["low"] == pdf["high"]).iloc[0])
        pairs = linked(sets, sets, threshold) if alone else linked(sets[:first], sets[first:], threshold)
        counts = pairs.sum(axis=1) - 1 if alone else np.concatenate([pairs.sum(axis=1), pairs.sum(axis=0)])
        forest = Forest(len(ids))
        for i, row in enumerate(pairs):
            for j in np.flatnonzero(row):
                forest.join(i, int(j) + (0 if alone else first))
        return pd.DataFrame({"node": ids, "links": counts.astype(np.int64), "root": ids[[forest.find(i) for i in range(len(ids))]], "blocks": pdf["blocks"]})

    found = stage(held.groupBy("component", "low", "high").applyInPandas(compare, "node long, links long, root long, blocks int"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = found.where("blocks = 1").select("node", "root")
    spread = found.where("blocks > 1").select(F.col("node").alias("u"), F.col("root").alias("v"))
    if not spread.isEmpty():
        roots = roots.union(components(spread).select("node", F.col("component").alias("root")))
    links = links.join(roots, "node", "left").select(F.col("node").alias("set_id"), "links", "root")
    return members.select(*map(quoted, keep), "k1", "k2", "set_id").join(links, "set_id", "left").select(
        *map(quoted, keep), "k1", "k2", "set_id", F.coalesce("root", "set_id").alias("class_id"), F.coalesce("links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame, *, text: str = "text", order: str = "doc_id", **how) -> DataFrame:
    """``docs`` with one row of every class: the least ``order`` (nulls last), then the least text key, then the least hash of all columns."""
    found = classes(docs, text=text, keep=(order,), **how)
    first = F.min(F.struct(quoted(order).isNull().alias("none"), quoted(order).alias("first"), F.col("k1"), F.col("k2"))).alias("x")
    chosen = found.groupBy("class_id").agg(first).select(F.col("x.k1").alias("chosen_1"), F.col("x.k2").alias("chosen_2"), F.col("x.first").alias("chosen_order"))
    a, b = text_key(F.coalesce(quoted(text).cast("string"), F.lit("")))
    keyed = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), F.xxhash64(*map(quoted, docs.columns)).alias("row_hash"), quoted(order).alias("own_order"), a, b)
    same = (F.col("k1") == F.col("chosen_1")) & (F.col("k2") == F.col("chosen_2")) & F.col("own_order").eqNullSafe(F.col("chosen_order"))
    # Rows that agree in text and order are one document.
    return keyed.join(chosen, same).groupBy("k1", "k2").agg(F.min_by("row", "row_hash").alias("row")).select("row.*")
