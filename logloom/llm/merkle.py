"""A Merkle tree over a table and a proof for each row, by pointer jumping.

1. Rows become leaves; their places inside their group come from running sums over ranges.
2. Trees are built in blocks: 2^8 neighbouring nodes give the nodes of eight levels above
   them, so a tree of n leaves takes log(n) / 8 rounds and no block grows with the input.
   The subroots of all groups are the leaves of one more tree.
3. Every node holds its sibling as a segment of one step towards its parent. Joining the
   nodes with themselves, each takes over its ancestor's segment and with it doubles the
   distance it spans: after k joins a segment has 2^k steps. Only nodes at every
   2^k-th level are asked for again, so the table soon has hardly more rows than leaves.

A step is one byte for the sibling's side and its 32 bytes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from logloom.llm.arrow_text import free_name, quoted
from logloom.llm.ordering import running
from logloom.operators.joins import attach
from logloom.session import stage

#: Levels that a block makes at once: it holds 2^BLOCK_LEVELS nodes of the level below.
BLOCK_LEVELS = 8
#: Bytes of a step, and the sides a sibling can stand on.
STEP, LEFT, RIGHT, ALONE = 33, b"L", b"R", b"-"
#: Ancestors are broadcast up to this size, which follows from the number of leaves.
BROADCAST_BYTES = 4 << 20


def leaf_of(*values: Column) -> Column:
    """SHA-256 (lowercase hex) of the values one after another: ``-`` for null, else UTF-8 byte count, ``:`` and the value as text."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def levels_up(nodes: DataFrame, level: int) -> DataFrame:
    """Blocks of ``nodes`` (tree, n, pos, digest at ``level``): tree, n, block, and ``levels``, an array of digests for each level from here to the next block.

    A level above the root is empty.
    """
    blocks = nodes.groupBy("tree", "n", F.shiftright("pos", BLOCK_LEVELS).alias("block")).agg(
        F.array(F.transform(F.sort_array(F.collect_list(F.struct("pos", "digest"))), lambda x: x["digest"])).alias("levels"))

    def paired(below: Column) -> Column:
        digest = lambda i: F.sha2(F.concat(F.get(below, 2 * i), F.coalesce(F.get(below, 2 * i + 1), F.lit(""))), 256)
        return F.transform(F.sequence(F.lit(0), F.shiftright(F.size(below) - 1, 1)), digest)

    # One node alone in its block is the root if it is alone in the tree, too.
    ends = F.transform(F.sequence(F.lit(0), F.lit(BLOCK_LEVELS - 1)), lambda j: F.element_at(widths(level), j + 1) <= 1)
    step = lambda made, end: F.concat(made, F.array(F.when(end, F.array().cast("array<string>")).otherwise(paired(F.element_at(made, -1)))))
    return stage(blocks.withColumn("levels", F.aggregate(ends, F.col("levels"), step)), "levels")


def widths(level: int) -> Column:
    """How many nodes a tree of ``n`` leaves has at each level of a block that begins at ``level``, and at the next block's first."""
    return F.array(*[F.shiftright(F.col("n") - 1, level + j) + 1 for j in range(BLOCK_LEVELS + 1)])


def steps_of(blocks: DataFrame, level: int) -> DataFrame:
    """A row for each node of a block below the root: tree, n, level, pos, and the step to its parent."""
    rows = blocks.select("tree", "n", "block", widths(level).alias("wide"), F.posexplode("levels").alias("j", "digests")).where(f"j < {BLOCK_LEVELS} and wide[j] > 1")

    def step(digest: Column, i: Column) -> Column:
        other = F.get("digests", i.bitwiseXOR(F.lit(1)))
        side = F.when(other.isNull(), F.lit(ALONE)).when(F.pmod(i, F.lit(2)) == 1, F.lit(LEFT)).otherwise(F.lit(RIGHT))
        return F.concat(side, F.coalesce(F.unhex(other), F.lit(bytes(STEP - 1))))

    rows = rows.select("tree", "n", "block", "j", F.posexplode(F.transform("digests", step)).alias("i", "path"))
    return rows.select("tree", "n", (F.col("j") + level).alias("level"), F.expr(f"(block << ({BLOCK_LEVELS} - j)) + i").alias("pos"), "path")


def forest(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of trees given by their leaves (tree, n, pos, digest): roots (tree, root), and for each leaf the path to its root (tree, pos, path).

    ``n`` is the number of leaves of the tree, ``pos`` counts from 0. A lone leaf is its own root and has no path row.
    """
    largest, total = leaves.agg(F.max("n"), F.count("*")).first()
    nodes, level, parts = leaves.select("tree", "n", "pos", "digest"), 0, []
    roots = [nodes.where("n = 1").select("tree", F.col("digest").alias("root"))]
    while ((largest or 1) - 1) >> level > 0:
        blocks = levels_up(nodes.where(F.get(widths(level), F.lit(0)) > 1), level)
        parts.append(steps_of(blocks, level))
        last = F.element_at("levels", -1)
        whole = blocks.where(F.get(widths(level), F.lit(BLOCK_LEVELS)) == 1)
        roots.append(whole.select("tree", F.element_at(F.element_at(F.filter("levels", lambda x: F.size(x) > 0), -1), 1).alias("root")))
        level += BLOCK_LEVELS
        nodes = blocks.where(F.get(widths(level), F.lit(0)) > 1).select("tree", "n", F.col("block").alias("pos"), F.get(last, F.lit(0)).alias("digest"))
    found = reduce(DataFrame.union, roots)
    if not parts:
        return found, leaves.select("tree", "pos", F.lit(b"").alias("path")).where("false")
    return found, jump(reduce(DataFrame.union, parts), (largest - 1).bit_length(), total)


def jump(nodes: DataFrame, height: int, leaves: int) -> DataFrame:
    """Paths of all leaves to their roots (tree, pos, path) from single steps, by doubling the distance spanned."""
    span = 1
    while span < height:
        if span > 1:
            nodes = stage(nodes, "paths", compression="zstd")
        here = nodes.where(F.pmod("level", F.lit(2 * span)) == 0)
        there = nodes.where(F.pmod("level", F.lit(2 * span)) == span).select(
            F.col("tree").alias("to_tree"), F.col("level").alias("to_level"), F.col("pos").alias("to_pos"), F.col("path").alias("rest"))
        # A tree with steps at a level of L or more has over 2^L leaves, so fewer than 3 such nodes for 2^span leaves; a path has span steps.
        if 3 * (leaves >> span) * (span * STEP + 64) <= BROADCAST_BYTES:
            there = F.broadcast(there)
        met = (F.col("tree") == F.col("to_tree")) & (F.col("level") + span == F.col("to_level")) & (F.shiftright("pos", span) == F.col("to_pos"))
        path = F.concat("path", F.coalesce("rest", F.lit(b"")))
        nodes = here.join(there, met, "left").select("tree", "n", "level", "pos", path.alias("path"))
        span *= 2
    return nodes.where("level = 0").select("tree", "pos", "path")


def manifest(docs: DataFrame, leaf: Column, *, group: str = "lang", order: str = "doc_id", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, leaf, subroot, root, path: every row with its proof.

    Inside a group (null is one, too) leaves ascend by ``order`` (null first), then by
    digest. While several nodes remain, neighbours in twos, a last one alone, become the
    SHA-256 of their hex digests; what remains is the group's ``subroot``. Subroots in the order
    of their groups (null first, bytewise) give ``root`` in the same way. ``path`` has a step
    of 33 bytes for each level from the leaf to the root. Repeated rows are leaves of their own; columns not
    kept are not looked at, and one of ``keep`` that has the name of an output gives way to it;
    an empty table gives an empty table.
    """
    out = ("leaf", "subroot", "root", "path")
    kept = [c for c in keep if c.lower() not in out]
    names = {}
    for c in (*kept, "rank"):
        names[c] = free_name("own", ["tree", "pos", "n", "digest", "path", "order", "node_before", "node_total", "subroot", "root", "top_path", *names.values()])
    rank = names.pop("rank")
    # A key for every group: null before all others, the rest as their texts.
    tree = F.coalesce(F.concat(F.lit("="), quoted(group).cast("string")), F.lit(""))
    rows = stage(docs.select(*[quoted(c).alias(n) for c, n in names.items()], tree.alias("tree"), quoted(order).alias("order"), leaf.alias("digest")), "leaves")
    others = F.xxhash64(*names.values()) if names else F.lit(0)
    placed = running(rows.withColumn(rank, others), ["tree"], [F.asc_nulls_first("order"), F.col("digest"), F.col(rank)], {"node": F.lit(1)})
    placed = stage(placed.select(*names.values(), "tree", "digest", F.col("node_before").alias("pos"), F.col("node_total").alias("n")), "placed")
    subroots, paths = forest(placed)
    sizes = placed.where("pos = 0").select("tree", "n")
    tops = running(stage(subroots.join(sizes, "tree"), "subroots"), [], [F.col("tree")], {"node": F.lit(1)})
    tops = stage(tops.select(F.lit("").alias("tree"), F.col("tree").alias("of"), F.col("n").alias("n_leaves"), F.col("root").alias("digest"),
                             F.col("node_before").alias("pos"), F.col("node_total").alias("n")), "tops")
    roots, top_paths = forest(tops)
    top_paths = top_paths.select(F.col("pos").alias("top_pos"), F.col("path").alias("top_path"))
    root = roots.select("root").first()
    over = tops.join(top_paths, F.col("pos") == F.col("top_pos"), "left").select(
        F.col("of").alias("tree"), "n_leaves", F.col("digest").alias("subroot"), F.lit(root[0] if root else None).cast("string").alias("root"), "top_path")
    own_path = paths.select(F.col("tree").alias("path_tree"), F.col("pos").alias("path_pos"), "path")
    met = placed.drop("n").join(own_path, (F.col("tree") == F.col("path_tree")) & (F.col("pos") == F.col("path_pos")), "left").drop("path_tree", "path_pos")
    # The last jump: from the subroot, which every leaf has reached, to the root.
    met = attach(met, stage(over, "over"), "tree", spread=F.col("pos"), how="inner", uses="n_leaves")
    whole = F.concat(*[F.coalesce(c, F.lit(b"")) for c in (F.col("path"), F.col("top_path"))])
    return met.select(*[F.col(n).alias(c) for c, n in names.items()], F.col("digest").alias("leaf"), "subroot", "root", whole.alias("path"))


def _steps(path: Column) -> Column:
    """The steps of a path: side and sibling in hex."""
    at = lambda i: F.substring(path, i * STEP + 1, F.lit(STEP))
    one = lambda s: F.struct(F.substring(s, 1, 1).alias("side"), F.lower(F.hex(F.substring(s, 2, STEP - 1))).alias("sibling"))
    count = F.floor(F.octet_length(path) / STEP).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: one(at(i)))).otherwise(
        F.array().cast("array<struct<side:binary,sibling:string>>"))


def proof_digest(path: Column) -> Column:
    """SHA-256 of the siblings of a path, in hex, one after another."""
    return F.sha2(F.array_join(F.transform(F.filter(_steps(path), lambda s: s["side"] != F.lit(ALONE)), lambda s: s["sibling"]), ""), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""
    step = lambda got, s: F.sha2(F.when(s["side"] == F.lit(LEFT), F.concat(s["sibling"], got)).when(s["side"] == F.lit(RIGHT), F.concat(got, s["sibling"])).otherwise(got), 256)
    return F.aggregate(_steps(path), leaf, step)
