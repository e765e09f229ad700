"""Mixing sources to target weights by weighted sampling without replacement, in DataFrame functions.

1. Every source gets a share of the words wanted by its weight; what exceeds the epochs
   that a source may be read goes to the others by weight. Sources in order of size over
   weight: the first that stays below its bound, and so do all after it.
2. A source is taken whole as often as its target holds it. For the rest every document
   draws an exponential key, divided by its quality weight (Efraimidis and Spirakis): documents in
   the order of their keys are taken once more while at least half of them fits.

Sums over sources and over the documents of a source are running sums over ranges, so neither
many sources nor one with a third of all documents meets in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from logloom.llm.arrow_text import free_name, quoted
from logloom.llm.ordering import running
from logloom.operators.joins import attach
from logloom.session import stage

WORD = r"[^\x20\x09-\x0D]+"


def word_shape(text: Column, size: Column) -> Column:
    """A quality weight: 1 where a word and its space take 4 to 11 code points on average, as in prose, else 0.25."""
    return F.when(F.length(text).between(4 * size, 11 * size), 1.0).otherwise(0.25)


def draw(seed: int, key: Column, text: Column) -> Column:
    """A number between 0 and 1 (both left out) of 52 bits of the MD5 of ``seed:key:text``."""
    digits = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), text))
    return (F.conv(F.substring(digits, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def targets(sizes: DataFrame, *, source: str, size: str, weights: tuple[int, ...], share: float, epochs: int) -> DataFrame:
    """``sizes`` (a row a source, with its words) and ``target``: shares by weight, bounded by ``epochs`` times the size, the excess dealt anew until none is above.

    Sources weigh ``weights`` in turn, in order of their names by code point, null last.
    """
    ranked = running(sizes, [], [F.asc_nulls_last(quoted(source))], {"place": F.lit(1)})
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod("place_before", F.lit(len(weights))).cast("int"))
    ranked = ranked.withColumn("weight", weight.cast("long"))
    # In the order of size over weight the sources that reach their bound come first. Sums are whole numbers.
    order = [quoted(size) / F.col("weight"), F.col("place_before")]
    summed = stage(running(ranked, [], order, {"weight": F.col("weight"), "words": quoted(size)}), "sources")
    left = F.col("words_total").cast("double") * share - F.col("words_before").cast("double") * epochs
    level = left / (F.col("weight_total") - F.col("weight_before")).cast("double")
    bound = quoted(size).cast("double") * epochs
    # The level at the first source below its bound is that of all after it.
    common = summed.where(level * F.col("weight") <= bound).agg(F.min_by(level, F.struct(*order))).first()[0]
    free = F.lit(common).cast("double") * F.col("weight")
    return summed.select(*map(quoted, sizes.columns), F.when(level * F.col("weight") <= bound, free).otherwise(bound).alias("target"))


def mix(docs: DataFrame, *, text: str = "text", source: str = "source", key: str = "doc_id", keep: tuple[str, ...] = ("doc_id",),
        weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, epochs: int = 2, seed: int = 42, quality: Column | None = None) -> DataFrame:
    """``keep``, size, source_size, target, times, taken: how often the mix takes each document.

    ``size`` counts the words of the whole text (null: 0), ``source_size`` those of its
    source, ``target`` the words wanted of it out of ``share`` times all words. ``times`` is
    at most ``epochs`` and ``taken`` is times x size. ``quality`` is a positive weight (by default
    ``word_shape``): of two documents of a source the heavier is likelier to be read once
    more. A source's taken words miss its target by at most half of one document.

    Null and empty sources are sources of their own; documents without words are never
    counted against a target. The draw is made from seed, key and text, so reruns agree; rows
    equal in both share their draw and each count. Columns not kept are not looked at, and one of
    ``keep`` that has the name of an output gives way to it; an empty table gives an empty table.
    """
    out = ("size", "source_size", "target", "times", "taken")
    kept = [c for c in keep if c.lower() not in out]
    words, where, turn, told = (free_name(n, [*kept, *out]) for n in ("words", "from", "turn", "told"))
    whole = F.coalesce(quoted(text).cast("string"), F.lit(""))
    heavy = word_shape(whole, F.col(words)) if quality is None else quality
    # One key for every source, null included; a name can't begin with the sign of null.
    named = F.coalesce(F.concat(F.lit("="), quoted(source).cast("string")), F.lit("~"))
    counted = docs.withColumn(words, F.regexp_count(whole, F.lit(WORD)).cast("long"))
    base = stage(counted.select(*map(quoted, kept), named.alias(where), words, (-F.ln(draw(seed, quoted(key), whole)) / heavy).alias(turn)), "draws")
    sizes = base.groupBy(where).agg(F.sum(words).alias("source_size"), F.count("*").alias("n_docs"))
    wanted = stage(targets(sizes, source=where, size="source_size", weights=weights, share=share, epochs=epochs), "targets")
    others = F.xxhash64(*map(quoted, kept)) if kept else F.lit(0)
    summed = running(base, [where], [F.col(turn), F.col(words), others], {told: F.col(words)})
    joined = attach(summed, wanted, where, spread=F.xxhash64(turn, f"{told}_before"), how="inner", uses="n_docs")
    whole_times = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - whole_times * F.col("source_size")
    times = whole_times + (F.col(f"{told}_before") + F.col(words) / 2 < rest).cast("long")
    return joined.select(*map(quoted, kept), F.col(words).alias("size"), "source_size", "target", times.alias("times"), (times * F.col(words)).alias("taken"))
