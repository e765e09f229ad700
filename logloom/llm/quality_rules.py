"""Quality rules learned by sequential covering: an ordered list of threshold conjunctions, run as one CASE expression.

Statistics of every text come from DataFrame functions alone. Labelled rows are cut into
bins once; every step of the learner is one small aggregation over them:

- grow: add the threshold that gains most (FOIL) on the grow rows not covered yet;
- prune: cut conditions from the end while that helps on the prune rows;
- accept the rule if it is precise enough on the prune rows, drop what it covers, go on.

What a step brings to the driver is one row a statistic and bin, whatever the input.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from logloom.llm.arrow_text import quoted
from logloom.session import stage

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
#: What the learner looks at: shares and lengths, so that rules hold for texts of any size.
FEATURES = ("n_words", "mean_word", "symbol_share", "mark_share", "upper_share", "dup_line_share", "repeat_share", "distinct_share", "digit_share")


def text_stats(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Statistics of every whole text; a null text has no words. ``keep`` names the columns to carry along."""
    kept = [quoted(c) for c in keep]
    blank = r"[\x20\x09-\x0D]+"
    step = docs.select(*kept, F.coalesce(quoted(text).cast("string"), F.lit("")).alias("_t"))
    step = step.select(*kept, "_t", F.filter(F.split("_t", blank), lambda w: w != "").alias("_w"),
                       F.filter(F.split("_t", "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != "").alias("_l"))

    def matched(pattern: str) -> Column:
        return (F.length("_t") - F.length(F.regexp_replace("_t", pattern, ""))).cast("long")

    windows = F.when(F.size("_w") >= WINDOW, F.transform(F.sequence(F.lit(0), F.size("_w") - WINDOW), lambda i: F.xxhash64(F.slice("_w", i + 1, F.lit(WINDOW)))))
    step = step.select(
        *kept, F.size("_w").cast("long").alias("n_words"), F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        matched(SYMBOLS).alias("n_symbols"), (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        F.size("_l").alias("_lines"), matched("[!?]").alias("_marks"), matched("[A-Z]").alias("_upper"), matched("[0-9]").alias("_digits"),
        F.size(F.array_distinct("_w")).alias("_distinct"), windows.alias("_h"))
    # Only texts in which a window occurs twice need to know where.
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    step = step.withColumn("_s", F.when(repeats, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    same = lambda k, h: F.coalesce(F.get("_s", k)["h"] == h, F.lit(False))
    starts = F.transform(F.filter("_s", lambda s, k: same(k - 1, s["h"]) | same(k + 1, s["h"])), lambda s: s["i"])
    step = step.drop("_h").withColumn("_p", F.sort_array(starts)).drop("_s")
    covered = F.aggregate(F.transform("_p", lambda s, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_p", k + 1) - s, F.lit(WINDOW)))), F.lit(0), lambda a, b: a + b)
    step = step.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_p")
    share = lambda a, b: F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))
    return step.select(
        *kept, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", share("word_chars", "n_words").alias("mean_word"),
        share("n_symbols", "word_chars").alias("symbol_share"), share("_marks", "word_chars").alias("mark_share"), share("_upper", "word_chars").alias("upper_share"),
        share("n_dup_lines", "_lines").alias("dup_line_share"), share("n_repeat_words", "n_words").alias("repeat_share"),
        share("_distinct", "n_words").alias("distinct_share"), share("_digits", "word_chars").alias("digit_share"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.col(self.feature).cast("double")
        return value >= self.threshold if self.above else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _holds(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, (c.column() for c in rule), F.lit(True))


def _uncovered(rules: list[Rule]) -> Column:
    return reduce(lambda a, r: a & ~_holds(r), rules, F.lit(True))


def _thresholds(labelled: DataFrame, features: tuple[str, ...], bins: int) -> dict[str, list[float]]:
    """Quantiles of all rows and of the bad ones, a bounded number a feature."""
    cuts = [i / bins for i in range(1, bins)]
    wanted = []
    for f in features:
        value = F.col(f).cast("double")
        wanted += [F.percentile_approx(value, cuts, 10000).alias(f"all_{f}"), F.percentile_approx(F.when(F.col("bad") == 1, value), cuts, 10000).alias(f"bad_{f}")]
    row = labelled.agg(*wanted).first()
    return {f: sorted(map(float, {*(row[f"all_{f}"] or []), *(row[f"bad_{f}"] or [])})) for f in features}


def _counts(rows: DataFrame, thresholds: dict[str, list[float]]) -> dict[str, list[tuple[int, int]]]:
    """Bad and good rows below each threshold step of every feature (bin k: values from threshold k-1 up to k)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"bin_{f}").alias("bin")) for f in thresholds])).alias("x")
    found = rows.select("bad", pairs).groupBy("x.feature", "x.bin").agg(F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("n")).collect()
    out = {f: [(0, 0)] * (len(t) + 1) for f, t in thresholds.items()}
    for r in found:
        out[r["feature"]][r["bin"]] = (r["bad"], r["n"] - r["bad"])
    return out


def _best(counts: dict[str, list[tuple[int, int]]], thresholds: dict[str, list[float]], least: int) -> Condition | None:
    """The condition of largest FOIL gain; ties go to the feature's place and the lower threshold."""
    best, gain = None, 1e-9
    for f, bins in counts.items():
        bad, good = sum(b for b, _ in bins), sum(g for _, g in bins)
        if not bad:
            return None
        base, low_bad, low_good = math.log2(bad / (bad + good)), 0, 0
        for k, t in enumerate(thresholds[f]):
            low_bad, low_good = low_bad + bins[k][0], low_good + bins[k][1]
            for above, b, g in ((False, low_bad, low_good), (True, bad - low_bad, good - low_good)):
                if b >= least and (now := b * (math.log2(b / (b + g)) - base)) > gain + 1e-9:
                    best, gain = Condition(f, above, t), now
    return best


def learn(labelled: DataFrame, *, features: tuple[str, ...] = FEATURES, max_rules: int = 10, max_conditions: int = 3, bins: int = 48,
          precision: float = 0.9, support: float = 0.01) -> list[Rule]:
    """An ordered list of rules for ``bad`` (0/1) from the statistics of labelled rows.

    Two thirds of the rows, by hash of ``salt`` and values, grow rules, the rest prune and judge them.
    A rule must be right for a share ``precision`` of the prune rows it covers and cover a share
    ``support`` of the bad ones. No labelled rows, or labels of one kind, give no rules.
    """
    thresholds = _thresholds(labelled, features, bins)
    if not all(thresholds.values()):
        return []
    def bin_of(f: str) -> Column:
        value = F.col(f).cast("double")
        return F.size(F.filter(F.array(*map(F.lit, thresholds[f])), lambda t: value >= t)).alias(f"bin_{f}")

    grow = F.pmod(F.xxhash64("salt", *features), F.lit(3)) > 0
    binned = stage(labelled.select("bad", *features, grow.alias("grow"), *map(bin_of, features)), "labelled-stats")
    totals = {r["grow"]: (r["bad"] or 0, r["n"]) for r in binned.groupBy("grow").agg(F.sum("bad").alias("bad"), F.count(F.lit(1)).alias("n")).collect()}
    bad_grow, bad_prune = totals.get(True, (0, 0))[0], totals.get(False, (0, 0))[0]
    least_grow, least_prune = max(2, math.ceil(support * bad_grow)), max(1, math.ceil(support * bad_prune))
    rules: list[Rule] = []
    while len(rules) < max_rules:
        rest = binned.where(_uncovered(rules))
        rule: Rule = ()
        while len(rule) < max_conditions:
            counts = _counts(rest.where("grow").where(_holds(rule)), thresholds)
            found = _best(counts, thresholds, least_grow)
            if found is None:
                break
            rule += (found,)
            side = range(thresholds[found.feature].index(found.threshold) + 1)
            good = sum(g for k, (_, g) in enumerate(counts[found.feature]) if (k in side) != found.above)
            if not good:
                break
        if not rule:
            break
        judged = rest.where(~F.col("grow")).agg(*[x for k in range(len(rule)) for x in (
            F.sum(F.when(_holds(rule[:k + 1]), F.col("bad"))).alias(f"b{k}"), F.count(F.when(_holds(rule[:k + 1]), 1)).alias(f"n{k}"))]).first()
        worth = [((2 * (judged[f"b{k}"] or 0) - judged[f"n{k}"]) / judged[f"n{k}"] if judged[f"n{k}"] else -1.0, -k) for k in range(len(rule))]
        at = -max(worth)[1]
        hit, n = judged[f"b{at}"] or 0, judged[f"n{at}"]
        if hit < least_prune or hit < precision * n:
            break
        rules.append(rule[:at + 1])
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The decision list as one ordered conditional: false at the first rule that holds."""
    out = None
    for rule in rules:
        out = F.when(_holds(rule), False) if out is None else out.when(_holds(rule), False)
    return F.lit(True) if out is None else out.otherwise(True)


def judge(docs: DataFrame, labels: DataFrame, *, text: str = "text", min_words: int = 20, max_repeat_percent: int = 30, **how) -> DataFrame:
    """One row a document: doc_id, its statistics, base_failed and kept.

    ``labels`` has doc_id and quality (1 good, 0 bad); other values and null ids are left
    out, and a document with both labels counts as bad. A null or empty text has no words, so it fails
    the base rule. Repeated rows are judged each; columns other than doc_id and the text
    are not looked at; an empty table gives an empty table.
    """
    stats = stage(text_stats(docs, text), "text-stats")
    marks = labels.select("doc_id", "quality").where(F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labelled = stats.join(marks, "doc_id").select(F.col("doc_id").alias("salt"), *FEATURES, (1 - F.col("quality")).cast("long").alias("bad"))
    rules = learn(stage(labelled, "labelled"), **how)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    return stats.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))
