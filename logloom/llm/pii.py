"""Personal data and the terms that give it away.

Base spans (e-mail, IP, card, phone) are patterns. What else reveals a person is learned
from the corpus: for an entity c and a term t that stands within ``window`` words of it,

    disclosure(c, t) = PMI(c; t) / IC(c),   PMI = log p(c,t) / (p(c) p(t)),   IC = -log p(c)

is the share of c's information that t alone gives; 1 means that t never occurs without c.
p counts documents, all of them. A term is sanitised in documents that name the entity if
its disclosure reaches the threshold. Most values stand in one text, so no pair is left out
for being rare; one seen in fewer than ``support`` different texts is smoothed: its term
counts as seen without the entity in as many more documents as texts are missing.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F, types as T

from logloom.llm.arrow_text import distinct_words, explode_texts, free_name, map_texts, quoted, split_words, text_key
from logloom.session import stage

KINDS = ("email", "ip", "card", "phone")
#: What a span is replaced by.
MARKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}
EDGES = ".,;:!?\"'()[]{}<>*#$%&|"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# A failing run of digits fails from each of its digits, so only its first is tried.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, in one pass over the @ signs: the local part is the run before one, the domain what follows."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as in ``KINDS``, then start; code points, end exclusive."""
    out = [("email", a, b) for a, b in emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def entity_key(kind: str, value: str) -> int:
    """One key for all spellings of a value."""
    return xxhash.xxh3_64_intdigest(f"{kind}:{value.lower() if kind in ('email', 'ip') else _digits(value)}") - (1 << 63)


def term_of(word: str) -> str:
    return word.strip(EDGES).lower()


def term_key(term: str) -> int:
    return xxhash.xxh3_64_intdigest(term) - (1 << 63)


def near_terms(text: str, spans: list[tuple[str, int, int]], window: int) -> set[tuple[int, int]]:
    """(entity, term) keys of the words within ``window`` words of a span, spans' own words left out."""
    words = [m.span() for m in _WORD.finditer(text)]
    starts, ends = [a for a, _ in words], [b for _, b in words]
    taken = sorted((a, b) for _, a, b in spans)
    covered = _covered(words, taken)
    found = set()
    for kind, a, b in spans:
        entity = entity_key(kind, text[a:b])
        before, after = bisect_right(ends, a), bisect_left(starts, b)
        for k in [*range(max(0, before - window), before), *range(after, min(len(words), after + window))]:
            if not covered[k] and (term := term_of(text[slice(*words[k])])):
                found.add((entity, term_key(term)))
    return found


def _covered(words: list[tuple[int, int]], taken: list[tuple[int, int]]) -> list[bool]:
    """Which words overlap a span; both sorted by start."""
    out, k, reach = [], 0, -1
    for a, b in words:
        while k < len(taken) and taken[k][0] < b:
            reach = max(reach, taken[k][1])
            k += 1
        out.append(reach > a)
    return out


def term_documents(docs: DataFrame, text: str) -> DataFrame:
    """``term, n``: how many documents hold each term, summed inside slices before any shuffle."""

    def setup():
        def counted(texts):
            words, before = split_words(texts)
            distinct, codes = distinct_words(words)
            terms = np.fromiter((term_key(t) if (t := term_of(w)) else 0 for w in distinct), np.int64, len(distinct))
            # One entry a document and term: sort by document, then term.
            of = terms[codes] if len(codes) else np.zeros(0, np.int64)
            rows = np.repeat(np.arange(len(texts)), np.diff(before))
            order = np.lexsort((of, rows))
            rows, of = rows[order], of[order]
            first = np.ones(len(of), bool)
            first[1:] = (rows[1:] != rows[:-1]) | (of[1:] != of[:-1])
            term, n = np.unique(of[first], return_counts=True)
            return np.zeros(len(term), np.int64), [pa.array(term), pa.array(n.astype(np.int64))]

        return counted

    fields = [T.StructField("term", T.LongType()), T.StructField("n", T.LongType())]
    return explode_texts(docs, setup, fields, text=text, keep=[]).groupBy("term").agg(F.sum("n").alias("n"))


def disclosing_terms(docs: DataFrame, *, text: str = "text", threshold: float = 0.8, support: int = 3, window: int = 10) -> DataFrame:
    """``entity, term, disclosure``: the terms that reveal an entity, from co-occurrence over all documents."""

    def setup():
        def pairs(texts):
            rows, entities, terms = [], [], []
            for row, t in enumerate(texts.to_pylist()):
                spans = base_spans(t)
                # An entity by itself, too: the number of documents that name it.
                found = {(entity_key(k, t[a:b]), None) for k, a, b in spans} | (near_terms(t, spans, window) if spans else set())
                for entity, term in found:
                    rows.append(row)
                    entities.append(entity)
                    terms.append(term)
            return np.array(rows, np.int64), [pa.array(entities, pa.int64()), pa.array(terms, pa.int64())]

        return pairs

    named = docs.where(likely(F.col(text))).select(text, *text_key(F.col(text)))
    fields = [T.StructField("entity", T.LongType()), T.StructField("term", T.LongType())]
    pairs = explode_texts(named, setup, fields, text=text, keep=["k1", "k2"])
    # First a row a text, then a row a pair: copies of a text count as documents, not as support.
    pairs = pairs.groupBy("entity", "term", "k1", "k2").agg(F.count(F.lit(1)).alias("n"))
    pairs = stage(pairs.groupBy("entity", "term").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts")), "pii-pairs")
    near = pairs.where(F.col("term").isNotNull()).select("entity", "term", F.col("n").alias("both"), F.greatest(F.lit(support) - F.col("texts"), F.lit(0)).alias("missing"))
    total = docs.count()
    entities = pairs.where(F.col("term").isNull()).select("entity", F.col("n").alias("with_entity"))
    terms = term_documents(docs, text).join(near.select("term").distinct(), "term").withColumnRenamed("n", "with_term")
    every = float(total)
    found = near.join(entities, "entity").join(terms, "term")
    pmi = F.log(F.col("both") * every / (F.col("with_entity") * (F.col("with_term") + F.col("missing"))))
    content = -F.log(F.col("with_entity") / every)
    found = found.withColumn("disclosure", F.when(content > 0, pmi / content)).where(F.col("disclosure") >= threshold)
    return stage(found.select("entity", "term", "disclosure"), "pii-terms")


def likely(text: Column) -> Column:
    """Texts that can hold a base span at all: every kind needs a digit or an @."""
    return F.coalesce(text.rlike("[0-9@]"), F.lit(False))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def find(docs: DataFrame, *, text: str = "text", threshold: float = 0.8, support: int = 3, window: int = 10) -> DataFrame:
    """``docs`` with ``pii_spans``: base spans by kind and start, then the disclosing terms by start.

    A term's spans never overlap base spans, and only documents that name the entity it
    reveals have them. A null or empty text has none; repeated rows get the same spans; a
    column named pii_spans gives way; an empty table gives an empty table.
    """
    docs = docs.select(*[quoted(c) for c in docs.columns if c.lower() != "pii_spans"])
    revealing = disclosing_terms(docs.select(quoted(text).alias("text")), threshold=threshold, support=support, window=window)

    def contents():
        def of(texts):
            rows, entities, terms = [], [], []
            for row, t in enumerate(texts.to_pylist()):
                if spans := base_spans(t):
                    rows.append(row)
                    entities.append(sorted({entity_key(k, t[a:b]) for k, a, b in spans}))
                    terms.append(sorted({term_key(term) for w in set(_WORD.findall(t)) if (term := term_of(w))}))
            return np.array(rows, np.int64), [pa.array(entities, pa.list_(pa.int64())), pa.array(terms, pa.list_(pa.int64()))]

        return of

    held = likely(quoted(text))
    some = docs.where(held).select(quoted(text).alias("text"), *text_key(quoted(text)))
    keys = [T.StructField(c, T.ArrayType(T.LongType())) for c in ("entities", "held_terms")]
    contained = stage(explode_texts(some, contents, keys, keep=["k1", "k2"]), "pii-texts")
    named, holding = (contained.select("k1", "k2", F.explode(c).alias(n)).distinct() for c, n in (("entities", "entity"), ("held_terms", "term")))
    # By the terms a text holds: an entity of many texts has terms from all of them, few of them in any one.
    reveals = holding.join(revealing.select("entity", "term"), "term").join(named, ["k1", "k2", "entity"], "left_semi") \
        .groupBy("k1", "k2").agg(F.collect_set("term").alias("terms"))
    k1, k2, terms = (free_name(c, [*docs.columns, "pii_spans"]) for c in ("text_key", "text_key_again", "revealing_terms"))
    a, b = text_key(quoted(text))
    keyed = docs.where(held).withColumns({k1: a, k2: b}).join(
        reveals.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("terms").alias(terms)), [k1, k2], "left")
    def spans():
        def of(texts, revealing):
            out = []
            for t, wanted in zip(texts.to_pylist(), revealing.to_pylist()):
                spans = base_spans(t)
                if wanted:
                    wanted = set(wanted)
                    words = [m.span() for m in _WORD.finditer(t)]
                    covered = _covered(words, sorted((a, b) for _, a, b in spans))
                    for (a, b), base in zip(words, covered):
                        if not base and (term := term_of(t[a:b])) and term_key(term) in wanted:
                            lead = len(t[a:b]) - len(t[a:b].lstrip(EDGES))
                            spans.append(("term", a + lead, b - (len(t[a:b]) - len(t[a:b].rstrip(EDGES)))))
                out.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            return [pa.array(out, kind)]

        return of

    found = map_texts(keyed, spans, [T.StructField("pii_spans", SPANS)], text=text, keep=docs.columns, extra=[terms])
    return found.unionByName(docs.where(~held).withColumn("pii_spans", F.array().cast(SPANS)))


def sanitise(docs: DataFrame, *, text: str = "text", remove_terms: bool = False, **how) -> DataFrame:
    """``docs`` with base spans replaced by their kind and terms generalised to ``[TERM]``, or removed."""
    found = find(docs, text=text, **how)
    # Of spans that overlap, the one that starts first counts, then the longer one.
    ordered = F.array_sort(F.transform("pii_spans", lambda s: F.struct(s["start"].alias("a"), (-s["end"]).alias("b"), s["kind"].alias("k"))))
    marks = F.create_map(*[F.lit(x) for kind, mark in MARKS.items() for x in (kind, "" if remove_terms and kind == "term" else mark)])
    whole = quoted(text)
    state = F.struct(F.lit(1).alias("at"), F.lit("").alias("done"))

    def step(acc, s):
        start, end = s["a"] + 1, -s["b"] + 1
        done = F.concat(acc["done"], F.substring(whole, acc["at"], start - acc["at"]), marks[s["k"]])
        return F.when(start >= acc["at"], F.struct(end.alias("at"), done.alias("done"))).otherwise(acc)

    clean = F.aggregate(ordered, state, step, lambda acc: F.concat(acc["done"], F.substring(whole, acc["at"], F.length(whole))))
    return found.withColumn(text, F.when(F.size("pii_spans") > 0, clean).otherwise(whole))
