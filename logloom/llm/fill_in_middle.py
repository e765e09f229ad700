"""Fill-in-the-middle examples, cut between units by one match that keeps every repetition.

``(unit)*`` is matched against the whole text once; the library keeps the end of every
repetition of the group, so their number is the number of units and the ends are all
places where the text may be cut. The two cuts and the form come from a hash of the
document's id, so an example doesn't depend on its place in the table.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F, types as T

from logloom.llm.arrow_text import free_name, map_texts, quoted

#: Prefix, suffix and middle begin with these.
MARKS = ("<P>", "<S>", "<M>")
#: A word with the white space before it, or white space at the end. Neither part gives back, so the match is linear.
UNITS = regex.compile(r"([\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++)*+")

FIELDS = [
    T.StructField("n", T.LongType()), T.StructField("form", T.StringType()), T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()), T.StructField("output", T.StringType()),
]


def draws(key: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers of a key: the first groups of eight digits of the SHA-256 of ``seed:key`` (null: nothing after the colon)."""
    digits = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digits, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def example(text: str, first: int, second: int, third: int, fourth: int, *, rate: int, suffix_first: int) -> tuple[int, str, int | None, int | None, str]:
    """Number of units, form, code points of prefix and middle, and the example itself."""
    ends = UNITS.fullmatch(text).ends(1)
    n = len(ends)
    if not text or third % 100 >= rate or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    low, high = sorted((first % (n + 1), second % (n + 1)))
    a, b = ends[low - 1] if low else 0, ends[high - 1] if high else 0
    prefix, suffix, middle = (mark + part for mark, part in zip(MARKS, (text[:a], text[b:], text[a:b])))
    if fourth % 100 < suffix_first:
        return n, "spm", a, b - a, suffix + prefix + middle
    return n, "psm", a, b - a, prefix + suffix + middle


def transform(docs: DataFrame, *, text: str = "text", key: str = "doc_id", seed: int = 42, rate: int = 50, suffix_first: int = 80) -> DataFrame:
    """``docs`` with n, form, prefix_chars, middle_chars and ``output``, the example made of the whole text.

    ``rate`` per cent of the keys are cut, ``suffix_first`` per cent of these as spm, the
    others as psm; the rest is plain, as are empty texts and those that hold a mark. A null
    text is empty, and a null key draws like the empty string. Rows with the same key get the same draws; repeated
    rows each give an example; a column with the name of an output gives way to it; an
    empty table gives an empty table.
    """
    names = []
    for i in range(4):
        names.append(free_name(f"draw_{i}", [*docs.columns, *names]))
    drawn = docs.select("*", *[d.alias(n) for d, n in zip(draws(quoted(key), seed), names)])

    def setup():
        def made(texts, *numbers):
            rows = [example(t, *four, rate=rate, suffix_first=suffix_first)
                    for t, *four in zip(texts.to_pylist(), *(x.to_pylist() for x in numbers))]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string())
            return [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)]

        return made

    return map_texts(drawn, setup, FIELDS, text=text, extra=names, keep=docs.columns)


def restored(output: Column, form: Column) -> Column:
    """The text that an example was made of.

    A mark can't begin inside another one and no text that was cut holds one, so the first
    of each kind is the one that was put there.
    """
    after = lambda mark: F.split_part(output, F.lit(mark), F.lit(2))
    upto = lambda part, mark: F.split_part(part, F.lit(mark), F.lit(1))
    p, s, m = MARKS
    prefix, suffix = F.when(form == "psm", upto(after(p), s)).otherwise(upto(after(p), m)), F.when(form == "psm", upto(after(s), m)).otherwise(upto(after(s), p))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, after(m), suffix))
