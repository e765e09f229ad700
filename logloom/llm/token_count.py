"""Token counts by byte-pair merging with a heap and a linked list, without making identifiers.

The vocabulary file (``tokenizers`` JSON, kind BPE) gives the special strings, the
normaliser, the splitter and the merge ranks. A text is cut at its white space, as no
pre-token of these vocabularies spans it; every distinct word of a slice is counted once,
frequent ones once a worker. The count of a pre-token is its initial symbols less its
merges: the adjacent pair of lowest rank, leftmost first, is popped until none is left.
"""

from __future__ import annotations

import functools
import json
import os
import re
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from logloom.llm.arrow_text import WordTable, distinct_words, map_texts, split_words, sums_by_row

#: Words whose count a worker remembers (about 20 MB), and the longest such word in characters.
REMEMBERED, SHORT = 600_000, 48


class PairMerger:
    """Counts what is left of a string of byte symbols after all merges."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        odd = [k for k in ("continuing_subword_prefix", "dropout", "unk_token", "byte_fallback", "ignore_merges") if model.get(k)]
        added = spec.get("added_tokens", [])
        odd += [t["content"] for t in added if t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"])]
        if model["type"] != "BPE" or odd:
            raise ValueError(f"not a plain byte-pair vocabulary: {path} {odd}")
        vocab, self.suffix = model["vocab"], model.get("end_of_word_suffix") or ""
        self.symbols = vocab
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"])))) if added else None
        library = Tokenizer.from_file(path)
        self.normalise = library.normalizer.normalize_str if library.normalizer else str
        self.split = library.pre_tokenizer.pre_tokenize_str

    def merged(self, pre_token: str) -> int:
        """Symbols of one pre-token after merging; ``pre_token`` has a character a byte."""
        get = self.symbols.get
        symbols = [get(c) for c in pre_token[:-1]] + [get(pre_token[-1] + self.suffix)]
        symbols = [s for s in symbols if s is not None]
        n = len(symbols)
        if n < 2:
            return n
        pairs, after, before = self.pairs, list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], i, found[1]) for i in range(n - 1) if (found := pairs.get((symbols[i], symbols[i + 1])))]
        heapify(heap)
        left = n
        while heap:
            rank, i, new = heappop(heap)
            j = after[i]
            if j >= n or symbols[i] < 0 or pairs.get((symbols[i], symbols[j])) != (rank, new):
                continue  # a neighbour has been merged since
            symbols[i], symbols[j] = new, -1
            after[i] = k = after[j]
            left -= 1
            if k < n:
                before[k] = i
                if found := pairs.get((new, symbols[k])):
                    heappush(heap, (found[0], i, found[1]))
            if (h := before[i]) >= 0 and (found := pairs.get((symbols[h], new))):
                heappush(heap, (found[0], h, found[1]))
        return left

    def count(self, word: str) -> int:
        """Tokens of a string; special strings inside it count one each."""
        total, parts = 0, [word]
        if self.special and self.special.search(word):
            total, parts = len(self.special.findall(word)), self.special.split(word)
        for part in parts:
            if part:
                total += sum(self.merged(piece) for piece, _ in self.split(self.normalise(part)) if piece)
        return total


@functools.lru_cache(maxsize=2)
def word_counter(path: str) -> WordTable:
    """Counts of words, remembered for short words; one table a worker process."""
    merger = PairMerger(path)
    return WordTable(lambda words: ([merger.count(w)] for w in words), REMEMBERED, SHORT)


def count_tokens(docs: DataFrame, vocabulary: str, *, text: str = "text", name: str = "n_tokens") -> DataFrame:
    """``docs`` with the number of tokens of every whole text (null or empty: 0).

    ``vocabulary`` is the path of the vocabulary file on every executor. Special strings in
    a text are one token each, as the library takes them by default; nothing is added or
    cut. A column with the new name gives way to it; an empty table gives an empty table.
    """

    def setup():
        count = word_counter(vocabulary)

        def counted(texts):
            words, before = split_words(texts)
            distinct, codes = distinct_words(words)
            counts = count(distinct)[0].astype(np.int64)
            return [pa.array(sums_by_row(counts[codes] if len(codes) else np.zeros(0, np.int64), before))]

        return counted

    return map_texts(docs, setup, [T.StructField(name, T.LongType())], text=text)


def with_limit(docs: DataFrame, vocabulary: str, *, text: str = "text", limit: int = 2048) -> DataFrame:
    """``n_bytes, n_tokens, over_limit`` of every text, beside the other columns except the text."""
    names = [c for c in docs.columns if c.lower() not in ("n_bytes", "n_tokens", "over_limit")]
    sized = docs.select(*names, F.octet_length(F.coalesce(F.col(text).cast("string"), F.lit(""))).cast("long").alias("n_bytes"))
    counted = count_tokens(sized, vocabulary, text=text)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit).drop(text)
