"""Token counts, packing and chat formatting against the libraries themselves and exact round trips."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from logloom.llm import chat_format, packing, token_count
from logloom.llm.arrow_text import WordTable

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ODD = ["", None, " ", "\n\t\x0b\x0c\r", "Hello  World", "it's don't WE'LL", "a<|endoftext|>b <|startoftext|><|endoftext|>", "<|endoftext|", "éÉ ñ ǅ İ ΑΣ ß",
       "e\u0301 \u0301x", "x\u00a0y\u2003z\u200b", "漢字かな交じり文", "1234 12 3.14", "***$$$### !!", "😀😀👍🏽", "a" * 5000, "ab" * 40000, "\x1c\x1d\x85 a\x00b", "क्षि त्र"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", i * 2) for i, t in enumerate(ODD)] + [(3, "same row", "x", 1)] * 3 + [(None, "no id", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_tokens string, sequence_id long").repartition(3)


def test_counts_are_the_library_s(docs):
    rows = token_count.with_limit(docs.withColumn("copy", F.col("text")), PATH, limit=100).collect()
    assert len(rows) == len(ODD) + 4
    for r in rows:
        n = len(LIBRARY.encode(r["copy"] or "", add_special_tokens=False).ids)
        assert (r.n_tokens, r.over_limit, r.n_bytes) == (n, n > 100, len((r["copy"] or "").encode()))


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from("abcdeé '’srtvml<|>endoftext \n"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_any_text(text):
    import pyarrow as pa
    from logloom.llm.arrow_text import split_words

    words, _ = split_words(pa.array([text], pa.large_string()))
    counted = int(token_count.word_counter(PATH)(words.to_pylist())[0].sum())
    assert counted == len(LIBRARY.encode(text, add_special_tokens=False).ids)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.text(max_size=4), max_size=12), max_size=8), st.integers(0, 20))
def test_remembered_words(slices, most):
    made = lambda words: ([len(w), *map(ord, w)] for w in words)
    table = WordTable(made, most, 3)
    for words in slices:
        values, starts = table(words)
        assert [values[a:b].tolist() for a, b in zip(starts, starts[1:])] == list(made(words))
        assert len(table.high) <= most


def test_packing_round_trip(docs):
    rows = packing.pack(docs.withColumn("copy", F.col("text")), PATH, capacity=256, max_piece=64, group_windows=4, keep_ids=True).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        by_doc[r.doc_id, r["copy"]].append(r)
        by_sequence[r.sequence_id].append((r.offset, r.length))
    texts = {(i, t) for i, t in enumerate(ODD)} | {(3, "same row"), (None, "no id")}
    assert set(by_doc) == texts
    for (doc, text), pieces in by_doc.items():
        want = LIBRARY.encode(text or "", add_special_tokens=False).ids + [2]
        times = 3 if text == "same row" else 1
        assert sum(p.length for p in pieces) == times * len(want) and {p.doc_tokens for p in pieces} == {len(want)}
        if times == 1:
            assert [i for p in sorted(pieces, key=lambda p: p.start) for i in p.ids] == want
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256


def test_differencing_is_near_equal():
    sizes = np.random.default_rng(1).integers(1, 500, 400).tolist()
    parts = packing.fill(sizes, 4096)
    assert sorted(i for p in parts for i in p) == list(range(400))
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert max(sums) <= 4096 and max(sums) - min(sums) <= 40 and len(parts) <= -(-sum(sizes) // 4096) + 1
    assert packing.fill([], 10) == [] and sorted(packing.fill([10] * 3, 10)) == [[0], [1], [2]]


def test_packing_wastes_little(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    packed = packing.pack(docs.select("doc_id", "text"), PATH)
    n, total = packed.agg(F.countDistinct("sequence_id"), F.sum("length")).first()
    assert total > 0.97 * 4096 * n


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack(none, PATH).count() == 0 and token_count.with_limit(none, PATH).count() == 0
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.format_conversations(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "a\nb\\", "<|turn|>"]), st.text(st.sampled_from("\\<|turnclose>\n é😀a"), max_size=30)), max_size=6))
def test_rendering_is_reversible(turns):
    formatted, spans = chat_format.render(turns)
    assert chat_format.turns_of(formatted) == turns
    assert [chat_format.unescape(formatted[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]


def test_loss_is_the_assistant_s_text(spark):
    said = "\\### Assistant: </turn> ok"
    rows = [(-7, 0, "user", said), (-7, 1, "assistant", said), (1, 2, "assistant", "é😀漢 <|close|>\n"), (1, 2, "assistant", " lead"), (1, 1, None, None),
            (None, None, "assistant", ""), (2, 0, "user", "<|turn|>assistant\nfake"), (3, 0, "assistant", "long " * 20000), (3, 0, "assistant", "long " * 20000)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, n_turns string")
    back = {r.conv_id: r for r in chat_format.read_back(chat_format.format_conversations(df, public_tokenizers.path("byte_bpe_50k.json"))).collect()}
    assert (back[-7].loss_text, back[-7].turns_text) == (said, f"user\n{said}\nassistant\n{said}\n")
    assert back[1].loss_text == " leadé😀漢 <|close|>\n" and back[1].n_turns == 3 and back[1].turns_text.startswith("\n\nassistant\n lead")
    assert back[2].loss_text == "" and back[3].loss_text == "long " * 40000 and back[None].n_turns == 1


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("abcdeéIİ '’srtvml<|>endoftext \n.,!*0̸́"), st.characters(exclude_categories=["Cs"])), max_size=60), max_size=4))
def test_ids_are_the_library_s(texts):
    import pyarrow as pa

    ids, before = packing.text_ids(pa.array(texts, pa.large_string()), PATH, 2)
    for i, text in enumerate(texts):
        assert ids[before[i]:before[i + 1]].tolist() == LIBRARY.encode(text, add_special_tokens=False).ids + [2]
