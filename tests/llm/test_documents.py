"""Operators over documents against brute force, with odd rows among ordinary ones."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from logloom.llm import components, contamination, line_dedup, near_duplicates, pii, quality_compression, quality_rules, queries, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def words(text):
    return WORD.findall(text or "")


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(["alpha", "bé", "γάμμα", "delta,", "Eps.", "zeta", "eta", "theta"]) + str(r.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base, other = prose(1, 120), prose(2, 90)
    near = base.split(" ")
    near[60] = "changed"
    out = [(1, base), (2, base), (3, " ".join(near)), (4, base + " tail"), (5, other), (6, other[:200] + "\n" + prose(3, 60)), (7, None), (8, ""), (9, " \n\t"), (10, "one"),
           (11, "one"), (12, "x " * 3000), (13, "aé b " * 400 + base), (None, base), (None, None), (14, "\x00   x"), (5, other), (5, other), (15, prose(9, 30000))]
    out += [(100 + i, f"Shared Line \nown {i}\n\nshared line\n \x0bSHARED LINE\x1f") for i in range(12)]
    return out + [(200 + i, prose(50 + i, 60)) for i in range(12)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(d, t, "n", i, "v") for i, (d, t) in enumerate(rows)]
    return spark.createDataFrame(data, "doc_id long, text string, n_lines string, k1 long, pii_spans string").repartition(3)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


def test_lines(docs, rows, empty):
    keys = lambda t: [x.strip(" \t\n\x0b\x0c\r").translate({c: c + 32 for c in range(65, 91)}) for x in (t or "").split("\n")]
    for min_chars, shard in ((1, 1 << 18), (5, 1)):
        count = Counter(k for _, t in rows for k in set(keys(t)) if len(k) >= min_chars)
        want = []
        for d, t in rows:
            gone = [len(k) >= min_chars and count[k] >= 10 for k in keys(t)]
            want.append((d, "\n".join(x for x, g in zip((t or "").split("\n"), gone) if not g), len(gone), sum(gone)))
        got = line_dedup.drop_shared_lines(docs, min_chars=min_chars, shard_keys=shard)
        assert set(got.columns) == {"doc_id", "text", "n_lines", "k1", "pii_spans", "n_dropped"}
        assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == Counter(want)
    assert line_dedup.drop_shared_lines(empty).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.sets(st.integers(0, (1 << 64) - 1), max_size=500))
def test_perfect_hash(keys):
    keys = np.array(sorted(keys), np.uint64)
    hashed = line_dedup.PerfectHash.build(keys)
    assert sorted(hashed.index(keys).tolist()) == list(range(len(keys))) and hashed.size == len(keys)


@pytest.mark.parametrize("sizes", [{}, {"group_runs": 1}, {"part_runs": 1}])
def test_substrings(docs, rows, empty, sizes):
    count = Counter(tuple(w[i:i + 35]) for _, t in rows for w in [words(t)] for i in range(len(w) - 34))
    want = []
    for d, t in rows:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - 34):
            if count[tuple(w[i:i + 35])] > 1:
                gone[i:i + 35] = [True] * 35
        want.append((d, " ".join(x for x, g in zip(w, gone) if not g), len(w), sum(gone)))
    got = substring_dedup.drop_repeats(docs, **sizes).collect()
    assert Counter((r.doc_id, r.text, r.n_words, r.n_removed) for r in got) == Counter(want)
    if not sizes:
        assert substring_dedup.drop_repeats(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=14), max_size=5), st.integers(2, 6))
def test_runs_hold_every_repeat(texts, window):
    """Windows with equal words meet in runs of one k-gram, and each window is in one run."""
    hashes = np.array([h * 7919 + 13 for t in texts for h in t], np.uint64)
    before = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    rows, first, counts, gram, _ = substring_dedup.runs_of(hashes, before, window)
    of = defaultdict(set)
    seen = Counter()
    for r, f, n, g in zip(rows, first, counts, gram):
        for s in range(f, f + n):
            of[tuple(texts[r][s:s + window])].add(int(g))
            seen[r, s] += 1
    assert all(len(g) == 1 for g in of.values())
    assert seen == Counter({(i, s): 1 for i, t in enumerate(texts) for s in range(len(t) - window + 1)})


@pytest.mark.parametrize("blocks", [{}, {"node_block": 2, "exact_block": 2}])
def test_near_copies(docs, rows, empty, blocks):
    sets = [frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if (w := words(t)) else frozenset() for _, t in rows]
    texts = sorted(set(sets), key=lambda s: (len(s), sorted(s)))
    close = {s: [o for o in texts if o != s and s and len(s & o) >= 0.8 * len(s | o) - 1e-9] for s in texts}
    root = {s: s for s in texts}
    for _ in texts:
        for s in texts:
            root[s] = min([root[s], *(root[o] for o in close[s])], key=texts.index)
    got = near_duplicates.classes(docs.drop("k1"), keep=("doc_id", "text"), **blocks).collect()
    assert len(got) == len(rows)
    by_text = {t: s for (_, t), s in zip(rows, sets)}
    named = {}
    for r in got:
        s = by_text[r.text]
        assert r.n_links == len(close[s])
        assert named.setdefault(root[s], r.class_id) == r.class_id
    assert len(set(named.values())) == len(named)
    if not blocks:
        kept = near_duplicates.keep_one(docs)
        assert sorted(kept.columns) == sorted(docs.columns)
        assert sorted(root[by_text[r.text]] == root[by_text[rows[0][1]]] for r in kept.collect()).count(True) == 1 and kept.count() == len(named)
        assert near_duplicates.classes(empty).count() == 0 and near_duplicates.keep_one(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7), (5, 3), (5, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_prefixes_shorten_to_the_recall():
    assert near_duplicates.prefix_length(0.8, 0.5) > near_duplicates.prefix_length(0.8, 0.9999)
    assert near_duplicates.prefix_length(0.99, 0.5) == near_duplicates.DEPTH


def test_leaks(spark, docs, empty):
    item = "What did the grey heron carry over the frozen lake at dawn? A silver key wrapped in blue paper."
    w = item.split(" ")
    paraphrase = w[:3] + ["old"] + w[4:9] + ["big"] + w[9:]
    texts = [("exact", prose(31, 200) + " " + item.upper() + " " + prose(32, 50)), ("para", prose(33, 80) + "\n" + " ".join(paraphrase) + "\n" + prose(34, 80)),
             ("alone", item), ("half", prose(35, 60) + " " + " ".join(w[:6]) + " " + prose(36, 60))]
    more = spark.createDataFrame([(t, 900 + i) for i, (_, t) in enumerate(texts)], "text string, doc_id long")
    bench = spark.createDataFrame([(1, item, 0), (2, None, 0), (3, "", 0), (None, "...", 0), (4, prose(2, 90), 0)], "item_id long, text string, doc_id long")
    got = contamination.leaks(docs.select("text", "doc_id").unionByName(more), bench).collect()
    assert {r.doc_id for r in got if r.item_id == 1} == {900, 901, 902}
    assert {r.doc_id for r in got if r.item_id == 4} == {5} and len([r for r in got if r.item_id == 4]) == 3
    assert contamination.leaks(empty, bench).count() == 0 and contamination.leaks(docs, bench.where("item_id in (2, 3)")).count() == 0


def test_recall_of_leaks(spark):
    """Items put into random documents, as they are and changed, against the common subsequence with the whole document."""
    items = [(r.item_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.1/benchmark.parquet").collect()]
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("text is not null").orderBy("doc_id").select("text").collect()]
    r = random.Random(5)
    pool = [w for t in texts[:2000] for w in t.split()]
    planted = []
    for item_id, text in items:
        for kind in ["exact"] * 15 + ["inserted", "substituted"] * 8:
            w = text.split()
            for _ in range(len(w) // 4 if kind == "inserted" else 0):
                w.insert(r.randrange(len(w) + 1), r.choice(pool))
            for k in r.sample(range(len(w)), len(w) // 4) if kind == "substituted" else []:
                w[k] = r.choice(pool)
            d = r.choice(texts).split()[:400]
            at = r.randrange(len(d) + 1)
            planted.append((kind, item_id, " ".join(d[:at] + w + d[at:])))
    rows = [(-1, t) for t in texts] + [(i, t) for i, (_, _, t) in enumerate(planted)]
    df = spark.createDataFrame(pa.table({"doc_id": [d for d, _ in rows], "text": [t for _, t in rows]})).repartition(16)
    got = {(x.doc_id, x.item_id) for x in contamination.leaks(df, spark.createDataFrame(items, "item_id long, text string")).collect()}
    of, lost, tried = {i: contamination.terms_of(t) for i, t in items}, Counter(), Counter()
    for n, (kind, item_id, text) in enumerate(planted):
        own = of[item_id]
        if contamination.common_length(own, contamination.terms_of(text)) >= 0.7 * len(own):
            for key in (kind, f"{kind}, just above a power of two") if len(own) in {*range(17, 21), *range(33, 41)} else (kind,):
                tried[key] += 1
                lost[key] += (n, item_id) not in got
    print({k: f"{lost[k]} of {tried[k]} lost" for k in tried})
    assert len(tried) == 6 and lost["exact"] == 0
    assert all(lost[k] <= 0.003 * tried[k] for k in tried)


def test_documents_without_a_word_of_the_benchmark(spark):
    bench = spark.createDataFrame([(1, "grey herons carry silver keys"), (2, "lone")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "nothing of it"), (2, None), (3, "")], "doc_id long, text string")
    assert contamination.leaks(docs, bench).count() == 0
    got = contamination.leaks(docs.union(spark.createDataFrame([(4, "x grey herons carry silver keys y")], docs.schema)), bench).collect()
    assert [(r.doc_id, r.item_id, r.common) for r in got] == [(4, 1, 1.0)]


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 1000])
def test_running_sums(n):
    rows = np.random.default_rng(n).standard_normal((n, 5))
    assert np.allclose(contamination.running_sums(rows), np.concatenate([np.zeros((1, 5)), np.cumsum(rows, axis=0)]), atol=1e-4)
    assert contamination.running_sums(rows[:, :0]).shape == (n + 1, 0)


@pytest.mark.parametrize("n", [0, 1, 500, 20_000])
def test_blocks_are_the_matrix_of_passages(n):
    """Dense blocks, one under another, are the unit TF-IDF rows of all passages with a weighty word; none is large."""
    r = np.random.default_rng(n)
    terms, places, weights = r.integers(0, 300, n).astype(np.int32), np.sort(r.choice(4 * n, n, replace=False)), r.random(300) * (r.random(300) < 0.7)
    want = []
    for p in range(4 * n // contamination.PASSAGE + 1):
        row = np.bincount(terms[places // contamination.PASSAGE == p], minlength=300) * weights
        want += [row / np.linalg.norm(row)] if row.any() else []
    got = [np.zeros((0, 300))]
    for own, block in contamination._blocks(terms, places, weights):
        assert np.count_nonzero(block) < contamination.ENTRIES + contamination.PASSAGE
        got.append(np.zeros((len(block), 300)))
        got[-1][:, own] = block
    assert np.allclose(np.concatenate(got), np.array(want).reshape(-1, 300), atol=1e-6)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=12), st.lists(st.integers(0, 5), max_size=12))
def test_common_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert contamination.common_length(a, b) == best[-1][-1]


def simple_spans(text):
    """The four kinds by their patterns alone."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c in "0123456789"][::-1]
        if 13 <= len(d) <= 19 and sum(x if k % 2 == 0 else sum(divmod(2 * x, 10)) for k, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c in "0123456789" for c in m[0]) <= 15]


@settings(max_examples=1500, deadline=None)
@given(st.text(st.sampled_from("a9@.-+ 1234567890()%é_\n"), max_size=40))
def test_base_spans(text):
    assert pii.base_spans(text) == simple_spans(text)


def test_sanitising(spark, docs, rows, empty):
    texts = [f"{prose(60 + i, 12)} agent nightingale-x mail jd@ex.org now {prose(80 + i, 12)}" for i in range(4)]
    texts += [f"{prose(99, 8)} mail a@b.cc 4111-1111-1111-1111 at 10.0.0.1 or +1 (202) 555-0100!", "4111 1111 1111 1112", "@" * 5000 + "9" * 5000]
    df = docs.unionByName(spark.createDataFrame([(t, 500 + i) for i, t in enumerate(texts)], "text string, doc_id long"), allowMissingColumns=True)
    found = {r.doc_id: [tuple(s) for s in r.pii_spans] for r in pii.find(df, threshold=0.8).where("doc_id >= 500").collect()}
    for i, t in enumerate(texts):
        assert [s for s in found[500 + i] if s[0] != "term"] == simple_spans(t)
    for i in range(4):
        assert {texts[i][a:b] for k, a, b in found[500 + i] if k == "term"} >= {"agent", "nightingale-x"}
    assert not any(s[0] == "term" for s in found[504])
    clean = {r.doc_id: r.text for r in pii.sanitise(df).where("doc_id >= 500").collect()}
    assert "nightingale" not in clean[500] and "[EMAIL]" in clean[500]
    assert clean[504].endswith("mail [EMAIL] [CARD] at [IP] or [PHONE]!") and clean[505] == texts[5]
    assert pii.find(df).count() == len(rows) + len(texts) and pii.find(empty).count() == 0
    removed = {r.doc_id: r.text for r in pii.sanitise(df, remove_terms=True).where("doc_id = 500").collect()}
    assert "[TERM]" not in removed[500] and "nightingale" not in removed[500]


def test_terms_of_rare_entities(spark):
    """Disclosure by its formula over all documents, for entities of one, two and more texts."""
    texts = [prose(700 + i, 25) for i in range(300)]
    texts += ["Reached Nightingale-X, by jd@ex.org today. " + prose(41, 30) + " codename", f"{prose(42, 20)} kestrel +1 (202) 555-0100 {prose(43, 20)}",
              f"{prose(44, 20)} kestrel +12025550100 osprey {prose(45, 20)}"]
    texts += [f"{prose(46, 15)} robin 10.1.2.3 {prose(47, 15)}"] * 3 + [f"{prose(900 + i, 20)} heron 10.9.9.9 {prose(920 + i, 20)}" for i in range(5)] + ["heron", "", None]
    base = [[(pii.entity_key(k, t[a:b]), a, b) for k, a, b in simple_spans(t or "")] for t in texts]
    term = lambda w: w.strip(pii.EDGES).lower()
    with_entity, with_term, both, seen = Counter(), Counter(), Counter(), defaultdict(set)
    for t, spans in zip(texts, base):
        t = t or ""
        with_entity.update({e for e, _, _ in spans})
        with_term.update({term(w) for w in words(t)})
        at = [(m.start(), m.end()) for m in WORD.finditer(t)]
        free = [term(t[a:b]) if not any(a < y and x < b for _, x, y in spans) else "" for a, b in at]
        pairs = set()
        for e, x, y in spans:
            before, after = [w for (_, b), w in zip(at, free) if b <= x][-10:], [w for (a, _), w in zip(at, free) if a >= y][:10]
            pairs |= {(e, w) for w in before + after if w}
        both.update(pairs)
        for p in pairs:
            seen[p].add(t)
    n = len(texts)
    want = {}
    for (e, w), k in both.items():
        d = np.log(k * n / (with_entity[e] * (with_term[w] + max(0, 3 - len(seen[e, w]))))) / -np.log(with_entity[e] / n)
        if d >= 0.8:
            want[e, pii.term_key(w)] = d
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {(r.entity, r.term): r.disclosure for r in pii.disclosing_terms(df).collect()}
    assert got == pytest.approx(want)
    found = {r.doc_id: {texts[r.doc_id][s.start:s.end].lower() for s in r.pii_spans if s.kind == "term"} for r in pii.find(df).collect()}
    shown = {e: {w for w in with_term if (e, pii.term_key(w)) in want} for e in with_entity}
    for i, (t, spans) in enumerate(zip(texts, base)):
        assert found[i] == {term(w) for w in words(t)} & set().union(*(shown[e] for e, _, _ in spans))
    assert "nightingale-x" in found[300] and "codename" not in found[300]
    assert all("kestrel" in found[i] for i in (301, 302)) and all("robin" in found[i] for i in (303, 304, 305)) and all("heron" in found[i] for i in range(306, 311)) and not found[311]


def test_statistics(docs, rows, empty):
    def stats(t):
        t = t or ""
        w = words(t)
        count = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
        again = set()
        for i in range(len(w) - 7):
            if count[tuple(w[i:i + 8])] > 1:
                again |= set(range(i, i + 8))
        lines = [x for x in t.split("\n") if words(x)]
        return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(again)

    got = quality_rules.text_stats(docs).collect()
    assert Counter(tuple(r)[:6] for r in got) == Counter((d, *stats(t)) for d, t in rows)
    labels = docs.sparkSession.createDataFrame([(1, 1, 0), (1, 0, 0), (12, 0, 0), (None, 1, 0), (15, None, 1), (5, 7, 0)], "doc_id long, quality int, toxic int")
    judged = {r.doc_id: r for r in quality_rules.judge(docs, labels).collect()}
    assert judged[12].base_failed and not judged[12].kept and judged[7].base_failed and judged[15].kept
    assert quality_rules.judge(empty, labels).count() == 0 and quality_rules.judge(docs, labels.where("false")).where("kept").count() > 0


@pytest.fixture(scope="module")
def labelled(spark):
    r = random.Random(4)
    rows = []
    for i in range(900):
        t = prose(1000 + i, r.randrange(30, 90))
        bad = i % 5 == 0
        if bad:
            t = " ".join(w + "***" for w in t.split(" ")) if i % 2 else t.upper().replace(" ", "!! ")
        rows.append((i, t, 0 if bad else 1))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_rules_learn(labelled):
    half = labelled.where("doc_id % 3 <> 2").select("doc_id", "quality")
    wrong = quality_rules.judge(labelled, half).join(labelled, "doc_id").where("doc_id % 3 = 2 and kept <> (quality = 1)").count()
    assert wrong <= 6
    stats = quality_rules.text_stats(labelled).join(half, "doc_id")
    rules = quality_rules.learn(stats.withColumn("salt", F.col("doc_id")).withColumn("bad", (1 - F.col("quality")).cast("long")))
    assert rules and all(len(r) <= 3 for r in rules)


def test_compression_learns(labelled, docs, empty):
    held = quality_compression.held_out()
    model = quality_compression.fit(labelled, labelled.select("doc_id", "quality"), usable=~held)
    got = quality_compression.score(labelled.where(held), model).collect()
    assert sum((r.score >= 0.7) != (r.quality == 1) for r in got) <= 0.03 * len(got)
    odd = {r.doc_id: r.score for r in quality_compression.score(docs, model).collect()}
    assert all(0 <= s <= 1 for s in odd.values()) and odd[7] == odd[8] and odd[1] == odd[2]
    assert quality_compression.score(empty, model).count() == 0
    alone = quality_compression.fit(labelled, labelled.select("doc_id", F.lit(1).alias("quality")))
    assert {round(r.score, 2) for r in quality_compression.score(docs, alone).collect()} == {1.0}
    none = quality_compression.fit(labelled, labelled.where("false").select("doc_id", "quality"))
    assert {r.score for r in quality_compression.score(docs, none).collect()} == {0.5}


def test_bounds_of_dictionaries(labelled):
    labels = labelled.select("doc_id", "quality")
    small = quality_compression.fit(labelled, labels, chunks_kept=1, dictionary_bytes=4096)
    assert 0 < len(small.good) <= 4096 and 0 < len(small.bad) <= 4096
    named = quality_compression.fit(labelled, labels, chunks_kept=8, dictionary_bytes=1 << 16)
    assert named == quality_compression.fit(labelled, labels) and len(named.good) > 4096


@pytest.mark.parametrize("name", list(queries.SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    want = con.execute(queries.SQL[name])
    names = [d[0] for d in want.description]
    assert Counter(tuple(r[n] for n in names) for r in got.collect()) == Counter(want.fetchall()) and sorted(names) == sorted(got.columns)


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    held, sizes = docs, [docs.count()]
    for name, step in corpus_pipeline.STAGES[:-1]:
        held = step(spark, held, SF).cache()
        assert held.columns == columns
        sizes.append(held.count())
    assert sizes[2] == sizes[1] < sizes[0] and sizes[4] <= sizes[3] <= sizes[2]
    texts = [r.text for r in held.collect()]
    assert len(set(texts)) == len(texts)
    items = [" ".join(contamination.terms_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert not any(i in " ".join(contamination.terms_of(t)) for t in texts for i in items)
    packed = corpus_pipeline.STAGES[-1][1](spark, held, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in held.select("doc_id").collect()}
    run = corpus_pipeline.run(spark, SF)
    digest = lambda df: hashlib.md5(repr(sorted(tuple(r) for r in df.select("doc_id", "start", "length", "ids_crc32").collect())).encode()).hexdigest()
    assert digest(run) == digest(packed)


def test_stages_return_what_they_were_given(spark, rows):
    """Columns with the names of outputs, dots and backquotes; null, empty and repeated rows; an empty table."""
    names = ["doc_id", "text", "lang", "source", "n_chars", "score", "n_lines", "n_dropped", "a.b", "back`quote", "row", "k1", "set_id", "text_key", "cosine"]
    data = [(d, t, "en", "s", None if t is None else len(t), *[f"{i}:{n}" for n in names[5:]]) for i, (d, t) in enumerate(rows)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"c{i} string" for i in range(5, len(names)))).toDF(*names).repartition(3)
    given = {tuple(r)[5:] for r in docs.collect()}
    for name, step in corpus_pipeline.STAGES[:-1]:
        made = step(spark, docs, SF)
        assert made.columns == names, name
        got = made.collect()
        assert {tuple(r)[5:] for r in got} <= given and (name == "quality" or got), name
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got), name
        none = step(spark, docs.where("false"), SF)
        assert none.columns == names and none.count() == 0, name
    lines = corpus_pipeline.shared_lines(spark, docs, SF)
    assert lines.count() == len(rows) and lines.where("text is null").count() == 0
    kept = corpus_pipeline.near_copies(spark, docs, SF)
    assert Counter(tuple(r) for r in kept.collect()) == Counter(tuple(r) for r in corpus_pipeline.near_copies(spark, docs.repartition(5, "score"), SF).collect())
    packed = corpus_pipeline.STAGES[-1][1]
    assert packed(spark, docs, SF).select("doc_id").distinct().count() == len({d for d, _ in rows}) and packed(spark, docs.where("false"), SF).count() == 0
