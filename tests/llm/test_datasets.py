"""Merkle proofs, source mixing and fill-in-middle examples against brute force, with odd rows among ordinary ones."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from logloom.llm import fill_in_middle, merkle, mixing, ordering, queries

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def rows():
    texts = ["", None, " ", "\n\t x", "one", "é 漢 😀 y", "a <S> b", "tail \n", "w " * 30000, "<", "<P", "\x1c\x1d a\x00b", "  lead and  tail  "]
    out = [(i, t, ["en", None, "", "de"][i % 4], ["b", "a", None, ""][i % 4 if i % 5 else 0], None if t is None else len(t)) for i, t in enumerate(texts)]
    out += [(100 + i, f"document number {i} " * (i % 7 + 1), "en", "big", i) for i in range(700)]
    out += [(3, "same", "en", "b", 4)] * 5 + [(3, "other", "en", "b", 5), (None, "no id", "en", "big", None), (None, None, None, None, None), (-5, "x", "Zz", "é", 1), (7, "y", "ä", "z", 2)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    # Columns that bear the names of outputs and of helpers.
    data = [(*r, "v", "v", 1, "v", 2, "v") for r in rows]
    return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, path string, root string, n long, size string, pos long, `a.b` string").repartition(5)


@pytest.fixture(scope="module")
def sql_view(spark, docs):
    import duckdb

    con = duckdb.connect()
    con.register("given", docs.select("doc_id", "text", "lang", "source", "n_chars").toArrow())
    con.execute("CREATE TABLE documents AS SELECT * FROM given")
    return con


def tree(leaves):
    """Levels of a tree, leaves first."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        at = levels[-1]
        levels.append([digest("".join(at[i:i + 2])) for i in range(0, len(at), 2)])
    return levels


def siblings(levels, at):
    """The sibling at every level below the root, None for a node alone."""
    return [level[s] if (s := (at >> k) ^ 1) < len(level) else None for k, level in enumerate(levels[:-1])]


def proofs(rows):
    """leaf, subroot, root, siblings, by row."""
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: digest("".join(map(told, (r[0], r[3], r[2], r[4], r[1]))))
    groups = defaultdict(list)
    for r in rows:
        groups[r[2]].append((r[0] is not None, r[0] or 0, leaf(r)))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(groups[g])]) for g in groups}
    top = tree([trees[g][-1][0] for g in order])
    for k, g in enumerate(order):
        for at, (known, doc, own) in enumerate(sorted(groups[g])):
            path = siblings(trees[g], at) + siblings(top, k)
            yield doc if known else None, own, trees[g][-1][0], top[-1][0], digest("".join(s for s in path if s))


@pytest.mark.parametrize("block, limit", [(8, 4 << 20), (2, 0)])
def test_proofs(docs, rows, monkeypatch, block, limit):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", block)
    monkeypatch.setattr(merkle, "BROADCAST_BYTES", limit)
    leaf = merkle.leaf_of(*map(F.col, ("doc_id", "source", "lang", "n_chars", "text")))
    made = merkle.manifest(docs, leaf, keep=("doc_id", "n", "a.b", "path"))
    assert made.columns == ["doc_id", "n", "a.b", "leaf", "subroot", "root", "path"]
    got = made.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof"), merkle.fold(F.col("leaf"), F.col("path")).alias("back"),
                      merkle.fold(F.sha2(F.lit("forged"), 256), F.col("path")).alias("forged")).collect()
    assert Counter(tuple(r)[:5] for r in got) == Counter(proofs(rows))
    assert all(r.back == r.root != r.forged for r in got)


@pytest.mark.parametrize("n", [0, 1, 2, 3, 5, 8, 9])
def test_small_trees(spark, n):
    docs = spark.createDataFrame([(i, f"t{i}", "en", "s", i) for i in range(n)], "doc_id long, text string, lang string, source string, n_chars long")
    leaf = merkle.leaf_of(*map(F.col, ("doc_id", "source", "lang", "n_chars", "text")))
    got = merkle.manifest(docs, leaf).withColumn("proof", merkle.proof_digest(F.col("path"))).select("doc_id", "leaf", "subroot", "root", "proof").collect()
    assert Counter(map(tuple, got)) == Counter(proofs([tuple(r) for r in docs.collect()]))


def test_tampered_rows_fail(spark):
    got = queries.op11_merkle_manifest(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 200
    for r in got:
        assert r.verified == bool(zlib.crc32(str(r.doc_id).encode()) % 7) == (r.folded_root == r.root)


def shares(sizes, share=1.5, epochs=2):
    """Targets by dealing the excess anew until no source is above its bound."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, bounded = share * sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in bounded]
        left = total - sum(epochs * sizes[s] for s in bounded)
        target = {s: epochs * sizes[s] if s in bounded else left * weight[s] / sum(weight[x] for x in free) for s in order}
        over = {s for s in free if target[s] > epochs * sizes[s] + 1e-9}
        if not over:
            return target
        bounded |= over


@pytest.mark.parametrize("share", [1.5, 0.3, 2.0])
def test_mix(docs, rows, share):
    sizes, longest = Counter(), Counter()
    for doc, text, _, source, _ in rows:
        n = len(WORD.findall(text or ""))
        sizes[source] += n
        longest[source] = max(longest[source], n)
    want = shares(sizes, share)
    got = mixing.mix(docs, keep=("doc_id", "source", "a.b", "size"), share=share).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in got) == Counter((d, s, len(WORD.findall(t or ""))) for d, t, _, s, _ in rows)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-12, abs_tol=1e-9)
        assert r.taken == r.times * r.size and 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        # Whole epochs come first.
        assert not r.size or r.times - math.floor(r.target / r.source_size) in (0, 1)
    assert all(abs(taken[s] - want[s]) <= longest[s] / 2 for s in sizes)
    again = mixing.mix(docs.repartition(2, "text"), keep=("doc_id", "source", "a.b", "size"), share=share).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


def test_heavier_documents_come_first(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'s' AS source", "'word' AS text", "id % 2 AS good")
    mixed = mixing.mix(docs, keep=("doc_id", "good"), share=0.5, quality=F.when(F.col("good") == 1, 4.0).otherwise(1.0))
    n = {r.good: r.n for r in mixed.where("taken > 0").groupBy("good").agg(F.count("*").alias("n")).collect()}
    assert sum(n.values()) == 2000 and n[1] > 2.2 * n[0]


def test_running_sums_over_ranges(spark):
    rows = [(["a", None, "b"][i % 3] if i < 900 else "hot", i % 7, i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k long, v long").repartition(6)
    made = ordering.running(df, ["g"], [F.col("k"), F.col("v")], {"v": F.col("v")}).collect()
    assert len(made) == 3000
    for g in {r[0] for r in rows}:
        total = 0
        for r in sorted((r for r in made if r.g == g), key=lambda r: (r.k, r.v)):
            assert (r.v_before, r.v_total) == (total, sum(x[2] for x in rows if x[0] == g))
            total += r.v


def by_hand(doc, text):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    h = digest(f"42:{'' if doc is None else doc}")
    h1, h2, h3, h4 = (int(h[8 * i:8 * i + 8], 16) for i in range(4))
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    prefix, middle, suffix = ("".join(u) for u in (units[:low], units[low:high], units[high:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return doc, len(units), "plain", None, None, text, text
    if h4 % 100 < 80:
        return doc, len(units), "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}", text
    return doc, len(units), "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}", text


def test_examples(docs, rows):
    made = fill_in_middle.transform(docs)
    assert sorted(made.columns) == sorted([*[c for c in docs.columns if c != "n"], *[f.name for f in fill_in_middle.FIELDS]])
    got = made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", fill_in_middle.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert Counter(map(tuple, got)) == Counter(by_hand(d, t) for d, t, *_ in rows)
    assert {r.form for r in got} == {"plain", "spm", "psm"}


@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from("ab <PSM>\n\t\x0b\x1c "), st.characters(exclude_categories=["Cs"])), max_size=60), st.integers(0, 99), st.integers(0, 99), st.integers(0, 99))
def test_any_example_can_be_undone(text, first, second, fourth):
    n, form, prefix, middle, output = fill_in_middle.example(text, first, second, 0, fourth, rate=50, suffix_first=80)
    assert n == len(UNIT.findall(text))
    if form == "plain":
        assert output == text
    else:
        p, s, m = (output.index(x) for x in fill_in_middle.MARKS)
        parts = {"p": output[p + 3:s if form == "psm" else m], "s": output[s + 3:m if form == "psm" else p], "m": output[m + 3:]}
        assert parts["p"] + parts["m"] + parts["s"] == text and (len(parts["p"]), len(parts["m"])) == (prefix, middle)


@pytest.mark.parametrize("name", ["op11_merkle_manifest", "op12_source_mixing", "op13_fill_in_middle"])
def test_queries_say_the_same_as_their_sql(spark, docs, sql_view, tmp_path, name):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(str(tmp_path / "documents.parquet"))
    run = getattr(queries, name)
    want = sql_view.execute(queries.SQL[name])
    columns = sorted(c[0] for c in want.description)
    want = want.fetchdf()[columns].astype(object).where(lambda x: x.notna(), None).values.tolist()
    got = [[r[c] for c in columns] for r in run(spark, str(tmp_path)).collect()]
    tidy = lambda row: tuple(f"{float(v):.9g}" if isinstance(v, (int, float)) else str(v) for v in row)
    assert Counter(map(tidy, got)) == Counter(map(tidy, want))


def test_empty_tables(spark, docs, tmp_path):
    none = docs.where("false")
    assert merkle.manifest(none, merkle.leaf_of(F.col("text"))).count() == 0
    assert mixing.mix(none).count() == 0 and fill_in_middle.transform(none).count() == 0
    assert mixing.mix(docs.where("text is null")).where("taken <> 0 or target <> 0").count() == 0
