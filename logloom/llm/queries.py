"""The registered queries of this subpackage: every operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from logloom.llm import (
    chat_format, contamination, fill_in_middle, line_dedup, merkle, mixing, near_duplicates, packing, pii, quality_compression, quality_rules, substring_dedup,
    token_count)
from logloom.session import local_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    base = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return judged.select(*base)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"))
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("pii_spans", lambda s: s["kind"] != "term")
    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(told(base), 256).alias("base_sha256"), told(F.col("pii_spans")).alias("spans"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_shared_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = quality_compression.held_out()
    model = quality_compression.fit(docs, table(spark, sf_dir, "labels"), usable=~held_out)
    return quality_compression.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring_dedup.drop_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates.classes(docs).select("doc_id", "class_id", "n_links")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "first_word", "last_word", F.round("common", 6).alias("common"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    extra = local_table(spark, [(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    back = chat_format.read_back(chat_format.format_conversations(rows, public_tokenizers.path("byte_bpe_50k.json")))
    return back.select("conv_id", "n_turns", F.sha2("turns_text", 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
                       F.sha2("loss_text", 256).alias("loss_sha256"), "formatted_chars")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


def op10_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_count.with_limit(docs, public_tokenizers.path("word_bpe_49k.json"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    claimed = F.when(tampered, merkle.leaf_of(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text")))
    proofs = merkle.manifest(docs.withColumn("claimed", claimed), merkle.leaf_of(*map(F.col, docs.columns)), keep=("doc_id", "claimed"))
    folded = merkle.fold(F.coalesce("claimed", "leaf"), F.col("path"))
    return proofs.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest(F.col("path")).alias("proof_sha256"), folded.alias("folded_root")).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def op12_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_in_middle.transform(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fill_in_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_quality_rules, op2_pii, op3_line_dedup, op4_quality_classifier, op5_substring_dedup, op6_ngram_jaccard, op7_decontamination, op8_chat_format, op9_packing,
    op10_token_count, op11_merkle_manifest, op12_source_mixing, op13_fill_in_middle)}

SQL: dict[str, str] = {}

SQL["op3_line_dedup"] = r"""
WITH lines AS (
  SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
one AS (SELECT r, doc_id, ls, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM lines),
keyed AS (
  SELECT r, doc_id, i, l, translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM one),
shared AS (SELECT k FROM keyed WHERE k <> '' GROUP BY k HAVING count(DISTINCT r) >= 10),
marked AS (SELECT r, doc_id, i, l, keyed.k IN (SELECT k FROM shared) AS gone FROM keyed)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""

SQL["op5_substring_dedup"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
windows AS (
  SELECT r, i, array_to_string(list_slice(ws, i, i + 34), ' ') AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 33)) AS i FROM d WHERE len(ws) >= 35)),
twice AS (SELECT r, i AS start FROM windows WHERE k IN (SELECT k FROM windows GROUP BY k HAVING count(*) > 1)),
marked AS (
  SELECT r, i, word, coalesce(max(s) OVER (PARTITION BY r ORDER BY i) >= i - 34, FALSE) AS gone
  FROM (SELECT w.r, w.i, word, t.start AS s FROM w LEFT JOIN twice t ON t.r = w.r AND t.start = w.i))
SELECT doc_id, count(i)::BIGINT AS n_words, (count(*) FILTER (gone))::BIGINT AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM d LEFT JOIN marked USING (r) GROUP BY r, doc_id
"""

SQL["op8_chat_format"] = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, t.turn, t.role, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(turn, role)),
sized AS (
  SELECT *, length(replace(replace(text, '\', '\\'), '<|', '<\|')) + length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\' || chr(10)))
         + length('<|turn|>' || '<|close|>') + 2 AS n FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), ''))::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(n)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

SQL["op11_merkle_manifest"] = r"""
WITH RECURSIVE texts AS (
  SELECT row_number() OVER () AS r, doc_id, lang, n_chars,
         xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
                         lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) AS draw,
         coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail FROM documents),
d AS (
  SELECT r, doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
         sha256(head || coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') || tail) AS changed, draw % 7 = 0 AS tampered FROM texts),
l AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
nodes AS (
  SELECT lang, 0 AS level, pos, leaf AS digest, n FROM l
  UNION ALL
  SELECT lang, level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM nodes WHERE n > 1 GROUP BY lang, level, pos // 2, n),
subroots AS (
  SELECT lang, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, pos, digest, n FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2 FROM tops WHERE n > 1 GROUP BY level, pos // 2, n),
steps AS (
  SELECT l.r, own.level AS k, CASE WHEN other.digest IS NULL THEN '-' WHEN own.pos % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(other.digest, '') AS step
  FROM l JOIN nodes own ON own.lang IS NOT DISTINCT FROM l.lang AND own.pos = l.pos >> own.level AND own.n > 1
  LEFT JOIN nodes other ON other.lang IS NOT DISTINCT FROM own.lang AND other.level = own.level AND other.pos = xor(own.pos, 1)
  UNION ALL
  SELECT l.r, 1000 + own.level, CASE WHEN other.digest IS NULL THEN '-' WHEN own.pos % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(other.digest, '')
  FROM l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang JOIN tops own ON own.pos = s.pos >> own.level AND own.n > 1
  LEFT JOIN tops other ON other.level = own.level AND other.pos = xor(own.pos, 1)),
proofs AS (SELECT r, list(step ORDER BY k) AS path, sha256(string_agg(step[2:], '' ORDER BY k)) AS proof FROM steps GROUP BY r),
folded AS (
  SELECT l.*, coalesce(proof, sha256('')) AS proof_sha256,
         list_reduce(list_prepend(CASE WHEN tampered THEN changed ELSE leaf END, coalesce(path, [])),
                     lambda got, s: sha256(CASE s[1] WHEN 'L' THEN s[2:] || got WHEN 'R' THEN got || s[2:] ELSE got END)) AS folded_root
  FROM l LEFT JOIN proofs USING (r))
SELECT doc_id, leaf, s.digest AS subroot, t.digest AS root, proof_sha256, folded_root, folded_root = t.digest AS verified
FROM folded f JOIN subroots s ON s.lang IS NOT DISTINCT FROM f.lang JOIN tops t ON t.n = 1
"""

SQL["op12_source_mixing"] = r"""
WITH texts AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
sized AS (
  SELECT r, doc_id, source, len(regexp_extract_all(t, '[^\x20\x09-\x0D]+'))::BIGINT AS size, length(t) AS chars,
         ((('0x' || substr(md5('42:' || coalesce(doc_id::VARCHAR, '') || ':' || t), 1, 13))::UBIGINT)::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u FROM texts),
d AS (SELECT *, -ln(u) / CASE WHEN chars BETWEEN 4 * size AND 11 * size THEN 1::DOUBLE ELSE 0.25::DOUBLE END AS turn FROM sized),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM sources),
weighed AS (SELECT *, [5, 2, 1][place % 3 + 1]::BIGINT AS weight FROM placed),
summed AS (
  SELECT *, sum(weight) OVER o - weight AS weight_before, sum(source_size) OVER o - source_size AS words_before, sum(weight) OVER () AS weights, sum(source_size) OVER () AS words
  FROM weighed WINDOW o AS (ORDER BY source_size::DOUBLE / weight, place ROWS UNBOUNDED PRECEDING)),
levelled AS (
  SELECT *, (words::DOUBLE * 1.5::DOUBLE - words_before::DOUBLE * 2::DOUBLE) / (weights - weight_before)::DOUBLE AS level, source_size::DOUBLE * 2::DOUBLE AS bound FROM summed),
common AS (SELECT arg_min(level, row(source_size::DOUBLE / weight, place)) AS of_all FROM levelled WHERE level * weight::DOUBLE <= bound),
wanted AS (SELECT source, source_size, CASE WHEN level * weight::DOUBLE <= bound THEN of_all * weight::DOUBLE ELSE bound END AS target FROM levelled, common),
queued AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY turn, size, r ROWS UNBOUNDED PRECEDING) - size AS told FROM d),
met AS (
  SELECT q.*, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE)::BIGINT ELSE 0 END AS whole
  FROM queued q JOIN wanted w ON w.source IS NOT DISTINCT FROM q.source)
SELECT doc_id, size, source_size, target, ((whole + CASE WHEN told::DOUBLE + size::DOUBLE / 2 < target - (whole * source_size)::DOUBLE THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM met
"""

SQL["op13_fill_in_middle"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
         sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
  SELECT doc_id, t, units, len(units) AS n, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3,
         ('0x' || h[25:32])::UBIGINT AS h4 FROM d),
cut AS (
  SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                            WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form,
         coalesce(array_to_string(units[1:least(h1 % (n + 1), h2 % (n + 1))::BIGINT], ''), '') AS prefix,
         coalesce(array_to_string(units[least(h1 % (n + 1), h2 % (n + 1))::BIGINT + 1:greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT], ''), '') AS middle,
         coalesce(array_to_string(units[greatest(h1 % (n + 1), h2 % (n + 1))::BIGINT + 1:n], ''), '') AS suffix FROM drawn)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut
"""
