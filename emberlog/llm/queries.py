"""The queries of this subpackage, and SQL for those that SQL can express."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, jaccard_join, license_scan, mixing, packing, quality_rules, secret_scan, token_counts, topk_search, toxicity
from .common import spool


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: An insertion, a deletion and a replacement for every document, at places that depend on its length.
EDITS = """array(
 named_struct('position', cast(length(text) div 3 as int), 'removed', 0, 'inserted', ' a revised sentence, added in 2024.\\n'),
 named_struct('position', cast(length(text) div 2 as int), 'removed', 40, 'inserted', ''),
 named_struct('position', cast(length(text) * 9 div 10 as int), 'removed', 5, 'inserted', 'naïve'))"""


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    trees = spool(token_counts.plant(_read(spark, sf_dir, "documents")))
    found = token_counts.edit(trees, EDITS)
    return found.select(F.col("id").alias("doc_id"), F.col("n_tokens_before").alias("n_tokens"), F.col("n_tokens").alias("n_tokens_edited"), "n_edits", "encoded_chars", "tree_chars", "tree_tokens")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.line_frequency(_read(spark, sf_dir, "documents"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & ~F.col("depleted")).alias("kept"), "removed_words")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    segments, _, paths = chat_format.forest(turns)
    return chat_format.read_back(segments, paths)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.mix(_read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(_read(spark, sf_dir, "documents"))
    text = lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])
    base = F.filter("spans", lambda x: x["kind"].isin(*secret_scan.KINDS[:3]))
    counts = [F.size(F.array_remove(F.transform("spans", lambda x: x["kind"] == kind), F.lit(False))).cast("long").alias(f"n_{kind}") for kind in secret_scan.KINDS[:3]]
    return found.select("doc_id", *counts, F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", text), ",").alias("spans"))


def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _read(spark, sf_dir, "embeddings")
    good = vectors.filter(topk_search.usable("embedding"))
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    return topk_search.top_k(good.select("vec_id", whole.alias("vector")), "vec_id % 50 = 0")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents")).drop("detections")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents")).drop("ids")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (toxicity.fold("doc_id") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(_read(spark, sf_dir, "documents"), width=3, percent=90)


QUERIES = {f.__name__: f for f in (op1_token_counts, op2_quality_rules, op3_chat_formatting, op4_mixing, op5_secret_scan, op6_topk_search, op7_license_scan, op8_packing, op9_toxicity, op10_jaccard_join)}

W = r"[^\x20\x09-\x0D]+"

ORACLE_SQL = {
    "op2_quality_rules": rf"""
WITH d AS (SELECT doc_id, source, row_number() OVER () AS rid, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '{W}') AS w FROM d),
g AS (SELECT rid, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM w, unnest(generate_series(1, len(w) - 2)) u(i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM g) WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, unnest([0, 1, 2]) u(k) GROUP BY rid),
l AS (SELECT rid, doc_id, source, pos, line, len(regexp_extract_all(line, '{W}')) AS nw,
  translate(trim(regexp_replace(line, '[\x20\x09-\x0D]+', ' ', 'g')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM (SELECT rid, doc_id, source, string_split(t, chr(10)) AS ls FROM d), unnest(ls) WITH ORDINALITY u(line, pos)),
r AS (SELECT * FROM l WHERE nw > 0),
dup AS (SELECT rid, sum(CASE WHEN k > 1 THEN 1 ELSE 0 END) AS n FROM (SELECT rid, row_number() OVER (PARTITION BY rid, line ORDER BY pos) AS k FROM r) GROUP BY rid),
above AS (SELECT source, norm FROM r GROUP BY source, norm HAVING count(DISTINCT coalesce('d' || doc_id, 'r' || rid)) > 20),
lost AS (SELECT rid, sum(nw) AS n FROM r JOIN above a ON r.source IS NOT DISTINCT FROM a.source AND r.norm = a.norm GROUP BY rid),
f AS (SELECT doc_id, CAST(len(w.w) AS BIGINT) AS n_words,
  CAST(coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS removed_words
  FROM d JOIN w USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN lost USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (100 * removed_words > 50 * n_words) AS kept, removed_words FROM f""",
    "op3_chat_formatting": r"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations UNION ALL
  SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
e AS (SELECT *, length(replace(replace(replace(replace(replace(text, '\', '\\'), '</s>', '<\/s>'), '<s>', '<\s>'), '[/INST]', '[\/INST]'), '[INST]', '[\INST]')) AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n + length(role) + length('<s>[INST][/INST]</s>')) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id""",
    "op6_topk_search": r"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, q.v AS v, c.vec_id AS vec_id, CAST(list_sum(list_transform(generate_series(1, len(q.v)), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v WHERE vec_id % 50 = 0) q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, v ORDER BY score DESC, vec_id) AS rank FROM p) WHERE rank <= 5""",
    "op10_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{W}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN w ELSE w[i:i + 2] END AS g FROM d, unnest(generate_series(1, greatest(1, len(w) - 2))) u(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 90 * (a.n + b.n - k)),
both_ways AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT r.doc_id, b.y FROM reach r JOIN both_ways b ON b.x = r.other)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) m USING (doc_id)""",
}
