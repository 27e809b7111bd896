"""The registered queries of this subpackage: name -> (Spark callable, SQL text or None)."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm import bpe, fingerprint, hmm, infill, langid, negatives, packing, repeats, simhash, topk, toxicity, url_filter, warc


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


RULES = (
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"), ("net", "/fr/", "block"),
)


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, RULES).select("page_id", "judged.*")


OP1_SQL = """
WITH rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
         ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
rest AS (
  SELECT row_number() OVER () AS n, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
hosts AS (
  SELECT n, page_id, regexp_extract(r, '^[^/?#]*') AS raw, r FROM rest),
parts AS (
  SELECT n, page_id,
    translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(r, length(raw) + 1), '^[^?#]*') AS path FROM hosts),
fits AS (
  SELECT p.page_id, p.host, p.path, r.*,
    row_number() OVER (PARTITION BY p.n ORDER BY length(rule_host) + length(rule_path) DESC NULLS LAST) AS k
  FROM parts p LEFT JOIN rules r
    ON (p.host = rule_host OR suffix(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path))
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(rule_verdict, 'allow') AS verdict FROM fits WHERE k = 1
"""


def op2_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint.compare_with_next(_table(spark, folder, "documents"))


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    manifest = warc.write_archives(_table(spark, folder, "pages"))
    return warc.read_archives(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id,
    payload_bytes >= 100 AND row_number() OVER (PARTITION BY payload_digest ORDER BY page_id) > 1 AS again
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first_id END AS refers_to
FROM f
"""


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_groups(_table(spark, folder, "documents"))
    return groups.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search_every(_table(spark, folder, "embeddings"), step=100, k=10)


OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, v FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY v) AS k FROM v WHERE vec_id % 100 = 0) WHERE k = 1),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM q JOIN v c ON c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
"""


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(_table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op7_hidden_markov(spark: SparkSession, folder: str) -> DataFrame:
    return hmm.train_and_score(_table(spark, folder, "documents"))


def op8_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs, path = _table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json")
    return bpe.round_trip(docs, path, bpe.build_lexicon(docs, path))


def op9_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _table(spark, folder, "labels").select("doc_id", "toxic"))
    return toxicity.classify(docs, model).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "toxicity.*")


def op10_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text", "lang")
    return langid.predict(docs, langid.train(docs)).select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "language.*")


def op11_repeats(spark: SparkSession, folder: str) -> DataFrame:
    done = repeats.remove_repeats(_table(spark, folder, "documents"))
    return done.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT r, doc_id, len(w) AS n, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
g AS (
  SELECT *, CASE WHEN i + 19 <= n THEN string_agg(word, ' ') OVER (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) END AS passage
  FROM t),
s AS (SELECT *, passage IS NOT NULL AND rank() OVER (PARTITION BY passage ORDER BY doc_id, i) > 1 AS again FROM g),
c AS (SELECT *, bool_or(again) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM s),
k AS (
  SELECT r, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept FROM c GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(_table(spark, folder, "embeddings"), anchors=F.col("vec_id") % 50 == 0, label=moved)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (
  SELECT vec_id, label, v FROM (
    SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY label, v) AS k FROM v WHERE vec_id % 50 = 0) WHERE k = 1),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, c.label = a.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM a JOIN v c ON c.vec_id <> a.vec_id AND len(c.v) = len(a.v)),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS place
  FROM s WHERE same),
n AS (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
    row_number() OVER (PARTITION BY p.anchor_id, place ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
  WHERE place <= 5)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def op13_infill(spark: SparkSession, folder: str) -> DataFrame:
    done = infill.transform(_table(spark, folder, "documents").select("doc_id", "text"), into="text")
    back = infill.restore(done, "text").select("doc_id", "text.*", "restored")
    return back.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2("restored", 256).alias("restored_sha256"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256(concat('42:', CAST(doc_id AS VARCHAR))) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
  FROM documents),
g AS (
  SELECT doc_id, t, u, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
    CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (
  SELECT doc_id, t, CAST(n AS BIGINT) AS n, form, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid,
    array_to_string(u[b + 1:], '') AS suf FROM c)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
    ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""


QUERIES = {
    "op1_url_filter": (op1_url_filter, OP1_SQL),
    "op2_fingerprint": (op2_fingerprint, None),
    "op3_warc": (op3_warc, OP3_SQL),
    "op4_simhash": (op4_simhash, None),
    "op5_topk": (op5_topk, OP5_SQL),
    "op6_packing": (op6_packing, None),
    "op7_hidden_markov": (op7_hidden_markov, None),
    "op8_bpe": (op8_bpe, None),
    "op9_toxicity": (op9_toxicity, None),
    "op10_language_id": (op10_language_id, None),
    "op11_repeats": (op11_repeats, OP11_SQL),
    "op12_hard_negatives": (op12_hard_negatives, OP12_SQL),
    "op13_infill": (op13_infill, OP13_SQL),
}
