"""The registered queries of this subpackage and their SQL, built from the modules beside it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eqloom.llm import ann, decontam, langid, line_dedup, minhash, packing, quality, substring, toxicity, warc
from eqloom.llm.common import crc_fold, scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(crc_fold("doc_id", 5) != 0), "toxic")
    return _judged(toxicity.score(docs, model), crc_fold("doc_id", 5) == 0, 0.5)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = quality.fit(docs, labels.where(crc_fold("doc_id", 4) != 2), "quality")
    return _judged(quality.score(docs, model), crc_fold("doc_id", 4) == 2, 0.7)


def _judged(scored: DataFrame, held_out, least: float) -> DataFrame:
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = crc_fold("doc_id", 3) == 1
    out = langid.identify(docs, langid.fit(docs.where(~held)))
    return out.select("doc_id", (crc_fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), lambda i: i % 20 == 0, k=20)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses are read with their payload and digested anew; revisits by their headers."""
    path = scratch(spark, "warc")
    warc.archive(_table(spark, sf_dir, "pages"), path)
    full = warc.read(spark, path).where("record_type = 'response'").withColumns({"payload_digest": F.sha1("payload"), "payload_bytes": F.length("payload").cast("long")})
    heads = warc.read(spark, path, payload=False).where("record_type = 'revisit'")
    return full.unionByName(heads).select(F.col("row_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), exact_chars=1)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op8_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.dedup_passages(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_toxicity, op2_minhash, op3_language, op4_packing, op5_quality, op6_lines, op7_warc, op8_passages, op9_ann, op10_decontamination)}

ORACLES: dict[str, str] = {
    "op2_minhash": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) END AS sh
  FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
b AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, z) AS (SELECT doc_id, doc_id FROM n UNION SELECT b.y, r.z FROM r JOIN b ON b.x = r.doc_id),
m AS (SELECT doc_id, min(z) AS component_id FROM r GROUP BY 1)
SELECT n.doc_id, n.n AS n_shingles, m.component_id, n.doc_id = m.component_id AS kept FROM n JOIN m USING (doc_id)""",
    "op7_warc": r"""
WITH p AS (SELECT page_id, sha1(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS head FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> head THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> head THEN head END AS refers_to
FROM m""",
    "op6_lines": r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(len(ls))) AS line, unnest(ls) AS raw FROM d),
t AS (SELECT doc_id, line, raw, lower(regexp_replace(raw, '^[ \t\n\r\v\f]+|[ \t\n\r\v\f]+$', '', 'g')) AS norm FROM l),
f AS (SELECT norm, min((doc_id, line)) AS pos FROM t WHERE norm <> '' GROUP BY norm),
long AS (SELECT * FROM f WHERE length(norm) >= 24),
v AS (SELECT norm, pos, norm AS v FROM long UNION ALL
  SELECT norm, pos, substr(norm, 1, i - 1) || substr(norm, i + 1) FROM (SELECT norm, pos, unnest(range(1, length(norm) + 1)) AS i FROM long)),
k AS (SELECT norm, pos, hash(v) AS v FROM v),
n AS (SELECT DISTINCT a.norm FROM k a JOIN k b ON a.v = b.v AND b.pos < a.pos AND levenshtein(a.norm, b.norm) <= 1),
g AS (SELECT t.*, n.norm IS NOT NULL OR (f.norm IS NOT NULL AND (t.doc_id, t.line) > f.pos) AS gone
  FROM t LEFT JOIN f ON t.norm = f.norm LEFT JOIN n ON t.norm = n.norm)
SELECT d.doc_id, CAST(CASE WHEN d.text IS NULL THEN 0 ELSE len(d.ls) END AS BIGINT) AS n_lines, CAST(count(*) FILTER (g.gone) AS BIGINT) AS n_removed,
  CASE WHEN d.text IS NOT NULL THEN sha256(coalesce(string_agg(g.raw, chr(10) ORDER BY g.line) FILTER (NOT g.gone), '')) END AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id, d.text, d.ls""",
    "op8_passages": r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g'), ' '), lambda x: x <> '') AS ws
  FROM documents),
n AS (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS s FROM w WHERE len(ws) >= 20),
k AS (SELECT doc_id, s, md5(array_to_string(ws[s:s + 19], ' ')) AS g FROM n),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY g ORDER BY doc_id, s) AS o FROM k) WHERE o > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS i FROM r),
e AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
x AS (SELECT e.doc_id, count(c.i) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY e.i) FILTER (c.i IS NULL), '') AS kept FROM e LEFT JOIN c ON e.doc_id = c.doc_id AND e.i = c.i GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN x ON x.doc_id = w.doc_id""",
}
