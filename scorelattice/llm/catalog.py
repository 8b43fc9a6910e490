"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelattice.llm import decontam, embedding_dedup, lang_id, mixing, pii, quality, secrets, simhash, substring_dedup, token_counts
from scorelattice.llm.simhash_sql import OP8_SQL

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return lang_id.with_fold(lang_id.predict(docs, lang_id.train(docs, per_language=lang_id.TRAIN_DOCS)))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.apply_edits(token_counts.sample_edits(_table(spark, sf_dir, "documents")))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_table(spark, sf_dir, "documents"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.deduplicate(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(_table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.overlaps(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumn("items", F.array_join("items", ","))


def queries() -> dict[str, Query]:
    own = (op1_language, op2_quality, op3_token_counts, op4_secrets, op5_substring_dedup, op6_embedding_dedup, op7_pii, op8_simhash, op9_mixing, op10_decontamination)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {"op5_substring_dedup": OP5_SQL, "op6_embedding_dedup": OP6_SQL, "op8_simhash": OP8_SQL, "op10_decontamination": OP10_SQL}


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM d, unnest(range(1, len(w) - 11)) AS r(i)),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY win) AS first_doc FROM windows) WHERE first_doc < doc_id),
gone AS (SELECT DISTINCT doc_id, i + o AS p FROM repeated, unnest(range(0, 13)) AS r(o)),
words AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS r(p)),
kept AS (SELECT words.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY words.p) AS t FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p WHERE gone.p IS NULL GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""

OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / sqrt(list_dot_product(a.e, a.e) * list_dot_product(b.e, b.e)) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS y FROM v UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y),
component AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN component ON component.x = v.vec_id LEFT JOIN degree ON degree.x = v.vec_id
"""

# Every alignment of a document and an item by their equal words; of each its longest stretch with equal ends and
# enough equal words, found among all pairs of ends.
OP10_SQL = r"""
WITH marks AS (SELECT '!"#$%&''()*+,-./:;<=>?@[\]^_`{|}~' AS m),
d AS (SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT row_number() OVER () AS i, coalesce(item_id, -1) AS item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS ws FROM benchmark WHERE text IS NOT NULL),
dw AS (SELECT d, p, coalesce(nullif(trim(ws[p], m), ''), ws[p]) AS w FROM d, marks, unnest(range(1, len(ws) + 1)) AS r(p)),
iw AS (SELECT i, q, least(13, greatest(5, CAST(ceil(len(ws) * 8 / 10.0) AS BIGINT))) AS need, coalesce(nullif(trim(ws[q], m), ''), ws[q]) AS w FROM i, marks, unnest(range(1, len(ws) + 1)) AS r(q) WHERE len(ws) >= 5),
hits AS (SELECT d, i, p - q AS shift, q, need, row_number() OVER (PARTITION BY d, i, p - q ORDER BY q) AS rn, count(*) OVER (PARTITION BY d, i, p - q) AS n FROM dw JOIN iw USING (w)),
ends AS (SELECT * FROM hits WHERE 5 * n >= 4 * need),
best AS (SELECT a.d, a.i, a.shift, max(b.q - a.q + 1) AS words FROM ends a JOIN ends b ON b.d = a.d AND b.i = a.i AND b.shift = a.shift AND b.q >= a.q WHERE 5 * (b.rn - a.rn + 1) >= 4 * (b.q - a.q + 1) AND b.q - a.q + 1 >= a.need GROUP BY ALL),
found AS (SELECT d, count(*) AS n, max(words) AS longest, list_sort(list(DISTINCT item_id)) AS items FROM best JOIN i USING (i) GROUP BY d)
SELECT doc_id, n IS NOT NULL AS contaminated, coalesce(n, 0) AS n_overlaps, coalesce(longest, 0) AS longest, coalesce(array_to_string(items, ','), '') AS items FROM d LEFT JOIN found USING (d)
"""
