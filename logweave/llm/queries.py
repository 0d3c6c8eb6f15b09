"""Queries of the operators over their whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.llm.exact_dedup import exact_dedup, normalised
from logweave.llm import toxicity
from logweave.llm.centroids import centroid_clusters
from logweave.llm.html_extract import extract
from logweave.llm.jaccard_join import jaccard_join
from logweave.llm.langid import language_id
from logweave.llm.lexical import lexical_search
from logweave.llm.media import media_columns
from logweave.llm.packing import pack
from logweave.llm.sentencepiece import encoded_documents
from logweave.llm.simhash import simhash_dedup
from logweave.llm.substring_dedup import substring_dedup
from logweave.llm.warc import archive


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive(_read(spark, sf_dir, "pages"))
    return found.select(F.col("id").alias("page_id"), F.col("bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


OP1_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages
), g AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
FROM g
"""


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_documents(_read(spark, sf_dir, "documents"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(F.encode(normalised("text"), "UTF-8"), 256))
    return exact_dedup(docs, hash_col="text_sha256").select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP3_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT *, row_number() OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS place,
         count(*) OVER (PARTITION BY text_sha256) AS group_size,
         first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id
  FROM n
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, place = 1 AS kept, text_sha256 FROM r
"""


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_read(spark, sf_dir, "documents").select("doc_id", "text", "lang")).select("doc_id", "held_out", "lang_pred", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _read(spark, sf_dir, "labels").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return toxicity.predict(docs, toxicity.fit(docs, labels, ["low_quality", "toxic"])).drop("text")


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(_read(spark, sf_dir, "pages"))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(_read(spark, sf_dir, "documents"))


def op11_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(_read(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END)) AS s FROM w
), g AS MATERIALIZED (SELECT min(doc_id) AS rep, s FROM s WHERE len(s) > 0 GROUP BY s),
x AS (SELECT rep, len(s) AS n, unnest(s) AS t FROM g),
link AS MATERIALIZED (
  SELECT a.rep AS src, b.rep AS dst FROM x a JOIN x b ON a.t = b.t AND a.rep <> b.rep AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach(rep, least) USING KEY (rep) AS (
  SELECT rep, rep FROM g
  UNION SELECT dst, min(r.least) FROM reach r JOIN link ON src = r.rep JOIN recurring.reach old ON old.rep = dst WHERE r.least < old.least GROUP BY dst
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(least, s.doc_id) AS component_id FROM s LEFT JOIN g ON g.s = s.s LEFT JOIN reach USING (rep)
"""


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


OP12_SQL = r"""
WITH d AS (
  SELECT doc_id, w, count(*) AS tf FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM documents)
  GROUP BY doc_id, w
), b AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark
), n AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM d GROUP BY doc_id),
s AS (SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM n),
t AS (SELECT w, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM d, s GROUP BY w),
r AS (
  SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM b JOIN d USING (w) JOIN t USING (w) JOIN n USING (doc_id), s GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM r WHERE score > 0 QUALIFY rank <= 50
"""


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(_read(spark, sf_dir, "embeddings"))


def _op13_sql(k: int = 8, rounds: int = 10) -> str:
    """Each round as two relations: assignments, and the floors of the means, those of empty clusters from before."""
    out = f"""
WITH q AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
), h AS (SELECT *, row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS c FROM q),
c0 AS MATERIALIZED (SELECT c, v FROM h WHERE c < {k})"""
    for r in range(rounds + 1):
        out += f""",
a{r} AS MATERIALIZED (
  SELECT vec_id, any_value(v) AS v, arg_min(c, (d, c)) AS c, min(d) AS d
  FROM (SELECT vec_id, q.v, c, list_sum(list_transform(list_zip(q.v, z.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM q, c{r} z) GROUP BY vec_id
)"""
        if r < rounds:
            out += f""",
c{r + 1} AS MATERIALIZED (
  SELECT c, coalesce(m.v, z.v) AS v FROM c{r} z LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS v
    FROM (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY c, i) GROUP BY c) m USING (c)
)"""
    return out + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
       CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(z.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} z USING (c)
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_simhash_dedup": op4_simhash_dedup,
        "op5_langid": op5_langid,
        "op6_toxicity": op6_toxicity,
        "op7_substring_dedup": op7_substring_dedup,
        "op8_packing": op8_packing,
        "op9_html": op9_html,
        "op10_media": op10_media,
        "op11_jaccard_join": op11_jaccard_join,
        "op12_lexical": op12_lexical,
        "op13_centroids": op13_centroids,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_warc": OP1_SQL, "op3_exact_dedup": OP3_SQL, "op11_jaccard_join": OP11_SQL, "op12_lexical": OP12_SQL, "op13_centroids": _op13_sql()}
