"""One query for each operator, over whole tables, with SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact_dedup, jaccard, language, mixing, pitman_yor, quality, sharding, substring_dedup, topk
from .shared import documents


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = bpe.encode(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN, decoded=True)
    return found.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return topk.search(vectors, vectors.where(F.col("vec_id") % 50 == 0), k=5)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(documents(spark, sf_dir), count_links=True)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op6_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(documents(spark, sf_dir))


def op7_lpt_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(documents(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.substring_dedup(documents(spark, sf_dir))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {f.__name__: f for f in (op1_source_mixing, op2_bpe, op3_topk_search, op4_jaccard_join, op5_quality, op6_pitman_yor, op7_lpt_sharding, op8_exact_dedup, op9_language, op10_substring_dedup)}

ORACLE = {
    "op1_source_mixing": r"""
        WITH d AS (
            SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   md5('17:' || doc_id || ':' || md5(coalesce(text, ''))) AS k
            FROM documents),
        s AS (
            SELECT source, sum(size)::BIGINT AS source_size,
                   1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w
            FROM d GROUP BY source),
        o AS (
            SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / w, w, source) AS i,
                   coalesce(sum(3 * source_size) OVER (ORDER BY 3.0 * source_size / w, w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
                   sum(w) OVER (ORDER BY 3.0 * source_size / w, w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
            FROM s),
        f AS (
            SELECT min(i) AS i FROM o
            WHERE ((SELECT sum(source_size) FROM s) - capped) * w / free <= 3 * source_size),
        t AS (
            SELECT o.source, o.source_size,
                   CASE WHEN o.i < f.i THEN (3 * o.source_size)::DOUBLE
                        ELSE ((SELECT sum(source_size) FROM s) - c.capped)::DOUBLE * o.w / c.free::DOUBLE END AS target
            FROM o, f JOIN o AS c ON c.i = f.i),
        b AS (
            SELECT *, least(round_even(target, 0), 3 * source_size)::BIGINT AS budget FROM t),
        p AS (
            SELECT d.doc_id, d.size, b.source_size, b.target, b.budget,
                   coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
            FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source)
        SELECT doc_id, size, source_size, target,
               (CASE WHEN source_size = 0 THEN 0
                     ELSE budget // source_size * size + greatest(0, least(size, budget % source_size - start)) END)::BIGINT AS taken
        FROM p""",
    "op8_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t)::BIGINT AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d""",
    "op10_substring_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50),
        k AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM p),
        m AS (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) < doc_id AS again FROM k),
        c AS (
            SELECT DISTINCT doc_id, unnest(generate_series(i, i + 49)) AS j FROM m WHERE again),
        x AS (SELECT doc_id, unnest(w) AS word, unnest(generate_series(1, len(w))) AS j FROM d),
        r AS (
            SELECT x.doc_id, count(c.j) AS n_removed, string_agg(x.word, ' ' ORDER BY x.j) FILTER (WHERE c.j IS NULL) AS kept
            FROM x LEFT JOIN c ON c.doc_id = x.doc_id AND c.j = x.j GROUP BY x.doc_id)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(r.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(r.kept, '')) AS kept_sha256
        FROM d LEFT JOIN r USING (doc_id)""",
    "op4_jaccard_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS g
            FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        o AS (
            SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
        e AS (
            SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
        r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON e.x = r.y),
        m AS (SELECT x, min(y) AS component_id FROM r GROUP BY x),
        l AS (SELECT x, count(*) AS n_links FROM e GROUP BY x)
        SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, coalesce(l.n_links, 0)::BIGINT AS n_links
        FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.x = d.doc_id LEFT JOIN l ON l.x = d.doc_id""",
    "op3_topk_search": r"""
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.x, c.x), lambda p: p[1] * p[2]))::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}
