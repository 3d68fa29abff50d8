"""A training corpus in five stages, from raw documents to token ids.

Each stage takes all that the one before kept, as a Parquet table, and its
decisions take effect; all but the last return the columns of ``documents``.

1. ``language_id``: each document gets its predicted language; those in none of
   the learned languages (no text, no letter, or a score below the floor) go.
2. ``exact_dedup``: of equal texts (white space aside) the smallest id stays.
3. ``near_dedup``: of documents linked by a Jaccard similarity of at least 0.75
   of their five-word shingles, the smallest id stays.
4. ``mixing``: sources are taken to their target weights; documents repeat by
   epochs, and the one that meets a source's cut is taken in part.
5. ``bpe``: byte-level BPE ids, decoded again as a proof.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keystrand.llm import bpe, exact_dedup, jaccard, language, mixing
from keystrand.llm.shared import documents, written


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.accepted(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.survivors(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.survivors(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    taken = mixing.mixed(docs)
    if "n_chars" in docs.columns:  # a text may have been cut
        taken = taken.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))
    return taken


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per taken document: doc_id, n_tokens, ids, decoded_sha256."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    found = bpe.encode(docs, ranks, public_tokenizers.PATTERN, decoded=True)
    return found.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("bpe", encode)]

#: Language identification and BPE have no SQL form; the tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
