"""The corpus pipeline: five stages over documents, each written as Parquet and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tidemill.llm import common as C
from tidemill.llm import decontamination, language_id, ngram_join, piece_codec, queries, substring_dedup


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter and those that are in no learned language."""
    return language_id.keep_known(docs, language_id.learning_rows(docs))


def one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates, the document with the smallest doc_id stays."""
    return ngram_join.one_of_each_class(docs)


def repeats_removed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that a document with a smaller doc_id has too; the document stays, be it empty."""
    return substring_dedup.strip_substrings(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return decontamination.clean(docs, C.table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the hashes of the ids and of the decoded text."""
    import public_tokenizers

    return queries.coded_digest(piece_codec.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model")))


STAGES = [
    ("language ID", known_languages),
    ("n-gram Jaccard join", one_of_each_class),
    ("substring dedup", repeats_removed),
    ("benchmark decontamination", decontaminated),
    ("SentencePiece encoding and decoding", encoded),
]

#: SQL expresses neither the language model nor the tokenizer; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each stage but the last keeps is written to the shared folder."""
    docs = C.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = f"{C.shared_dir(spark)}/pipeline-{uuid.uuid4().hex}/{k}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
