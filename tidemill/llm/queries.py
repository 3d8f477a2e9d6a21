"""The registered queries of the ten operators: thin digests of the operators' outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C
from .brown_lm import BASE_SQL as LM_SQL
from .chat_format import DIGEST_SQL as CHAT_SQL
from .conversation_trie import DIGEST_SQL as TRIE_SQL
from .decontamination import DIGEST_SQL as DECONTAMINATION_SQL
from .hard_negatives import DIGEST_SQL as NEGATIVES_SQL
from .language_id import BASE_SQL as LANGUAGE_SQL
from .license_scan import BASE_SQL as LICENSE_SQL
from .quality_rules import BASE_SQL as QUALITY_SQL
from .source_mix import DIGEST_SQL as MIX_SQL
from .substring_dedup import DIGEST_SQL as SUBSTRING_SQL


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify, learning_rows

    docs = C.table(spark, sf_dir, "documents")
    return identify(docs, learning_rows(docs))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import digest, scan

    return digest(scan(C.table(spark, sf_dir, "documents"), C.table(spark, sf_dir, "benchmark")))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import digest, read_back

    said = r"\### Assistant: </turn> ok"
    added = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    rows = C.table(spark, sf_dir, "conversations").select(*added.columns).unionByName(added)
    return digest(read_back(rows))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ngram_join import near_duplicates

    return near_duplicates(C.table(spark, sf_dir, "documents"))


def op5_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import compression_bands

    return compression_bands(C.table(spark, sf_dir, "documents"))


def op6_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .brown_lm import score

    docs = C.table(spark, sf_dir, "documents")
    held_out = F.coalesce(C.crc_mod(F.col("doc_id"), 5) == 1, F.lit(False))
    return score(docs, docs.where(~held_out), held_out)


def coded_digest(coded: DataFrame) -> DataFrame:
    """The counts and hashes of piece_codec.encode_decode()'s rows."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op7_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .piece_codec import encode_decode

    return coded_digest(encode_decode(C.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import scan

    return scan(C.table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import dedup_substrings

    kept = dedup_substrings(C.table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(C.table(spark, sf_dir, "pages"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hard_negatives import hard_negatives

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(C.table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 50 == 0)


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .conversation_trie import conversation_trie

    return conversation_trie(C.table(spark, sf_dir, "conversations")).drop("is_point")


def op13_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_mix import digest, phased, positions

    docs = C.table(spark, sf_dir, "documents")
    return digest(positions(docs, phased(docs)))


# --- the columns of operators 1, 5, 6 and 8 that SQL can express -----------------------------------


def base_columns_1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_language_id(spark, sf_dir).select("doc_id", "held_out", (F.col("lang_pred") == "und").alias("undetermined"))


def base_columns_5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op5_compression_bands(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def base_columns_6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op6_brown_lm(spark, sf_dir).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


def base_columns_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_decontamination, op3_chat_format, op4_ngram_join, op5_compression_bands,
        op6_brown_lm, op7_piece_codec, op8_license_scan, op9_substring_dedup, op10_html_extraction, op11_hard_negatives, op12_conversation_trie, op13_source_mix,
        base_columns_1, base_columns_5, base_columns_6, base_columns_8,
    )
}

#: Oracle SQL for those of QUERIES that SQL expresses.
ORACLE_SQL: dict[str, str] = {"op2_decontamination": DECONTAMINATION_SQL, "op3_chat_format": CHAT_SQL, "op9_substring_dedup": SUBSTRING_SQL, "op11_hard_negatives": NEGATIVES_SQL, "op12_conversation_trie": TRIE_SQL, "op13_source_mix": MIX_SQL, "base_columns_1": LANGUAGE_SQL, "base_columns_5": QUALITY_SQL, "base_columns_6": LM_SQL, "base_columns_8": LICENSE_SQL}
