"""The queries of this subpackage, with production parameters over their whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from overlapse.llm import arrow_store, langid, mixing, ngram_join, pii, quality, sp_codec, token_counts, topk, urls
from overlapse.llm.common import table

BYTE_BPE, PIECE_BPE = "byte_bpe_50k.json", "piece_bpe_32k.model"


def vocabulary(name: str) -> str:
    """The place of an installed public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.url_filter(table(spark, sf_dir, "pages"))


def piece_digest(docs: DataFrame) -> DataFrame:
    """Each document encoded and decoded again: ids counted and summed up, and whether the text came back."""
    return sp_codec.round_trips(docs, vocabulary(PIECE_BPE))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digest(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    # a row without doc_id is held out: nothing is learned from it
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    net = langid.trained(docs.where(~out))
    return langid.language(docs, net).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), with_key=True)


def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    uri, shards = arrow_store.write_store(docs, vocabulary(BYTE_BPE))
    return arrow_store.read_store(spark, uri, shards, docs.schema["doc_id"].dataType)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary(BYTE_BPE))


def op10_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_url_filters, op2_sentencepiece, op3_ngram_jaccard_join, op4_quality_rules, op5_language_id, op6_pii, op7_mixing, op8_token_ids, op9_token_counts, op10_exact_top_k)
}
#: The others are tested against brute force, a round trip or held-out accuracy.
ORACLES = {"op3_ngram_jaccard_join": ngram_join.ORACLE, "op4_quality_rules": quality.ORACLE, "op7_mixing": mixing.ORACLE, "op10_exact_top_k": topk.ORACLE}
