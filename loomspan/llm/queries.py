"""The queries of this subpackage, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from . import alignment, chat, decontaminate, jaccard, language, packing, page_text, passages, rolling, sharding, token_output, toxicity, twins, vector_search


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.find(table(spark, sf_dir, "documents"), k=5, min_words=50, identity=0.8, near=None)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), learnable=lambda doc: toxicity.fold(doc) != 2)
    held_out = F.coalesce(toxicity.fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out")
    return toxicity.score(docs, model, threshold=0.3).select("doc_id", held_out, "score", "predicted")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(table(spark, sf_dir, "documents"), seq_len=2048, end_id=1)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language.fit(docs, learnable=language.fold("doc_id", 3) != 1)
    held_out = F.coalesce(language.fold("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return language.predict(docs, model).select("doc_id", held_out, "lang_pred", "score", "rejected")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard.jaccard_components(table(spark, sf_dir, "documents"), percent=85, k=4)
    return found.select("doc_id", "n_shingles", "component_id")


CONFLICT = "</s>[INST] ok [/INST]"


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONFLICT).alias("text")
    )
    found = chat.digest(chat.format_conversations(rows.unionByName(extra)))
    return found.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars")


def op7_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search.nearest(table(spark, sf_dir, "embeddings"), is_query=lambda i: i % 20 == 0, k=20)


def op8_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.main_text(table(spark, sf_dir, "pages"))


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_output.write_token_files(table(spark, sf_dir, "documents"), end_id=2)
    return token_output.read_token_files(manifest, digest=True)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.digest(table(spark, sf_dir, "documents"))


def event_seconds(doc_id):
    """The time that the rolling features give a document."""
    h = F.crc32(doc_id.cast("string")) % 4000
    return F.floor((doc_id + h) / 6).cast("long") * 60


def op12_rolling_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rolling.document_features(table(spark, sf_dir, "documents"), event_seconds(F.col("doc_id")), widths=(3600, 21600))


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(sharding.shard_rows(table(spark, sf_dir, "documents"), shards=40))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_substring_dedup": op1_substring_dedup, "op2_toxicity": op2_toxicity, "op3_packing": op3_packing, "op4_language_id": op4_language_id, "op5_jaccard_join": op5_jaccard_join, "op6_chat_format": op6_chat_format, "op7_vector_search": op7_vector_search, "op8_page_text": op8_page_text, "op9_token_output": op9_token_output, "op10_decontamination": op10_decontamination, "op11_token_alignment": op11_token_alignment, "op12_rolling_features": op12_rolling_features, "op13_sharding": op13_sharding}


def oracle_sql() -> dict[str, str]:
    return twins.oracle_sql()
