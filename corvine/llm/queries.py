"""Queries of this package by name, each over the whole of its table, and their DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm import chat_format, conversation_repair, decontaminate, embedding_dedup, jaccard_join, language_id, license_scan, mixing, quality, token_output, toxicity, url_filters
from corvine.runtime import few_rows_per_batch, scratch_root, table


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    few_rows_per_batch(spark)
    return table(spark, sf_dir, "documents")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(_texts(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_texts(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "lang", "source", "copies")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge_urls(table(spark, sf_dir, "pages")).drop("n_candidates")


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents")).drop("detections")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    return quality.score_documents(docs, quality.fit(docs))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    return language_id.predict_languages(docs, language_id.fit(docs))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _texts(spark, sf_dir)
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(1).select(F.explode(F.array(*[
        F.struct(F.lit(-1).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role"), F.lit(said).alias("text"))
        for i, r in enumerate(("user", "assistant"))
    ])).alias("r")).select("r.*")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    out = chat_format.read_back(chat_format.format_conversations(rows))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid", F.col("first_bad_turn").cast("long").alias("first_bad_turn"),
    )


def damaged_turns(conversations: DataFrame) -> DataFrame:
    """Rows with one of five kinds of damage, chosen by the checksum of conversation and turn; nulls are one space."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), (F.crc32(F.concat_ws(":", text("conv_id"), text("turn"))) % 20).alias("kind")).where("kind <> 0")
    marred = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.withColumns({"text": marred, "role": F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))})
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("copy", "kind")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    few_rows_per_batch(spark)
    rows = table(spark, sf_dir, "conversations")
    out = conversation_repair.repair_conversations(damaged_turns(rows))
    lines = F.array_join(F.transform("repaired", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    out = out.select(F.col("conv_id").alias("_id"), *conversation_repair.COUNTS, "audit", F.sha2(lines, 256).alias("repaired_sha256"))
    every = rows.select("conv_id").distinct()
    out = every.join(out, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    return out.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in conversation_repair.COUNTS],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op12_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The files stay in a folder of their own under the shared one."""
    path = f"{scratch_root(spark)}/tokens-{uuid.uuid4().hex}"
    token_output.write_token_blocks(_texts(spark, sf_dir), path)
    return token_output.read_token_blocks(spark, path, digest_only=True)


QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_jaccard_join, op3_mixing, op4_url_filters, op5_embedding_dedup, op6_license_scan, op7_quality, op8_language_id, op9_toxicity, op10_chat_formatting,
    op11_conversation_repair, op12_token_output,
)}
