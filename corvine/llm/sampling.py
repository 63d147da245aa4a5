"""Bounded, repeatable training samples and hold-out marks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.runtime import broadcast_if_small, materialize, row_count

MAX_CLASSES, SALTS = 64, 64


def crc_mod(doc_id: Column, m: int) -> Column:
    """crc32 of the id as text, modulo m; a null id counts as the empty text."""
    return F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % m


def trainable(text: Column) -> Column:
    """Whether a text can be trained on: it is not null and holds a letter. Its length does not matter."""
    return F.coalesce(text.cast("string").rlike(r"\p{L}"), F.lit(False))


def labelled_sample(documents: DataFrame, marks: DataFrame, label: str, per_class: dict | int, seed: int = 7) -> DataFrame:
    """(label, text, _h) of at most ``per_class`` documents for each label, in no order; ``_h`` orders them repeatably.

    ``marks`` holds doc_id and a label that is not null, of :func:`trainable` texts only, else a winner without
    one would leave its place empty. Only ids are ranked, by a seeded hash, and their bounded number is
    sent to the texts, which stay with the executors. Of rows that share an id the smallest text counts.
    With more than ``MAX_CLASSES`` labels every label keeps its place and the number of rows for each shrinks.
    """
    most = max(per_class.values()) if isinstance(per_class, dict) else per_class
    keyed = marks.where("doc_id is not null").select("doc_id", label, F.xxhash64(F.lit(seed), "doc_id").alias("_h")).distinct().withColumn("_s", F.pmod("_h", F.lit(SALTS)))
    # a label may hold most rows: the best of each salted part first, then the best of those
    for by in ([label, "_s"], [label]):
        keyed = keyed.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy("_h", "doc_id"))).where(F.col("_r") <= most)
    ranked = keyed.select("doc_id", label, "_r")
    if isinstance(per_class, dict):
        ranked = ranked.where(F.col("_r") <= F.coalesce(*[F.when(F.col(label) == k, v) for k, v in per_class.items()], F.lit(0)))
    won = materialize(ranked.orderBy("_r", label).limit(MAX_CLASSES * most).select("doc_id", label), "won", 32)
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text")).where(trainable(F.col("text")))
    rows = rows.join(broadcast_if_small(won, row_count(won), 32), "doc_id").groupBy("doc_id", label).agg(F.min("text").alias("text"))
    return rows.select(label, "text", F.xxhash64(F.lit(seed), "doc_id").alias("_h"))
