"""Score retrieval over a document table: one row for each question and configuration, partitioned by both kinds.

    python -m jobs.evaluation_report [--config FILE] [--documents PATH] [--questions PATH] [--output PATH]

Questions (Parquet with item_id, text) expect the documents (Parquet with doc_id, text) that hold them verbatim. Each
configuration retrieves ``top_k`` documents; hits are scored as in tier 1 of the evaluation. The report is a Parquet
folder, partitioned by config and category (none, one or several expected documents). The whole report is replaced in
each run, so a run again gives the same rows, and configurations that are no longer asked for are gone.

Null texts are empty; an empty question finds nothing and expects nothing; without questions the report has no rows.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.config import RetrievalSettings
from corvine.functions.text import strip
from corvine.operators import containment, fusion
from corvine.plans import evaluate
from corvine.plans.retrieve import Corpus, branches
from corvine.runtime import materialize
from jobs.common import JobError, command_line

log = logging.getLogger("jobs.evaluation_report")

CASES = "id bigint, n_expected int, hit boolean, hit_rank int, recall double, reciprocal_rank double, ndcg double, retrieved array<bigint>, config string, category string"
MODES = ("sparse", "dense", "hybrid")


@dataclass(frozen=True)
class ReportConfig:
    documents: str
    questions: str
    output: str
    configurations: tuple[str, ...] = ("sparse", "hybrid")
    top_k: int = 5


def expected_documents(documents: DataFrame, questions: DataFrame) -> DataFrame:
    """id, expected, category of every question."""
    held = containment.holding(documents, "doc_id", "text", questions, "id", "text")
    expected = held.groupBy("id").agg(F.array_sort(F.collect_set("doc_id")).alias("expected"))
    rows = questions.select("id").join(expected, "id", "left").withColumn("expected", F.coalesce("expected", F.array().cast("array<bigint>")))
    n = F.size("expected")
    return rows.withColumn("category", F.when(n == 0, "unanswerable").when(n == 1, "single").otherwise("multi"))


def run(spark: SparkSession, config: ReportConfig) -> dict[str, int]:
    asked = tuple(dict.fromkeys(config.configurations))
    if not asked or set(asked) - set(MODES):
        raise JobError(f"configurations are some of {', '.join(MODES)}, not {', '.join(asked) or 'none'}")
    documents = spark.read.parquet(config.documents).select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    questions = spark.read.parquet(config.questions).select(F.col("item_id").cast("long").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    questions = materialize(questions, "questions")
    log.info("read %d documents of %s and %d questions of %s", documents.count(), config.documents, questions.count(), config.questions)
    cases = expected_documents(documents, questions)
    said = questions.withColumn("text", strip(F.col("text"))).where("text <> ''")
    mode = asked[0] if len(set(asked)) == 1 else "hybrid"  # its two branches serve all configurations
    found = {b: materialize(r, b) for b, r in branches(Corpus(documents, "doc_id"), said, "id", RetrievalSettings(mode=mode)).items()}
    hits = None
    for name in asked:
        fused = fusion.fuse({b: r for b, r in found.items() if name in (b, "hybrid")}, "id", "doc_id")
        part = fused.where(F.col("fused_rank") <= config.top_k).select("id", "doc_id", F.col("fused_rank").alias("rank"), F.lit(name).alias("config"))
        hits = part if hits is None else hits.unionByName(part)
    grid = cases.withColumn("config", F.explode(F.array(*map(F.lit, asked))))
    scored = evaluate.tier1_cases(grid, hits, "doc_id", ["config"])
    report = scored.select(
        "id", F.size("expected").alias("n_expected"), "hit", F.col("hit_rank").cast("int").alias("hit_rank"), *[F.round(c, 6).alias(c) for c in ("recall", "reciprocal_rank", "ndcg")],
        F.col("retrieved").cast("array<bigint>").alias("retrieved"), "config", "category")
    report.hint("rebalance", "config", "category").write.mode("overwrite").partitionBy("config", "category").parquet(config.output)
    rows = read_output(spark, config)
    for r in rows.groupBy("config").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("n_expected") > 0, F.col("hit").cast("double"))), 4).alias("hit_rate")).orderBy("config").collect():
        log.info("%s: %d questions, hit rate %s", r["config"], r["n"], r["hit_rate"])
    done = {"rows": rows.count(), "hits": rows.where("hit").count()}
    log.info("wrote %s: %s", config.output, done)
    return done


def read_output(spark: SparkSession, config: ReportConfig) -> DataFrame:
    return spark.read.schema(CASES).parquet(config.output)


if __name__ == "__main__":
    command_line(ReportConfig, run, __doc__, "jobs/evaluation_report.json")
