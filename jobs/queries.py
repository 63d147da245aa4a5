"""The jobs as registered queries: each runs twice into one new folder and returns the output as it then stands."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.catalog import oracles as sql
from corvine.runtime import scratch_root
from jobs import evaluation_report, refresh_index


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def job1_refresh_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = _folder(spark, "job1")
    config = refresh_index.RefreshConfig(f"{sf_dir}/documents.parquet", f"{at}/output", f"{at}/checkpoint")
    for _ in range(2):
        refresh_index.run(spark, config)
    return refresh_index.read_output(spark, config)


def job2_evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = evaluation_report.ReportConfig(f"{sf_dir}/documents.parquet", f"{sf_dir}/benchmark.parquet", f"{_folder(spark, 'job2')}/output")
    for _ in range(2):
        evaluation_report.run(spark, config)
    return evaluation_report.read_output(spark, config).withColumn("retrieved", F.array_join("retrieved", ","))


QUERIES = {f.__name__: f for f in (job1_refresh_index, job2_evaluation_report)}

_JOB1 = f"""
WITH {sql.DOCS}, {sql.TOK},
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(terms) AS term FROM tok) GROUP BY ALL)
SELECT d.doc_id, d.lang, sha256(nfc_normalize(d.text)) AS content_sha256, len(t.terms)::INT AS n_terms, ((length(d.text) + 3) // 4)::INT AS token_count, d.source, tf.term, tf.tf
FROM docs d JOIN tok t ON d.doc_id = t.doc_id LEFT JOIN tf ON d.doc_id = tf.doc_id"""

_JOB2 = f"""{sql.BOTH} {sql.fused()}, {sql.CASES},
ranked AS (SELECT 'sparse' AS config, query_id, doc_id, rank FROM sparse UNION ALL SELECT 'hybrid', query_id, doc_id, rank FROM fused),
{sql.tier1('ranked', 5, 'config')}
SELECT t.id, len(c.expected)::INT AS n_expected, t.hit, t.hit_rank::INT AS hit_rank, round(t.recall, 6) AS recall, round(t.reciprocal_rank, 6) AS reciprocal_rank, round(t.ndcg, 6) AS ndcg,
  array_to_string(coalesce(l.got, []), ',') AS retrieved, t.config, t.category
FROM tier1 t JOIN cases c ON c.id = t.id LEFT JOIN lists l ON l.id = t.id AND l.config = t.config"""

ORACLES = {"job1_refresh_index": _JOB1, "job2_evaluation_report": _JOB2}
