"""Corpus pipeline: toxicity, language ID, n-gram Jaccard join, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; :func:`run` writes each stage's result as
Parquet in the shared folder and reads it back for the next. All stages but the last return the columns of
their input. Filtering stages keep every document that they have no reason to reject.

Defined results: toxicity, language ID and decontamination judge rows by their text, so of rows that share a doc_id
only those that are rejected go, and rows with a null id are judged like others. Null and empty texts are not toxic
and match no benchmark; language ID rejects them. The join sees rows that share a doc_id as one document with the links
of all its texts; of a group the smallest doc_id stays, in one row, the one with the smallest text (null first) and
then the smallest other columns in their order (maps by their JSON); rows with a null id all stay. Repeated rows so become one at that
stage; ties cannot occur after it. Null lang or source is a child of its own in mixing. Empty tables give no rows.
Extra columns, whatever their names, are kept, but ``copies``, in any case of letters, is replaced by the last stage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.llm import decontaminate, jaccard_join, language_id, mixing, toxicity
from corvine.llm.mixing import quoted
from corvine.runtime import broadcast_if_small, drop_materialized, few_rows_per_batch, materialize, row_count, table

#: Language ID rejects texts without letters, and those where no language gets this probability, if any was learned.
LEAST_LANGUAGE_SCORE = 0.5
#: Near-duplicates: five words and a similarity of 0.8 or more.
NEAR = jaccard_join.JoinSpec(words=5, percent=80)


def _key(docs: DataFrame) -> Column:
    """A row's id and text; rows that share both are judged alike."""
    return F.concat_ws(":", F.col("doc_id").cast("string"), F.coalesce(F.hex(F.xxhash64(F.col("text").cast("string"))), F.lit("")))


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select(_key(docs).alias("doc_id"), "text")


def _without(docs: DataFrame, gone: DataFrame, key: Column | None = None) -> DataFrame:
    """``docs`` but for the keys in ``gone``, which is written first so that its size is known."""
    name = "gone" + "_" * max(map(len, docs.columns))  # longer than any name, so it clashes with none
    gone = materialize(gone.select(F.col("doc_id").alias(name)).where(F.col(name).isNotNull()).distinct(), "gone", 40)
    return docs.join(broadcast_if_small(gone, row_count(gone), 64), (_key(docs) if key is None else key) == F.col(name), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    few_rows_per_batch(spark)
    scored = toxicity.score_documents(_keyed(docs), toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return _without(docs, scored.where("predicted = 1"))


def drop_unidentified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where no language could be learned, only null texts and texts without letters are rejected."""
    few_rows_per_batch(spark)
    model = language_id.fit(docs)
    if not model.langs:
        return _without(docs, language_id.without_letters(_keyed(docs)))
    found = language_id.predict_languages(_keyed(docs), model)
    return _without(docs, found.where((F.col("lang_pred") == "und") | (F.col("score") < LEAST_LANGUAGE_SCORE)))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each group stays, once."""
    few_rows_per_batch(spark)
    groups = jaccard_join.jaccard_components(docs, NEAR)
    kept = _without(docs, groups.where("component_id <> doc_id"), F.col("doc_id"))
    again = materialize(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"), "again", 8)
    if not row_count(again):
        return kept
    # only the rows whose id repeats move
    again = broadcast_if_small(again, row_count(again), 16)
    rest = [f for f in docs.schema if f.name not in ("doc_id", "text")]
    # what cannot be ordered, like a map, is ordered by its JSON
    order = [F.to_json(F.struct(quoted(f.name))) if any(k in f.dataType.simpleString() for k in ("map<", "variant")) else quoted(f.name) for f in rest]
    row = F.struct(*[quoted(c) for c in docs.columns])
    one = kept.join(again, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(row, F.struct("text", *order)).alias("__row")).select("__row.*")
    return kept.join(again, "doc_id", "left_anti").select(*[quoted(c) for c in docs.columns]).unionByName(one)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    few_rows_per_batch(spark)
    return _without(docs, decontaminate.find_leaks(_keyed(docs), table(spark, sf_dir, "benchmark")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("language ID", drop_unidentified),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
]

#: Trained models cannot be written in SQL; tests hold every stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), "stage")
        drop_materialized(before)
    return materialize(STAGES[-1][1](spark, docs, sf_dir), "stage")
