"""Batch retrieval: both branches, fusion, threshold, late payload, rerank. Inventory 52, 98-106, 139-140, 177.

A single question is a batch of one row. Filters are validated before any plan is made and apply ahead of
both branches; corpus statistics stay those of the whole corpus. The payload is joined last, to the hits only.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.config import PromptSettings, RetrievalSettings
from corvine.functions import identity, text
from corvine.operators import answer, bm25, context, dense, fusion, rerank
from corvine.operators.filters import Filter
from corvine.sources.postings import PostingIndex

MODES = ("dense", "sparse", "hybrid")


class RetrievalError(ValueError):
    """A query or setting is not acceptable."""


@dataclass(frozen=True)
class Corpus:
    """What is searched: ``points`` has the key, text and payload columns; vectors are computed or given, and so are posting lists."""

    points: DataFrame
    key: str = "point_id"
    text: str = "text"
    vector: str | None = None
    postings: PostingIndex | None = None

    def tokenised(self) -> DataFrame:
        return bm25.with_terms(self.points, self.key, self.text)

    def vectors(self) -> DataFrame:
        made = F.col(self.vector) if self.vector else identity.hash_vector(F.col(self.text))
        return self.points.select(self.key, made.alias("vector"))


def checked_queries(queries: DataFrame, query_key: str) -> DataFrame:
    """Stripped queries; an empty one is an error."""
    out = queries.withColumn("text", text.strip(F.col("text")))
    if out.where("text is null or text = ''").limit(1).count():
        raise RetrievalError("a query is empty")
    return out


def branches(corpus: Corpus, queries: DataFrame, query_key: str, s: RetrievalSettings, flt: Filter | Column | None = None) -> dict[str, DataFrame]:
    """branch -> (query key, key, score, rank). Each branch has its own depth, whatever top_k is."""
    if s.mode not in MODES:
        raise RetrievalError(f"mode {s.mode!r} is none of {', '.join(MODES)}")
    if s.top_k <= 0:
        raise RetrievalError("top_k must be positive")
    predicate = flt.column() if isinstance(flt, Filter) else flt
    visible = corpus.points if predicate is None else corpus.points.where(predicate)
    out = {}
    if s.mode != "sparse":
        asked = queries.select(query_key, identity.hash_vector(F.col("text")).alias("vector")) if corpus.vector is None else queries.select(query_key, "vector")
        out["dense"] = dense.dense_search(replace(corpus, points=visible).vectors(), corpus.key, asked, query_key, s.dense_top_k)
    if s.mode != "dense":
        restrict = None if predicate is None else visible.select(corpus.key)
        if corpus.postings is not None:
            out["sparse"] = corpus.postings.search(queries, query_key, s.sparse_top_k, restrict=restrict)
        else:
            out["sparse"] = bm25.sparse_search(corpus.tokenised(), corpus.key, queries, query_key, s.sparse_top_k, restrict=restrict)
    return out


def retrieve(corpus: Corpus, queries: DataFrame, query_key: str = "query_id", settings: RetrievalSettings | None = None, flt: Filter | Column | None = None, depth: int | None = None) -> DataFrame:
    """query key, key, score, rank, ranks, contributions. One-branch modes go through fusion too, with weight 1."""
    s = settings or RetrievalSettings()
    found = branches(corpus, queries, query_key, s, flt)
    weights = s.weights if s.mode == "hybrid" else {}
    fused = fusion.fuse(found, query_key, corpus.key, s.rrf_k, weights)
    hits, _ = fusion.threshold_and_limit(fused, query_key, depth or s.top_k, s.score_threshold)
    return hits.drop("fused_rank")


def with_payload(hits: DataFrame, corpus: Corpus, columns: list[str]) -> DataFrame:
    """Left join of the few hits to their payload; a missing one leaves empty fields."""
    return hits.join(corpus.points.select(corpus.key, *columns), corpus.key, "left")


def reranked(hits: DataFrame, queries: DataFrame, query_key: str, kind: str, top_k: int, text_column: str = "text", model: rerank.Scorer | None = None, fail_open: bool = True) -> DataFrame:
    asked = queries.select(query_key, F.col("text").alias("query"))
    return rerank.rerank(hits.join(asked, query_key), query_key, rerank.build_reranker(kind, model), top_k, text=text_column, fail_open=fail_open)[0]


def answer_batch(hits: DataFrame, queries: DataFrame, query_key: str, settings: PromptSettings | None = None) -> DataFrame:
    """One row per query: blocks, dropped, prompt, answer, cited, invalid_markers, refusal_reason, refused, hits_used, uncited_claims.

    ``hits`` has rank, key, source_path, title, heading_path, text and score. Queries without hits keep a row.
    """
    s = settings or PromptSettings()
    blocks = context.select_blocks(hits, query_key, s.max_blocks, s.max_tokens, s.heading_in_prompt)
    rows = queries.select(query_key, F.col("text").alias("question")).join(blocks, query_key, "left")
    has = F.coalesce(F.size("blocks") > 0, F.lit(False))
    rows = rows.withColumn("prompt", context.user_prompt(F.col("blocks"), F.col("question")))
    rows = rows.withColumn("answer", F.when(has, answer.extractive_answer(F.col("blocks"), F.col("question"), s.sentences)).otherwise(F.lit("")))
    rows = answer.cited(rows)
    why = answer.refusal_reason(F.col("answer"), F.col("cited"), has, s.require_citation, s.refuse_without_evidence)
    return answer.finalise(rows.withColumn("refusal_reason", why))
