"""Reranking by term coverage or any scorer. Inventory 83, 93, 106, 107, 109, 110, 163."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvine.functions.text import search_terms

#: A scorer makes a score column from a query text and a hit text column.
Scorer = Callable[[Column, Column], Column]


class RerankError(RuntimeError):
    """The scorer failed and the caller asked to be told."""


def term_coverage(query: Column, text: Column) -> Column:
    """Share of the query's distinct terms that the text has; 0 for a query without terms."""
    asked = F.array_distinct(search_terms(query))
    have = F.size(F.array_intersect(asked, search_terms(text)))
    return F.when(F.size(asked) > 0, have / F.size(asked)).otherwise(F.lit(0.0))


def build_reranker(kind: str, model: Scorer | None = None) -> Scorer | None:
    if kind == "off":
        return None
    if kind == "fake":
        return term_coverage
    if kind in ("local", "auto"):
        if model is None and kind == "local":
            raise ValueError("a local reranker needs a scorer, such as a pandas UDF over a model")
        return model
    raise ValueError(f"unknown reranker {kind!r}")


def rerank(hits: DataFrame, query_key: str, scorer: Scorer | None, top_k: int, query: str = "query", text: str = "text", fail_open: bool = True) -> tuple[DataFrame, str | None]:
    """(hits, error). Hits are ordered by the scorer, then by their former rank, which stays as pre_rerank_rank.

    Without a scorer the order stays. A scorer that fails inside an executor fails only when it runs, so with
    ``fail_open`` the result is computed here, and the former order is returned with the error if that fails.
    """
    plain = hits.where(F.col("rank") <= top_k)
    if scorer is None:
        return plain, None
    try:
        scored = hits.withColumn("rerank_score", scorer(F.col(query), F.col(text)))
        before = F.coalesce("pre_rerank_rank", "rank") if "pre_rerank_rank" in hits.columns else F.col("rank")
        w = Window.partitionBy(query_key).orderBy(F.col("rerank_score").desc(), "rank")
        out = scored.withColumn("pre_rerank_rank", before).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k)
        if fail_open and scorer is not term_coverage:
            from corvine.runtime import materialize

            out = materialize(out, "rerank")
        return out, None
    except Exception as e:
        if not fail_open:
            raise RerankError(str(e)) from e
        return plain, str(e)[:500]
