"""Ingest: documents to points, once or incrementally, batch or streamed. Inventory 13, 66, 112, 160, 175, 178.

Chunks are cut in one narrow stage and written once; statistics and vectors read that. Counters come from one
aggregate over it. Sparse weights are not stored: search computes them from current statistics, so an
incremental run cannot leave stale weights behind; a posting index keeps the statistics themselves current.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.functions import identity
from corvine.operators import bm25
from corvine.operators.chunking import ChunkRules, chunk_documents
from corvine.plans.providers import Embedder, build_embedder
from corvine.runtime import materialize
from corvine.sources.points import PointsTable
from corvine.sources.postings import PostingIndex


def points_of(chunks: DataFrame, run_id: str, embedder: Embedder | None = None) -> DataFrame:
    """Chunk columns with the vector of the embed text and where it came from."""
    made = embedder or build_embedder()
    return chunks.where("kept").drop("kept").withColumns({
        "vector": made.vector(F.col("embed_text")), "embedded_model": F.lit(made.model), "ingest_run_id": F.lit(run_id)})


@dataclass(frozen=True)
class IngestResult:
    counters: dict[str, int]
    per_document: DataFrame
    stats: dict[str, Any]


def run_ingest(documents: DataFrame, table: PointsTable | None, run_id: str, rules: ChunkRules | None = None, incremental: bool = True, dry_run: bool = False, index: PostingIndex | None = None, embedder: Embedder | None = None) -> IngestResult:
    """Points into ``table`` and, if given, their postings into ``index`` (keyed by point_id) as its next batch."""
    rules = rules or ChunkRules()
    chunks = materialize(chunk_documents(documents, rules), "chunks")
    kept = chunks.where("kept")
    totals = chunks.agg(F.count_if("kept").alias("chunks_built"), F.count_if(~F.col("kept")).alias("chunks_dropped_short"), F.countDistinct(F.when(F.col("kept"), F.col("doc_id"))).alias("documents_ingested")).first().asDict()
    totals["documents_seen"] = documents.count()
    totals["documents_without_chunks"] = totals["documents_seen"] - totals["documents_ingested"]
    tokenised = bm25.with_terms(kept, "point_id", "embed_text")
    stats = bm25.corpus_stats(tokenised).crossJoin(bm25.vocabulary_size(tokenised)).first().asDict()
    totals |= {"chunks_skipped_unchanged": 0, "points_upserted": 0}
    if table is not None and not dry_run:
        embedder = embedder or build_embedder()
        table.ensure(embedder.dim)
        points, before = points_of(chunks, run_id, embedder), table.count()
        if incremental:
            table.append_new(points)
            totals["points_upserted"] = table.count() - before
            totals["chunks_skipped_unchanged"] = totals["chunks_built"] - totals["points_upserted"]
        else:
            table.upsert(points)
            totals["points_upserted"] = totals["chunks_built"]
        if index is not None:
            index.add(kept.select(index.key, F.col("embed_text").alias("text")), max(index.batches(), default=-1) + 1)
    return IngestResult(totals, kept.groupBy("source_path").agg(F.count("*").alias("chunks")), stats)


def corpus_identity(documents: DataFrame, rules: ChunkRules, root: str = "", collection: str = "", model: str = identity.HASH_MODEL) -> dict[str, Any]:
    r = identity.corpus_hash(documents).first()
    return {"embedder_id": model, "chunker_version": rules.version, "doc_count": r["doc_count"], "corpus_hash": r["corpus_hash"], "corpus_root": root, "collection": collection}


def compatible(left: dict, right: dict) -> bool:
    return all(left.get(k) == right.get(k) for k in ("embedder_id", "chunker_version", "doc_count", "corpus_hash"))


def cache_material(identity_: dict) -> str:
    return json.dumps({k: identity_[k] for k in ("collection", "embedder_id", "chunker_version", "doc_count", "corpus_hash")}, separators=(",", ":"), sort_keys=True)
