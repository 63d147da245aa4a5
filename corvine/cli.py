"""Command line: ingest, ask, evaluate. The last line of output is JSON; exit 0 done, 1 failed gate, 2 bad request. Inventory 22, 157."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from corvine.config import RetrievalSettings, load_settings
from corvine.operators.filters import FilterError, build_filter, parse_filter_arguments
from corvine.plans import evaluate, ingest
from corvine.plans.providers import ProviderError, build_embedder
from corvine.plans.retrieve import Corpus, RetrievalError, answer_batch, checked_queries, retrieve, with_payload
from corvine.runtime import build_session
from corvine.sources.corpus import CorpusError, GoldenError, read_corpus, read_golden
from corvine.sources.points import CollectionMismatch, PointsTable, assert_embedder
from corvine.sources.postings import PostingIndex

PAYLOAD = ["source_path", "title", "heading_path", "text"]


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corvine", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("ingest", "ask", "evaluate"):
        c = sub.add_parser(name)
        c.add_argument("--points", required=True)
        c.add_argument("--config")
        c.add_argument("--mode", default="hybrid", choices=("dense", "sparse", "hybrid"))
        c.add_argument("--filter", action="append")
        c.add_argument("--k", type=int, default=5)
    sub.choices["ingest"].add_argument("--corpus", required=True)
    sub.choices["ingest"].add_argument("--exclude", action="append", default=[])
    sub.choices["ingest"].add_argument("--full", action="store_true")
    sub.choices["ask"].add_argument("question", nargs="+")
    sub.choices["evaluate"].add_argument("--golden", required=True)
    sub.choices["evaluate"].add_argument("--fail-under-hit", type=float)
    return p


def run(argv: list[str] | None = None) -> tuple[int, dict]:
    args = _parser().parse_args(argv)
    settings = load_settings(args.config)
    embedder = build_embedder(settings.embedder, settings.dim)
    flt = build_filter(parse_filter_arguments(args.filter))
    spark = build_session("corvine-cli")
    table = PointsTable(spark, args.points)
    index = PostingIndex(spark, args.points.rstrip("/") + "-postings", "point_id", "string")
    if args.command == "ingest":
        r = ingest.run_ingest(read_corpus(spark, args.corpus, exclude=args.exclude), table, "cli", settings.chunking, not args.full, index=index, embedder=embedder)
        return 0, {**r.counters, "stats": r.stats}
    if not table.exists():
        raise CollectionMismatch(f"no points table at {args.points}")
    points = table.read()
    if points is None:
        raise CollectionMismatch(f"the points table at {args.points} is empty")
    assert_embedder(points, embedder.model)
    tags = [c for c in flt.conditions if c.field == "tags"] if flt else []
    if tags:  # statistics come from the posting index, so no other file is needed
        points = table.read_tagged(list(tags[0].values))
    corpus = Corpus(points, vector="vector", text="embed_text", postings=index)
    how = RetrievalSettings(**{**settings.retrieval.__dict__, "mode": args.mode, "top_k": args.k})
    if args.command == "ask":
        q = checked_queries(spark.createDataFrame(list(enumerate(args.question)), "query_id long, text string"), "query_id")
        q = q.withColumn("vector", embedder.vector(F.col("text")))
        hits = with_payload(retrieve(corpus, q, settings=how, flt=flt), corpus, PAYLOAD).withColumn("key", F.col("point_id"))
        rows = answer_batch(hits, q, "query_id", settings.prompt).select("query_id", "question", "answer", "refused", "refusal_reason", F.transform(F.filter("blocks", lambda b: F.array_contains("cited", b["marker"])), lambda b: b["source_path"]).alias("cited")).orderBy("query_id").collect()
        return 0, {"answers": [r.asDict() for r in rows]}
    golden = read_golden(spark, args.golden)
    cases = golden.select("id", F.col("question").alias("text"), F.col("expected_source_paths").alias("expected"), "category", "answerable")
    hits = with_payload(retrieve(corpus, cases.select("id", "text", embedder.vector(F.col("text")).alias("vector")), "id", how, flt), corpus, ["source_path"])
    m = evaluate.tier1_metrics(evaluate.tier1_cases(cases, hits.select("id", "source_path", "rank"), "source_path")).first().asDict()
    return int(args.fail_under_hit is not None and m["hit_at_k"] < args.fail_under_hit), m


def main(argv: list[str] | None = None) -> int:
    try:
        code, out = run(argv)
    except (FilterError, RetrievalError, CorpusError, GoldenError, CollectionMismatch, ProviderError) as e:
        code, out = 2, {"error": getattr(e, "error_type", type(e).__name__), "message": str(e)}
    print(json.dumps(out, sort_keys=True, default=str))
    return code


if __name__ == "__main__":
    sys.exit(main())
