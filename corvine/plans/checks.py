"""Golden-set checks, costs and cache keys. Inventory 58-59, 61, 73-76, 90-91, 127-128, 155-157, 171, 179."""

from __future__ import annotations

import json
import random
from collections import OrderedDict
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Slices, thresholds and rates.
SLICES, LEAST_ITEMS, MAX_TOP_SHARE, SLICE_SIZE = ("answerable", "unanswerable", "filter", "hybrid-vs-dense"), 50, 0.5, 10
RATES = {"text-embedding-3-small": 0.02, "gpt-4o-mini-input": 0.15, "gpt-4o-mini-output": 0.60}


def duplicates(cases: DataFrame, column: str) -> DataFrame:
    return cases.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n")).where("n > 1 or coalesce(value, '') = ''")


def label_errors(cases: DataFrame, documents: DataFrame, chunkable: DataFrame) -> DataFrame:
    """(id, path, code): expected sources that are missing, or that produce no chunks. All frames are set-based."""
    wanted = cases.select("id", F.explode("expected_source_paths").alias("path"))
    missing = wanted.join(documents.select(F.col("source_path").alias("path")).distinct(), "path", "left_anti").withColumn("code", F.lit("missing"))
    there = wanted.join(documents.select(F.col("source_path").alias("path")).distinct(), "path", "left_semi")
    bare = there.join(chunkable.select(F.col("source_path").alias("path")).distinct(), "path", "left_anti").withColumn("code", F.lit("no_chunks"))
    return missing.unionByName(bare).select("id", "path", "code")


def integrity_findings(cases: DataFrame, documents: DataFrame, chunkable: DataFrame) -> DataFrame:
    """(code, subject, detail) of everything wrong with a golden set."""
    parts = [
        label_errors(cases, documents, chunkable).select("code", F.col("id").alias("subject"), F.col("path").alias("detail")),
        *[duplicates(cases, c).select(F.lit(f"duplicate_{c}").alias("code"), F.coalesce("value", F.lit("")).alias("subject"), F.col("n").cast("string").alias("detail")) for c in ("id", "question")],
        cases.where("answerable = false and size(expected_source_paths) > 0").select(F.lit("unanswerable_with_sources").alias("code"), F.col("id").alias("subject"), F.lit("").alias("detail")),
        cases.groupBy(F.coalesce("category", F.lit("")).alias("subject")).agg(F.count("*").alias("n")).where(F.col("n") != SLICE_SIZE).select(
            F.lit("slice_size").alias("code"), "subject", F.col("n").cast("string").alias("detail")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rank_findings(cases: DataFrame, ranks: DataFrame) -> DataFrame:
    """(slice, code, items) of slices whose targets already stand first, and of items without a usable rank."""
    rows = cases.where(F.col("category").isin(list(SLICES))).join(ranks.select("id", "target_rank", F.lit(True).alias("listed")), "id", "left")
    gone = rows.where("listed is null").groupBy("category").agg(F.count("*").alias("items")).withColumn("code", F.lit("missing_rank"))
    bad = rows.where("listed and target_rank is null").groupBy("category").agg(F.count("*").alias("items")).withColumn("code", F.lit("bad_rank"))
    share = rows.where("target_rank is not null and category <> 'unanswerable'").groupBy("category").agg(
        F.count_if(F.col("target_rank") <= 1).alias("items"), F.avg((F.col("target_rank") <= 1).cast("double")).alias("share"))
    easy = share.where(F.col("share") >= MAX_TOP_SHARE).withColumn("code", F.lit("all_trivial_rank1"))
    whole = share.where(F.col("share") == 1).withColumn("code", F.lit("slice_all_rank1"))
    out = None
    for p in (gone, bad, easy, whole):
        p = p.select(F.col("category").alias("slice"), "code", "items")
        out = p if out is None else out.unionByName(p)
    return out


def structure_findings(cases: DataFrame) -> DataFrame:
    """(slice, code, items): rules every item of a slice has to meet, and slices or a program that are too small."""
    has = F.coalesce(F.size("expected_source_paths"), F.lit(0)) > 0
    token = F.coalesce(F.col("rare_token"), F.lit(""))
    rules: dict[str, tuple[str, Column]] = {
        "answerable_flag": ("answerable", F.col("answerable").eqNullSafe(False)), "answerable_paths": ("answerable", ~has),
        "unanswerable_flag": ("unanswerable", ~F.col("answerable").eqNullSafe(False)), "unanswerable_paths": ("unanswerable", has),
        "filter_required": ("filter", F.coalesce(F.size("filters"), F.lit(0)) <= 0),
        "rare_token": ("hybrid-vs-dense", (token == "") | ~F.contains(F.col("question"), token)),
    }
    one = cases.select("category", F.explode(F.array(*[
        F.when((F.col("category") == s) & F.coalesce(broken, F.lit(True)), F.struct(F.lit(s).alias("slice"), F.lit(code).alias("code"))) for code, (s, broken) in rules.items()])).alias("f"))
    found = one.where("f is not null").groupBy("f.slice", "f.code").agg(F.count("*").alias("items"))
    sizes = cases.groupBy().agg(F.count("*").alias("n"), F.collect_set("category").alias("there"))
    gone = sizes.select(F.explode(F.array_except(F.array(*map(F.lit, SLICES)), "there")).alias("slice")).select("slice", F.lit("missing_slice").alias("code"), F.lit(0).cast("long").alias("items"))
    small = sizes.where(F.col("n") < LEAST_ITEMS).select(F.lit("overall").alias("slice"), F.lit("n_below_minimum").alias("code"), F.col("n").alias("items"))
    return found.unionByName(gone).unionByName(small)


def sample_ids(ids: list[str], n: int, seed: int) -> list[str]:
    """A seeded choice that keeps the original order."""
    if n >= len(ids):
        return list(ids)
    chosen = set(random.Random(seed).sample(range(len(ids)), n))
    return [x for i, x in enumerate(ids) if i in chosen]


class CostError(ValueError):
    """Usage or spend that does not add up."""


@dataclass(frozen=True)
class Calls:
    document_embeddings: int
    query_embeddings: int
    generations: int
    judge_calls: int


def derive_calls(items: int, configurations: Mapping[str, tuple[str, str]], chunks: int, ingest: bool, llm: str, judge: str) -> Calls:
    """Each configuration retrieves every item twice, once per tier; sparse ones embed nothing."""
    dense = sum(mode != "sparse" for mode, _ in configurations.values())
    made = items * len(configurations) if llm != "none" else 0
    return Calls(chunks if ingest else 0, 2 * items * dense, made, made if judge != "none" else 0)


def cost_usd(embedding: Column, prompt: Column, completion: Column, digits: int = 6) -> Column:
    total = embedding * RATES["text-embedding-3-small"] + prompt * RATES["gpt-4o-mini-input"] + completion * RATES["gpt-4o-mini-output"]
    return F.round(total / 1_000_000, digits)


def estimate_cost(plans: DataFrame) -> DataFrame:
    """Adds expected_usd and upper_bound_usd; input: generations, embedding_tokens, query_tokens, max_context_tokens, max_output_tokens, billed."""
    e = F.col("embedding_tokens") + F.col("query_tokens")
    i, o = F.col("generations") * F.col("max_context_tokens"), F.col("generations") * F.col("max_output_tokens")
    half = lambda c: F.floor(c / 2)
    free = lambda c: F.when(F.col("billed"), c).otherwise(F.lit(0.0))
    return plans.withColumns({"expected_usd": free(cost_usd(e, half(i), half(o), 4)), "upper_bound_usd": free(cost_usd(e, i, o, 4))})


def ledger(usage: DataFrame, billed: bool, bound: float | None = None) -> dict[str, Any]:
    """Sums of a usage log (kind, items, prompt_tokens, completion_tokens); a paid row without counters, or spend over the bound, is an error."""
    kinds = ("documents", "query", "generation")
    bad = F.count_if(~F.col("kind").isin(list(kinds)))
    unmetered = F.count_if(F.coalesce(F.col("prompt_tokens") < 0, F.lit(True)) | ((F.col("kind") == "generation") & F.coalesce(F.col("completion_tokens") < 0, F.lit(True))))
    of = lambda kind, c: F.coalesce(F.sum(F.when(F.col("kind") == kind, c)), F.lit(0))
    r = usage.agg(
        bad.alias("bad"), unmetered.alias("unmetered"), of("documents", F.col("items")).alias("document_embeddings"), of("query", F.col("items")).alias("query_embeddings"),
        F.count_if(F.col("kind") == "generation").alias("generations"),
        (of("documents", F.col("prompt_tokens")) + of("query", F.col("prompt_tokens"))).alias("embedding_tokens"),
        of("generation", F.col("prompt_tokens")).alias("prompt_tokens"), of("generation", F.col("completion_tokens")).alias("completion_tokens"),
    ).first().asDict()
    if r.pop("bad"):
        raise CostError("unknown kind of call")
    if r.pop("unmetered") and billed:
        raise CostError("a paid call has no usage")
    spent = (r["embedding_tokens"] * RATES["text-embedding-3-small"] + r["prompt_tokens"] * RATES["gpt-4o-mini-input"] + r["completion_tokens"] * RATES["gpt-4o-mini-output"]) / 1e6
    r["cost_usd"] = round(spent, 6) if billed else 0.0
    if bound is not None and r["cost_usd"] > bound:
        raise CostError(f"spend {r['cost_usd']:.6f} is above the bound {bound:.6f}")
    return r


def require_consent(billed: bool, agreed: bool) -> None:
    if billed and not agreed:
        raise ValueError("paid providers need an explicit consent")


def canonical_filters(filters: Mapping[str, Any] | None) -> str:
    """One text for one filter, whatever the order of fields and alternatives; empty is unfiltered."""
    plain = {k: sorted(map(str, v)) if isinstance(v, list | tuple) else str(v) for k, v in sorted((filters or {}).items())}
    return json.dumps(plain, separators=(",", ":"), ensure_ascii=False) if plain else ""


def retrieval_fingerprint(mode=None, top_k=None, dense_top_k=None, sparse_top_k=None, rrf_k=None, rerank=None) -> str:
    knobs = {"mode": mode or "", "top_k": top_k, "dense_top_k": dense_top_k, "sparse_top_k": sparse_top_k, "rrf_k": rrf_k, "rerank": rerank or ""}
    return json.dumps(knobs, separators=(",", ":"), sort_keys=True)


@dataclass
class ResultCache:
    """Least recently used results by key digest; off unless it has room."""

    room: int = 256
    _kept: OrderedDict = field(default_factory=OrderedDict)

    def get(self, key: str) -> Any:
        if key in self._kept:
            self._kept.move_to_end(key)
        return self._kept.get(key)

    def put(self, key: str, value: Any) -> None:
        if self.room <= 0:
            return
        self._kept[key] = value
        self._kept.move_to_end(key)
        while len(self._kept) > self.room:
            self._kept.popitem(last=False)


def exact_tokens(texts: Iterable[str], encoding) -> int:
    """Tokens by a given encoding; strings that look like control tokens are content."""
    return sum(len(encoding.encode(t, disallowed_special=())) for t in texts)
