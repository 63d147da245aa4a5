"""Two-tier evaluation of batches, ablations and scorecards. Inventory 45, 55-56, 60, 67-72, 85-87, 143-148, 154, 181.

Cases: id, question (as text), expected array<key>, category, answerable. Retrieval runs once per mode; both
tiers and the statistics read the same hits.
"""

from __future__ import annotations

from collections.abc import Mapping
from datetime import UTC, datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.operators import answer
from corvine.plans import stats

#: Configurations and metrics of the report.
CONFIGURATIONS = {"sparse": ("sparse", "off"), "dense": ("dense", "off"), "hybrid": ("hybrid", "off"), "hybrid_rerank": ("hybrid", "fake")}
METRICS = ("hit_at_5", "recall_at_5", "mrr", "ndcg_at_5", "citation_precision", "invalid_marker_rate", "refusal_accuracy")


def scorable() -> Column:
    return F.coalesce(F.size("expected"), F.lit(0)) > 0


def unanswerable() -> Column:
    """The explicit flag decides; without it, the category or a lack of expected sources."""
    return F.coalesce(~F.col("answerable"), F.col("category").eqNullSafe("unanswerable") | ~scorable())


def _gain(position: Column) -> Column:
    return F.lit(1.0) / F.log2(position + 1.0)


def tier1_cases(cases: DataFrame, hits: DataFrame, key: str, by: list[str] | None = None) -> DataFrame:
    """Per case: scored, hit, hit_rank, recall, reciprocal_rank, ndcg, retrieved.

    ``hits``: id, key, rank (and the columns ``by``, which multiply the cases, or are columns of the cases too). The reciprocal rank looks at the raw
    list, nDCG at the list without repeats; the ideal counts all expected sources.
    """
    by = by or []
    lists = hits.groupBy("id", *by).agg(F.array_sort(F.collect_list(F.struct("rank", F.col(key).alias("k")))).alias("h"))
    rows = cases.join(lists, ["id", *[b for b in by if b in cases.columns]], "left").withColumn("retrieved", F.coalesce(F.transform("h", lambda x: x["k"]), F.array().cast(f"array<{hits.schema[key].dataType.simpleString()}>")))
    seen = F.array_distinct("retrieved")
    want = F.array_distinct("expected")
    first = F.array_min(F.filter(F.transform("h", lambda x: F.when(F.array_contains("expected", x["k"]), x["rank"])), lambda r: r.isNotNull()))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    gains = total(F.transform(seen, lambda p, i: F.when(F.array_contains("expected", p), _gain(i + 1)).otherwise(F.lit(0.0))))
    ideal = total(F.transform(F.sequence(F.lit(1), F.greatest(F.size(want), F.lit(1))), _gain))
    on = scorable()
    zero = lambda c: F.when(on, F.coalesce(c, F.lit(0.0))).otherwise(F.lit(0.0))
    return rows.select(
        *cases.columns, *[b for b in by if b not in cases.columns], on.alias("scored"), (on & first.isNotNull()).alias("hit"), F.when(on, first).alias("hit_rank"),
        zero(F.size(F.array_intersect(seen, want)) / F.size(want)).alias("recall"), zero(F.lit(1.0) / first).alias("reciprocal_rank"),
        zero(gains / ideal).alias("ndcg"), "retrieved")


def tier1_metrics(scored_cases: DataFrame, by: list[str] | None = None) -> DataFrame:
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(F.col("scored"), c)), F.lit(0.0)), 4)
    return scored_cases.groupBy(*(by or [])).agg(
        F.count("*").alias("cases"), F.count_if("scored").alias("scored_cases"), mean(F.col("hit").cast("double")).alias("hit_at_k"),
        mean(F.col("recall")).alias("recall_at_k"), mean(F.col("reciprocal_rank")).alias("mrr"), mean(F.col("ndcg")).alias("ndcg_at_k"))


def by_category(scored_cases: DataFrame) -> DataFrame:
    """Overall and per category in one pass; cases without a category count overall only."""
    rows = scored_cases.where("scored").groupingSets([[], [F.col("category")]], F.col("category")).agg(
        F.grouping("category").alias("overall"), F.count("*").alias("cases"), F.round(F.avg(F.col("hit").cast("double")), 4).alias("hit_at_k"),
        F.round(F.avg("recall"), 4).alias("recall_at_k"))
    return rows.where("overall = 1 or category is not null")


def tier2_cases(cases: DataFrame, answers: DataFrame, judged: bool = True) -> DataFrame:
    """Per case: cited paths, citation_precision, invalid_count, refused, refusal_correct, faithfulness, relevance.

    ``answers``: id, answer, blocks, cited, invalid_markers, refused; blocks carry the cited text and path.
    """
    rows = cases.join(answers, "id")
    blocks = F.filter("blocks", lambda b: F.array_contains("cited", b["marker"]))
    rows = rows.withColumn("cited_blocks", F.coalesce(F.transform("cited", lambda m: F.element_at(F.filter(blocks, lambda b: b["marker"] == m), 1)), F.array().cast(answers.schema["blocks"].dataType)))
    paths = F.transform("cited_blocks", lambda b: b["key"])
    good = F.size(F.filter(paths, lambda p: F.array_contains("expected", p)))
    precision = F.when((F.size("cited") > 0) & scorable(), F.round(good / F.size("cited"), 4))
    faith, rel = answer.judge(F.col("text"), F.col("answer"), F.transform("cited_blocks", lambda b: b["text"]), F.col("refused"))
    none = F.lit(None).cast("double")
    return rows.select(
        *cases.columns, paths.alias("cited_keys"), precision.alias("citation_precision"), F.size("invalid_markers").alias("invalid_count"),
        F.size("cited").alias("citations"), "refused", unanswerable().alias("unanswerable"), (F.col("refused") == unanswerable()).alias("refusal_correct"),
        (faith if judged else none).alias("faithfulness"), (rel if judged else none).alias("relevance"))


def tier2_metrics(case_rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Precision is a mean over cases that cited; the invalid rate is pooled over markers; judge means are null without scores."""
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4)
    emitted = F.sum(F.col("citations") + F.col("invalid_count"))
    return case_rows.groupBy(*(by or [])).agg(
        F.count("*").alias("cases"), F.count_if("unanswerable").alias("unanswerable_cases"), F.count_if("refused").alias("refusals"),
        zero(F.avg("citation_precision")).alias("citation_precision"), zero(F.sum("invalid_count") / F.nullif(emitted, F.lit(0))).alias("invalid_marker_rate"),
        zero(F.avg(F.col("refusal_correct").cast("double"))).alias("refusal_accuracy"),
        F.round(F.avg("faithfulness"), 4).alias("faithfulness"), F.round(F.avg("relevance"), 4).alias("relevance"))


def comparisons(case_rows: DataFrame, base: str = "sparse", order: str = "id", resamples: int = stats.RESAMPLES, seed: int = stats.SEED) -> DataFrame:
    """a, b, scope, n, delta, ci, test and verdict of every configuration against ``base``, overall and by category.

    Over all cases: those that are not scored count as misses on both sides.
    """
    hits = case_rows.select("config", "id", F.coalesce("category", F.lit("uncategorized")).alias("category"), "hit")
    other = hits.where(F.col("config") != base).withColumnRenamed("hit", "a")
    both = other.join(hits.where(F.col("config") == base).select("id", F.col("hit").alias("b")), "id")
    scoped = both.withColumn("scope", F.explode(F.array(F.lit("overall"), "category")))
    ci = stats.bootstrap(scoped, ["config", "scope"], order, resamples, seed)
    out = stats.paired(scoped, ["config", "scope"]).join(ci, ["config", "scope"])
    ok, why = stats.reportable(F.col("n"), F.col("ci_low"), F.col("ci_high"))
    return out.select(
        F.col("config").alias("a"), F.lit(base).alias("b"), "scope", "n", F.round("delta", 4).alias("delta"), F.round("ci_low", 4).alias("ci_low"),
        F.round("ci_high", 4).alias("ci_high"), "a_only", "b_only", F.round("p_exact", 6).alias("p_exact"), ok.alias("reportable"), why.alias("reason"))


def build_scorecard(case_rows: DataFrame, metrics: Mapping[str, Mapping[str, float]], provenance: Mapping[str, Any], resamples: int = stats.RESAMPLES, seed: int = stats.SEED) -> dict[str, Any]:
    """Schema 1 from retained case rows (config, id, category, hit); what comes to the driver is one row per scope."""
    rows = case_rows.withColumn("category", F.coalesce("category", F.lit("uncategorized")))
    rates = rows.groupBy("category", "config").agg(F.count("*").alias("n"), F.avg(F.col("hit").cast("double")).alias("rate")).collect()
    slices: dict[str, Any] = {}
    for name in sorted({r["category"] for r in rates}):
        own = {r["config"]: r for r in rates if r["category"] == name}
        n = own["sparse"]["n"]
        slices[name] = {
            "n": n, "powered": n >= 30, "mde_at_80_power": stats.minimum_detectable_effect(case_rows.sparkSession, n, own["sparse"]["rate"]),
            "configs": {c: {"hit_at_5": round(own[c]["rate"], 4)} for c in CONFIGURATIONS}}
    found = [{
        "a": r["a"], "b": r["b"], "metric": "hit_at_5", "scope": r["scope"], "n": r["n"], "delta": r["delta"], "ci95": [r["ci_low"], r["ci_high"]],
        "mcnemar": {"a_only": r["a_only"], "b_only": r["b_only"], "p_exact": r["p_exact"]}, "reportable": r["reportable"], "reason": r["reason"],
    } for r in comparisons(rows, resamples=resamples, seed=seed).orderBy("a", "scope").collect()]
    card = {
        "schema_version": 1, "generated_at": datetime.now(UTC).isoformat(), "provenance": {**provenance, "bootstrap_seed": seed, "bootstrap_resamples": resamples},
        "configs": {c: dict(metrics[c]) for c in CONFIGURATIONS}, "slices": slices, "comparisons": found}
    validate_scorecard(card)
    return card


_PAIR = frozenset({"a_only", "b_only", "p_exact"})
_SHAPE: dict[str, Any] = {
    "": {"schema_version", "generated_at", "provenance", "configs", "slices", "comparisons"},
    "provenance": {"commit", "corpus", "golden", "embedder", "llm", "judge", "cost_usd", "cost_estimate_usd", "cost_expected_usd", "billed", "bootstrap_seed", "bootstrap_resamples"},
    "provenance.corpus": {"path", "documents", "chunks"}, "provenance.golden": {"path", "items"},
    "configs": set(CONFIGURATIONS), "configs.*": set(METRICS), "slices.*": {"n", "powered", "mde_at_80_power", "configs"},
    "slices.*.configs": set(CONFIGURATIONS), "slices.*.configs.*": {"hit_at_5"},
    "comparisons.*": {"a", "b", "metric", "scope", "n", "delta", "ci95", "mcnemar", "reportable", "reason"}, "comparisons.*.mcnemar": _PAIR,
}


def _at(card: Any, path: str) -> list[Any]:
    found = [card]
    for part in path.split(".") if path else []:
        if part == "*":
            found = [y for x in found for y in (x.values() if isinstance(x, Mapping) else x)]
        else:
            found = [x[part] for x in found]
    return found


def validate_scorecard(card: Any) -> None:
    """Exact key sets at every level, and billing that agrees with the spend."""
    for path, keys in _SHAPE.items():
        for x in _at(card, path):
            if not isinstance(x, Mapping) or set(x) != keys:
                raise ValueError(f"scorecard {path or 'root'}: expected {sorted(keys)}")
    p = card["provenance"]
    number = lambda x: isinstance(x, int | float) and not isinstance(x, bool)
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool)
    if card["schema_version"] != 1 or not isinstance(card["comparisons"], list) or any(not isinstance(c["ci95"], list) or len(c["ci95"]) != 2 for c in card["comparisons"]):
        raise ValueError("scorecard: bad version or comparisons")
    if not isinstance(p["billed"], bool) or not all(number(p[k]) for k in ("cost_usd", "cost_estimate_usd", "cost_expected_usd")) or p["billed"] != (p["cost_usd"] > 0):
        raise ValueError("scorecard: billed and costs do not agree")
    if not whole(p["bootstrap_seed"]) or not whole(p["bootstrap_resamples"]) or p["bootstrap_resamples"] <= 0:
        raise ValueError("scorecard: bad bootstrap settings")
