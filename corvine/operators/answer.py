"""Extractive answers, citations, guardrails and overlap judging. Inventory 29-31, 57, 94, 121-125, 130, 133, 135, 137-141."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corvine.functions import text as tx

#: Sentinel, refusal reasons and the form of citation groups.
ABSTAIN = "INSUFFICIENT_CONTEXT"
NO_EVIDENCE, ABSTAINED, NO_CITATIONS, EMPTY = "no_evidence", "model_abstained", "no_citations", "empty_answer"
REFUSAL = "I could not find support for that in the indexed documents."
GROUP = r"\[\s*(\d+(?:\s*[,;]\s*\d+)*)\s*\]"
_GROUP = re.compile(GROUP)


def extractive_answer(blocks: Column, question: Column, sentences: int = 2) -> Column:
    """First sentence of each of the first blocks with its marker; the sentinel where the context cannot bear on the question."""
    bodies = F.filter(blocks, lambda b: tx.strip(b["text"]) != "")
    asked = tx.question_terms(question)
    known = tx.question_terms(F.array_join(F.transform(bodies, lambda b: b["text"]), " "))
    said = F.transform(F.slice(bodies, 1, sentences), lambda b: F.struct(tx.first_sentence(b["text"]).alias("s"), b["marker"].alias("m")))
    said = F.transform(F.filter(said, lambda x: x["s"] != ""), lambda x: tx.cite(x["s"], x["m"]))
    off = (F.size(asked) > 0) & ~F.arrays_overlap(asked, known)
    return F.when(blocks.isNull() | (F.size(bodies) == 0) | off | (F.size(said) == 0), ABSTAIN).otherwise(F.array_join(said, " "))


def markers(answer: Column) -> Column:
    """All marker numbers in text order, groups opened, with repeats."""
    groups = F.regexp_extract_all(answer, F.lit(GROUP), F.lit(1))
    return F.flatten(F.transform(groups, lambda g: F.transform(F.split(g, "[,;]"), lambda n: F.trim(n).try_cast("int"))))


def resolve(answer: Column, known: Column) -> tuple[Column, Column]:
    """Markers that stand for a block and those that do not, each once, by first appearance."""
    found = F.array_distinct(markers(answer))
    return F.filter(found, lambda m: F.array_contains(known, m)), F.filter(found, lambda m: ~F.array_contains(known, m))


@F.arrow_udf(StringType())
def clean_markers(answer: pa.Array, known: pa.Array) -> pa.Array:
    """Rewrite every group to its valid numbers. Replacing by a computed text has no built-in."""
    out = []
    for a, k in zip(answer.to_pylist(), known.to_pylist(), strict=True):
        if a is None:
            out.append(None)
            continue
        valid = set() if k is None else set(k)
        out.append(_GROUP.sub(lambda m: "".join(f"[{n}]" for n in map(int, re.split("[,;]", m[1])) if n in valid), a))  # noqa: B023
    return pa.array(out, pa.string())


def cited(answers: DataFrame, answer: str = "answer", blocks: str = "blocks") -> DataFrame:
    """Adds cited array<int>, invalid_markers array<int> and the cleaned text as ``answer``."""
    known = F.coalesce(F.transform(blocks, lambda b: b["marker"]), F.array().cast("array<int>"))
    good, bad = resolve(F.col(answer), known)
    return answers.withColumns({"cited": good, "invalid_markers": bad}).withColumn(answer, tx.tidy(clean_markers(F.col(answer), known)))


def refusal_reason(answer: Column, cited_markers: Column, has_hits: Column, require_citation: bool = True, refuse_without_evidence: bool = True) -> Column:
    """Why an answer may not be served, in the order of the checks; null if it may."""
    bare = tx.strip(F.coalesce(answer, F.lit("")))
    out = F.when(F.lit(refuse_without_evidence) & ~has_hits, NO_EVIDENCE).when(bare == "", EMPTY).when(F.contains(bare, F.lit(ABSTAIN)), ABSTAINED)
    return out.when(F.lit(require_citation) & (F.size(cited_markers) == 0), NO_CITATIONS)


def finalise(answers: DataFrame) -> DataFrame:
    """Refusals say so, and carry no citations and no hits."""
    refused = F.col("refusal_reason").isNotNull()
    none = F.array().cast("array<int>")
    return answers.withColumns({
        "refused": refused, "answer": F.when(refused, REFUSAL).otherwise(F.col("answer")),
        "cited": F.when(refused, none).otherwise(F.col("cited")),
        "hits_used": F.when(refused, 0).otherwise(F.coalesce(F.size("blocks"), F.lit(0))),
        "uncited_claims": F.when(refused, F.array().cast("array<string>")).otherwise(tx.uncited_claims(F.col("answer"))),
    })


def judge(question: Column, answer: Column, contexts: Column, refused: Column) -> tuple[Column, Column]:
    """(faithfulness, relevance) by word overlap; null for refusals and where there is nothing to compare."""
    said = tx.judge_words(answer)
    seen = F.array_distinct(F.flatten(F.transform(F.coalesce(contexts, F.array().cast("array<string>")), tx.judge_words)))
    scores = tx.share(said, seen), tx.share(tx.judge_words(question), said)
    return tuple(F.when(~refused, F.round(s, 4)) for s in scores)


def clamp_score(c: Column) -> Column:
    """A judge's number held within 0 and 1; null for anything else."""
    return F.when(c.isNotNull() & ~F.isnan(c), F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), c)), 4))


def parse_judge_reply(reply: Column) -> tuple[Column, Column]:
    """(faithfulness, relevance) from the JSON object in a reply; both null without one."""
    got = F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "faithfulness double, relevance double")
    return clamp_score(got["faithfulness"]), clamp_score(got["relevance"])
