"""License scans [native]: ordered signature rules gated by keywords, with suppression of overlaps.

A document whose lower-cased text holds no keyword stem of any rule is never normalised and runs no
rule. For the others the text becomes lower-cased words joined by single spaces, each rule whose keyword
occurs runs its pattern over that, and matches become intervals of word positions. A detection is
suppressed when a detection of another label (a) contains it and is longer, or (b) overlaps it with a
higher priority. The contract's base phrases are found in every place and never suppressed.

Defined results: null text counts as empty (no words, no labels, score 0); repeated rows are scanned one
by one; an empty table gives no rows; extra columns are ignored; whole texts are scanned, whatever the length.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.llm.license_rules import BASE, RULES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"

#: Every pattern holds one of these stems, or one of the short words below, so a text without any needs no further look.
STEMS = (
    "licen", "apache", "mozilla", "cecill", "wtfpl", "beerware", "commons", "domain", "permission", "redistribution", "altered", "rights", "proprietary",
    "unauthorized", "reproduced", "commercial", "research", "copyright",
)
#: Short words that other words often hold; they count only as whole words.
SHORT = ("gpl", "gfdl", "bsd", "mpl", "epl", "cddl", "eupl", "asl", "ofl", "cc0", "train", "perl", "cc", "mit")
SHORT_WORDS = rf"(?<!{WORD})(?:[al]?gplv?[0-9]?|gfdl|bsd|mpl|epl|cddl|eupl|asl|ofl|cc0|train(?:ing)?|perl|cc{NOT_WORD}+by|mit{NOT_WORD}+(?:0|no{NOT_WORD}+attribution))(?!{WORD})"

KEYWORDS = tuple(dict.fromkeys(r.keyword for r in RULES))

#: Detections are ordered by where they start, and each is compared with so many before and after it.
#: Where one further off may overlap it, as the text's longest detection tells, it is compared with all.
NEAR = 256


def _count(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[^ ]+"))


def _word_count(raw: Column) -> Column:
    """Number of words: each with what surrounds it becomes one character, and no word is made into a string."""
    return F.when(raw.rlike(WORD), F.length(F.regexp_replace(raw, f"{NOT_WORD}*+{WORD}++{NOT_WORD}*+", "x"))).otherwise(0)


def _places(norm: Column, pattern: Column) -> Column:
    """array<struct<s, e>> of word positions [s, e) where the pattern matches, in order."""
    gaps = F.transform(F.split(norm, pattern, -1), _count)
    found = F.transform(F.regexp_extract_all(norm, pattern, F.lit(0)), _count)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,e:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + x["gap"]
        return F.struct((s + x["n"]).alias("at"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), (s + x["n"]).alias("e")))).alias("out"))

    pairs = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, n: F.struct(g.alias("gap"), n.alias("n")))
    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def scan_licenses(documents: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections."""
    raw = F.coalesce(F.col(text).cast("string"), F.lit(""))
    low = F.lower(raw)
    holds = lambda stems: reduce(or_, (F.contains(F.col("_low"), F.lit(x)) for x in stems))
    gate = holds(STEMS) | (holds(SHORT) & F.col("_low").rlike(SHORT_WORDS))
    docs = documents.select("doc_id", raw.alias("_raw"), low.alias("_low")).withColumn("_gate", gate)
    words = F.regexp_replace(F.translate("_raw", UPPER, LOWER), f"{NOT_WORD}+", " ")
    docs = docs.select(
        "doc_id", _word_count(F.col("_raw")).cast("long").alias("n_words"),
        F.when(F.col("_gate"), F.concat(F.lit(" "), F.trim(words), F.lit(" "))).alias("norm"),
    )
    rules = F.array(*[F.struct(
        F.lit(r.label).alias("label"), F.lit(r.priority).alias("p"), F.lit(KEYWORDS.index(r.keyword)).alias("k"), F.lit(f"(?<= ){r.pattern}(?= )").alias("re"),
    ) for r in RULES])
    base = F.array(*[F.struct(F.lit(label).alias("label"), F.lit(f"(?<= ){phrase}(?= )").alias("re"), F.lit(f" {phrase} ").alias("k")) for label, phrase in BASE])

    def spans(r: Column, p: Column) -> Column:
        return F.transform(_places(F.col("norm"), r["re"]), lambda x: F.struct(r["label"].alias("label"), p.alias("p"), x["s"].alias("s"), x["e"].alias("e")))

    run = docs.withColumn("base", F.when(F.col("norm").isNotNull(), F.flatten(F.transform(
        F.filter(base, lambda r: F.contains(F.col("norm"), r["k"])), lambda r: spans(r, F.lit(99))))))
    # each keyword is looked for once, whatever the number of its rules; bound by a lambda, else it would be done for every rule
    there = F.transform(F.array(*[F.lit(" " + k) for k in KEYWORDS]), lambda k: F.contains(F.col("norm"), k))
    due = F.get(F.transform(F.array(there), lambda t: F.filter(rules, lambda r: F.get(t, r["k"]))), F.lit(0))
    run = run.withColumn("found", F.when(F.col("norm").isNotNull(), F.flatten(F.transform(due, lambda r: spans(r, r["p"]))))).drop("norm")
    everything = F.transform(
        F.array_sort(F.array_distinct(F.transform(F.concat("base", "found"), lambda d: F.struct(d["s"].alias("s"), d["e"].alias("e"), d["label"].alias("label"), d["p"].alias("p"))))),
        lambda d: F.struct(d["label"].alias("label"), d["p"].alias("p"), d["s"].alias("s"), d["e"].alias("e")))

    def beaten(d: Column, i: Column) -> Column:
        before, after = F.get("all", i - NEAR - 1)["s"], F.get("all", i + NEAR + 1)["s"]
        enough = F.coalesce(before + F.col("longest") <= d["s"], F.lit(True)) & F.coalesce(after >= d["e"], F.lit(True))
        near = F.slice("all", F.greatest(i + 1 - NEAR, F.lit(1)), F.lit(2 * NEAR + 1))
        return F.exists(F.when(enough, near).otherwise(F.col("all")), lambda e: (e["label"] != d["label"]) & (
            ((e["s"] <= d["s"]) & (e["e"] >= d["e"]) & (e["e"] - e["s"] > d["e"] - d["s"])) | ((e["s"] < d["e"]) & (d["s"] < e["e"]) & (e["p"] > d["p"]))))

    run = run.withColumn("all", everything).withColumn("longest", F.array_max(F.transform("all", lambda d: d["e"] - d["s"])))
    run = run.withColumn("kept", F.filter("all", lambda d, i: (d["p"] == 99) | ~beaten(d, i)))
    label_list = lambda c: F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform(c, lambda d: d["label"]))), ","), F.lit(""))
    starts = F.transform("base", lambda d: d["s"])
    strength = F.array_max(F.transform("kept", lambda d: F.least(d["p"], F.lit(10)) / F.lit(10.0)))
    return run.select(
        "doc_id", "n_words", F.when(F.col("base").isNull(), 0).otherwise(F.size("base")).cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        label_list(F.col("base")).alias("base_labels"), label_list(F.col("kept")).alias("labels"),
        F.coalesce(strength, F.lit(0.0)).alias("score"),
        F.coalesce(F.transform("kept", lambda d: F.struct(d["label"].alias("label"), d["s"].alias("start"), d["e"].alias("end"))), F.array().cast("array<struct<label:string,start:int,end:int>>")).alias("detections"),
    )
