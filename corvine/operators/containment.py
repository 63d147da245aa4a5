"""Which texts hold which passages verbatim, as an equi-join. Inventory 58, 61, 67.

Words are what stands between single spaces. The inner words of a passage (all but its first and last, which may be
parts of words in a text) are words of any text that holds it, so each passage is filed under the inner word that the
fewest texts have. Texts give those of their words that some passage is filed under, the join brings the passages, and a
substring test decides. Passages without inner words are compared with all texts, in blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.functions.text import let
from corvine.runtime import broadcast_if_small, materialize, row_count

#: Words that a scan is asked for by name; more go through a join.
INLINE_WORDS = 20_000
#: Short passages in one block, and characters of them.
BLOCK, BLOCK_CHARS = 200, 1 << 16


def _quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("\\", "\\\\").replace("'", "\\'") + "'" for w in words)


def _words(c: Column) -> Column:
    return F.split(c, " ")


def _given(texts: DataFrame, key: str, text: str, words: DataFrame, keep_text: bool) -> DataFrame:
    """key, (text,) word: the words of each text, once, that are in ``words``."""
    kept = [key, text] if keep_text else [key]
    named = [r["word"] for r in words.limit(INLINE_WORDS + 1).collect()]
    if len(named) > INLINE_WORDS:
        rows = texts.select(*kept, F.explode(F.array_distinct(_words(F.col(text)))).alias("word"))
        return rows.join(broadcast_if_small(words, row_count(words), 48), "word", "left_semi").select(*kept, "word")
    some = F.expr(f"filter(split(`{text}`, ' '), w -> w in ({_quoted(named)}))") if named else F.array().cast("array<string>")
    return texts.select(*kept, F.explode(F.array_distinct(some)).alias("word"))


def holding(texts: DataFrame, key: str, text: str, passages: DataFrame, passage_key: str, passage: str) -> DataFrame:
    """key, passage_key: every text with every passage that it holds. Null and empty passages are held by none, null texts hold none.

    Passages that repeat count once, texts that repeat one by one. No plan of this has a join without keys, and only passages move.
    """
    asked = passages.select(passage_key, F.col(passage).alias("_passage")).where("_passage <> ''").distinct()
    inner = lambda words: F.array_distinct(F.filter(words, lambda w, i: (i > 0) & (i < F.size(words) - 1) & (w != "")))
    asked = asked.withColumn("_inner", let(_words(F.col("_passage")), inner)).withColumn("_n", F.monotonically_increasing_id())
    asked = materialize(asked, "passages", 1024)
    have = texts.where(F.col(text).isNotNull()).select(key, text)

    each = asked.select("_n", F.explode("_inner").alias("word"))
    words = materialize(each.select("word").distinct(), "inner", 48)
    df = materialize(_given(have, key, text, words, False).groupBy("word").agg(F.count("*").alias("df")), "df", 56)
    # a word that no text has rules its passage out
    rarest = each.join(broadcast_if_small(df, row_count(df), 56), "word", "left").groupBy("_n").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "word")).alias("r"))
    filed = asked.join(rarest.where("r.df > 0").select("_n", F.col("r.word").alias("word")), "_n").select(passage_key, "_passage", "word")
    filed = materialize(filed, "filed", 1024)
    anchors = materialize(filed.select("word").distinct(), "anchors", 48)
    pairs = _given(have, key, text, anchors, True).join(broadcast_if_small(filed, row_count(filed), 1024), "word")
    out = pairs.where(F.contains(text, "_passage")).select(key, passage_key)

    short = asked.where(F.size("_inner") == 0).select(passage_key, "_passage")
    for block in _blocks(short, passage_key):
        kind = short.schema[passage_key].dataType.simpleString()
        found = F.filter(F.array(*[F.struct(F.lit(k).cast(kind).alias(passage_key), F.lit(p).alias("p")) for k, p in block]), lambda b: F.contains(F.col(text), b["p"]))
        out = out.unionByName(have.select(key, F.explode(found).alias("b")).select(key, F.col("b").getField(passage_key).alias(passage_key)))
    return out


def _blocks(short: DataFrame, passage_key: str):
    """Short passages in blocks of bounded size; each block is one more expression over the texts."""
    block: list = []
    chars = 0
    for r in short.toLocalIterator():
        block.append((r[passage_key], r["_passage"]))
        chars += len(r["_passage"])
        if len(block) >= BLOCK or chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block
