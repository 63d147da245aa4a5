"""Context assembly under a token budget, prompts, and inverting them. Inventory 32, 84, 118, 120, 131, 134."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.functions.text import prompt_token_estimate, strip

#: What the prompt says around blocks and question.
HEADER, QUESTION, NO_BLOCKS = "Context blocks:", "Question:", "(no context blocks were retrieved)"
MAX_BLOCKS, MAX_TOKENS = 8, 6000
_NUMBERED = re.compile(r"^\[(\d+)\]\s*(.*)$")


def render_block(marker: Column, path: Column, title: Column, heading: Column | None, text: Column) -> Column:
    blank = lambda c: F.nullif(c, F.lit(""))
    parts = [F.concat(F.lit("source="), F.coalesce(blank(path), F.lit("unknown"))), F.concat(F.lit("title="), blank(title))]
    if heading is not None:
        parts.append(F.concat(F.lit("heading="), blank(heading)))
    return F.concat(F.lit("["), marker.cast("string"), F.lit("] "), F.concat_ws(" | ", *parts), F.lit("\n"), text)


def select_blocks(hits: DataFrame, query_key: str, max_blocks: int = MAX_BLOCKS, max_tokens: int = MAX_TOKENS, heading_in_prompt: bool = True) -> DataFrame:
    """query key, blocks array<struct<marker, key, source_path, rendered, text, score, rank, tokens>>, dropped, tokens.

    Blocks are taken greedily by rank: one that does not fit is passed over and a later, smaller one may
    still fit; the first is always taken. A fold over a query's few hits does what a running sum cannot. The
    cost of a block always counts its heading, whether the prompt shows it or not.
    """
    cols = ["rank", "key", "source_path", "title", "heading_path", "text", "score"]
    each = hits.groupBy(query_key).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("hits"))
    cost = lambda m, h: prompt_token_estimate(render_block(m, h["source_path"], h["title"], h["heading_path"], h["text"]))

    def step(acc: Column, h: Column) -> Column:
        n = F.size(acc["taken"])
        t = cost(n + 1, h)
        fits = (n < max_blocks) & ((n == 0) | (acc["used"] + t <= max_tokens))
        return F.struct(
            F.when(fits, F.concat(acc["taken"], F.array(h["rank"]))).otherwise(acc["taken"]).alias("taken"),
            F.when(fits, acc["used"] + t).otherwise(acc["used"]).alias("used"))

    start = F.struct(F.array().cast("array<int>").alias("taken"), F.lit(0).alias("used"))
    picked = each.withColumn("fold", F.aggregate(F.transform("hits", lambda h: h.withField("rank", h["rank"].cast("int"))), start, step))
    mine = F.filter("hits", lambda h: F.array_contains(F.col("fold.taken"), h["rank"].cast("int")))

    def block(h: Column, i: Column) -> Column:
        shown = render_block(i + 1, h["source_path"], h["title"], h["heading_path"] if heading_in_prompt else None, h["text"])
        return F.struct(
            (i + 1).alias("marker"), h["key"].alias("key"), h["source_path"].alias("source_path"), shown.alias("rendered"),
            h["text"].alias("text"), h["score"].alias("score"), h["rank"].alias("rank"), prompt_token_estimate(shown).alias("tokens"))

    return picked.select(
        query_key, F.transform(mine, block).alias("blocks"), (F.size("hits") - F.size("fold.taken")).alias("dropped"), F.col("fold.used").alias("tokens"))


def user_prompt(blocks: Column, question: Column) -> Column:
    shown = F.array_join(F.transform(blocks, lambda b: b["rendered"]), "\n\n")
    context = F.when(F.size(blocks) > 0, shown).otherwise(F.lit(NO_BLOCKS))
    return F.concat(F.lit(HEADER + "\n\n"), context, F.lit(f"\n\n{QUESTION} "), strip(question))


def parse_blocks(prompt: str) -> list[tuple[int, str]]:
    """(marker, body) of the blocks in a rendered prompt, up to the question; blank bodies go."""
    out: list[tuple[int, list[str]]] = []
    for line in prompt.splitlines():
        if line.startswith(QUESTION):
            break
        if m := _NUMBERED.match(line):
            out.append((int(m[1]), []))
        elif out:
            out[-1][1].append(line)
    return [(n, body) for n, lines in out if (body := "\n".join(lines).strip())]
