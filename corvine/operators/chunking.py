"""Structural Markdown chunking. Inventory 24-28, 44, 174.

A chunk is always one span of its section, so the cutter works on positions and never copies pieces:
:func:`cuts` lists where pieces end, :func:`spans` packs them. Documents are independent, so the operator
is one narrow ``mapInArrow`` stage without a shuffle; ids and estimates are expressions on top of it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.functions import identity, text
from corvine.runtime import slices

#: Heading and fence forms and the version name of these rules.
_HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")
_FENCE = re.compile(r"^\s{0,3}(?:```|~~~)")
#: Documents that are cut at a time.
ROWS = 200
VERSION = "structural-markdown-v1"
PIECES = pa.list_(pa.struct([("text", pa.string()), ("heading", pa.string()), ("heading_path", pa.list_(pa.string())), ("kept", pa.bool_())]))


@dataclass(frozen=True)
class ChunkRules:
    size: int = 800
    overlap: int = 120
    least: int = 120
    separators: tuple[str, ...] = ("\n## ", "\n### ", "\n\n", "\n", ". ", " ")
    heading_context: bool = True

    def __post_init__(self):
        if self.size <= 0 or not 0 <= self.overlap < self.size:
            raise ValueError("overlap must be less than size")

    @property
    def version(self) -> str:
        return f"{VERSION}:size={self.size}:overlap={self.overlap}"


def sections(body: str) -> Iterator[tuple[str | None, list[str], str]]:
    """(heading, heading path, body) of every section with a body, in order."""
    heading, stack, lines, fenced = None, [], [], False
    for line in [*body.splitlines(), None]:
        found = None
        if line is not None:
            if _FENCE.match(line):
                fenced = not fenced
            elif not fenced:
                found = _HEADING.match(line)
            if found is None:
                lines.append(line)
                continue
        whole = "\n".join(lines).strip()
        if whole:
            yield heading, [h for _, h in stack], whole
        lines = []
        if found is not None:
            level, heading = len(found[1]), found[2].strip()
            stack = [x for x in stack if x[0] < level] + [(level, heading)]


def cuts(s: str, lo: int, hi: int, separators: tuple[str, ...], limit: int) -> Iterator[int]:
    """Ends of consecutive pieces of s[lo:hi], none longer than ``limit``; weaker separators only where needed."""
    if hi - lo <= limit:
        if hi > lo:
            yield hi
        return
    if not separators:
        yield from range(lo + limit, hi, limit)
        yield hi
        return
    mark, weaker = separators[0], separators[1:]
    # a separator that opens something stays with what follows, another with what it ends
    shift = 0 if mark.startswith("\n") and mark.strip() else len(mark)
    at, start = s.find(mark, lo, hi), lo
    while at >= 0:
        if at + shift > start:
            yield from cuts(s, start, at + shift, weaker, limit)
            start = at + shift
        at = s.find(mark, at + len(mark), hi)
    if hi > start:
        yield from cuts(s, start, hi, weaker, limit)


def spans(s: str, rules: ChunkRules) -> Iterator[tuple[int, int]]:
    """Spans of the chunks of a stripped text."""
    if len(s) <= rules.size:
        yield 0, len(s)
        return
    starts, low, at = [0], 0, 0  # where the pieces of the open chunk begin; its span is [low, at)
    for end in cuts(s, 0, len(s), rules.separators, rules.size):
        if low < at and end - low > rules.size:
            yield low, at
            # whole pieces from behind until the overlap is reached; one long piece is cut to it
            k = max(0, bisect_right(starts, at - rules.overlap) - 1) if rules.overlap else len(starts)
            starts = starts[k:]
            if not rules.overlap:
                starts, low = [], at
            elif len(starts) == 1 and at - starts[0] > rules.overlap:
                starts, low = [at - rules.overlap], at - rules.overlap
            else:
                low = starts[0]
            room = rules.size - (end - at)
            if at - low > room:
                low = at - max(0, room)
                starts = [low] if low < at else []
        if not starts or starts[-1] != at:
            starts.append(at)
        at = end
    if low < at:
        yield low, at


def split_text(body: str, rules: ChunkRules) -> list[str]:
    whole = body.strip()
    return [c for a, b in spans(whole, rules) if (c := whole[a:b].strip())] if whole else []


def chunk_text(body: str | None, rules: ChunkRules) -> list[dict]:
    whole = (body or "").strip()
    if not whole:
        return []
    if len(whole) < rules.least:
        return [{"text": whole, "heading": None, "heading_path": [], "kept": True}]
    return [{"text": c, "heading": h, "heading_path": path, "kept": len(c) >= rules.least} for h, path, own in sections(body) for c in split_text(own, rules)]


def _chunk_batches(rules: ChunkRules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a batch of long texts and its pieces would be many times its size at once
        for batch in slices(batches, ROWS):
            pieces = pa.array([chunk_text(t.as_py(), rules) for t in batch.column("text")], PIECES)
            keep = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], pieces], [*keep, "pieces"])

    return run


def chunk_documents(documents: DataFrame, rules: ChunkRules | None = None) -> DataFrame:
    """Chunks of documents(source_path, text, title, source, tags), with ids, digests, embed texts and estimates.

    Rows of dropped pieces stay with ``kept`` false and a null index, so that they can be counted; filter on ``kept``.
    """
    rules = rules or ChunkRules()
    meta = "source_path string, title string, source string, tags array<string>"
    cut = documents.select("source_path", "title", "source", "tags", "text").mapInArrow(
        _chunk_batches(rules), f"{meta}, pieces array<struct<text:string,heading:string,heading_path:array<string>,kept:boolean>>")
    # the index runs over kept pieces only; the kept ones are numbered within their own array
    kept, lost = F.filter("pieces", lambda p: p["kept"]), F.filter("pieces", lambda p: ~p["kept"])
    numbered = F.concat(
        F.transform(kept, lambda p, i: F.struct(p.alias("p"), i.alias("i"))),
        F.transform(lost, lambda p: F.struct(p.alias("p"), F.lit(None).cast("int").alias("i"))))
    rows = cut.withColumn("x", F.explode(numbered)).select(
        "source_path", "title", "source", "tags", F.col("x.p.text").alias("text"), F.col("x.p.heading").alias("heading"),
        F.col("x.p.heading_path").alias("_path"), F.col("x.p.kept").alias("kept"), F.col("x.i").alias("chunk_index"))
    embed = text.embed_text(F.col("text"), F.col("title"), F.col("_path")) if rules.heading_context else F.col("text")
    doc, digest = identity.doc_id(F.col("source_path")), identity.sha256_text(F.col("text"))
    return rows.select(
        doc.alias("doc_id"), F.when(F.col("kept"), identity.chunk_id(doc, F.col("chunk_index"))).alias("chunk_id"),
        F.when(F.col("kept"), identity.point_id(F.col("source_path"), F.col("chunk_index"), digest)).alias("point_id"),
        "chunk_index", "text", embed.alias("embed_text"), digest.alias("content_sha256"), "source_path", "source", "title", "heading",
        F.nullif(F.array_join("_path", " > "), F.lit("")).alias("heading_path"), text.chunk_token_estimate(F.col("text")).alias("token_count_est"), "tags", "kept")
