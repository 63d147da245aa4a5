"""Chat formatting [native]: a finite-state machine over roles and a declarative template.

A template names, for each role, the control strings that open and close a turn and whether the
turn's text counts in the loss. Texts are escaped so that no control string can occur inside them:
a control string in a text, with any number of backslashes after its first character, gets one more
backslash there; reading back takes one away. The escaping is a bijection, so it is reversible for
every text, including texts that hold escaped control strings already.

Defined results: null text is the empty text; null role is the empty role; null conv_id is a
conversation of its own; rows are ordered by (turn, role, text) with null turns first, so repeated
rows and tied turns give the same output every time; an empty table gives no rows; other columns of
the input are ignored. A conversation is one output value, so one conversation's text must fit a row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Turn:
    open: str
    close: str
    loss: bool = False


@dataclass(frozen=True)
class ChatTemplate:
    """Declarative template: turns by role, a form for any other role, and the allowed turn order."""

    turns: dict[str, Turn] = field(default_factory=lambda: {
        "system": Turn("[SYS] ", " [/SYS]"),
        "user": Turn("[INST] ", " [/INST]"),
        "assistant": Turn("<s> ", " </s>", loss=True),
    })
    other_open: str = "[TURN "
    other_close: str = " [/TURN]"
    #: state -> roles that may follow; the state is the role read last.
    follows: dict[str, tuple[str, ...]] = field(default_factory=lambda: {
        "": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",),
    })
    accepting: tuple[str, ...] = ("assistant",)

    def controls(self) -> list[str]:
        own = [s.strip() for t in self.turns.values() for s in (t.open, t.close)]
        return [*own, self.other_open, self.other_close.strip()]

    def _rests(self) -> dict[str, str]:
        """By the first character of control strings, a pattern for what follows it."""
        by_first: dict[str, list[str]] = {}
        for c in self.controls():
            by_first.setdefault(c[0], []).append(re.escape(c[1:]))
        return {re.escape(f): "|".join(rest) for f, rest in by_first.items()}

    def escape(self, text: Column) -> Column:
        for first, rest in self._rests().items():
            text = F.regexp_replace(text, rf"({first})(?=\\*(?:{rest}))", r"$1\\")
        return text

    def unescape(self, text: Column) -> Column:
        for first, rest in self._rests().items():
            text = F.regexp_replace(text, rf"({first})\\(?=\\*(?:{rest}))", "$1")
        return text

    def turn_pattern(self) -> str:
        """Groups: 1 a known role's opener, 2 another role in hex, 3 the escaped text."""
        opens = "|".join(re.escape(t.open) for t in self.turns.values())
        closes = "|".join(re.escape(t.close) for t in [*self.turns.values(), Turn("", self.other_close)])
        return rf"(?s)(?:({opens})|{re.escape(self.other_open)}([0-9A-F]*)\] )(.*?)(?:{closes})"


def format_conversations(conversations: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """One row per conversation: conv_id, valid, first_bad_turn, segments, formatted.

    ``segments`` is array<struct<text, loss>>; ``formatted`` is their concatenation. ``valid`` says
    whether the state machine accepts the turn order; ``first_bad_turn`` is the position (from 0) of
    the first turn it refuses. Conversations that it refuses are formatted too, and marked.
    """
    t = template or ChatTemplate()
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    known = [F.col("role") == r for r in t.turns]
    opening = F.concat(F.lit(t.other_open), F.hex(F.encode(role, "UTF-8")), F.lit("] "))
    closing, loss = F.lit(t.other_close), F.lit(False)
    for is_role, turn in zip(known, t.turns.values(), strict=True):
        opening = F.when(is_role, turn.open).otherwise(opening)
        closing = F.when(is_role, turn.close).otherwise(closing)
        loss = F.when(is_role, turn.loss).otherwise(loss)
    rows = conversations.select(
        "conv_id", "turn", role.alias("role"), opening.alias("o"), closing.alias("c"), loss.alias("l"),
        t.escape(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
    )
    turns = rows.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "text", "o", "c", "l"))).alias("turns")
    )
    pairs = [f"{s}>{r}" for s, rs in t.follows.items() for r in rs]

    def step(acc: Column, x: Column) -> Column:
        ok = F.concat(acc["state"], F.lit(">"), x["role"]).isin(pairs)
        return F.struct(
            x["role"].alias("state"), (acc["i"] + 1).alias("i"),
            F.when((acc["bad"] < 0) & ~ok, acc["i"]).otherwise(acc["bad"]).alias("bad"),
        )

    start = F.struct(F.lit("").alias("state"), F.lit(0).alias("i"), F.lit(-1).alias("bad"))
    run = turns.withColumn("fsm", F.aggregate("turns", start, step))
    segments = F.flatten(F.transform("turns", lambda x: F.array(
        F.struct(x["o"].alias("text"), F.lit(False).alias("loss")),
        F.struct(x["text"].alias("text"), x["l"].alias("loss")),
        F.struct(x["c"].alias("text"), F.lit(False).alias("loss")),
    )))
    bad = F.col("fsm.bad")
    return run.select(
        "conv_id",
        ((bad < 0) & F.col("fsm.state").isin(list(t.accepting))).alias("valid"),
        F.when(bad >= 0, bad).alias("first_bad_turn"),
        segments.alias("segments"),
    ).withColumn("formatted", F.array_join(F.transform("segments", lambda s: s["text"]), ""))


def read_back(formatted: DataFrame, template: ChatTemplate | None = None) -> DataFrame:
    """Parse :func:`format_conversations` output: turns array<struct<role, text>> and loss_text, unescaped."""
    t = template or ChatTemplate()
    p = t.turn_pattern()
    part = [F.regexp_extract_all("formatted", F.lit(p), F.lit(i)) for i in (1, 2, 3)]
    cols = formatted.select("*", part[0].alias("_o"), part[1].alias("_h"), part[2].alias("_t"))

    def named(x: Column) -> Column:
        out = F.decode(F.unhex(x["_h"]), "UTF-8")
        for r, turn in t.turns.items():
            out = F.when(x["_o"] == turn.open, r).otherwise(out)
        return F.struct(out.alias("role"), t.unescape(x["_t"]).alias("text"))

    losses = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: t.unescape(s["text"]))
    return cols.withColumn("turns", F.transform(F.arrays_zip("_o", "_h", "_t"), named)).withColumn(
        "loss_text", F.array_join(losses, "")
    ).drop("_o", "_h", "_t")
