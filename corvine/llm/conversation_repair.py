"""Conversation structure repair: the cheapest edits that give every conversation a proper order of turns.

Roles by their initials must read ``(s?(ua)+)?``. Rows have faults first: blank, duplicate (role and text stood
earlier in the conversation) or truncated (no sentence end). Edits are Keep (0), Rerole to user or assistant (3), Delete
(4; the only edit for blank and duplicate rows) and Insert of an empty user or assistant turn (3); a truncated row that
stays costs 3 more. Of equally cheap edits those whose initials, in order, are least as text win.

Rows are dealt by conversation and sorted; a worker reads them in order and hands batches of conversations to a DuckDB
recursive query. Each recursion advances one turn in all conversations of the batch and keeps, for each conversation
and state of the grammar, the least cost and audit. A conversation longer than a batch goes on in the next one: costs
and audits of a part are kept by the state that it began in, and joined to those before, so what a batch holds is bounded.

Equal costs and rows never give audits of which one starts another (it would have more inserts, which cost), so the
least audit of a state stays the least whatever follows, and an audit tells what each edit made.

Defined results: null roles and texts are one space; a row without any role cannot be kept as it is; a null turn comes first and counts in no gap; rows that share
a turn are ordered by role and text, and equal ones by which is the duplicate; a null conv_id is a conversation; a
conversation without rows does not appear; an empty table gives no rows; extra columns are ignored; texts of any length
are read whole. One conversation's repaired turns have to fit a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corvine.runtime import slices

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: State of the grammar -> initial of the next role -> state. 0: nothing yet, 1: system, 2: user, 3: assistant.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ROLES = {"u": "user", "a": "assistant"}
ENDS = (0, 3)
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
#: Rows, and characters of text, of a batch.
BATCH_ROWS, BATCH_CHARS = 1 << 14, 8 << 20
#: Memory of a worker's DuckDB, which keeps no files.
MEMORY = "512MB"


def chains(state: int) -> Iterator[tuple[int, int]]:
    """(state, inserts) that up to two inserts reach; more than two never pay, as they come back to a state."""
    for n in range(3):
        yield state, n
        state = next(q for r, q in GRAMMAR[state].items() if r in ROLES)


def moves() -> list[tuple[int, str | None, bool, int, int, str]]:
    """(state, initial the row must have, deletes, next state, cost, edits) of inserts and then one row's edit."""
    out: list[tuple[int, str | None, bool, int, int, str]] = []
    for p in GRAMMAR:
        for q, n in chains(p):
            cost, ops = n * INSERT, "I" * n
            out.append((p, None, True, q, cost + DELETE, ops + "D"))
            for r, to in GRAMMAR[q].items():
                out.append((p, r, False, to, cost + KEEP, ops + "K"))
                if r in ROLES:
                    out.append((p, None, False, to, cost + REROLE, ops + "R"))
    return out


#: Every part of a conversation is advanced from the states in ``starts``; ``best`` compares cost, then audit.
_ADVANCE = f"""
WITH RECURSIVE path(cid, origin, state, pos, best) USING KEY (cid, origin, state) AS (
  SELECT cid, state, state, 0, {{'cost': 0::BIGINT, 'audit': ''}} FROM starts
  UNION
  SELECT p.cid, p.origin, m.next, p.pos + 1,
         min({{'cost': p.best.cost + m.cost + CASE WHEN r.truncated AND NOT m.deletes THEN {TRUNCATED} ELSE 0 END, 'audit': p.best.audit || m.edits}})
  FROM path p JOIN turns r ON r.cid = p.cid AND r.pos = p.pos
       JOIN moves m ON m.state = p.state AND (m.initial IS NULL OR m.initial = r.initial) AND (m.deletes OR NOT r.goes)
  GROUP BY p.cid, p.origin, m.next, p.pos)
SELECT cid, origin, state, best.cost, best.audit FROM path JOIN sizes USING (cid) WHERE pos = n"""

_COUNT = """
SELECT cid, count(*) FILTER (fault = 'blank'), count(*) FILTER (fault = 'duplicate'), count(*) FILTER (fault = 'truncated'),
       count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')), min(turn), max(turn), count(*) FILTER (first_of_turn)
FROM turns GROUP BY cid"""


@dataclass
class _Conversation:
    key: object
    counts: list[int] = field(default_factory=lambda: [0, 0, 0, 0])
    low: int | None = None
    high: int | None = None
    distinct: int = 0
    #: state -> (cost, audit, repaired turns)
    paths: dict[int, tuple[int, str, list[dict]]] = field(default_factory=lambda: {0: (0, "", [])})
    last_initial: str | None = None
    last_turn: int | None = None
    turns: list[tuple] = field(default_factory=list)  # of the batch: turn, role, text, fault, before, first_of_turn

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        self.turns.append((turn, role, text, fault, self.last_initial, turn is not None and turn != self.last_turn))
        self.last_initial, self.last_turn = role[:1], turn

    def extend(self, found: list[tuple[int, int, int, str]], counted: tuple) -> None:
        """Join what the batch's turns give, by state, to what was before."""
        self.counts = [a + b for a, b in zip(self.counts, counted[:4], strict=True)]
        if counted[4] is not None:
            self.low, self.high = counted[4] if self.low is None else self.low, counted[5]
        self.distinct += counted[6]
        best: dict[int, tuple[int, str, int, str]] = {}
        for origin, state, cost, audit in found:
            before = self.paths[origin]
            new = (before[0] + cost, before[1] + audit, origin, audit)
            best[state] = min(best.get(state, new), new)
        self.paths = {s: (cost, audit, replayed(self.paths[o][2], o, part, self.turns)) for s, (cost, audit, o, part) in best.items()}
        self.turns = []

    def result(self) -> dict:
        done = []
        for state, (cost, audit, turns) in self.paths.items():
            end, n = next((q, n) for q, n in chains(state) if q in ENDS)
            done.append((cost + n * INSERT, audit + "I" * n, state, turns))
        cost, audit, state, turns = min(done, key=lambda x: x[:2])
        blank, duplicate, truncated, illegal = self.counts
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        inserts = len(audit) - len(self.paths[state][1])
        return {"conv_id": self.key, "gaps": gaps, "blank": blank, "duplicate": duplicate, "truncated": truncated, "illegal": illegal,
                "cost": cost, "audit": audit, "repaired": replayed(turns, state, "I" * inserts, [])}


def replayed(before: list[dict], state: int, audit: str, turns: list[tuple]) -> list[dict]:
    """``before`` and what the edits make of ``turns``."""
    out, rows = list(before), iter(turns)
    for edit in audit:
        role, text = (None, "") if edit == "I" else next(rows)[1:3]
        if edit == "D":
            continue
        initial = role[:1] if edit == "K" else next(r for r in GRAMMAR[state] if r in ROLES)
        out.append({"role": role if edit == "K" else ROLES[initial], "text": text})
        state = GRAMMAR[state][initial]
    return out


def _connect():
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
    con.execute("CREATE TABLE moves (state INT, initial VARCHAR, deletes BOOLEAN, next INT, cost INT, edits VARCHAR)")
    con.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?, ?)", moves())
    return con


def _advance(con, held: list[_Conversation]) -> None:
    """One recursive query for the turns of all conversations in hand."""
    rows = [(c, p, *t) for c, conv in enumerate(held) for p, t in enumerate(conv.turns)]
    if not rows:
        return
    cid, pos, turn, role, _, fault, before, first = map(list, zip(*rows, strict=True))
    turns = pa.table({
        "cid": pa.array(cid, pa.int32()), "pos": pa.array(pos, pa.int32()), "turn": pa.array(turn, pa.int64()), "initial": pa.array([r[:1] for r in role], pa.string()),
        "fault": pa.array(fault, pa.string()), "goes": pa.array([f in ("blank", "duplicate") for f in fault]), "truncated": pa.array([f == "truncated" for f in fault]),
        "before": pa.array(before, pa.string()), "first_of_turn": pa.array(first)})
    starts = [(c, s) for c, conv in enumerate(held) if conv.turns for s in conv.paths]
    con.register("turns", turns)
    con.register("starts", pa.table({"cid": pa.array([c for c, _ in starts], pa.int32()), "state": pa.array([s for _, s in starts], pa.int32())}))
    con.register("sizes", pa.table({"cid": pa.array(range(len(held)), pa.int32()), "n": pa.array([len(c.turns) for c in held], pa.int32())}))
    found: dict[int, list] = {}
    for c, *rest in con.execute(_ADVANCE).fetchall():
        found.setdefault(c, []).append(tuple(rest))
    for c, *counted in con.execute(_COUNT).fetchall():
        held[c].extend(found[c], tuple(counted))
    for name in ("turns", "starts", "sizes"):
        con.unregister(name)


def _repair(schema: pa.Schema, batch_rows: int, batch_chars: int):
    def made(done: list[_Conversation]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([c.result() for c in done], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _connect()
        held: list[_Conversation] = []
        rows = chars = 0
        for batch in slices(batches):
            for r in batch.to_pylist():
                if not held or held[-1].key != r["conv_id"]:
                    if rows >= batch_rows or chars >= batch_chars:
                        _advance(con, held)
                        yield made(held)
                        held, rows, chars = [], 0, 0
                    held.append(_Conversation(r["conv_id"]))
                elif rows >= batch_rows or chars >= batch_chars:
                    # inside a conversation: the others are done, this one goes on
                    _advance(con, held)
                    if held[:-1]:
                        yield made(held[:-1])
                    held, rows, chars = held[-1:], 0, 0
                held[-1].add(r["turn"], r["role"], r["text"], r["fault"])
                rows, chars = rows + 1, chars + len(r["text"])
        if held:
            _advance(con, held)
            yield made(held)

    return run


def fault_of(duplicate: Column) -> Column:
    """A row's first fault, or "" ."""
    text = F.col("text")
    return (
        F.when(~text.rlike(r"[^\x20\x09-\x0D]"), "blank").when(duplicate, "duplicate")
        .when(~text.rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated").otherwise("")
    )


def repair_conversations(conversations: DataFrame, batch_rows: int = BATCH_ROWS, batch_chars: int = BATCH_CHARS) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired (array of role and text) of every
    conversation in ``conversations`` (conv_id, turn, role, text)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role"), space("text"))
    # where equal rows share a turn, any of them may be the one that counts
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.asc_nulls_first("turn"))) > 1
    rows = rows.withColumn("again", again).withColumn("fault", fault_of(F.col("again")))
    rows = rows.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "text", "again").drop("again")
    kind = conversations.schema["conv_id"].dataType.simpleString()
    schema = f"conv_id {kind}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role: string, text: string>>"
    return rows.mapInArrow(_repair(to_arrow_schema(StructType.fromDDL(schema)), batch_rows, batch_chars), schema)
