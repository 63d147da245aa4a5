import re
import zlib

import pytest

from corvine.llm.conversation_repair import repair_conversations
from corvine.llm.queries import damaged_turns

FIELDS = "conv_id long, turn long, role string, text string, repaired string, cost int"
BLANKS = " \t\n\x0b\x0c\r"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], FIELDS)


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        kept = text.strip(BLANKS)
        out.append("blank" if not kept else "duplicate" if (role, text) in seen else "" if kept[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def brute(rows):
    """Every sequence of edits of a short conversation that costs no more than the best so far."""
    bad, best = faults(rows), [(10**9, "", [])]

    def step(at, order, cost, audit, turns, inserts):
        if (cost, audit) > best[0][:2] or not re.fullmatch("s?(ua)*u?", order):
            return
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", order):
            best[0] = min(best[0], (cost, audit, turns))
        if inserts < 3:
            for r in ("user", "assistant"):
                step(at, order + r[0], cost + 3, audit + "I", [*turns, (r, "")], inserts + 1)
        if at < len(rows):
            _, role, text = rows[at]
            step(at + 1, order, cost + 4, audit + "D", turns, 0)
            if bad[at] in ("", "truncated"):
                more = 3 if bad[at] else 0
                if role:
                    step(at + 1, order + role[:1], cost + more, audit + "K", [*turns, (role, text)], 0)
                for r in ("user", "assistant"):
                    step(at + 1, order + r[0], cost + 3 + more, audit + "R", [*turns, (r, text)], 0)

    step(0, "", 0, "", [], 0)
    return best[0]


def expected(rows):
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for _, t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = [t for t, _, _ in rows if t is not None]
    bad, roles = faults(rows), [r[:1] for _, r, _ in rows]
    cost, audit, repaired = brute(rows)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(roles, roles[1:], strict=False))
    return (gaps, bad.count("blank"), bad.count("duplicate"), bad.count("truncated"), illegal, cost, audit, repaired)


def conversations():
    """Short conversations of all kinds from a generator: roles, faults, ties, nulls and repeats."""
    state, out = 12345, []

    def draw(n):
        nonlocal state
        state = (state * 1103515245 + 12345) % (1 << 31)
        return (state >> 12) % n

    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, ""]
    texts = ["One. ", "Two?", "no end", "", None, " .", " \t\n", "Three!\r\n", "One. ", "ünï 😀."]
    for c in range(60):
        rows = [(c, None if draw(9) == 0 else t + (draw(4) == 0), roles[draw(len(roles))], texts[draw(len(texts))]) for t in range(1 + draw(5))]
        out += rows + ([rows[0]] if draw(4) == 0 else [])
    out += [(100, 5, "user", "Alone."), (101, 0, "assistant", "Hm"), (None, 3, "user", "Nobody's."), (None, 4, "assistant", "Right.")]
    return out


@pytest.mark.parametrize("limit", [1, 7, 1 << 14])
def test_against_every_sequence_of_edits(spark, limit):
    """However small the batches, also where a conversation goes on over many of them."""
    rows = conversations()
    got = {r.conv_id: r for r in repair_conversations(frame(spark, rows), batch_rows=limit).collect()}
    assert set(got) == {r[0] for r in rows}
    for c, r in got.items():
        mine = (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, [(t.role, t.text) for t in r.repaired])
        assert mine == expected([x for x in rows if x[0] == c]), c


def test_long_conversation_and_text(spark):
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(3000)] + [(2, 0, "user", "x" * 400_000 + "."), (2, 1, "assistant", "word " * 100_000)]
    del rows[1500]
    got = {r.conv_id: r for r in repair_conversations(frame(spark, rows), batch_rows=256).collect()}
    assert got[1].gaps == 1 and got[1].cost == 3 and got[1].audit == "K" * 1500 + "I" + "K" * 1499 and len(got[1].repaired) == 3000
    assert got[2].truncated == 1 and got[2].cost == 3 and got[2].audit == "KK" and len(got[2].repaired[1].text) == 500_000


def test_empty_table(spark):
    assert repair_conversations(frame(spark, [])).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", f"A. b! c{c}? {t}") for c in range(40) for t in range(5)] + [(None, None, None, None), (None, 1, "user", "x.")]
    got = sorted(((r.conv_id, r.turn, r.role, r.text) for r in damaged_turns(frame(spark, rows)).collect()), key=str)
    want = []
    for c, t, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if kind:
            row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            want += [row, row] if kind == 3 else [row]
    assert got == sorted(want, key=str)
