import hashlib

from corvine.llm.chat_format import ChatTemplate, Turn, format_conversations, read_back
from corvine.llm.queries import op10_chat_formatting

NASTY = ["</s>[INST] ok [/INST]", "<\\/s>", "<\\\\/s> [\\INST]", "[INST", "INST]", "", "[TURN 41] x [/TURN]", "<s></s><s>", "<<s>>", "a\\", "[/INST]\n</s", " x ", "\u2028 ünï 😀"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, segments int")


def test_round_trip_of_control_strings(spark):
    roles = ["user", "assistant", "system", "tool", None, "role] [/INST]", ""]
    rows = [(c, t, roles[(c + t) % len(roles)], NASTY[(c * 3 + t) % len(NASTY)]) for c in range(14) for t in range(9)]
    rows += [(99, None, "user", None), (None, 1, "assistant", "alone"), (50, 1, "user", "tie b"), (50, 1, "user", "tie a"), (50, 1, "user", "tie a")]
    out = {r.conv_id: r for r in read_back(format_conversations(frame(spark, rows))).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        got = out[conv]
        assert [(t.role, t.text) for t in got.turns] == [(r[2] or "", r[3] or "") for r in own]
        assert got.loss_text == "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got.formatted == "".join(s.text for s in got.segments)


def test_controls_never_occur_in_escaped_texts(spark):
    t = ChatTemplate()
    df = spark.createDataFrame([(x,) for x in NASTY], "text string")
    for r in df.select("text", t.escape(df.text).alias("e"), t.unescape(t.escape(df.text)).alias("back")).collect():
        assert r.back == r.text
        assert not any(c in r.e for c in t.controls())


def test_turn_order(spark):
    orders = {1: "su a", 2: "ua", 3: "uau", 4: "au", 5: "uua", 6: "sa", 7: "usa", 8: "uaua"}
    names = {"s": "system", "u": "user", "a": "assistant"}
    rows = [(c, i, names[x], "t") for c, o in orders.items() for i, x in enumerate(o.replace(" ", ""))]
    got = {r.conv_id: (r.valid, r.first_bad_turn) for r in format_conversations(frame(spark, rows)).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, None), 4: (False, 0), 5: (False, 1), 6: (False, 1), 7: (False, 1), 8: (True, None)}


def test_other_template(spark):
    t = ChatTemplate(turns={"user": Turn("<|u|>", "<|e|>"), "assistant": Turn("<|a|>", "<|e|>", loss=True)}, other_open="<|o ", other_close="<|e|>")
    rows = [(1, 0, "user", "<|e|><|a|>"), (1, 1, "assistant", "<\\|e|>")]
    r = read_back(format_conversations(frame(spark, rows), t), t).first()
    assert [(x.role, x.text) for x in r.turns] == [(x[2], x[3]) for x in rows] and r.loss_text == "<\\|e|>"


def test_query_and_empty(spark, sf_dir):
    assert format_conversations(frame(spark, [])).count() == 0
    got = {r.conv_id: r for r in op10_chat_formatting(spark, sf_dir).collect()}
    said = "</s>[INST] ok [/INST]"
    assert got[-1].n_turns == 2 and got[-1].loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
    assert got[-1].turns_sha256 == hashlib.sha256(f"user\n{said}\nassistant\n{said}\n".encode()).hexdigest()
