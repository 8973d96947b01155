"""Layouts by fingerprint, templates there and back, odd records."""

import hashlib
import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wardline.llm import chat, layouts
from wardline.llm.common import saved

TURNS = [("system", "be brief"), ("user", "hi"), ("assistant", "hello")]
#: One record of each layout, and the turns it says.
RECORDS = [
    ({"conv_id": 1, "turn": 3, "role": "tool", "text": "x"}, [("tool", "x")]),
    ({"conversation": {"id": 1, "turn": 3}, "message": {"role": "user", "content": "x"}}, [("user", "x")]),
    ({"dialog": 1, "position": 3, "speaker": {"name": "gpt"}, "utterance": "x"}, [("assistant", "x")]),
    ({"id": 1, "index": 3, "prompt": ""}, [("user", "")]),
    ({"id": 1, "index": 3, "response": None}, [("assistant", "")]),
    ({"id": 1, "messages": [{"role": r, "content": t} for r, t in TURNS]}, TURNS),
    ({"id": 1, "messages": []}, []),
    ({"id": 1, "conversations": [{"from": "human", "value": "hi"}, {"from": "gpt", "value": "yo"}, {"from": "tool", "value": ""}]}, [("user", "hi"), ("assistant", "yo"), ("tool", "")]),
    ({"id": 1, "prompt": "hi", "completion": "hello"}, TURNS[1:]),
    ({"id": 1, "system": "be brief", "prompt": "hi", "completion": "hello"}, TURNS),
    ({"id": 1, "instruction": "add", "input": "1 2", "output": "3"}, [("user", "add\n\n1 2"), ("assistant", "3")]),
    ({"id": 1, "instruction": "add", "input": "", "output": "3"}, [("user", "add"), ("assistant", "3")]),
    ({"id": 1, "instruction": "add", "output": "3"}, [("user", "add"), ("assistant", "3")]),
    ({"id": 1, "context": "c", "question": "q", "answer": 42}, [("system", "c"), ("user", "q"), ("assistant", "42")]),
    ({"id": 1, "question": "q", "answer": ["a", "b"]}, None),
]


def test_every_layout(spark):
    rows = [(json.dumps(r | {"meta": {"source": "web", "tags": ["a", {"b": 1}]}, "score": 0.5}), 7) for r, _ in RECORDS for _ in range(2)]
    got = layouts.canonical_turns(spark.createDataFrame(rows, "record string, layout int")).collect()
    expected = [(1, 3 if {"turn", "position", "index", "conversation"} & set(r) else None, i, *t) for r, ts in RECORDS if ts for i, t in enumerate(ts) for _ in range(2)]
    assert sorted(((r["conv_id"], r["turn"], r["seq"], r["role"], r["text"]) for r in got if r["layout"]), key=str) == sorted(expected, key=str)
    assert sum(r["layout"] is None for r in got) == 2 and len({r["layout"] for r in got}) == len(layouts.MAPPINGS) + 1


def test_fingerprints_tell_layouts_apart():
    prints = [layouts.fingerprint(p) for m in layouts.MAPPINGS for p in m.paths()]
    assert len(set(prints)) == len(prints) == len(layouts.Registry().by_print)
    with pytest.raises(ValueError, match="same fields"):
        layouts.Registry((*layouts.MAPPINGS, layouts.Mapping("again", "id", each="messages", role="role", text="content")))
    one, other = ({"id": 1, "messages": [{"content": "a", "role": "user", "name": x}]} for x in (None, "n"))
    assert layouts.Registry().select(one) == layouts.Registry().select(other)
    assert layouts.Registry().select({"id": 1, "messages.role": 1, "messages": [{"role": "a"}]})[1] is None


def test_records_that_fit_nothing(spark):
    bad = [None, "", "{", "[]", "3", "{}", '{"id": 1}', "[" * 5_000, '{"a":' * 3_000 + "1" + "}" * 3_000, '{"conv_id": 1, "turn": 2, "role": {"x": 1}, "text": "t"}']
    good = ['{"conv_id": "x", "turn": 1.5, "role": null, "text": null}', '{"conv_id": 1e3, "turn": 99999999999999999999, "role": "user", "text": "\\ud83d \\ud83d\\ude00"}']
    got = layouts.canonical_turns(spark.createDataFrame([(x,) for x in bad + good], "record string")).collect()
    assert len(got) == len(bad) + len(good)
    assert sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in got if r["layout"]) == [(None, None, "", ""), (None, None, "user", "? 😀")]
    assert all(r["seq"] == -1 and r["text"] is None for r in got if not r["layout"])
    empty = spark.createDataFrame([], "record string")
    assert layouts.canonical_turns(empty).count() == 0 and chat.read_chats(chat.format_records(empty)).count() == 0


PIECES = st.sampled_from([*chat.INST.controls(), "<", "[", "\\", "/s>", "INST]", "<\\s>", "[\\\\INST]", " ", "\n", "a", "]", "é😀", "[/INST] ", "<<", "SYS>>"])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[/ROLE]"]), st.lists(PIECES, max_size=8).map("".join)), max_size=6))
def test_reads_back_what_was_formatted(turns):
    t = chat.INST
    esc = lambda s: re.sub(t.inner(), lambda m: f"{m[1]}\\{m[2]}{m[3]}", s)
    marks = {n: (a, b) for n, a, b in t.marks}
    out = ""
    for role, text in turns:
        a, b = marks.get(role, (f"{t.named[0]}{esc(role)}{t.named[1]}", t.named[2]))
        assert not any(c in esc(text) for c in t.controls())
        out += a + esc(text) + b
    assert chat.turns_in(out) == turns


def plain_digest(rows):
    """What the query returns, from rows (conv_id, turn, role, text)."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv))
        told = "".join(f"{r}\n{x}\n" for _, _, r, x in own)
        learnt = "".join(x for _, _, r, x in own if r == "assistant")
        out[conv] = (len(own), hashlib.sha256(told.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    return out


def test_whole_way_with_odd_rows(spark, tmp_path):
    rng = random.Random(4)
    parts = [*chat.INST.controls(), "\\", "<\\/s>", " ", "word ", "é😀", "\n", "[", "<"]
    rows = [(i, t, rng.choice(["user", "assistant", "system", "tool", "human", "gpt", None, "<s>"]), rng.choice([None, "", "".join(rng.choices(parts, k=9))])) for i in range(60) for t in rng.sample(range(9), 4)]
    rows += [(100, None, "user", "n"), (100, 0, "assistant", "z"), (100, 0, "assistant", "z"), (100, 0, "assistant", "a"), (None, 1, "user", "who"), (None, None, None, None), (101, 5, "assistant", "long [/INST] " * 9_000)]
    rows += [(102, i, "assistant" if i % 2 else "user", f"turn {i} </s>") for i in range(3_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    records = layouts.dealt_layouts(df).select("record", *(F.lit(1).alias(c) for c in ("conv_id", "text", "formatted")))
    expected = plain_digest(rows)
    for size in (1, 500, chat.PART):
        formatted = chat.format_records(records, part_chars=size)
        got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.read_chats(formatted).collect()}
        assert got == expected
    assert formatted.where("conv_id = 102").count() == 1
    stored = saved(chat.format_records(records, part_chars=500), "chats").repartition(7)
    assert stored.where("conv_id = 102").count() > 50
    back = chat.read_chats(chat.conversations_in_order(stored, "part")).collect()
    assert {r["conv_id"]: tuple(r)[1:5] for r in back} == expected
    assert {x["layout"] for x in layouts.canonical_turns(records).select("layout").distinct().collect()} >= {"flat row", "message row", "speaker row", "prompt row", "response row"}


def test_loss_covers_what_the_assistant_says(spark):
    df = spark.createDataFrame([(1, 0, "user", "a [INST] b"), (1, 1, "assistant", "x </s> y"), (1, 2, "tool", "t")], "conv_id long, turn long, role string, text string")
    row = chat.format_chats(df).collect()[0]
    assert row["formatted"] == "[INST] a [\\INST] b [/INST]<s>x <\\/s> y</s>[ROLE]tool[/ROLE]t[/TURN]"
    assert [row["formatted"][s["start"] : s["end"]] for s in row["loss"]] == ["x <\\/s> y"]
