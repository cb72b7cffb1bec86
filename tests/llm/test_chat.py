import collections
import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from gridloom.llm import chat

CONTROL = [chat.TURN, chat.TEXT, chat.END, "[INST]", "[/INST]", "<s>", "<<SYS>>", "<</SYS>>", "<|im_end|>", "<|endoftext|>"]


def test_escaping_is_undone():
    r = random.Random(2)
    parts = ["<", "|", "\x1b", "e", "l", "b", "[", "a", "\n", "", *CONTROL]
    for _ in range(30_000):
        t, u = ("".join(r.choice(parts) for _ in range(r.randrange(9))) for _ in range(2))
        assert chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in CONTROL), t
        assert list(chat.read_turns(chat.format_turn(t, u)[0] + chat.format_turn("user", t)[0])) == [(t, u), ("user", t)]


def test_read_back(spark):
    r, rows = random.Random(3), []
    for c in [*range(40), None]:
        for t in range(r.randrange(1, 30)):
            rows.append((c, t if r.random() > 0.1 else 0, r.choice(["user", "assistant", "system", None, "</s>"]), r.choice([None, "", "hi " * r.randrange(50), "</s>[INST]", "é\x1b<|text|>"])))
    rows += [(7, 0, "user", "same")] * 3 + [(50, None, "user", "no turn"), (50, 1, "assistant", "x" * 100_000)]
    df = spark.createDataFrame([(*x, "extra") for x in rows], "conv_id long, turn long, role string, text string, Text string").repartition(5)
    parts = chat.formatted(chat.table_turns(df), 200)
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c].append(((t is not None, t or 0), (role is not None, role or ""), (text is not None, text or "")))
    want = {}
    for c, x in by.items():
        turns = [(role, text) for _, (_, role), (_, text) in sorted(x)]
        said = "".join(t for role, t in turns if role == "assistant")
        want[c] = (len(turns), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(),
                   sum(len(chat.format_turn(*t)[0]) for t in turns))
    for got in (chat.read_back(parts, in_order=True), chat.read_back(parts.repartition(3))):
        assert {x.conv_id: tuple(x)[1:] for x in got.collect()} == want
    assert parts.groupBy("conv_id").count().where("count > 1").count() > 5
    assert chat.read_back(chat.formatted(chat.table_turns(df.limit(0)))).collect() == []


def test_layouts(spark):
    records = {
        "messages": ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}], "id": 4}, [("user", "a"), ("assistant", "")]),
        "conversations": ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}]}, [("user", "q"), ("assistant", "r")]),
        "dialog": ({"dialog": [{"speaker": "Bot", "text": "x"}]}, [("assistant", "x")]),
        "instruction": ({"instruction": "i", "input": "x", "output": "o", "system": "s"}, [("system", "s"), ("user", "i\n\nx"), ("assistant", "o")]),
        "prompt_response": ({"prompt": "p", "response": "r"}, [("user", "p"), ("assistant", "r")]),
        "prompt_completion": ({"prompt": "p", "completion": 3}, [("user", "p"), ("assistant", "3")]),
        "question_answer": ({"question": "q", "answer": "a", "context": "c"}, [("user", "c\n\nq"), ("assistant", "a")]),
    }
    data = [(i, json.dumps(r)) for i, (r, _) in enumerate(records.values())] + [(90, None), (91, "{"), (92, "[1]"), (93, '{"x": {"y": 1}}'), (94, "")]
    rows = {x.conv_id: x for x in chat.record_turns(spark.createDataFrame(data, "k long, record string"), "k", "record").collect()}
    for i, (name, (_, turns)) in enumerate(records.items()):
        assert rows[i].layout == name and [(t.role, t.text) for t in rows[i].turns] == turns
    assert all(rows[i].layout is None and rows[i].turns is None for i in range(90, 95)) and rows[93].paths == ["x", "x.y"]
    assert len(chat.REGISTRY) == sum(1 << len(m.get("optional", [])) for m in chat.MAPPINGS.values())                        # no two mappings look alike
    with pytest.raises(ValueError):
        chat.table_turns(spark.createDataFrame([(1,)], "x int"))


def test_other_fields_make_no_difference(spark):
    """Every field that some mapping names, as an extra column of a table of turns, and as an extra field of every record."""
    fields = sorted({p.split(".")[0].split("[")[0] for m in chat.MAPPINGS.values() for p in [*m["paths"], *m.get("optional", [])]})
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    extra = [f for f in fields if f not in ("conv_id", "turn", "role", "text")] + ["TEXT", "Role"]
    df = spark.createDataFrame([(*r, *extra) for r in rows], "conv_id long, turn long, role string, text string, " + ", ".join(f"`{f}` string" for f in extra))
    assert sorted(tuple(r) for r in chat.table_turns(df).collect()) == rows
    nested = df.withColumn("messages", F.array(F.struct(F.lit("x").alias("role"), F.lit("y").alias("content"))))
    assert sorted(tuple(r) for r in chat.table_turns(nested).collect()) == rows
    record = {"prompt": "p", "response": "r"}
    noise = {"input": "i", "text": "t", "role": "x", "turn": 3, "conv_id": 9, "question": "no answer", "messages": "none", "dialog": []}
    found = chat.record_turns(spark.createDataFrame([(1, json.dumps(record | noise))], "k long, record string"), "k", "record").first()
    assert found.layout == "prompt_response" and [(t.role, t.text) for t in found.turns] == [("user", "p"), ("assistant", "r")]
    both = {"messages": [{"role": "user", "content": "m"}], "instruction": "i", "output": "o"}
    assert chat.record_turns(spark.createDataFrame([(1, json.dumps(both))], "k long, record string"), "k", "record").first().layout == "messages"
