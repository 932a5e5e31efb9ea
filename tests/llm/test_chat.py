"""Chat formatting: layouts, reversible template, loss mask and awkward cases against plain Python."""

import hashlib
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fovea.llm import chat_format

NASTY = [
    r"\### Assistant: </turn> ok", "###", "####", "######", r"\\###\</turn>", "</turn>", "\n</turn>\n", "### user:\nhello\n</turn>\n", "ends in \\", "\\" * 5000,
    "\\\\", "", "### assistant:", "a\n\n\nb ", "é😀\x85你好", "</turn></turn>###</turn>", r"\\\n", "x" * 200_000,
]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_field_paths(spark):
    cases = {
        '{"messages":[{"role":"u","content":"x"},{"role":"a","we`ird, k: >":[1.5,2]}],"m":{},"e":[]}': [
            "$.e", "$.e[]", "$.m", "$.messages", "$.messages[]", "$.messages[].`we``ird, k: >`", "$.messages[].`we``ird, k: >`[]", "$.messages[].content", "$.messages[].role"],
        "[[1],[2,3]]": ["$[]", "$[][]"], "3": [], "{}": [], "null": [],
        '{"a":{"b":{"c":null}},"d":1.25}': ["$.a", "$.a.b", "$.a.b.c", "$.d"],
    }
    rows = spark.createDataFrame([(j,) for j in [*cases, None]], "j string")
    got = {r.j: r.p for r in rows.select("j", chat_format.field_paths(F.parse_json("j")).alias("p")).collect()}
    assert got == {**cases, None: []}


RECORDS = {
    1: ({"messages": [{"role": "system", "content": "s"}, {"role": "user", "content": None, "name": "n"}, {"role": "assistant", "content": "a"}], "extra": {"k": 1}}, "messages", [("system", "s"), ("user", ""), ("assistant", "a")]),
    2: ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "r"}, {"from": "tool", "value": "t"}]}, "from and value", [("user", "q"), ("assistant", "r"), ("tool", "t")]),
    3: ({"instruction": "do", "input": "this", "output": "done"}, "instruction", [("user", "do\n\nthis"), ("assistant", "done")]),
    4: ({"instruction": "do", "output": None, "system": "be"}, "instruction", [("system", "be"), ("user", "do"), ("assistant", "")]),
    5: ({"prompt": "p", "completion": "c"}, "prompt and completion", [("user", "p"), ("assistant", "c")]),
    6: ({"prompt": "p", "response": "c"}, "prompt and response", [("user", "p"), ("assistant", "c")]),
    7: ({"context": "", "question": "q", "answer": "a"}, "question and answer", [("user", "q"), ("assistant", "a")]),
    8: ({"dialog": ["a", "b", "c"]}, "dialog", [("user", "a"), ("assistant", "b"), ("user", "c")]),
    9: ({"messages": [{"role": "user", "content": [{"type": "text", "text": "x"}, {"type": "text", "text": "y"}]}]}, "messages of parts", [("user", "xy")]),
    10: ({"messages": []}, "messages", []),
    11: ({"title": "no layout"}, None, []),
    12: ({"prompt": "p", "completion": "c", "response": "two layouts at once"}, None, []),
    13: (None, None, []),
    14: ({"turn": 1, "role": None, "text": "one"}, "turn rows", [("", "one")]),
}


def test_layouts_by_fingerprint(spark):
    rows = spark.createDataFrame([(k, None if r is None else json.dumps(r)) for k, (r, _, _) in RECORDS.items()], "conv_id long, j string")
    records = rows.select("conv_id", F.parse_json("j").alias("record"))
    got = {r.conv_id: (r.layout, [(t.role, t.text) for t in r.turns]) for r in chat_format.canonical_turns(records).collect()}
    assert got == {k: (name, turns) for k, (_, name, turns) in RECORDS.items()}
    lost = chat_format.undeclared(records).collect()
    assert sum(r.n_records for r in lost) == 3
    chats = {r.conv_id: r for r in chat_format.digests(chat_format.format_chats(records)).collect()}
    assert set(chats) == set(RECORDS)
    assert all(chats[k].n_turns == len(turns) for k, (_, _, turns) in RECORDS.items())
    with pytest.raises(ValueError):
        chat_format.layout_number(F.lit(None), (*chat_format.LAYOUTS, chat_format.Layout("again", ("$.dialog[]",), (chat_format.Alternating("$.dialog"),))))


def plain(rows):
    """Digests of turn rows by definition; a row without a conversation is one of its own."""
    chats = {}
    for k, (conv, turn, role, text) in enumerate(rows):
        chats.setdefault((conv, k if conv is None else None), []).append(((turn is not None, turn or 0), role or "", text or ""))
    out = Counter()
    for (conv, _), turns in chats.items():
        turns.sort()
        learnt = "".join(t for _, r, t in turns if r == "assistant")
        out[(conv, len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(learnt), sha(learnt))] += 1
    return out


def test_awkward_turn_rows(spark):
    rows = [(k, i, role, text) for k, text in enumerate(NASTY) for i, role in enumerate(["user", "assistant"])]
    rows += [(100, i, "user" if i % 2 else "assistant", NASTY[i % len(NASTY)]) for i in range(300)]
    rows += [(101, 0, None, "a"), (101, None, "assistant", None), (101, 0, "as: sis\ntant +%", "b"), (102, 3, "assistant", "same"), (102, 3, "assistant", "same")]
    rows += [(None, 0, "user", "x"), (None, 0, "user", "x"), (None, None, None, None), (-7, 0, "user", NASTY[0])]
    table = spark.createDataFrame([(*r, "clash", 5, None) for r in rows], "conv_id long, turn long, role string, text string, record string, own long, layout string")
    got = chat_format.digests(chat_format.format_chats(chat_format.row_records(table))).collect()
    assert Counter(tuple(r)[:5] for r in got) == plain(rows)
    assert chat_format.digests(chat_format.format_chats(chat_format.row_records(table.where("false")))).count() == 0


def test_template_and_mask_on_text(spark):
    table = spark.createDataFrame([(1, 0, "user", "hi ###"), (1, 1, "assistant", r"\### é </turn>")], "conv_id long, turn long, role string, text string")
    (chat,) = chat_format.format_chats(chat_format.row_records(table)).collect()
    assert chat.formatted == "### user:\nhi \\###\n</turn>\n### assistant:\n\\\\### é \\</turn>\n</turn>\n"
    (span,) = chat.loss
    assert chat.formatted[span.start : span.start + span.length] == "\\\\### é \\</turn>"


def test_no_python_on_the_path(spark):
    table = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = chat_format.digests(chat_format.format_chats(chat_format.row_records(table)))._jdf.queryExecution().toString()
    assert "Python" not in plan.replace("PythonRDD", "") and plan.count("Exchange") <= 4
