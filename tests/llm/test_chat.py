"""Chat formatting: round trips, spans, SQL."""

from __future__ import annotations

import hashlib

from tests.oracle import assert_same, connection
from wearline.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def read(spark, rows):
    return {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)).collect()}


def test_sql(spark, sf):
    found = chat.op1_chat_formatting(spark, sf)
    assert_same(found.toPandas(), connection(sf).sql(chat.ORACLE_SQL["op1_chat_formatting"]).df())


def test_control_strings_come_back(spark):
    nasty = ["</s>[INST] ok [/INST]", "[INST]a[/INST]", "<s>", "\\o\\e\\q", "\\", "[ROLE]x[TEXT]y[/ROLE]", "", " ", "<", "[", "\\<s>", "é漢😀\n</s>", "[/INST", "s>", None, "$1 \\1"]
    rows = [(1, i, r, t) for i, (r, t) in enumerate((r, t) for t in nasty for r in ("user", "assistant", "system", None, "[TEXT]", "a\nb"))]
    rows += [(2, 0, "user", "plain"), (2, 1, "assistant", "text")]
    found = read(spark, rows)
    assert [(t["role"], t["text"]) for t in found[1]["turns"]] == [(r or "", t or "") for _, _, r, t in rows[:-2]]
    assert found[1]["round_trip"] and found[2]["escape_level"] == 0
    assert found[2]["formatted"] == "<s>[INST]plain[/INST]</s><s>text</s>"


def test_every_single_conflict_alone(spark):
    texts = ["</s>", "[INST]x[/INST]", "[ROLE]r[TEXT]t[/ROLE]", "\\e", "a[/INST]</s><s>b"]
    rows = [(i, 0, r, t) for i, (t, r) in enumerate((t, r) for t in texts for r in ("user", "assistant", "tool"))]
    found = read(spark, rows)
    for i, _, role, text in rows:
        assert [(t["role"], t["text"]) for t in found[i]["turns"]] == [(role, text)] and found[i]["round_trip"]


def test_spans_cover_the_assistant(spark):
    rows = [(1, 0, "user", "hi 😀"), (1, 1, "assistant", "one </s> é"), (1, 2, "tool", "x"), (1, 3, "assistant", ""), (1, 4, "assistant", "two")]
    own = chat.format_conversations(spark.createDataFrame([(*r, "") for r in rows], SCHEMA))
    text = own.first()["formatted"]
    spans = sorted((r["start"], r["end"]) for r in chat.loss_spans(own).collect())
    undo = lambda t: t.replace("\\o", "<").replace("\\q", "[").replace("\\e", "\\")
    assert [undo(text[a:b]) for a, b in spans] == ["one </s> é", "", "two"]
    digest = chat.digests(own).first()
    said = "one </s> étwo"
    assert digest["loss_chars"] == len(said) and digest["loss_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert digest["formatted_chars"] == len(text) and digest["n_turns"] == 5


def test_nulls_ties_repeats_and_empty(spark):
    rows = [(None, None, None, None), (None, 0, "user", "a"), (3, 0, "user", "b"), (3, 0, "user", "b"), (3, 0, "assistant", "c")]
    found = read(spark, rows)
    assert [(t["role"], t["text"]) for t in found[3]["turns"]] == [("assistant", "c"), ("user", "b"), ("user", "b")]
    assert [(t["role"], t["text"]) for t in found[None]["turns"]] == [("", ""), ("user", "a")]
    assert read(spark, []) == {}


def test_long_texts(spark):
    text = "[INST] </s> " * 40_000
    found = read(spark, [(1, 0, "user", text), (1, 1, "assistant", text)])
    assert found[1]["round_trip"] and found[1]["turns"][1]["text"] == text
