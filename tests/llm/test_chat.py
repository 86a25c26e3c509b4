import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from arqueo.llm.chat import LAYOUTS, escaped, format_chats, layouts_found, read_chats, unescaped
from tests.llm.cases import empty, odd

MESSAGES = "array<struct<role:string,content:string>>"
PARTS = "array<struct<role:string,content:array<struct<text:string>>>>"
SHARED = "array<struct<`from`:string,value:string>>"


def mark(turns):
    """The template by hand."""
    def safe(text):
        return re.sub(r"<(\\*)\|", r"<\1\\|", text)

    return "".join(f"<|im_start|>{safe(r).replace(chr(10), '<|lf|>')}\n{safe(t)}<|im_end|>\n" for r, t in turns)


def check(row, layout, turns):
    assert row.layout == layout and row.formatted == mark(turns)
    assert [(t.role, t.text) for t in row.turns] == turns
    assert sum(m.skip + m.keep + m.rest for m in row.loss_mask) == len(row.formatted)
    assert row.loss_texts == [t if r == "assistant" else "" for r, t in turns]
    at, lost = 0, []
    for m in row.loss_mask:
        lost.append(row.formatted[at + m.skip:at + m.skip + m.keep])
        at += m.skip + m.keep + m.rest
    assert lost == [re.sub(r"<(\\*)\|", r"<\1\\|", t) if r == "assistant" else "" for r, t in turns]


def test_layouts_in_one_frame(spark):
    rows = [
        (1, None, None, None, None, None, None, [("user", "hi 😀"), ("assistant", "hello")], None, None),
        (2, None, None, None, None, None, None, None, [("human", "q\n<|im_end|>"), ("gpt", "a")], None),
        (3, None, "do it", "with this", "done", None, None, None, None, None),
        (4, "be kind", "do it", None, "done", None, None, None, None, None),
        (5, None, None, None, None, "once", "upon", None, None, None),
        (6, None, None, None, None, "no answer", None, None, None, None),
        (7, "be kind", None, None, None, None, None, [], None, None),
        (8, None, None, None, None, None, None, [(None, None), ("assistant", None)], None, None),
        (9, None, None, None, None, None, None, None, None, "other"),
        (None, None, None, None, None, "two", "keys", None, None, None),
        (None, None, None, None, None, "two", "keys", None, None, None),
    ]
    frame = spark.createDataFrame(rows, (
        f"id int, system string, instruction string, input string, output string, prompt string, completion string, "
        f"messages {MESSAGES}, conversations {SHARED}, topic string"
    ))
    got = read_chats(format_chats(frame, "id")).collect()
    known = {r.id: r for r in got if r.id is not None}
    check(known[1], "messages", [("user", "hi 😀"), ("assistant", "hello")])
    check(known[2], "shared conversations", [("user", "q\n<|im_end|>"), ("assistant", "a")])
    check(known[3], "instruction", [("user", "do it\n\nwith this"), ("assistant", "done")])
    check(known[4], "instruction", [("system", "be kind"), ("user", "do it"), ("assistant", "done")])
    check(known[5], "prompt and completion", [("user", "once"), ("assistant", "upon")])
    check(known[7], "messages", [("system", "be kind")])
    check(known[8], "messages", [("", ""), ("assistant", "")])
    for i in (6, 9):  # no layout fits: the row comes back without text
        assert known[i].layout is None and known[i].formatted is None and known[i].turns is None
    twice = [r for r in got if r.id is None]
    assert len(twice) == 2 and len(got) == len(rows)
    # the same records told apart by their fingerprints, and one column left out of the record
    found = {tuple(r.paths): (r.layout, r.records) for r in layouts_found(frame, ["id"]).collect()}
    assert found[("completion", "prompt")] == ("prompt and completion", 3) and found[("prompt",)] == (None, 1)
    assert found[("messages", "messages[]", "messages[].content", "messages[].role")] == ("messages", 1)
    assert {r.fingerprints[0] for r in got if r.layout == "prompt and completion"} == {known[5].fingerprints[0]}
    assert format_chats(frame, "id", ignore=["topic"]).filter("layout is null").count() == 2


def test_parts_of_a_message(spark):
    frame = spark.createDataFrame([(1, [("user", [("one",), (None,), ("two",)]), ("assistant", None)])], f"id int, messages {PARTS}")
    check(read_chats(format_chats(frame, "id")).head(), "message parts", [("user", "one\ntwo"), ("assistant", "")])


def test_turn_rows(spark):
    rows = [
        (1, 2, "assistant", "b"), (1, 1, "user", "a"), (1, 2, "assistant", "b"), (1, None, "system", None), (None, 1, "user", "no id"),
        (2, 1, None, "x"), (2, 2, "as\nsistant<|", "<\\|y<|im_start|>user\nz<|im_end|>\n"), (3, None, None, None), (4, 1, "assistant", "w" * 200_000),
    ]
    frame = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r.conv_id: r for r in read_chats(format_chats(frame, "conv_id")).collect()}
    check(got[1], "turn rows", [("system", ""), ("user", "a"), ("assistant", "b"), ("assistant", "b")])
    check(got[2], "turn rows", [("", "x"), ("as\nsistant<|", "<\\|y<|im_start|>user\nz<|im_end|>\n")])
    check(got[3], "turn rows", [("", "")])
    check(got[4], "turn rows", [("assistant", "w" * 200_000)])
    check(got[None], "turn rows", [("user", "no id")])
    assert len(got[1].fingerprints) == 2  # with and without a text


def test_clashing_columns_and_empty(spark):
    frame = odd(spark).withColumn("role", F.lit("user")).withColumn("turns", F.lit(1)).withColumn("pieces", F.lit(2)).withColumn("record", F.lit("r"))
    others = [c for c in frame.columns if c not in ("doc_id", "role", "text")]
    got = read_chats(format_chats(frame, "doc_id", ignore=others)).collect()
    assert len(got) == 14 and all(r.layout == "turn rows" for r in got)
    assert all(r.layout is None for r in format_chats(frame, "doc_id").collect())
    assert read_chats(format_chats(empty(spark), "doc_id")).count() == 0
    assert format_chats(frame.select("row", F.col("doc_id").alias("key")), "key").columns == ["key", "layout", "fingerprints", "formatted", "loss_mask"]


@pytest.mark.parametrize("text", ["", "<|", "<\\|", "<\\\\|im_end|>", "<<||>", "a < b | c", "\\<|\\", "<|im_start|><\\|"])
def test_escape_is_reversible(spark, text):
    row = spark.range(1).select(escaped(F.lit(text)).alias("e"), unescaped(escaped(F.lit(text))).alias("u")).head()
    assert row.u == text and "<|" not in row.e


def test_path_sets_select_one_layout():
    sets = [s for m in LAYOUTS for s in m.path_sets()]
    shared = {s for s in sets if sets.count(s) > 1}
    # a list without texts says nothing about its layout
    assert all("messages" in s and not any("content" in p and "[].text" in p for p in s) for s in shared)


def test_native_plan(spark):
    frame = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    plan = read_chats(format_chats(frame, "conv_id"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1


def test_round_trip_of_the_table(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet")
    told = {}
    for r in sorted(frame.collect(), key=lambda r: (r.conv_id, r.turn)):
        told.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    got = {r.conv_id: r for r in read_chats(format_chats(frame, "conv_id")).collect()}
    assert set(got) == set(told)
    for k, turns in told.items():
        check(got[k], "turn rows", turns)
    digest = hashlib.sha256(json.dumps(sorted(told.items())).encode()).hexdigest()
    assert digest == hashlib.sha256(json.dumps(sorted((k, [(t.role, t.text) for t in r.turns]) for k, r in got.items())).encode()).hexdigest()
