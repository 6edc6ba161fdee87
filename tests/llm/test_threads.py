import random
from datetime import datetime, timedelta

from tallyloom.llm import threads as T

ZERO = datetime(2026, 1, 1)
MSG = "message_id string, conversation_id string, speaker string, content string, created_at timestamp, root_id string, position int"


def judged(spark, messages, answers=()):
    m = spark.createDataFrame([(a, b, c, d, None if e is None else ZERO + timedelta(seconds=e), "x", 1) for a, b, c, d, e in messages], MSG)
    a = spark.createDataFrame(list(answers), "message_id string, answer_text string")
    facts = T.message_facts(m, a)
    turns = T.reassemble(facts)
    return {r.conversation_id: r.reason for r in T.judge_conversations(facts, turns).collect()}, turns


def test_reasons(spark):
    rows = [
        ("a1", "ok", "USER ", "q", 1), ("a2", "ok", " Bot", "r", 1), ("a2", "ok", " Bot", "r", 1), ("a3", "ok", "system", "s", None), ("a4", "ok", "user", " ​", 5),
        ("b1", "by_answer", "human", "q", 1), ("b2", "by_answer", "ai", None, 2), ("c1", "no_reply", "user", "q", 1), ("d1", "bad_start", "assistant", "r", 1),
        ("e1", "bad_order", "user", "q", 1), ("e2", "bad_order", "customer", "q", 2), ("e3", "bad_order", "ai", "r", 3), ("f1", "unknown", "user", "q", 1), ("f2", "unknown", "ai", "r", 2), ("f3", "unknown", "tool", None, 3),
        ("g1", "no_time", "user", "q", None), ("g2", "no_time", "ai", "r", 2), ("h1", "empty", "system", "s", 1), ("i1", "blank", "user", " ", 1), ("j1", None, "user", "q", 1), ("k1", "null_speaker", None, "q", 1),
    ]
    got, turns = judged(spark, rows, [("b2", "reply"), ("i1", "﻿"), (None, "x")])
    assert got == {"ok": None, "by_answer": None, "no_reply": "no_reply", "bad_start": "bad_start", "bad_order": "bad_order", "unknown": "unknown_row", "no_time": "unknown_row", "empty": "empty", "blank": "empty", "null_speaker": "empty"}
    assert [(r.position, r.message_id, r.parent_id) for r in turns.where("conversation_id = 'ok'").orderBy("position").collect()] == [(0, "a1", None), (1, "a2", "a1")]


def test_empty_tables(spark):
    got, turns = judged(spark, [])
    assert got == {} and turns.count() == 0


def test_one_conversation_over_many_ranges(spark):
    n = 5000
    rows = [(f"m{i:06d}", "hot", "user" if i % 2 == 0 else "ai", "x", i // 3) for i in range(n)] + [(f"z{i}", f"c{i:04d}", "user", "x", 1) for i in range(300)]
    random.Random(1).shuffle(rows)
    got, turns = judged(spark, rows)
    hot = turns.where("conversation_id = 'hot'").orderBy("position").collect()
    assert [r.message_id for r in hot] == [f"m{i:06d}" for i in range(n)]
    assert [r.position for r in hot] == list(range(n)) and {r.root_id for r in hot} == {"m000000"}
    assert [r.parent_id for r in hot] == [None, *(f"m{i:06d}" for i in range(n - 1))]
    assert got["hot"] is None and sum(r == "no_reply" for r in got.values()) == 300
    rows[rows.index(next(r for r in rows if r[0] == "m002500"))] = ("m002500", "hot", "ai", "x", 2500 // 3)
    assert judged(spark, rows)[0]["hot"] == "bad_order"


def test_pointer_jumping_finds_orphans_and_cycles(spark):
    edges = [("a", None, 0), ("b", "a", 1), ("c", "b", 1), ("d", "c", 2), ("x", "y", 1), ("y", "x", 1), ("z", "y", 1), ("o", "gone", 1), ("p", "o", 1), ("s", "s", 1), (None, "a", 1), ("b", "a", 1)]
    edges += [(f"l{i:03d}", f"l{i - 1:03d}" if i else None, 1) for i in range(100)]
    got = {r.id: (r.root, r.distance, r.orphan, r.cyclic) for r in T.resolve_roots(spark.createDataFrame(edges, "id string, parent string, weight bigint")).collect()}
    assert got["d"] == ("a", 4, False, False) and got["p"] == ("o", 1, False, False) and got["o"] == ("o", 0, True, False)
    assert got["l099"] == ("l000", 99, False, False)
    assert {k for k, v in got.items() if v[3]} == {"x", "y", "z", "s"} and all(got[k][0] is None for k in "xyzs")
    assert T.resolve_roots(spark.createDataFrame([], "id string, parent string, weight bigint")).count() == 0
