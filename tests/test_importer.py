"""The agent-log importer against a plain one, and chains against plain walks."""

import json
import random
from collections import Counter

import pytest

from mnemodex.operators import importer as I
from mnemodex.operators import parts as P

LINES = "file string, line long, value string"


def line(k, role="user", content="hi", parent=None, **more):
    return {"type": role, "uuid": f"u{k}", "parentUuid": parent, "timestamp": f"2026-08-06T09:00:{k % 60:02}.100Z", "sessionId": "s", "message": {"role": role, "content": content}} | more


GOOD = [
    line(1, "assistant", [{"type": "text", "text": "a", "extra": {"z": [1, 2.5]}}, {"type": "thinking", "thinking": "", "signature": "sig"}, {"type": "tool_use", "id": "t1", "name": "Read", "input": {"b": 1, "a": None}, "caller": {"type": "direct"}}]),
    line(2, content=[{"type": "tool_result", "tool_use_id": "t1", "content": "package main\n"}], toolUseResult={"x": 1}),
    line(3, content=[{"type": "tool_result", "tool_use_id": "t2", "is_error": False, "content": [{"type": "image", "source": {"type": "base64", "media_type": "image/png", "data": "AA="}}, {"type": "tool_reference", "tool_name": "Bash"}, {"type": "text", "text": "in"}]}]),
    line(4), line(5, content=[{"type": "tool_result", "tool_use_id": "t3", "content": "exit 1", "is_error": True}], parent="u4"),
    line(6, content=[{"type": "tool_result", "tool_use_id": "a", "content": [{"type": "tool_result", "tool_use_id": "b", "content": [{"type": "tool_result", "tool_use_id": "c", "content": [{"type": "tool_result", "tool_use_id": "d", "content": [{"type": "tool_result", "tool_use_id": "e", "content": [{"type": "tool_result", "tool_use_id": "f", "content": "deep"}]}]}]}]}]}]),
    line(7, content=[{"type": "never met", "fields": [True, {"q": "é"}]}], isSidechain=True), line(8, content=[{"type": "tool_result", "tool_use_id": "z"}]), line(9, content=""),
    line(10, content=[{"type": "text", "text": ""}]), {k: v for k, v in line(11).items() if k != "parentUuid"}, {**line(12), "message": {**line(12)["message"], "model": "m", "usage": {"input_tokens": 1}}, "message2": 5},
]
OTHER = {
    "{broken": ("refused", "the line does not parse"), '{"type":"mode","mode":"x"}': ("other", "mode"), '{"x":1}': ("other", ""),
    json.dumps(line(20, timestamp="yesterday")): ("refused", "timestamp"), json.dumps({**line(21), "message": {"role": "user"}}): ("refused", "message has no content"), json.dumps(line(22, content={"a": 1})): ("refused", "message content"),
    json.dumps(line(23, content=["x"])): ("refused", "message content"), json.dumps({**line(24), "message": "x"}): ("refused", "message envelope"), json.dumps({**line(25), "uuid": " "}): ("refused", "missing id"),
    json.dumps({**line(26), "message": {"role": "robot", "content": "x"}}): ("refused", "unknown role"), json.dumps(line(27, content=[])): ("refused", "no parts"), json.dumps(line(28, content=[{"type": "tool_use", "name": "n", "input": {}}])): ("refused", "tool part without call id"),
    json.dumps(line(29, content=[{"text": "x"}])): ("refused", "part without type"), json.dumps(line(30, content=[{"type": "tool_result", "tool_use_id": "a", "content": 5}])): ("refused", "message content"),
    json.dumps(line(31, timestamp="2026-08-06T09:00:00Z")): ("diverged", "timestamp"), json.dumps(line(32, content=[{"type": "thinking", "thinking": "x"}])): ("diverged", "message.content[thinking].signature added"),
    json.dumps(line(33, content=[{"type": "tool_result", "tool_use_id": "a", "content": []}])): ("diverged", "message.content[tool_result].content dropped"), json.dumps(line(34, content=[{"type": "text", "text": 5}])): ("diverged", "message.content[text].text changed"),
    json.dumps(line(35, content=[{"type": "tool_use", "id": "c", "name": "n"}])): ("diverged", "message.content[tool_use].input added"), json.dumps({**line(36), "parentUuid": 5}): ("diverged", "parentUuid"),
    json.dumps(line(37, timestamp="2026-08-06T11:00:00.100+02:00")): ("diverged", "timestamp"), json.dumps({**line(38), "timestamp": None}): ("diverged", "timestamp"),
}


@pytest.fixture(scope="module")
def judged(spark):
    rows = [("f", k, json.dumps(x)) for k, x in enumerate(GOOD)] + [("g", k, x) for k, x in enumerate(OTHER)] + [("g", 100, "  "), ("g", 101, None)]
    return I.outcomes(I.to_messages(spark.createDataFrame(rows, LINES))).cache()


def test_every_good_line_is_rebuilt(judged):
    assert [(r.outcome, r.detail) for r in judged.where("file = 'f'").orderBy("line").collect()] == [("rebuilt", "")] * len(GOOD)


def test_others_are_told_by_reason(judged):
    got = {r.line: (r.outcome, r.detail) for r in judged.where("file = 'g'").collect()}
    assert got == dict(enumerate(OTHER.values()))
    want = Counter(OTHER.values()) + Counter({("rebuilt", ""): len(GOOD)})
    assert {(r.outcome, r.detail): r.n for r in I.census(judged).collect()} == want


def test_parts_of_imported_lines(spark, judged):
    m = judged.where("file = 'f'").withColumnRenamed("line", "pos")
    got = [(r.pos, r.type) for r in P.walk_parts(m).orderBy("pos", "path").collect()]
    assert [t for k, t in got if k == 0] == ["text", "reasoning", "toolCall"] and [t for k, t in got if k == 2] == ["toolResult", "file", "tool_reference", "text"]
    assert [t for k, t in got if k == 5] == ["toolResult"] * 5  # deeper content rides in the last one's bag
    lines = spark.createDataFrame([("f", k, json.dumps(x)) for k, x in enumerate(GOOD)], LINES)
    count = Counter()

    def walk(c):
        if isinstance(c, list):
            for p in c:
                count[p["type"]] += 1
                walk(p.get("content") if p["type"] == "tool_result" else None)

    for x in GOOD:
        c = x["message"]["content"]
        count["<string>"] += isinstance(c, str)
        walk(c)
    assert {r.type: r.n for r in I.part_census(lines, 8).collect()} == count


def plain_chains(rows):
    """rows(session, id, parent, line, sidechain)"""
    first, out = {}, []
    for s, i, p, n, side in sorted(rows, key=lambda r: r[3]):
        if (s, i) in first:
            out.append((s, i, n, None, None, None, "repeated"))
        else:
            first[s, i] = (p, n, side)
    main = set()
    for s in {k[0] for k in first}:
        ends = [(n, i) for (t, i), (_, n, side) in first.items() if t == s and not side]
        at = max(ends)[1] if ends else None
        while at is not None and (s, at) in first and (s, at) not in main:
            main.add((s, at))
            at = first[s, at][0]
    for (s, i), (p, n, side) in first.items():
        at, steps, seen = i, 0, set()
        while first[s, at][0] is not None and (s, first[s, at][0]) in first and at not in seen:
            seen.add(at)
            at, steps = first[s, at][0], steps + 1
        circle = at in seen
        problem = "circle" if circle else "cut" if p is not None and (s, p) not in first else None
        out.append((s, i, n, None if circle else at, None if circle else steps, "side" if side else "main" if (s, i) in main else "fork", problem))
    return Counter(out)


def test_chains(spark):
    r = random.Random(2)
    rows = [("long", f"n{k}", f"n{k - 1}" if k else None, k, False) for k in range(300)]
    for s in range(12):
        for k in range(r.randrange(1, 60)):
            rows.append((f"s{s}", f"m{r.randrange(50)}", r.choice([None, f"m{r.randrange(55)}", f"m{max(0, k - 1)}"]), k, r.random() < 0.2))
    rows.append(("alone", "x", "x", 0, False))
    d = spark.createDataFrame([(f"{s}", i, p, n, side) for s, i, p, n, side in rows], "session string, id string, parent string, line long, sidechain boolean").repartition(5)
    assert Counter(tuple(x) for x in I.chains(d).collect()) == plain_chains(rows)
    assert I.chains(d.limit(0)).count() == 0


def test_turns_of_a_forked_log(spark):
    log = [line(1), line(2, "assistant", parent="u1"), line(3, parent="u2"), line(4, parent="u1"), line(5, "assistant", parent="u4", isSidechain=True), line(4, content="again", parent="u1"), line(6, content="end", parent="u4")]
    m = I.to_messages(spark.createDataFrame([("f", k, json.dumps(x)) for k, x in enumerate(log)], LINES))
    turns = I.imported_turns(m, I.chains(m.where("kind in ('user', 'assistant')"))).orderBy("pos").collect()
    assert [(t.pos, t.id, t.role) for t in turns] == [(0, "u1", "user"), (1, "u4", "user"), (2, "u6", "user")]
    assert json.loads(turns[2].parts)[0]["text"] == "end"
