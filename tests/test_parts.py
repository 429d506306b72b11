"""Nested parts against plain walks over parsed JSON."""

import json
import random

import pytest

from mnemodex.operators import parts as P

SCHEMA = "session string, pos long, id string, role string, parts string"


def some_parts(r, depth=0):
    out = []
    for _ in range(r.randrange(0 if depth else 1, 4)):
        kind = r.choice(["text", "reasoning", "toolCall", "toolResult", "file", "resourceLink", "new"])
        p = {"type": kind}
        if kind in ("text", "reasoning"):
            p["text"] = r.choice(["", " ", "said  that", "Ünï 😀", "x" * 200])
        if kind in ("toolCall", "toolResult"):
            p["callId"] = f"c{r.randrange(6)}"
        if kind == "toolCall":
            p |= {"name": f"n{r.randrange(3)}", "input": {"z": 1.50, "a": ["q", {"k": None}]}}
        if kind == "toolResult":
            p["isError"] = r.random() < 0.3
        if kind == "file":
            p |= {"mediaType": "image/png", "filename": "f.png"}
        if kind == "resourceLink":
            p["uri"] = "mnemodex://memory/1"
        if depth < 3 and (kind == "toolResult" or r.random() < 0.1):
            p["content"] = some_parts(r, depth + 1)
        out.append(p)
    return out


@pytest.fixture(scope="module")
def talk():
    r = random.Random(11)
    return [(f"s{k % 7}", k, f"m{k}", r.choice(["user", "assistant", "tool"]), some_parts(r)) for k in range(120)]


@pytest.fixture(scope="module")
def messages(spark, talk):
    return spark.createDataFrame([(s, k, i, role, json.dumps(p, separators=(",", ":"), ensure_ascii=False)) for s, k, i, role, p in talk], SCHEMA).repartition(4)


def walk(parts, path=()):
    for i, p in enumerate(parts):
        yield (*path, i), p
        yield from walk(p.get("content") or [], (*path, i))


def rendered(parts):
    out = ""
    for p in parts:
        t = p["type"]
        if t == "text":
            out += p["text"] + "\n"
        elif t == "reasoning":
            out += f"(thinking) {p['text']}\n" if p["text"] else ""
        elif t == "toolCall":
            out += f"→ called {p['name']}({json.dumps(p['input'], separators=(',', ':'))})\n"
        elif t == "toolResult":
            out += "← returned " + ("an error: " if p["isError"] else "") + rendered(p.get("content") or []) + "\n"
        elif t == "file":
            out += "[image/png attachment f.png]\n"
        elif t == "resourceLink":
            out += "[see mnemodex://memory/1]\n"
        else:
            out += f"[a {t} part this build does not render]\n"
    return out


def test_walk(messages, talk):
    want = {(s, k, i, n, path, p["type"], p.get("callId"), p.get("name"), p.get("text")) for s, k, i, _, parts in talk for n, (path, p) in enumerate(walk(parts))}
    for depth in (None, 6):
        assert {(r.session, r.pos, r.id, r["at"], tuple(r.path), r.type, r.call_id, r.name, r.text) for r in P.walk_parts(messages, depth).collect()} == want
    few = P.walk_parts(messages, 1).collect()
    assert {len(r.path) for r in few} == {1}
    assert "ArrowPython" not in P.walk_parts(messages, 4)._jdf.queryExecution().toString()


def test_rendering_and_titles(messages, talk):
    got = {(r.session, r.pos): r.text for r in P.rendered_turns(messages).collect()}
    assert got == {(s, k): f"### {role}\n{rendered(p)}\n" for s, k, _, role, p in talk}
    page = {r.session: r.text for r in P.replay(P.rendered_turns(messages)).collect()}
    assert page["s3"] == "## The conversation so far\n\n" + "".join(got[(s, k)] for s, k, *_ in talk if s == "s3")
    titles = {}
    for s, _, _, role, p in talk:
        said = [x["text"].strip() for _, x in walk(p) if x["type"] == "text" and x["text"].strip()]
        if role == "user" and said and s not in titles:
            flat = " ".join(said[0].split())
            titles[s] = flat if len(flat) <= 72 else flat[:72].strip() + "…"
    assert {r.session: r.title for r in P.spoken_titles(messages).collect()} == {s: titles.get(s, f"Recovered session 000000{s}") for s, *_ in talk}


def test_exchanges(messages, talk):
    want = {}
    for s, k, i, _, parts in talk:
        for path, p in walk(parts):
            if p["type"] not in ("toolCall", "toolResult"):
                continue
            new = (s, p["callId"]) not in want
            e = want.setdefault((s, p["callId"]), {"met": (k, path), "name": None, "call": None, "result": None, "error": None})
            if p["type"] == "toolCall" and new:
                e |= {"name": p["name"], "call": i}
            if p["type"] == "toolResult":
                e |= {"result": i, "error": p["isError"]}
    got = {(r.session, r.call_id): {"met": (r.met.pos, tuple(r.met.path)), "name": r.name, "call": r.call_message, "result": r.result_message, "error": r.is_error} for r in P.tool_exchanges(messages).collect()}
    assert got == want
    assert {r.matched for r in P.tool_exchanges(messages).where("result_message is null").collect()} <= {False}


def test_problems(spark):
    deep = [{"type": "toolResult", "callId": "a", "content": [{"type": "toolResult", "callId": "b", "content": [{"type": "toolCall", "callId": " "}]}]}]
    cases = {
        '[{"type":"text","text":"x"}]': None, '{broken': "malformed part", '["a"]': "malformed part", '[{"text":"x"}]': "part without type", '[{"type":" "}]': "part without type", '[{"type":"text"}, 5]': "malformed part", "[]": "no parts",
        json.dumps(deep): "tool part without call id", '[{"type":"toolResult","callId":"a","content":"text"}]': "malformed part", '{"type":"text"}': "malformed part", '[{"type":"toolCall"},{"x":1}]': "tool part without call id",
        '[{"type":"new","any":[1]}]': None, "null": "no parts", json.dumps([{"type": "text"}] * 1025): "too many parts", "[null]": "malformed part", " ": "no parts", '[{"type":"text","content":[]}]': None,
    }
    rows = [("s", k, f"m{k}", "user", p) for k, p in enumerate(cases)] + [("s", 100, " ", "user", "[]"), ("s", 101, "i" * 257, "user", "[]"), ("s", 102, "m", "boss", "[]"), ("s", 103, "m", "user", None)]
    got = [r.problem for r in P.message_problems(spark.createDataFrame(rows, SCHEMA)).orderBy("pos").collect()]
    assert got == [*cases.values(), "missing id", "id too long", "unknown role", "no parts"]
    assert P.message_problems(spark.createDataFrame([], SCHEMA)).count() == 0
