"""Operator 6, chat formatting: budgeted windows of turns.

A turn is written `<s>[role]text</s>`; inside role and text the characters that start or end control
strings are escaped (backslash, `<`, `[`, `]`), so no control string of this or another template
survives in a text, and reading back is exact. A turn's tokens are those of its formatted text under a byte-level BPE
vocabulary. Prefix sums of the turns' token counts choose spans of whole turns that fit the budget; a window repeats the conversation's system turn and limited history
before them. Only assistant texts of its own span are under the loss mask, so each is learned once.

A conversation is cut after every `segment` turn numbers, so that one that holds a third of all rows is
formatted by many tasks; the last turns of a segment go along to the next one as history. Memory is
bounded by a block of turns, whatever a conversation's length. A reader that hashes a whole
conversation, as `read_back` does, streams over its windows.

Defined cases: null texts and roles are empty; a null turn number comes first; equal turn numbers are
ordered by role and text and repeated rows are repeated turns; a turn beyond the budget has a window of
its own; extra columns are left out; an empty table gives no windows.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import utf8

WINDOWS = "conv_id long, segment long, window long, n_context int, n_tokens long, text string, loss array<struct<start:int,end:int>>"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
BLOCK_TURNS, BLOCK_CHARS = 512, 4 << 20
_ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b", "]": "\\e"}
_BACK = {v[1]: k for k, v in _ESCAPES.items()}
_TURN = re.compile(r"<s>\[([^\[\]<]*)\]([^\[\]<]*)</s>")


def escape(s: str) -> str:
    return re.sub(r"[\\<\[\]]", lambda m: _ESCAPES[m[0]], s)


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", lambda m: _BACK[m[1]], s) if "\\" in s else s


def turn(role: str, text: str) -> str:
    return f"<s>[{escape(role)}]{escape(text)}</s>"


def turn_tokens(codec: bpe.Codec, turns: list[str]) -> list[int]:
    return [len(ids) for ids in codec.encode(*utf8(pa.array(turns, pa.large_string())))]


def parse(text: str) -> list[tuple[str, str]]:
    return [(unescape(a), unescape(b)) for a, b in _TURN.findall(text)]


def spans(tokens: np.ndarray, room_at) -> Iterator[tuple[int, int]]:
    """Turn-aligned spans: from each start the longest run whose prefix-sum difference fits room_at(start), one turn at least."""
    total = np.append(0, np.cumsum(tokens))
    a = 0
    while a < len(tokens):
        b = int(np.searchsorted(total, total[a] + room_at(a), side="right")) - 1
        b = max(a + 1, b)
        yield a, b
        a = b


def _format(ranks, budget: int, history_tokens: int, history_turns: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size = 0
        key = system = None
        window = 0
        past: deque = deque(maxlen=history_turns)
        block: list[tuple] = []
        chars = 0

        def close() -> None:
            nonlocal window, size, chars
            if not block:
                return
            before = len(past)
            turns = [*past, *block]  # (turn, role, text, tokens)
            plans: dict[int, tuple[bool, int]] = {}

            def is_system(t) -> bool:
                return system is not None and t[:3] == system[:3]

            def room(a: int) -> int:
                """What is left for own turns from block turn a on; remembers its system copy and history."""
                own = block[a]
                copy = system is not None and not is_system(own) and (system[0] is None or own[0] is not None and system[0] < own[0])
                left = budget - own[3] - (system[3] if copy else 0)
                first, used = a, 0
                while first > -before and a - first < history_turns:
                    t = turns[before + first - 1]
                    if is_system(t) or used + t[3] > min(history_tokens, left):
                        break
                    used += t[3]
                    first -= 1
                plans[a] = copy, first
                return left + own[3] - used

            for a, b in spans(np.array([t[3] for t in block]), room):
                copy, first = plans[a]
                context = [system] * copy + turns[before + first : before + a]
                pieces, loss, at = [], [], 0
                for i, (_, role, text, _) in enumerate([*context, *block[a:b]]):
                    lead, body = f"<s>[{escape(role)}]", escape(text)
                    at += len(lead)
                    if i >= len(context) and role == "assistant" and body:
                        loss.append({"start": at, "end": at + len(body)})
                    at += len(body) + 4
                    pieces.append(f"{lead}{body}</s>")
                out.append((*key, window, len(context), sum(t[3] for t in (*context, *block[a:b])), "".join(pieces), loss))
                size += at
                window += 1
            past.extend(block)
            block.clear()
            chars = 0

        def flush() -> pa.RecordBatch:
            nonlocal size
            cols = [*zip(*out)]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            out.clear()
            size = 0
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["conv_id", "segment", "window", "n_context", "n_tokens", "text", "loss"])

        codec = bpe.codec(ranks.value)
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(6)]
            tokens = turn_tokens(codec, [*map(turn, cols[4], cols[5])])
            for conv, seg, kind, place, role, text, n in zip(*cols, tokens):
                if (conv, seg) != key:
                    close()
                    key, system, window = (conv, seg), None, 0
                    past.clear()
                item = (place, role, text, n)
                if kind == 0:
                    system = item
                elif kind == 1:
                    past.append(item)
                else:
                    block.append(item)
                    chars += len(text)
                    if len(block) >= BLOCK_TURNS or chars >= BLOCK_CHARS:
                        close()
                if size > BLOCK_CHARS:
                    yield flush()
        close()
        if out:
            yield flush()

    return run


def chat_windows(conversations: DataFrame, ranks: bytes, budget: int = 2048, history_tokens: int = 256, history_turns: int = 8, segment: int = 256) -> DataFrame:
    """Windows of formatted turns: text, the number of repeated turns that lead it, and the loss spans in it. ranks: the content of
    a .tiktoken file, of a fixed size, by which tokens are counted."""
    ranks = conversations.sparkSession.sparkContext.broadcast(ranks)
    c = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("segment", F.coalesce(F.floor(F.col("turn") / segment), F.lit(-(1 << 40))).cast("long"))
    own = c.withColumn("kind", F.lit(2))
    tail = c.where(F.pmod("turn", F.lit(segment)) >= segment - history_turns).withColumn("segment", F.col("segment") + 1).withColumn("kind", F.lit(1))
    # the first system turn of each conversation, copied to each of its segments: one small row for each
    first = c.where("role = 'system'").groupBy("conv_id").agg(F.min(F.struct("turn", "text")).alias("s"))
    parts = c.select("conv_id", "segment").distinct().withColumn("kind", F.lit(0))
    copies = parts.join(first, parts.conv_id.eqNullSafe(first.conv_id)).select(parts.conv_id, F.col("s.turn").alias("turn"), F.lit("system").alias("role"), F.col("s.text").alias("text"), "segment", "kind")
    rows = own.unionByName(tail).unionByName(copies).select("conv_id", "segment", "kind", "turn", "role", "text")
    keys = ["conv_id", "segment"]
    return rows.repartition(*keys).sortWithinPartitions(*keys, "kind", "turn", "role", "text").mapInArrow(_format(ranks, budget, history_tokens, history_turns), WINDOWS)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, state = object(), None

    def done():
        n, turns, chars, loss, formatted, windows = state
        cols = [[key], [n], [turns.hexdigest()], [chars], [loss.hexdigest()], [formatted], [windows]]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_windows"])

    for batch in batches:
        for conv, context, text, loss in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if state is None or conv != key:
                if state is not None:
                    yield done()
                key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
            turns = parse(text)[context:]
            state[0] += len(turns)
            for role, body in turns:
                state[1].update(f"{role}\n{body}\n".encode())
            for x in loss:
                body = unescape(text[x["start"] : x["end"]])
                state[2] += len(body)
                state[3].update(body.encode())
            state[4] += len(text)
            state[5] += 1
    if state is not None:
        yield done()


def read_back(windows: DataFrame) -> DataFrame:
    """Per conversation, what its windows hold: turns once each in order, and the text under the loss mask."""
    w = windows.repartition("conv_id").sortWithinPartitions("conv_id", "segment", "window")
    return w.select("conv_id", "n_context", "text", "loss").mapInArrow(_read, READ)
