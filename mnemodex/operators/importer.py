"""Agent logs: JSON lines to messages and nested parts and back, what was lost, and message chains by their parent pointers.

A line is read as VARIANT and turned into a message by expressions alone, row by row; what the message schema has no field for rides
in bags (`ext`) at the level where it was found, so a message turns back into its line. A line is `rebuilt` if that gives the same
value, `diverged` at the first field that differs, `refused` with a reason, or no message.

Chains are found by pointer doubling: log2(length) joins, of which each is dealt by (session, id), so a session with a third of all
lines is spread like others. Rounds are written to the shared folder.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..sources.shared import written
from .parts import message_problems

# The bags' names, the log's part types and the schema's
BARE, FIELDS = "$string", "$fields"
TYPES = {"text": "text", "thinking": "reasoning", "tool_use": "toolCall", "tool_result": "toolResult", "image": "file"}
CONSUMED = {"text": ("type", "text"), "thinking": ("type", "thinking", "signature"), "tool_use": ("type", "id", "name", "input"), "tool_result": ("type", "tool_use_id"), "image": ("type",)}
#: Levels of content that are turned into parts; deeper content rides in its part's bag.
DEPTH = 4

_NONE = "map<string,variant>"


def _v(x: Column) -> Column:
    return x.cast("variant")


def _let(x: Column, then) -> Column:
    """then(x), with x bound once: what is used twice at each level would else be written out 2**depth times."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def _get(v: Column, path: str) -> Column:
    return F.try_variant_get(v, path, "variant")


def _is_string(v: Column) -> Column:
    return F.coalesce(F.schema_of_variant(v) == "STRING", F.lit(False))


def _string(v: Column, path: str) -> Column:
    """The string at a path; anything else is empty."""
    x = _get(v, path)
    return F.when(_is_string(x), F.try_variant_get(v, path, "string")).otherwise("")


def _list(v: Column) -> Column:
    """The elements; a JSON null has none; null where it is no list."""
    return F.when(F.is_variant_null(v), F.array().cast("array<variant>")).otherwise(F.try_variant_get(v, "$", "array<variant>"))


def _fields(v: Column) -> Column:
    return F.try_variant_get(v, "$", _NONE)


def _object(entries: dict[str, Column]) -> Column:
    """A map of the entries that are not null."""
    flat = [x for k, c in entries.items() for x in (F.lit(k), c)]
    return F.map_filter(F.create_map(*flat), lambda _, x: x.isNotNull())


def _filled(x: Column) -> Column:
    """A string as VARIANT; empty ones are left out, as on the wire."""
    return F.when(x != "", _v(x))


def _unless_empty(x: Column) -> Column:
    """An array or a map as VARIANT, null where it is empty."""
    return _let(x, lambda y: F.when(F.size(y) > 0, F.to_variant_object(y)))


def _text_part(text: Column, bare: bool) -> Column:
    bag = F.to_variant_object(F.create_map(F.lit(BARE), _v(F.lit(True))))
    return F.to_variant_object(_object({"type": _v(F.lit("text")), "text": _filled(text), **({"ext": bag} if bare else {})}))


def to_part(v: Column, depth: int = DEPTH) -> Column:
    """A log's part as a part of the schema."""
    kind, m = _string(v, "$.type"), _fields(v)
    of = lambda k, x: F.when(kind == k, x)
    name = F.coalesce(*[F.when(kind == k, t) for k, t in TYPES.items()], kind)
    failed = F.coalesce(F.try_variant_get(v, "$.is_error", "boolean"), F.lit(False)) & (F.schema_of_variant(_get(v, "$.is_error")) == "BOOLEAN")
    content = _get(v, "$.content")
    consumed = F.coalesce(*[F.when(kind == k, F.array(*map(F.lit, ks))) for k, ks in CONSUMED.items()], F.array(F.lit("type")))
    consumed = F.when((kind == "tool_result") & failed, F.array_append(consumed, "is_error")).otherwise(consumed)
    bare = (kind == "tool_result") & _is_string(content)
    own: dict[str, Column] = {
        "type": _filled(name), "text": F.coalesce(of("text", _filled(_string(v, "$.text"))), of("thinking", _filled(_string(v, "$.thinking")))), "signature": of("thinking", _filled(_string(v, "$.signature"))),
        "callId": F.coalesce(of("tool_use", _filled(_string(v, "$.id"))), of("tool_result", _filled(_string(v, "$.tool_use_id")))), "name": of("tool_use", _filled(_string(v, "$.name"))), "input": of("tool_use", _get(v, "$.input")),
        "isError": F.when((kind == "tool_result") & failed, _v(F.lit(True))), "mediaType": of("image", _filled(_string(v, "$.source.media_type"))),
    }
    if depth:
        consumed = F.when(kind == "tool_result", F.array_append(consumed, "content")).otherwise(consumed)
        inner = F.transform(_list(content), lambda x: to_part(x, depth - 1))
        inner = F.when(bare, F.array(_text_part(F.try_variant_get(v, "$.content", "string"), False))).otherwise(inner)
        own["content"] = F.when(kind == "tool_result", _unless_empty(inner))
    kept = F.map_filter(m, lambda k, _: ~F.array_contains(consumed, k))
    own["ext"] = _unless_empty(_object({FIELDS: _unless_empty(kept), BARE: F.when(bare, _v(F.lit(True))) if depth else F.lit(None).cast("variant")}))
    return F.to_variant_object(_object(own))


def _over(base: Column, own: Column) -> Column:
    """Both maps; the second one's entries win."""
    return _let(own, lambda o: F.map_concat(F.map_filter(F.coalesce(base, F.create_map().cast(_NONE)), lambda k, _: ~F.array_contains(F.map_keys(o), k)), o))


def from_part(p: Column, depth: int = DEPTH) -> Column:
    """A part of the schema as the log's."""
    kind = _string(p, "$.type")
    name = F.coalesce(*[F.when(kind == t, k) for k, t in TYPES.items()], kind)
    of = lambda t, x: F.when(kind == t, x)
    said = lambda path: _v(_string(p, path))
    content = _get(p, "$.content")
    null = F.parse_json(F.lit("null"))
    own: dict[str, Column] = {
        "type": _v(name), "text": of("text", said("$.text")), "thinking": of("reasoning", said("$.text")), "signature": of("reasoning", said("$.signature")), "id": of("toolCall", said("$.callId")),
        "name": of("toolCall", said("$.name")), "input": of("toolCall", F.coalesce(_get(p, "$.input"), null)), "tool_use_id": of("toolResult", said("$.callId")),
        "is_error": of("toolResult", F.when(F.try_variant_get(p, "$.isError", "boolean"), _v(F.lit(True)))),
    }
    if depth:
        bare = _get(p, f'$.ext["{BARE}"]').isNotNull()
        listed = F.to_variant_object(F.transform(_list(content), lambda x: from_part(x, depth - 1)))
        own["content"] = of("toolResult", F.when(content.isNotNull(), F.when(bare, _v(_string(p, "$.content[0].text"))).otherwise(listed)))
    return F.to_variant_object(_over(F.try_variant_get(p, f'$.ext["{FIELDS}"]', _NONE), _object(own)))


def _odd(v: Column, depth: int = DEPTH) -> Column:
    """Whether a list of parts holds what is no part: no object, or a tool result whose content is no text and no list."""
    content = lambda x: _get(x, "$.content")
    fits = lambda x: content(x).isNull() | _is_string(content(x)) | _list(content(x)).isNotNull()
    odd = lambda x: _fields(x).isNull() | ((_string(x, "$.type") == "tool_result") & (~fits(x) | (_odd(content(x), depth - 1) if depth else F.lit(False))))
    return F.coalesce(F.exists(_list(v), odd), F.lit(False))


_RFC3339 = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)$"


def _shown(t: Column) -> Column:
    return F.date_format(F.date_trunc("MILLISECOND", t), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def to_messages(lines: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(file, line, kind, session, id, role, parent, created, sidechain, parts, ext, refused, log) of lines(file, line, value).

    kind is the line's type; refused is set where a user or assistant line is no message. parts and ext are JSON; parts fit
    `parts.walk_parts` and the other operators there. A blank line is left out; one that does not parse has no kind.
    """
    v = F.try_parse_json(F.trim("value"))
    d = lines.where(F.trim(F.coalesce("value", F.lit(""))) != "").select("file", "line", v.alias("log"), v.isNull().alias("broken"))
    log, content = F.col("log"), F.get(F.col("content"), F.lit(0))
    d = d.select("*", _string(log, "$.type").alias("kind"), F.array(_get(log, "$.message.content")).alias("content"), _fields(log).alias("m"), _fields(_get(log, "$.message")).alias("envelope"))
    stamp, parent = _get(log, "$.timestamp"), _get(log, "$.parentUuid")
    said = F.trim(F.try_variant_get(log, "$.timestamp", "string"))
    linked = parent.isNotNull() & ~F.is_variant_null(parent)
    parts = F.when(_is_string(content), F.array(_text_part(F.try_variant_get(content, "$", "string"), True))).otherwise(F.transform(_list(content), lambda x: to_part(x, depth)))
    left = lambda m, *known: F.map_filter(m, lambda k, _: ~k.isin(*known))
    rest, inside = left(F.col("m"), "uuid", "timestamp", "message"), left(F.col("envelope"), "role", "content")
    rest = F.map_filter(rest, lambda k, _: ~((k == "parentUuid") & linked))
    bag = _over(rest, _object({"message": _unless_empty(inside)}))
    refused = (
        F.when(F.col("broken"), "the line does not parse").when(~F.col("kind").isin("user", "assistant"), None)
        .when(_get(log, "$.message").isNotNull() & F.col("envelope").isNull(), "message envelope").when(stamp.isNotNull() & ~F.is_variant_null(stamp) & (said != "") & ~(said.rlike(_RFC3339) & F.try_to_timestamp(said).isNotNull()), "timestamp")
        .when(content.isNull(), "message has no content").when(~_is_string(content) & _list(content).isNull(), "message content").when(_odd(content, depth), "message content")
    )
    return d.select(
        "file", "line", "kind", _string(log, "$.sessionId").alias("session"), _string(log, "$.uuid").alias("id"), _string(log, "$.message.role").alias("role"), F.when(linked, F.nullif(_string(log, "$.parentUuid"), F.lit(""))).alias("parent"),
        F.when(said.rlike(_RFC3339), F.date_trunc("MILLISECOND", F.try_to_timestamp(said))).alias("created"), F.coalesce(F.try_variant_get(log, "$.isSidechain", "boolean"), F.lit(False)).alias("sidechain"),
        F.to_json(F.to_variant_object(parts)).alias("parts"), F.to_json(F.to_variant_object(bag)).alias("ext"), refused.alias("refused"), "log",
    )


def from_message(depth: int = DEPTH) -> Column:
    """The log line of a message(id, parent, created, role, parts, ext), as VARIANT."""
    parts, ext = F.parse_json("parts"), F.parse_json("ext")
    first = _get(parts, "$[0]")
    bare = _get(first, f'$.ext["{BARE}"]').isNotNull() & (F.size(_list(parts)) == 1) & (_string(first, "$.type") == "text")
    content = F.when(bare, _v(_string(first, "$.text"))).otherwise(F.to_variant_object(F.transform(_list(parts), lambda p: from_part(p, depth))))
    envelope = _over(F.try_variant_get(ext, "$.message", _NONE), _object({"role": _v(F.col("role")), "content": content}))
    own = {"uuid": _v(F.col("id")), "parentUuid": F.when(F.coalesce("parent", F.lit("")) != "", _v(F.col("parent"))), "timestamp": F.when(F.col("created").isNotNull(), _v(_shown(F.col("created")))), "message": F.to_variant_object(envelope)}
    return F.to_variant_object(_over(F.map_filter(_fields(ext), lambda k, _: k != "message"), _object(own)))


def _first_key(a: Column, b: Column) -> Column:
    """The first key, by name, whose values differ."""
    none = F.create_map().cast(_NONE)
    value = lambda m, k: F.to_json(F.try_element_at(m, k))
    differs = lambda a, b: F.filter(F.array_sort(F.array_union(F.map_keys(a), F.map_keys(b))), lambda k: ~value(a, k).eqNullSafe(value(b, k)))
    return _let(F.struct(F.coalesce(a, none).alias("a"), F.coalesce(b, none).alias("b")), lambda x: F.try_element_at(differs(x["a"], x["b"]), F.lit(1)))


def _part_difference(a: Column, b: Column) -> Column:
    """Of two lists of parts: [type].field added, dropped or changed, of the first part that differs."""

    def told(one: Column) -> Column:
        has = lambda c: F.array_contains(F.map_keys(_fields(one[c])), one["k"])
        how = F.when(~has("x"), " added").when(~has("y"), " dropped").otherwise(" changed")
        return F.concat(F.lit("["), _string(one["x"], "$.type"), F.lit("]."), one["k"], how)

    def of(x: Column) -> Column:
        pairs = F.zip_with(x["a"], x["b"], lambda p, q: F.struct(p.alias("x"), q.alias("y"), _first_key(_fields(p), _fields(q)).alias("k")))
        one = _let(F.try_element_at(F.filter(pairs, lambda p: p["k"].isNotNull()), F.lit(1)), told)
        sizes = F.concat(F.lit("["), F.size(x["a"]), F.lit(" parts vs "), F.size(x["b"]), F.lit("]"))
        return F.when(x["a"].isNull() | x["b"].isNull(), "<not a list>").when(F.size(x["a"]) != F.size(x["b"]), sizes).otherwise(one)

    return _let(F.struct(_list(a).alias("a"), _list(b).alias("b")), of)


def outcomes(messages: DataFrame, depth: int = DEPTH) -> DataFrame:
    """`to_messages` with outcome (rebuilt, diverged, refused, other) and detail: the field that differs, the reason, or the line's kind.

    The wire form is read again for the comparison, so a field that survives in memory and not in JSON is lost.
    """
    d = messages.withColumns({"session_": F.col("session")})
    turn = F.col("kind").isin("user", "assistant")
    fit = turn & F.col("refused").isNull()
    # each line is judged for itself, whatever its id
    keyed = d.withColumns({"session": F.col("file"), "pos": F.col("line")})
    judged = message_problems(keyed.where(fit).select("session", "pos", "id", "role", "parts")).select(F.col("session").alias("file_"), F.col("pos").alias("line_"), F.col("problem"))
    d = messages.join(judged, (F.col("file") == F.col("file_")) & (F.col("line") == F.col("line_")), "left").withColumn("refused", F.coalesce("refused", "problem")).drop("file_", "line_", "problem")
    back = F.when(fit & F.col("refused").isNull(), from_message(depth))
    d = d.withColumn("back", back)
    log, got = F.col("log"), F.col("back")
    envelope = lambda v: _fields(_get(v, "$.message"))
    key = _first_key(_fields(log), _fields(got))
    inner = _first_key(envelope(log), envelope(got))
    content = F.concat(F.lit("message.content"), _part_difference(_get(log, "$.message.content"), _get(got, "$.message.content")))
    where = F.when(key != "message", key).otherwise(F.when(inner == "content", content).otherwise(F.concat(F.lit("message."), inner)))
    same = F.to_json(log).eqNullSafe(F.to_json(got))
    outcome = F.when(F.col("refused").isNotNull(), "refused").when(~turn, "other").when(same, "rebuilt").otherwise("diverged")
    detail = F.when(F.col("refused").isNotNull(), F.col("refused")).when(~turn, F.col("kind")).when(same, "").otherwise(where)
    return d.select(*messages.columns[:-1], outcome.alias("outcome"), detail.alias("detail"))


def census(judged: DataFrame) -> DataFrame:
    """(outcome, detail, n) of `outcomes`."""
    return judged.groupBy("outcome", "detail").agg(F.count("*").alias("n"))


def part_census(lines: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(type, n): the log's parts of user and assistant lines by type, nested ones too; a bare string is `<string>`."""
    v = F.try_parse_json(F.trim("value"))
    level = lines.select(v.alias("log")).where(_string(F.col("log"), "$.type").isin("user", "assistant")).select(_get(F.col("log"), "$.message.content").alias("c"))
    found = level.where(_is_string(F.col("c"))).select(F.lit("<string>").alias("type"))
    for _ in range(depth + 1):
        p = level.select(F.explode(_list(F.col("c"))).alias("p"))
        found = found.unionByName(p.select(_string(F.col("p"), "$.type").alias("type")))
        level = p.where(_string(F.col("p"), "$.type") == "tool_result").select(_get(F.col("p"), "$.content").alias("c"))
    return found.groupBy("type").agg(F.count("*").alias("n"))


def chains(messages: DataFrame) -> DataFrame:
    """(session, id, line, root, depth, branch, problem): where each message(session, id, parent, line, sidechain) stands in its conversation.

    Of lines that repeat an id the first one counts, and others are `repeated`; a parent that is no message here is `cut`, and its
    child a root; messages that lead round in a circle have problem `circle` and no root. The conversation is the way from the root
    to its last message outside sidechains: that is branch `main`; what turns off it is `fork`, and sidechains are `side`.
    """
    key = ["session", "id"]
    m = messages.where(F.coalesce("id", F.lit("")) != "").select("session", "id", F.nullif("parent", F.lit("")).alias("parent"), "line", "sidechain")
    first = m.groupBy(*key).agg(F.min(F.struct("line", "parent", "sidechain")).alias("f")).select(*key, "f.*")
    parents = first.select("session", F.col("id").alias("parent"), F.lit(True).alias("there"))
    nodes = written(first.join(parents, ["session", "parent"], "left").select(*key, "line", "sidechain", F.when(F.col("there"), F.col("parent")).alias("up"), (F.col("parent").isNotNull() & F.col("there").isNull()).alias("cut")))
    most = nodes.groupBy("session").agg(F.count("*").alias("n")).agg(F.coalesce(F.max("n"), F.lit(1))).first()[0]
    # at: as far up as 2**round steps lead, or the root; tables of jumps are kept for the way back
    jump = nodes.select(*key, F.coalesce("up", "id").alias("at"), F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long").alias("steps"), F.col("up").isNull().alias("done"))
    jumps = [jump]
    for _ in range(max(1, math.ceil(math.log2(most + 1)))):
        on = jump.select("session", F.col("id").alias("at"), F.col("at").alias("next"), F.col("steps").alias("more"), F.col("done").alias("end"))
        jump = written(jump.join(on, ["session", "at"]).select("session", "id", F.col("next").alias("at"), (F.col("steps") + F.col("more")).alias("steps"), F.col("end").alias("done")))
        jumps.append(jump)
        if not jump.where("not done").limit(1).count():
            break
    last = nodes.where(~F.col("sidechain")).groupBy("session").agg(F.max_by("id", "line").alias("id"))
    main = last.select(*key)
    for jump in reversed(jumps):
        main = written(main.unionByName(jump.join(main, key, "left_semi").select("session", F.col("at").alias("id"))).distinct())
    main = main.withColumn("main", F.lit(True))
    out = nodes.join(jumps[-1], key).join(main, key, "left")
    circle = ~F.col("done")
    branch = F.when(F.col("sidechain"), "side").when(F.col("main"), "main").otherwise("fork")
    one = out.select(*key, "line", F.when(~circle, F.col("at")).alias("root"), F.when(~circle, F.col("steps")).alias("depth"), branch.alias("branch"), F.when(circle, "circle").when(F.col("cut"), "cut").alias("problem"))
    again = m.join(first.select(*key, F.col("line").alias("kept")), key).where("line <> kept").select(*key, "line", F.lit(None).cast("string").alias("root"), F.lit(None).cast("long").alias("depth"), F.lit(None).cast("string").alias("branch"), F.lit("repeated").alias("problem"))
    return one.unionByName(again)


def imported_turns(messages: DataFrame, chain: DataFrame) -> DataFrame:
    """(session, pos, id, role, parts, created): each conversation's main branch in order, of messages that were not refused."""
    m = messages.where(F.col("refused").isNull()).select("session", "id", "line", "role", "parts", "created")
    on = chain.where("branch = 'main' and root is not null").select("session", "id", "line", F.col("depth").alias("pos"))
    return m.join(on, ["session", "id", "line"]).select("session", "pos", "id", "role", "parts", "created")
