"""Nested message parts: walking, rules, tool calls and their results, titles, rendering.

Parts are a JSON array; a tool result holds parts of its own. Everything is done in the JVM: `from_json` reads an array as the
texts of its elements, so a tool's input is shown as it is stored (VARIANT would sort its keys), and each level of nesting
is one generator over the one above. A part's `path`, its places from the top down, orders parts as they are read.

Defined cases: null and empty parts are no parts; parts that are no JSON array are one row of no type whose `malformed` says so, and
so is an element that is no object or whose content is no array; nothing raises. A string that holds the JSON of an object is read as that object.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T

# Part types, in either spelling
CALLS, RESULTS = ("toolCall", "tool_call"), ("toolResult", "tool_result")
REASONING, LINKS = ("reasoning", "thinking"), ("resourceLink", "resource_link")

_FIELDS = "type string, text string, callId string, call_id string, name string, input string, content string, isError boolean, mediaType string, filename string, uri string"
#: Levels of nesting that are followed before the walk is given up as endless.
DEEPEST = 64


def _read(raw: Column) -> Column:
    """An element's text as a part; null where it is no object."""
    return F.when(F.ltrim(raw).startswith("{"), F.from_json(raw, _FIELDS))


def _inner(content: Column) -> Column:
    return F.from_json(content, "array<string>")


def _part(at: Column, raw: Column, shown: Column, keys: list[str]) -> list:
    p = _read(raw)
    no_list = p["content"].isNotNull() & (F.trim(p["content"]) != "") & _inner(p["content"]).isNull()
    return [*keys, at.alias("path"), p.alias("part"), shown.alias("shown"), (p.isNull() | F.coalesce(no_list, F.lit(False))).alias("malformed")]


def part_rows(messages: DataFrame, keys: list[str], parts: str = "parts", depth: int | None = None) -> DataFrame:
    """(keys, path, part, shown, malformed): a row for each part of each message, nested ones too; `shown` where all that hold it are tool results.

    Levels are added until one is empty; where `depth` is given, so many are taken without looking.
    """
    raw = F.col(parts).cast("string")
    top = F.from_json(raw, "array<string>")
    broken = ~F.trim(raw).isin("", "null") & top.isNull()
    top = F.when(broken, F.array(F.lit("broken"))).otherwise(top)
    level = messages.select(*keys, F.posexplode(top).alias("i", "raw")).select(*_part(F.array("i"), F.col("raw"), F.lit(True), keys))
    found = level
    for n in range(1, depth or DEEPEST + 1):
        if n == depth:
            break
        inside = level.where(F.col("part.content").isNotNull())
        inside = inside.select(*keys, "path", F.col("shown") & F.coalesce(F.col("part.type").isin(*RESULTS), F.lit(False)), F.posexplode(_inner(F.col("part.content")))).toDF(*keys, "path", "shown", "i", "raw")
        level = inside.select(*_part(F.concat("path", F.array("i")), F.col("raw"), F.col("shown"), keys))
        if depth is None and level.isEmpty():
            break
        if n == DEEPEST:
            raise ValueError(f"parts are nested more than {DEEPEST} deep")
        found = found.unionByName(level)
    return found


def _call_id() -> Column:
    return F.coalesce("part.callId", "part.call_id")


def walk_parts(messages: DataFrame, depth: int | None = None) -> DataFrame:
    """(session, pos, id, at, path, type, call_id, name, text): every part of messages(session, pos, id, parts: JSON array), nested
    ones behind the part that holds them; `at` counts a message's parts in that order."""
    keys = ["session", "pos", "id"]
    at = F.row_number().over(Window.partitionBy(*keys).orderBy("path")) - 1
    return part_rows(messages, keys, depth=depth).select(*keys, at.alias("at"), "path", F.col("part.type").alias("type"), _call_id().alias("call_id"), F.col("part.name").alias("name"), F.col("part.text").alias("text"))


def _is(kinds: tuple[str, ...]) -> Column:
    return F.coalesce(F.col("part.type").isin(*kinds), F.lit(False))


def message_problems(messages: DataFrame, depth: int | None = None) -> DataFrame:
    """messages(session, pos, id, role, parts: JSON array) with `problem`: the first rule broken, or null.

    Parts are judged in reading order at any depth: each is an object with a type, its content is a list, and a tool part has a call id.
    """
    at = ["session", "pos"]
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    whole = F.size("path") == 1
    wrong = (
        F.when(F.col("malformed") & F.col("part").isNull(), "malformed part").when(blank(F.col("part.type")), "part without type")
        .when(_is(CALLS + RESULTS) & blank(_call_id()), "tool part without call id").when(F.col("malformed"), "malformed part")
    )
    walked = part_rows(messages, at, depth=depth).withColumn("wrong", wrong)
    walked = walked.groupBy(*at).agg(F.count_if(whole).alias("n_"), F.min_by("wrong", F.when(F.col("wrong").isNotNull(), F.col("path"))).alias("wrong_"))
    n = F.coalesce("n_", F.lit(0))
    problem = (
        F.when(blank(F.col("id")), "missing id").when(F.octet_length("id") > C.MESSAGE_ID_MAX, "id too long").when(~F.coalesce(F.col("role").isin(*C.ROLES), F.lit(False)), "unknown role")
        .when(n == 0, "no parts").when(n > C.PARTS_MAX, "too many parts").otherwise(F.col("wrong_"))
    )
    return messages.join(walked, at, "left").withColumn("problem", problem).drop("n_", "wrong_")


def tool_exchanges(messages: DataFrame, depth: int | None = None) -> DataFrame:
    """(session, call_id, met, name, input, call_message, result_message, is_error, matched) of messages(session, pos, id, parts).

    Calls meet results by id alone, at any depth. The first call of an id counts, unless a result came before it: then there is
    no call (an exchange cut in half). Of several results the last one counts. `met` is where the id was first seen.
    """
    p = part_rows(messages, ["session", "pos", "id"], depth=depth).where(_is(CALLS + RESULTS))
    result, at = _is(RESULTS), F.struct("pos", "path")
    p = p.select("session", F.coalesce(_call_id(), F.lit("")).alias("call_id"), at.alias("at"), F.struct(result.alias("result"), "id", F.col("part.name").alias("name"), F.col("part.input").alias("input"), F.coalesce("part.isError", F.lit(False)).alias("error")).alias("p"))
    a = p.groupBy("session", "call_id").agg(F.min("at").alias("met"), F.min_by("p", "at").alias("f"), F.max_by("p", F.when(F.col("p.result"), F.col("at"))).alias("r"))
    call = lambda c: F.when(~F.col("f.result"), F.col(f"f.{c}"))
    return a.select("session", "call_id", "met", call("name").alias("name"), call("input").alias("input"), call("id").alias("call_message"), F.col("r.id").alias("result_message"), F.col("r.error").alias("is_error"), F.col("r").isNotNull().alias("matched"))


def spoken_titles(messages: DataFrame, depth: int | None = None) -> DataFrame:
    """(session, title): the first prose of the first user message that has some, depth first, cut to a title; else a recovered-session one."""
    keys = ["session", "pos"]
    text = T.trimmed(F.col("part.text"))
    said = part_rows(messages.where("role = 'user'"), keys, depth=depth).where((F.col("part.type") == "text") & (text != "")).groupBy("session").agg(F.min_by(text, F.struct("pos", "path")).alias("said"))
    every = messages.select("session").distinct()
    recovered = F.concat(F.lit("Recovered session "), F.substring(F.lpad(F.col("session").cast("string"), 8, "0"), 1, 8))
    return every.join(said, "session", "left").select("session", F.coalesce(T.truncate_title(F.col("said")), recovered).alias("title"))


def part_text(part: Column) -> Column:
    """A part's text up to what it holds; a tool result is closed by a line feed behind its content."""
    s = lambda c: F.coalesce(part[c], F.lit(""))
    kind, cat = part["type"], F.concat
    return (
        F.when(kind == "text", cat(s("text"), F.lit("\n")))
        .when(kind.isin(*REASONING), F.when(s("text") != "", cat(F.lit("(thinking) "), s("text"), F.lit("\n"))).otherwise(""))
        .when(kind.isin(*CALLS), cat(F.lit("→ called "), s("name"), F.lit("("), s("input"), F.lit(")\n")))
        .when(kind.isin(*RESULTS), cat(F.lit("← returned "), F.when(F.coalesce(part["isError"], F.lit(False)), "an error: ").otherwise("")))
        .when(kind == "file", cat(F.lit("["), s("mediaType"), F.lit(" attachment "), s("filename"), F.lit("]\n")))
        .when(kind.isin(*LINKS), cat(F.lit("[see "), s("uri"), F.lit("]\n")))
        .otherwise(cat(F.lit("[a "), s("type"), F.lit(" part this build does not render]\n")))
    )


def rendered_turns(messages: DataFrame, depth: int | None = None) -> DataFrame:
    """(session, pos, text): messages(session, pos, role, parts) as they are shown when a conversation is resumed.

    Each part opens at its path and a tool result closes behind all paths below its own; a turn's pieces meet in its row, which holds
    no more than the message did.
    """
    keys = ["session", "pos"]
    p = part_rows(messages, keys, depth=depth).where("shown")
    shut = F.when(_is(RESULTS), F.struct(F.concat("path", F.array(F.lit(1 << 30))).alias("path"), F.lit("\n").alias("text")))
    p = p.select(*keys, F.explode(F.array_compact(F.array(F.struct("path", part_text(F.col("part")).alias("text")), shut))).alias("e"))
    inside = p.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["text"]), "").alias("inside"))
    text = F.concat(F.lit("### "), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("inside", F.lit("")), F.lit("\n"))
    return messages.select(*keys, "role").join(inside, keys, "left").select(*keys, text.alias("text"))


def replay(turns: DataFrame) -> DataFrame:
    """(session, text): a page of rendered turns, a few for each session, as one text."""
    each = F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"])
    return turns.groupBy("session").agg(F.concat(F.lit("## The conversation so far\n\n"), F.array_join(each, "")).alias("text"))
