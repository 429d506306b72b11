"""Scalar functions as column expressions; everything stays inside the JVM unless it says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C

#: White space as the record format trims it, beyond ASCII too.
_SPACE = r"[\s\u0085   -     　]"
SCHEME = "mnemodex"


def trimmed(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, f"^{_SPACE}+", ""), f"{_SPACE}+$", "")


def normalize_tag(x: Column) -> Column:
    return F.lower(trimmed(x))


def normalize_tags(tags: Column) -> Column:
    """Lower-cased and trimmed, without blanks and repeats, first occurrences in order."""
    return F.array_distinct(F.filter(F.transform(tags, normalize_tag), lambda t: t != ""))


def project_key(repo: Column, cwd: Column) -> Column:
    return F.coalesce(F.nullif(repo, F.lit("")), cwd)


def index_text(statement: Column, context: Column) -> Column:
    return F.concat(F.coalesce(statement, F.lit("")), F.lit("\n\n"), F.coalesce(context, F.lit("")))


def joined(sep: str, *parts: Column) -> Column:
    """The parts that are not empty, joined."""
    return F.concat_ws(sep, *[F.nullif(p, F.lit("")) for p in parts])


def session_index_text(title: Column, summary: Column, tags: Column) -> Column:
    return joined("\n\n", title, summary, F.array_join(tags, " "))


def lexical_text(statement: Column, context: Column, keywords: Column, tags: Column) -> Column:
    return joined("\n", statement, context, F.array_join(keywords, " "), F.array_join(tags, " "))


def words(x: Column) -> Column:
    """Lower-cased runs of letters and digits; the pieces at both ends may be empty."""
    return F.split(F.lower(x), r"[^\p{L}\p{Nd}]+")


def is_term(t: Column) -> Column:
    """Whether a word is a term: two bytes or more, and no stopword (a hash set in the plan)."""
    return (F.octet_length(t) >= 2) & ~t.isin(*C.STOPWORDS)


def terms(x: Column) -> Column:
    """Analysed terms: lower-cased runs of letters and digits of two bytes or more, no stopwords; repeats stay."""
    return F.filter(words(x), is_term)


def analyze(text: str) -> list[str]:
    """The same analysis for a query string on the driver."""
    import regex

    return [t for t in regex.split(r"[^\p{L}\p{Nd}]+", text.lower()) if len(t.encode()) >= 2 and t not in set(C.STOPWORDS)]


def parse_span(x: Column) -> Column:
    """`a..b` or `a`: a struct first, last; a missing end is the start."""
    parts = F.split(x, r"\.\.", 2)
    first, last = trimmed(parts[0]), trimmed(F.try_element_at(parts, F.lit(2)))
    return F.struct(first.alias("first"), F.coalesce(F.nullif(last, F.lit("")), first).alias("last"))


def format_span(first: Column, last: Column) -> Column:
    return F.when((last == "") | last.isNull() | (first == last), first).otherwise(F.concat(first, F.lit(".."), last))


def snippet(x: Column, limit: int = C.SNIPPET_BYTES) -> Column:
    """A struct text, truncated: the trimmed text, or its start up to the last blank (space, line feed, tab) among its first
    `limit` bytes and the one after them; where that loses more than half, up to a whole character. With an ellipsis then.

    Bytes are cut as binary; a broken last character becomes the replacement character and is dropped.
    """
    flat = trimmed(x)
    raw = F.encode(flat, "UTF-8")
    # a word that ends exactly at the limit is followed by its blank
    head = lambda n: F.make_valid_utf8(F.substring(raw, 1, n).cast("string"))
    ahead = head(limit + 1)
    word = F.regexp_extract(ahead, r"(?s)^(.*)[ \n\t]", 1)
    whole = F.regexp_replace(head(limit), "\ufffd+$", "")
    cut = F.when(F.octet_length(word) >= limit // 2, word).otherwise(whole)
    long = F.octet_length(flat) > limit
    return F.struct(F.when(long, F.concat(trimmed(cut), F.lit("…"))).otherwise(flat).alias("text"), long.alias("truncated"))


def truncate_title(x: Column, runes: int = C.TITLE_RUNES) -> Column:
    flat = trimmed(F.regexp_replace(x, f"{_SPACE}+", " "))
    return F.when(F.length(flat) > runes, F.concat(F.rtrim(F.substring(flat, 1, runes)), F.lit("…"))).otherwise(flat)


def first_line(x: Column) -> Column:
    return F.coalesce(F.try_element_at(F.filter(F.transform(F.split(x, "\n"), trimmed), lambda t: t != ""), F.lit(1)), F.lit(""))


def short_id(x: Column) -> Column:
    return F.substring(x, 1, 12)


def uri(kind: Column, id_: Column, transcript: bool = False) -> Column:
    return F.concat(F.lit(f"{SCHEME}://"), kind, F.lit("/"), id_, F.lit("/transcript" if transcript else ""))


def parse_uri(x: Column) -> Column:
    """A struct kind, id, transcript; null where the address is malformed."""
    rx = rf"^{SCHEME}://(memory|session)/([0-9a-fA-F]{{32}})(/transcript)?$"
    ok = x.rlike(rx) & ~(x.rlike("/transcript$") & x.rlike("://memory/"))
    return F.when(ok, F.struct(F.regexp_extract(x, rx, 1).alias("kind"), F.lower(F.regexp_extract(x, rx, 2)).alias("id"), (F.regexp_extract(x, rx, 3) != "").alias("transcript")))


def format_time(ts: Column) -> Column:
    """Milliseconds, UTC; unknown times are empty."""
    return F.coalesce(F.date_format(F.date_trunc("MILLISECOND", ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit(""))


def parse_time(x: Column) -> Column:
    return F.try_to_timestamp(x, F.lit("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def valid_id(x: Column) -> Column:
    return x.rlike("^[0-9a-fA-F]{32}$")


def content_id(body: Column, key: str = "") -> Column:
    """A keyed content address (SHA-256)."""
    return F.sha2(F.concat(F.lit(key), body), 256)


def query_stamp(x: Column) -> Column:
    """The first six bytes of the query's SHA-256, base64url."""
    return F.translate(F.base64(F.substring(F.unhex(F.sha2(x, 256)), 1, 6)), "+/", "-_")


def clip_title(x: Column, width: int) -> Column:
    """At most `width` characters, the mark of the cut included; cut at the last blank of the second half, if it has one."""
    flat = trimmed(F.regexp_replace(x, f"{_SPACE}+", " "))
    head = F.substring(flat, 1, width)
    # the last blank among the first `width` characters, if it lies beyond the middle
    blank = width - F.instr(F.reverse(head), " ") + 1
    at = F.when((F.instr(head, " ") > 0) & (blank - 1 >= width // 2), blank - 1).otherwise(width - 1)
    return F.when(F.length(flat) > width, F.concat(F.trim(F.substring(flat, F.lit(1), at)), F.lit("…"))).otherwise(flat)


def saturating_minus(a: Column, b: Column) -> Column:
    return F.greatest(a - b, F.lit(0))


def flush_tick(shortest: Column) -> Column:
    """Seconds between looks at the queue: a tenth of the shortest trigger, from 1 s to a minute."""
    return F.least(F.greatest(shortest / 10, F.lit(1.0)), F.lit(60.0))


def seal(body: Column, key: str) -> Column:
    return F.aes_encrypt(body, F.lit(key), F.lit("GCM"))


def open_sealed(sealed: Column, key: str) -> Column:
    """The body, or null where it cannot be opened."""
    return F.try_aes_decrypt(sealed, F.lit(key), F.lit("GCM"))
