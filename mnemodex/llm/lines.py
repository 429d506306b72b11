r"""Operator 7, line dedup: boilerplate lines that are spread over many distinct sites. DataFrame functions only.

Lines are cut at \n; a line with no character but white space is never boilerplate. Lines are told
apart by two 64-bit hashes. A first aggregation, partial before its shuffle, keeps the lines that occur
`min_sites` times or more, on two sites at least: no other line can be spread that far. Of these a HyperLogLog sketch
per line, merged by aggregation, estimates the distinct sites. Estimates further than `margin` from the
threshold decide; the lines near it get exact distinct counts. The texts then lose the lines found.

A document's boilerplate lines come back as their places, in order; it keeps the stretches between them, so its cost is linear in its lines.

A line that a third of all documents hold is one row per task after partial aggregation. Documents get
their lines back by id, never by line, so a hot line gathers nowhere; the set of boilerplate lines is
joined by Spark's choice (broadcast only below its size limit).

At 8 sites a sketch still lists what it was given and is all but exact; for a large `min_sites` the margin is about 4.6
standard errors of a sketch of 2**10 registers, beyond which the estimate alone decides.

Defined cases: a null text stays null with 0 lines; a null site is a site; repeated rows of one id are
treated alike; documents with the same id keep their own texts; a text of boilerplate alone becomes empty; extra columns of
any name stay, but for n_lines and n_removed, which are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sites from which a line is boilerplate, the sketch's log2 size, and the relative half-width of "near".
MIN_SITES, SKETCH, MARGIN = 8, 10, 0.15


def _hash(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _solid(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\x0b\x0c\r", "")) != ""


def _lines(docs: DataFrame, site: str, text: str) -> DataFrame:
    """(h, site) of each solid line of each row."""
    line = F.explode(F.split(F.col(text), "\n"))
    return docs.select(F.coalesce(F.col(site).cast("string"), F.lit("\x00")).alias("site"), line.alias("line")).where(_solid(F.col("line"))).select(_hash(F.col("line")).alias("h"), "site")


def boilerplate(docs: DataFrame, site: str = "source", text: str = "text", min_sites: int = MIN_SITES, sketch: int = SKETCH, margin: float = MARGIN) -> DataFrame:
    """(h) of the lines found on `min_sites` distinct sites or more."""
    lines = _lines(docs, site, text)
    # several distinct sites need as many occurrences: counts are cheap, sketches are kept for the rest
    often = lines.groupBy("h").agg(F.count("*").alias("n"), F.min("site").alias("p"), F.max("site").alias("q")).where((F.col("n") >= min_sites) & (F.col("p") < F.col("q") if min_sites > 1 else F.lit(True))).select("h")
    some = lines.distinct().join(often, "h", "left_semi")  # a line meets its test once for each site, however often it occurs
    spread = some.groupBy("h").agg(F.hll_sketch_agg("site", sketch).alias("s")).select("h", F.hll_sketch_estimate("s").alias("sites"))
    sure = spread.where(F.col("sites") > min_sites * (1 + margin)).select("h")
    near = spread.where((F.col("sites") <= min_sites * (1 + margin)) & (F.col("sites") >= min_sites * (1 - margin))).select("h")
    exact = some.join(near, "h", "left_semi").groupBy("h").agg(F.count_distinct("site").alias("sites")).where(F.col("sites") >= min_sites).select("h")
    return sure.unionByName(exact)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", site: str = "source", text: str = "text", min_sites: int = MIN_SITES, sketch: int = SKETCH, margin: float = MARGIN, max_removed: float | None = 1.0) -> DataFrame:
    """The rows with their text freed of boilerplate lines, and n_lines, n_removed.

    All boilerplate goes. A caller may exempt documents of which it would be more than the share `max_removed` of the
    characters, or with None those that have no line of their own, as copies for document deduplication to judge.
    """
    found = boilerplate(docs, site, text, min_sites, sketch, margin)
    # the row is one column, so that no name of its own can clash
    d = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != text]).alias("r"), docs[id_col].alias("k"), docs[text].cast("string").alias("t")).withColumn("x", F.xxhash64("t"))
    mine = d.select("k", "x", F.posexplode(F.split("t", "\n")).alias("at", "line")).where(_solid(F.col("line"))).select("k", "x", "at", _hash(F.col("line")).alias("h"))
    bad = mine.join(found, "h", "left_semi").groupBy("k", "x").agg(F.array_sort(F.collect_set("at")).alias("bad")).select(F.col("k").alias("bk"), F.col("x").alias("bx"), "bad")
    d = d.join(bad, F.col("k").eqNullSafe(F.col("bk")) & (F.col("x") == F.col("bx")), "left")
    lines = F.split("t", "\n")
    # the stretches between removed lines, each a slice of the lines, which are split once
    ends = F.concat(F.col("bad"), F.array(F.size(lines)))
    between = lambda w: F.flatten(F.zip_with(F.concat(F.array(F.lit(-1)), "bad"), ends, lambda a, b: F.slice(w, a + 2, b - a - 1)))
    kept = F.get(F.transform(F.array(lines), between), F.lit(0))
    d = d.select("r", "t", F.when(F.col("t").isNull(), F.lit(0)).otherwise(F.size(lines)).alias("n"), F.when(F.col("bad").isNotNull(), kept).alias("kept"))
    joined = F.array_join("kept", "\n")
    if max_removed is None:
        left = F.exists("kept", _solid)
    else:
        left = F.length("t") - F.length(joined) <= F.lit(max_removed) * F.length("t")
    changed = F.col("kept").isNotNull() & left
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_removed")]
    return d.select(
        *[F.when(changed, joined).otherwise(F.col("t")).alias(c) if c == text else F.col("r")[c].alias(c) for c in own],
        F.col("n").cast("long").alias("n_lines"),
        F.when(changed, F.col("n") - F.size("kept")).otherwise(F.lit(0)).cast("long").alias("n_removed"),
    )
