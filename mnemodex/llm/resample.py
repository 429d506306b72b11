r"""Operator 11, importance resampling toward a target: documents are drawn by how like the target their n-grams are.

1. Position table: `posexplode` gives each document's words with their places, and window `lead()` in a document puts the next
   words beside each, whose concatenation is the feature of each order.
2. A feature's bucket is the CRC-32 of its UTF-8 bytes modulo `buckets`. Grouped, all documents give a count for each bucket,
   partial before its shuffle, and so do the target's texts.
3. A bucket's gain is the floored logarithm, in thousandths, of its smoothed share in the target over that in the documents.
   The table of gains has `buckets` rows; it is written, and joined to the position table (broadcast up to 2**20 rows).
4. A document's weight is the sum of its features' gains. A Gumbel number by the hash of its id is added, and the highest
   scores are the draw: an exact sample without replacement. Places come from ranges of equal depth (`number_rows`).

Rows are numbered and written first, so a document's words meet again in one row of the shuffle after a partial sum where they
were read, whatever its id; with orders above one the window takes the words of one document, never those of a key.

Defined cases: a null or empty text has no features and weight 0 and is not drawn; each row counts for itself, so repeated
rows draw the same number and are placed one after another; a null id draws as the empty string and comes after other ids of its
score; extra columns are left out, whatever their names; texts of any length are taken whole; an empty table gives an
empty result, and an empty target (or one without words) leaves every bucket its smoothed share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import number_rows
from .common import materialize

#: Fixed value: what stands between words, once A-Z are lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Gains up to this many rows are broadcast.
BROADCAST_ROWS = 1 << 20


def words(text: Column) -> Column:
    """Words of a text, as written."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def lower_ascii(word: Column) -> Column:
    """A-Z as a-z, and nothing else; a word of ASCII alone takes the fast way."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(word, _UPPER, _UPPER.lower()))


def position_table(docs: DataFrame, first: int = 1, last: int = 1) -> DataFrame:
    """(number, doc_id, pos, head, feature) of docs(number, doc_id, text): the runs of `first` to `last` words from each place.

    head marks one row a place, for counting words; a document without words is one row whose feature is null.
    """
    t = docs.select("number", "doc_id", F.posexplode_outer(words(F.col("text"))).alias("pos", "word"))
    t = t.withColumn("word", lower_ascii(F.col("word")))
    if last == 1:
        return t.select("number", "doc_id", "pos", F.col("word").isNotNull().alias("head"), F.col("word").alias("feature"))
    here = Window.partitionBy("number").orderBy("pos")
    ahead = [F.lead("word", k).over(here).alias(f"word{k}") for k in range(1, last)]
    t = t.select("number", "doc_id", "pos", "word", *ahead)
    names = ["word", *[f"word{k}" for k in range(1, last)]]
    runs = F.array(*[F.when(F.col(names[k - 1]).isNotNull(), F.concat_ws(" ", *names[:k])) for k in range(first, last + 1)])
    t = t.select("number", "doc_id", "pos", "word", F.posexplode(runs).alias("order", "feature"))
    return t.select("number", "doc_id", "pos", (F.col("word").isNotNull() & (F.col("order") == 0)).alias("head"), "feature").where("head or feature is not null or pos is null and not head")


def bucketed(table: DataFrame, buckets: int) -> DataFrame:
    return table.withColumn("bucket", F.crc32(F.col("feature").cast("binary")) % buckets)


def gains(source: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain) of every bucket, from two frames with a column bucket (null: no feature)."""
    count = lambda d, name: d.where("bucket is not null").groupBy("bucket").agg(F.count("*").alias(name))
    spark = source.sparkSession
    b = spark.range(0, buckets, 1, 1).select(F.col("id").alias("bucket")).join(count(source, "s"), "bucket", "left").join(count(target, "t"), "bucket", "left")
    b = materialize(b.select("bucket", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t")))
    total = b.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    x = lambda c: F.col(c).cast("double") + 1.0
    ratio = x("t") * float(total.s + buckets) / (x("s") * float(total.t + buckets))
    return materialize(b.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain")))


def gumbel(doc_id: Column, seed: str) -> Column:
    """A Gumbel number in thousandths by the hash of seed and id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", first: int = 1, last: int = 1,
             buckets: int = 10_000, min_words: int = 20, percent: int = 10, seed: str = "2024") -> DataFrame:
    """One row per document: doc_id, n_words, n_features, weight, score, rank (1, 2, 3... of the drawn, null for others).

    Drawn are `percent` in a hundred of the documents of `min_words` words or more, rounded down.
    """
    number = F.monotonically_increasing_id().alias("number")
    d = materialize(docs.select(number, docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")))
    t = target.select(number, F.lit(None).cast("long").alias("doc_id"), target[target_col].cast("string").alias("text"))
    t = materialize(t) if last > 1 else t
    table = bucketed(position_table(d, first, last), buckets)
    gain = gains(table, bucketed(position_table(t, first, last), buckets), buckets)
    gain = F.broadcast(gain) if buckets <= BROADCAST_ROWS else gain
    summed = table.join(gain, "bucket", "left").groupBy("number", "doc_id").agg(F.count_if("head").alias("n_words"), F.count("feature").alias("n_features"), F.coalesce(F.sum("gain"), F.lit(0)).alias("weight"))
    scored = materialize(summed.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score")))
    fit = F.col("n_words") >= min_words
    drawn = scored.where(fit).count() * percent // 100
    placed = number_rows(scored, fit.desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), name="place")
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", F.when(fit & (F.col("place") < drawn), F.col("place") + 1).alias("rank"))
