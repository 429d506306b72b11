"""Operator 10, mixing sources to target weights. DataFrame functions only.

1. Each source's documents are packed, in the order of a hash of doc_id and text, into blocks of a fixed number of words: `block`, or
   fewer where the source or its target has less than 100 such blocks, so that whole blocks come near every target.
2. The mix is a sequence of slots in output shards. Every slot draws its source by one hashed uniform number, so the
   source counts of a shard are a multinomial draw (`shard_counts`). Of a source that was drawn more often than its target
   has blocks the surplus slots, which a hash picks, go to the sources that were drawn too seldom: a few in ten thousand,
   and then every source has its target's number of slots.
3. A source's slots, in the order of a hash, are its passes over its blocks, one after another; each pass maps them through
   its own pseudorandom permutation of block indices (the published swap-or-not shuffle), and slots join blocks by
   (source, index): keys of which each has at most two slots, so a hot source loads no single task.

Running counts are two-level sums: within buckets of a source, and over the few buckets of each source. A bucket is a
range of a hash, and their number follows the rows, so the result is the same for any number of buckets and on any
cluster. Tables with a row for each source (targets) are windowed by one task; nothing is broadcast by a hint.

Defined cases: a null text has no words and takes part with size 0; a null source is a source, the last;
every row has a number, by which it is packed and its words are taken, so rows that repeat others take
part like others (`taken` shares out what equal rows take among them); sources of no words have target 0; a source whose
target is less than half a word gets no slot; extra columns are left out. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: A word, and the characters between words.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = " \t\n\x0b\x0c\r"
#: Rows of a bucket in which running counts are taken, cells of a stretch, slots of a cell, rounds of a permutation.
BUCKET_ROWS, STRETCH, CELL, ROUNDS = 4096, 65536, 64, 16
#: Blocks that a source and its target have at least, unless a block is a word.
LEAST_BLOCKS = 100


def n_words(text: Column) -> Column:
    """Words of a text: split at single characters of white space, without the empty pieces."""
    spaced = F.coalesce(text, F.lit(""))
    for c in SPACE[1:]:  # replaces bytes, where translate would look up each character
        spaced = F.replace(spaced, F.lit(c), F.lit(SPACE[0]))
    return F.size(F.array_remove(F.split(spaced, SPACE[0]), "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) from (source, source_size): weighted shares, stopped at `most` times
    the size, the excess shared again by weight until none is above.

    The fixed point has a level L: target = min(most * size, weight * L). Ordered by the level at which
    each source stops, running sums give L without iterating; a row per source, so the table is small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.partitionBy(F.lit(0))
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    t = sizes.select("source", "source_size", w.cast("double").alias("weight"), (F.col("source_size") * F.lit(most)).alias("cap"))
    t = t.withColumn("total", F.sum("source_size").over(every) * F.lit(share))
    t = t.withColumn("stop", F.col("cap") / F.col("weight"))
    before = Window.orderBy("stop", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("stop", F.col("source").asc_nulls_last()).rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    t = t.withColumn("level", level)
    # the first source that does not stop below its level fixes it for all after it
    found = F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "level"))).over(every)
    return t.select("source", "source_size", F.when(found.isNull() | (F.col("stop") <= found["level"]), F.col("cap")).otherwise(F.col("weight") * found["level"]).alias("target"))


def round_keys(n: Column, key: Column) -> Column:
    """What `permute` adds in each round, and the round."""
    return F.array(*[F.struct(F.pmod(F.xxhash64(key, F.lit(r)), n).alias("add"), F.lit(r).alias("round")) for r in range(ROUNDS)])


def permute(x: Column, n: Column, key: Column, keys: Column | None = None) -> Column:
    """A permutation of 0..n-1 keyed by a number: in each round a hash of the greater of x and its mirror image decides which of both goes on.

    keys: `round_keys` of n and key, as a column, so that generated code makes them once a row.
    """
    keys = round_keys(n, key) if keys is None else keys

    def step(a: Column, k: Column) -> Column:
        mirror = F.pmod(k["add"] - a, n)
        return F.when(F.xxhash64(key, F.greatest(a, mirror), k["round"]).bitwiseAND(F.lit(1)) == 1, mirror).otherwise(a)

    # never null; said so, as a join would else test it for null and compute it twice
    return F.coalesce(F.aggregate(keys, x.cast("long"), step), F.lit(0).cast("long"))


def _bucket(place: Column, spread: int) -> Column:
    """Of a hash of 63 bits, the bucket by its upper 31: buckets are in the order of the hash."""
    return F.shiftright(F.shiftright(place, 32) * F.lit(spread).cast("long"), 31)


def numbered(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """doc_id, source, size, row (the text's hash), number (the row's own), and own: a struct of `columns`. Written, so that numbers stay."""
    d = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), n_words(F.col("text").cast("string")).alias("size"),
        F.xxhash64("text").alias("row"), F.monotonically_increasing_id().alias("number"), *([F.struct(*columns).alias("own")] if columns else []),
    )
    return materialize(d)  # sizes are counted once


def pack(docs: DataFrame, spread: int | None = None) -> DataFrame:
    """(source, doc_id, row, number, size, start): each document's first word's place among its source's words; a column words stays.

    docs: source, doc_id, row and number (tell rows of equal ids apart), size. spread: buckets of a source; the result does not depend on it.
    """
    spread = spread or max(8, -(-docs.count() // BUCKET_ROWS))
    d = docs.withColumn("place", F.shiftrightunsigned(F.xxhash64("doc_id", "row"), 1))
    d = d.withColumn("bucket", _bucket(F.col("place"), spread))
    sums = d.groupBy("source", "bucket").agg(F.sum("size").alias("s"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("src"), F.col("bucket").alias("bkt"), F.coalesce(F.sum("s").over(ahead), F.lit(0)).alias("base"))
    inner = Window.partitionBy("source", "bucket").orderBy("place", "doc_id", "row", "number").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    d = d.join(sums, d.source.eqNullSafe(sums.src) & (d.bucket == sums.bkt))
    return d.select("source", "doc_id", "row", "number", "size", *(["words"] if "words" in docs.columns else []), (F.col("base") + F.col("inner")).alias("start"))


def block_words(block: int) -> Column:
    """The words of a block of a source, by its source_size and target."""
    least = F.floor(F.least(F.col("source_size").cast("double"), F.col("target")) / LEAST_BLOCKS)
    return F.greatest(F.lit(1), F.least(F.lit(block), least)).cast("long")


def quotas(targets: DataFrame, block: int) -> DataFrame:
    """(src, blocks, quota, lo, hi) of targets(source, source_size, target): the slots that come nearest to each target, as blocks
    of a source hold source_size / blocks words each, laid end to end."""
    up = Window.orderBy(F.col("src").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    q = targets.where("target > 0").select(F.col("source").alias("src"), "source_size", "target", F.ceil(F.col("source_size") / block_words(block)).cast("long").alias("blocks"))
    q = q.withColumn("quota", F.round(F.col("target") * F.col("blocks") / F.col("source_size")).cast("long")).where("quota > 0")
    return q.withColumn("hi", F.sum("quota").over(up)).withColumn("lo", F.col("hi") - F.col("quota")).select("src", "blocks", "quota", "lo", "hi")


def draw(quota: DataFrame, total: int, shard_slots: int, seed: int) -> DataFrame:
    """(id, shard, slot, src, blocks, quota): every slot's source, drawn on its own with probability quota / total."""
    spark = quota.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // 1_000_000))
    u = F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(total))
    slots = spark.range(0, total, 1, parts).select("id", F.floor(F.col("id") / shard_slots).alias("shard"), (F.col("id") % shard_slots).alias("slot"), u.alias("u")).withColumn("cell", F.floor(F.col("u") / CELL))
    # each source's part of the line in cells, so that a number finds its source by an equal key
    first, last = F.floor(F.col("lo") / CELL), F.floor((F.col("hi") - 1) / CELL)
    runs = quota.withColumn("run", F.explode(F.sequence(first, last, F.lit(STRETCH).cast("long")))).withColumn("last", last).repartition("src", "run")
    cells = runs.withColumn("cell", F.explode(F.sequence("run", F.least(F.col("last"), F.col("run") + STRETCH - 1)))).drop("run", "last")
    return slots.join(cells, "cell").where("u >= lo and u < hi").select("id", "shard", "slot", "src", "blocks", "quota")


def shard_counts(drawn: DataFrame) -> DataFrame:
    """(shard, src, n): the multinomial counts."""
    return drawn.groupBy("shard", "src").agg(F.count("*").alias("n"))


def settle(drawn: DataFrame, quota: DataFrame, total: int, seed: int) -> DataFrame:
    """(id, shard, slot, src, blocks, j): each source's slots numbered by a hash, 0 to its quota - 1; surplus slots are given to sources that lack some."""
    spread = max(8, -(-total // BUCKET_ROWS // 16))
    d = drawn.withColumn("place", F.shiftrightunsigned(F.xxhash64(F.lit(seed + 1), "id"), 1)).withColumn("bucket", _bucket(F.col("place"), spread))
    counts = d.groupBy("src", "bucket").agg(F.count("*").alias("n"))
    ahead = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(F.col("src").alias("own"), F.col("bucket").alias("bkt"), F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    inner = Window.partitionBy("src", "bucket").orderBy("place", "id")
    d = d.withColumn("inner", F.row_number().over(inner) - 1).join(base, F.col("src").eqNullSafe(F.col("own")) & (F.col("bucket") == F.col("bkt")))
    d = d.select("id", "shard", "slot", "src", "blocks", "quota", (F.col("base") + F.col("inner")).alias("j"))
    got = counts.groupBy(F.col("src").alias("own")).agg(F.sum("n").alias("n"))
    order = Window.orderBy(F.col("src").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    n = F.coalesce("n", F.lit(0))
    b = quota.join(got, F.col("src").eqNullSafe(F.col("own")), "left").select("src", "blocks", n.alias("n"), F.greatest(n - F.col("quota"), F.lit(0)).alias("over"), F.greatest(F.col("quota") - n, F.lit(0)).alias("under"))
    b = b.withColumns({"over_lo": F.coalesce(F.sum("over").over(order), F.lit(0)), "under_lo": F.coalesce(F.sum("under").over(order), F.lit(0))})
    spare = d.where("j >= quota").join(b.select(F.col("src").alias("own"), "over_lo"), F.col("src").eqNullSafe(F.col("own")))
    spare = spare.select("id", "shard", "slot", (F.col("over_lo") + F.col("j") - F.col("quota")).alias("r"))
    lack = b.where("under > 0").withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("under") - 1))).select((F.col("under_lo") + F.col("i")).alias("r"), "src", "blocks", (F.col("n") + F.col("i")).alias("j"))
    names = ["id", "shard", "slot", "src", "blocks", "j"]
    return d.where("j < quota").select(*names).unionByName(spare.join(lack, "r").select(*names))


def mix(docs: DataFrame, block: int = 64, shard_slots: int = 1024, seed: int = 7, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """(spans, sizes). spans: shard, slot, source, pass, doc_id, row, number, first, last (words of the document that the
    slot takes, 0-based, last exclusive). sizes: doc_id, row, number, source, size, source_size, target.

    docs: doc_id, source, text and anything else. No document is taken more than `most` times, a whole number, as a source
    has no more passes than its target allows.
    """
    return mix_numbered(numbered(docs), block, shard_slots, seed, weights, share, most)


def mix_numbered(docs: DataFrame, block: int = 64, shard_slots: int = 1024, seed: int = 7, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, DataFrame]:
    """`mix` of documents that `numbered` made."""
    d = docs.select("doc_id", "source", "size", "row", "number")
    t = materialize(targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most))
    own = t.select(F.col("source").alias("src"), "source_size", "target")
    sizes = d.join(own, d.source.eqNullSafe(own.src)).drop("src")
    quota = materialize(quotas(t, block))
    total = quota.agg(F.coalesce(F.max("hi"), F.lit(0))).first()[0]
    slots = settle(materialize(draw(quota, total, shard_slots, seed)), quota, total, seed) if total else None
    if slots is None:
        none = "shard long, slot long, source string, pass int, doc_id long, row long, number long, first long, last long"
        return docs.sparkSession.createDataFrame([], none), sizes
    turn = F.floor(F.col("j") / F.col("blocks"))
    # each step's columns are read more than once by the next one, so the planner keeps the steps apart
    slots = slots.withColumn("pass", turn).withColumn("key", F.xxhash64(F.lit(seed), "src", "pass")).withColumn("keys", round_keys(F.col("blocks"), F.col("key")))
    slots = slots.withColumn("block", permute(F.col("j") % F.col("blocks"), F.col("blocks"), F.col("key"), F.col("keys"))).drop("key", "keys")
    packed = pack(sizes.withColumn("words", block_words(block))).where("size > 0")
    words = F.col("words")
    pieces = packed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / words), F.floor((F.col("start") + F.col("size") - 1) / words))))
    pieces = pieces.withColumn("first", F.greatest(F.lit(0), F.col("block") * words - F.col("start"))).withColumn("last", F.least(F.col("size"), (F.col("block") + 1) * words - F.col("start")))
    # the planner cannot see how many rows the sequences make, so it is told not to broadcast them
    spans = slots.hint("merge").join(pieces, slots.src.eqNullSafe(pieces.source) & (slots.block == pieces.block))
    return spans.select("shard", "slot", "source", F.col("pass").cast("int").alias("pass"), "doc_id", "row", "number", "first", "last"), sizes


def taken(docs: DataFrame, **how) -> DataFrame:
    """Per row: doc_id, size, source_size, target, taken (words that the mix takes, repeats counted)."""
    spans, sizes = mix(docs, **how)
    own = ["doc_id", "row", "source"]
    used = spans.groupBy(*own).agg(F.sum(F.col("last") - F.col("first")).alias("sum"))
    rows = sizes.groupBy(*own, "size", "source_size", "target").agg(F.count("*").alias("n"))
    cond = [rows[c].eqNullSafe(used[c]) for c in own]
    out = rows.join(used, cond, "left").select(rows.doc_id, "size", "source_size", "target", F.coalesce(F.col("sum"), F.lit(0)).alias("sum"), "n")
    # identical rows share what was taken from them; the first ones get the remainder
    out = out.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n")))).withColumn("taken", F.floor(F.col("sum") / F.col("n")) + F.when(F.col("i") <= F.col("sum") % F.col("n"), 1).otherwise(0))
    return out.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, columns: list[str], **how) -> DataFrame:
    """The mix as documents: a row for each document and pass, its text the words taken in that pass, in order.

    White space before a taken word is kept, so a document taken whole keeps its text up to the end of its last word.
    """
    d = numbered(docs, columns)
    spans, _ = mix_numbered(d, **how)
    part = F.struct("first", "last")
    used = spans.groupBy("number", "pass").agg(F.array_sort(F.collect_list(part)).alias("spans_"), F.sum(F.col("last") - F.col("first")).alias("sum_")).withColumnRenamed("number", "number_")
    d = d.select("number", "size", "own").join(used, F.col("number") == F.col("number_")).select("own.*", "spans_", (F.col("sum_") == F.col("size")).alias("whole_"))
    words = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    # the words are bound once by the outer transform; as a column the optimizer would copy their extraction into every slice
    cut = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform("spans_", lambda s: F.slice(w, (s["first"] + 1).cast("int"), (s["last"] - s["first"]).cast("int")))), ""))
    # a pass's spans do not overlap, so one that takes as many words as there are takes them all
    text = F.when(F.col("whole_"), F.rtrim("text", F.lit(SPACE))).otherwise(F.get(cut, F.lit(0)))
    return d.withColumn("text", text).select(*columns)
