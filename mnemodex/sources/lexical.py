"""A lexical index on disk: postings in segments, with upserts, deletes, merging and BM25 from the asked terms alone.

A write adds a segment: postings (term, id, tf, dl), dealt into ranges of equal depth by bucket, term and id, so that a term that
a third of all records hold is spread over files, and sorted by term below a folder for each bucket of terms; and touched (id, dl),
a row for each record written or forgotten (dl 0: nothing to find). The newest segment that touches a record has its postings,
older ones are dead. A search reads the folders and row groups of its terms, and the touched ids of all segments but the first;
no text is read. The number of live records and of their terms stands in the commit log, brought forward by each write.

Merging writes one segment of the live postings and runs when later segments hold more than a quarter of the first one's
rows, so the ids that a search looks up stay few. Two writers at once both succeed: the later one adds up its figures again over the
other's commit. Readers keep the segments of the commit that they began with; files are never deleted.

Defined cases: a null text or one without terms makes a record that no search finds; of rows of one id in a write one counts, the last by
`order` where that is given; an id that is forgotten or written again leaves its old terms; an empty index answers nothing.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from .commits import CommitLog

BUCKETS = 64
#: Bytes of text, and postings, of a task that writes; there are at least as many tasks as the session's shuffle partitions.
TASK_BYTES, TASK_ROWS = 8 << 20, 1 << 20


class LexicalIndex:
    """The index below `root`, of ids of one Spark type."""

    def __init__(self, spark: SparkSession, root: str, id_type: str = "long"):
        self.spark, self.root = spark, root.rstrip("/")
        self.log = CommitLog(spark, self.root)
        self.touched_schema, self.postings_schema = f"id {id_type}, dl long", f"term string, id {id_type}, tf long, dl long, bucket int"

    # ---- reading

    def _touched(self, segments: list[dict]) -> DataFrame:
        """(id, gen, dl): the newest row of each id in these segments."""
        read = lambda s: self.spark.read.schema(self.touched_schema).parquet(f"{self.root}/{s['path']}/touched").withColumn("gen", F.lit(s["gen"]).cast("long"))
        if not segments:
            return self.spark.createDataFrame([], f"{self.touched_schema}, gen long")
        every = reduce(DataFrame.unionByName, map(read, segments))
        return every if len(segments) == 1 else every.groupBy("id").agg(F.max("gen").alias("gen"), F.max_by("dl", "gen").alias("dl"))

    def _postings(self, segments: list[dict], terms: list[str] | None = None) -> DataFrame:
        """Live postings, of the given terms or of all."""

        def read(s: dict) -> DataFrame:
            p = self.spark.read.schema(self.postings_schema).parquet(f"{self.root}/{s['path']}/postings")
            if terms is not None:
                p = p.where(F.col("bucket").isin(sorted({self._bucket_of(t) for t in terms})) & F.col("term").isin(sorted(terms)))
            return p.select("term", "id", "tf", "dl", F.lit(s["gen"]).cast("long").alias("gen"))

        if not segments:
            return self.spark.createDataFrame([], self.postings_schema).select("term", "id", "tf", "dl")
        every = reduce(DataFrame.unionByName, map(read, segments))
        if len(segments) > 1:
            later = self._touched(segments[1:]).select("id", F.col("gen").alias("newest"))
            every = every.join(later, "id", "left").where(F.col("gen") >= F.coalesce("newest", F.lit(-1)))
        return every.select("term", "id", "tf", "dl")

    def _bucket_of(self, term: str) -> int:
        import zlib

        return zlib.crc32(term.encode()) % BUCKETS

    def count(self) -> int:
        """Records that a search can find."""
        return self.log.newest()[1].get("n", 0)

    def scores(self, query: list[str]) -> DataFrame:
        """(id, score) of records with a query term, as `retrieval.bm25_scores` of the live texts gives them."""
        from ..operators.retrieval import bm25_of_terms

        entry, want = self.log.newest()[1], sorted(set(query))
        p = self._postings(entry.get("segments", []) if want else [], want)
        f = [F.coalesce(F.max(F.when(F.col("term") == w, F.col("tf"))), F.lit(0)).alias(f"f{i}") for i, w in enumerate(want)]
        t = p.groupBy("id").agg(F.max("dl").alias("dl"), *f)
        n = entry.get("n", 0)
        return bm25_of_terms(t, query, F.lit(n), F.lit(entry.get("terms", 0) / n if n else 1.0))

    # ---- writing

    def put(self, texts: DataFrame, order: str | None = None) -> None:
        """Write texts(id, text); records that are there lose their old terms."""
        one = F.max_by("text", order) if order else F.first("text")
        # a task counts the terms of all its records at once, so it is dealt a bounded part of the texts
        size = texts.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
        texts = texts.repartition(self._parts(size, TASK_BYTES), "id").groupBy("id").agg(F.coalesce(one, F.lit("")).alias("text"))
        words = texts.select("id", T.terms(F.col("text")).alias("terms"))
        words = words.select("id", F.size("terms").cast("long").alias("dl"), F.explode_outer("terms").alias("term"))
        counted = words.groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
        name = f"seg-{uuid.uuid4().hex}"
        # one file set holds both: a record without terms has a row whose term is null
        staged = f"{self.root}/staged-{name}"
        counted.write.parquet(staged)
        counted = self.spark.read.parquet(staged)
        self._write(name, counted.where("term is not null"), counted.select("id", "dl").distinct(), counted.count())
        self._add(name)

    def forget(self, ids: DataFrame) -> None:
        """Take records(id) out of every search."""
        name = f"seg-{uuid.uuid4().hex}"
        self._write(name, None, ids.select("id", F.lit(0).cast("long").alias("dl")).distinct())
        self._add(name)

    def _parts(self, size: int, most: int) -> int:
        return max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-size // most))

    def _write(self, name: str, postings: DataFrame | None, touched: DataFrame, rows: int = 0) -> None:
        """A segment's files; `postings` are about `rows`."""
        touched.write.option("compression", "zstd").parquet(f"{self.root}/{name}/touched")
        p = postings if postings is not None else self.spark.createDataFrame([], self.postings_schema)
        p = p.select("term", "id", "tf", "dl", (F.crc32(F.col("term").cast("binary")) % BUCKETS).cast("int").alias("bucket"))
        p = p.repartitionByRange(self._parts(rows, TASK_ROWS), "bucket", "term", "id").sortWithinPartitions("bucket", "term", "id")
        p.write.option("compression", "zstd").option("parquet.block.size", 8 << 20).partitionBy("bucket").parquet(f"{self.root}/{name}/postings")

    def _add(self, name: str) -> None:
        """Commit a segment; the figures change by what its records were and are."""
        new = self.spark.read.schema(self.touched_schema).parquet(f"{self.root}/{name}/touched")
        rows, n, terms = new.agg(F.count("*"), F.count_if(F.col("dl") > 0), F.coalesce(F.sum("dl"), F.lit(0))).first()

        def change(entry: dict) -> dict:
            segments = entry.get("segments", [])
            was = self._touched(segments).join(new.select("id"), "id", "left_semi").agg(F.count_if(F.col("dl") > 0), F.coalesce(F.sum("dl"), F.lit(0))).first() if segments else (0, 0)
            gen = entry.get("gen", 0) + 1
            return {"gen": gen, "n": entry.get("n", 0) + n - was[0], "terms": entry.get("terms", 0) + terms - was[1], "segments": [*segments, {"path": name, "gen": gen, "rows": rows}]}

        entry = self.log.update(change)
        first, *later = entry["segments"]
        if sum(s["rows"] for s in later) > max(C.COMPACT_RATIO * first["rows"], 1):
            self.merge()

    def merge(self) -> None:
        """One segment of what is live; segments that come meanwhile stay behind it."""
        entry = self.log.newest()[1]
        old = entry.get("segments", [])
        if len(old) < 2:
            return
        name = f"seg-{uuid.uuid4().hex}"
        live = self._touched(old).where("dl > 0").select("id", "dl")
        written = sum(self.spark.read.schema(self.postings_schema).parquet(f"{self.root}/{s['path']}/postings").count() for s in old)
        self._write(name, self._postings(old), live, written)
        rows = self.spark.read.schema(self.touched_schema).parquet(f"{self.root}/{name}/touched").count()
        paths = [s["path"] for s in old]

        def change(now: dict) -> dict:
            if [s["path"] for s in now["segments"][: len(paths)]] != paths:
                return now  # another merge was first
            return {**now, "segments": [{"path": name, "gen": old[-1]["gen"], "rows": rows}, *now["segments"][len(paths) :]]}

        self.log.update(change)
