"""A corpus pipeline over `documents`: quality rules, line dedup, near duplicates, mixing, encoding.

Every stage takes (spark, docs, sf_dir), with all that its predecessor kept, and returns a frame that is
written as Parquet and read again as the next one's docs. All but the last return the columns of documents;
other columns, whatever their names, are left out. An empty table gives an empty result at every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemodex.llm import bpe, lines, mixing, near, quality
from mnemodex.llm.common import materialize
from mnemodex.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _counted(docs: DataFrame) -> DataFrame:
    return docs.select(*COLUMNS).withColumn("n_chars", F.length("text").cast("long"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules keep, unchanged.

    Null and empty texts have no words and go; each row is judged alone, so repeated rows, rows without an id and rows of one id
    stay or go by their own texts; a text of any length is measured whole.
    """
    return quality.keep_rows(docs.select(*COLUMNS))


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the boilerplate lines that are spread over many sources; one of no other lines stays whole.

    A null text stays null (n_chars null); a null source is a source; repeated rows are treated alike, and rows of one id
    by their own texts.
    """
    return _counted(lines.dedup_lines(docs, max_removed=None))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id, of each group of near duplicates; a row without an id is kept if its group has no other.

    Rows that repeat an id and its text are one document. Texts without words (null, empty) are no one's copies and stay,
    each if without an id; rows of one id with different texts are different documents; ties are decided by the text's hash.
    """
    return near.near_kept(docs.select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: for each document and pass the words that its slots take, in order.

    Documents without words (null, empty) have nothing to take; every row has its own words, so rows that repeat others take
    part like others and none gives more than twice its words; a null source is a source, the last.
    """
    return _counted(mixing.mixed_documents(docs, COLUMNS))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each row's whole text, with digests of ids and decoded bytes; null and empty texts have no ids."""
    coded = bpe.bpe(docs, vocabulary())
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", lines_stage),
    ("n-gram Jaccard join", near_stage),
    ("mixing sources to target weights", mixing_stage),
    ("byte-level BPE", encoding_stage),
]

#: SQL cannot express the prefix-tree components and the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
