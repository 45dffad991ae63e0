"""The corpus pipeline: documents to token ids in five stages, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from stintline.llm import bpe, line_dedup, mixing, quality, similar
from stintline.llm.common import read, shared_folder

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base counts or the likelihood ratio go; so do null and short texts. Repeated rows share one verdict."""
    return quality.keep_good(docs, read(spark, sf_dir, "labels"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that too many pages of a source share go; ``n_chars`` follows the text. Rows without a source or a text stay as they are."""
    from pyspark.sql import functions as F

    kept = line_dedup.drop_boilerplate(docs).drop("n_lines_dropped")
    return kept.withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (SimHash over five-word shingles, confirmed at a similarity of 0.8 or more) the document with the least id stays.

    Null and empty texts are copies of each other; of rows with one id the first by text stays.
    """
    return similar.keep_first(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in the order of the mixed stream; a null source is a source of its own."""
    return mixing.in_order(mixing.mix(docs)).select(*docs.columns)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and ``mix_pos``, its place in the mixed stream; rows and part files follow that order.

    Reading a table back does not keep the order of its rows, so the place is worked out again, as the stage before did. A null
    text has no tokens.
    """
    lines, pattern = bpe.public_vocabulary()
    placed = mixing.in_order(mixing.mix(docs)).select(*docs.columns, "mix_pos")
    return bpe.encode(placed, lines, pattern, decoded=False)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", drop_lines),
    ("simhash near-dedup", one_of_each),
    ("mixing", mix_sources),
    ("byte-level bpe", tokenize),
]

#: Hashed n-grams, fingerprints and token ids cannot be expressed in SQL; the tests compare each stage with a brute-force version.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    """Through Hadoop's file system, so any store that Spark reads will do."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; an empty table gives an empty result.

    The tables between the stages lie in the shared folder, each until its successor is written; the last is the result's.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{folder}/{name.replace(' ', '_')}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before is not None:
            _delete(spark, before)
        before = path
    return docs
