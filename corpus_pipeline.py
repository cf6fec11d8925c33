"""The corpus pipeline: documents in, packed training sequences out.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that
is written as Parquet and read again as the next one's docs.  All but the last return the columns
of documents, with n_chars following the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlens.llm import line_dedup, packing, quality, simhash_dedup, suffix_dedup
from marketlens.llm.common import documents, stored, tuned
from marketlens.llm.queries import END_ID, WORD_BPE


def _recounted(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of ``like``, with n_chars counted anew."""
    kind = like.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.char_length(F.coalesce("text", F.lit(""))).cast(kind)).select(*like.columns)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps."""
    tuned(spark)
    weights = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, weights, with_row=True)


def fuzzy_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that an earlier line resembles."""
    tuned(spark)
    return _recounted(line_dedup.deduplicated(docs, counts=False), docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints."""
    tuned(spark)
    return simhash_dedup.representatives(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings that occur elsewhere."""
    tuned(spark)
    return _recounted(suffix_dedup.removed(docs), docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in the training sequences."""
    tuned(spark)
    return packing.pack(packing.pieces(docs, WORD_BPE, END_ID)).withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", fuzzy_lines),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("packing", pack_sequences),
]

# Co-training, XXH64 votes and token ids have no SQL form; tests/llm holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
