"""From raw documents to packed sequences: the stages in order, each on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the columns of documents, extra
ones included. Null and empty texts are scored like any other text by the first stage; those it keeps pass the middle
stages untouched and are packed as their end id alone. Empty tables give empty results. Rows that share a doc_id pass
or go together in the stages that filter by doc_id; equal ones are one document to line_dedup and near_duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from crosspanel.llm import contamination, lines, minmax, packing, quality
from crosspanel.llm.shared import settle


#: Rows that travel to a Python worker at once: texts are some kilobytes, and the buffers of a batch stay with executors
#: and workers from stage to stage.
ARROW_ROWS = 2000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Fitted on labelled rows of ``docs``; what it predicts as 0 goes."""
    small_batches(spark)
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that repeat an earlier run are cut; a document with nothing but such lines goes."""
    small_batches(spark)
    return lines.without_repeats(docs, drop_emptied=True)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 or more the smallest doc_id stays."""
    small_batches(spark)
    return minmax.keep_one(docs, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    small_batches(spark)
    return contamination.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their sequences."""
    small_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing_stage),
]
#: Not expressible in SQL: the classifier is trained and the packing is fitted; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
