"""The corpus pipeline: quality filter, near-duplicate removal, benchmark decontamination, redaction of personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on every row that its predecessor kept; all but the last return the columns of
documents. Between stages, run() writes Parquet to the shared folder and reads it again, so a lost executor costs one stage at most.

Defined results: rows without doc_id get a key of their own at the near-duplicate stage and are compared like all others; see the operators for null, empty and
repeated texts. Extra columns of documents are carried along until packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontam, jaccard, packing, pii, quality
from quarry.llm.common import spool, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality.keep_good(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of linked rows, the one with the smallest doc_id stays, or any one where none has a doc_id; rows without words stay.

    Rows are told apart by a written key, so that rows that share a doc_id, or have none, are rows of their own.
    """
    first = "_row_of_" + "_".join(docs.columns)  # no column of docs has this name
    rows = spool(docs.withColumn(first, F.monotonically_increasing_id()), "rows")
    keys = rows.select(F.col(first).alias("doc_id"), F.col("text"))
    linked = jaccard.link_classes(keys).select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_class"))
    ids = rows.select(F.col(first).alias("_row"), F.col("doc_id").alias("_id"))
    best = linked.join(ids, "_row").groupBy("_class").agg(F.min(F.struct(F.col("_id").isNull().alias("no"), "_id", "_row")).alias("b")).select(F.col("b._row").alias("_keep"))
    return rows.join(best, F.col(first) == F.col("_keep"), "left_semi").drop(first)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every document stays."""
    return pii.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [("quality", quality_stage), ("near_duplicates", near_duplicate_stage), ("decontamination", decontamination_stage), ("personal_data", personal_data_stage), ("packing", packing_stage)]

#: SQL can express neither the classifier's training nor tokenisation; the tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = spool(docs, name)
    return docs
