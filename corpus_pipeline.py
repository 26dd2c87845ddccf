"""The corpus pipeline: five operators in a row, each on what the one before has kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each result as Parquet in the shared folder and reads it again for the next.
All stages but the last return the columns of ``documents``.

Rows are judged one by one, whatever their ids.  Where a stage needs to know a row
again it goes by the SHA-256 of all its columns, or by a number that is written with
the row; decontamination and mixing pass rows through.  Equal rows have equal
verdicts; the near-duplicate stage keeps one of them.  Null and empty texts go in the
first stage, and a null language is a language; empty tables pass all stages; columns
beyond those of ``documents`` are left behind.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tieout.llm import contamination, jaccard, mixing, perplexity, runtime, substring

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _ready(docs: DataFrame) -> DataFrame:
    runtime.ship(docs.sparkSession)
    return docs.select(*COLUMNS)


def _digest():
    return F.sha2(F.to_json(F.struct(*COLUMNS), {"ignoreNullFields": "false"}), 256)


def _keyed(docs: DataFrame) -> DataFrame:
    """Adds 120 bits of the row's digest, in two numbers."""
    half = lambda at: F.conv(F.substring(_digest(), at, 15), 16, 10).cast("bigint")
    return _ready(docs).withColumns({"row": half(1), "twin": half(16)})


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier keeps."""
    docs = _keyed(docs)
    judged = perplexity.classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), carry=("row", "twin"))
    return docs.join(judged.where("kept").select("row", "twin").distinct(), ["row", "twin"], "left_semi").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near duplicates: the one with the least id (without an id only if no row has one).

    Rows are made distinct first, and written with a number of their own.
    """
    distinct = _ready(docs).withColumn("sha", _digest()).dropDuplicates(["sha"]).withColumn("number", F.monotonically_increasing_id())
    path = f"{_folder(spark)}/rows"
    distinct.write.parquet(path)
    numbered = spark.read.parquet(path)
    classes = jaccard.join(numbered.select(F.col("number").alias("doc_id"), "text")).select(F.col("doc_id").alias("number"), "class_id")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha", "number")).alias("first")
    kept = classes.join(numbered.select("number", "doc_id", "sha"), "number").groupBy("class_id").agg(first).select("first.number")
    return numbered.join(kept, "number", "left_semi").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 13 words and more that a document with a smaller id has; emptied documents go."""
    docs = _ready(docs)
    cut = substring.remove_repeats(docs, carry=("lang", "source"))
    return cut.where("n_words = 0 or n_removed < n_words").select("doc_id", "text", "lang", "source", F.length("text").cast("bigint").alias("n_chars")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark passage."""
    found = contamination.find(_ready(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=tuple(COLUMNS[1:]))
    return found.where("not contaminated").select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: a row for each copy of a document, with its source's target."""
    return mixing.emitted(mixing.mix(_ready(docs), carry=("text", "lang", "n_chars")))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("substring dedup", repeated_passages),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
]

#: Perplexities and similarities of whole tables are beyond SQL; tests hold each stage, and run(), against brute force.
ORACLE_SQL = None


def _folder(spark: SparkSession) -> str:
    runtime.shared_folder(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/pipeline-{uuid.uuid4().hex}"


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage has read is deleted once its result is written."""
    folder = _folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            _delete(spark, f"{folder}/{i - 1}")
    return docs
