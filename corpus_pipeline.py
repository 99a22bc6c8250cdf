"""Documents to packed training sequences: quality, near copies, benchmark leaks, personal data, packing.

Every stage takes the rows that its predecessor kept and returns the columns of documents, the last one packed pieces.
Each stage is written as Parquet and read again by the next.  Rows with a null doc_id pass the grouping of near copies; a
null text is an empty document to quality and packing, and never a copy or a leak; of rows that share a doc_id, one stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxmill.llm._store import cut
from voxmill.llm.decontaminate import find_leaks
from voxmill.llm.jaccard import link_documents
from voxmill.llm.packing import pack_documents
from voxmill.llm.pii import pseudonymise
from voxmill.llm.quality import score_documents
from voxmill.llm.queries import pii_key, vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score_documents(docs, labels, carried=True).where("kept").select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; of rows that share its id, that with the least text."""
    stay = link_documents(docs).where("doc_id = component_id").select("doc_id").distinct()
    others = [c for c in COLUMNS if c not in ("doc_id", "text")]
    known = docs.where("doc_id is not null").join(stay, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *others)).alias("row"))
    return known.select("doc_id", "row.*").select(*COLUMNS).union(docs.where("doc_id is null").select(*COLUMNS))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.  A leak is a matter of the text, so its digest is the key."""
    keyed = docs.select(*COLUMNS).withColumn("key", F.xxhash64("text"))
    found = find_leaks(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "key")
    leaks = cut(found.select(F.col("doc_id").alias("key")).distinct(), "leaks")
    return keyed.join(leaks, "key", "left_anti").select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data."""
    return pseudonymise(docs, pii_key(spark)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their tokens and their places in sequences."""
    return pack_documents(docs, vocabulary())


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark_leaks),
    ("PII", personal_data),
    ("best-fit packing", packing),
]
# Models, keyed digests and a local search cannot be said in SQL; tests/llm/test_pipeline.py holds the stages against brute
# force where one exists, and the classifier against held-out labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
