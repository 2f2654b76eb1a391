"""A training corpus from the documents table: five stages of the operators in quarry.llm.

Each stage takes (spark, docs, sf_dir), docs being what the stage before it kept, and returns a frame
that is written as Parquet and read again for the next. All but the last return docs's own columns.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, jaccard_join, pfair, secrets, site_quality
from quarry.llm.queries import quality_labels
from quarry.session import checkpointed, shared_dir, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose posterior quality is below one half."""
    return site_quality.good_documents(docs, quality_labels(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each class of near duplicates a document of the least id; of rows that repeat an id and
    its text, one. Rows without an id stay."""
    found = jaccard_join.near_duplicates(docs)
    told = checkpointed(found.groupBy("id", "text_hash").agg(F.max(F.col("component") != F.col("id")).alias("spare"), F.count("*").alias("n")).where("id is not null"))
    text_hash = F.xxhash64(docs["text"])

    def rows(held: str) -> tuple[DataFrame, list]:
        own = told.where(held).select("id", F.col("text_hash").alias("_hash"))
        return own, [docs["doc_id"] == own["id"], text_hash == own["_hash"]]

    kept = docs.join(*rows("spare or n > 1"), "left_anti")
    if told.where("n > 1 and not spare").isEmpty():
        return kept
    return kept.unionByName(docs.join(*rows("n > 1 and not spare"), "left_semi").dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; no document goes."""
    trees = secrets.train(secrets.labelled_findings(spark))
    return secrets.redacted(docs, trees, length_col="n_chars")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds each document's place in the mix of sources: (slot, place), and its block."""
    return pfair.mixed(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("secret scans", secret_scan),
    ("mixing sources", mixing),
]

#: SQL can express neither the classifier nor the forest; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    folder = f"{shared_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
