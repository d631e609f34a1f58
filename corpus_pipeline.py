"""The training-data pipeline: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on all documents that the stage before
it kept; all but the last return the columns of ``documents``. ``run`` writes each stage's
result to the shared folder and reads it again, so a lost executor costs a stage at most.

Documents whose every line with a word repeats an earlier line are dropped by the line stage, as
nothing of them is left; n_chars follows the text. Mixing writes a document as often as
its copies say; its targets are shares of the tokens after mixing, whatever the input's are.
Growth times the high-quality share is over 1, so clean documents keep a rate of 1 or more.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftlink.llm.common import shared_dir, stored, table
from weftlink.llm.line_dedup import HAS_WORD, dedup_lines
from weftlink.llm.mixing import mix_documents
from weftlink.llm.near_dup import link_documents
from weftlink.llm.packing import pack_documents
from weftlink.llm.quality import kept_documents
from weftlink.llm.tokens import vocabulary

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TARGETS = {"high": 0.93, "low": 0.02, "toxic": 0.05}
GROWTH = 1.08
#: So many ids whose verdict is not the usual one may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 200_000


def _matched(docs: DataFrame, verdicts: DataFrame, usual: int) -> DataFrame:
    """``docs`` with ``_n``, the verdict (id, n) of its id; only verdicts other than the usual one are joined."""
    other = stored(verdicts.where(F.col("n") != usual).select(F.col("id").alias("_id"), F.col("n").alias("_n")), "verdicts")
    few = other.count() <= BROADCAST_IDS
    found = docs.select(*COLUMNS).join(F.broadcast(other) if few else other, F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return found.select(*COLUMNS, F.coalesce("_n", F.lit(usual)).alias("_n"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep, each row on its own."""
    return kept_documents(docs.select(*COLUMNS), table(spark, sf_dir, "labels")).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines."""
    left = dedup_lines(docs.select(*COLUMNS)).where(F.col("text").rlike(HAS_WORD))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8."""
    verdicts = link_documents(docs).groupBy("id").agg(F.max(F.col("kept").cast("int")).alias("n"))
    return _matched(docs, verdicts, 1).where("_n > 0").select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix to target weights has it."""
    copies = mix_documents(docs, table(spark, sf_dir, "labels"), TARGETS, GROWTH)
    found = _matched(docs, copies.select(F.col("doc_id").alias("id"), F.col("copies").cast("int").alias("n")), 1).where("_n > 0")
    return found.select(*COLUMNS, F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("_time")).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token sequences, one row per piece."""
    return pack_documents(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near", near_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: Thresholds, set joins and tokens are not expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    folder = f"{shared_dir(spark)}/weftlink-pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
