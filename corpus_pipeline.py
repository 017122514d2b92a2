"""A corpus pipeline of five stages: filter, deduplicate, cut repeated passages, decontaminate, encode.

Each stage takes the documents that the one before it kept and returns
documents, the last one their codes.  The stages work on whole texts; what one
drops or cuts is gone for the next.

Defined cases: an empty table stays empty through all stages; the stages that
drop rows know one by a 64-bit hash of its columns, so rows without an id and rows
that share an id are judged by their own texts, and of rows alike one stays; a
text without words is in no group of copies and stays if the rules let it; extra
columns of the input are left behind by the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import byte_bpe, decontamination, jaccard_join, quality_rules, substring_dedup
from lumenframe.sources.workspace import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the plain rules and their language's perplexity bands keep."""
    keyed = docs.select(*COLUMNS, F.xxhash64("doc_id", "lang", "text").alias("row_key"))
    rejected = quality_rules.judge(keyed, doc_id="row_key").where(~F.col("kept")).select("row_key").distinct()
    return keyed.join(rejected, "row_key", "left_anti").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates: one with the smallest id, or without an id where none has one."""
    keyed = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("row_key"))
    found = jaccard_join.classes(keyed, "row_key").where("n_shingles > 0").select(F.col("doc_id").alias("row_key"), "component_id").distinct()
    rows = keyed.groupBy("row_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))
    nodes = materialise(rows.join(found, "row_key"), "row-groups", jaccard_join.ROWS)
    stays = nodes.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))["row_key"].alias("row_key"))
    repeated = nodes.where("n > 1").join(stays, "row_key", "left_semi").select("row_key")
    others = nodes.join(stays, "row_key", "left_anti").select("row_key").unionByName(repeated)
    one = keyed.join(repeated, "row_key", "left_semi").dropDuplicates(["row_key"])
    return keyed.join(others, "row_key", "left_anti").unionByName(one).select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that occur more than once; a document may be left empty."""
    cut = substring_dedup.dedup(docs, carry=("lang", "source", "n_chars"))
    return cut.select("doc_id", F.col("kept").alias("text"), "lang", "source", F.when(F.col("n_removed") > 0, F.length("kept").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    keyed = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("row_key"))
    leaks = decontamination.find(keyed, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "row_key").select("row_key").distinct()
    return keyed.join(leaks, "row_key", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document the number and digest of its token ids, and the digest of the bytes that they decode to."""
    return byte_bpe.encode(docs, public_tokenizers.path(VOCABULARY), digest=True)


STAGES = [
    ("quality rules", filter_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("substring dedup", cut_repeats),
    ("benchmark decontamination", drop_benchmark),
    ("byte-level BPE", encode),
]

#: The first stage's model is not expressible in SQL; tests hold the rest against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
