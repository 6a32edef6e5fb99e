"""Toxicity filter, near-duplicate removal, benchmark decontamination, mixing and sharding of a corpus, in this order.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; the driver of the stages (run,
or the caller) writes each result as Parquet and hands the reread table to the next. All stages but the last return the
columns of documents. Nulls in any column, empty tables and repeated rows pass through every stage by the rules of its
operator.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowtide.cluster import shared_dir
from flowtide.llm import decontaminate, mixing, near_dup, sharding, toxicity

NEAR_PERCENT, SHARDS = 80, 16
LEAST_SPAN, MOST_SHARE = 1, 0.5


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose score is at the cut or above; the model is that of the given documents and the
    table's labels."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs, "_toxicity")
    return toxicity.score(docs, model, name=score).filter(F.col(score) < toxicity.CUT).select(*docs.columns)


def free_name(docs: DataFrame, name: str) -> str:
    """The name, with as many more underlines as it takes to be none of the columns."""
    while name in docs.columns:
        name += "_"
    return name


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies, the one of least id. A document is an id and a text: texts that share an id,
    or have none, are documents of their own. Of rows equal in both the least by their other columns stays."""
    mark, kept, kept_mark = (free_name(docs, n) for n in ("_mark", "_kept", "_kept_mark"))
    found = near_dup.groups_of(docs, NEAR_PERCENT).filter("kept").select(
        F.col("id").alias(kept), F.col("mark").alias(kept_mark)).distinct()
    same = F.col("doc_id").eqNullSafe(F.col(kept)) & (F.col(mark) == F.col(kept_mark))
    order = F.xxhash64(*[F.col(c) for c in docs.columns if c != "text"])
    row = F.min_by(F.struct(*docs.columns), order).alias(kept)
    return (docs.withColumn(mark, near_dup.mark(F.col("text"))).join(found, same, "left_semi")
            .groupBy("doc_id", mark).agg(row).select(f"{kept}.*"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of benchmark items, and without the documents that are mostly such passages."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.clean(docs, items, least=LEAST_SPAN, share=MOST_SHARE)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens meet the target shares of sources, languages and topics."""
    return mixing.draw(docs, mixing.POWER)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's size, checksum, shard and place in it."""
    return sharding.shard_by_bytes(docs, SHARDS)


STAGES = [("toxicity", drop_toxic), ("near_dedup", drop_near_duplicates), ("decontamination", drop_benchmark),
          ("mixing", mix), ("sharding", shard)]

#: Toxicity is a trained model, which SQL does not express; tests/llm holds each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/flowtide-{spark.sparkContext.applicationId}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
