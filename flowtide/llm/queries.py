"""Registered queries of the training-data operators: production parameters, whole tables, full results."""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from flowtide.cluster import shared_dir
from flowtide.llm import (decontaminate, divergence, fim, fingerprints, licenses, mixing, near_dup, secrets, sharding,
                          substring_dedup, token_counts, token_store, toxicity)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _new_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/flowtide-{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every text through a ledger of its own, begun empty."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = secrets.scan_versions(docs, _new_path(spark, "ledger"))
    base = [r.kind for r in secrets.BASE]
    of_base = F.filter("findings", lambda f: f["kind"].isin(base))

    def count(kind: str):
        return F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", "blob", *[count(k) for k in base],
                        F.sha2(secrets.written(of_base).cast("binary"), 256).alias("base_sha256"),
                        secrets.written(F.col("findings")).alias("spans"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text written to a store of packed segments, then read back."""
    import public_tokenizers

    path = _new_path(spark, "tokens")
    token_store.write_store(_table(spark, sf_dir, "documents"), path, str(public_tokenizers.path("word_bpe_49k.json")),
                            vocabulary=49_408, end_id=2)
    return token_store.documents_of(spark, path)


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited text."""
    both = fingerprints.edited_pairs(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return both.select("doc_id", "n_chars", "edited_sha256", fingerprints.written(F.col("own")).alias("fingerprint"),
                       fingerprints.written(F.col("edited")).alias("edited_fingerprint"),
                       fingerprints.likeness(F.col("own"), F.col("edited")).alias("near_edited"),
                       fingerprints.likeness(F.col("own"), F.col("next")).alias("near_next"))


def op4_byte_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 contiguous shards of equal bytes."""
    cut = sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), 16)
    return cut.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every text for the unigram model over the pieces of a public vocabulary file."""
    import public_tokenizers

    return token_counts.count_tokens(_table(spark, sf_dir, "documents"), str(public_tokenizers.path("piece_bpe_32k.model")))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents as files source/lang/id.txt (the digest of its text where a row has no id); one that is a
    licence as a whole speaks for its directory."""
    docs = _table(spark, sf_dir, "documents")
    name = F.coalesce(F.col("doc_id").cast("string"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))
    files = docs.select("doc_id", F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("unknown")),
                                              F.concat(name, F.lit(".txt"))).alias("path"), "text")
    return licenses.scan(files, F.col("license_unit") == "whole").select(
        "doc_id", "path", "own_license", "cosine", "license_unit", "license", "inherited_from")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every text by the model of the table's labels."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated sampling of all documents by source, language and topic."""
    return mixing.calibrate(_table(spark, sf_dir, "documents"), mixing.POWER)


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents linked at 85 % of common five-word shingles or more."""
    return near_dup.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Divergence of all pairs of sources of each language, and the terms that set each source apart."""
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts without the sequences of 35 words that start at more than one place."""
    kept = substring_dedup.without_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts cut and put together for filling in the middle, and restored from that."""
    return fim.transform(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_token_store": op2_token_store,
    "op3_fingerprints": op3_fingerprints,
    "op4_byte_shards": op4_byte_shards,
    "op5_token_counts": op5_token_counts,
    "op6_license_scan": op6_license_scan,
    "op7_toxicity": op7_toxicity,
    "op8_source_mixing": op8_source_mixing,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_decontamination": op10_decontamination,
    "op11_source_divergence": op11_source_divergence,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_fill_in_middle": op13_fill_in_middle,
}
