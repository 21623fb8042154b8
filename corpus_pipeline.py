"""A corpus pipeline: documents that are good enough, one of each group of near copies, without benchmark items and
secrets, encoded. Each stage takes (spark, docs, sf_dir) and is written as Parquet before the next one reads it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import bpe, decontaminate, jaccard, quality, secrets
from lodestone.llm.common import checkpointed, free, one_in, shared_dir, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the byte network, fitted on these documents' labels, doesn't reject."""
    network = quality.train(docs, table(spark, sf_dir, "labels"), ~one_in("doc_id", 4, 2))
    return quality.classify(docs, network, carry=True).where(F.col(free(docs, "_predicted")) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group connected by similarities of 0.8 or more the document with the least doc_id, once; where texts of a
    group share that doc_id, one of them. Documents without a doc_id can't be compared and stay."""
    least = jaccard.join(docs, carry=True).where("doc_id = class_id").groupBy("_root", "doc_id", "_unit", "_mark").agg(F.count("*").alias("rows"))
    first = checkpointed(least.groupBy("_root").agg(F.min(F.struct("doc_id", "_unit", "_mark", "rows")).alias("s")).select("s.doc_id", "s._mark", "s.rows"))
    count, most = first.agg(F.count("*"), F.max("rows")).first()
    mark = free(docs, "_mark")
    marked = docs.withColumn(mark, F.xxhash64("text"))
    kept = marked.join(jaccard.small(first.select("doc_id", F.col("_mark").alias(mark)), count), ["doc_id", mark], "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
    if (most or 1) > 1:
        kept = kept.dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id is null"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, each judged by its own text."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"), by_row=True)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced, and n_chars that of the new text."""
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*[F.col(f"`{c}`") for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): ids as little-endian unsigned 32-bit integers."""
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", keep_quality), ("near_copies", drop_near_copies), ("benchmark", drop_benchmark), ("secrets", redact_secrets), ("bpe", encode)]
#: A learned classifier isn't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), shared_dir(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
