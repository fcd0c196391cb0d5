"""The text problems in this project's terms. SQL cannot express them; tests compare with brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.bpe import count_tokens, decode_corpus, encode_corpus
from tidemark.llm.packing import bucket_batches, pack
from tidemark.llm.stuffing import stuffed_pages
from tidemark.session import cut_lineage

CAPACITY = 2048


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    return encode_corpus(_documents(spark, folder))


def p8_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """The texts again, from their ids: null and empty texts are empty."""
    return decode_corpus(encode_corpus(_documents(spark, folder)))


def _sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts, checkpointed: a few bytes per document, used for the histogram and the placing."""
    return cut_lineage(count_tokens(_documents(spark, folder)))


def p9_containers(spark: SparkSession, folder: str) -> DataFrame:
    return pack(_sizes(spark, folder), id="doc_id", size="n_tokens", capacity=CAPACITY)


def p9_padded_buckets(spark: SparkSession, folder: str) -> DataFrame:
    return bucket_batches(_sizes(spark, folder), id="doc_id", size="n_tokens", capacity=CAPACITY)


def p9_unused(spark: SparkSession, folder: str) -> DataFrame:
    """Unused space of both ways of filling."""
    sizes = _sizes(spark, folder)

    def told(way: str, placed: DataFrame) -> DataFrame:
        used = placed.where("length > 0").groupBy("container").agg(F.sum("length").alias("used"), F.count(F.lit(1)).alias("items"))
        return used.agg(F.lit(way).alias("way"), F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"), (1 - F.sum("used") / (F.count(F.lit(1)) * CAPACITY)).alias("unused_share"))

    return told("filled", pack(sizes, id="doc_id", size="n_tokens", capacity=CAPACITY)).unionByName(told("padded_buckets", bucket_batches(sizes, id="doc_id", size="n_tokens", capacity=CAPACITY)))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return stuffed_pages(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang"), lang="lang").select("doc_id")


QUERIES = {f.__name__: f for f in (p8_ids, p8_decoded, p9_containers, p9_padded_buckets, p9_unused, p10_found)}
SQL: dict[str, str] = {}
