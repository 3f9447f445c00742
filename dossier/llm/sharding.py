"""Rendezvous hashing of stable record keys over weighted shards.

DataFrame functions only.  Every shard draws a number for the key, and the
smallest -log(draw) / weight wins; so a new shard takes rows from all others and
no row moves between old ones.  The draws of a row are made once and stored with its
few numbers.  Slots inside a shard count rows bucket by bucket, so that no task
numbers a whole shard.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.llm.scratch import stored

RECORD_BYTES = 16
BUCKETS = 1024


def _score(key: Column, shard: Column, weight: Column) -> Column:
    draw = (F.shiftrightunsigned(F.xxhash64(key, shard), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(draw) / weight


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """struct(score, shard) of the winner among len(weights) shards; depends on the key, the number of shards and their weights alone."""
    given = F.array(*(F.lit(float(w)) for w in weights))
    shards = F.sequence(F.lit(0), F.lit(len(weights) - 1))
    return F.array_min(F.transform(shards, lambda s: F.struct(_score(key, s, F.element_at(given, s + 1)).alias("score"), s.alias("shard"))))


def shard_rows(docs: DataFrame, *, weights: Sequence[float] = (1.0,) * 40, grown_weight: float = 1.0, buckets: int = BUCKETS, as_read: bool = False) -> DataFrame:
    """One row a record of (doc_id, text): doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size is the text's UTF-8 bytes plus 16; a null text has none and the CRC of no bytes, 0.  A null doc_id is one key.
    Rows that repeat a doc_id share a shard and have a slot each.  grown_shard is the shard with one shard more.  A shard's
    slots go by a hash of the row; with as_read, for docs that are read from files, by the number of the file that Spark
    wrote and the row's place in it, so that rows written in order stay in order in each shard.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    n = len(weights)
    bucket, place = F.pmod(F.xxhash64(key, F.lit("slot"), F.crc32("text")), F.lit(buckets)).cast("int"), F.lit(0).cast("long")
    if as_read:
        file = docs.metadataColumn("_metadata")
        bucket, place = F.coalesce(F.regexp_extract(file["file_name"], r"part-(\d+)", 1).try_cast("int"), F.lit(0)), file["row_index"]
    best = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + RECORD_BYTES).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        rendezvous(key, weights).alias("best"),
        F.struct(_score(key, F.lit(n), F.lit(float(grown_weight))).alias("score"), F.lit(n).alias("shard")).alias("new"),
        bucket.alias("bucket"), place.alias("place"),
    )
    rows = stored(best.select("doc_id", "size", "text_crc32", F.col("best.shard").alias("shard"), F.least("best", "new")["shard"].alias("grown_shard"), "bucket", "place"), "placed")
    counts = rows.groupBy("shard", "bucket").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    within = W.partitionBy("shard", "bucket").orderBy("place", "doc_id", "size", "text_crc32")
    placed = rows.repartition("shard", "bucket").withColumn("inner", F.row_number().over(within) - 1).join(starts, ["shard", "bucket"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("first") + F.col("inner")).cast("long").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, *, weights: Sequence[float] = (1.0,) * 40, files_a_shard: int = 8) -> None:
    """The documents as Parquet in one folder a shard, with all their columns but shard, which names the folder.

    Rows without doc_id are one key and one file of their shard; no rows write no folder.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    placed = docs.withColumn("shard", rendezvous(key, weights)["shard"]).withColumn("_part", F.pmod(F.xxhash64(key), F.lit(files_a_shard)))
    placed.repartition("shard", "_part").drop("_part").write.partitionBy("shard").parquet(path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
