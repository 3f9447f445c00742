"""Mixing sources to target weights along a time-varying curriculum.

DataFrame functions only.  Sizes are words.  Each source gets a target; its
documents, in an order given by a digest of doc_id, form a stream that starts
over when it ends, and the mix takes the stream up to the target.  A copy is
taken when its middle lies inside, so that a source misses its target by half a
document at most.  A copy's share of its source's cumulative demand, put through
the inverse of the integral of the source's weight schedule, is its position in
training, and documents are range-sorted by it.

The running size inside a source is a sum over the buckets of the digest before
the document's bucket plus a running sum inside the bucket: no task gets a whole
source.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.llm.scratch import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BUCKETS = 4096
#: A schedule is a list of (time, relative weight), straight between its knots, over times from 0 to 1.
Schedule = Sequence[tuple[float, float]]
#: The heavy sources lead, the light ones close.
SCHEDULES: Mapping[int, Schedule] = {5: ((0.0, 1.5), (1.0, 0.5)), 2: ((0.0, 1.0), (1.0, 1.0)), 1: ((0.0, 0.5), (1.0, 1.5))}


def inverse_demand(share: Column, schedule: Schedule) -> Column:
    """The time at which the schedule's integral reaches a share of its total."""
    total = sum((b - a) * (u + v) / 2 for (a, u), (b, v) in zip(schedule[:-1], schedule[1:], strict=True))
    time, done = F.lit(1.0), 1.0
    for (a, u), (b, v) in reversed(list(zip(schedule[:-1], schedule[1:], strict=True))):
        area = (b - a) * (u + v) / 2 / total
        start = done - area
        u1, slope = u / total, (v - u) / (b - a) / total
        rest = share - F.lit(start)
        root = F.sqrt(F.greatest(F.lit(u1 * u1) + F.lit(2 * slope) * rest, F.lit(0.0)))
        step = F.when(rest <= 0, F.lit(0.0)).otherwise(F.lit(2.0) * rest / (F.lit(u1) + root))
        time = F.when(share < F.lit(done), F.lit(a) + step).otherwise(time)
        done = start
    return time


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = 3) -> DataFrame:
    """(source, source_size) -> also weight and target: weights repeat over the sources by code point, null last; no target is above most times its source's size, and what that leaves goes to the others by weight."""
    by_name = W.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.row_number().over(by_name) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    ranked = ranked.withColumn("ratio", F.col("cap") / F.col("weight"))
    before = W.orderBy("ratio", F.col("source").isNull(), "source").rowsBetween(W.unboundedPreceding, -1)
    whole = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left_size = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    left_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    ranked = ranked.withColumn("level", left_size / left_weight)
    #: The sources that stop are the first by ratio; the first that does not stop sets the level of all others.
    level = F.min(F.when(F.col("ratio") > F.col("level"), F.struct("ratio", "level"))).over(whole)["level"]
    ranked = ranked.withColumn("common", level)
    target = F.when(F.col("common").isNull() | (F.col("ratio") <= F.col("common")), F.col("cap").cast("double")).otherwise(F.col("common") * F.col("weight"))
    return ranked.select("source", "source_size", "weight", target.alias("target"))


def curriculum(docs: DataFrame, *, weights: Sequence[int] = WEIGHTS, schedules: Mapping[int, Schedule] = SCHEDULES, most: int = 3, buckets: int = BUCKETS) -> DataFrame:
    """One row a document of (doc_id, text, source), range-sorted by first position: doc_id, source, size, source_size, target, taken, copies, positions, first_position.

    Null text: size 0.  A null source is a source.  A null doc_id sorts as the empty string.  Rows that repeat a doc_id
    are separate documents; equal rows are interchangeable.  Documents that are not taken have no position and come last.
    """
    out = _placed(docs, weights, schedules, most, buckets, ())
    place = F.coalesce("first_position", 1 + F.col("order_key") / F.lit(float(1 << 60)))
    return out.withColumn("place", place).repartitionByRange("place").sortWithinPartitions("place").drop("place", "order_key")


def _placed(docs: DataFrame, weights: Sequence[int], schedules: Mapping[int, Schedule], most: int, buckets: int, carry: Sequence[str]) -> DataFrame:
    """The rows of curriculum in any order, with order_key and the columns named in carry."""
    text, id_text = F.col("text"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    digest = F.md5(id_text)
    key = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source"))).alias("source_key"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        key.alias("order_key"),
        F.floor(key / F.lit((1 << 60) // buckets)).cast("int").alias("bucket"),
        F.xxhash64(text).alias("tie"),
        *[F.col(c).alias(f"carried_{c}") for c in carry],
    )
    if not carry:  # a few numbers a row: words are counted once
        sized = stored(sized, "sizes")
    dealt = sized.repartition("source_key", "bucket")
    by_bucket = stored(sized.groupBy("source_key", "bucket").agg(F.sum("size").alias("bucket_size"), F.first("source").alias("source")), "sizes")  # a row a source and bucket
    by_source = by_bucket.groupBy("source_key").agg(F.sum("bucket_size").alias("source_size"), F.first("source").alias("source"))
    targets = source_targets(by_source.select("source", "source_size"), weights, most)
    targets = targets.withColumn("source_key", F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("source")))).drop("source")
    earlier = W.partitionBy("source_key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = by_bucket.select("source_key", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("bucket_start"))
    starts = starts.join(targets, "source_key")

    within = W.partitionBy("source_key", "bucket").orderBy("order_key", "doc_id", "size", "tie").rowsBetween(W.unboundedPreceding, -1)
    placed = dealt.withColumn("inner_start", F.coalesce(F.sum("size").over(within), F.lit(0))).join(starts, ["source_key", "bucket"])
    start = F.col("bucket_start") + F.col("inner_start")
    middles = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda turn: (turn * F.col("source_size") + start) * 2 + F.col("size"))
    taken = F.filter(middles, lambda middle: middle < F.col("target") * 2)
    share = lambda middle: middle / (F.col("target") * 2)
    position = lambda middle: _by_weight(F.col("weight"), share(middle), schedules)
    out = placed.withColumn("taken_at", taken).withColumn("copies", F.size("taken_at")).withColumn("positions", F.transform("taken_at", position))
    first = F.try_element_at("positions", F.lit(1))
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "positions", first.alias("first_position"), "order_key", *[F.col(f"carried_{c}").alias(c) for c in carry])


def _by_weight(weight: Column, share: Column, schedules: Mapping[int, Schedule]) -> Column:
    """A weight without a schedule has a constant one."""
    out = inverse_demand(share, ((0.0, 1.0), (1.0, 1.0)))
    for w, schedule in schedules.items():
        out = F.when(weight == w, inverse_demand(share, schedule)).otherwise(out)
    return out


def mixed_documents(docs: DataFrame, *, weights: Sequence[int] = WEIGHTS, schedules: Mapping[int, Schedule] = SCHEDULES, most: int = 3, buckets: int = BUCKETS) -> DataFrame:
    """The documents that the mix takes, a row for each copy, in training order; the columns of docs.

    Partitions and the rows in them are in the order of training, and so are the files that they are written to.  Nulls, ties
    and repeated rows count as in curriculum; a document of size 0 is taken where its place is; no rows give none.
    """
    names = docs.columns
    own = [c if c in ("doc_id", "text", "source") else f"given_{i}" for i, c in enumerate(names)]
    mix = _placed(docs.toDF(*own), weights, schedules, most, buckets, [c for c in own if c not in ("doc_id", "source")])
    copies = mix.select(*own, F.explode("positions").alias("training_position"))
    return copies.repartitionByRange("training_position").sortWithinPartitions("training_position").drop("training_position").toDF(*names)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return curriculum(docs).select("doc_id", "size", "source_size", "target", "taken", F.round("first_position", 6).alias("first_position"))


OP5_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15) AS order_key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM sized GROUP BY source),
ranked AS (
  SELECT *, (source_size * 3)::DOUBLE / weight AS ratio,
         (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER before, 0))::DOUBLE
           / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM sources
  WINDOW before AS (ORDER BY (source_size * 3)::DOUBLE / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
common AS (SELECT arg_min(level, ratio) AS level FROM ranked WHERE ratio > level),
targets AS (
  SELECT r.source, r.source_size, r.weight,
         CASE WHEN c.level IS NULL OR r.ratio <= c.level THEN (r.source_size * 3)::DOUBLE ELSE c.level * r.weight END AS target
  FROM ranked r LEFT JOIN common c ON TRUE),
placed AS (
  SELECT s.doc_id, s.size, t.source_size, t.target, t.weight,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.order_key, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
counted AS (
  SELECT *, (start * 2 + size < target * 2)::BIGINT + ((source_size + start) * 2 + size < target * 2)::BIGINT
            + ((2 * source_size + start) * 2 + size < target * 2)::BIGINT AS copies,
         (start * 2 + size) / (target * 2) AS share
  FROM placed)
SELECT doc_id, size, source_size, target, size * copies AS taken,
       CASE WHEN copies > 0 THEN round(CASE weight
         WHEN 5 THEN 2 * share / (1.5 + sqrt(greatest(1.5 * 1.5 - 2 * share, 0)))
         WHEN 1 THEN 2 * share / (0.5 + sqrt(greatest(0.5 * 0.5 + 2 * share, 0)))
         ELSE share END, 6) END AS first_position
FROM counted
"""
