"""Predictions against expected labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.functions import rules
from dossier.functions.text import missing_fields

STATUSES = ("relevant", "maybe", "not_relevant")


def prepared(cases: DataFrame, contexts: DataFrame, key: str) -> DataFrame:
    """cases with preparation: ok, stale (another input hash), missing."""
    now = contexts.select(key, F.col("input_hash").alias("current_hash"))
    state = F.when(F.col("current_hash").isNull(), "missing").when(F.col("current_hash") == F.col("input_hash"), "ok").otherwise("stale")
    return cases.join(now, key, "left").withColumn("preparation", state).drop("current_hash")


def compared(rows: DataFrame) -> DataFrame:
    """(expected_, predicted_)(status, type, category) -> also core, full, category_match and mismatch."""
    e, p = (lambda n: F.col(f"expected_{n}")), (lambda n: F.col(f"predicted_{n}"))
    core = e("status").eqNullSafe(p("status")) & e("type").eqNullSafe(p("type"))
    category = e("category").eqNullSafe(p("category"))
    return rows.withColumns({"core": core, "category_match": category, "full": core & category, "mismatch": rules.mismatch(e("status"), p("status"), core)})


def accuracy(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """metric, correct, total, ratio (null for none) of status, type, category (only where one is expected), core and full; of compared rows."""
    metrics: dict[str, tuple[Column, Column]] = {
        "status": (F.col("expected_status").eqNullSafe(F.col("predicted_status")), F.lit(True)),
        "type": (F.col("expected_type").eqNullSafe(F.col("predicted_type")), F.lit(True)),
        "category": (F.col("category_match"), F.col("expected_category").isNotNull()),
        "core": (F.col("core"), F.lit(True)),
        "full": (F.col("full"), F.lit(True)),
    }
    sums = [F.struct(F.lit(n).alias("metric"), F.count_if(ok & counted).alias("correct"), F.count_if(counted).alias("total")) for n, (ok, counted) in metrics.items()]
    out = rows.groupBy(*by).agg(F.array(*sums).alias("m")).select(*by, F.explode("m").alias("m")).select(*by, "m.*")
    return out.withColumn("ratio", F.try_divide("correct", "total"))


def records(cases: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """One record a case: cases (key, preparation, expected_status, expected_type, expected_category) with outcome: skipped (not prepared), error (no prediction or one with an error) or scored.

    predictions has key, predicted_status, predicted_type, predicted_category and error; core, category_match and full are null unless scored.
    """
    joined = cases.join(predictions.withColumn("_found", F.lit(True)), key, "left")
    outcome = F.when(F.col("preparation") != "ok", "skipped").when(F.col("_found").isNull() | F.col("error").isNotNull(), "error").otherwise("scored")
    scored = compared(joined.withColumn("outcome", outcome))
    return scored.withColumns({c: F.when(F.col("outcome") == "scored", F.col(c)) for c in ("core", "category_match", "full", "mismatch")}).drop("_found")


def valid_cases(cases: DataFrame, errors: DataFrame, most: int = 100) -> DataFrame:
    """The cases, if they have no errors; else a ValueError that names the first of them."""
    found = errors.limit(most).collect()
    if found:
        raise ValueError("; ".join(" ".join(map(str, r)) for r in found))
    return cases


def confusion(rows: DataFrame, expected: str, predicted: str, labels: Sequence[str] = STATUSES) -> DataFrame:
    """A row an expected label with the counts of each predicted one, zeros included."""
    found = rows.groupBy(expected).pivot(predicted, list(labels)).agg(F.count(F.lit(1)))
    every = rows.sparkSession.createDataFrame([(x,) for x in labels], f"{expected} string")
    return every.join(found, expected, "left").fillna(0, list(labels))


def mismatches(rows: DataFrame, id_column: str) -> DataFrame:
    """Numbers and smallest ids of each class of mismatch; of compared rows."""
    return rows.groupBy("mismatch").agg(F.count(F.lit(1)).alias("n"), F.min(id_column).alias("first_id"))


def mismatch_ids(rows: DataFrame, id_column: str, position: str) -> DataFrame:
    """The ids of each class of mismatch, a row each, with their place in the class's order from 1; of compared rows.

    Places are counted in buckets of the position, so that no task has a whole class.
    """
    wrong = rows.where("mismatch <> 'none'").select("mismatch", id_column, position)
    bucket = F.floor(F.col(position) / 4096)
    counts = wrong.groupBy("mismatch", bucket.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("mismatch", "_b", F.coalesce(F.sum("_n").over(W.partitionBy("mismatch").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inner = F.row_number().over(W.partitionBy("mismatch", "_b").orderBy(position, id_column))
    placed = wrong.withColumn("_b", bucket).withColumn("_inner", inner).join(before, ["mismatch", "_b"])
    return placed.select("mismatch", id_column, (F.col("_before") + F.col("_inner")).cast("long").alias("place"))


def passes(rows: DataFrame, errors: Column, by: Sequence[str] = ()) -> DataFrame:
    """Whether all are right, without misses, false alarms and errors; categories don't count."""
    found = rows.groupBy(*by).agg(
        F.every("core").alias("all_right"),
        (F.count_if(F.col("mismatch") == "false_negative") == 0).alias("no_misses"),
        (F.count_if(F.col("mismatch") == "false_positive") == 0).alias("no_false_alarms"),
        (F.count_if(errors) == 0).alias("no_errors"),
    )
    return found.withColumn("passes", F.col("all_right") & F.col("no_misses") & F.col("no_false_alarms") & F.col("no_errors"))


def case_errors(cases: DataFrame, key: str, hash_column: str, required: dict[str, Column]) -> DataFrame:
    """All errors of a set of cases, a row each: key, error.  Blank fields, hashes that are not 64 hex digits, repeated keys."""
    missing = cases.select(key, F.explode(F.transform(missing_fields(required), lambda x: F.concat(F.lit("missing "), x))).alias("error"))
    hashes = cases.where(~F.coalesce(F.col(hash_column).rlike("^[0-9a-f]{64}$"), F.lit(False))).select(key, F.lit("bad hash").alias("error"))
    repeated = cases.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(key, F.lit("repeated").alias("error"))
    return missing.unionByName(hashes).unionByName(repeated)
