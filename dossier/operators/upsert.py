"""Change-detecting writes as joins: a stored snapshot and new rows make the next snapshot and a status a row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from dossier.functions.text import changed_fields, is_blank

STATUSES = ("new", "existing", "updated", "deleted")


def insert_missing(stored: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows whose key is not stored, once each; also the versioned insert when the content's hash is part of the key."""
    return rows.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti")


def upsert_status(stored: DataFrame, rows: DataFrame, keys: Sequence[str], compared: Sequence[str], replace: bool = False) -> DataFrame:
    """keys, status and changed fields of each new row, and with replace of each stored row that is not among them.

    Both sides hold a key once.  Nulls are equal.
    """
    new = rows.select(*keys, F.struct(*compared).alias("new"))
    old = stored.select(*keys, F.struct(*compared).alias("old"))
    both = new.join(old, list(keys), "full_outer" if replace else "left")
    changed = changed_fields({c: (F.col(f"new.{c}"), F.col(f"old.{c}")) for c in compared})
    status = F.when(F.col("new").isNull(), "deleted").when(F.col("old").isNull(), "new").when(F.size(changed) == 0, "existing").otherwise("updated")
    return both.select(*keys, status.alias("status"), F.when(status == "updated", changed).otherwise(F.array().cast("array<string>")).alias("changed"))


def upserted(stored: DataFrame, rows: DataFrame, keys: Sequence[str], compared: Sequence[str], now: Column, touch_existing: bool = False, first: str = "first_seen_at", last: str = "last_seen_at") -> DataFrame:
    """The next snapshot: keys, compared fields, first and last.

    Absent keys are stored as they were; first never changes; last is now for new and updated rows, and for existing ones if touched.
    """
    new = rows.select(*keys, F.struct(*compared).alias("new"))
    old = stored.select(*keys, F.struct(*compared).alias("old"), F.col(first).alias("_first"), F.col(last).alias("_last"))
    both = new.join(old, list(keys), "full_outer")
    differs = F.col("old").isNull() | ~F.col("new").eqNullSafe(F.col("old"))
    touched = F.col("new").isNotNull() & (differs | F.lit(touch_existing))
    values = [F.coalesce(F.col("new"), F.col("old"))[c].alias(c) for c in compared]
    return both.select(*keys, *values, F.coalesce("_first", now).alias(first), F.when(touched, now).otherwise(F.col("_last")).alias(last))


def batch_status(stored: DataFrame, rows: DataFrame, keys: Sequence[str], compared: Sequence[str], position: str, required: Sequence[str] = ()) -> DataFrame:
    """Status of each row of a batch that is taken in order, so that a key's later row is compared with its earlier one.

    Rows without a required field are failed and change nothing.  Returns keys, position, status.
    """
    bad = F.lit(False)
    for c in required:
        bad = bad | is_blank(F.col(c).cast("string"))
    good = rows.where(~bad)
    old = stored.select(*keys, F.struct(*compared).alias("old"))
    before = F.lag(F.struct(*compared)).over(W.partitionBy(*keys).orderBy(position))
    joined = good.withColumn("before", before).join(old, list(keys), "left").withColumn("reference", F.coalesce("before", "old"))
    status = F.when(F.col("reference").isNull(), "new").when(F.struct(*compared).eqNullSafe(F.col("reference")), "existing").otherwise("updated")
    done = joined.select(*keys, position, status.alias("status"))
    return done.unionByName(rows.where(bad).select(*keys, position, F.lit("failed").alias("status")))


def status_counts(statuses: DataFrame) -> DataFrame:
    return statuses.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def stage_summary(outcomes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Of rows with status (new, updated, existing or failed): processed, success, failed and each of the others, zeros included."""
    count = lambda *names: F.count_if(F.col("status").isin(*names))
    return outcomes.groupBy(*by).agg(F.count(F.lit(1)).alias("processed"), count("new", "updated", "existing").alias("success"), *(count(n).alias(n) for n in ("failed", "new", "updated", "existing")))


def last_attempt(stored: DataFrame, rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """State of the last attempt: new rows replace stored ones whole."""
    return rows.unionByName(stored.join(rows.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def cleaned_children(children: Column, code: str, name: str | None = None) -> Column:
    """An array of structs without blank codes and without later repeats of (code, name); null stays null, which means keep."""
    kept = F.filter(children, lambda x: ~is_blank(x[code]))
    if not name:
        return F.array_distinct(kept)
    same = lambda x, y: x[code].eqNullSafe(y[code]) & x[name].eqNullSafe(y[name])
    return F.filter(kept, lambda x, i: ~F.exists(F.slice(kept, F.lit(1), i), lambda y: same(x, y)))


def replaced_children(stored: Column, given: Column) -> Column:
    """struct(children, changed): null keeps the stored list, any list replaces it if it differs."""
    next_ = F.coalesce(given, stored)
    return F.struct(next_.alias("children"), (~next_.eqNullSafe(stored)).alias("changed"))


def with_children(stored: DataFrame, rows: DataFrame, keys: Sequence[str], compared: Sequence[str], lists: Sequence[str], now: Column, last: str = "enriched_at") -> DataFrame:
    """The next snapshot of parents with lists of children, and status: keys, compared, lists, last, status (null for rows that are not given).

    Scalars are replaced; a null list keeps the stored one, any other replaces it whole; last is now for every given row.
    """
    new = rows.select(*keys, F.struct(*compared).alias("new"), *(F.col(c).alias(f"new_{c}") for c in lists))
    old = stored.select(*keys, F.struct(*compared).alias("old"), *(F.col(c).alias(f"old_{c}") for c in lists), F.col(last).alias("_last"))
    both = new.join(old, list(keys), "full_outer")
    differs = ~F.col("new").eqNullSafe(F.col("old"))
    for c in lists:
        differs = differs | replaced_children(F.col(f"old_{c}"), F.col(f"new_{c}"))["changed"]
    status = F.when(F.col("new").isNull(), None).when(F.col("old").isNull(), "new").when(differs, "updated").otherwise("existing")
    return both.select(
        *keys, *(F.coalesce("new", "old")[c].alias(c) for c in compared), *(F.coalesce(f"new_{c}", f"old_{c}").alias(c) for c in lists),
        F.when(F.col("new").isNotNull(), now).otherwise(F.col("_last")).alias(last), status.alias("status"),
    )


def results_upserted(stored: DataFrame, rows: DataFrame, keys: Sequence[str], compared: Sequence[str], parents: DataFrame, parent_key: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(next snapshot of results, rows without a parent); analyzed_at is that of the last change."""
    known = rows.join(parents.select(parent_key).distinct(), parent_key, "left_semi")
    return upserted(stored, known, keys, compared, now, first="first_analyzed_at", last="analyzed_at"), missing_parents(rows, parents.select(parent_key).distinct(), parent_key)


def missing_parents(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    return children.join(parents, key, "left_anti")


def begun_attempts(deliveries: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Deliveries to be tried: keys and attempt; sent ones are left out, others count one attempt more."""
    joined = wanted.select(*keys).distinct().join(deliveries.select(*keys, "status", "attempt_count"), list(keys), "left")
    return joined.where(F.col("status").isNull() | (F.col("status") != "sent")).select(*keys, (F.coalesce("attempt_count", F.lit(0)) + 1).alias("attempt_count"))


def settled_deliveries(deliveries: DataFrame, results: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Deliveries after their results (keys, ok): a failure never takes back what was sent."""
    joined = deliveries.join(results.select(*keys, "ok"), list(keys), "left")
    status = F.when(F.col("ok") | (F.col("status") == "sent"), "sent").when(F.col("ok").isNotNull(), "failed").otherwise(F.col("status"))
    return joined.withColumn("status", status).drop("ok")
