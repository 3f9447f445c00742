"""Which rows need work, in which order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pending(spine: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of the spine without a result."""
    return spine.join(done, key, "left_anti")


def by_priority(spine: DataFrame, done: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Rows without a result (priority 0) and rows whose last attempt failed (1); state has key and status."""
    joined = spine.join(done.select(key, F.lit(True).alias("has_result")), key, "left").join(state.select(key, "status"), key, "left")
    failed = F.coalesce(F.col("status") == "failed", F.lit(False))
    wanted = joined.where(F.col("has_result").isNull() | failed)
    return wanted.withColumn("priority", F.when(F.col("has_result").isNull(), 0).otherwise(1)).select(*spine.columns, "priority")


def document_candidates(spine: DataFrame, done: DataFrame, document_state: DataFrame, state: DataFrame, key: str) -> DataFrame:
    """Rows with a result whose documents were not read, or not well, unless the result's own last attempt failed."""
    documents = document_state.select(key, F.col("status").alias("document_status"))
    joined = spine.join(done.select(key), key).join(documents, key, "left").join(state.select(key, "status"), key, "left")
    open_ = F.col("document_status").isNull() | (F.col("document_status") == "failed")
    kept = joined.where(open_ & (F.col("status").isNull() | (F.col("status") != "failed")))
    return kept.withColumn("priority", F.when(F.col("document_status").isNull(), 0).otherwise(1)).select(*spine.columns, "priority")


def stale(current: DataFrame, stored: DataFrame, key: str, hash_column: str = "input_hash") -> DataFrame:
    """Keys whose stored result is missing or belongs to another content: key, reason."""
    both = current.select(key, F.col(hash_column).alias("current_hash")).join(stored.select(key, F.col(hash_column).alias("stored_hash")), key, "left")
    kept = both.where(~F.col("current_hash").eqNullSafe(F.col("stored_hash")))
    return kept.select(key, F.when(F.col("stored_hash").isNull(), "missing").otherwise("stale").alias("reason"))


def stage_current(row_hash: Column, pairs: Sequence[tuple[Column, Column]], current_hash: Column) -> Column:
    """A stored row counts only for the same content, prompt, provider and model."""
    same = row_hash == current_hash
    for a, b in pairs:
        same = same & (a == b)
    return F.coalesce(same, F.lit(False))


def loaded(candidates: DataFrame, rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Candidates (key, ...) with the columns of their row, and the candidates that have none and are left out."""
    return candidates.join(rows, key), candidates.join(rows.select(key), key, "left_anti")


def latest_with_children(versions: DataFrame, children: DataFrame, keys: Sequence[str], order: Sequence[str], version_id: str, child: Column, child_order: Column, name: str) -> DataFrame:
    """The last version of each key, with an array of that version's children in order, empty for none."""
    return with_children(latest(versions, keys, order), children, version_id, child, child_order, name)


def first_wins(parts: Sequence[DataFrame], key: str, order: Sequence[str]) -> DataFrame:
    """Union in which the first row of a key stays: of an earlier part, then by order.  Rows with a blank key all stay.  Adds part, the number of the part."""
    every = parts[0].withColumn("part", F.lit(0))
    for n, p in enumerate(parts[1:], 1):
        every = every.unionByName(p.withColumn("part", F.lit(n)))
    keyed = every.withColumn("_key", F.nullif(F.trim(F.col(key)), F.lit("")))
    rest = [c for c in every.columns if c not in ("part", *order)]
    first = F.min_by(F.struct(*every.columns), F.struct("part", *order, *rest))
    chosen = keyed.where(F.col("_key").isNotNull()).groupBy("_key").agg(first.alias("r")).select("r.*")
    return chosen.unionByName(keyed.where(F.col("_key").isNull()).select(*every.columns))


def union_minus(parts: Sequence[DataFrame], removed: DataFrame, key: str) -> DataFrame:
    """Distinct keys of the parts that are not blank and not among the removed."""
    every = parts[0].select(key)
    for p in parts[1:]:
        every = every.union(p.select(key))
    return every.where(F.trim(F.col(key).cast("string")) != "").distinct().join(removed, key, "left_anti")


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key by order; sums up before it shuffles."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("_last")).select(*keys, "_last.*")


def round_robin(rows: DataFrame, groups: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The first n rows when the groups, in order of their first rows, give one row each in turn.

    The groups' first rows are an aggregate, and no group gives more than n rows, which the rank filter drops before the shuffle.
    """
    firsts = rows.groupBy(*groups).agg(F.min(F.struct(*order)).alias("_first"))
    ranked = rows.withColumn("_turn", F.row_number().over(W.partitionBy(*groups).orderBy(*order))).where(F.col("_turn") <= n)
    same = [ranked[g].eqNullSafe(firsts[g]) for g in groups]
    joined = ranked.join(firsts, same, "inner").select(*(ranked[c] for c in rows.columns), "_turn", "_first")
    return joined.orderBy("_turn", "_first").limit(n).drop("_turn", "_first")


def first_of_each(rows: DataFrame, kind: str, order: Sequence[str], kinds: Sequence[str]) -> DataFrame:
    """The first row of each of the named kinds."""
    others = [c for c in rows.columns if c != kind]
    found = rows.where(F.col(kind).isin(*kinds)).groupBy(kind).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("_r"))
    return found.select(kind, "_r.*")


def limited_with_exempt(rows: DataFrame, exempt: Column, order: Sequence[Column | str], n: int) -> DataFrame:
    """The first n rows that are not exempt, and all exempt ones outside the limit."""
    return rows.where(~exempt).orderBy(*order).limit(n).unionByName(rows.where(exempt))


def duplicates(rows: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once: key, n."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def repeated_at(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Each repetition of a key with the place of its first occurrence."""
    firsts = rows.groupBy(key).agg(F.min(position).alias("first_position"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return rows.join(firsts, key).where(F.col(position) > F.col("first_position")).select(key, position, "first_position")


def child_counts(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, conditions: dict[str, Column]) -> DataFrame:
    """Parents with the numbers of their children that meet each condition, 0 for none."""
    counts = children.groupBy(F.col(child_key).alias(parent_key)).agg(*(F.count_if(c).alias(name) for name, c in conditions.items()))
    return parents.join(counts, parent_key, "left").fillna(0, list(conditions))


def with_children(parents: DataFrame, children: DataFrame, key: str, child: Column, order: Column, name: str) -> DataFrame:
    """Parents with an array of their children in order, empty for none."""
    nested = children.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), child.alias("c")))).alias("_l"))
    kind = F.transform("_l", lambda x: x["c"])
    out = parents.join(nested.select(key, kind.alias(name)), key, "left")
    return out.withColumn(name, F.coalesce(name, F.array().cast(out.schema[name].dataType)))


def changed_headers(rows: DataFrame, group: Sequence[str], order: Sequence[str], header: Sequence[str]) -> DataFrame:
    """Rows with starts_header: whether the header differs from that of the row before in the group."""
    before = W.partitionBy(*group).orderBy(*order)
    now, last = F.struct(*header), F.lag(F.struct(*header)).over(before)
    return rows.withColumn("starts_header", last.isNull() | ~now.eqNullSafe(last))


def contiguous(rows: DataFrame, key: str, number: str) -> DataFrame:
    """key, n, is_contiguous: whether the numbers of a key are 1 to n, each once."""
    found = rows.groupBy(key).agg(F.count(number).alias("n"), F.min(number).alias("low"), F.max(number).alias("high"), F.count_distinct(number).alias("d"))
    return found.select(key, "n", ((F.col("low") == 1) & (F.col("high") == F.col("n")) & (F.col("d") == F.col("n"))).alias("is_contiguous"))
