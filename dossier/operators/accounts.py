"""Reservations and accounting blocks of paid calls, against stored tables and as states of a journal's entries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.text import is_blank
from dossier.operators import ledger
from dossier.operators.ledger import OUTSTANDING


def reserved(reservations: DataFrame, wanted: DataFrame, scope: Sequence[str], order: Column) -> DataFrame:
    """wanted with granted: of each scope the first by order, if the scope has no outstanding reservation; a null scope is one."""
    held = reservations.where(F.col("status").isin(*OUTSTANDING)).select(*(F.col(c).alias(f"_{c}") for c in scope)).distinct()
    firsts = wanted.groupBy(*(F.col(c).alias(f"_{c}") for c in scope)).agg(F.min(order).alias("_first"))
    same = lambda other: [wanted[c].eqNullSafe(other[f"_{c}"]) for c in scope]
    free = firsts.join(held, [firsts[f"_{c}"].eqNullSafe(held[f"_{c}"]) for c in scope], "left_anti")
    joined = wanted.join(free, same(free), "left")
    return joined.select(*(wanted[c] for c in wanted.columns), F.coalesce(order == F.col("_first"), F.lit(False)).alias("granted"))


def block_reason(outstanding: Column, open_blocks: Column, failed: Column) -> Column:
    """Why no call may be made: outstanding reservations, open blocks, a failure of this run, in this order; null if none."""
    return F.when(outstanding > 0, "outstanding_reservations").when(open_blocks > 0, "open_blocks").when(failed, "accounting_failed")


def block_reasons(reservations: DataFrame, blocks: DataFrame, scope: str) -> DataFrame:
    """scope, outstanding, open_blocks, reason for each scope of either table."""
    held = reservations.groupBy(scope).agg(F.count_if(F.col("status").isin(*OUTSTANDING)).alias("outstanding"))
    open_ = blocks.groupBy(scope).agg(F.count_if(F.col("resolved_at").isNull()).alias("open_blocks"))
    both = held.join(open_, scope, "full_outer").fillna(0, ["outstanding", "open_blocks"])
    return both.withColumn("reason", block_reason(F.col("outstanding"), F.col("open_blocks"), F.lit(False)))


def finished(reservations: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """reservations with the status that their answers (key, outcome, note) give, and error.

    Outcomes: settled, unresolved, released; only an outstanding reservation is finished, and a release needs a note.
    """
    joined = reservations.join(answers.select(key, "outcome", "note"), key, "left")
    outstanding = F.col("status").isin(*OUTSTANDING)
    error = F.when(F.col("outcome").isNotNull() & ~outstanding, "not outstanding").when((F.col("outcome") == "released") & is_blank(F.col("note")), "a release needs a note")
    return joined.withColumn("error", error).withColumn("status", F.when(F.col("outcome").isNotNull() & error.isNull(), F.col("outcome")).otherwise(F.col("status"))).drop("outcome", "note")


def settlement(reservations: DataFrame, usages: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """The ledger rows of settled reservations' usages (key, response_id, ...): a response that the ledger has, or that came before here, is not written again."""
    settled = usages.join(reservations.where("status = 'settled'").select(key), key, "left_semi")
    return ledger.appended(stored, settled)


def reconciled(blocks: DataFrame, stored: DataFrame, reservations: DataFrame, key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ledger rows to add, blocks that are closed, reservations after it): usage stored with open blocks is written once, and their reservations are settled."""
    open_ = blocks.where(F.col("resolved_at").isNull())
    added = ledger.appended(stored, open_)
    closed = open_.select(key).distinct()
    after = reservations.join(closed.withColumn("_closed", F.lit(True)), key, "left")
    status = F.when(F.col("_closed") & F.col("status").isin(*OUTSTANDING), "settled").otherwise(F.col("status"))
    return added, closed, after.withColumn("status", status).drop("_closed")


#: What each kind of entry makes of its reservation; entries of other kinds leave it as it is.
AFTER = {"reserved": "reserved", "settled": "settled", "unresolved": "unresolved", "released": "released", "reconciled": "settled"}


def journal_reservations(entries: DataFrame) -> DataFrame:
    """(seq, kind, reservation, ...) -> reservation, status, created_at, settled_at, estimate, cost, reference: what the entries up to the last say of each."""
    said = entries.where(F.col("kind").isin(*AFTER) & F.col("reservation").isNotNull())
    status = F.lit(None).cast("string")
    for kind, after in AFTER.items():
        status = F.when(F.col("kind") == kind, after).otherwise(status)
    said = said.withColumn("status", status)
    opened = F.col("kind") == "reserved"
    first = lambda c: F.min_by(F.when(opened, F.col(c)), F.when(opened, F.col("seq"))).alias(c)
    out = said.groupBy("reservation").agg(F.max_by("status", "seq").alias("status"), F.min(F.when(opened, F.col("at"))).alias("created_at"), F.max_by("at", "seq").alias("_at"), first("estimate"), first("reference"), F.max_by("cost", "seq").alias("cost"))
    return out.withColumn("settled_at", F.when(F.col("status") == "settled", F.col("_at"))).select("reservation", "status", "created_at", "settled_at", "estimate", "cost", "reference")


def journal_ledger(entries: DataFrame) -> DataFrame:
    """The entries with usage that the ledger takes: a response once, by its first entry, and those without a response id always."""
    paid = entries.where(F.col("kind").isin("settled", "reconciled"))
    named = paid.where(F.col("response_id").isNotNull()).groupBy("response_id").agg(F.min_by(F.struct(*(c for c in entries.columns if c != "response_id")), "seq").alias("row"))
    return named.select("row.*", "response_id").select(*entries.columns).unionByName(paid.where(F.col("response_id").isNull()))


def open_blocks(entries: DataFrame) -> DataFrame:
    """The blocks that no entry has reconciled."""
    closed = entries.where(F.col("kind") == "reconciled").select("block").where(F.col("block").isNotNull()).distinct()
    return entries.where(F.col("kind") == "block_opened").join(closed, "block", "left_anti")


def journal_reason(entries: DataFrame) -> str | None:
    """Why no call may be made now; None if one may."""
    held = journal_reservations(entries).where(F.col("status").isin(*OUTSTANDING)).agg(F.count(F.lit(1)).alias("outstanding"))
    blocks = open_blocks(entries).agg(F.count(F.lit(1)).alias("open_blocks"))
    return held.crossJoin(blocks).select(block_reason(F.col("outstanding"), F.col("open_blocks"), F.lit(False))).first()[0]  # two single rows


def journal_committed(entries: DataFrame) -> DataFrame:
    """month, spent, reserved, committed: costs by the month of their entry, estimates of outstanding reservations by that of the reservation."""
    usage = journal_ledger(entries).select("cost", F.col("at").alias("created_at"))
    held = journal_reservations(entries).select(F.col("estimate").alias("cost"), "created_at", "status")
    return ledger.committed(usage, held)
