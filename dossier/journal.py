"""A journal of paid calls: numbered entries, each committed whole by the exclusive creation of one file.

A call is reserved before it is made.  A writer reads the entries there are, decides on
what they say, and creates the next number's file; where another writer was first, it
reads again and decides again.  So the check and the entry are one step, whichever
drivers share the folder, and an entry is there, whole, before a call goes out: what a
driver that dies leaves behind is an outstanding reservation, which stops the next
calls until somebody settles it.  An entry that settles carries the usage, so that
the ledger and the reservation change together.

Reservations, ledger and open blocks are derived from the entries by operators.accounts.
There is an entry or two for each paid call, so that reading them is cheap beside it.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.operators import accounts
from dossier.schemas import JOURNAL
from dossier.store import exists


class ReservationBlocked(Exception):
    """No call may be made now; the reason is the message."""


def create_exclusive(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a file with this text unless there is one; whole or not at all.

    On a local file system by a link, else by a rename that fails where the target exists, as HDFS has it.  A store
    without such a rename can't hold a journal.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs
    target, draft = hadoop.Path(path), hadoop.Path(f"{path.rpartition('/')[0]}/.draft-{uuid.uuid4().hex}")
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(draft, False)
    out.write(bytearray(text.encode()))
    out.hsync()
    out.close()
    try:
        if files.getUri().getScheme() != "file":
            return bool(files.rename(draft, target))
        at = lambda p: spark._jvm.java.io.File(p.toUri().getPath()).toPath()
        try:
            spark._jvm.java.nio.file.Files.createLink(at(target), at(draft))
        except Exception as e:
            if "FileAlreadyExistsException" in str(e):
                return False
            raise
        return True
    finally:
        files.delete(draft, False)


class Journal:
    """The journal in a folder; price gives a usage's cost."""

    def __init__(self, spark: SparkSession, base: str, price: Callable[[dict], Decimal], now: Callable[[], datetime] = lambda: datetime.now(UTC)) -> None:
        self.spark, self.path, self.price, self.now = spark, f"{base}/journal", price, now
        where = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(where)

    def last(self) -> int:
        """The number of the last entry, 0 if there is none."""
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        files = where.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = (s.getPath().getName().removesuffix(".json") for s in files.listStatus(where))
        return max((int(n) for n in names if n.isdigit()), default=0)

    def entries(self) -> DataFrame:
        if not self.last():
            return self.spark.createDataFrame([], JOURNAL)
        return self.spark.read.schema(JOURNAL).json(f"{self.path}/*.json")

    def _commit(self, decide: Callable[[DataFrame, int], dict | None]) -> dict | None:
        """Adds what decide(entries, number) says to the entries before this number; None adds nothing."""
        while True:
            number = self.last() + 1
            entry = decide(self.entries().where(F.col("seq") < number), number)
            if entry is None:
                return None
            entry = {"seq": number, "at": self.now().astimezone(UTC).isoformat()} | entry
            if create_exclusive(self.spark, f"{self.path}/{number:012d}.json", json.dumps(entry, default=str)):
                return entry
            if not exists(self.spark, f"{self.path}/{number:012d}.json"):
                raise OSError(f"entry {number} could not be created in {self.path}")

    def reserve(self, analysis_type: str, reference: str | None, estimate: Decimal, **more) -> int:
        """The number of a new reservation, which is stored when this returns; ReservationBlocked while one is outstanding or a block is open."""
        if estimate < 0:
            raise ValueError("an estimate is not negative")

        def decide(entries: DataFrame, number: int) -> dict:
            if reason := accounts.journal_reason(entries):
                raise ReservationBlocked(reason)
            return {"kind": "reserved", "reservation": number, "analysis_type": analysis_type, "reference": reference, "estimate": estimate} | more

        return self._commit(decide)["reservation"]

    def _outstanding(self, entries: DataFrame, reservation: int) -> None:
        if accounts.journal_reservations(entries.where(F.col("reservation") == reservation)).where(F.col("status").isin(*accounts.OUTSTANDING)).isEmpty():
            raise ValueError(f"reservation {reservation} is not outstanding")

    def settle(self, reservation: int, usage: dict, response_id: str | None = None, *, success: bool = True) -> Decimal | None:
        """The cost that the ledger takes; None for a response that it has already, which settles the reservation all the same."""
        if usage.get("input_tokens") is None and usage.get("output_tokens") is None:
            raise ValueError("a settlement needs the usage")
        cost = self.price(usage)

        def decide(entries: DataFrame, number: int) -> dict:
            self._outstanding(entries, reservation)
            known = response_id is not None and not accounts.journal_ledger(entries).where(F.col("response_id") == response_id).isEmpty()
            return {"kind": "settled", "reservation": reservation, "response_id": response_id, "usage": usage, "cost": None if known else cost, "success": success}

        made = self._commit(decide)
        return made["cost"]

    def unresolved(self, reservation: int, note: str) -> None:
        """Whether the call cost is not known: the reservation goes on blocking."""
        self._finish(reservation, "unresolved", note)

    def release(self, reservation: int, note: str) -> None:
        """The call is known not to have cost anything."""
        if not note or not note.strip():
            raise ValueError("a release needs a note")
        self._finish(reservation, "released", note)

    def _finish(self, reservation: int, kind: str, note: str) -> None:
        def decide(entries: DataFrame, number: int) -> dict:
            self._outstanding(entries, reservation)
            return {"kind": kind, "reservation": reservation, "note": note}

        self._commit(decide)

    def open_block(self, usage: dict, failure: str, reservation: int | None = None, response_id: str | None = None) -> int:
        """Keeps the usage of an answer that could not be settled; calls stop until reconcile()."""
        return self._commit(lambda entries, number: {"kind": "block_opened", "block": number, "reservation": reservation, "usage": usage, "response_id": response_id, "note": failure})["seq"]

    def reconcile(self, note: str) -> list[dict]:
        """Writes the usage of every open block to the ledger once, and settles the reservations; one entry for each block."""
        if not note or not note.strip():
            raise ValueError("a reconciliation needs a note")
        done = []
        for row in accounts.open_blocks(self.entries()).orderBy("block").collect():  # each an answer that could not be settled
            usage = {k: v for k, v in row["usage"].asDict().items() if v is not None}

            def decide(entries: DataFrame, number: int, row=row, usage=usage) -> dict | None:
                if accounts.open_blocks(entries.where(F.col("block") == row["block"])).isEmpty():
                    return None
                known = row["response_id"] is not None and not accounts.journal_ledger(entries).where(F.col("response_id") == row["response_id"]).isEmpty()
                return {"kind": "reconciled", "block": row["block"], "reservation": row["reservation"], "usage": usage, "response_id": row["response_id"], "cost": None if known else self.price(usage), "note": note}

            if made := self._commit(decide):
                done.append({"block": row["block"], "cost": made["cost"]})
        return done

    def spent(self) -> Decimal:
        """What the ledger and the outstanding reservations of this month hold."""
        month = self.now().astimezone(UTC).strftime("%Y-%m")
        return accounts.journal_committed(self.entries()).where(F.date_format("month", "yyyy-MM") == month).agg(F.sum("committed")).first()[0] or Decimal(0)
