"""A delivery run: eligible results as cards, once a version."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dossier.operators import cards, upsert


def outbox(rows: DataFrame, deliveries: DataFrame) -> DataFrame:
    """(resource_url, input_hash, delivery, title, items) -> resource_url, input_hash, attempt_count, card of the eligible versions that are not sent."""
    keys = ["resource_url", "input_hash"]
    wanted = rows.where("delivery = 'eligible'")
    attempts = upsert.begun_attempts(deliveries, wanted, keys)
    return wanted.join(attempts, keys).select(*keys, "attempt_count", cards.card(F.col("title"), F.col("items")).alias("card"))


def send(cards_out: DataFrame, sender: Callable[[str], bool], limit: int) -> list[dict]:
    """Sends the first limit cards from the driver, each on its own: a failure is recorded and the next one goes on."""
    sent = []
    for row in cards_out.orderBy("resource_url").limit(limit).collect():
        try:
            ok = bool(sender(row["card"]))
        except Exception:  # recorded as a failed attempt
            ok = False
        sent.append({"resource_url": row["resource_url"], "input_hash": row["input_hash"], "ok": ok})
    return sent
