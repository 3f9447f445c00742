"""Cards of results: bullets, profiles of size, and who gets one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.dates import local_display
from dossier.functions.segments import clipped
from dossier.functions.text import collapsed, is_blank, is_placeholder, meaningful

#: (items, characters of one) from the fullest to the shortest.
PROFILES = ((5, 160), (3, 100), (1, 60))
LIMIT = 4096


def bullets(items: Column, most: int, chars: int) -> Column:
    """Lines of the first items, each cut, and how many there are if not all are shown."""
    shown = F.transform(F.slice(items, 1, most), lambda x: F.concat(F.lit("• "), clipped(x, chars)))
    note = F.format_string("… %d / %d", F.lit(most), F.size(items))
    return F.array_join(F.when(F.size(items) > most, F.concat(shown, F.array(note))).otherwise(shown), "\n")


def card(title: Column, items: Column, profiles: Sequence[tuple[int, int]] = PROFILES, limit: int = LIMIT) -> Column:
    """The fullest card that fits the limit, else the shortest."""
    made = [F.concat_ws("\n", title, bullets(items, n, chars)) for n, chars in profiles]
    return F.coalesce(*(F.when(F.length(c) <= limit, c) for c in made[:-1]), made[-1])


def by_severity(barriers: Column, order: Sequence[str] = ("high", "medium", "low")) -> Column:
    """array<struct<severity, text>> by severity, unknown ones last, otherwise as they were."""
    place = lambda s: F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, order)), s), F.lit(0)), F.lit(len(order) + 1))
    ranked = F.transform(barriers, lambda b, i: F.struct(place(b["severity"]).alias("p"), i.alias("i"), b.alias("b")))
    return F.transform(F.array_sort(ranked), lambda r: r["b"])


def item_line(name: Column, quantity: Column, unit: Column) -> Column:
    return F.concat(name, F.when(quantity.isNotNull(), F.concat(F.lit(" — "), F.concat_ws(" ", quantity.cast("string"), unit))).otherwise(F.lit("")))


def delivery_state(summary: Column, deep_hash: Column, state_hash: Column, sent: Column, current_hash: Column, expired: Column) -> Column:
    """Why a result is not delivered, or eligible; the first that holds."""
    return (
        F.when(summary.isNull(), "incomplete")
        .when(~deep_hash.eqNullSafe(state_hash), "stale")
        .when(sent, "already_sent")
        .when(~current_hash.eqNullSafe(deep_hash), "stale")
        .when(expired, "expired")
        .otherwise("eligible")
    )


def deliverable(states: DataFrame, deep: DataFrame, deliveries: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Completed announcements with delivery: states(key, input_hash, expired), deep(key, input_hash, summary), deliveries(key, input_hash, status), current(key, input_hash)."""
    sent = deliveries.where("status = 'sent'").select(key, F.col("input_hash").alias("deep_hash")).distinct().withColumn("sent", F.lit(True))
    rows = (
        states.withColumnRenamed("input_hash", "state_hash")
        .join(deep.select(key, F.col("input_hash").alias("deep_hash"), "summary"), key, "left")
        .join(sent, [key, "deep_hash"], "left")
        .join(current.select(key, F.col("input_hash").alias("current_hash")), key, "left")
    )
    state = delivery_state(F.col("summary"), F.col("deep_hash"), F.col("state_hash"), F.coalesce("sent", F.lit(False)), F.col("current_hash"), F.col("expired"))
    return rows.select(key, state.alias("delivery"))


def delivered_result(deliveries: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """deliveries (key, input_hash) with result and available: the result of their key, if it is of the version that was delivered."""
    now = results.select(key, F.col("input_hash").alias("_hash"), F.col("result").alias("_result"))
    same = F.coalesce(F.col("_hash") == F.col("input_hash"), F.lit(False))
    return deliveries.join(now, key, "left").withColumns({"result": F.when(same, F.col("_result")), "available": same}).drop("_hash", "_result")


def callback_context(deliveries: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """(key, input_hash) -> key, deadline as shown, value; both null unless the current content (key, input_hash, deadline, value) is that version."""
    now = current.select(key, F.col("input_hash").alias("_hash"), F.col("deadline").alias("_deadline"), F.col("value").alias("_value"))
    same = F.col("_hash") == F.col("input_hash")
    return deliveries.join(now, key, "left").select(key, F.when(same, local_display(F.col("_deadline"))).alias("deadline"), F.when(same, F.col("_value")).alias("value"))


def field_lines(fields: dict[str, Column]) -> Column:
    """Name: value of the fields that say something, whole."""
    lines = F.array(*(F.when(~is_blank(c), F.concat(F.lit(f"{name}: "), collapsed(c))) for name, c in fields.items()))
    return F.filter(lines, lambda x: x.isNotNull())


def barrier_lines(barriers: Column) -> Column:
    """Lines of array<struct<label, description>>: the description, and the label after it unless the description says it in any case."""
    said = lambda b: F.contains(F.lower(b["description"]), F.lower(b["label"]))
    return F.transform(barriers, lambda b: F.concat(F.lit("• "), b["description"], F.when(said(b), F.lit("")).otherwise(F.concat(F.lit(" — "), b["label"]))))


# Words of the lines that cards have.
LOT, LOTS_ARE, MENTIONS_LOTS = "Лот", "Лотов", "лот"
LOGISTICS_LINES = (("service", "Услуга"), ("cargo", "Груз"), ("route", "Маршрут"), ("transport_mode", "Вид транспорта"))


def lot_line(number: Column, description: Column) -> Column:
    """A lot's description behind its number; a lot without one says nothing."""
    said = meaningful(description)
    return F.when(said.isNotNull(), F.coalesce(F.concat(F.lit(f"{LOT} "), meaningful(number), F.lit(": "), said), said))


def named_item_line(name: Column, quantity: Column, unit: Column) -> Column:
    """An item's name and how much of it; one whose name is only a lot's number says nothing."""
    said = meaningful(name)
    much = F.nullif(F.concat_ws(" ", meaningful(quantity), meaningful(unit)), F.lit(""))
    return F.when(~is_placeholder(said), F.coalesce(F.concat(said, F.lit(" — "), much), said))


def logistics_lines(block: Column) -> Column:
    """Of struct<service, cargo, origin, destination, transport_mode> the lines that say something; null has none."""
    route = F.nullif(F.concat_ws(" → ", meaningful(block["origin"]), meaningful(block["destination"])), F.lit(""))
    said = {name: route if name == "route" else meaningful(block[name]) for name, _ in LOGISTICS_LINES}
    return F.filter(F.array(*(F.concat(F.lit(f"{label_}: "), said[name]) for name, label_ in LOGISTICS_LINES)), lambda x: x.isNotNull())


def procured_lines(items: Column, lots: Column, logistics: Column) -> Column:
    """What is bought: lines of array<struct<item_name, quantity, unit>>, or where these say nothing of array<struct<lot_number, description>>, then those of logistics."""
    told = lambda c, line: F.coalesce(F.filter(F.transform(c, line), lambda x: x.isNotNull()), F.array().cast("array<string>"))
    of_items = told(items, lambda i: named_item_line(i["item_name"], i["quantity"], i["unit"]))
    of_lots = told(lots, lambda x: lot_line(x["lot_number"], x["description"]))
    return F.concat(F.when(F.size(of_items) > 0, of_items).otherwise(of_lots), logistics_lines(logistics))


def quantity_lines(summary: Column, total_lots: Column) -> Column:
    """The summary of quantities, and the number of lots unless the summary speaks of lots."""
    said = meaningful(summary)
    lots = F.when(~F.coalesce(F.lower(said).contains(MENTIONS_LOTS), F.lit(False)), F.concat(F.lit(f"{LOTS_ARE}: "), total_lots.cast("string")))
    return F.filter(F.array(said, lots), lambda x: x.isNotNull())
