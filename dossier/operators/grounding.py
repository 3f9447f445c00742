"""Quotes and the texts that they must come from.

A source goes once through one automaton (Aho and Corasick) of all quotes that are looked
for in it.  Where a quote names no source, all sources are read once for all quotes (lookup).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, StructType

from dossier.functions.text import collapsed
from dossier.operators import lookup
from dossier.store import spread

FEW = 4  #: quotes that are looked for one by one
MOST_QUOTES = 10_000  #: quotes of one automaton


def found_in(quotes: list[str], text: str, automaton=None) -> set[str]:
    """The quotes that the text holds; automaton is one of these quotes."""
    if automaton is None and len(quotes) <= FEW:
        return {q for q in quotes if q in text}
    automaton = automaton or automaton_of(quotes)
    found: set[str] = set()
    for _, quote in automaton.iter(text):
        found.add(quote)
        if len(found) == len(quotes):
            break
    return found


def automaton_of(quotes: list[str]):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for quote in quotes:
        automaton.add_word(quote, quote)
    automaton.make_automaton()
    return automaton


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for quotes, source in zip(batch.column("_quotes").to_pylist(), batch.column("_source"), strict=True):
            asked = sorted({q for q in quotes if q})
            found = found_in(asked, source.as_py()) if asked and source.is_valid else set()
            out.append([q in found for q in quotes])
        kept = [n for n in batch.schema.names if n not in ("_quotes", "_source")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(out, pa.list_(pa.bool_()))], names=[*kept, "_found"])


def grounded(quotes: DataFrame, sources: DataFrame, key: str, quote: str = "quote", text: str = "text") -> DataFrame:
    """quotes with grounded: whether the quote, white space collapsed, is in the source of its key.  Case and Unicode form count; a blank quote or missing source is not grounded.

    A source moves once for MOST_QUOTES quotes of its key.
    """
    names = quotes.columns
    numbered = quotes.select(F.col(key).alias("_key"), F.struct(*names).alias("_row"), collapsed(F.col(quote)).alias("_quote"), F.row_number().over(W.partitionBy(key).orderBy(quote)).alias("_n"))
    numbered = numbered.withColumn("_part", F.when(F.col("_key").isNull(), F.lit(0)).otherwise(F.floor(F.col("_n") / MOST_QUOTES)))
    asked = numbered.where("_key IS NOT NULL").groupBy("_key", "_part").agg(F.collect_list("_row").alias("_rows"), F.collect_list(F.coalesce("_quote", F.lit(""))).alias("_quotes"))
    plain = sources.select(F.col(key).alias("_key"), collapsed(F.col(text)).alias("_source"))
    joined = asked.join(plain, "_key").select("_key", "_rows", "_quotes", "_source")
    schema = StructType([f for f in joined.schema.fields if f.name in ("_key", "_rows")]).add("_found", ArrayType(BooleanType()))
    answered = joined.mapInArrow(_answered, schema).select(F.explode(F.arrays_zip("_rows", "_found")).alias("_x")).select("_x._rows.*", F.col("_x._found").alias("grounded"))
    alone = quotes.join(sources.select(key), key, "left_anti").withColumn("grounded", F.lit(False))
    return answered.unionByName(alone.select(*names, "grounded"))


def found_sources(quotes: DataFrame, sources: DataFrame, quote_id: str, key: str, quote: str = "quote", text: str = "text", most_bytes: int = 64 << 20) -> DataFrame:
    """(quote_id, quote) looked for in all sources (key, text): quote_id, n_sources, first_source (the smallest key), white space collapsed.

    Blank and null quotes are nowhere, and so have 0 and null.  Sources are dealt to tasks and read once, whatever the number of quotes,
    of which the tasks have most_bytes at the most: a bitset.
    """
    asked = quotes.select(quote_id, collapsed(F.col(quote)).alias("_quote"))
    plain = spread(sources.select(F.col(key).alias("_key"), collapsed(F.col(text)).alias("_source")), "_key", "_source")
    found = lookup.holders(asked, plain, "_quote", "_key", "_source", most_bytes).groupBy("_quote").agg(F.count(F.lit(1)).alias("n_sources"), F.min("_key").alias("first_source"))
    asked = asked.withColumn("_quote", F.col("_quote").cast("binary"))
    return asked.join(found, "_quote", "left").select(quote_id, F.coalesce("n_sources", F.lit(0)).cast("long").alias("n_sources"), "first_source")


def evidence_grounding(results: DataFrame, sources: DataFrame, result: str, evidence: str = "evidence") -> DataFrame:
    """Results (result, evidence array<struct<source, text>>) with ungrounded: the numbers from 0 of the evidence whose text is not in its source (source, text).

    Evidence without a source, or of a source that there is none of, is not grounded; no evidence gives no numbers.
    """
    items = results.select(F.col(result).alias("_result"), F.posexplode(evidence).alias("_place", "_item"))
    quotes = items.select("_result", "_place", F.col("_item.source").alias("source"), F.col("_item.text").alias("quote"))
    bad = grounded(quotes, sources, "source").where("NOT grounded").groupBy("_result").agg(F.array_sort(F.collect_list("_place")).alias("_bad"))
    joined = results.join(bad, results[result].eqNullSafe(bad["_result"]), "left")
    return joined.select(*(results[c] for c in results.columns), F.coalesce("_bad", F.array().cast("array<int>")).alias("ungrounded"))


def grounded_by_content(quotes: DataFrame, sources: DataFrame, canonical: DataFrame, key: str, quote: str = "quote", text: str = "text") -> DataFrame:
    """As grounded, where a document without a text of its own stands for the canonical one of its content."""
    resolved = quotes.join(canonical.select(key, "canonical_id"), key, "left").withColumn("_own", F.col(key)).withColumn(key, F.coalesce("canonical_id", key))
    return grounded(resolved, sources, key, quote, text).withColumn(key, F.col("_own")).drop("_own", "canonical_id")


def catalog(units: DataFrame, group: list[str], order: list[str], source: Column) -> DataFrame:
    """Units with ref, their number in the group from 1, and evidence_id."""
    number = F.row_number().over(W.partitionBy(*group).orderBy(*order))
    return units.withColumn("ref", number).withColumn("evidence_id", source)


def document_unit_id(document: Column, content_hash: Column, number: Column) -> Column:
    return F.concat(F.lit("ev_doc_"), document.cast("string"), F.lit("_"), F.substring(content_hash, 1, 6), F.lit("_"), F.lpad(number.cast("string"), 4, "0"))


def resolved_refs(answers: DataFrame, catalog_rows: DataFrame, group: list[str], refs: str = "refs") -> DataFrame:
    """Units that answers refer to by number: group, position, ref, evidence_id, valid.  Numbers outside the catalog and repeated ones are not valid."""
    asked = answers.select(*group, F.posexplode(refs).alias("position", "ref"))
    repeated = F.count(F.lit(1)).over(W.partitionBy(*group, "ref")) > 1
    asked = asked.withColumn("_repeated", repeated)
    joined = asked.join(catalog_rows.select(*group, "ref", "evidence_id"), [*group, "ref"], "left")
    return joined.select(*group, "position", "ref", "evidence_id", (F.col("evidence_id").isNotNull() & ~F.col("_repeated")).alias("valid"))


def quote_variants(c: Column) -> Column:
    """The text and its form inside JSON."""
    json = F.to_json(F.struct(c.alias("v")))
    return F.array(c, F.substring(json, F.lit(7), F.length(json) - 8))


def leaf_texts(json: Column) -> Column:
    """The strings and numbers at the leaves of a JSON value, as texts; names, true, false and null are none."""
    token = F.regexp_extract_all(json, F.lit(r'"(?:[^"\\]|\\.)*"(?:\s*:)?|-?[0-9][0-9.eE+-]*'), F.lit(0))
    leaf = F.filter(token, lambda x: ~x.rlike(r":$"))
    return F.transform(leaf, lambda x: F.when(x.startswith('"'), F.try_variant_get(F.try_parse_json(x), "$", "string")).otherwise(x))


def source_variants(text: Column, json: Column) -> Column:
    """All texts in which a quote may stand: a flat text and its JSON form, or of a nested value its JSON, its leaves and the leaves' JSON forms."""
    flat = quote_variants(text)
    nested = F.concat(F.array(json), leaf_texts(json), F.flatten(F.transform(leaf_texts(json), quote_variants)))
    return F.when(json.isNull(), flat).otherwise(nested)


def quoted_in(variants: Column, quote: Column) -> Column:
    """Whether a quote is in one of the texts, white space collapsed; a blank one never."""
    plain = collapsed(quote)
    return F.coalesce((plain != "") & F.exists(variants, lambda v: collapsed(v).contains(plain)), F.lit(False))


def field_pieces(fields: dict[str, Column]) -> Column:
    """array<struct<field, number, text>> of texts and arrays of texts by field, in the given order; nulls and empty ones have no piece."""


    def pieces(name: str, c: Column) -> Column:
        said = F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
        return F.transform(said, lambda x, i: F.struct(F.lit(name).alias("field"), i.cast("long").alias("piece"), x.alias("text")))

    return F.concat(*(pieces(name, c) for name, c in fields.items()))


def catalog_ids(kind: Column, field: Column, number: Column) -> Column:
    """Ids of units of fields: ev_ann_ or ev_enr_, the field and the number from 0."""
    return F.concat(F.when(kind == "announcement", "ev_ann_").otherwise("ev_enr_"), field, F.lit("_"), number.cast("string"))


def repeated_ids(units: DataFrame, group: list[str]) -> DataFrame:
    """Ids that a catalogue must not hold twice, with their number: a catalogue with any is unusable."""
    return units.groupBy(*group, "evidence_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
