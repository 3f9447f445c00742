"""Contexts of announcements: contents once each, previews within a budget, coverage, hashes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dossier.functions import canonical, rules, urls


def content_groups(docs: DataFrame, id_column: str, name_column: str | None = None, text: str = "text") -> DataFrame:
    """One row a content: content_hash, canonical_id (smallest by id as text), members, chars; empty texts have none."""
    name = F.coalesce(F.col(name_column), F.lit("")) if name_column else F.lit("")
    order = F.struct(F.col(id_column).cast("string"), name)
    rows = docs.where(F.length(text) > 0)
    grouped = rows.groupBy(F.sha2(text, 256).alias("content_hash")).agg(F.min_by(id_column, order).alias("canonical_id"), F.count(F.lit(1)).alias("members"), F.first(F.length(text)).alias("chars"))
    return grouped


def represented(docs: DataFrame, id_column: str, text: str = "text") -> DataFrame:
    """Each document beside the canonical one of its content: id, canonical_id."""
    keyed = docs.where(F.length(text) > 0).select(id_column, F.sha2(text, 256).alias("content_hash"))
    order = F.col(id_column).cast("string")
    canonical = keyed.groupBy("content_hash").agg(F.min_by(id_column, order).alias("canonical_id"))
    return keyed.join(canonical, "content_hash").select(id_column, "canonical_id")


def previews(docs: DataFrame, group: Sequence[str], order: Sequence[str], budget: int, text: str = "text") -> DataFrame:
    """The documents of a group in order until their texts fill a budget of characters: the columns of docs but the text, preview, truncated."""
    rows = docs.where(F.length(text) > 0)
    before = F.coalesce(F.sum(F.length(text).cast("long")).over(W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    taken = F.least(F.length(text).cast("long"), F.lit(budget) - before)
    out = rows.withColumn("_taken", taken).where(F.col("_taken") > 0)
    return out.withColumns({"preview": F.substring(F.col(text), F.lit(1), F.col("_taken").cast("int")), "truncated": F.col("_taken") < F.length(text)}).drop(text, "_taken")


def coverage(documents: DataFrame, known: DataFrame, key: str, processing: DataFrame) -> DataFrame:
    """For each announcement of known (key, known_names array): counts by extraction status, unsupported extensions, chars, complete.

    documents has key, member_name, status, text; processing has key and status of the last attempt.
    """
    name = F.col("member_name")
    missing = F.coalesce(F.nullif(urls.extension(name), F.lit("")), F.lit("(no extension)"))
    counts = documents.groupBy(key).agg(
        F.count_if(F.col("status") == "success").alias("successful"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.array_sort(F.collect_set(F.when(F.col("status") == "skipped", missing))).alias("skipped_extensions"),
        F.sum(F.when(F.col("status") == "success", F.length("text")).otherwise(0)).alias("chars"),
    )
    both = known.join(counts, key, "left").join(processing.select(key, F.col("status").alias("processing")), key, "left")
    extension = lambda x: F.coalesce(F.nullif(urls.extension(urls.base_name(x)), F.lit("")), F.lit("(no extension)"))
    unreadable = F.filter(F.transform("known_names", extension), lambda e: ~e.isin(*(f".{x}" for x in urls.READABLE_FILES)))
    unsupported = F.array_sort(F.array_union(F.coalesce("skipped_extensions", F.array().cast("array<string>")), unreadable))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    complete = rules.coverage_complete(zero("failed"), zero("skipped"), F.size(unsupported), F.col("processing"), F.size("known_names"), zero("successful"))
    return both.select(key, *(zero(c).alias(c) for c in ("successful", "failed", "skipped", "chars")), unsupported.alias("unsupported"), complete.alias("complete"))


def known_names(kind: Column, documents: Column, document_url: Column, resource_url: Column) -> Column:
    """Names of the documents that an announcement of a resource type is known to have, read or not."""
    one = lambda c: F.filter(F.array(c), lambda x: x.isNotNull() & (x != ""))
    listed = F.filter(F.transform(F.coalesce(documents, F.array().cast("array<struct<filename:string>>")), lambda d: d["filename"]), lambda x: x.isNotNull() & (x != ""))
    none = F.array().cast("array<string>")
    return F.when(kind == "armeps_documents_page", listed).when(kind == "eauction_tender_page", one(document_url)).when(kind == "direct_file", one(resource_url)).otherwise(none)


def metrics(counts: dict[str, Column]) -> Column:
    """Map of the counts that are known."""
    pairs = [x for n, c in counts.items() for x in (F.lit(n), c.cast("long"))]
    return F.map_filter(F.create_map(*pairs), lambda _, v: v.isNotNull())


def nested(announcements: DataFrame, enrichments: DataFrame, documents: DataFrame, coverage_: DataFrame, key: str, announcement: Sequence[str], enrichment: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The whole context of each announcement that has an enrichment: key, announcement, enrichment, document_coverage, documents.

    documents are structs of all columns but key, in order, an empty array for none; coverage_ has key and its facts.
    """
    rest = [c for c in documents.columns if c != key]
    lists = documents.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*rest).alias("d")))).alias("l"))
    entries = lists.select(key, F.transform("l", lambda x: x["d"]).alias("documents"))
    facts = coverage_.select(key, F.struct(*(c for c in coverage_.columns if c != key)).alias("document_coverage"))
    joined = announcements.select(key, F.struct(*announcement).alias("announcement")).join(enrichments.select(key, F.struct(*enrichment).alias("enrichment")), key)
    out = joined.join(facts, key, "left").join(entries, key, "left")
    return out.withColumn("documents", F.coalesce("documents", F.array().cast(out.schema["documents"].dataType)))


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON of named values by name, nulls kept."""
    return F.to_json(F.struct(*(c.alias(n) for n, c in sorted(fields.items()))), {"ignoreNullFields": "false"})


def input_hash(fields: dict[str, Column]) -> Column:
    """The engine's own content hash; equal for equal values whatever their order here."""
    return F.sha2(canonical_json(fields), 256)


def context_hash(contexts: DataFrame, key: str) -> DataFrame:
    """key, input_hash: of all other columns, at any depth, by their names' order; so is the text that a Python client of the same values would hash."""
    fields = StructType([f for f in contexts.schema.fields if f.name != key])
    return contexts.select(key, F.sha2(canonical.canonical_json(F.struct(*fields.names), fields), 256).alias("input_hash"))


def backfill_reasons(downloads: DataFrame, extractions: DataFrame, key: str) -> DataFrame:
    """Downloads to be extracted again and why: key, reasons."""
    level = (F.length("member_name") - F.length(F.replace(F.col("member_name"), F.lit("!/"), F.lit("")))) / 2 + 1
    extension = urls.extension(F.col("member_name"))
    readable = (extension == ".xlsx") | (extension == ".docx") | ((extension == ".zip") & (level < 2))
    counts = extractions.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "failed").alias("failed"), F.count_if((F.col("status") == "skipped") & readable).alias("readable"))
    both = downloads.select(key).join(counts, key, "left")
    reasons = F.filter(
        F.array(
            F.when(F.col("n").isNull(), "no_extraction"),
            F.when(F.col("failed") > 0, "failed_extraction"),
            F.when(F.col("readable") > 0, "skipped_supported_members"),
        ),
        lambda r: r.isNotNull(),
    )
    return both.select(key, reasons.alias("reasons")).where(F.size("reasons") > 0)
