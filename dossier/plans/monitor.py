"""An ingest run: landed list and detail pages become announcements and enrichments.

Fetching is outside the engine: pages are landed as (url, html) and files as rows of
bytes.  A page that can't be read is a failed row and holds up nothing else.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier import schemas
from dossier.functions import dates, rules, text, urls
from dossier.operators import candidates, upsert
from dossier.sources import html, office


@dataclass
class Site:
    """How a site's pages are read: URL rules, the labels of its detail pages, those whose values are classification lines, fields that are whole numbers, and what marks the link to the documents."""

    rules: list[tuple[str, str | None, str]]
    labels: dict[str, str]
    required: tuple[str, ...]
    classifications: dict[str, str] = field(default_factory=dict)
    counts: tuple[str, ...] = ()
    document_marker: str | None = None


def announcements(list_pages: DataFrame, site: Site) -> DataFrame:
    """(url, section, section_name, html) -> announcements with position, in page order."""
    pages = list_pages.select(F.struct("url", "section", "section_name").alias("page"), "html")
    nodes = html.nodes(pages, "page", tags=("div", "a", "p"), said=("a", "p"))
    items = html.list_items(nodes, "page", (F.col("tag") == "div") & html.has_class("tender"), (F.col("tag") == "div") & html.has_class("tender_title"), (F.col("tag") == "p") & html.has_class("tender_time"))
    joined = items.select("page.*", "item_node", "title", "href", "raw_time")
    return joined.select(
        F.col("href").alias("resource_url"), "title", F.col("section").alias("source_section"), F.col("section_name").alias("source_section_name"), F.col("url").alias("source_page_url"),
        urls.classified(F.col("href"), site.rules).alias("resource_type"), dates.first_datetime(F.col("raw_time")).alias("published_at"),
        dates.until_datetime(F.col("raw_time")).alias("deadline_at"), F.col("raw_time").alias("tender_time_raw"), F.struct("section", "url", "item_node").alias("position"),
    )


def section_runs(list_pages: DataFrame) -> DataFrame:
    """(section, url, html) -> section, pages, failed (not landed or blank), whole; a failed page leaves the others as they are."""
    failed = text.is_blank(F.col("html"))
    runs = list_pages.groupBy("section").agg(F.count(F.lit(1)).alias("pages"), F.count_if(failed).alias("failed"))
    return runs.withColumn("whole", F.col("failed") == 0)


def ingest(stored: DataFrame, given: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """The next snapshot of announcements and the status of each given row, taken in order."""
    keys, fields, needed = ["resource_url"], list(schemas.ANNOUNCEMENT_FIELDS), list(schemas.ANNOUNCEMENT_REQUIRED)
    statuses = upsert.batch_status(stored, given, keys, fields, "position", needed)
    good = given
    for c in needed:
        good = good.where(~text.is_blank(F.col(c)))
    last = candidates.latest(good.select(*keys, *fields, "position"), keys, ["position"]).drop("position")
    return upsert.upserted(stored, last, keys, fields, now, touch_existing=True), statuses


def enrichments(rows: DataFrame, detail_pages: DataFrame, site: Site) -> DataFrame:
    """Announcements with landed detail pages (url, html) -> fields by their labels, date matches and enrichment_status.

    Of a site that says so, counts are whole numbers (null where they are none), classification lines are array of struct(code, name), and
    document_url is the first link with the mark.
    """
    nodes = html.nodes(detail_pages, "url", tags=("dt", "dd", "div", *(("a",) if site.document_marker else ()), *((html.TEXT,) if site.classifications else ())))
    is_label = (F.col("tag") == "dt") | html.has_class("de_t") | html.has_class("fe_t")
    is_value = (F.col("tag") == "dd") | html.has_class("de_v") | html.has_class("fe_v")
    names = sorted(set(site.labels.values()))
    values = html.labelled_values(nodes, "url", is_label, is_value, site.labels).groupBy(F.col("url").alias("resource_url")).pivot("field", names).agg(F.first("value"))
    for c in [n for n in names if n.endswith("_at_detail")]:
        values = values.withColumn(c, dates.normal_datetime(F.col(c)))
    for c in site.counts:
        values = values.withColumn(c, text.natural_number(F.col(c)))
    joined = rows.select("resource_url", "published_at", "deadline_at").join(values.hint("merge"), "resource_url", "left")
    if site.classifications:
        fields = sorted(set(site.classifications.values()))
        lines = html.labelled_lines(nodes, "url", is_label, is_value, site.classifications).groupBy(F.col("url").alias("resource_url")).pivot("field", fields).agg(F.first("lines"))
        joined = joined.join(lines.select("resource_url", *(text.cpv_codes(F.col(c)).alias(c) for c in fields)).hint("merge"), "resource_url", "left")
    if site.document_marker:
        marked = html.first_link(nodes, "url", site.document_marker).select(F.col("url").alias("resource_url"), F.col("href").alias("document_url"))
        joined = joined.join(marked.hint("merge"), "resource_url", "left")
    found = F.lit(True)
    for c in site.required:
        found = found & ~text.is_blank(F.col(c).cast("string"))
    status = F.when(found, "success").otherwise("partial")
    if "resource_type" in rows.columns:
        joined = joined.join(rows.select("resource_url", "resource_type"), "resource_url")
        status = rules.enrichment_status(F.col("resource_type"), F.when(found, 0).otherwise(1))
    matches = {f"{c}_match": dates.dates_match(F.col(c), F.col(f"{c}_detail")) for c in ("published_at", "deadline_at") if f"{c}_detail" in names}
    return joined.withColumns(matches | {"enrichment_status": status}).drop("published_at", "deadline_at")


def plans(rows: DataFrame) -> DataFrame:
    """(resource_url, resource_type, document_url, documents) -> resource_url and what to read; rows without a plan are left out."""
    plan = rules.document_plan(F.col("resource_type"), F.col("resource_url"), F.col("document_url"), F.col("documents"))
    return rows.select("resource_url", plan.alias("p")).where("p IS NOT NULL").select("resource_url", "p.*")


def extractions(planned: DataFrame, files: DataFrame, most_bytes: int = 50 << 20) -> DataFrame:
    """Plans with landed files (url, content, perhaps content_length) -> resource_url, sha256 and the members' texts.

    Too large files, pages instead of files and files of another length than was announced are failed rows.
    """
    landed = planned.join(files, planned["source_url"] == files["url"])
    length = F.octet_length("content")
    page = F.lower(F.decode(F.substring("content", 1, 200), "ISO-8859-1")).rlike("<!doctype html|<html")
    refused = F.when(length > most_bytes, "too many bytes").when(page, "a page instead of a file")
    if "content_length" in files.columns:
        refused = F.when(F.col("content_length") > most_bytes, "too many bytes").when(F.col("content_length") != length, "fewer bytes than announced").otherwise(refused)
    checked = landed.withColumn("refused", refused).withColumn("sha256", F.sha2("content", 256))
    good = checked.where("refused IS NULL").withColumn("path", F.lower("expected_filename"))
    texts = office.extracted(good, keys=("resource_url", "sha256"))
    done = texts.select("resource_url", "sha256", "member_name", "file_type", "status", "text", "error")
    failed = checked.where("refused IS NOT NULL").select("resource_url", "sha256", F.lit("").alias("member_name"), F.lit(None).cast("string").alias("file_type"), F.lit("failed").alias("status"), F.lit(None).cast("string").alias("text"), F.col("refused").alias("error"))
    return done.unionByName(failed)
