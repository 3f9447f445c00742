"""Constraints of results as arrays of errors: a row is valid if it has none."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.text import is_blank, is_snake_case

#: Fixed values of results.
RELEVANCE = ("relevant", "maybe", "not_relevant")
TYPES = ("logistics", "procurement", "logistics_and_procurement", "other_service", "unrelated", "unclear")
CONFIDENCE = ("high", "medium", "low")
SOURCES = ("announcement", "enrichment", "document")
BARRIERS = (
    "manufacturer_authorization", "official_dealer_required", "origin_restriction", "certification", "license", "medical_registration", "local_service_required",
    "experience_requirement", "financial_requirement", "bid_security", "contract_security", "short_delivery_deadline", "other",
)
#: Which types a triage may give with which relevance, and which of them have a category.
ALLOWED = {"relevant": ("procurement",), "maybe": ("unclear",), "not_relevant": ("other_service", "unrelated")}
WITH_CATEGORY = ("procurement", "other_service")


def errors(checks: dict[str, Column]) -> Column:
    """Names of the checks that hold; an unknown one counts as holding."""
    return F.filter(F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in checks.items())), lambda x: x.isNotNull())


def not_among(c: Column, values: Sequence[str]) -> Column:
    return c.isNull() | ~c.isin(*values)


def not_natural(c: Column) -> Column:
    return c.isNotNull() & (c < 0)


def key_errors(json: Column, keys: Sequence[str]) -> Column:
    """Keys of a JSON object that are too many or missing, as extra:k and missing:k."""
    given = F.coalesce(F.json_object_keys(json), F.array().cast("array<string>"))
    wanted = F.array(*map(F.lit, keys))
    extra = F.transform(F.array_sort(F.array_except(given, wanted)), lambda k: F.concat(F.lit("extra:"), k))
    missing = F.transform(F.array_sort(F.array_except(wanted, given)), lambda k: F.concat(F.lit("missing:"), k))
    return F.concat(extra, missing)


def evidence_errors(items: Column, sources: Sequence[str], most_chars: int = 500) -> Column:
    """Of array<struct<source_type, text>>: empty, bad_source, blank_text, long_text."""
    return errors({
        "empty": F.coalesce(F.size(items), F.lit(0)) <= 0,
        "bad_source": F.exists(F.coalesce(items, F.array().cast("array<struct<source_type:string,text:string>>")), lambda x: not_among(x["source_type"], sources)),
        "blank_text": F.exists(F.coalesce(items, F.array().cast("array<struct<source_type:string,text:string>>")), lambda x: is_blank(x["text"])),
        "long_text": F.exists(F.coalesce(items, F.array().cast("array<struct<source_type:string,text:string>>")), lambda x: F.coalesce(F.length(x["text"]) > most_chars, F.lit(False))),
    })


def triage_errors(status: Column, kind: Column, category: Column, confidence: Column, reason: Column, deep: Column) -> Column:
    fits = F.lit(False)
    for s, kinds in ALLOWED.items():
        fits = fits | ((status == s) & kind.isin(*kinds))
    return errors({
        "status": not_among(status, RELEVANCE),
        "type": not_among(kind, TYPES),
        "confidence": not_among(confidence, CONFIDENCE),
        "reason": is_blank(reason),
        "category": F.when(kind.isin(*WITH_CATEGORY), ~is_snake_case(category)).otherwise(category.isNotNull()),
        "pair": ~F.coalesce(fits, F.lit(False)),
        "deep_flag": (status == "not_relevant") & deep,
    })


def grounded_errors(found: Column, ungrounded: Column) -> Column:
    """The errors of a result with those of its evidence (see grounding.evidence_grounding), as ungrounded:number."""
    return F.concat(found, F.transform(ungrounded, lambda n: F.concat(F.lit("ungrounded:"), n.cast("string"))))


def response_kind(refusal: Column, status: Column, text: Column, valid: Column) -> Column:
    """What is wrong with an answer; null if nothing."""
    parsed = F.try_variant_get(F.try_parse_json(text), "$", "string")
    return (
        F.when(~is_blank(refusal), "refusal")
        .when(status == "incomplete", "incomplete")
        .when(status == "failed", "failed")
        .when(is_blank(text), "empty")
        .when(parsed.isNull(), "invalid_structured_output")
        .when(~F.ltrim(text).startswith("{"), "invalid_structured_output")
        .when(~valid, "validation")
    )


def barrier_errors(barriers: Column) -> Column:
    """Of array<struct<type, description, severity, evidence: array>>: bad_type, blank_description, bad_severity, no_evidence."""
    each = lambda bad: F.exists(F.coalesce(barriers, F.array().cast("array<struct<type:string,description:string,severity:string,evidence:array<string>>>")), bad)
    return errors({
        "bad_type": each(lambda b: not_among(b["type"], BARRIERS)),
        "blank_description": each(lambda b: is_blank(b["description"])),
        "bad_severity": each(lambda b: not_among(b["severity"], CONFIDENCE)),
        "no_evidence": each(lambda b: F.coalesce(F.size(b["evidence"]), F.lit(0)) <= 0),
    })


def conflict_errors(conflicts: Column) -> Column:
    """Of array<struct<sources: array<string>, conflict_description, impact>>: no_sources, bad_source, blank_description, blank_impact."""
    each = lambda bad: F.exists(F.coalesce(conflicts, F.array().cast("array<struct<sources:array<string>,conflict_description:string,impact:string>>")), bad)
    return errors({
        "no_sources": each(lambda c: F.coalesce(F.size(c["sources"]), F.lit(0)) <= 0),
        "bad_source": each(lambda c: F.exists(F.coalesce(c["sources"], F.array().cast("array<string>")), lambda s: not_among(s, SOURCES))),
        "blank_description": each(lambda c: is_blank(c["conflict_description"])),
        "blank_impact": each(lambda c: is_blank(c["impact"])),
    })


def primitive_errors(json: Column, kinds: dict[str, str]) -> Column:
    """Names of the fields of a JSON object that are not what they must be: text (not blank), text?, flag, flag?, count, count? or list.

    A question mark lets null stand; a missing field is null.  What is no object fails as object.
    """
    value = F.try_parse_json(json)
    checks = {"object": value.isNull() | ~F.ltrim(json).startswith("{")}
    for name, kind in kinds.items():
        part = F.try_variant_get(value, f"$.{name}", "variant")
        said = F.schema_of_variant(part)
        none = part.isNull() | (said == "VOID")
        number = F.try_variant_get(value, f"$.{name}", "bigint")
        right = {
            "text": (said == "STRING") & ~is_blank(F.try_variant_get(value, f"$.{name}", "string")),
            "flag": said == "BOOLEAN",
            "count": (said == "BIGINT") & (number >= 0),
            "list": said.startswith("ARRAY"),
        }[kind.rstrip("?")]
        if kind == "text?":
            right = said == "STRING"
        checks[name] = ~(F.coalesce(right, F.lit(False)) | (none if kind.endswith("?") else F.lit(False)))
    return errors(checks)


def procurement_errors(block: Column) -> Column:
    """Of struct<total_lots, items: array<struct<item_name, evidence>>, lots: array<struct<lot_number, item_count>>>: bad_total, items, bad_lot, bad_count; null has none."""
    lots = F.coalesce(block["lots"], F.array().cast("array<struct<lot_number:string,item_count:bigint>>"))
    found = errors({
        "bad_total": F.coalesce(block["total_lots"] < 0, F.lit(False)),
        "items": F.size(item_errors(block["items"])) > 0,
        "bad_lot": F.exists(lots, lambda x: is_blank(x["lot_number"])),
        "bad_count": F.exists(lots, lambda x: F.coalesce(not_natural(x["item_count"]), F.lit(False))),
    })
    return F.when(block.isNull(), F.array().cast("array<string>")).otherwise(found)


def item_errors(items: Column) -> Column:
    """Of array<struct<item_name, evidence: array>>: blank_name, no_evidence; an item can't be claimed without a quote."""
    each = lambda bad: F.exists(F.coalesce(items, F.array().cast("array<struct<item_name:string,evidence:array<string>>>")), bad)
    return errors({"blank_name": each(lambda x: is_blank(x["item_name"])), "no_evidence": each(lambda x: F.coalesce(F.size(x["evidence"]), F.lit(0)) <= 0)})


def deep_errors(summary: Column, why: Column, kind: Column, confidence: Column, has_procurement: Column, has_logistics: Column) -> Column:
    """Errors of a deep result: blocks must be there exactly for the types that have them."""
    return errors({
        "summary": is_blank(summary),
        "why_interesting": is_blank(why),
        "type": not_among(kind, TYPES),
        "confidence": not_among(confidence, CONFIDENCE),
        "procurement": kind.isin("procurement", "logistics_and_procurement") != has_procurement,
        "logistics": kind.isin("logistics", "logistics_and_procurement") != has_logistics,
    })
