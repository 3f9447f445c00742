"""What results of triage and deep analysis, and golden cases, must be like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dossier.functions.constraints import Fields, Flag, Items, OneOf, Text, Whole, is_true, json_errors, present, said
from dossier.operators.validators import BARRIERS, CONFIDENCE, RELEVANCE, SOURCES, TYPES

# The fields of each part.
SAID = Text()
MAYBE = Text(nullable=True, blank=True)
TEXTS = Items(Text(), nullable=True)
EVIDENCE = Fields({"source_type": OneOf(SOURCES), "field": MAYBE, "download_id": Whole(nullable=True), "member_name": MAYBE, "text": Text(most=500)})
DEEP_EVIDENCE = Fields(EVIDENCE.fields | {"evidence_id": Text()}, optional=("evidence_id",))
BRAND = Fields({"specified_brand": MAYBE, "equivalent_allowed": Flag(nullable=True)}, nullable=True)
ITEM = Fields(
    {"item_name": SAID, "lot_number": MAYBE, "quantity": MAYBE, "unit": MAYBE, "key_specifications": TEXTS, "brand_or_equivalent": BRAND, "evidence": Items(DEEP_EVIDENCE, least=1)}, optional=("brand_or_equivalent",)
)
LOT = Fields({"lot_number": SAID, "description": MAYBE, "item_count": Whole(nullable=True, least=0), "evidence": Items(DEEP_EVIDENCE)})
PROCUREMENT = Fields(
    {name: MAYBE for name in ("subject", "quantity_summary", "delivery_location", "delivery_deadline", "warranty", "estimated_value_amd")}
    | {"total_lots": Whole(nullable=True, least=0), "brand_or_equivalent": BRAND, "items": Items(ITEM, nullable=True), "lots": Items(LOT, nullable=True)}
    | {name: TEXTS for name in ("technical_requirements", "country_of_origin_requirements", "certifications")},
    nullable=True,
)
LOGISTICS = Fields(
    {name: MAYBE for name in ("service", "cargo", "origin", "destination", "transport_mode", "weight", "volume", "frequency", "customs_requirements", "insurance_requirements", "special_conditions")}, nullable=True
)
BARRIER = Fields({"type": OneOf(BARRIERS), "description": SAID, "severity": OneOf(CONFIDENCE), "evidence": Items(DEEP_EVIDENCE, least=1)})
CONFLICT = Fields({"sources": Items(OneOf(SOURCES), least=1), "conflict_description": SAID, "impact": SAID})

_with_procurement = lambda m: F.coalesce(said(m, "opportunity_type").isin("procurement", "logistics_and_procurement"), F.lit(False))
_with_logistics = lambda m: F.coalesce(said(m, "opportunity_type").isin("logistics", "logistics_and_procurement"), F.lit(False))
_known_type = lambda m: F.coalesce(said(m, "opportunity_type").isin(*TYPES), F.lit(False))
_status = lambda m, *values: F.coalesce(said(m, "relevance_status").isin(*values), F.lit(False))
_unclear = lambda m: F.coalesce(said(m, "opportunity_type") == "unclear", F.lit(False))

TRIAGE = Fields(
    {"relevance_status": OneOf(RELEVANCE), "opportunity_type": OneOf(TYPES), "category": MAYBE, "confidence": OneOf(CONFIDENCE), "reason": SAID, "requires_deep_analysis": Flag(), "evidence": Items(EVIDENCE)},
    checks={
        "unclear without maybe": lambda m: _unclear(m) & _status(m, "relevant", "not_relevant"),
        "deep analysis of what is not relevant": lambda m: _status(m, "not_relevant") & is_true(m, "requires_deep_analysis"),
        "no deep analysis": lambda m: _status(m, "relevant", "maybe") & ~is_true(m, "requires_deep_analysis"),
    },
)
DEEP = Fields(
    {
        "summary": SAID, "opportunity_type": OneOf(TYPES), "category": MAYBE, "why_interesting": SAID, "contracting_authority": MAYBE, "procedure_code": MAYBE, "confidence": OneOf(CONFIDENCE),
        "participation_barriers": Items(BARRIER), "missing_information": TEXTS, "source_conflicts": Items(CONFLICT), "manual_review_required": Flag(), "evidence": Items(DEEP_EVIDENCE),
        "procurement": PROCUREMENT, "logistics": LOGISTICS,
    },
    checks={
        "needs procurement": lambda m: _with_procurement(m) & ~present(m, "procurement"),
        "must not have procurement": lambda m: _known_type(m) & ~_with_procurement(m) & present(m, "procurement"),
        "needs logistics": lambda m: _with_logistics(m) & ~present(m, "logistics"),
        "must not have logistics": lambda m: _known_type(m) & ~_with_logistics(m) & present(m, "logistics"),
    },
)
#: Types of golden cases, and those that need no category.
GOLDEN_TYPES, WITHOUT_CATEGORY = ("procurement", "other_service", "unrelated", "unclear"), ("unrelated", "unclear")
GOLDEN = Fields(
    {
        "case_id": SAID, "resource_url": SAID, "title": SAID, "input_hash": Text(pattern="^[0-9a-f]{64}\\z"),
        "expected": Fields(
            {"relevance_status": OneOf(RELEVANCE), "opportunity_type": OneOf(GOLDEN_TYPES), "category": Text(nullable=True), "expected_reason": SAID, "notes": MAYBE},
            checks={
                "needs a category": lambda m: F.coalesce(said(m, "opportunity_type").isin(*(t for t in GOLDEN_TYPES if t not in WITHOUT_CATEGORY)), F.lit(False)) & F.map_contains_key(m, F.lit("category")) & ~present(m, "category"),
                "unclear without maybe": lambda m: _unclear(m) & _status(m, "relevant", "not_relevant"),
            },
        ),
    },
    others=True,
)


def triage_faults(json: Column) -> Column:
    return json_errors(TRIAGE, json)


def deep_faults(json: Column) -> Column:
    return json_errors(DEEP, json)


def golden_faults(cases: DataFrame, key: str, json: str) -> DataFrame:
    """key, fault: all faults of a set of golden cases, a row each; ids and addresses that earlier cases (by key) have too are faults of the later ones."""
    found = cases.select(key, F.explode(json_errors(GOLDEN, F.col(json))).alias("fault"))
    value = F.try_parse_json(F.col(json))
    for name in ("case_id", "resource_url"):
        part = F.try_variant_get(value, f"$.{name}", "variant")
        named = cases.select(key, F.when(F.schema_of_variant(part) == "STRING", F.try_variant_get(value, f"$.{name}", "string")).alias("_said")).where("_said IS NOT NULL")
        firsts = named.groupBy("_said").agg(F.min(key).alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
        again = named.join(firsts, "_said").where(F.col(key) != F.col("_first"))
        found = found.unionByName(again.select(key, F.lit(f"$.{name}: repeated").alias("fault")))
    return found
