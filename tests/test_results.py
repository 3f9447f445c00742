"""Compiled constraints against a plain reading of the same rules, on random values."""

import json
import random
import re

from pyspark.sql import functions as F

from dossier.functions import constraints as c
from dossier.operators import results


def faults(rule, value, path="$"):
    """The same rules, read one value at a time; without the checks between fields."""
    name = {c.Fields: "not an object", c.Items: "not a list", c.OneOf: "not one of the values", c.Text: "not a text", c.Flag: "not a flag", c.Whole: "not a whole number"}[type(rule)]
    if value is None:
        return [] if getattr(rule, "nullable", False) else [f"{path}: {name}"]
    kinds = {c.Fields: dict, c.Items: list, c.OneOf: str, c.Text: str, c.Flag: bool, c.Whole: int}
    if not isinstance(value, kinds[type(rule)]) or isinstance(rule, c.Whole) and isinstance(value, bool):
        return [f"{path}: {name}"]
    if isinstance(rule, c.OneOf):
        return [] if value in rule.values else [f"{path}: {name}"]
    if isinstance(rule, c.Text):
        bad = "blank" if not rule.blank and not value.strip() else "too long" if rule.most and len(value) > rule.most else "bad form" if rule.pattern and not re.fullmatch(r"[0-9a-f]{64}", value) else None
        return [f"{path}: {bad}"] if bad else []
    if isinstance(rule, c.Whole):
        return [f"{path}: too small"] if rule.least is not None and value < rule.least else []
    if isinstance(rule, c.Items):
        few = [f"{path}: too few"] if len(value) < rule.least else []
        return few + [f for i, x in enumerate(value) for f in faults(rule.item, x, f"{path}[{i}]")]
    if isinstance(rule, c.Fields):
        out = [] if rule.others else [f"{path}: unknown field {json.dumps(k, ensure_ascii=False)}" for k in sorted(set(value) - set(rule.fields))]
        for k, own in rule.fields.items():
            out += faults(own, value[k], f"{path}.{k}") if k in value else [] if k in rule.optional else [f"{path}.{k}: missing"]
        return out
    return []


def made(rule, rng, odd):
    """A value after a rule, each part of it odd with a chance."""
    if rng.random() < odd:
        return rng.choice([None, 1, -2, 1.5, 10**25, True, "", "  ", "x" * 501, [], [None], {}, {"é\n": 1}])
    if getattr(rule, "nullable", False) and rng.random() < 0.2:
        return None
    if isinstance(rule, c.OneOf):
        return rng.choice(rule.values)
    if isinstance(rule, c.Text):
        return "a" * 64 if rule.pattern else "text"
    if isinstance(rule, c.Flag):
        return rng.random() < 0.5
    if isinstance(rule, c.Whole):
        return rng.randrange(9)
    if isinstance(rule, c.Items):
        return [made(rule.item, rng, odd) for _ in range(rng.randrange(rule.least if rng.random() > odd else 0, rule.least + 3))]
    out = {k: made(r, rng, odd) for k, r in rule.fields.items() if rng.random() > (0.5 if k in rule.optional else odd / 2)}
    return out | {"other": 1} if rng.random() < odd else out


def test_random_values(spark):
    rng = random.Random(4)
    for rule in (results.TRIAGE, results.DEEP, results.GOLDEN):
        plain = c.Fields(rule.fields, rule.optional, rule.nullable, rule.others)
        values = [made(plain, rng, rng.choice([0, 0.02, 0.1, 0.4])) for _ in range(150)]
        rows = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=False)) for i, v in enumerate(values)], "id long, json string")
        without = c.Fields({k: c.Fields(r.fields, r.optional, r.nullable, r.others) if isinstance(r, c.Fields) else r for k, r in rule.fields.items()}, rule.optional, rule.nullable, rule.others)
        got = rows.select("id", c.json_errors(without, F.col("json")).alias("e")).collect()
        for r in got:
            assert r.e == faults(plain, values[r.id]), values[r.id]
        assert 20 < sum(not r.e for r in got) < 140


def judged(spark, faults_of, values):
    """The faults of JSON texts and values, worked out together."""
    texts = [(i, v if v is None or isinstance(v, str) else json.dumps(v)) for i, v in enumerate(values)]
    rows = spark.createDataFrame(texts, "id long, json string").select("id", faults_of(F.col("json")).alias("e")).collect()
    return [r.e for r in sorted(rows)]


def test_between_fields(spark):
    triage = {"relevance_status": "relevant", "opportunity_type": "procurement", "category": None, "confidence": "high", "reason": "r", "requires_deep_analysis": True, "evidence": []}
    assert judged(spark, results.triage_faults, [triage, triage | {"opportunity_type": "unclear"}, triage | {"relevance_status": "not_relevant"}, triage | {"requires_deep_analysis": False}]) == [
        [], ["$: unclear without maybe"], ["$: deep analysis of what is not relevant"], ["$: no deep analysis"],
    ]
    logistics = dict.fromkeys(results.LOGISTICS.fields)
    procurement = dict.fromkeys(results.PROCUREMENT.fields)
    deep = {"summary": "s", "opportunity_type": "logistics", "category": None, "why_interesting": "w", "contracting_authority": None, "procedure_code": None, "confidence": "low", "participation_barriers": [], "missing_information": None, "source_conflicts": [], "manual_review_required": False, "evidence": [], "procurement": None, "logistics": logistics}
    quote = {"source_type": "document", "field": "text", "download_id": 1, "member_name": "a", "text": "q"}
    item = {"item_name": "bolt", "lot_number": None, "quantity": None, "unit": None, "key_specifications": ["m8", " "], "brand_or_equivalent": {"specified_brand": None, "equivalent_allowed": "no"}, "evidence": []}
    lot = {"lot_number": " ", "description": None, "item_count": -1, "evidence": [quote | {"evidence_id": ""}]}
    bought = deep | {"opportunity_type": "procurement", "logistics": None, "procurement": procurement | {"items": [{k: v for k, v in item.items() if k != "brand_or_equivalent"} | {"evidence": [quote], "key_specifications": None}, item], "lots": [lot]}}
    cases = [
        (deep, []), (deep | {"logistics": None}, ["$: needs logistics"]), (deep | {"procurement": procurement}, ["$: must not have procurement"]), (deep | {"opportunity_type": "logistics_and_procurement"}, ["$: needs procurement"]),
        (deep | {"opportunity_type": "unrelated"}, ["$: must not have logistics"]), (deep | {"opportunity_type": "transport"}, ["$.opportunity_type: not one of the values"]),
        (deep | {"logistics": logistics | {"cargo": 5, "route": "x"}}, ['$.logistics: unknown field "route"', "$.logistics.cargo: not a text"]),
        (bought, [
            "$.procurement.items[1].key_specifications[1]: blank", "$.procurement.items[1].brand_or_equivalent.equivalent_allowed: not a flag", "$.procurement.items[1].evidence: too few",
            "$.procurement.lots[0].lot_number: blank", "$.procurement.lots[0].item_count: too small", "$.procurement.lots[0].evidence[0].evidence_id: blank",
        ]),
        *((v, ["$: not JSON"]) for v in ("{", None, '"a":1}', "{} {}", "1,2", "[1],[2]", '1},{"v":2', "")), *((v, ["$: not an object"]) for v in ("[]", "null")),
    ]
    assert judged(spark, results.deep_faults, [v for v, _ in cases]) == [e for _, e in cases]


def test_golden_cases(spark):
    expected = {"relevance_status": "maybe", "opportunity_type": "unclear", "category": None, "expected_reason": "r", "notes": None}
    case = {"case_id": "c1", "resource_url": "u1", "title": "t", "input_hash": "0" * 64, "expected": expected, "more": 1}
    cases = [
        case, case | {"case_id": "c2"}, case | {"case_id": "c3", "resource_url": "u3", "input_hash": "0" * 64 + "\n"}, case | {"case_id": "c1", "resource_url": "u4", "expected": expected | {"opportunity_type": "procurement"}},
        case | {"case_id": 5, "resource_url": "u5", "expected": expected | {"opportunity_type": "logistics"}}, case | {"case_id": "c6", "resource_url": "u6", "expected": expected | {"relevance_status": "relevant"}},
    ]
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(cases)], "id long, json string")
    got = sorted((r.id, r.fault) for r in results.golden_faults(rows, "id", "json").collect())
    assert got == [
        (1, "$.resource_url: repeated"), (2, "$.input_hash: bad form"), (3, "$.case_id: repeated"), (3, "$.expected: needs a category"), (4, "$.case_id: not a text"), (4, "$.expected.opportunity_type: not one of the values"),
        (5, "$.expected: unclear without maybe"),
    ]
