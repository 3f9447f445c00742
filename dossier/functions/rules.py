"""Decision rules as column expressions; the first condition that holds decides."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions import urls

RETRYABLE_STATUS = (408, 409, 429)
LANGUAGES = ("RU", "EN", "HY")
FORMATS = (".docx", ".xlsx", ".zip")


def commercial_gate(conflict: Column, value: Column, least_value: Column, extracted: Column) -> Column:
    """Whether an announcement is worth a deep analysis; least_value null means no threshold."""
    return (
        F.when(conflict, "manual_review")
        .when(value.isNotNull() & least_value.isNull(), "deep_candidate")
        .when(value.isNotNull() & (value < least_value), "skip_low_value")
        .when(value.isNotNull(), "deep_candidate")
        .when(extracted == 0, "insufficient_data")
        .otherwise("deep_candidate")
    )


def budget_guard(spend: Column, estimate: Column, deep: Column, hard: Column, soft: Column, call_cap: Column) -> Column:
    """struct(decision, allowed) of a call against the month's budget."""
    left = hard - spend
    decision = (
        F.when(left <= 0, "blocked_hard_limit")
        .when(deep & call_cap.isNotNull() & (estimate > call_cap), "blocked_single_call_limit")
        .when(estimate > left, "insufficient_budget_remaining")
        .when(spend >= soft, "soft_limit_mode")
        .otherwise("allowed")
    )
    return F.struct(decision.alias("decision"), ((decision == "allowed") | ((decision == "soft_limit_mode") & ~deep)).alias("allowed"))


def guarded(spend, estimate, deep: bool, hard, soft=None, call_cap=None) -> tuple[str, bool]:
    """(decision, allowed) as budget_guard has it, for one call on the driver; without a soft limit or a limit of one call these don't matter."""
    left = hard - spend
    if left <= 0:
        return "blocked_hard_limit", False
    if deep and call_cap is not None and estimate > call_cap:
        return "blocked_single_call_limit", False
    if estimate > left:
        return "insufficient_budget_remaining", False
    if soft is not None and spend >= soft:
        return "soft_limit_mode", not deep
    return "allowed", True


def deep_admission(gate: Column, priced: Column, tokens: Column, most_tokens: Column, guard_allowed: Column) -> Column:
    return (
        F.when(gate != "deep_candidate", "gate_skip")
        .when(~priced, "pricing_unknown")
        .when(tokens > most_tokens, "deferred_input_too_large")
        .when(~guard_allowed, "budget_deferred")
        .otherwise("admitted")
    )


def pending_reason(c: dict[str, Column]) -> Column:
    """What an announcement waits for; null if for nothing.

    c has: triage_current, triage_failure_known, not_relevant, deep_current, deep_failure_known, has_state, same_hash,
    state, memo_same_value, memo_same_tokens, expired.
    """
    same, state = c["same_hash"], c["state"]
    fresh = ~c["has_state"] | state.isin("triage_completed", "commercial_gate_pass", "pending_triage")
    reason = (
        F.when(~c["triage_current"] & c["triage_failure_known"], None)
        .when(~c["triage_current"] & ~c["has_state"], "needs_triage")
        .when(~c["triage_current"], "retry_triage")
        .when(c["not_relevant"] & same & (state == "stopped_not_relevant"), None)
        .when(c["not_relevant"], "needs_routing")
        .when(c["deep_current"] & same & (state == "deep_completed"), None)
        .when(c["deep_current"], "needs_routing")
        .when(c["deep_failure_known"], None)
        .when(same & (state == "commercial_gate_skip") & c["memo_same_value"], None)
        .when(same & (state == "deep_deferred_input") & c["memo_same_tokens"], None)
        .when(fresh, "needs_deep")
        .otherwise("retry_deep")
    )
    paid = reason.isin("needs_triage", "retry_triage", "needs_deep", "retry_deep")
    return F.when(paid & c["expired"] & same & (state == "skipped_expired"), None).when(paid & c["expired"], "skip_expired").otherwise(reason)


def coverage_complete(failed: Column, skipped: Column, unsupported: Column, processing: Column, known: Column, successful: Column) -> Column:
    """Whether nothing that an announcement lists is missing from its texts."""
    return (failed == 0) & (skipped == 0) & (unsupported == 0) & F.coalesce(processing != "failed", F.lit(True)) & ((known == 0) | (successful > 0))


def value_facts(official: Column, lot_sum: Column) -> Column:
    """struct(value, source, conflict) of the official value and the sum of the lots."""
    conflict = F.coalesce(official != lot_sum, F.lit(False))
    value = F.when(conflict, None).otherwise(F.coalesce(official, lot_sum))
    source = F.when(conflict, "unknown").when(official.isNotNull(), "official_tender_value").when(lot_sum.isNotNull(), "sum_of_official_lot_values").otherwise("unknown")
    return F.struct(value.alias("value"), source.alias("source"), conflict.alias("conflict"))


def operational_key(reason: Column, eligibility: Column) -> Column:
    """What a pending announcement counts as in the operational summary: its reason with what is known of its deadline; null for none."""
    suffix = F.when(eligibility == "eligible", "_active").when(eligibility == "unknown", "_deadline_unknown").otherwise("_deadline_conflict")
    return F.when(reason == "skip_expired", reason).otherwise(F.concat(reason, suffix))


def enrichment_status(kind: Column, missing: Column) -> Column:
    """Of a resource type and the number of its missing required fields."""
    return F.when(kind == "direct_file", "not_required").when(kind == "unknown", "unsupported").when(missing > 0, "partial").otherwise("success")


def next_step(c: dict[str, Column]) -> Column:
    """The step that a batch takes next for an announcement; c has triage_current, not_relevant, deep_current, eligibility, gate, admission."""
    return (
        F.when(~c["triage_current"] & (c["eligibility"] == "expired"), "skip_expired")
        .when(~c["triage_current"], "call_triage")
        .when(c["not_relevant"], "stop_not_relevant")
        .when(c["deep_current"], "reuse_deep")
        .when(c["eligibility"] == "expired", "skip_expired")
        .when(c["gate"] != "deep_candidate", F.concat(F.lit("gate:"), c["gate"]))
        .when(c["admission"] != "admitted", F.concat(F.lit("deferred:"), c["admission"]))
        .otherwise("call_deep")
    )


def best_document(documents: Column) -> Column:
    """Of array<struct<document_id, filename, language>> the readable one by language, then format, then place."""
    ranked = F.transform(documents, lambda d, i: F.struct(_rank(F.upper(d["language"]), LANGUAGES).alias("l"), _rank(urls.extension(d["filename"]), FORMATS).alias("f"), i.alias("i"), d.alias("d")))
    return F.array_min(F.filter(ranked, lambda r: r["f"] <= len(FORMATS)))["d"]


def _rank(c: Column, order: tuple[str, ...]) -> Column:
    place = F.array_position(F.array(*map(F.lit, order)), c)
    return F.when(F.coalesce(place, F.lit(0)) == 0, len(order) + 1).otherwise(place)


def document_plan(kind: Column, resource_url: Column, document_url: Column, documents: Column) -> Column:
    """struct(source_kind, source_ref, source_url, expected_filename) of what to read for an announcement; null if nothing."""
    plan = lambda k, ref, url, name: F.struct(F.lit(k).alias("source_kind"), ref.alias("source_ref"), url.alias("source_url"), name.alias("expected_filename"))
    best = best_document(documents)
    return (
        F.when((kind == "eauction_tender_page") & urls.is_readable(document_url), plan("eauction_document", document_url, document_url, urls.base_name(document_url)))
        .when((kind == "armeps_documents_page") & best.isNotNull(), plan("armeps_document", best["document_id"].cast("string"), resource_url, best["filename"]))
        .when((kind == "direct_file") & urls.is_readable(resource_url), plan("direct_file", resource_url, resource_url, urls.base_name(resource_url)))
    )


def error_kind(status: Column, timed_out: Column, quota: Column) -> Column:
    """struct(kind, retryable) of a failed call."""
    kind = F.when(timed_out, "timeout").when(status.isin(401, 403), "authentication").when(status == 429, "rate_limit").when(status >= 500, "server").otherwise("request")
    return F.struct(kind.alias("kind"), (timed_out | (status >= 500) | (status.isin(*RETRYABLE_STATUS) & ~quota)).alias("retryable"))


def escalation(kind: Column) -> Column:
    names = {"validation": "invalid_output", "invalid_structured_output": "invalid_output", "refusal": "refused", "incomplete": "output_cut"}
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def mismatch(expected: Column, predicted: Column, same_labels: Column) -> Column:
    """The class of a wrong prediction: a miss, a false alarm, an unclear one, or other labels."""
    return (
        F.when((expected == "relevant") & (predicted == "not_relevant"), "false_negative")
        .when((expected == "not_relevant") & (predicted == "relevant"), "false_positive")
        .when((expected != predicted) & ((expected == "maybe") | (predicted == "maybe")), "maybe_unclear")
        .when(~same_labels, "label_mismatch")
        .otherwise("none")
    )


def routing(reason: Column, not_relevant: Column, gate: Column, admission: Column) -> Column:
    """Where a batch would send an announcement, as far as can be told without a call."""
    return (
        F.when(reason == "skip_expired", "skip_expired")
        .when(reason.isin("needs_triage", "retry_triage"), "pending_triage")
        .when(not_relevant, "stopped_not_relevant")
        .when(gate != "deep_candidate", F.concat(F.lit("commercial_gate_skip:"), gate))
        .otherwise(F.concat(F.lit("deep:"), admission))
    )


def reconciled_state(is_latest: Column, has_state: Column, same_source: Column, unchanged: Column) -> Column:
    """What a backfill does to an announcement's state: only the latest version of its own source changes it."""
    return F.when(~is_latest, "not_latest").when(has_state & ~same_source, "other_source").when(has_state & unchanged, "unchanged").otherwise("updated")


#: The parts of facts, document entries and admissions that are kept with a decision or sent to a model.
FACTS = ("estimated_value", "value_source", "source_refs", "total_lots", "total_quantity", "notes")
DOCUMENT_SUMMARY = ("download_id", "member_name", "file_type", "extraction_status")
ADMISSION = ("deep_analysis_status", "reason", "reason_code")


def subset(c: Column, names: tuple[str, ...]) -> Column:
    """A struct of some fields of a struct; null stays null."""
    return F.when(c.isNotNull(), F.struct(*(c[n].alias(n) for n in names)))


def document_summaries(documents: Column) -> Column:
    """Of array<struct<...>> of documents what a model is told of each: no texts."""
    return F.transform(documents, lambda d: F.struct(*(d[n].alias(n) for n in DOCUMENT_SUMMARY)))


def admission_details(admission: Column, preflight: Column, budget: Column) -> Column:
    """JSON of an admission's decision, with preflight and budget where there are any."""
    return F.to_json(F.struct(*(admission[n].alias(n) for n in ADMISSION), preflight.alias("preflight"), budget.alias("budget")))
