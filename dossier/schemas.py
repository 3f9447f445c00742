"""Schemas of the tables that runs keep, and the names that their columns may hold."""

from __future__ import annotations

from pyspark.sql import types as T


LONG, STRING, TIME, FLAG = T.LongType(), T.StringType(), T.TimestampType(), T.BooleanType()


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


def _fields(kind: T.DataType, names: str) -> dict[str, T.DataType]:
    return dict.fromkeys(names.split(), kind)


def _list(names: str) -> T.ArrayType:
    return T.ArrayType(_struct(**_fields(STRING, names)))


RESOURCE_TYPES = ("armeps_documents_page", "eauction_tender_page", "direct_file", "unknown")
PIPELINE_STATES = (
    "pending_triage", "triage_completed", "triage_error", "triage_deferred_budget", "stopped_not_relevant", "skipped_expired", "commercial_gate_pass",
    "commercial_gate_skip", "deep_completed", "deep_error", "deep_deferred_budget", "deep_deferred_input", "escalation_candidate",
)
EXTRACTION_STATUSES = ("success", "skipped", "failed")
RESERVATION_STATUSES = ("reserved", "settled", "unresolved", "released")

ANNOUNCEMENT_FIELDS = ("title", "source_section", "source_section_name", "source_page_url", "resource_type", "published_at", "deadline_at", "tender_time_raw")
ANNOUNCEMENT_REQUIRED = ("resource_url", "source_section", "source_section_name", "source_page_url", "resource_type", "title")
ANNOUNCEMENTS = _struct(resource_url=STRING, **dict.fromkeys(ANNOUNCEMENT_FIELDS, STRING), **_fields(TIME, "first_seen_at last_seen_at"))
ENRICHMENT = _struct(
    **_fields(STRING, "resource_url enrichment_status procedure_code contracting_authority detail_title procurement_type procedure_type description estimated_value"),
    **_fields(STRING, "published_at_detail deadline_at_detail document_url"),
    number_of_lots=LONG, **_fields(FLAG, "published_at_match deadline_at_match"), cpv_codes=_list("code name"), documents=_list("document_id filename language"), enriched_at=TIME,
)
DOWNLOADS = _struct(download_id=LONG, **_fields(STRING, "resource_url source_kind source_ref source_url filename sha256"), size_bytes=LONG, downloaded_at=TIME)
EXTRACTIONS = _struct(
    download_id=LONG, **_fields(STRING, "member_name file_type status text error"), **_fields(LONG, "char_count paragraph_count table_count sheet_count row_count cell_count"), extracted_at=TIME,
)
ATTEMPTS = _struct(**_fields(STRING, "resource_url status error"), attempted_at=TIME)
RESULTS = _struct(**_fields(STRING, "resource_url input_hash prompt_version provider model relevance result_json"), analyzed_at=TIME)
STATES = _struct(**_fields(STRING, "resource_url state reason_code input_hash"), details=T.MapType(STRING, STRING), updated_at=TIME)
LEDGER = _struct(
    **_fields(STRING, "event_id response_id analysis_type reference input_hash model"), **_fields(LONG, "input_tokens cached_tokens cache_write_tokens output_tokens"),
    cost=T.DecimalType(38, 12), created_at=TIME,
)
DELIVERIES = _struct(**_fields(STRING, "resource_url input_hash status"), attempt_count=LONG, sent_at=TIME)
USAGE = _struct(**_fields(LONG, "input_tokens cached_tokens cache_write_tokens output_tokens reasoning_tokens total_tokens"))
JOURNAL = _struct(
    seq=LONG, kind=STRING, at=TIME, **_fields(LONG, "reservation block"), **_fields(STRING, "analysis_type reference model prompt_version input_hash response_id note"),
    **_fields(T.DecimalType(38, 12), "estimate cost"), success=FLAG, usage=USAGE,
)
