"""What an answer of a model holds: usage, text, refusal; and the records made of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shape of an answer in JSON.
RESPONSE = (
    "output array<struct<type:string,content:array<struct<type:string,text:string,refusal:string>>>>,"
    "usage struct<input_tokens:bigint,output_tokens:bigint,total_tokens:bigint,input_tokens_details:struct<cached_tokens:bigint,cache_write_tokens:bigint>,output_tokens_details:struct<reasoning_tokens:bigint>>"
)


def usage(response: Column) -> Column:
    """struct of token counts; written cache tokens are 0 where they are missing, and without usage all is null."""
    u = response["usage"]
    found = F.struct(
        u["input_tokens"].alias("input_tokens"), u["output_tokens"].alias("output_tokens"), u["total_tokens"].alias("total_tokens"),
        u["input_tokens_details"]["cached_tokens"].alias("cached_tokens"), F.coalesce(u["input_tokens_details"]["cache_write_tokens"], F.lit(0)).alias("cache_write_tokens"),
        u["output_tokens_details"]["reasoning_tokens"].alias("reasoning_tokens"),
    )
    return F.when(u.isNotNull(), found)


def output_parts(response: Column) -> Column:
    """struct(text, refusal): the texts of all messages joined, and the last refusal."""
    contents = F.flatten(F.transform(F.filter(F.coalesce(response["output"], F.array().cast("array<struct<type:string,content:array<struct<type:string,text:string,refusal:string>>>>")), lambda x: x["type"] == "message"), lambda x: F.coalesce(x["content"], F.array().cast("array<struct<type:string,text:string,refusal:string>>"))))
    texts = F.transform(F.filter(contents, lambda c: (c["type"] == "output_text") & c["text"].isNotNull()), lambda c: c["text"])
    refusals = F.transform(F.filter(contents, lambda c: c["type"] == "refusal"), lambda c: F.coalesce(F.nullif(c["refusal"], F.lit("")), F.lit("(no text)")))
    return F.struct(F.array_join(texts, "").alias("text"), F.try_element_at(refusals, F.lit(-1)).alias("refusal"))


def token_count(text: Column) -> Column:
    """struct(count, error) of a JSON value as text: null counts as 0; anything but a whole number from 0 on is an error."""
    number = F.when(text.rlike(r"^\d{1,18}$"), text.try_cast("long"))
    nothing = text.isNull() | (text == "null")
    return F.struct(F.when(nothing, F.lit(0).cast("long")).otherwise(number).alias("count"), (~nothing & number.isNull()).alias("error"))


def synthetic_triage(status: Column, kind: Column, category: Column, reason: Column) -> Column:
    """A triage result made of an expected label, as if a sure model had given it."""
    none = F.array().cast("array<struct<source_type:string,text:string>>")
    return F.struct(
        status.alias("relevance_status"), kind.alias("opportunity_type"), category.alias("category"), F.lit("high").alias("confidence"), reason.alias("reason"),
        (status != "not_relevant").alias("requires_deep_analysis"), none.alias("evidence"),
    )


def verified(files: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """stored (key, sha256) with state: ok if the landed content (key, content) has the digest, changed if not, missing without one."""
    landed = files.select(key, F.sha2("content", 256).alias("_now"))
    state = F.when(F.col("_now").isNull(), "missing").when(F.col("_now") == F.col("sha256"), "ok").otherwise("changed")
    return stored.join(landed, key, "left").withColumn("state", state).drop("_now")


def case_record(case: dict[str, Column], context: dict[str, Column], expected: tuple[str, ...]) -> Column:
    """An evaluation case: its fields, the triage context as a struct of its own, and a template of expected labels that are still null."""
    return F.struct(
        *(c.alias(n) for n, c in case.items()), F.struct(*(c.alias(n) for n, c in context.items())).alias("triage_context"),
        F.struct(*(F.lit(None).cast("string").alias(n) for n in expected)).alias("expected"),
    )


def golden_cases(current: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    """Current contexts (key, input_hash, title) with human labels (key, expected struct) as cases: case_id from the key, hash and title as they are now; without a context none."""
    case_id = F.concat(F.lit("case-"), F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 16))
    return labels.join(current, key).select(case_id.alias("case_id"), key, "input_hash", "title", "expected")


def usage_totals(records: DataFrame, counts: tuple[str, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """Sums of token counts, a missing one as 0."""
    return records.groupBy(*by).agg(*(F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in counts))


def run_cost(records: DataFrame, cost: Column, model: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The sum of the records' costs and error; with any model that has no price there is no sum but the error that names the first."""
    unpriced = F.min(F.when(cost.isNull(), F.col(model)))
    error = F.when(F.count_if(cost.isNull()) > 0, F.concat(F.lit("no price for "), F.coalesce(unpriced, F.lit("(none)"))))
    return records.groupBy(*by).agg(F.when(error.isNull(), F.sum(cost)).alias("cost"), error.alias("error"))


def deep_records(cases: DataFrame, contexts: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """One record a golden case of a deep run: the case's columns, status, what went to the model, what came back, and error (kind, message).

    cases have preparation (ok, or why no call was made) and detail; contexts have document_coverage, input_size_chars and evidence_units; answers have
    prediction, raw_output, usage, response_id, attempts, error_kind and error_message.  A case that is not prepared is
    skipped and has nothing of either; one without an answer, or whose answer has an error, is an error, with the usage
    that it cost all the same.
    """
    sent = ("document_coverage", "input_size_chars", "evidence_units")
    joined = cases.join(contexts.select(key, *sent), key, "left").join(answers.withColumn("_answered", F.lit(True)), key, "left")
    prepared = F.coalesce(F.col("preparation") == "ok", F.lit(False))
    answered = F.coalesce(F.col("_answered"), F.lit(False))
    failed = ~answered | F.col("error_kind").isNotNull()
    status = F.when(~prepared, "skipped").when(failed, "error").otherwise("scored")
    text = lambda c: F.col(c).cast("string")
    kind = F.when(~prepared, text("preparation")).when(~answered, "unexpected_error").otherwise(text("error_kind"))
    message = F.when(~prepared, text("detail")).when(~answered, "no answer").otherwise(text("error_message"))
    own = [c for c in cases.columns if c not in ("preparation", "detail")]
    return joined.select(
        *own, status.alias("status"), *(F.when(prepared, F.col(c)).alias(c) for c in sent), *(F.when(prepared & ~failed, F.col(c)).alias(c) for c in ("prediction", "raw_output")),
        *(F.when(prepared & answered, F.col(c)).alias(c) for c in ("usage", "response_id", "attempts")), F.when(~prepared | failed, F.struct(kind.alias("kind"), message.alias("message"))).alias("error"),
    )


def deep_artifacts(records: DataFrame, run: dict[str, Column], cost: Column) -> DataFrame:
    """One artifact a record, for files.write_artifact: the run's facts (evaluator, prompt, provider, model, ...), the usage, its cost and the record as case."""
    return records.select(*(c.alias(n) for n, c in run.items()), "usage", cost.alias("cost"), F.struct(*records.columns).alias("case"))
