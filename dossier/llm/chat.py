"""Chat formatting over typed content parts.

DataFrame functions only.  A visitor walks the parts of each message: text is
escaped, and an image, audio clip or document leaves a placeholder, its
reference and the number of tokens that it expands to.  The template marks turns
with angle brackets, and escaping takes all brackets out of texts and roles, so
that markers and placeholders can't be forged and the conversation can be read
back from the formatted string.  One conversation is one string, and so one row
of one task: a conversation has to fit there, as in any training record.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

#: Fixed values of the template: escapes and markers.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), (">", "\\g"))
OPEN, OPENED, CLOSE = "<turn ", ">\n", "\n</turn>\n"
TOKENS_A_UNIT: Mapping[str, int] = {"image": 256, "audio": 25, "document": 512}
TRAINED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _parts(messages: DataFrame) -> Column:
    kind = messages.schema["parts"].dataType if "parts" in messages.columns else None
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType) and {"type", "text", "ref", "units"} <= set(kind.elementType.names):
        return F.coalesce(F.col("parts"), F.array().cast(messages.schema["parts"].dataType))
    nothing = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), F.col("text").cast("string").alias("text"), nothing.cast("string").alias("ref"), nothing.cast("long").alias("units")))


def _placeholder(kind: Column) -> Column:
    return F.concat(F.lit("<"), F.when(kind.isin(*TOKENS_A_UNIT), kind).otherwise(F.lit("file")), F.lit(">"))


def _tokens(kind: Column, units: Column, rates: Mapping[str, int]) -> Column:
    rate = F.lit(1)
    for name, tokens in rates.items():
        rate = F.when(kind == name, F.lit(tokens)).otherwise(rate)
    return rate * F.greatest(F.coalesce(units, F.lit(1)), F.lit(0))


def formatted_conversations(messages: DataFrame, *, rates: Mapping[str, int] = TOKENS_A_UNIT) -> DataFrame:
    """One row a conversation of (conv_id, turn, role, text), or parts array<struct<type, text, ref, units>> for text: conv_id, formatted, loss_spans, attachments, expanded_tokens.

    Turns go by turn (null first), then role, then content.  Null role and text count as empty, no parts as empty text; an
    unknown part type leaves <file>.  A column parts of any other type is ignored, as are all other columns.  Rows that repeat a turn are turns of their own.  loss_spans has the place (from 1)
    and length in formatted of each text part of an assistant's turn; attachments the turn's number, type, ref and tokens.
    """
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    turns = messages.select("conv_id", "turn", role.alias("role"), _parts(messages).alias("parts"))
    visit = lambda p: F.when(p["type"] == "text", escaped(F.coalesce(p["text"], F.lit("")))).otherwise(_placeholder(p["type"]))
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(OPENED))
    turns = turns.withColumn("visited", F.transform("parts", visit)).withColumn("head", head)
    turns = turns.withColumn("body", F.array_join("visited", "")).withColumn("turn_text", F.concat("head", "body", F.lit(CLOSE)))
    order = W.partitionBy("conv_id").orderBy("turn", "role", "body")
    turns = turns.withColumn("nth", F.row_number().over(order)).withColumn("start", F.coalesce(F.sum(F.length("turn_text").cast("long")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))

    ends = F.transform("visited", lambda _, i: F.aggregate(F.slice("visited", F.lit(1), i + 1), F.lit(0), lambda n, v: n + F.length(v)))
    span = lambda p, i: F.struct((F.col("start") + F.length("head") + 1 + ends[i] - F.length(F.col("visited")[i])).cast("int").alias("at"), F.length(F.col("visited")[i]).alias("chars"), (p["type"] == "text").alias("is_text"))
    spans = F.when(F.col("role") == TRAINED_ROLE, F.filter(F.transform("parts", span), lambda s: s["is_text"]))
    files = F.transform(F.filter("parts", lambda p: ~p["type"].eqNullSafe("text")), lambda p: F.struct(F.col("nth").alias("turn"), p["type"].alias("type"), p["ref"].alias("ref"), _tokens(p["type"], p["units"], rates).cast("long").alias("tokens")))
    turns = turns.select("conv_id", "nth", "turn_text", spans.alias("spans"), files.alias("files"))
    grouped = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("nth", "turn_text", "spans", "files"))).alias("turns"))
    kept = F.flatten(F.filter(F.transform("turns", lambda t: t["spans"]), lambda s: s.isNotNull()))
    attachments = F.flatten(F.transform("turns", lambda t: t["files"]))
    out = grouped.select("conv_id", F.array_join(F.transform("turns", lambda t: t["turn_text"]), "").alias("formatted"), F.transform(kept, lambda s: F.struct(s["at"].alias("at"), s["chars"].alias("chars"))).alias("loss_spans"), attachments.alias("attachments"))
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda n, a: n + a["tokens"]))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted string: array<struct<role, text>>, placeholders left out of the texts."""
    pieces = F.split(formatted, CLOSE)
    pieces = F.slice(pieces, F.lit(1), F.size(pieces) - 1)

    def turn(piece: Column) -> Column:
        head = F.substring_index(piece, OPENED, 1)
        body = F.substring(piece, F.length(head) + 1 + len(OPENED), F.length(piece))
        return F.struct(unescaped(F.substring(head, F.lit(len(OPEN) + 1), F.length(head))).alias("role"), unescaped(F.regexp_replace(body, "<[a-z]+>", "")).alias("text"))

    return F.transform(pieces, turn)


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"), F.lit(said).alias("text"))
    done = formatted_conversations(given.unionByName(hard))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), s["at"], s["chars"]))), "")
    back = done.withColumn("turns", read_back(F.col("formatted"))).withColumn("loss", loss)
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


OP8_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
measured AS (
  SELECT *, length(replace(replace(replace(role, '\', '\b'), '<', '\l'), '>', '\g'))
            + length(replace(replace(replace(text, '\', '\b'), '<', '\l'), '>', '\g')) + 17 AS chars
  FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM measured GROUP BY conv_id
"""
