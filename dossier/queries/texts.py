"""Text operators over documents and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dossier.functions import segments, text
from dossier.operators import contexts, facts, grounding
from dossier.queries.base import Registry, table
from dossier.store import spread

registry = Registry()


def _docs(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", *more)


@registry.add(r"SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS text_hash, length(trim(regexp_replace(text, '\s+', ' ', 'g')))::INTEGER AS chars FROM documents")
def normalize_whitespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    plain = text.collapsed(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(plain, 256).alias("text_hash"), F.length(plain).alias("chars"))


CHUNK_SQL = """
WITH RECURSIVE cut AS (
  SELECT doc_id, text AS rest, 0 AS n, 0::BIGINT AS start, NULL::VARCHAR AS piece FROM documents WHERE text <> ''
  UNION ALL
  SELECT doc_id, substr(rest, size + 1), n + 1, start + length(coalesce(piece, '')), substr(rest, 1, size)
  FROM (SELECT *, CASE WHEN length(rest) <= 4000 THEN length(rest)
          WHEN contains(substr(rest, 2, 3999), chr(10)) THEN 4001 - strpos(reverse(substr(rest, 1, 4000)), chr(10)) ELSE 4000 END AS size FROM cut)
  WHERE rest <> '')
"""


@registry.add(CHUNK_SQL + "SELECT doc_id, (n - 1)::INTEGER AS n, start::INTEGER AS start, length(piece)::INTEGER AS chars, sha256(piece) AS piece_hash FROM cut WHERE n > 0")
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = segments.chunks(_docs(spark, sf_dir))
    return cut.select("doc_id", "n", "start", F.length("piece").alias("chars"), F.sha2("piece", 256).alias("piece_hash"))


@registry.add("SELECT doc_id, sha256(text) AS text_hash FROM documents WHERE text <> ''")
def chunk_reassembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks put together again are the text."""
    return segments.reassembled(segments.chunks(_docs(spark, sf_dir), size=1000), "doc_id").select("doc_id", F.sha2("text", 256).alias("text_hash"))


@registry.add("""
WITH RECURSIVE line AS (
  SELECT doc_id, unnest(list_transform(string_split(text, chr(10)), lambda x: x)) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
placed AS (SELECT doc_id, k, line, (sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS UNBOUNDED PRECEDING) - length(line) - 1)::BIGINT AS start FROM line),
cut AS (
  SELECT doc_id, start, line AS rest, NULL::VARCHAR AS piece FROM placed WHERE line <> ''
  UNION ALL
  SELECT doc_id, start + length(coalesce(piece, '')), substr(rest, size + 1), substr(rest, 1, size)
  FROM (SELECT *, CASE WHEN length(rest) <= 500 THEN length(rest)
          WHEN regexp_matches(substr(rest, 2, 499), '[ \t]') THEN 501 - length(regexp_extract(substr(rest, 1, 500), '[^ \t]*$')) - 1 ELSE 500 END AS size FROM cut)
  WHERE rest <> '')
SELECT doc_id, start::INTEGER AS start, length(piece)::INTEGER AS chars, sha256(piece) AS piece_hash FROM cut WHERE regexp_matches(piece, '\\S')
""")
def evidence_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = segments.evidence_units(_docs(spark, sf_dir))
    return units.select("doc_id", "start", (F.col("end") - F.col("start")).alias("chars"), F.sha2("piece", 256).alias("piece_hash"))


@registry.add("""
WITH ordered AS (SELECT doc_id, source, length(text) AS n, text, coalesce(sum(length(text)) OVER (PARTITION BY source, doc_id // 100 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM documents WHERE text <> '')
SELECT doc_id, source, sha256(substr(text, 1, least(n, 6000 - before)::BIGINT)) AS preview_hash, least(n, 6000 - before) < n AS truncated FROM ordered WHERE before < 6000
""")
def preview_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """6,000 characters of the documents of each lot of a source, in order."""
    docs = _docs(spark, sf_dir, "source").withColumn("lot", F.expr("doc_id div 100"))
    return contexts.previews(docs, ["source", "lot"], ["doc_id"], 6000).select("doc_id", "source", F.sha2("preview", 256).alias("preview_hash"), "truncated")


@registry.add("SELECT sha256(text) AS content_hash, arg_min(doc_id, doc_id::VARCHAR) AS canonical_id, count(*)::BIGINT AS members, any_value(length(text))::INTEGER AS chars FROM documents WHERE text <> '' GROUP BY text")
def exact_dedup_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts.content_groups(_docs(spark, sf_dir), "doc_id")


@registry.add("SELECT doc_id, arg_min(doc_id, doc_id::VARCHAR) OVER (PARTITION BY text) AS canonical_id FROM documents WHERE text <> ''")
def represented_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contexts.represented(_docs(spark, sf_dir), "doc_id")


@registry.add("""
SELECT doc_id, sha256('{"lang":' || coalesce('"' || lang || '"', 'null') || ',"n_chars":' || coalesce(n_chars::VARCHAR, 'null') || ',"source":' || coalesce('"' || source || '"', 'null') || '}') AS input_hash FROM documents
""")
def input_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", contexts.input_hash({c: F.col(c) for c in ("source", "n_chars", "lang")}).alias("input_hash"))


@registry.add("SELECT doc_id, len(string_split_regex(text, '[.!?]\\s+'))::INTEGER AS sentences, (text IS NULL OR trim(text) = '') AS blank, length(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'))::INTEGER AS escaped_chars FROM documents")
def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.size(text.sentences(c)).alias("sentences"), text.is_blank(c).alias("blank"), F.length(text.html_escaped(c)).alias("escaped_chars"))


SECRET = r"sk-[A-Za-z0-9]{8,}|[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[a-z]{2,}|[0-9a-f]{40}"


@registry.add(f"SELECT doc_id, sha256(regexp_replace(text, '{SECRET}', '***', 'g')) AS text_hash, len(regexp_extract_all(text, '{SECRET}'))::INTEGER AS secrets FROM documents")
def secret_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", F.sha2(text.redacted(c, SECRET), 256).alias("text_hash"), F.regexp_count(c, F.lit(SECRET)).alias("secrets"))


@registry.add(r"""
WITH q AS (SELECT doc_id, regexp_replace(substr(text, 11, 60), '\s+', '  ', 'g') || CASE WHEN doc_id % 5 = 0 THEN '#' ELSE '' END AS quote FROM documents)
SELECT d.doc_id, trim(regexp_replace(quote, '\s+', ' ', 'g')) <> '' AND contains(trim(regexp_replace(text, '\s+', ' ', 'g')), trim(regexp_replace(quote, '\s+', ' ', 'g'))) AS grounded
FROM documents d JOIN q ON q.doc_id = d.doc_id
""")
def grounded_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes cut from the texts with other white space; some of them altered."""
    docs = _docs(spark, sf_dir)
    altered = F.when(F.col("doc_id") % 5 == 0, F.lit("#")).otherwise(F.lit(""))
    quotes = docs.select("doc_id", F.concat(F.regexp_replace(F.substring("text", 11, 60), r"\s+", "  "), altered).alias("quote"))
    return grounding.grounded(quotes, docs, "doc_id").select("doc_id", "grounded")


@registry.add("""
WITH canonical AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS first_id, arg_min(doc_id, doc_id::VARCHAR) OVER (PARTITION BY text) AS canonical_id FROM documents WHERE text <> '')
SELECT c.doc_id, contains(trim(regexp_replace(o.text, '\\s+', ' ', 'g')), trim(regexp_replace(substr(c.text, 1, 40), '\\s+', ' ', 'g'))) AND trim(substr(c.text, 1, 40)) <> '' AS grounded
FROM canonical c JOIN documents o ON o.doc_id = c.canonical_id WHERE c.canonical_id <> c.doc_id
""")
def quotes_of_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes of copies are looked up in the canonical text."""
    docs = _docs(spark, sf_dir)
    canonical = contexts.represented(docs, "doc_id")
    copies = canonical.where("canonical_id <> doc_id")
    quotes = docs.join(copies.select("doc_id"), "doc_id").select("doc_id", F.substring("text", 1, 40).alias("quote"))
    kept = docs.join(canonical.select(F.col("canonical_id").alias("doc_id")).distinct(), "doc_id", "left_semi")
    return grounding.grounded_by_content(quotes, kept, canonical, "doc_id").select("doc_id", "grounded")


@registry.add("""
WITH c AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS ref FROM conversations),
asked AS (SELECT conv_id, unnest([1, 3, 3, conv_id % 9]) AS ref, generate_subscripts([1, 3, 3, conv_id % 9], 1) - 1 AS position FROM (SELECT DISTINCT conv_id FROM conversations))
SELECT a.conv_id, a.position::INTEGER AS position, a.ref::INTEGER AS ref, 'ev_' || a.conv_id || '_' || c.turn AS evidence_id,
       c.conv_id IS NOT NULL AND count(*) OVER (PARTITION BY a.conv_id, a.ref) = 1 AS valid
FROM asked a LEFT JOIN c ON c.conv_id = a.conv_id AND c.ref = a.ref
""")
def evidence_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References by number into the turns of a conversation; one is repeated and one may be out of range."""
    turns = table(spark, sf_dir, "conversations").withColumn("order_text", F.col("text"))
    name = F.concat(F.lit("ev_"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"))
    rows = grounding.catalog(turns, ["conv_id"], ["turn", "role", "order_text"], name)
    asked = turns.select("conv_id").distinct().select("conv_id", F.array(F.lit(1), F.lit(3), F.lit(3), (F.col("conv_id") % 9).cast("int")).alias("refs"))
    return grounding.resolved_refs(asked, rows, ["conv_id"])


LOTS = "string_agg(l_linenumber || chr(9) || (l_extendedprice::BIGINT + 1000) || CASE WHEN l_orderkey % 13 = 0 THEN 'x' ELSE '' END || chr(9) || 'part ' || l_partkey, chr(10) ORDER BY l_linenumber, l_partkey)"


@registry.add("""
WITH lot AS (SELECT l_orderkey AS doc_id, count(*)::BIGINT AS lots, sum(round_even(l_extendedprice, 0)::BIGINT)::BIGINT AS total,
               count(DISTINCT l_linenumber) AS d, min(l_linenumber) AS low, max(l_linenumber) AS top FROM lineitem GROUP BY 1)
SELECT doc_id, lots, CASE WHEN d = lots AND doc_id % 13 <> 0 AND low = 1 AND top = lots THEN total END AS lot_sum,
       CASE WHEN d < lots THEN 'repeated_number' WHEN doc_id % 13 = 0 THEN 'bad_price' WHEN low <> 1 OR top <> lots THEN 'not_contiguous' END AS reason FROM lot
""")
def lot_price_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a table of each order's lots, read back; every thirteenth has prices that are no numbers."""
    price = F.concat(F.bround("l_extendedprice").cast("long").cast("string"), F.when(F.col("l_orderkey") % 13 == 0, F.lit("x")).otherwise(F.lit("")))
    row = F.concat_ws("\t", F.col("l_linenumber").cast("string"), price, F.concat(F.lit("part "), F.col("l_partkey").cast("string")))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", row.alias("row")))), lambda x: x["row"]), "\n")
    texts = spread(table(spark, sf_dir, "lineitem"), "l_orderkey").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.concat(F.lit("Terms\nLots\tName\nNumber\tPrice\n"), rows, F.lit("\nEnd")).alias("text"))
    return facts.lot_tables(texts, "doc_id", r"^Lots\tName\s*\nNumber\tPrice\s*$")


@registry.add("""
SELECT l_orderkey AS doc_id, CASE WHEN count(*) FILTER (WHERE l_shipdate IS NULL OR l_linenumber = 7) = 0 THEN sum(l_quantity::BIGINT)::BIGINT END AS total, count(*)::BIGINT AS rows FROM lineitem GROUP BY 1
""")
def quantity_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sheets of each order's lots; a seventh lot has a quantity that is no number."""
    quantity = F.when(F.col("l_linenumber") == 7, F.lit("some")).otherwise(F.col("l_quantity").cast("long").cast("string"))
    row = F.concat_ws("\t", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), quantity)
    rows = F.array_join(F.collect_list(row), "\n")
    texts = spread(table(spark, sf_dir, "lineitem"), "l_orderkey").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.concat(F.lit("[Sheet: Lots]\nNo\tUnit price\tQuantity\n"), rows).alias("text"))
    return facts.column_totals(texts, "doc_id", ["Unit price", "Quantity"], "Quantity")


@registry.add("""
SELECT p_brand, CASE WHEN min(p_size) = max(p_size) THEN min(p_size) END AS p_size, min(p_size) = max(p_size) AS agree FROM part GROUP BY p_brand
""")
def agreed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.agreed(table(spark, sf_dir, "part"), "p_brand", "p_size")


@registry.add("""
WITH RECURSIVE l AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, role || ': ' || coalesce(text, '') AS line FROM conversations),
e AS (SELECT conv_id, count(*) AS last_k FROM l GROUP BY 1),
s AS (
  SELECT conv_id, last_k, 1::BIGINT AS k, NULL::VARCHAR AS rest, '' AS page, 0 AS n, NULL::VARCHAR AS done FROM e
  UNION ALL
  SELECT conv_id, last_k, CASE step WHEN 'fit' THEN k + 1 WHEN 'cut' THEN k + (after = '')::BIGINT WHEN 'end' THEN k + 1 ELSE k END,
    CASE step WHEN 'fit' THEN NULL WHEN 'cut' THEN nullif(after, '') ELSE line END, CASE step WHEN 'fit' THEN together ELSE '' END,
    n + (step <> 'fit')::INTEGER, CASE step WHEN 'fit' THEN NULL WHEN 'cut' THEN substr(line, 1, size) ELSE page END
  FROM (SELECT *, ltrim(substr(line, size + 1), ' ') AS after FROM (
    SELECT s.*, coalesce(rest, l.line) AS line, CASE WHEN page = '' THEN coalesce(rest, l.line) ELSE page || chr(10) || coalesce(rest, l.line) END AS together,
      CASE WHEN contains(substr(coalesce(rest, l.line), 2, 4096), ' ') THEN length(substr(coalesce(rest, l.line), 2, 4096)) - strpos(reverse(substr(coalesce(rest, l.line), 2, 4096)), ' ') + 1 ELSE 4096 END AS size,
      CASE WHEN s.k > last_k THEN 'end' WHEN length(CASE WHEN page = '' THEN coalesce(rest, l.line) ELSE page || chr(10) || coalesce(rest, l.line) END) <= 4096 THEN 'fit' WHEN page <> '' THEN 'full' ELSE 'cut' END AS step
    FROM s LEFT JOIN l ON l.conv_id = s.conv_id AND l.k = s.k WHERE s.k <= last_k OR s.k = last_k + 1 AND page <> '')))
SELECT conv_id, (n - 1)::INTEGER AS n, length(done)::INTEGER AS chars, sha256(done) AS page_hash FROM s WHERE done IS NOT NULL
""")
def full_text_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation as message pages of at most 4,096 characters."""
    lines = table(spark, sf_dir, "conversations").withColumn("line", F.concat("role", F.lit(": "), F.coalesce("text", F.lit(""))))
    pages = segments.paged(lines, "conv_id", ["turn", "role", "text"])
    return pages.select("conv_id", "n", F.length("page").alias("chars"), F.sha2("page", 256).alias("page_hash"))


@registry.add(r"""
WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
h AS (SELECT doc_id, t, regexp_extract(substr(t, 1, 160), '(?s)^(.*[.!?])(\s|$)', 1) AS s, regexp_replace(regexp_extract(substr(t, 1, 159), '(?s)^(.*)\s', 1), '[,;:—-]*\s*$', '') AS w FROM c)
SELECT doc_id, CASE WHEN length(t) <= 160 THEN t WHEN length(s) * 2 >= 160 THEN s WHEN length(w) > 0 THEN w || '…' ELSE substr(t, 1, 159) || '…' END AS clipped FROM h
""")
def clipped_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir).withColumn("text", text.collapsed(F.col("text")))
    return docs.select("doc_id", segments.clipped(F.col("text"), 160).alias("clipped"))


@registry.add(r"""
WITH c AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents),
p AS (SELECT doc_id, t, list_transform(list_filter(range(1, 160), lambda i: substr(t, i, 1) IN (',', ';') AND substr(t, i + 1, 1) = ' ' AND i < 160), lambda i: regexp_replace(substr(t, 1, i - 1), '[ ,;:–—-]+$', '')) AS parts FROM c),
w AS (SELECT doc_id, t, list_filter(parts, lambda x: length(x) >= 64 AND regexp_extract(regexp_replace(x, '[ ,;:–—.-]+$', ''), '[^ ]*$') <> '' AND lower(regexp_extract(regexp_replace(x, '[ ,;:–—.-]+$', ''), '[^ ]*$')) NOT IN ('и', 'или', 'а', 'но', 'что', 'чтобы', 'как', 'для', 'в', 'во', 'на', 'с', 'со', 'по', 'к', 'ко', 'от', 'из', 'о', 'об', 'при', 'за', 'до', 'у', 'не', 'что-либо', 'также', 'где', 'когда', 'если')) AS whole FROM p)
SELECT doc_id, CASE WHEN length(t) <= 160 THEN t WHEN len(whole) > 0 THEN whole[-1] || '.' END AS thought FROM w
""")
def complete_thoughts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, or their longest beginnings that are a thought of their own."""
    docs = _docs(spark, sf_dir).withColumn("text", text.collapsed(F.col("text")))
    return docs.select("doc_id", segments.complete_thought(F.col("text"), 160).alias("thought"))


@registry.add("""
WITH RECURSIVE u AS (SELECT conv_id, turn // 3 AS section, role AS title, trim(regexp_replace(substr(text, 1, 90), '\\s+', ' ', 'g')) AS line, row_number() OVER (PARTITION BY conv_id ORDER BY turn // 3, role, turn, text) AS k FROM conversations WHERE trim(regexp_replace(substr(text, 1, 90), '\\s+', ' ', 'g')) <> ''),
l AS (SELECT *, section || title AS part FROM u),
s AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS k, '' AS page, NULL::VARCHAR AS part, NULL::VARCHAR AS done FROM l
  UNION ALL
  SELECT conv_id, k, CASE WHEN full_ THEN head || chr(10) || line ELSE joined END, new_part, CASE WHEN full_ THEN page END FROM (
    SELECT *, page <> '' AND length(joined) > 300 AS full_ FROM (
      SELECT s.conv_id, l.k, l.part AS new_part, l.line, s.page, CASE WHEN s.part = l.part THEN l.title || ' (continued):' ELSE l.title || ':' END AS head,
        CASE WHEN s.part = l.part THEN s.page || chr(10) || l.line WHEN s.page <> '' THEN s.page || chr(10) || chr(10) || l.title || ':' || chr(10) || l.line ELSE l.title || ':' || chr(10) || l.line END AS joined
      FROM s JOIN l ON l.conv_id = s.conv_id AND l.k = s.k + 1))),
p AS (SELECT conv_id, k, done AS page FROM s WHERE done IS NOT NULL UNION ALL SELECT conv_id, max(k) + 1, arg_max(page, k) FROM s GROUP BY 1)
SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY k) - 1)::INTEGER AS n, page FROM p
""")
def section_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns under headings, on pages of at most 300 characters; a section that goes on has its heading again."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", F.floor(F.col("turn") / 3).alias("third"), "role", text.collapsed(F.substring("text", 1, 90)).alias("line"))
    rows = turns.withColumns({"section": F.concat(F.col("third").cast("string"), F.col("role")), "title": F.col("role")})
    return segments.section_pages(rows, "conv_id", ["third", "role", "turn", "text"], 300)
