"""Case files, artifacts and names of landed files."""

from __future__ import annotations

from email.errors import HeaderParseError
from email.header import decode_header, make_header
from email.message import Message

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from dossier.functions.text import safe_file_name

#: Hex digits of the content hash that tell colliding names apart, tried in turn.
HASH_DIGITS = (8, 16, 64)


def json_cases(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A JSON list of cases; a file that is none fails."""
    return spark.read.schema(schema).json(path, multiLine=True, mode="FAILFAST")


def write_artifact(rows: DataFrame, path: str) -> None:
    """JSON lines in a folder that must not be there yet."""
    rows.write.mode("errorifexists").json(path)


def header_name(disposition: str | None) -> str | None:
    """The file name in one Content-Disposition, with encoded words decoded and UTF-8 that was read as Latin-1 put right."""
    if not disposition:
        return None
    message = Message()
    message["Content-Disposition"] = disposition
    name = message.get_filename()
    if not name:
        return None
    if "=?" in name:
        try:
            name = str(make_header(decode_header(name)))
        except (LookupError, UnicodeError, HeaderParseError):
            pass
    try:
        name = name.encode("latin-1").decode()
    except UnicodeError:
        pass
    return name.strip() or None


#: Charsets of encoded words that Spark reads itself, and others of one byte a letter, read by a table.
CHARSETS = {"utf-8": "UTF-8", "utf8": "UTF-8", "us-ascii": "US-ASCII", "iso-8859-1": "ISO-8859-1", "latin-1": "ISO-8859-1"}
TABLES = ("windows-1251", "windows-1252", "koi8-r", "cp866", "iso-8859-5", "iso-8859-15")
WORD = r"=\?[^?]*\?[bBqQ]\?[^?]*\?="


def _quoted_printable(payload: Column) -> Column:
    """Hex of the bytes of a Q word."""
    units = F.regexp_extract_all(F.replace(payload, F.lit("_"), F.lit(" ")), F.lit(r"=[0-9A-Fa-f]{2}|[\s\S]"), F.lit(0))
    return F.array_join(F.transform(units, lambda u: F.when(F.length(u) == 3, F.upper(F.substring(u, 2, 2))).otherwise(F.hex(F.encode(u, "UTF-8")))), "")


def _in_charset(data: Column, charset: Column) -> Column:
    """Bytes as text; null where the charset is unknown or the bytes are none of it."""
    out = F.lit(None).cast("string")
    for name, known in CHARSETS.items():
        text = F.try_validate_utf8(data.cast("string")) if known == "UTF-8" else F.when(~F.hex(data).rlike("^(..)*[89A-F]"), F.decode(data, known)) if known == "US-ASCII" else F.decode(data, known)
        out = F.when(charset == name, text).otherwise(out)
    upper = "".join(map(chr, range(128, 256)))
    for name in TABLES:
        letters = bytes(range(128, 256)).decode(name, "replace")
        text = F.translate(F.decode(data, "ISO-8859-1"), upper, letters)
        out = F.when(charset == name, F.when(~text.contains("\ufffd"), text)).otherwise(out)
    return out


def decoded_words(text: Column) -> Column:
    """Encoded words (Base64 or Q, of the charsets above) as what they say: white space between two is none, bytes of one charset that go on in the next word are read together, and a space parts ASCII from other charsets.  A text with a word that can't be read stays as it is."""
    tight = F.regexp_replace(text, r"(\?=)\s+(?=" + WORD + ")", "$1")
    tokens = F.regexp_extract_all(tight, F.lit(rf"{WORD}|(?:(?!{WORD})[\s\S])+"), F.lit(0))
    part = lambda t, i: F.regexp_extract(t, r"(?s)^=\?([^?]*)\?([bBqQ])\?([^?]*)\?=$", i)
    is_word = lambda t: t.rlike(rf"(?s)^{WORD}$")
    padded = lambda p: F.rpad(p, F.ceil(F.length(p) / 4).cast("int") * 4, F.lit("="))
    data = lambda t: F.when(F.lower(part(t, 2)) == "b", F.hex(F.try_to_binary(padded(part(t, 3)), F.lit("base64")))).otherwise(_quoted_printable(part(t, 3)))
    read = F.transform(tokens, lambda t: F.struct(F.when(is_word(t), F.lower(part(t, 1))).alias("charset"), F.when(is_word(t), data(t)).otherwise(t).alias("said")))
    none = F.array().cast("array<struct<charset: string, said: string>>")
    last = lambda acc: F.try_element_at(acc, F.lit(-1))
    goes_on = lambda acc, x: F.coalesce(last(acc)["charset"] == x["charset"], F.lit(False))
    longer = lambda acc, x: F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(x["charset"].alias("charset"), F.concat(last(acc)["said"], x["said"]).alias("said"))))
    joined = F.aggregate(read, none, lambda acc, x: F.when(goes_on(acc, x), longer(acc, x)).otherwise(F.concat(acc, F.array(x))))
    plain = lambda x: F.coalesce(x["charset"] == "us-ascii", F.lit(True))
    texts = F.transform(joined, lambda x: F.struct(plain(x).alias("plain"), F.when(x["charset"].isNull(), x["said"]).otherwise(_in_charset(F.unhex(x["said"]), x["charset"])).alias("said")))
    edge = r"[\s()\\]"
    parted = lambda acc, x: F.when(acc["plain"], ~x["plain"] & ~acc["said"].rlike(f"{edge}$")).otherwise(x["plain"] & ~x["said"].rlike(f"^{edge}"))
    joint = lambda acc, x: F.when((acc["said"] != "") & parted(acc, x), F.lit(" ")).otherwise(F.lit(""))
    start = F.struct(F.lit(True).alias("plain"), F.lit("").alias("said"))
    whole = F.aggregate(texts, start, lambda acc, x: F.struct(x["plain"].alias("plain"), F.concat(acc["said"], joint(acc, x), x["said"]).alias("said")))
    return F.when(text.contains("=?"), F.coalesce(whole["said"], text)).otherwise(text)


def header_file_name(disposition: Column) -> Column:
    """The file name in a Content-Disposition: the extended form by its percent codes, a quoted or plain one with its encoded words decoded; UTF-8 that was read as Latin-1 is put right; null if there is none."""
    extended = F.nullif(F.regexp_extract(disposition, r"(?i);\s*filename\*\s*=\s*[^';]*'[^';]*'([^;]+)", 1), F.lit(""))
    quoted = F.nullif(F.regexp_replace(F.regexp_extract(disposition, r'(?i);\s*filename\s*=\s*"((?:[^"\\]|\\.)*)"', 1), r"\\(.)", "$1"), F.lit(""))
    plain = F.nullif(F.regexp_extract(disposition, r'(?i);\s*filename\s*=\s*([^";\s]+)', 1), F.lit(""))
    decoded = F.try_url_decode(F.replace(extended, F.lit("+"), F.lit("%2B")))
    said = F.coalesce(decoded, decoded_words(quoted), decoded_words(plain))
    latin = said.rlike(r"^[\u0000-\u00FF]*[\u0080-\u00FF][\u0000-\u00FF]*$")
    mended = F.try_validate_utf8(F.encode(said, "ISO-8859-1").cast("string"))
    return F.nullif(F.trim(F.when(latin, F.coalesce(mended, said)).otherwise(said)), F.lit(""))


def landed_names(files: DataFrame, folder: str, name: str, sha256: str, order: str) -> DataFrame:
    """files with landed_name and is_copy: the first file of a name keeps it, equal contents share a name, and another content gets as many digits of its hash as set it apart from the others of that name."""
    safe = files.withColumn("_safe", safe_file_name(F.col(name)))
    contents = safe.groupBy(folder, "_safe", sha256).agg(F.min(order).alias("_first"))
    within = W.partitionBy(folder, "_safe")
    stem, extension = F.regexp_extract("_safe", r"^(.+?)(\.[^.]*)?$", 1), F.regexp_extract("_safe", r"^(.+?)(\.[^.]*)?$", 2)
    named = contents.withColumn("_own", F.col("_first") == F.min("_first").over(within))
    candidate = F.lit(None).cast("string")
    for digits in reversed(HASH_DIGITS):
        short = F.substring(sha256, 1, digits)
        alone = F.count(F.lit(1)).over(W.partitionBy(folder, "_safe", "_own", short)) == 1
        candidate = F.when(alone | F.lit(digits == HASH_DIGITS[-1]), F.concat(stem, F.lit("__"), short, extension)).otherwise(candidate)
    named = named.withColumn("landed_name", F.when(F.col("_own"), F.col("_safe")).otherwise(candidate))
    joined = safe.join(named.select(folder, "_safe", sha256, "_first", "landed_name"), [folder, "_safe", sha256])
    return joined.withColumn("is_copy", F.col(order) > F.col("_first")).drop("_safe", "_first")


def response_state(status: Column, disposition: Column, content_type: Column, url_extension: Column, fields: Column, documents: Column, core_fields: int = 3) -> Column:
    """What a landed response is: direct_file, html_tender_page, html_documents_page or unknown."""
    kind = F.trim(F.lower(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    attached = F.lower(F.coalesce(disposition, F.lit(""))).rlike("attachment|filename")
    textual = kind.startswith("text/") | kind.rlike("html|json|xml|javascript")
    return (
        F.when(~F.coalesce(status.between(200, 299), F.lit(False)), "unknown")
        .when(attached | ((kind != "") & ~textual), "direct_file")
        .when(kind.rlike("html") & (fields >= core_fields), "html_tender_page")
        .when(kind.rlike("html") & (documents > 0), "html_documents_page")
        .otherwise("unknown")
    )
