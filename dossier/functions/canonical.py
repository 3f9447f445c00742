"""One text for each value: Unicode forms, case folding, and JSON as Python's json.dumps(sort_keys=True, ensure_ascii=False, default=str) writes it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Escapes of JSON strings that have a letter; other controls are escaped by number.
LETTERS = {"\\": "\\\\", '"': '\\"', "\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
ASCII = r"^[\x00-\x7f]*$"


def _by_icu(c: Column, type_: str, method: str, flag: bool) -> Column:
    """A static method of the Unicode library that Spark comes with; texts of ASCII alone and nulls don't need nfc."""
    return F.when(c.isNotNull(), F.reflect(F.lit(type_), F.lit(method), F.coalesce(c, F.lit("")), F.lit(flag)))


def nfc(c: Column) -> Column:
    """The composed form, so that canonically equal texts are equal."""
    return F.when(c.rlike(ASCII), c).otherwise(_by_icu(c, "com.ibm.icu.text.Normalizer", "compose", False))


def casefolded(c: Column) -> Column:
    """Full case folding: a sharp s and two of them, and both small sigmas, are equal."""
    return F.when(c.rlike(ASCII), F.lower(c)).otherwise(_by_icu(c, "com.ibm.icu.lang.UCharacter", "foldCase", True))


def json_string(c: Column) -> Column:
    """A text as a JSON string, with what is not ASCII as it is."""
    escaped = c
    for plain, escape in LETTERS.items():  # the backslash first
        escaped = F.replace(escaped, F.lit(plain), F.lit(escape))
    for code in sorted(set(range(32)) - {ord(p) for p in LETTERS}):
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), F.when(c.rlike(r'["\\\x00-\x1f]'), escaped).otherwise(c), F.lit('"'))


def float_text(c: Column) -> Column:
    """A double as Python writes it: positional from 1e-4 to 1e16, else with an exponent of two digits at least.  Of numbers below 1e-307 there may be more digits."""
    tried = [F.format_string(f"%.{n}e", F.abs(c)) for n in (14, 15, 16)]
    tried.insert(2, F.regexp_replace(tried[2], "[0-9]e", "e"))  # cut where rounding went past it
    said = F.coalesce(*(F.when(t.try_cast("double") == F.abs(c), t) for t in tried), tried[-1])  # the shortest that reads as the same number
    exponent = F.regexp_replace(F.substring_index(said, "e", -1), "^[+]", "").try_cast("int")
    digits = F.coalesce(F.nullif(F.regexp_replace(F.replace(F.substring_index(said, "e", 1), F.lit(".")), "0+$", ""), F.lit("")), F.lit("0"))
    n = F.length(digits)
    positional = (
        F.when(exponent < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits))
        .when(n <= exponent + 1, F.concat(F.rpad(digits, exponent + 1, F.lit("0")), F.lit(".0")))
        .otherwise(F.concat(F.substring(digits, F.lit(1), exponent + 1), F.lit("."), F.substring(digits, exponent + 2, n)))
    )
    tail = F.concat(F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.length(F.abs(exponent).cast("string"))), F.lit("0")))
    scientific = F.concat(F.substring(digits, F.lit(1), F.lit(1)), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(F.lit("")), F.lit("e"), tail)
    plain = F.when(c == 0, "0.0").when((exponent >= -4) & (exponent < 16), positional).otherwise(scientific)
    sign = F.when((c < 0) | c.cast("string").startswith("-"), "-").otherwise("")
    return F.when(F.isnan(c), "NaN").when(F.abs(c) == float("inf"), F.concat(sign, F.lit("Infinity"))).otherwise(F.concat(sign, plain))


def canonical_json(c: Column, kind: T.DataType) -> Column:
    """A value of any depth as JSON: keys in order of their code points at every depth, nulls kept, other atomic values as texts."""
    if isinstance(kind, T.StructType):
        fields = [F.concat(F.lit(_spelled(f.name) + ": "), canonical_json(c[f.name], f.dataType)) for f in sorted(kind.fields, key=lambda f: f.name)]
        text = F.concat(F.lit("{"), F.concat_ws(", ", *fields), F.lit("}"))
    elif isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: canonical_json(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.MapType):
        entries = F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(e["key"].cast("string").alias("key"), canonical_json(e["value"], kind.valueType).alias("value"))))
        text = F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(json_string(e["key"]), F.lit(": "), e["value"])), ", "), F.lit("}"))
    elif isinstance(kind, (T.DoubleType, T.FloatType)):
        text = float_text(c.cast("double"))
    elif isinstance(kind, (T.IntegralType, T.BooleanType)):
        text = c.cast("string")
    else:
        text = json_string(c.cast("string"))
    return F.coalesce(F.when(c.isNotNull(), text), F.lit("null"))


def _spelled(name: str) -> str:
    import json

    return json.dumps(name, ensure_ascii=False)
