"""String expressions: normalisation, predicates, parsing and identifiers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.canonical import casefolded

#: White space as text parsing sees it: Unicode spaces and the four separator controls.
SPACES = r"[\s\u001C-\u001F\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
# Words that stand for nothing, device names that a file can't have, and lots' names that say no more than a number.
EMPTY_WORDS = ("", "none", "null", "n/a")
RESERVED_NAMES = r"(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\..*)?$"
LOT_PLACEHOLDER = r"(?iuU)^(лот|lot|լոտ)\s*(№|#|n)?\s*\d+$"


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACES}+|{SPACES}+$", "")


def collapsed(c: Column) -> Column:
    """Each run of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACES}+", " "))


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.regexp_replace(c, f"{SPACES}+", "") == "")


def unix_lines(c: Column) -> Column:
    return stripped(F.regexp_replace(c, "\r\n?", "\n"))


def label(c: Column) -> Column:
    """A form label: collapsed, without a colon at the end, its case folded."""
    return casefolded(F.rtrim(F.regexp_replace(collapsed(c), ":+$", "")))


def meaningful(c: Column) -> Column:
    """Collapsed text, null where it says nothing."""
    plain = collapsed(c)
    return F.when(~F.lower(plain).isin(*EMPTY_WORDS), plain)


def missing_fields(required: dict[str, Column]) -> Column:
    """Names of required fields that are blank."""
    return F.filter(F.array(*(F.when(is_blank(c), F.lit(name)) for name, c in required.items())), lambda x: x.isNotNull())


def amount(c: Column) -> Column:
    """Digits, or groups of three parted by a space, no-break space or narrow one, as a whole number; else null."""
    parted = c.rlike(r"^\d{1,3}([ \u00A0\u202F]\d{3})+$|^\d+$")
    return F.when(parted, F.regexp_replace(c, r"[ \u00A0\u202F]", "").try_cast("long"))


def natural_number(c: Column) -> Column:
    return F.when(c.rlike(r"^\d+$"), c.try_cast("long"))


def currency_is(c: Column, marker: str, others: str) -> Column:
    """The marker is there and no other currency's."""
    return c.rlike(f"(?iu){marker}") & ~c.rlike(f"(?iu){others}")


def sentences(c: Column) -> Column:
    return F.split(c, r"(?<=[.!?])\s+")


def is_placeholder(c: Column) -> Column:
    """A lot's name that is only the word lot, in three languages, and its number."""
    return F.coalesce(collapsed(c).rlike(LOT_PLACEHOLDER), F.lit(False))


def category_label(code: Column, names: dict[str, str]) -> Column:
    """The name of a category; of one without a name its code with spaces and a capital."""
    said = meaningful(code)
    plain = F.replace(said, F.lit("_"), F.lit(" "))
    out = F.concat(F.upper(F.substring(plain, 1, 1)), F.substring(plain, F.lit(2), F.length(plain)))
    for name, label_ in names.items():
        out = F.when(said == name, F.lit(label_)).otherwise(out)
    return out


def grouped_number(c: Column) -> Column:
    """A whole number with spaces between its thousands."""
    return F.replace(F.format_number(c, 0), F.lit(","), F.lit(" "))


def is_snake_case(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[a-z][a-z0-9]*(_[a-z0-9]+)*$"), F.lit(False))


def html_escaped(c: Column) -> Column:
    for plain, code in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def redacted(c: Column, secrets: str, mask: str = "***") -> Column:
    return F.regexp_replace(c, secrets, mask)


def digest_name(c: Column, prefix: str = "", chars: int = 16) -> Column:
    """The first hex digits of the SHA-256, after a prefix."""
    return F.concat(F.lit(prefix), F.substring(F.sha2(c, 256), 1, chars))


def let(c: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is worked out once, however often body uses it."""
    return F.element_at(F.transform(F.array(c), body), 1)


def safe_file_name(c: Column, most: int = 150, default: str = "document") -> Column:
    """A name without folders, controls and characters that file systems refuse; the extension survives cutting."""
    name = F.regexp_extract(F.regexp_replace(c, r"\\", "/"), "[^/]*$", 0)
    name = F.regexp_replace(name, r"[\u0000-\u001F\u007F]", "")
    name = F.regexp_replace(name, r'[<>:"|?*]', "_")
    name = F.regexp_replace(name, r"^[ .]+|[ .]+$", "")

    def cut(n: Column) -> Column:
        extension = F.regexp_extract(n, r"(\.[^.]{1,10})$", 1)
        return F.when(F.length(n) > most, F.concat(F.substring(n, F.lit(1), most - F.length(extension)), extension)).otherwise(n)

    def allowed(n: Column) -> Column:
        return F.when(n.rlike(RESERVED_NAMES), F.concat(F.lit("_"), n)).when(n == "", F.lit(default)).otherwise(n)

    return F.coalesce(let(let(name, cut), allowed), F.lit(default))


def padded(c: Column, width: int) -> Column:
    """Text of one width: cut with an ellipsis or filled up."""
    return F.when(F.length(c) > width, F.concat(F.substring(c, 1, width - 1), F.lit("…"))).otherwise(F.rpad(c, width, " "))


def changed_fields(pairs: dict[str, tuple[Column, Column]]) -> Column:
    """Names of the fields whose two values differ, nulls being equal."""
    return F.filter(F.array(*(F.when(~a.eqNullSafe(b), F.lit(name)) for name, (a, b) in pairs.items())), lambda x: x.isNotNull())


def cpv_codes(lines: Column) -> Column:
    """Lines of a classification as array of struct(code, name): eight digits, a hyphen and a name, other lines as a name without a code.  Blank lines are left out; none gives null."""
    said = F.filter(F.transform(lines, collapsed), lambda x: x != "")
    part = lambda x, i: F.regexp_extract(x, r"^([0-9]{8})\s*-\s*(.*)$", i)
    code = lambda x: F.nullif(part(x, 1), F.lit(""))
    found = F.transform(said, lambda x: F.struct(code(x).alias("code"), F.when(code(x).isNull(), x).otherwise(F.nullif(part(x, 2), F.lit(""))).alias("name")))
    return F.when(F.size(found) > 0, found)


def callback_id(data: Column) -> Column:
    """The delivery that a button's data full:<id> names; null for any other data."""
    return F.nullif(F.regexp_extract(data, r"^full:([0-9]{1,18})\z", 1), F.lit("")).cast("long")
