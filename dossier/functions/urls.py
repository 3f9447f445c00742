"""URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIRECT_FILES = ("pdf", "doc", "docx", "xls", "xlsx", "zip", "rar", "7z", "xml")
READABLE_FILES = ("docx", "xlsx", "zip")


def host(c: Column) -> Column:
    """Lower case, without www., user and port; null if there is none."""
    found = F.regexp_extract(c, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    bare = F.regexp_replace(F.regexp_replace(found, r"^.*@", ""), r":\d*$", "")
    return F.nullif(F.regexp_replace(F.lower(bare), r"^www\.", ""), F.lit(""))


def path(c: Column) -> Column:
    return F.regexp_extract(c, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def query_value(c: Column, name: str) -> Column:
    """The first value of a query parameter, decoded; null if there is none."""
    query = F.regexp_extract(c, r"\?([^#]*)", 1)
    raw = F.regexp_extract(query, rf"(?:^|&){name}=([^&]*)", 1)
    return F.nullif(F.coalesce(F.try_url_decode(raw), raw), F.lit(""))


def base_name(c: Column) -> Column:
    """The last segment of the decoded path."""
    raw = path(c)
    plain = F.regexp_replace(F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw), r"\\", "/")
    return F.element_at(F.split(plain, "/"), -1)


def extension(name: Column) -> Column:
    """The last extension in lower case with its dot, or nothing."""
    return F.lower(F.regexp_extract(name, r"[^.](\.[^./\\]*)$", 1))


def is_readable(c: Column) -> Column:
    return extension(base_name(c)).isin(*(f".{x}" for x in READABLE_FILES))


def page_url(section_url: Column, page: Column) -> Column:
    """A section's first page is its own URL; later ones end with their number."""
    return F.when(page == 1, section_url).when(page > 1, F.concat(F.regexp_replace(section_url, "/+$", ""), F.lit("/"), page.cast("string")))


def classified(c: Column, rules: list[tuple[str, str | None, str]], files: tuple[str, ...] = DIRECT_FILES) -> Column:
    """The kind of the first rule (host, part of path, kind) that fits; then direct_file by extension; then rules for files whose part starts with ^; else unknown."""
    h, p = host(c), path(c)
    kind = F.lit("unknown")
    for name, part, value in reversed([r for r in rules if r[1] and r[1].startswith("^")]):
        kind = F.when((h == name) & p.startswith(part[1:]), value).otherwise(kind)
    kind = F.when(F.lower(p).rlike(rf"\.({'|'.join(files)})$"), "direct_file").otherwise(kind)
    for name, part, value in reversed([r for r in rules if not (r[1] and r[1].startswith("^"))]):
        fits = (h == name) & (p.contains(part) if part else F.lit(True))
        kind = F.when(fits, value).otherwise(kind)
    return kind
