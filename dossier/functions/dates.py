"""Date expressions: parsing what pages say, deadlines, months."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dossier.functions.text import collapsed, let

# The formats in which pages give times, and their zone.
#: Formats of detail pages; the day and the hour may have one digit.
DETAIL_FORMATS = ("d/M/yyyy H:m:s", "d/M/yyyy H:m", "yyyy-M-d H:m:s")
DAY_FORMATS = ("yyyy-M-d", "d/M/yyyy")
TIME_FORMATS = ("yyyy-M-d H:m:s", "yyyy-M-d H:m", "d/M/yyyy H:m:s", "d/M/yyyy H:m")
#: Times with an offset: day, time and fraction by Spark's patterns, the offset as Z, +04:00 or +0400.
OFFSET_FORMATS = tuple(f"yyyy-MM-dd{between}HH:mm[:ss[.SSSSSSSSS]]{offset}" for between in ("'T'", " ") for offset in ("XXX", "XX"))
LOCAL_ZONE = "Asia/Yerevan"


def _first(c: Column, formats: tuple[str, ...]) -> Column:
    return F.coalesce(*(F.try_to_timestamp(c, F.lit(f)) for f in formats))


def normal_datetime(c: Column) -> Column:
    """yyyy-MM-dd HH:mm:ss of a detail page's date, null for any other form."""
    return F.date_format(_first(collapsed(c), DETAIL_FORMATS), "yyyy-MM-dd HH:mm:ss")


def deadline(c: Column, zone: str = LOCAL_ZONE) -> Column:
    """The instant of a deadline: a day ends at its last second, times are local unless they carry an offset; else null.

    The session's time zone must be UTC.
    """


    def read(plain: Column) -> Column:
        day = _first(plain, DAY_FORMATS) + F.expr("INTERVAL '23:59:59' HOUR TO SECOND")
        return F.coalesce(F.to_utc_timestamp(F.coalesce(day, _first(plain, TIME_FORMATS)), zone), _first(plain, OFFSET_FORMATS))

    return let(collapsed(c), read)


def eligibility(given: list[Column], now: Column, zone: str = LOCAL_ZONE) -> Column:
    """struct(status, resolved) of deadlines as texts at an instant.

    No deadline that can be read: unknown.  All past: expired, but unknown if another can't be read.  Else eligible if all
    are one instant, and conflict if not.  resolved is the latest.
    """
    each = F.array(*(F.struct(deadline(c, zone).alias("at"), F.coalesce(collapsed(c) != "", F.lit(False)).alias("said")) for c in given))
    return let(each, lambda x: _eligibility(x, now))


def _eligibility(each: Column, now: Column) -> Column:
    read = F.filter(F.transform(each, lambda x: x["at"]), lambda at: at.isNotNull())
    bad = F.exists(each, lambda x: x["said"] & x["at"].isNull())
    latest = F.array_max(read)
    status = (
        F.when(F.size(read) == 0, "unknown")
        .when((latest <= now) & bad, "unknown")
        .when(latest <= now, "expired")
        .when(F.size(F.array_distinct(read)) == 1, "eligible")
        .otherwise("conflict")
    )
    return F.struct(status.alias("status"), latest.alias("resolved"))


def dates_match(a: Column, b: Column) -> Column:
    """Whether two texts are equal; null unless both say something."""
    return F.when((collapsed(a) != "") & (collapsed(b) != ""), a == b)


def month_start(c: Column) -> Column:
    return F.date_trunc("month", c)


def utc_text(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ssXXX")


def local_display(c: Column, zone: str = LOCAL_ZONE) -> Column:
    return F.date_format(F.from_utc_timestamp(c, zone), "dd.MM.yyyy HH:mm")


def first_datetime(c: Column) -> Column:
    """The first yyyy-MM-dd HH:mm:ss in a text."""
    return F.nullif(F.regexp_extract(c, r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})", 1), F.lit(""))


def until_datetime(c: Column) -> Column:
    """The time after the word that means until; null for open-ended or other texts."""
    return F.nullif(F.regexp_extract(c, r"(?iU)\bДо\s+(\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2})", 1), F.lit(""))
