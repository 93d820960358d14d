"""Dates and version keys as column expressions; every function returns null for what it cannot read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL_WIDTH = "０１２３４５６７８９"
PLAIN_DIGITS = "0123456789"
_PARTED = r"^\s*(\d{4})\s*[.\-/년]\s*(\d{1,2})\s*[.\-/월]\s*(\d{1,2})\s*[.일]?\s*$"
_KEY = r"^\s*(\d{4})\s*[.\-/년]?\s*(\d{1,2})\s*[.\-/월]?\s*(\d{1,2})\s*[.일]?\s*\|\s*제?\s*(\d+)\s*호?\s*$"


def _plain_digits(c: Column) -> Column:
    return F.translate(c, FULL_WIDTH, PLAIN_DIGITS)


def real_day(c: Column) -> Column:
    """``c`` if it is an eight-digit calendar day, else null."""
    ok = c.rlike(r"^[1-9]\d{7}$") & F.try_to_timestamp(c, F.lit("yyyyMMdd")).isNotNull()
    return F.when(ok, c)


def norm_date(c: Column) -> Column:
    """Any spelling of a day as ``YYYYMMDD``; missing, partial or impossible days are null."""
    s = _plain_digits(c)
    parted = F.concat(
        F.regexp_extract(s, _PARTED, 1),
        F.lpad(F.regexp_extract(s, _PARTED, 2), 2, "0"),
        F.lpad(F.regexp_extract(s, _PARTED, 3), 2, "0"),
    )
    return real_day(F.when(s.rlike(r"^\s*\d{8}\s*$"), F.trim(s)).when(s.rlike(_PARTED), parted))


def norm_version_key(c: Column) -> Column:
    """``YYYYMMDD|N`` without leading zeros in N; blank, ``|`` and unreadable keys are null."""
    s = _plain_digits(c)
    number = F.regexp_replace(F.regexp_extract(s, _KEY, 4), r"^0+(?=\d)", "")
    parts = [F.regexp_extract(s, _KEY, 1), F.lpad(F.regexp_extract(s, _KEY, 2), 2, "0"), F.lpad(F.regexp_extract(s, _KEY, 3), 2, "0")]
    return F.when(s.rlike(_KEY), F.concat(*parts, F.lit("|"), number))


def day_before(c: Column) -> Column:
    return F.date_format(F.date_sub(F.to_date(c, "yyyyMMdd"), 1), "yyyyMMdd")
