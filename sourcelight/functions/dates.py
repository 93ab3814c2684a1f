"""Date scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def news_date(c: Column) -> Column:
    """ISO day of an RFC-822 or ISO-8601 stamp in its own zone, else 10 characters.

    The day is read in the stamp's own offset, so no zone conversion happens.
    """
    raw = F.trim(F.coalesce(c, F.lit("")))
    rfc = F.regexp_extract(raw, r"(?i)^(?:[a-z]{3},?\s+)?(\d{1,2})\s+([a-z]{3})[a-z]*\s+(\d{4})\b", 0)
    rfc_core = F.regexp_replace(rfc, r"(?i)^[a-z]{3},?\s+(?=\d)", "")
    from_rfc = F.try_to_date(rfc_core, "d MMM yyyy") if hasattr(F, "try_to_date") else F.to_date(
        F.try_to_timestamp(rfc_core, F.lit("d MMM yyyy"))
    )
    iso = F.regexp_extract(raw, r"^(\d{4}-\d{2}-\d{2})(?:[T ]\d{2}.*)?$", 1)
    from_iso = F.to_date(F.try_to_timestamp(F.nullif(iso, F.lit("")), F.lit("yyyy-MM-dd")))
    return F.coalesce(
        F.date_format(F.when(rfc != "", from_rfc), "yyyy-MM-dd"),
        F.date_format(from_iso, "yyyy-MM-dd"),
        F.substring(F.coalesce(c, F.lit("")), 1, 10),
    )


def month_day_year(c: Column) -> Column:
    """``Sep 5, 2026`` to an ISO day; null when it does not parse."""
    return F.date_format(F.try_to_timestamp(c, F.lit("MMM d, yyyy")), "yyyy-MM-dd")


def cjk_date(c: Column) -> Column:
    """First ``年 月 日`` date of the text as an ISO day, else empty."""
    pattern = r"(20\d{2})\s*年\s*(\d{1,2})\s*月\s*(\d{1,2})\s*日"
    part = [F.regexp_extract(c, pattern, i) for i in (1, 2, 3)]
    return F.when(
        part[0] != "",
        F.concat_ws("-", part[0], F.lpad(part[1], 2, "0"), F.lpad(part[2], 2, "0")),
    ).otherwise(F.lit(""))


def days_since(day: Column, today: Column | None = None) -> Column:
    return F.greatest(F.datediff(F.current_date() if today is None else today, F.to_date(day)), F.lit(0))
