"""Free-text dates to integer fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -----------------------------------------------------------
MONTHS = (
    ("january", "jan"), ("february", "feb"), ("march", "mar"), ("april", "apr"), ("may",),
    ("june", "jun"), ("july", "jul"), ("august", "aug"), ("september", "sep", "sept"),
    ("october", "oct"), ("november", "nov"), ("december", "dec"),
)
# -----------------------------------------------------------------------------


def number(digits: Column) -> Column:
    """An integer; NULL for no digits without a cast, which fails by an exception each time."""
    return F.nullif(digits, F.lit("")).try_cast("int")


def _group(text: Column, pattern: str, index: int) -> Column:
    return number(F.regexp_extract(text, pattern, index))


def first_year(text: Column) -> Column:
    """First free-standing four-digit number."""
    return _group(text, r"(?U)\b(\d{4})\b", 1)


def normalize_date(text: Column) -> Column:
    """struct(date_year, date_month, date_day_start, date_day_end)."""
    raw = F.trim(text)
    iso = r"^(\d{4})-(\d{1,2})-(\d{1,2})"
    is_iso = raw.rlike(iso)
    plain = F.translate(raw, "–—", "--")
    span = r"(?U)\b(\d{1,2})\s*-\s*(\d{1,2})\b"
    dashed = plain.contains("-")
    # The calendar order decides between two month names, not the text order.
    named = F.regexp_extract_all(plain, F.lit(rf"(?iU)\b({'|'.join(n for names in MONTHS for n in names)})\b"), F.lit(1))
    short = F.array(*[F.lit(names[-1][:3]) for names in MONTHS])
    month = F.array_min(
        F.transform(named, lambda n: F.array_position(short, F.lower(F.substring(n, 1, 3))).cast("int"))
    )
    lone_day = _group(plain, r"(?U)\b(\d{1,2})\b", 1)
    start = F.coalesce(F.when(dashed, _group(plain, span, 1)), F.when(lone_day <= 31, lone_day))
    return F.struct(
        F.when(is_iso, _group(raw, iso, 1)).otherwise(first_year(plain)).alias("date_year"),
        F.when(is_iso, _group(raw, iso, 2)).otherwise(month).alias("date_month"),
        F.when(is_iso, _group(raw, iso, 3)).otherwise(start).alias("date_day_start"),
        F.when(~is_iso & dashed, _group(plain, span, 2)).alias("date_day_end"),
    )


def games_id(text: Column) -> Column:
    """"2012 Summer" anywhere in the text to ``2012-Summer``; NULL otherwise."""
    pattern = r"(?i)(\d{4})\s*(Summer|Winter)"
    year, season = F.regexp_extract(text, pattern, 1), F.regexp_extract(text, pattern, 2)
    return F.when(year != "", F.concat(year, F.lit("-"), F.initcap(season)))


def games_year(games: Column) -> Column:
    """Year part of a Games id."""
    return number(F.regexp_extract(games, r"^(\d+)(?:-|$)", 1))


def games_season(games: Column) -> Column:
    """Season part of a Games id."""
    return F.nullif(F.regexp_extract(games, r"^[^-]*-(.*)$", 1), F.lit(""))


def edition_of(event_id: Column) -> Column:
    """Edition segment of an event id, "" when it has none."""
    return F.regexp_extract(F.concat(F.lit("-"), event_id, F.lit("-")), r"-(\d{4}-(?:Summer|Winter))-", 1)
