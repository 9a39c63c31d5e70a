"""Times in integer hundredths, years and dates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The season that ages refer to.
SEASON = 2026


def parse_time(text: Column) -> Column:
    """SS.cc, M:SS.cc or H:M:S.cc to hundredths (long); comma and semicolon are decimal marks; null if malformed."""
    clean = F.regexp_replace(F.trim(text), "[,;]", ".")
    parts = F.split(clean, ":")
    number = lambda i: F.get(parts, F.lit(i)).try_cast("decimal(12,4)")
    seconds = (
        F.when(F.size(parts) == 1, number(0))
        .when(F.size(parts) == 2, number(0) * 60 + number(1))
        .when(F.size(parts) == 3, number(0) * 3600 + number(1) * 60 + number(2))
    )
    return F.when(clean.rlike(r"^\d[\d:.]*$"), F.round(seconds * 100).cast("long"))


def lenex_time(text: Column) -> Column:
    """As parse_time; zero times and NT are null."""
    cents = parse_time(text)
    return F.when(cents > 0, cents)


def display_time(cents: Column) -> Column:
    """Below a minute SS.cc, else M:SS.cc."""
    minutes, rest = F.floor(cents / 6000), F.pmod(cents, F.lit(6000))
    tail = F.concat(F.floor(rest / 100).cast("string"), F.lit("."), F.lpad(F.pmod(rest, F.lit(100)).cast("string"), 2, "0"))
    return F.when(minutes > 0, F.concat(minutes.cast("string"), F.lit(":"), F.lpad(tail, 5, "0"))).otherwise(tail)


def fix_ocr_time(cents: Column, text: Column, least: Column) -> Column:
    """A time without minutes below the event's least gets the fewest minutes (1 to 20) that reach it."""
    add = F.ceil((least - cents) / 6000)
    fixable = ~text.contains(":") & (cents < least) & (add <= 20)
    return F.when(fixable, cents + add * 6000).otherwise(cents)


def birth_year(two_digits: Column) -> Column:
    """0 to 26 are 2000 and later, 27 to 99 are 1900 and later, else null."""
    n = F.floor(two_digits.cast("string").try_cast("double")).cast("int")
    return F.when(n.between(0, SEASON - 2000), n + 2000).when(n.between(SEASON - 1999, 99), n + 1900)


def age(year: Column) -> Column:
    return F.lit(SEASON) - year


def age_category(years: Column) -> Column:
    """The age as text; null without one."""
    return years.cast("string")


def parse_birthdate(text: Column) -> Column:
    """The year before the first dash, 1900 to the season, else null."""
    year = F.split_part(text, F.lit("-"), F.lit(1)).try_cast("int")
    return F.when(year.between(1900, SEASON), year)


def plausible_year(year: Column) -> Column:
    """The year if it gives an age of 8 to 60; a leading 6 misread for 1 in its last two digits is mended."""
    fine = lambda y: (F.lit(SEASON) - y).between(8, 60)
    short = F.pmod(year, F.lit(100))
    mended = F.when(F.floor(short / 10) == 6, F.lit(2010) + F.pmod(short, F.lit(10))).cast("int")
    return F.when(fine(year), year).when(fine(mended), mended)


def race_date(text: Column) -> Column:
    """YYYY.MM.DD of an ISO date, or of day, month (first and last short number) and a 4-digit year."""
    iso = F.regexp_extract(text, r"(\d{4})-(\d{2})-(\d{2})", 0)
    year = F.regexp_extract(text, r"(\d{4})", 1)
    short = F.regexp_extract_all(F.split_part(text, year, F.lit(1)), F.lit(r"(?<!\d)(\d{1,2})(?!\d)"), F.lit(1))
    free = F.concat_ws(".", year, F.lpad(F.element_at(short, -1), 2, "0"), F.lpad(F.element_at(short, 1), 2, "0"))
    return F.when(iso != "", F.replace(iso, F.lit("-"), F.lit("."))).when((year != "") & (F.size(short) >= 2), free)
