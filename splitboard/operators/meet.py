"""A meet as a whole: its readers' rows enriched, names merged, best times kept, dated.

Raw rows have RAW columns; a reader that lacks one leaves it null (``conform``).
Every step is a join or an aggregate, so meets of any number run as one plan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, times
from ..session import written
from ..sources import html, lenex
from ..sources import lines as line_reader
from .fuzzy import best_indel
from .resolve import donor_names, fallback_lookup, one_per_key, wildcard_override

#: What every reader gives for one result.
RAW = {
    "meet": "string", "pdf_seq": "long", "page": "int", "line_no": "int", "name_raw": "string", "club_raw": "string", "birth_year": "int", "gender": "string",
    "stroke": "string", "distance": "int", "cents": "long", "source": "string", "participant_type": "string",
}
#: What an enriched result has.
ENRICHED = (
    "name_raw", "name", "yb", "birth_year", "age", "club_raw", "club", "city", "region", "gender", "stroke", "distance", "time_text", "cents", "source",
    "club_found", "participant_type", "pdf_seq",
)


def conform(rows: DataFrame, **names: str) -> DataFrame:
    """The RAW columns of a reader's rows; ``names`` gives its name for one that it calls otherwise."""
    have = {c: names.get(c, c) for c in RAW}
    return rows.select(*((F.col(have[c]) if have[c] in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in RAW.items()))


def arrival() -> Column:
    """The order in which a meet's rows arrive: by file, page and line, then by value, so that it never depends on partitions."""
    return F.struct("pdf_seq", "page", "line_no", "name_raw", "club_raw", "birth_year", "gender", "stroke", "distance", "cents", "source")


def club_lookup(rows: DataFrame, club: str, stored: DataFrame, sheet: DataFrame) -> DataFrame:
    """Add ``stage``, ``club``, ``city`` and ``region`` of a club's row.

    ``stored`` and ``sheet`` have (key, club, city, region, at), keys in lookup form.
    Tried in order: stored, sheet, sheet without spaces, stored without spaces. Of rows
    that share a key the first counts in the sheet, the last elsewhere.
    """
    values = ["club", "city", "region"]
    dim = lambda df, key, name, last: one_per_key(df.select(key.alias(name), *values, "at"), name, "at", last).select(name, *values)
    tight = F.replace("key", F.lit(" "), F.lit(""))
    keyed = text.settled(rows, _key=text.normalize_for_lookup(F.col(club))).withColumn("_tight", F.replace("_key", F.lit(" "), F.lit("")))
    stages = [
        ("_key", dim(stored, F.col("key"), "k1", True), "k1"),
        ("_key", dim(sheet, F.col("key"), "k2", False), "k2"),
        ("_tight", dim(sheet, tight, "k3", True), "k3"),
        ("_tight", dim(stored, tight, "k4", True), "k4"),
    ]
    return fallback_lookup(keyed, stages).drop("_key", "_tight")


def enrich_results(raw: DataFrame, overrides: DataFrame, stored: DataFrame, sheet: DataFrame, dictionary: dict[str, str] | None = None) -> DataFrame:
    """Raw rows with display names, club, city, region and age: the ENRICHED columns after the row's own others.

    ``overrides`` has (name_normalized, birth_year, club_override, city, region,
    display_name, id); a null year holds for all years. An override with a club, city
    or region replaces all three and leaves the lookup's alone; empty texts and region
    0 count as none. A looked-up club in small letters only is shown as the row has it.
    """
    keyed = text.settled(raw, name_normalized=text.normalize_for_lookup(F.col("name_raw")))
    renamed = overrides.select("name_normalized", "birth_year", "id", *(F.col(c).alias(f"o_{c}") for c in ("club_override", "city", "region", "display_name")))
    seen = wildcard_override(keyed, renamed, "name_normalized", "birth_year", "id", ["o_club_override", "o_city", "o_region", "o_display_name"])
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    seen = seen.withColumns({f"o_{c}": blank(F.col(f"o_{c}")) for c in ("club_override", "city", "display_name")}).withColumn("o_region", F.nullif("o_region", F.lit(0)))
    known = F.coalesce("o_club_override", "o_city", F.col("o_region").cast("string")).isNotNull()
    found = club_lookup(seen, "club_raw", stored, sheet)
    shown = text.normalize_display(F.col("club_raw"))
    canonical = F.when(F.col("club") != F.lower("club"), F.col("club"))
    out = found.withColumns({
        "name": text.restore_display(F.coalesce("o_display_name", text.normalize_display(F.col("name_raw"))), dictionary or {}),
        "yb": F.coalesce(F.lpad(F.pmod("birth_year", F.lit(100)).cast("string"), 2, "0"), F.lit("")),
        "age": times.age(F.col("birth_year")),
        "club": F.when(known, F.coalesce("o_club_override", shown)).otherwise(F.coalesce(canonical, shown)),
        "city": F.when(known, F.col("o_city")).otherwise(F.col("city")),
        "region": F.when(known, F.col("o_region")).otherwise(F.col("region")),
        "time_text": times.display_time(F.col("cents")),
        "club_found": known | F.col("stage").isNotNull(),
    })
    return out.select(*(c for c in raw.columns if c not in ENRICHED), *ENRICHED)


def merge_abbreviations(rows: DataFrame, by: Sequence[str], order: str) -> DataFrame:
    """Give a row whose first name is an initial and a dot the full names of its surname, club, year and ``by``.

    The last full name to arrive stands for its key; its first letter must be the initial.
    """
    short = F.col("name_raw").rlike(r"^\p{Lu}\.\s+\S")
    words = F.split(text.squeeze(F.col("name_raw")), " ")
    keyed = text.settled(rows, _short=short, _last=text.normalize_for_lookup(F.element_at(words, -1)), _club=text.normalize_for_lookup(F.col("club_raw")))
    full = keyed.where(~F.col("_short") & (F.size(words) >= 2)).groupBy(*by, "_last", "_club", "birth_year").agg(F.max_by(F.struct("name_raw", "name"), order).alias("_full"))
    # Rows with whole names look for nothing: a key of their own, none of which is found, spreads them.
    own = F.when(F.col("_short"), F.col("_last")).otherwise(F.concat(F.lit("\0"), F.xxhash64(order).cast("string")))
    names = [*by, "_last", "_club", "birth_year"]
    right = full.select(*(F.col(c).alias(f"_r{i}") for i, c in enumerate(names)), "_full")
    on = [F.col(c).eqNullSafe(F.col(f"_r{i}")) for i, c in enumerate(names)]
    found = keyed.withColumn("_last", own).join(right, on, "left")
    taken = F.col("_short") & (F.upper(F.substring(F.col("_full.name_raw"), 1, 1)) == F.substring("name_raw", 1, 1))
    return found.withColumns({c: F.when(taken, F.col(f"_full.{c}")).otherwise(F.col(c)) for c in ("name_raw", "name")}).select(*rows.columns)


def correct_recognised(rows: DataFrame, athletes: DataFrame, cutoff: float = 82.0, stored: DataFrame | None = None, sheet: DataFrame | None = None) -> DataFrame:
    """Recognised rows (source "ocr") take the name of the most similar athlete (known_name, birth_year, gender) that reaches the cutoff.

    A name that is the athlete's without its blanks stays. With the club dimensions of
    ``club_lookup`` a corrected row without a found club takes the club, city and region
    of the athlete's ``club`` (of several athletes of one name the first by value that
    has one), if that is found.
    """
    group = ["birth_year", "gender"]
    read = rows.where("source = 'ocr'").withColumn("_seen", F.coalesce("name", "name_raw"))
    club = F.nullif("club", F.lit("")) if "club" in athletes.columns else F.lit(None).cast("string")
    known = athletes.groupBy("known_name", *group).agg(F.min(club).alias("_club"))
    values = ("club", "city", "region")
    if stored is not None and sheet is not None:
        clubs = club_lookup(known.select("_club").where("_club IS NOT NULL").distinct(), "_club", stored, sheet).where("stage IS NOT NULL")
        known = known.join(clubs.select("_club", F.struct(*values).alias("_of")), "_club", "left")
    best = best_indel(read.select("_seen", *group).distinct(), known, group, "_seen", "known_name", cutoff).drop("similarity")
    mended = read.join(best.join(known, ["known_name", *group]), ["_seen", *group], "left")
    changed = F.col("known_name").isNotNull() & (F.lower("known_name") != text.nospace(F.col("_seen")))
    out = {c: F.when(changed, F.col("known_name")).otherwise(F.col(c)) for c in ("name", "name_raw")}
    if "_of" in mended.columns:
        filled = changed & ~F.coalesce("club_found", F.lit(False)) & F.col("_of").isNotNull()
        out |= {c: F.when(filled, F.col(f"_of.{c}")).otherwise(F.col(c)) for c in values} | {"club_found": F.when(filled, True).otherwise(F.col("club_found"))}
    return rows.where(~F.col("source").eqNullSafe("ocr")).unionByName(mended.withColumns(out).select(*rows.columns))


def meet_results(
    archive: DataFrame, listed: DataFrame, dates: DataFrame, overrides: DataFrame, stored: DataFrame, sheet: DataFrame,
    dictionary: dict[str, str] | None = None, progression: DataFrame | None = None, athletes: DataFrame | None = None,
) -> DataFrame:
    """All meets' results: one row for each athlete, stroke and distance of a meet, with ``race_date``.

    All inputs but ``dates`` (meet, race_date) and the dimensions are RAW rows. A meet
    whose archive has results takes those only, any other its lists' (with those of the
    progression report, if given). ``athletes`` turns on the correction of recognised
    names and their clubs. A meet without a date has ''. For lists alone give an empty archive and no dates.
    """
    rest = listed if progression is None else listed.unionByName(progression)
    raw = archive.unionByName(rest.join(archive.select("meet").distinct(), "meet", "left_anti"))
    # Written once: names are looked for in the same rows that take them, and readers are dear. Few small inputs would else stay few partitions.
    rows = written(enrich_results(raw, overrides, stored, sheet, dictionary).withColumn("_at", arrival()))
    rows = merge_abbreviations(rows, ["meet"], "_at")
    if athletes is not None:
        rows = correct_recognised(rows, athletes, stored=stored, sheet=sheet)
    # Null years are one person's as others are.
    keyed = text.settled(rows, _who=text.nospace(F.col("name_raw")), _year=F.coalesce("birth_year", F.lit(0)))
    best = donor_names(keyed, ["meet", "_who", "_year"], ["stroke", "distance"], "name", "cents", "_at", ["name_raw"])
    dated = best.join(dates.groupBy("meet").agg(F.max("race_date").alias("race_date")), "meet", "left")
    return dated.withColumn("race_date", F.coalesce("race_date", F.lit(""))).select("meet", *ENRICHED, "race_date")


def landed_lists(pages: DataFrame, lines: DataFrame, spread: str = "whole") -> DataFrame:
    """RAW rows of the result lists that index pages link.

    ``pages`` has (meet, html), ``lines`` (meet, file, page, line_no, text), ``file`` as
    the page's link ends. A page's table says which event a file is; that holds until
    a header in the file says otherwise. A file that no page names has headers alone.
    """
    found = html.event_map(pages, "meet", "html")
    events = html.propagate_start_lists(html.event_map(pages, "meet", "html", "StartList"), found, "meet")
    hints = events.select("meet", "file", F.struct("gender", "distance", "stroke").alias("hint"))
    named = lines.join(hints, ["meet", "file"], "left").withColumn("doc", F.struct("meet", "file"))
    read = line_reader.result_lines(named, F.col("hint"), spread=spread)
    number = F.regexp_extract("doc.file", r"(\d+)\.\w+$", 1).try_cast("long")
    return conform(read.withColumns({"meet": F.col("doc.meet"), "pdf_seq": number}), name_raw="name", club_raw="club")


def landed_archives(swims: DataFrame, names: Column) -> DataFrame:
    """RAW rows of archives (``archive`` rows of kind results); ``names`` gives a path's meet."""
    return conform(lenex.results(swims).withColumn("meet", names), name_raw="name", club_raw="club")


def landed_dates(pages: DataFrame) -> DataFrame:
    """(meet, race_date) of the pages' first tables."""
    return html.meet_meta(pages, "meet", "html").select("meet", times.race_date(F.col("date")).alias("race_date"))


def manual_overrides(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    """Rows with the club, city, region and name that the override file has for a name, year and gender.

    Names are compared trimmed and in small letters; an empty value leaves the row's;
    of overrides of one key the last by its values counts.
    """
    spell = lambda c: F.trim(F.lower(c))
    values = ["canonical_club", "canonical_city", "canonical_name", *(c for c in ["canonical_region"] if c in overrides.columns)]
    dim = overrides.where("resolution = 'same'").groupBy(spell("name").alias("_name"), F.col("birth_year").alias("_by"), F.col("gender").alias("_g")).agg(F.max(F.struct(*values)).alias("_o"))
    joined = rows.join(dim, (spell(rows["name"]) == F.col("_name")) & (rows["birth_year"] == F.col("_by")) & (rows["gender"] == F.col("_g")), "left")
    pick = lambda c: F.nullif(F.col(f"_o.canonical_{c}").cast("string"), F.lit(""))
    out = {c: F.coalesce(pick(c).cast(rows.schema[c].dataType), F.col(c)) for c in ("club", "city", "region", "name") if f"canonical_{c}" in values}
    return joined.withColumns(out).select(*rows.columns)


def gender_code(value: Column, names: dict[str, str]) -> Column:
    """F or M: by ``names``, else the first letter in capitals; null for any other."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    code = F.coalesce(table[F.trim(value)], F.upper(F.substring(F.trim(value), 1, 1)))
    return F.when(code.isin("F", "M"), code)


def cohort(rows: DataFrame, year: str, years: Sequence[int] | None) -> DataFrame:
    """Rows of the birth years; none given: all. The list reaches the scan."""
    return rows.where(F.col(year).isin(*years)) if years else rows


def scored_cohort(rows: DataFrame, years: Sequence[int], genders: dict[str, str], overrides: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Enriched rows of the cohort with a known gender, overrides applied, that reach some threshold; with ``points``."""
    from .score import threshold_join

    known = cohort(rows, "birth_year", years).withColumn("gender", gender_code(F.col("gender"), genders)).where(F.col("gender").isNotNull())
    named = manual_overrides(known, overrides)
    dim = thresholds.select("birth_year", "gender", "stroke", "distance", "points", F.col("max_cs").alias("limit"))
    return threshold_join(named, dim, ["birth_year", "gender", "stroke", "distance"], "cents").where("points > 0")
