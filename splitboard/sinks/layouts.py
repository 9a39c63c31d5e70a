"""Workbooks in their fixed layouts: a meet's results, rankings, and the comparison of two rosters.

Each layout is a DataFrame first (``*_sheet``), so that it can be written in any
form; ``write_*`` gives workbooks, which tasks write (``books``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normalize_for_lookup
from ..operators import report
from .books import Layout, Style, sheet_rows, write_books

# Events in the order of the sheets' columns.
EVENTS = (
    ("Serbest", 50), ("Serbest", 100), ("Serbest", 200), ("Serbest", 400), ("Serbest", 800), ("Serbest", 1500),
    ("Sırtüstü", 50), ("Sırtüstü", 100), ("Sırtüstü", 200), ("Kurbağalama", 50), ("Kurbağalama", 100), ("Kurbağalama", 200),
    ("Kelebek", 50), ("Kelebek", 100), ("Kelebek", 200), ("Karışık", 200), ("Karışık", 400),
)
# Headings of a meet's sheet.
BASE = ("Ad Soyad", "YB", "Kulüp", "Şehir", "Bölge", "Yaş", "Cinsiyet")
# Headings of a roster comparison, and its colours with their meaning.
ROSTER = ("{0} - Sporcu", "{0} - Kulüp", "Doğum Yılı", "Cinsiyet", "{1} - Sporcu", "{1} - Kulüp")
COLOURS = {"both": "E8F5E9", "differs": "FADBD8", "only_a": "FFF3CD", "only_b": "D1ECF1"}
MEANING = {
    "both": ("Yeşil", "Her iki yarışta da var, kulüp eşleşiyor"), "differs": ("Kırmızı", "Her iki yarışta da var, kulüp farklı"),
    "only_a": ("Sarı", "Sadece birinci yarışta"), "only_b": ("Mavi", "Sadece ikinci yarışta"),
}
#: Headings of a ranking sheet before its events, with the column that each shows; {0} and {1} are the legs.
RANKING = (
    ("Sıra", "place"), ("Ad Soyad", "name"), ("Kulüp", "club"), ("Şehir", "city"), ("Bölge", "region"), ("Seçim", "selected_label"), ("Eşit", "tied"), ("Top3 {0}", "top3_{0}"),
    ("Top3 {1}", "top3_{1}"), ("Top3", "top3"), ("Dizi", "seq_display"), ("Bölge sıra", "region_place"),
)
# Colours, letters and widths of the sheets.
RESULT_STYLES = {
    "head": Style("1F4E79", "FFFFFF", True, 10, True, True), "sub": Style("2E75B6", "FFFFFF", True, 9, True, True), "left": Style(border=True), "mid": Style(centre=True, border=True),
    "left2": Style("F2F2F2", border=True), "mid2": Style("F2F2F2", centre=True, border=True),
}
RESULT_WIDTHS = [28, 5, 32, 14, 7, 5, 9] + [9] * len(EVENTS)
SELECTED = {"MULTINATIONS": "7B4F00", "TR": "1B5E20", "BÖLGE": "0D47A1", "tied": "4A235A"}
RANKING_STYLES = {k: Style(c, "FFFFFF", True, 10) for k, c in SELECTED.items()} | {"title": Style("1A237E", "FFFFFF", True, 10), "header": Style("263238", "FFFFFF", True, 10, True), "plain": Style(None, "1A1A1A", False, 10)}
RANKING_WIDTHS = [6, 26, 26, 12, 5, 14, 5, 7, 7, 7, 16, 6] + [5] * 3 * len(EVENTS)
ROSTER_WIDTHS = [32, 48, 12, 10, 32, 48]


def event_column(stroke: str, distance: int) -> str:
    return f"{stroke}_{distance}m"


def _is(stroke: str, distance: int) -> Column:
    return (F.col("stroke") == stroke) & (F.col("distance") == distance)


def results_sheet(rows: DataFrame, order: str, by: Sequence[str] = ()) -> DataFrame:
    """After the columns ``by`` (of a meet, where rows are of several) a meet's 24 columns: a person (name and club by lookup form) a row, by city, club and name; who has no city or club comes last.

    City, region and club of a person whose first row has no city are those of the
    first row with one. ``order`` is the rows' arrival, unique.
    """
    gender = F.when(F.col("gender") == "M", "Erkek").when(F.col("gender") == "F", "Kız").otherwise(F.col("gender"))
    named = rows.withColumn("gender", gender)
    keys = [*map(F.col, by), normalize_for_lookup(F.col("name")), normalize_for_lookup(F.coalesce("club", "club_raw"))]
    events = {event_column(*e): _is(*e) for e in EVENTS}
    out = report.athlete_sheet(named, keys, [*by, "name", "yb", "age", "gender"], ["city", "region", "club"], events, "cents", "time_text", order)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    base = [text(c).alias(h) for h, c in zip(BASE, ("name", "yb", "club", "city", "region", "age", "gender"))]
    last = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("ZZZ"))
    return out.select(*by, *base, *events).orderBy(*by, last("Şehir"), last("Kulüp"), "Ad Soyad")


def ranking_sheet(rows: DataFrame, scores: DataFrame, legs: tuple[str, str], keys: list[str]) -> DataFrame:
    """Published rows (``output_rows``) with 12 base columns and each event's points in both legs and over all.

    ``scores`` has keys, stroke, distance, a ``leg_<leg>`` column for each leg and ``combined``. By place, unplaced rows first.
    """
    columns = [(f"leg_{legs[0]}", legs[0]), (f"leg_{legs[1]}", legs[1]), ("combined", "")]
    headed = [(c, s, d, f"{event_column(s, d)} {leg}".strip()) for c, leg in columns for s, d in EVENTS]
    wide = scores.groupBy(*keys).agg(*(F.max(F.when(_is(s, d), F.col(c))).alias(h) for c, s, d, h in headed))
    base = [F.col(c.format(*legs)).alias(h.format(*legs)) for h, c in RANKING]
    return rows.join(wide, keys, "left").select(*keys, *base, *(h for *_, h in headed)).orderBy("Sıra", "Ad Soyad")


def roster_headings(legs: tuple[str, str]) -> list[str]:
    return [h.format(*legs) for h in ROSTER]


def roster_sheet(compared: DataFrame, legs: tuple[str, str]) -> DataFrame:
    """The six columns of a comparison (``roster_compare`` by name, birth_year and gender of name_a, name_b and clubs) and its status, by name."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cells = [shown(c).alias(h) for h, c in zip(roster_headings(legs), ("name_a", "value_a", "birth_year", "gender", "name_b", "value_b"))]
    return compared.select(*cells, "status").orderBy(F.coalesce("name_a", "name_b"), "birth_year")


def write_results(rows: DataFrame, order: str, path: str, meet: str, name: Column) -> None:
    """A workbook for each meet: ``results_sheet`` with coloured headings, every second row grey, the headings and base columns standing. ``name`` gives a meet's file."""
    sheet = results_sheet(rows, order, [meet])
    last = lambda c: F.coalesce(F.nullif(F.col(c), F.lit("")), F.lit("ZZZ"))
    n = len(BASE)
    cells = sheet_rows(sheet, name, F.lit("Sonuçlar"), [last("Şehir"), last("Kulüp"), F.col("Ad Soyad")], header=f"head:{n},sub", hidden=(meet,))
    painted = F.when(F.col("row") == 1, F.col("style")).when(F.col("row") % 2 == 0, f"left2:{n},mid2").otherwise(f"left:{n},mid")
    write_books(cells.withColumn("style", painted), path, None, RESULT_STYLES, {"": Layout(RESULT_WIDTHS, "H2", 30)})


def results_name(race_date: str, made: str) -> str:
    """File name of a meet's workbook: its date, if known, then when it was made."""
    return f"{race_date}_Yaris_Sonuclari_{made}.xlsx" if race_date else f"Yaris_Sonuclari_{made}.xlsx"


def write_ranking(ranked: DataFrame, group: Column, title: Column, clubs: DataFrame, summary: DataFrame, path: str, book: str, keys: Sequence[str]) -> None:
    """A workbook with a sheet for each group (its quotas above, rows coloured by selection), one of clubs, and a summary whose last row is the total (TOPLAM).

    ``ranked`` is a ``ranking_sheet``, whose ``keys`` are not shown.
    """
    style = F.when(F.col("Eşit").cast("boolean"), "tied").otherwise(F.col("Seçim"))
    style = F.when(style.isin(*SELECTED), style).otherwise("plain")
    rows = sheet_rows(ranked, F.lit(book), group, [F.col("Sıra"), F.col("Ad Soyad")], title, style=style, hidden=tuple(keys))
    for name, table in (("Kulüpler", clubs), ("Özet", summary)):
        first = [(F.col(table.columns[0]) == "TOPLAM"), F.col(table.columns[0])]
        rows = rows.unionByName(sheet_rows(table, F.lit(book), F.lit(name), first))
    layouts = {"": Layout(RANKING_WIDTHS, "A3"), "Kulüpler": Layout([34, *[8] * (len(clubs.columns) - 1)], "A2"), "Özet": Layout()}
    # Groups come first: the two others are put after them.
    rows = rows.withColumn("sheet", F.when(F.col("sheet").isin("Kulüpler", "Özet"), F.col("sheet")).otherwise(F.concat(F.lit(" "), "sheet")))
    write_books(rows, path, None, RANKING_STYLES, layouts)


def summary_sheet(tally: DataFrame, group: str, counts: list[str]) -> DataFrame:
    """Counts by group with their total as the last row."""
    rows = tally.rollup(group).agg(F.grouping(group).alias("_t"), *(F.sum(c).cast("long").alias(c) for c in counts))
    name = F.when(F.col("_t") == 1, "TOPLAM").otherwise(F.col(group))
    return rows.orderBy("_t", group).select(name.alias(group), *counts)


def write_roster(compared: DataFrame, legs: tuple[str, str], path: str, book: str) -> None:
    """The comparison with a colour for each status, and a sheet that says what they mean."""
    sheet = roster_sheet(compared, legs)
    named = F.coalesce(F.nullif(F.col(roster_headings(legs)[0]), F.lit("")), F.col(roster_headings(legs)[4]))
    first, second = "Sporcu Karşılaştırma", "Açıklama"
    rows = sheet_rows(sheet, F.lit(book), F.lit(first), [named, F.col(roster_headings(legs)[2])], style=F.col("status"), hidden=("status",))
    legend = compared.sparkSession.createDataFrame([(i, s, *MEANING[s]) for i, s in enumerate(MEANING)], "place int, status string, Renk string, Anlam string")
    rows = rows.unionByName(sheet_rows(legend, F.lit(book), F.lit(second), [F.col("place")], style=F.col("status"), hidden=("place", "status"), header="bold"))
    styles = {s: Style(c) for s, c in COLOURS.items()} | {"header": Style("1F3864", "FFFFFF", True, 11, True), "bold": Style(bold=True)}
    write_books(rows, path, {first: 0, second: 1}, styles, {first: Layout(ROSTER_WIDTHS, "A2", 28), second: Layout([12, 55])})
