"""Index pages: links, event maps and page meta, by expressions over the page text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_relay, parse_distance, parse_gender, parse_stroke, squeeze


def strip_tags(html: Column) -> Column:
    return squeeze(F.regexp_replace(html, r"(?s)<[^>]*>", " "))


def links(pages: DataFrame, key: str, html: str, pattern: str = r".*") -> DataFrame:
    """(key, position, href): each distinct link that matches, at its first place."""
    found = F.regexp_extract_all(F.col(html), F.lit(r'(?i)href="([^"]*)"'), F.lit(1))
    each = pages.select(key, F.posexplode(found).alias("position", "href")).where(F.col("href").rlike(pattern))
    return each.groupBy(key, "href").agg(F.min("position").cast("long").alias("position"))


def numbered_links(pages: DataFrame, key: str, html: str, kind: str, base: Column) -> DataFrame:
    """Absolute links of a kind (ResultList, StartList) with their trailing number (999 without one)."""
    number = F.coalesce(F.regexp_extract("href", r"(\d+)\.\w+$", 1).try_cast("long"), F.lit(999).cast("long"))
    absolute = F.when(F.col("href").rlike("^https?://"), F.col("href")).otherwise(F.concat(base, F.col("href")))
    return links(pages, key, html, rf"{kind}.*\.pdf$").select(key, number.alias("number"), absolute.alias("link"), "position")


def event_map(pages: DataFrame, key: str, html: str, kind: str = "ResultList") -> DataFrame:
    """(key, file, gender, distance, stroke): table rows that link a file of the kind; relays go, the last row of a file wins."""
    rows = pages.select(key, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r"(?is)<tr\b.*?</tr>"), F.lit(0))).alias("n", "row"))
    text = strip_tags(F.col("row"))
    each = rows.where(~is_relay(text)).select(key, "n", text.alias("text"), F.explode(F.regexp_extract_all(F.col("row"), F.lit(rf'(?i)href="(?:[^"]*/)?([^"/]*{kind}[^"/]*\.pdf)"'), F.lit(1))).alias("file"))
    parsed = each.select(key, "n", "file", parse_gender(F.col("text")).alias("gender"), parse_distance(F.col("text")).alias("distance"), parse_stroke(F.col("text")).alias("stroke"))
    known = parsed.where("distance IS NOT NULL AND stroke IS NOT NULL")
    return known.groupBy(key, "file").agg(F.max_by(F.struct("gender", "distance", "stroke"), "n").alias("e")).select(key, "file", "e.*")


def propagate_start_lists(starts: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Events of start lists under their result list's name, where that has none of its own."""
    renamed = starts.withColumn("file", F.replace(F.col("file"), F.lit("StartList"), F.lit("ResultList")))
    return results.unionByName(renamed.join(results, [key, "file"], "left_anti"))


def page_meta(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, title, language): the page's title text and language."""
    return pages.select(
        key,
        F.regexp_extract(F.col(html), r"(?is)<title>(.*?)</title>", 1).alias("title"),
        F.regexp_extract(F.col(html), r'(?i)<html[^>]*\blang="([^"]*)"', 1).alias("language"),
    )


def meet_meta(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, title, location, date) of the first table's first two rows.

    The first row has title and location; a second row's first cell is the location
    instead, its second the date. What is missing is ''.
    """
    table = F.regexp_extract(F.col(html), r"(?is)<table\b.*?(?:</table>|$)", 0)
    rows = F.regexp_extract_all(table, F.lit(r"(?is)<tr\b.*?(?=<tr\b|</tr>|</table>|$)"), F.lit(0))
    cells = lambda n: F.regexp_extract_all(F.coalesce(F.get(rows, F.lit(n)), F.lit("")), F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)(?=<t[dh]\b|</t[dh]>|</tr>|$)"), F.lit(1))
    cell = lambda n, i: strip_tags(F.get(cells(n), F.lit(i)))
    return pages.select(
        key, F.coalesce(cell(0, 0), F.lit("")).alias("title"), F.coalesce(cell(1, 0), cell(0, 1), F.lit("")).alias("location"), F.coalesce(cell(1, 1), F.lit("")).alias("date")
    )


def file_hints(rows: DataFrame, events: DataFrame, file: str, on: str = "file") -> DataFrame:
    """Each file's event and its trailing number."""
    number = F.regexp_extract(F.col(file), r"(\d+)\.\w+$", 1).try_cast("long")
    return rows.withColumn("pdf_seq", number).join(events.withColumnRenamed(on, file), file, "left")
