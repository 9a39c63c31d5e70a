"""Queries over whole meets: readers composed, lookups, overrides and cohorts.

Orders stand for swims, customers for athletes, nations for clubs and order priorities for meets. Names are spelled in letters, so that
lines of text can be made from them and read back; SQL states the expected rows from the tables, without any line.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text, times
from ..operators import meet
from ..session import files, shared_dir, table
from ..sinks import layouts
from ..sources import archive, lenex, sheets
from ..sources import lines as line_reader

QUERIES, ORACLES = {}, {}
STROKES = tuple(text.STROKES.values())
DISTANCES = (50, 100, 200, 400)
ARCHIVED = "1-URGENT"
YEARS = (2011, 2012, 2013)
GENDERS = {"Kadın": "F", "Kız": "F", "Kızlar": "F", "Erkek": "M", "Erkekler": "M"}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {SWIMS_SQL} {sql}"
        return f

    return add


def _pick(values: tuple, n: Column) -> Column:
    return F.get(F.array(*(F.lit(v) for v in values)), n.cast("int"))


def _letters(n: Column) -> Column:
    word = F.translate(n.cast("string"), "0123456789", "abcdefghij")
    return F.concat(F.upper(F.substring(word, 1, 1)), F.substr(word, F.lit(2)))


def swims(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    people = table(spark, sf_dir, "customer").select(
        k, "c_mktsegment", F.concat(F.lit("Sporcu "), _letters(k)).alias("name_raw"), F.concat(F.lit("Kulup "), _letters(F.col("c_nationkey"))).alias("club_raw"),
        (F.lit(2010) + k % 4).cast("int").alias("birth_year"), F.when(k % 2 == 0, "M").otherwise("F").alias("gender"), _pick(STROKES, k % 5).alias("stroke"),
        _pick(DISTANCES, k % 4).alias("distance"),
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderpriority").alias("meet"), F.col("o_orderkey").alias("seq"), (F.lit(2000) + F.col("o_orderkey") % 4000).alias("cents"), "o_orderdate"
    )
    return orders.join(people, "c_custkey")


SWIMS_SQL = """
swims AS (
  SELECT o_orderpriority AS meet, o_orderkey AS seq, 2000 + o_orderkey % 4000 AS cents, o_orderdate, c_custkey, c_mktsegment,
         'Sporcu ' || upper(w[1]) || w[2:] AS name_raw, 'Kulup ' || upper(n[1]) || n[2:] AS club_raw, CAST(2010 + c_custkey % 4 AS INTEGER) AS birth_year,
         CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS gender, ['Serbest', 'Sırtüstü', 'Kurbağalama', 'Kelebek', 'Karışık'][c_custkey % 5 + 1] AS stroke,
         CAST([50, 100, 200, 400][c_custkey % 4 + 1] AS INTEGER) AS distance, n_name, n_regionkey
  FROM orders JOIN (SELECT *, translate(CAST(c_custkey AS VARCHAR), '0123456789', 'abcdefghij') AS w, translate(CAST(c_nationkey AS VARCHAR), '0123456789', 'abcdefghij') AS n FROM customer) ON o_custkey = c_custkey
  JOIN nation ON c_nationkey = n_nationkey
)"""


def lists(rows: DataFrame) -> DataFrame:
    """The swims as lines of text, one list for each athlete and meet, with its header above all of them: a swim's number may be 0."""
    doc = F.concat_ws("|", "meet", "c_custkey")
    words = F.when(F.col("gender") == "M", "Erkekler").otherwise("Kızlar")
    head = rows.select(doc.alias("doc"), F.lit(-1).cast("long").alias("line_no"), F.concat(F.lit("Yarış 7, "), words, F.lit(", "), F.col("distance").cast("string"), F.lit("m "), "stroke").alias("text")).distinct()
    year = F.pmod("birth_year", F.lit(100)).cast("string")
    body = rows.select(doc.alias("doc"), F.col("seq").alias("line_no"), F.concat_ws(" ", F.lit("1."), "name_raw", year, "club_raw", times.display_time(F.col("cents"))).alias("text"))
    return head.unionByName(body).withColumn("page", F.lit(1))


def read_lists(rows: DataFrame) -> DataFrame:
    read = line_reader.result_lines(lists(rows)).withColumn("meet", F.split_part("doc", F.lit("|"), F.lit(1)))
    return meet.conform(read, name_raw="name", club_raw="club")


def clubs(spark: SparkSession, sf_dir: str, regions: tuple[int, ...], shown) -> DataFrame:
    nations = table(spark, sf_dir, "nation").where(F.col("n_regionkey").isin(*regions))
    key = text.normalize_for_lookup(F.concat(F.lit("Kulup "), _letters(F.col("n_nationkey"))))
    return nations.select(key.alias("key"), shown(F.col("n_name")).alias("club"), F.col("n_name").alias("city"), F.col("n_regionkey").cast("int").alias("region"), F.col("n_nationkey").alias("at"))


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every athlete of a segment has the segment for a city."""
    people = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    k, none = F.col("c_custkey"), F.lit(None)
    name = text.normalize_for_lookup(F.concat(F.lit("Sporcu "), _letters(k)))
    return people.select(
        name.alias("name_normalized"), none.cast("int").alias("birth_year"), none.cast("string").alias("club_override"), F.col("c_mktsegment").alias("city"),
        none.cast("int").alias("region"), none.cast("string").alias("display_name"), k.alias("id"),
    )


_ENRICHED = """CASE WHEN c_mktsegment <> 'BUILDING' AND n_regionkey <= 1 THEN n_name ELSE club_raw END AS club,
CASE WHEN c_mktsegment = 'BUILDING' THEN 'BUILDING' WHEN n_regionkey <= 3 THEN n_name END AS city, CASE WHEN c_mktsegment <> 'BUILDING' AND n_regionkey <= 3 THEN n_regionkey END AS region,
c_mktsegment = 'BUILDING' OR n_regionkey <= 3 AS club_found"""


def _dims(spark, sf_dir):
    return overrides(spark, sf_dir), clubs(spark, sf_dir, (0, 1), lambda c: c), clubs(spark, sf_dir, (2, 3), F.lower)


@query(f"""SELECT meet, seq, name_raw, name_raw AS name, lpad(CAST(birth_year % 100 AS VARCHAR), 2, '0') AS yb, birth_year, 2026 - birth_year AS age, club_raw, gender, stroke, distance, cents,
(cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS time_text, 'lenex' AS source, {_ENRICHED}, CAST(NULL AS VARCHAR) AS participant_type, CAST(NULL AS BIGINT) AS pdf_seq FROM swims""")
def enrich_results(spark, sf_dir):
    rows = swims(spark, sf_dir).withColumn("source", F.lit("lenex"))
    raw = rows.withColumns({"participant_type": F.lit(None).cast("string"), "pdf_seq": F.lit(None).cast("long")})
    return meet.enrich_results(raw.drop("c_custkey", "c_mktsegment", "o_orderdate"), *_dims(spark, sf_dir))


@query(f"""SELECT meet, name_raw AS name, birth_year, {_ENRICHED}, gender, stroke, distance, min(cents) AS cents, CASE WHEN meet = '{ARCHIVED}' THEN 'lenex' ELSE 'pdf' END AS source,
strftime(day, '%Y.%m.%d') AS race_date FROM swims JOIN (SELECT o_orderpriority AS meet, min(o_orderdate) AS day FROM orders GROUP BY 1) USING (meet)
GROUP BY meet, name_raw, birth_year, c_mktsegment, n_regionkey, n_name, club_raw, gender, stroke, distance, day""")
def meet_results(spark, sf_dir):
    """Archive rows of one meet, lists of all: the lists are read from text, and ignored where the archive has results."""
    rows = swims(spark, sf_dir)
    archive = meet.conform(rows.where(F.col("meet") == ARCHIVED).withColumn("source", F.lit("lenex")))
    shown = F.date_format(F.min("o_orderdate"), "dd / MM / yyyy")
    dates = rows.groupBy("meet").agg(times.race_date(shown).alias("race_date"))
    out = meet.meet_results(archive, read_lists(rows), dates, *_dims(spark, sf_dir))
    return out.select("meet", "name", "birth_year", "club", "city", "region", "club_found", "gender", "stroke", "distance", "cents", "source", "race_date")


@query("""SELECT meet, name_raw AS name, birth_year, gender, stroke, distance, min(cents) AS cents FROM swims GROUP BY ALL""")
def list_results(spark, sf_dir):
    """Lists alone, without archive, dates or events known beforehand."""
    listed = read_lists(swims(spark, sf_dir))
    dates = spark.createDataFrame([], "meet string, race_date string")
    out = meet.meet_results(listed.limit(0), listed, dates, *_dims(spark, sf_dir))
    return out.select("meet", "name", "birth_year", "gender", "stroke", "distance", "cents")


@query("""SELECT key, min(y) AS "YB", min(cents) FILTER (stroke = 'Serbest' AND distance = 50) AS free_50, min(cents) FILTER (stroke = 'Karışık' AND distance = 400) AS medley_400 FROM (
SELECT name_raw AS key, lpad(CAST(birth_year % 100 AS VARCHAR), 2, '0') AS y, cents, stroke, distance FROM swims) GROUP BY key""")
def results_sheet(spark, sf_dir):
    """The sheet's row a person; two of the 17 event columns are shown, as hundredths."""
    rich = meet.enrich_results(swims(spark, sf_dir).withColumns({"source": F.lit("lenex"), "participant_type": F.lit(None).cast("string"), "pdf_seq": F.lit(None).cast("long")}), *_dims(spark, sf_dir))
    sheet = layouts.results_sheet(rich, "seq")
    return sheet.select(F.col("Ad Soyad").alias("key"), "YB", times.parse_time(F.col("Serbest_50m")).alias("free_50"), times.parse_time(F.col("Karışık_400m")).alias("medley_400"))


def _file(spark, sf_dir):
    """An override for each athlete of a segment; the spelling differs in case and blanks."""
    k = F.col("c_custkey")
    name = F.concat(F.lit("  SPORCU "), F.upper(_letters(k)), F.lit(" "))
    gender = F.when(k % 2 == 0, "M").otherwise("F")
    rows = table(spark, sf_dir, "customer").where("c_mktsegment IN ('BUILDING', 'MACHINERY')")
    kind = F.when(F.col("c_mktsegment") == "BUILDING", "same").otherwise("different")
    return rows.select(name.alias("name"), (F.lit(2010) + k % 4).cast("int").alias("birth_year"), gender.alias("gender"), kind.alias("resolution"), F.lit("").alias("canonical_name"), F.lit("Yeni").alias("canonical_club"), F.col("c_mktsegment").alias("canonical_city"))


def _named(spark, sf_dir):
    return swims(spark, sf_dir).withColumnsRenamed({"name_raw": "name", "club_raw": "club"}).withColumn("city", F.lit("?"))


@query("""SELECT seq, name_raw AS name, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Yeni' ELSE club_raw END AS club, CASE WHEN c_mktsegment = 'BUILDING' THEN 'BUILDING' ELSE '?' END AS city FROM swims""")
def manual_overrides(spark, sf_dir):
    return meet.manual_overrides(_named(spark, sf_dir), _file(spark, sf_dir)).select("seq", "name", "club", "city")


@query("""SELECT seq, gender, birth_year, CASE WHEN c_mktsegment = 'BUILDING' THEN 'Yeni' ELSE club_raw END AS club, CAST(CASE WHEN cents <= 3000 THEN 9 ELSE 7 END AS BIGINT) AS points
FROM swims WHERE birth_year IN (2011, 2012, 2013) AND cents <= 4500""")
def scored_cohort(spark, sf_dir):
    """Genders as a list has them; two thresholds for each event."""
    rows = _named(spark, sf_dir).withColumn("gender", F.when(F.col("gender") == "M", "Erkekler").when(F.col("seq") % 2 == 0, "Kızlar").otherwise("f"))
    steps = [(y, g, s, d, p, c) for y in YEARS for g in "FM" for s in STROKES for d in DISTANCES for p, c in ((9, 3000), (7, 4500))]
    thresholds = spark.createDataFrame(steps, "birth_year int, gender string, stroke string, distance int, points int, max_cs long")
    out = meet.scored_cohort(rows, YEARS, GENDERS, _file(spark, sf_dir), thresholds)
    return out.select("seq", "gender", "birth_year", "club", "points")


def _folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    files(spark, path, lambda fs, at: fs.deleteOnExit(at))
    return path


def _land(rows: DataFrame, path: str, archived: bool) -> str:
    """Files (name, content) of a folder, written by tasks."""
    archive.register(rows.sparkSession)
    rows.write.format("meet_archive").option("archive", str(archived).lower()).mode("append").save(path)
    return path


def _marked(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))


def _archives(spark: SparkSession, rows: DataFrame) -> str:
    """A meet's swims as archives, one for each club: an entry for every swim, a result for those that were swum."""
    codes = F.create_map(*[F.lit(x) for code, name in text.STROKES.items() for x in (name, code)])
    event = F.concat(codes[F.col("stroke")], F.col("distance").cast("string"))
    time = F.concat(F.lit("00:00:"), F.lpad(F.floor(F.col("cents") / 100).cast("string"), 2, "0"), F.lit("."), F.lpad((F.col("cents") % 100).cast("string"), 2, "0"))
    swum = F.format_string('<RESULT eventid="%s" swimtime="%s" status="%s"/>', event, time, F.when(F.col("seq") % 7 == 0, "DSQ").otherwise(""))
    entered = F.format_string('<ENTRY eventid="%s" entrytime="%s"/>', event, F.when(F.col("seq") % 5 == 0, "NT").otherwise(time))
    style = F.format_string('<EVENT eventid="%s"><SWIMSTYLE distance="%d" stroke="%s"/></EVENT>', event, F.col("distance"), codes[F.col("stroke")])
    # One athlete has one event and few swims; a file is one club's meet.
    each = rows.where("cents < 6000").groupBy("meet", "club_raw", "name_raw", "birth_year", "gender").agg(F.array_join(F.sort_array(F.collect_list(swum)), "").alias("r"), F.array_join(F.sort_array(F.collect_list(entered)), "").alias("e"), F.max(style).alias("style"))
    person = F.format_string('<ATHLETE firstname="%s" lastname="%s" birthdate="%d-05-05" gender="%s"><RESULTS>%s</RESULTS><ENTRIES>%s</ENTRIES></ATHLETE>', F.split_part("name_raw", F.lit(" "), F.lit(1)), F.split_part("name_raw", F.lit(" "), F.lit(2)), "birth_year", "gender", "r", "e")
    clubs = each.groupBy("meet", "club_raw").agg(F.array_join(F.collect_set("style"), "").alias("events"), F.array_join(F.sort_array(F.collect_list(person)), "").alias("people"))
    content = F.format_string('<?xml version="1.0" encoding="UTF-8"?><LENEX><MEETS><MEET startdate="2026-01-02"><EVENTS>%s</EVENTS><CLUBS><CLUB name="%s"><ATHLETES>%s</ATHLETES></CLUB></CLUBS></MEET></MEETS></LENEX>', "events", _marked(F.col("club_raw")), "people")
    name = F.concat("meet", F.lit("~"), F.replace("club_raw", F.lit(" "), F.lit("_")), F.lit(".lxf"))
    return _land(clubs.select(name.alias("name"), content.alias("content")), _folder(spark, "archives"), True)


def _meet_of(path: Column) -> Column:
    return F.split_part(F.element_at(F.split(path, "/"), -1), F.lit("~"), F.lit(1))


@query("SELECT meet, club_raw AS club, name_raw AS name, gender, birth_year, stroke, distance, cents, 'lenex' AS source FROM swims WHERE cents < 6000 AND seq % 7 <> 0")
def archive_results(spark, sf_dir):
    """Archives are written from the swims and read back: disqualified swims go."""
    swims_read = lenex.read_meets(spark, _archives(spark, swims(spark, sf_dir)))
    return lenex.results(swims_read).select(_meet_of(F.col("path")).alias("meet"), "club", "name", "gender", "birth_year", "stroke", "distance", "cents", "source")


@query("SELECT meet, name_raw AS name, gender, birth_year, stroke, distance, CASE WHEN seq % 5 <> 0 THEN cents END AS entry_cents, '2026.01.02' AS race_date FROM swims WHERE cents < 6000")
def archive_entries(spark, sf_dir):
    """Entries of the same archives, with the meets' dates; NT is no time."""
    folder = _archives(spark, swims(spark, sf_dir))
    dates = lenex.meet_dates(lenex.read_meets(spark, folder, "meets"))
    entered = lenex.entries(lenex.read_meets(spark, folder, "entries")).join(dates, "path")
    return entered.select(_meet_of(F.col("path")).alias("meet"), "name", "gender", "birth_year", "stroke", "distance", "entry_cents", "race_date")


def _files_of(rows: DataFrame) -> DataFrame:
    """Swims with the list that they are in: one for each event (gender, distance, stroke) of a meet."""
    codes = F.create_map(*[F.lit(x) for i, name in enumerate(STROKES) for x in (name, i)])
    number = codes[F.col("stroke")] * 8 + F.array_position(F.array(*map(F.lit, DISTANCES)), F.col("distance")).cast("int") * 2 + F.when(F.col("gender") == "M", 1).otherwise(0)
    return rows.withColumns({"number": number, "file": F.format_string("ResultList_%d.pdf", number)})


@query(f"""SELECT meet, name_raw AS name, birth_year, club_raw AS club, gender, stroke, distance, min(cents) AS cents, CASE WHEN meet = '{ARCHIVED}' THEN 'lenex' ELSE 'pdf' END AS source, '2026.01.0' || meet[1] AS race_date
FROM swims WHERE meet <> '{ARCHIVED}' OR (cents < 6000 AND seq % 7 <> 0) GROUP BY ALL""")
def landed_meets(spark, sf_dir):
    """Index pages, lists and archives are landed from the swims, then read as one plan: pages say what a list's event is, half of the lists have no header."""
    rows = _files_of(swims(spark, sf_dir))
    words = F.when(F.col("gender") == "M", "Erkekler").otherwise("Kızlar")
    label = F.concat(words, F.lit(" "), F.col("distance").cast("string"), F.lit("m "), "stroke")
    linked = rows.groupBy("meet", "file").agg(F.min(label).alias("label"), F.min("number").alias("number"))
    line = F.format_string('<tr><td>%s</td><td><a href="pdf/%s">r</a></td></tr>', "label", "file")
    day = F.format_string("<tr><td>Meet</td><td>Ankara</td></tr><tr><td>Ankara</td><td>0%s / 01 / 2026</td></tr>", F.substring("meet", 1, 1))
    # A meet has few dozen lists, so a page is one small row.
    pages = linked.groupBy("meet").agg(F.array_join(F.sort_array(F.collect_list(line)), "").alias("rows")).select("meet", F.concat(F.lit("<html><table>"), day, "rows", F.lit("</table></html>")).alias("html"))
    year = F.lpad(F.pmod("birth_year", F.lit(100)).cast("string"), 2, "0")
    swim = F.concat_ws(" ", F.lit("1."), "name_raw", year, "club_raw", times.display_time(F.col("cents")))
    # A list is a file: a page of it for each hundred athletes of the event.
    page = F.floor(F.col("c_custkey") / 2000)
    sheets = rows.groupBy("meet", "file", "number", label.alias("label"), page.alias("page")).agg(F.array_join(F.sort_array(F.collect_list(swim)), "\n").alias("lines"))
    head = F.when(F.col("number") % 2 == 0, F.concat(F.lit("Yarış 7, "), F.regexp_replace("label", "m ", "m"), F.lit("\n"))).otherwise("")
    whole = sheets.groupBy("meet", "file", "number", "label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "lines"))), lambda s: s["lines"]), "\f").alias("body"))
    lists = whole.select(F.concat("meet", F.lit("~"), F.regexp_replace("file", "pdf$", "txt")).alias("name"), F.concat(head, "body").alias("content"))
    folder = _land(lists, _folder(spark, "lists"), False)
    read = spark.read.format("meet_archive").option("rows", "lines").load(folder)
    lines = read.select(F.split_part("doc", F.lit("~"), F.lit(1)).alias("meet"), F.concat(F.split_part("doc", F.lit("~"), F.lit(2)), F.lit(".pdf")).alias("file"), "page", "line_no", "text")
    archived = lenex.read_meets(spark, _archives(spark, rows.where(F.col("meet") == ARCHIVED)))
    raw = meet.landed_archives(archived, _meet_of(F.col("path")))
    dims = _dims(spark, sf_dir)
    out = meet.meet_results(raw, meet.landed_lists(pages, lines), meet.landed_dates(pages), *(d.limit(0) for d in dims))
    return out.select("meet", "name", "birth_year", "club", "gender", "stroke", "distance", "cents", "source", "race_date")


_EVENTS = [(s, d) for s, d in layouts.EVENTS]
_TEXTS = ", ".join(f"min(t) FILTER (stroke = '{s}' AND distance = {d}) AS e{i}" for i, (s, d) in enumerate(_EVENTS))


@query(f"""SELECT meet, name_raw AS name, any_value(lpad(CAST(birth_year % 100 AS VARCHAR), 2, '0')) AS yb, club_raw AS club, CASE gender WHEN 'M' THEN 'Erkek' ELSE 'Kız' END AS gender, {_TEXTS}
FROM (SELECT *, (cents // 100) || '.' || lpad(CAST(cents % 100 AS VARCHAR), 2, '0') AS t FROM swims) GROUP BY meet, name_raw, club_raw, gender""")
def results_books(spark, sf_dir):
    """A workbook for each meet is written by tasks and read back by its headings: a person a row, all 17 events."""
    rows = swims(spark, sf_dir).withColumns({"source": F.lit("lenex"), "participant_type": F.lit(None).cast("string"), "pdf_seq": F.lit(None).cast("long"), "cents": F.when(F.col("cents") < 6000, F.col("cents"))})
    rich = meet.enrich_results(rows, *(d.limit(0) for d in _dims(spark, sf_dir)))
    folder = _folder(spark, "books")
    layouts.write_results(rich, "seq", folder, "meet", F.col("meet"))
    heads = {"Ad Soyad": "name", "YB": "yb", "Kulüp": "club", "Cinsiyet": "gender"} | {layouts.event_column(*e): f"e{i}" for i, e in enumerate(_EVENTS)}
    read = sheets.read_sheet(spark, folder, heads, header_row=1)
    return read.select(F.regexp_extract("path", r"([^/]+)\.xlsx$", 1).alias("meet"), *heads.values())
