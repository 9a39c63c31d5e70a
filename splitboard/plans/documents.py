"""Queries over documents made from the tables: entry lists, progression reports, rosters, recognised words, sheets, and the text rules that read them.

The documents are lines, words or files that the swims are written to; SQL states what reading them must give, from the tables alone. What stands above the swims has
numbers below 0, as a swim's number may be 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text, times
from ..operators import persons, state
from ..session import table
from ..sinks import books
from ..sources import lines as line_reader
from ..sources import sheets
from .meets import SWIMS_SQL, _folder, swims

QUERIES, ORACLES = {}, {}


def query(sql: str, with_swims: bool = True):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = f"WITH {SWIMS_SQL} {sql}" if with_swims else sql
        return f

    return add


def _words(rows: DataFrame):
    return F.when(F.col("gender") == "M", "Erkekler").otherwise("Kızlar")


def _year():
    return F.lpad(F.pmod("birth_year", F.lit(100)).cast("string"), 2, "0")


def _doc():
    return F.concat_ws("|", "meet", "c_custkey").alias("doc")


@query("SELECT meet, name_raw AS name, club_raw AS club, birth_year, gender, stroke, distance, CASE WHEN seq % 3 <> 0 THEN cents END AS entry_cents FROM swims")
def start_list(spark, sf_dir):
    """Entries of lists whose header has the distance run into the stroke; a lane and a heat come before the name, NT is no time."""
    rows = swims(spark, sf_dir)
    head = rows.select(_doc(), F.lit(-2).cast("long").alias("line_no"), F.concat(F.lit("Yarış 3, "), _words(rows), F.lit(", "), F.col("distance").cast("string"), F.lit("m"), "stroke").alias("text")).distinct()
    time = F.when(F.col("seq") % 3 != 0, times.display_time(F.col("cents"))).otherwise("NT")
    body = rows.select(_doc(), F.col("seq").alias("line_no"), F.concat_ws(" ", F.lit("1 4"), "name_raw", _year(), "club_raw", time).alias("text"))
    note = head.select("doc", F.lit(-1).cast("long").alias("line_no"), F.lit("Not: 50m Kelebek barajlı").alias("text"))
    read = line_reader.start_lines(head.unionByName(note).unionByName(body).withColumn("page", F.lit(1)))
    return read.select(F.split_part("doc", F.lit("|"), F.lit(1)).alias("meet"), "name", "club", "birth_year", "gender", "stroke", "distance", "entry_cents")


@query("SELECT meet, club_raw AS club, name_raw AS name, birth_year, gender, stroke, distance, cents, 'progression_pdf' AS source FROM swims")
def progression_report(spark, sf_dir):
    """Reports of one club and athlete each, over two pages; the largest time of a line counts."""
    rows = swims(spark, sf_dir)
    age = (F.lit(2026) - F.col("birth_year")).cast("string")
    top = rows.select(_doc(), F.lit(1).alias("page"), "club_raw", F.concat(F.col("name_raw"), F.lit(", "), F.col("birth_year").cast("string"), F.lit(" ("), age, F.lit(" yas), "), _words(rows)).alias("person")).distinct()
    heads = top.select("doc", "page", F.posexplode(F.array("club_raw", "person")).alias("line_no", "text")).withColumn("line_no", F.col("line_no").cast("long"))
    swim = F.concat(F.col("distance").cast("string"), F.lit("m "), "stroke", F.lit(" 7. "), times.display_time(F.col("cents")), F.lit(" 300 "), times.display_time(F.col("cents") - 100), F.lit(" 97%"))
    body = rows.select(_doc(), F.lit(2).alias("page"), F.col("seq").alias("line_no"), swim.alias("text"))
    read = line_reader.progression_lines(heads.unionByName(body), spread="pages")
    return read.select(F.split_part("doc", F.lit("|"), F.lit(1)).alias("meet"), "club", "name", "birth_year", "gender", "stroke", "distance", "cents", "source")


@query("SELECT meet, name_raw AS name, birth_year, gender, club_raw AS club FROM swims GROUP BY ALL")
def roster_text(spark, sf_dir):
    """Athletes of a meet's rosters, a document for each club: each once, under its club's line."""
    rows = swims(spark, sf_dir)
    doc = F.concat_ws("|", "meet", "club_raw").alias("doc")
    clubs = rows.select(doc, F.lit(-2).cast("long").alias("line_no"), F.col("club_raw").alias("text")).distinct()
    age = (F.lit(2026) - F.col("birth_year")).cast("string")
    one = F.concat(F.col("name_raw"), F.lit(", "), F.col("birth_year").cast("string"), F.lit(" ("), age, F.lit(" yaş), "), F.when(F.col("gender") == "M", "Erkek").otherwise("Kız"))
    skip = clubs.select("doc", F.lit(-1).cast("long").alias("line_no"), F.lit("Sporcuların İlerlemesi").alias("text"))
    body = rows.select(doc, F.col("seq").alias("line_no"), one.alias("text"))
    read = line_reader.roster_lines(clubs.unionByName(skip).unionByName(body).withColumn("page", F.lit(1)))
    return read.select(F.split_part("doc", F.lit("|"), F.lit(1)).alias("meet"), "name", "birth_year", "gender", "club")


@query("SELECT meet, name_raw AS name, club_raw AS club, birth_year, gender, stroke, distance, cents, 'ocr' AS source FROM swims")
def recognised_words(spark, sf_dir):
    """Results from words with places: a line's words lie at slightly different heights, in any order."""
    rows = swims(spark, sf_dir)
    line = F.concat_ws(" ", F.lit("1."), "name_raw", _year(), "club_raw", times.display_time(F.col("cents")))
    n = F.dense_rank().over(_by_seq())
    head = F.concat(F.lit("Yarış 9, "), _words(rows), F.lit(", "), F.col("distance").cast("string"), F.lit("m "), "stroke")
    # An athlete's swims of a meet are a page.
    lines = rows.select(_doc(), n.alias("n"), line.alias("text")).unionByName(rows.select(_doc(), F.lit(0).alias("n"), head.alias("text")).distinct())
    words = lines.select("doc", F.lit(1).alias("page"), "n", F.posexplode(F.split("text", " ")).alias("at", "text"))
    boxes = words.select("doc", "page", (F.col("at") * 50).cast("double").alias("x"), (F.col("n") * 40 + F.col("at") % 3 * 4).cast("double").alias("y"), "text")
    read = line_reader.result_lines(line_reader.lines_of_boxes(boxes), source="ocr")
    return read.select(F.split_part("doc", F.lit("|"), F.lit(1)).alias("meet"), "name", "club", "birth_year", "gender", "stroke", "distance", "cents", "source")


def _by_seq():
    from pyspark.sql import Window

    return Window.partitionBy("meet", "c_custkey").orderBy("seq")


@query(
    """WITH s AS (SELECT s_suppkey AS row_no, 'Kulüp ' || translate(CAST(s_suppkey % 40 AS VARCHAR), '0123456789', 'acdefghijm') AS alt, n_name AS club, n_name AS city, CAST(n_regionkey AS INTEGER) AS region FROM supplier JOIN nation ON s_nationkey = n_nationkey),
g AS (SELECT * FROM s WHERE row_no % 11 <> 0), each AS (SELECT lower(translate(alt, 'ü', 'u')) AS key, alt, club, city, region, row_no, 0 AS o FROM g UNION ALL SELECT replace(lower(club), '_', ' '), club, club, city, region, row_no, 1 FROM g)
SELECT key, arg_max(alt, row_no * 2 + o) AS alt, arg_max(club, row_no * 2 + o) AS club, arg_max(city, row_no * 2 + o) AS city, arg_max(region, row_no * 2 + o) AS region FROM each GROUP BY key
UNION ALL SELECT 'old ' || lower(r_name), 'Old', 'Old', r_name, 0 FROM region""",
    with_swims=False,
)
def club_sync(spark, sf_dir):
    """A mapping sheet is written, read by its name and headings, and upserted: the last row of a key wins; every eleventh has no city."""
    nations = table(spark, sf_dir, "nation")
    rows = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    alt = F.concat(F.lit("Kulüp "), F.translate((F.col("s_suppkey") % 40).cast("string"), "0123456789", "acdefghijm"))
    sheet = rows.select(F.col("s_suppkey").alias("no"), alt.alias("Diğer Ad"), F.col("n_name").alias("Kulüp Adı"), F.when(F.col("s_suppkey") % 11 != 0, F.col("n_name")).alias("Şehir"), F.col("n_regionkey").cast("string").alias("Bölge"))
    folder = _folder(spark, "mapping")
    books.write_books(books.sheet_rows(sheet, F.lit("mapping"), F.lit("Kulüpler"), [F.col("no")], hidden=("no",)), folder)
    read = sheets.read_sheet(spark, folder, {"Diğer Ad": "alt", "Kulüp Adı": "canonical", "Şehir": "city", "Bölge": "region"}, sheet="Kulüpler", header_row=1)
    old = table(spark, sf_dir, "region").select(F.concat(F.lit("old "), F.lower("r_name")).alias("key"), F.lit("Old").alias("alt"), F.lit("Old").alias("club"), F.col("r_name").alias("city"), F.lit(0).alias("region"))
    clubs, _ = sheets.sync_clubs(old, read, text.normalize_for_lookup)
    return clubs.select("key", "alt", "club", "city", "region")


_TURKISH = "translate(p_name, 'gisocu', 'ğışöçü')"


@query(
    f"""SELECT p_partkey, lower(p_name) AS norm, replace(lower(p_name), ' ', '') AS tight, split_part(lower(p_name), ' ', -1) AS surname, true AS same, false AS other,
array_to_string(list_transform(string_split({_TURKISH}, ' '), lambda w: (CASE w[1] WHEN 'ı' THEN 'I' ELSE upper(w[1]) END) || w[2:]), ' ') AS shown FROM part""",
    with_swims=False,
)
def turkish_names(spark, sf_dir):
    """Names with Turkish and other marked letters, with and without combining marks, come to one key."""
    plain = F.col("p_name")
    turkish = F.translate(plain, "gisocu", "ğışöçü")
    marked = F.regexp_replace(F.translate(plain, "aey", "âéÿ"), "(?<=o)", "̈")
    return table(spark, sf_dir, "part").select(
        "p_partkey", text.normalize_for_lookup(turkish).alias("norm"), text.nospace(marked).alias("tight"), text.surname(turkish).alias("surname"), text.names_match(turkish, marked).alias("same"),
        text.names_match(turkish, F.concat(plain, F.lit("x"))).alias("other"), text.normalize_display(turkish).alias("shown"),
    )


@query(
    """SELECT o_orderkey, d AS distance, CASE o_orderkey % 3 WHEN 0 THEN 'F' ELSE 'M' END AS gender, o_orderkey % 5 = 0 AS relay, CASE WHEN k > 7 THEN NULL ELSE 2018 - k END AS plausible, 2000 + k AS born
FROM (SELECT *, CASE WHEN o_orderkey % 4 = 3 THEN NULL ELSE CAST([50, 100, 1500][o_orderkey % 4 + 1] AS INTEGER) END AS d, CAST(o_orderkey % 12 AS INTEGER) AS k FROM orders)""",
    with_swims=False,
)
def event_texts(spark, sf_dir):
    """What an event's text says, glued or not, relays, birth dates and years that can be."""
    k = F.col("o_orderkey")
    number = F.when(k % 4 == 0, "50").when(k % 4 == 1, "100").when(k % 4 == 2, "1500").otherwise("75")
    words = F.when(k % 3 == 0, "Kızlar").when(k % 3 == 1, "Erkekler").otherwise("Oğlanlar")
    shown = F.concat(words, F.when(k % 2 == 0, ", ").otherwise(" "), F.when(k % 5 == 0, "4x").otherwise(""), number, F.when(k % 2 == 0, "mSerbest").otherwise(" m Serbest"))
    plain = F.concat(words, F.lit(" "), number, F.lit("mSerbest"))
    n = (k % 12).cast("int")
    year = F.lit(2018) - n
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", text.parse_distance(plain).alias("distance"), text.parse_gender(shown).alias("gender"), text.is_relay(shown).alias("relay"),
        F.when(n <= 7, times.plausible_year(year)).alias("plausible"), times.parse_birthdate(F.concat((F.lit(2000) + n).cast("string"), F.lit("-05-06"))).alias("born"),
    )


@query(
    """WITH RECURSIVE n AS (SELECT DISTINCT p_name AS name FROM part), l AS (SELECT a.name AS a, b.name AS b FROM n a JOIN n b ON levenshtein(a.name, b.name) <= 2),
r AS (SELECT name, name AS root FROM n UNION SELECT r.name, l.b FROM r JOIN l ON l.a = r.root), c AS (SELECT name, min(root) AS person FROM r GROUP BY name)
SELECT p_partkey, person, first_value(p_name) OVER (PARTITION BY person ORDER BY p_partkey) AS canonical FROM part JOIN c ON p_name = name""",
    with_swims=False,
)
def person_clusters(spark, sf_dir):
    """Names within two edits are one person, and those of one person take its first spelling; renames can't run both ways."""
    from ..operators import fuzzy

    part = table(spark, sf_dir, "part")
    links = fuzzy.near_pairs(part, "p_name", 2).select("a", "b")
    return persons.one_spelling(part, links, "p_name", "p_partkey").select("p_partkey", "person", "canonical")


@query(
    """WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_custkey % 4 <> 0 THEN o_custkey END AS k, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey % 97 END AS t, o_orderstatus AS s FROM orders)
SELECT 'unmatched' AS part, id, k FROM (SELECT *, row_number() OVER (PARTITION BY k, s ORDER BY t NULLS LAST, id) AS n FROM o) WHERE n = 1 OR k IS NULL
UNION ALL SELECT 'override', id, k FROM (SELECT *, row_number() OVER (PARTITION BY k, s ORDER BY id DESC) AS n FROM o) WHERE n = 1""",
    with_swims=False,
)
def keyed_upserts(spark, sf_dir):
    """An upsert whose null keys equal no other, and one whose null keys are one key."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), F.when(F.col("o_custkey") % 4 != 0, F.col("o_custkey")).alias("k"), F.when(k % 5 != 0, k % 97).alias("t"), F.col("o_orderstatus").alias("s"))
    half = F.col("id") < F.lit(30_000)
    one = state.upsert_unmatched(rows.where(half), rows.where(~half), ["k", "s"], "t", "id")
    two = state.add_override(rows.where(half), rows.where(~half), ["k", "s"], "id")
    return one.select(F.lit("unmatched").alias("part"), "id", "k").unionByName(two.select(F.lit("override").alias("part"), "id", "k"))
