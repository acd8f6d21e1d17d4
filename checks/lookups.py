"""Dictionaries, gazetteers and spatial joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check, table
from parcelflow.functions.lookup import first_match, replace_exact, resolve_place, unify_variants
from parcelflow.operators.quality import unresolved
from parcelflow.operators.resolve import attach_coordinates, first_match_join
from parcelflow.operators.spatial import active_regions, points_in_regions
from parcelflow.plans.listings import anonymise
from parcelflow.session import scratch_path
from parcelflow.sources.dimensions import read_regions


@check(
    "source_anonymise",
    """
    SELECT doc_id, CASE source WHEN 'src0' THEN 'Website A' WHEN 'src1' THEN 'Website B'
                               WHEN 'src12' THEN 'Website C' ELSE 'Other' END AS SOURCE
    FROM documents""",
)
def source_anonymise(spark, folder):
    tagged = table(spark, folder, "documents").select("doc_id", F.col("source").alias("SOURCE"))
    return anonymise(tagged, {"src0": "Website A", "src1": "Website B", "src12": "Website C"})


@check(
    "city_map_replace",
    """
    SELECT c_custkey, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'HOME' WHEN 'FURNITURE' THEN 'BRAK' ELSE c_mktsegment END AS mapped,
           CASE WHEN regexp_matches(c_mktsegment, 'AUTO|MACH') THEN 'VEHICLE' ELSE c_mktsegment END AS unified
    FROM customer""",
)
def city_map_replace(spark, folder):
    segment = F.col("c_mktsegment")
    return table(spark, folder, "customer").select(
        "c_custkey",
        replace_exact(segment, {"HOUSEHOLD": "HOME", "FURNITURE": "BRAK"}).alias("mapped"),
        unify_variants(segment, ["AUTO", "MACH"], "VEHICLE").alias("unified"),
    )


def _customers_with_place(spark, folder):
    key = F.col("c_nationkey")
    place = F.when(key != 3, F.concat(F.lit("NATION_"), key))
    customers = table(spark, folder, "customer").select("c_custkey", place.alias("CITY"))
    gazetteer = (
        table(spark, folder, "nation")
        .filter(F.col("n_regionkey") != 4)
        .select(
            F.col("n_name").alias("CITY"),
            (F.col("n_nationkey") + 40.0).alias("LAT"),
            (F.col("n_nationkey") * 0.5).alias("LON"),
        )
    )
    return attach_coordinates(customers, gazetteer)


PLACED_SQL = """
    SELECT c_custkey, CITY, n_nationkey + CAST(40.0 AS DOUBLE) AS LAT, n_nationkey * CAST(0.5 AS DOUBLE) AS LON
    FROM (SELECT c_custkey, CASE WHEN c_nationkey <> 3 THEN 'NATION_' || c_nationkey END AS CITY FROM customer)
    LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 4) ON CITY = n_name"""


@check("gazetteer_left_join", PLACED_SQL)
def gazetteer_left_join(spark, folder):
    return _customers_with_place(spark, folder)


@check("unresolved_audit", f"SELECT DISTINCT CITY FROM ({PLACED_SQL}) WHERE LAT IS NULL")
def unresolved_audit(spark, folder):
    return unresolved(_customers_with_place(spark, folder), "LAT", "CITY")


NAMES = ["OLD", "RĘD RÓD", "WIDGET", "RÓD", "BŁUE", "LARGE GEAR", "GEAR", "PLATE", "OLD PLATE"]


def _text(column="p_name"):
    return F.translate(column, "oea", "óęą")


FOLDED_SQL = "translate(upper(translate(p_name, 'oea', 'óęą')), 'ĄĆĘŁŃÓŚŹŻ', 'ACELNOSZZ')"
FIRST_SQL = f"""CASE WHEN contains({FOLDED_SQL}, 'OLD') THEN 'OLD' WHEN contains({FOLDED_SQL}, 'RED ROD') THEN 'RĘD RÓD'
    WHEN contains({FOLDED_SQL}, 'WIDGET') THEN 'WIDGET' WHEN contains({FOLDED_SQL}, 'ROD') THEN 'RÓD'
    WHEN contains({FOLDED_SQL}, 'BLUE') THEN 'BŁUE' WHEN contains({FOLDED_SQL}, 'LARGE GEAR') THEN 'LARGE GEAR'
    WHEN contains({FOLDED_SQL}, 'GEAR') THEN 'GEAR' WHEN contains({FOLDED_SQL}, 'PLATE') THEN 'PLATE' END"""
LONGEST_SQL = f"""CASE WHEN contains({FOLDED_SQL}, 'LARGE GEAR') THEN 'LARGE GEAR' WHEN contains({FOLDED_SQL}, 'OLD PLATE') THEN 'OLD PLATE'
    WHEN contains({FOLDED_SQL}, 'RED ROD') THEN 'RĘD RÓD' WHEN contains({FOLDED_SQL}, 'WIDGET') THEN 'WIDGET'
    WHEN contains({FOLDED_SQL}, 'PLATE') THEN 'PLATE' WHEN contains({FOLDED_SQL}, 'BLUE') THEN 'BŁUE'
    WHEN contains({FOLDED_SQL}, 'GEAR') THEN 'GEAR' WHEN contains({FOLDED_SQL}, 'OLD') THEN 'OLD'
    WHEN contains({FOLDED_SQL}, 'ROD') THEN 'RÓD' END"""


@check(
    "first_match_resolution",
    f"SELECT p_partkey, {FIRST_SQL} AS first_match, {LONGEST_SQL} AS longest_match FROM part",
)
def first_match_resolution(spark, folder):
    return table(spark, folder, "part").select(
        "p_partkey",
        first_match(_text(), NAMES).alias("first_match"),
        first_match(_text(), NAMES, "longest_match").alias("longest_match"),
    )


@check(
    "location_fallback",
    f"""
    SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN NULL ELSE coalesce({FIRST_SQL}, 'CENTRE') END AS CITY
    FROM part""",
)
def location_fallback(spark, folder):
    given = F.when(F.col("p_type") == "PROMO", F.lit("brak")).otherwise(
        F.when(F.col("p_type") != "SMALL", F.col("p_type"))
    )
    city = resolve_place(given, first_match(_text(), NAMES), "BRAK", "CENTRE")
    return table(spark, folder, "part").select("p_partkey", city.alias("CITY"))


DICTIONARY_SQL = r"""
    WITH d AS (
      SELECT DISTINCT upper(w) AS name FROM (
        SELECT unnest(regexp_extract_all(text, '[A-Za-z]{3,}')) AS w FROM benchmark) WHERE length(w) >= 9)
    SELECT doc_id, (SELECT min(name) FROM d WHERE contains(translate(upper(text), 'ĄĆĘŁŃÓŚŹŻ', 'ACELNOSZZ'), name)) AS hit
    FROM documents"""


def _first_words(spark, folder, **options):
    """The alphabetically first of the long words of `benchmark` that occurs in each document."""
    words = (
        table(spark, folder, "benchmark")
        .select(F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{3,})"), 1)).alias("w"))
        .filter(F.length("w") >= 9)
        .select(F.upper("w").alias("name"))
        .distinct()
    )
    dictionary = words.select(F.col("name").alias("priority"), "name")
    documents = table(spark, folder, "documents").select("doc_id", "text")
    return first_match_join(documents, "text", dictionary, "hit", **options).select("doc_id", "hit")


@check("first_match_dictionary", DICTIONARY_SQL)
def first_match_dictionary(spark, folder):
    return _first_words(spark, folder)


@check("first_match_dictionary_join", DICTIONARY_SQL)
def first_match_dictionary_join(spark, folder):
    return _first_words(spark, folder, inline=0)


@check(
    "first_match_dictionary_large",
    r"""
    WITH d AS (SELECT DISTINCT upper(w) AS name FROM (
        SELECT unnest(regexp_extract_all(text, '[A-Za-z]{2,}')) AS w FROM documents)),
    t AS (SELECT DISTINCT text, translate(upper(text), 'ĄĆĘŁŃÓŚŹŻ', 'ACELNOSZZ') AS body FROM conversations),
    m AS (SELECT text, arg_min(name, (-length(name), name)) AS hit FROM t JOIN d ON contains(body, name) GROUP BY text)
    SELECT c.conv_id, c.turn, m.hit FROM conversations c LEFT JOIN m ON m.text = c.text""",
)
def first_match_dictionary_large(spark, folder):
    """The longest of all words of `documents`, short ones included, in each turn of a conversation."""
    words = table(spark, folder, "documents").select(
        F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z]{2,})"), 1)).alias("w")
    )
    names = words.select(F.upper("w").alias("name")).distinct()
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "text")
    dictionary = names.select(F.col("name").alias("priority"), "name")
    return first_match_join(turns, "text", dictionary, "hit", "longest_match").drop("text")


# Regions derived from `nation`: an arrow-shaped, concave ring around a centre of its own.
SHAPE = [(-3.1, -2.3), (3.3, -2.7), (0.37, 0.21), (2.9, 3.1), (-2.7, 2.9), (-0.77, 0.13), (-3.1, -2.3)]


def _regions(spark, folder):
    west = (F.col("n_nationkey") % 5) * 4.0 + 1.013
    south = F.floor(F.col("n_nationkey") / 5) * 3.0 + 40.017
    ring = F.array(
        *[F.struct((west + dx).alias("lon"), (south + dy).alias("lat")) for dx, dy in SHAPE]
    )
    return table(spark, folder, "nation").select(
        F.col("n_nationkey").cast("bigint").alias("region_id"), F.col("n_name").alias("name"), ring.alias("ring")
    )


def _points(spark, folder):
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        "c_custkey",
        F.when(key % 19 != 0, (key * 7919 % 26000) / 1000.0 - 3.0).alias("LON"),
        ((key * 104729 % 21000) / 1000.0 + 35.0).alias("LAT"),
    )


_EDGES = ", ".join(
    f"({ax}::DOUBLE, {ay}::DOUBLE, {bx}::DOUBLE, {by}::DOUBLE)"
    for (ax, ay), (bx, by) in zip(SHAPE, SHAPE[1:])
)
INSIDE_SQL = f"""
    WITH pts AS (
      SELECT c_custkey, CASE WHEN c_custkey % 19 <> 0 THEN (c_custkey * 7919 % 26000) / 1000.0::DOUBLE - 3.0::DOUBLE END AS lon,
             (c_custkey * 104729 % 21000) / 1000.0::DOUBLE + 35.0::DOUBLE AS lat FROM customer),
    e AS (
      SELECT CAST(n_nationkey AS BIGINT) AS region_id, n_name AS name, (n_nationkey % 5) * 4.0::DOUBLE + 1.013::DOUBLE + ax AS ax,
             (n_nationkey // 5) * 3.0::DOUBLE + 40.017::DOUBLE + ay AS ay, (n_nationkey % 5) * 4.0::DOUBLE + 1.013::DOUBLE + bx AS bx,
             (n_nationkey // 5) * 3.0::DOUBLE + 40.017::DOUBLE + by_ AS by_
      FROM nation, (VALUES {_EDGES}) AS s(ax, ay, bx, by_)),
    inside AS (
      SELECT c_custkey, region_id, any_value(name) AS name FROM pts, e
      WHERE (ay > lat) <> (by_ > lat) AND lon < (bx - ax) * (lat - ay) / (by_ - ay) + ax
      GROUP BY c_custkey, region_id HAVING count(*) % 2 = 1)"""


@check("point_in_polygon", INSIDE_SQL + " SELECT c_custkey, region_id, name FROM inside")
def point_in_polygon(spark, folder):
    found = points_in_regions(_points(spark, folder), _regions(spark, folder))
    return found.select("c_custkey", "region_id", "name")


@check(
    "active_regions",
    INSIDE_SQL + " SELECT n_name AS name FROM nation WHERE n_nationkey IN (SELECT region_id FROM inside)",
)
def regions_with_points(spark, folder):
    regions = _regions(spark, folder)
    return active_regions(regions, points_in_regions(_points(spark, folder), regions)).select("name")


# The same regions with a hole and a second part, and an enclave in each hole.
HOLE = [(-0.61, 1.31), (0.83, 1.37), (0.71, 2.33), (-0.53, 2.41), (-0.61, 1.31)]
PART = [(4.03, -1.1), (4.9, -0.97), (4.41, 0.83), (4.03, -1.1)]
ENCLAVE = [(-0.21, 1.61), (0.41, 1.63), (0.37, 2.11), (-0.17, 2.03), (-0.21, 1.61)]
_PART_EDGES = ", ".join(
    f"({kind}, {ax}::DOUBLE, {ay}::DOUBLE, {bx}::DOUBLE, {by}::DOUBLE)"
    for kind, ring in ((0, SHAPE), (0, HOLE), (0, PART), (1, ENCLAVE))
    for (ax, ay), (bx, by) in zip(ring, ring[1:])
)


def _regions_from_file(spark, folder):
    """Regions of several rings, written down and read back as a file of outlines."""
    west = (F.col("n_nationkey") % 5) * 4.0 + 1.013
    south = F.floor(F.col("n_nationkey") / 5) * 3.0 + 40.017
    rings = [
        F.array(*[F.struct((west + dx).alias("lon"), (south + dy).alias("lat")) for dx, dy in ring])
        for ring in (SHAPE, HOLE, PART, ENCLAVE)
    ]
    nation, number = table(spark, folder, "nation"), F.col("n_nationkey").cast("bigint")
    main = nation.select(
        number.alias("region_id"), F.col("n_name").alias("name"), F.array(*rings[:3]).alias("rings")
    )
    enclaves = nation.select(
        (number + 100).alias("region_id"), F.concat("n_name", F.lit(" enclave")).alias("name"), rings[3].alias("ring")
    )
    path = scratch_path(spark, "outlines")
    main.unionByName(enclaves, allowMissingColumns=True).write.parquet(path)
    return read_regions(spark, path)


@check(
    "point_in_regions_with_holes",
    f"""
    WITH pts AS (
      SELECT c_custkey, CASE WHEN c_custkey % 19 <> 0 THEN (c_custkey * 7919 % 26000) / 1000.0::DOUBLE - 3.0::DOUBLE END AS lon,
             (c_custkey * 104729 % 21000) / 1000.0::DOUBLE + 35.0::DOUBLE AS lat FROM customer),
    e AS (
      SELECT CAST(n_nationkey + 100 * kind AS BIGINT) AS region_id,
             n_name || CASE WHEN kind = 1 THEN ' enclave' ELSE '' END AS name,
             (n_nationkey % 5) * 4.0::DOUBLE + 1.013::DOUBLE + ax AS ax,
             (n_nationkey // 5) * 3.0::DOUBLE + 40.017::DOUBLE + ay AS ay,
             (n_nationkey % 5) * 4.0::DOUBLE + 1.013::DOUBLE + bx AS bx,
             (n_nationkey // 5) * 3.0::DOUBLE + 40.017::DOUBLE + by_ AS by_
      FROM nation, (VALUES {_PART_EDGES}) AS s(kind, ax, ay, bx, by_))
    SELECT c_custkey, region_id, any_value(name) AS name FROM pts, e
    WHERE (ay > lat) <> (by_ > lat) AND lon < (bx - ax) * (lat - ay) / (by_ - ay) + ax
    GROUP BY c_custkey, region_id HAVING count(*) % 2 = 1""",
)
def point_in_regions_with_holes(spark, folder):
    found = points_in_regions(_points(spark, folder), _regions_from_file(spark, folder))
    return found.select("c_custkey", "region_id", "name")
