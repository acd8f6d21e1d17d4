"""Daily series, whole listing build, snapshots."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from checks.registry import check, rnd, table
from parcelflow import schemas
from parcelflow.functions import rules
from parcelflow.plans.listings import Market, SOURCES, build_listings
from parcelflow.plans.market import MEDIANS, daily_market_stats, daily_medians, explode_days
from parcelflow.plans.prepare import Places
from parcelflow.profiles import lomza
from parcelflow.session import scratch_path
from parcelflow.sources.dimensions import gazetteer_frame
from parcelflow.sources.snapshots import latest_snapshot, write_snapshot
from parcelflow.sources.tables import ParquetTables, load_tables

# Events as listings that stay up to forty days; some intervals are reversed, some values missing.
LISTINGS_SQL = """
    listings AS (
      SELECT event_id AS ID, CASE WHEN a > b THEN b ELSE a END AS d0, CASE WHEN a > b THEN a ELSE b END AS d1,
             PRICE, AREA_M2, PRICE / nullif(AREA_M2, 0) AS PRICE_M2
      FROM (SELECT event_id, CAST(ts AS DATE) AS day, CAST(ts AS DATE) + CAST(user_id % 40 AS INTEGER) AS later,
                   CASE WHEN event_type = 'error' THEN later ELSE day END AS a,
                   CASE WHEN event_type = 'error' THEN day ELSE later END AS b,
                   CASE WHEN event_id % 11 = 0 THEN NULL ELSE value * 1000 END AS PRICE,
                   CASE WHEN event_id % 13 = 0 THEN NULL ELSE user_id + (event_id % 10) * 0.5::DOUBLE END AS AREA_M2
            FROM events))"""

SERIES_SQL = f"""WITH {LISTINGS_SQL},
    days AS (SELECT *, CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS day FROM listings)
    SELECT CAST(day AS VARCHAR) AS ACTIVE_DAY, count(ID) AS TOTAL_ACTIVE_OFFERS, {rnd('avg(PRICE_M2)', 2)} AS AVG_PRICE_M2,
           {rnd('median(PRICE_M2)', 2)} AS MEDIAN_PRICE_M2, {rnd('median(PRICE)', 2)} AS MEDIAN_PRICE,
           {rnd('avg(PRICE)', 2)} AS AVG_PRICE, {rnd('avg(AREA_M2)', 0)} AS AVG_AREA_M2,
           {rnd('coalesce(sum(AREA_M2), 0)', 0)} AS TOTAL_AREA_ON_MARKET, {rnd('median(AREA_M2)', 0)} AS MEDIAN_AREA_M2
    FROM days WHERE day >= (SELECT min(d1) FROM listings) GROUP BY day"""


def event_listings(spark, folder):
    day = F.to_date("ts")
    later = F.date_add(day, (F.col("user_id") % 40).cast("int"))
    error = F.col("event_type") == "error"
    raw = (
        table(spark, folder, "events")
        .select(
            F.col("event_id").alias("ID"),
            F.when(error, later).otherwise(day).alias("DATE_ADDED"),
            F.when(error, day).otherwise(later).alias("LAST_UPDATED"),
            F.when(F.col("event_id") % 11 != 0, F.col("value") * 1000).alias("PRICE"),
            F.when(F.col("event_id") % 13 != 0, F.col("user_id") + (F.col("event_id") % 10) * 0.5).alias("AREA_M2"),
        )
    )
    return rules.order_interval(rules.unit_price(raw, digits=None))


@check("daily_market_stats", SERIES_SQL)
def daily_series(spark, folder):
    return daily_market_stats(event_listings(spark, folder))


@check("daily_market_stats_delta", SERIES_SQL)
def daily_series_delta(spark, folder):
    return daily_market_stats(event_listings(spark, folder), strategy="changes")


# Prices that lie closer together than the first cells of the medians are wide.
CLOSE_SQL = f"""WITH {LISTINGS_SQL},
    near AS (SELECT d0, d1, 1000 + PRICE / 1e9 AS PRICE, -3 - PRICE / 1e10 AS PRICE_M2,
             CASE WHEN AREA_M2 > 40 THEN 7.25::DOUBLE ELSE 7.5 + PRICE / 1e12 END AS AREA_M2 FROM listings),
    days AS (SELECT *, CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS day FROM near)
    SELECT CAST(day AS VARCHAR) AS ACTIVE_DAY, {rnd('median(PRICE)', 10)} AS MEDIAN_PRICE,
           {rnd('median(PRICE_M2)', 10)} AS MEDIAN_PRICE_M2, {rnd('median(AREA_M2)', 10)} AS MEDIAN_AREA_M2
    FROM days GROUP BY day"""


@check("daily_medians_close", CLOSE_SQL)
def daily_medians_close(spark, folder):
    near = event_listings(spark, folder).select(
        "DATE_ADDED",
        "LAST_UPDATED",
        (F.lit(1000) + F.col("PRICE") / 1e9).alias("PRICE"),
        (F.lit(-3) - F.col("PRICE") / 1e10).alias("PRICE_M2"),
        F.when(F.col("AREA_M2") > 40, 7.25).otherwise(7.5 + F.col("PRICE") / 1e12).alias("AREA_M2"),
    )
    found = daily_medians(near, sorted_rows=256)
    return found.select("ACTIVE_DAY", *[F.round(name, 10).alias(name) for name in MEDIANS])


# Amounts from 2 ** -40 to 1e20 and NaN; in SQL as whole numbers of 2 ** -40.
WIDE_SQL = f"""WITH {LISTINGS_SQL},
    wide AS (SELECT ID, d0, d1, CASE WHEN ID % 4 = 0 AND d1 - d0 < 3 THEN 100000000000000000000::HUGEINT * 1099511627776
             WHEN ID % 4 = 1 THEN 1::HUGEINT WHEN ID % 4 = 2 THEN NULL
             ELSE CAST(floor(AREA_M2 * 1024) AS HUGEINT) * 1073741824 END AS units FROM listings),
    days AS (SELECT *, CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS day FROM wide)
    SELECT CAST(day AS VARCHAR) AS ACTIVE_DAY, count(*) AS TOTAL_ACTIVE_OFFERS,
           printf('%.11e', CAST(coalesce(sum(units), 0) AS DOUBLE) / 1099511627776) AS TOTAL_AREA_ON_MARKET,
           printf('%.11e', CAST(sum(units) AS DOUBLE) / 1099511627776 / count(units)) AS AVG_AREA_M2
    FROM days WHERE day >= (SELECT min(d1) FROM listings) GROUP BY day"""


def _wide_amounts(spark, folder, strategy):
    kind = F.col("ID") % 4
    brief = F.datediff("LAST_UPDATED", "DATE_ADDED") < 3
    amount = (
        F.when((kind == 0) & brief, 1e20)
        .when(kind == 1, 2.0**-40)
        .when(kind == 2, float("nan"))
        .otherwise(F.floor(F.col("AREA_M2") * 1024) / 1024)
    )
    listings = event_listings(spark, folder).withColumn("AREA_M2", amount)
    series = daily_market_stats(listings, digits={}, strategy=strategy)
    shown = [F.format_string("%.11e", c).alias(c) for c in ("TOTAL_AREA_ON_MARKET", "AVG_AREA_M2")]
    return series.select("ACTIVE_DAY", "TOTAL_ACTIVE_OFFERS", *shown)


@check("daily_sums_wide_explode", WIDE_SQL)
def daily_sums_wide_explode(spark, folder):
    return _wide_amounts(spark, folder, "explode")


@check("daily_sums_wide_changes", WIDE_SQL)
def daily_sums_wide_changes(spark, folder):
    return _wide_amounts(spark, folder, "changes")


@check(
    "exploded_days",
    f"""WITH {LISTINGS_SQL}
    SELECT ID, CAST(CAST(unnest(generate_series(d0, d1, INTERVAL 1 DAY)) AS DATE) AS VARCHAR) AS ACTIVE_DAY FROM listings""",
)
def exploded_days(spark, folder):
    return explode_days(event_listings(spark, folder)).select("ID", "ACTIVE_DAY")


# Five raw sources in the shapes of the deployment, made from the given tables, with a gazetteer of
# words that occur in part names.
PLACES = [
    (0, "RED", 53.1, 22.1),
    (1, "STARY BLUE", 53.2, 22.2),
    (2, "BLUE", 53.3, 22.3),
    (3, "LARGE GEAR", 53.4, 22.4),
    (4, "GEAR", 53.5, 22.5),
    (5, "MACHINERY", 53.6, 22.6),
    (6, "PROMO", 53.7, 22.7),
]
MARKET = Market(
    sources=SOURCES,
    places=Places(PLACES, {"ECONOMY HOT ROD": "BRAK", "SMALL NEW ROD": "OLD BLUE BOLT"}, default_place="RED"),
    centre=(53.1781, 22.0592),
    weekdays=lomza.WEEKDAYS,
    size_breaks=lomza.SIZE_BREAKS,
    size_labels=lomza.SIZE_LABELS,
    area_overrides={"dzialka-red-plate-0": 10200.0},
    source_names=lomza.SOURCE_NAMES,
)


def raw_sources(spark, folder):
    orders, customers = table(spark, folder, "orders"), table(spark, folder, "customer")
    day = F.to_date("o_orderdate")
    offers = orders.join(customers, orders.o_custkey == customers.c_custkey).select(
        F.col("o_orderkey").alias("ID"),
        F.when(F.col("o_orderstatus") != "P", day.cast("string")).alias("DATE_ISO"),
        F.date_add(day, (F.col("o_orderkey") % 120).cast("int")).cast("string").alias("LAST_UPDATED"),
        (F.col("o_custkey") % 400).cast("string").alias("AREA_M2"),
        F.lit("1").alias("PRICE_M2"),
        F.lower("c_mktsegment").alias("CITY"),
        F.col("o_totalprice").alias("VALUE"),
    )
    parts = table(spark, folder, "part")
    tytan = parts.select(
        F.concat(F.lit("T"), "p_partkey").alias("ID"),
        F.date_add(F.lit("2024-02-01").cast("date"), F.col("p_size")).cast("string").alias("DATE_ADDED"),
        F.lit("2024-02-20").alias("LAST_UPDATED"),
        F.lower("p_type").alias("LOCATION"),
        (F.col("p_size") * 37).alias("AREA_M2"),
        F.lit(None).cast("double").alias("PRICE_M2"),
        (F.col("p_retailprice") * 20).alias("PRICE"),
    )
    slug = F.concat(F.lit("dzialka-"), F.translate("p_name", " ", "-"), F.lit("-"), F.col("p_partkey"))
    gralczyk = parts.select(
        slug.alias("ID"),
        F.lit("2024-01-10").alias("FIRST_ADDED"),
        F.date_add(F.lit("2024-01-10").cast("date"), F.col("p_size")).cast("string").alias("LAST_UPDATED"),
        (F.col("p_retailprice") * 100).cast("string").alias("Cena"),
        F.lit("0").alias("Cena za m2"),
        F.concat(F.lit("1 "), F.lpad(F.col("p_size").cast("string"), 3, "0"), F.lit(",5  m2")).alias("Powierzchnia"),
    )
    polnoc = parts.select(
        F.when(F.col("p_type") != "LARGE", slug).otherwise(F.concat(F.lit("dom-"), F.col("p_partkey"))).alias("ID"),
        F.lit("2024-03-01").alias("FIRST_ADDED"),
        F.lit("2024-03-05").alias("LAST_UPDATED"),
        (F.col("p_retailprice") * 30).alias("Cena"),
        F.lit(None).cast("double").alias("Cena za m2"),
        F.when(F.col("p_size") > 5, F.col("p_size") * 300).alias("Powierzchnia działki"),
    )
    lines = table(spark, folder, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    ship = F.to_date("l_shipdate")
    analyzed = lines.select(
        F.concat_ws("/", "l_orderkey", "l_linenumber").alias("ID"),
        F.when(F.col("l_returnflag") == "A", F.lit("DZIAŁKA ROLNA")).otherwise(F.lit("X DZIAŁKA BUDOWLANA")).alias("ESTATE_TYPE"),
        F.lit("SPRZEDAZ").alias("OFFER_TYPE"),
        ship.cast("string").alias("DATE_ADDED"),
        F.date_sub(ship, F.col("p_size")).cast("string").alias("LAST_UPDATED"),
        ship.cast("string").alias("ANNOUNCE_DATE"),
        F.concat((F.col("l_quantity") * F.col("l_quantity")).cast("int"), F.lit(",5 m2")).alias("AREA_M2"),
        F.when(F.col("l_linenumber") == 3, F.lit("tel.")).otherwise(F.concat((F.col("l_extendedprice") * 3).cast("int"), F.lit(",25"))).alias("PRICE"),
        F.when(F.col("l_linestatus") == "O", F.lit("30 Arów")).alias("TEXT"),
        F.concat(F.lit(" "), F.lower("p_type"), F.lit(" "), "p_name", F.lit("\t")).alias("LOCATION"),
    )
    # Listing ids recur; all columns of a copy follow its dates, so which row is kept is settled.
    return {
        "offers": offers,
        "offers_tytan": tytan,
        "offers_gralczyk": gralczyk,
        "offers_polnoc": polnoc,
        "analyzed_offers": analyzed,
    }


def _first_place(text):
    return f"""CASE WHEN contains({text}, 'RED') THEN 'RED' WHEN contains({text}, 'STARY BLUE') THEN 'STARY BLUE'
        WHEN contains({text}, 'BLUE') THEN 'BLUE' WHEN contains({text}, 'LARGE GEAR') THEN 'LARGE GEAR'
        WHEN contains({text}, 'GEAR') THEN 'GEAR' WHEN contains({text}, 'MACHINERY') THEN 'MACHINERY'
        WHEN contains({text}, 'PROMO') THEN 'PROMO' END"""


_PLACE_ROWS = ", ".join(f"('{name}', {lat}::DOUBLE, {lon}::DOUBLE)" for _, name, lat, lon in PLACES)
_DAY_NAMES = "[" + ", ".join(f"'{name}'" for name in lomza.WEEKDAYS) + "]"

CLEANED_SQL = f"""
    WITH geo(place, LAT, LON) AS (VALUES {_PLACE_ROWS}),
    offers AS (
      SELECT CAST(o_orderkey AS VARCHAR) AS ID,
             CAST(o_orderdate AS DATE) + CAST(o_orderkey % 120 AS INTEGER) AS u,
             CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE)
                  ELSE CAST(o_orderdate AS DATE) + CAST(o_orderkey % 120 AS INTEGER) END AS a,
             CAST(o_custkey % 400 AS DOUBLE) AS area, o_totalprice AS price, upper(c_mktsegment) AS city, 'Website E' AS src
      FROM orders JOIN customer ON o_custkey = c_custkey),
    tytan AS (
      SELECT 'T' || p_partkey, DATE '2024-02-20', DATE '2024-02-01' + p_size, CAST(p_size * 37 AS DOUBLE),
             p_retailprice * 20, upper(p_type), 'Website C' FROM part),
    slugs AS (SELECT *, 'dzialka-' || replace(p_name, ' ', '-') || '-' || p_partkey AS slug FROM part),
    gralczyk AS (
      SELECT slug, DATE '2024-01-10' + p_size, DATE '2024-01-10', 1000.5::DOUBLE + p_size, p_retailprice * 100,
             {_first_place("upper(p_name)")}, 'Website D' FROM slugs),
    polnoc AS (
      SELECT slug, DATE '2024-03-05', DATE '2024-03-01', CAST(p_size * 300 AS DOUBLE), p_retailprice * 30,
             {_first_place("upper(p_name)")}, 'Website A' FROM slugs WHERE p_type <> 'LARGE' AND p_size > 5),
    lines AS (
      SELECT l_orderkey || '/' || l_linenumber AS ID, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS a,
             CAST(CAST(l_shipdate AS DATE) - p_size AS VARCHAR) AS u,
             CAST(l_quantity * l_quantity AS INTEGER) || ',5 m2' AS area_text,
             CASE WHEN l_linenumber = 3 THEN 'tel.' ELSE CAST(trunc(l_extendedprice * 3) AS INTEGER) || ',25' END AS price_text,
             CASE WHEN l_linestatus = 'O' THEN '30 Arów' END AS txt, ' ' || lower(p_type) || ' ' || p_name || chr(9) AS loc,
             'X DZIAŁKA BUDOWLANA' AS estate, 'SPRZEDAZ' AS offer
      FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'A'),
    uniq AS (
      SELECT *, CAST(replace(replace(area_text, ' m2', ''), ',', '.') AS DOUBLE) AS area0,
             TRY_CAST(replace(price_text, ',', '.') AS DOUBLE) AS price
      FROM (SELECT *, row_number() OVER (PARTITION BY ID ORDER BY u DESC, a DESC, estate DESC, offer DESC, a DESC,
                area_text DESC, price_text DESC, txt DESC NULLS LAST, loc DESC) AS r FROM lines) WHERE r = 1),
    o AS (SELECT area0 AS x, row_number() OVER (ORDER BY area0) - 1 AS i, count(*) OVER () AS n FROM uniq),
    q AS (SELECT min(x) FILTER (i = round(0.25 * (n - 1))) AS q1, min(x) FILTER (i = round(0.75 * (n - 1))) AS q3 FROM o),
    fixed AS (
      SELECT u.*, CASE WHEN (area0 < q1 - 1.5 * (q3 - q1) OR area0 > q3 + 1.5 * (q3 - q1)) AND coalesce(regexp_matches(txt, '(?i)ar'), FALSE)
                       THEN area0 / 10 ELSE area0 END AS area,
             upper(regexp_replace(loc, '^\\s+|\\s+$', '', 'g')) AS g0
      FROM uniq u, q),
    given AS (
      SELECT *, CASE g0 WHEN 'ECONOMY HOT ROD' THEN 'BRAK' WHEN 'SMALL NEW ROD' THEN 'OLD BLUE BOLT' ELSE g0 END AS g FROM fixed),
    analyzed AS (
      SELECT ID, CAST(u AS DATE), CAST(a AS DATE), area, price,
             CASE WHEN g = 'BRAK' THEN NULL ELSE coalesce({_first_place("g")}, 'RED') END, 'Website B'
      FROM given),
    everything AS (SELECT * FROM offers UNION ALL SELECT * FROM tytan UNION ALL SELECT * FROM gralczyk
                   UNION ALL SELECT * FROM polnoc UNION ALL SELECT * FROM analyzed),
    priced AS (
      SELECT * REPLACE (CASE WHEN price < 15000 THEN NULL ELSE price END AS price,
                        CASE WHEN ID = 'dzialka-red-plate-0' THEN 10200.0 WHEN area <= 1 THEN NULL
                             WHEN area < 100 THEN area * 100 ELSE area END AS area),
             a AS added FROM everything),
    placed AS (SELECT p.*, LAT, LON FROM priced p LEFT JOIN geo ON place = city)
    SELECT ID, CAST(CASE WHEN a > u THEN u ELSE a END AS VARCHAR) AS DATE_ADDED, CAST(CASE WHEN a > u THEN a ELSE u END AS VARCHAR) AS LAST_UPDATED,
           {rnd('area', 6)} AS AREA_M2, {rnd('price / area', 6)} AS PRICE_M2, city AS CITY, LAT, LON, {rnd('price', 6)} AS PRICE, src AS SOURCE,
           list_extract({_DAY_NAMES}, CAST(isodow(added) AS INTEGER)) AS DAY_NAME_PL,
           CASE WHEN LAT IS NOT NULL THEN {rnd('''2 * 6371.0 * asin(sqrt(power(sin((radians(LAT) - radians(53.1781)) / 2), 2)
             + cos(radians(53.1781)) * cos(radians(LAT)) * power(sin((radians(LON) - radians(22.0592)) / 2), 2)))''', 6)} END AS MAIN_CITY_DIST,
           CASE WHEN area IS NULL THEN NULL WHEN area <= 700 THEN 'Tiny/Sub-standard' WHEN area <= 1000 THEN 'Small Plot'
                WHEN area <= 1500 THEN 'Medium Plot' WHEN area <= 5000 THEN 'Large Plot'
                WHEN area <= 10000 THEN 'Investment/Small Farm' ELSE 'Hectares/Agriculture' END AS SIZE_SEGMENT,
           CAST(abs(u - a) AS BIGINT) AS DAYS_ON_MARKET,
           CASE WHEN abs(u - a) <= 7 THEN 'New Offer' WHEN abs(u - a) <= 30 THEN 'Active' WHEN abs(u - a) <= 90 THEN 'Stale'
                ELSE 'Old/Negotiable' END AS MARKET_STATUS
    FROM placed"""


def _shown_listings(spark, folder, market):
    listings = build_listings(raw_sources(spark, folder), market)
    return listings.withColumns(
        {c: F.round(c, 6) for c in ("AREA_M2", "PRICE_M2", "PRICE", "MAIN_CITY_DIST")}
    )


@check("cleaned_listings", CLEANED_SQL)
def cleaned_listings(spark, folder):
    return _shown_listings(spark, folder, MARKET)


@check("cleaned_listings_table", CLEANED_SQL)
def cleaned_listings_by_table(spark, folder):
    """The gazetteer as a table, with a name for every order that no listing has."""
    known = gazetteer_frame(spark, PLACES)
    others = table(spark, folder, "orders").select(
        F.lit(-1).alias("priority"),
        F.concat(F.lit("Q"), F.upper(F.md5(F.col("o_orderkey").cast("string")))).alias("CITY"),
        F.lit(0.0).alias("LAT"),
        F.lit(0.0).alias("LON"),
    )
    places = replace(MARKET.places, gazetteer=known.unionByName(others))
    return _shown_listings(spark, folder, replace(MARKET, places=places))


@check(
    "latest_snapshot",
    """
    SELECT event_id, user_id, value, '2024-01-11' AS snapshot_date FROM events""",
)
def newest_snapshot(spark, folder):
    root = scratch_path(spark, "snapshots")
    events = table(spark, folder, "events").select("event_id", "user_id", "value")
    write_snapshot(events.withColumn("value", -F.col("value")), root, "2024-01-09")
    write_snapshot(events.withColumn("value", F.lit(0.0)), root, "2024-01-11")
    write_snapshot(events, root, "2024-01-11")
    return latest_snapshot(spark, root)


@check(
    "parquet_roundtrip",
    """
    SELECT CAST(c_custkey AS VARCHAR) AS ID, CAST(NULL AS VARCHAR) AS DATE_ADDED, '2024-01-01' AS LAST_UPDATED, c_acctbal AS AREA_M2,
           CAST(NULL AS DOUBLE) AS PRICE_M2, c_name AS CITY, CAST(NULL AS DOUBLE) AS LAT, CAST(NULL AS DOUBLE) AS LON, c_acctbal AS PRICE
    FROM customer""",
)
def parquet_roundtrip(spark, folder):
    tables = load_tables(spark, ParquetTables(folder), ["customer", "nation"])
    kinds = {f.name: f.dataType for f in schemas.TARGET.fields}
    values = {
        "ID": F.col("c_custkey"),
        "LAST_UPDATED": F.lit("2024-01-01"),
        "AREA_M2": F.col("c_acctbal"),
        "CITY": F.col("c_name"),
        "PRICE": F.col("c_acctbal"),
    }
    shaped = tables["customer"].select(
        *[values.get(n, F.lit(None)).cast(kind).alias(n) for n, kind in kinds.items()]
    )
    root = scratch_path(spark, "tables")
    shaped.write.parquet(f"{root}/listings.parquet")
    stored = ParquetTables(root, schemas={"listings": schemas.TARGET})
    return load_tables(spark, stored, ["listings"])["listings"]
