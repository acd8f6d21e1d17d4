"""Columns, rules and source preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check, rnd, rounded, table
from parcelflow.functions import rules
from parcelflow.functions.dates import iso_weekday, weekday_english
from parcelflow.functions.numeric import bin_label, bin_ordinal, great_circle_km
from parcelflow.functions.text import (
    fold,
    mentions,
    parse_quantity,
    replace_first,
    slug_to_name,
    strip_whitespace,
)
from parcelflow.operators.quality import (
    correct_unit_errors,
    null_profile,
    table_profile,
    outlier_fences,
    fences_column,
    is_outlier,
)
from parcelflow.operators.dedup import dedup_latest
from parcelflow.operators.joins import apply_corrections
from parcelflow.plans.listings import union_sources
from parcelflow.plans.prepare import Places, Quantity, SourceSpec, prepare
from parcelflow.profiles import lomza
from parcelflow.sources.dimensions import gazetteer_frame


@check(
    "interval_repair_status",
    """
    WITH j AS (
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(o_orderdate AS DATE) AS a,
             CAST(CASE WHEN l_linenumber = 7 THEN NULL ELSE l_shipdate END AS DATE) AS b
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    s AS (
      SELECT *, CASE WHEN a > b THEN b ELSE a END AS d0, CASE WHEN a > b THEN a ELSE b END AS d1 FROM j)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(d0 AS VARCHAR) AS DATE_ADDED,
           CAST(d1 AS VARCHAR) AS LAST_UPDATED, CAST(d1 - d0 AS BIGINT) AS DAYS_ON_MARKET,
           CASE WHEN d1 - d0 <= 7 THEN 'New Offer' WHEN d1 - d0 <= 30 THEN 'Active'
                WHEN d1 - d0 <= 90 THEN 'Stale' ELSE 'Old/Negotiable' END AS MARKET_STATUS
    FROM s""",
)
def interval_repair_status(spark, folder):
    lines = table(spark, folder, "lineitem")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_orderdate")
    listed = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        F.to_date("o_orderdate").alias("DATE_ADDED"),
        F.to_date(F.when(F.col("l_linenumber") != 7, F.col("l_shipdate"))).alias("LAST_UPDATED"),
    )
    return rules.market_status(rules.order_interval(listed))


@check(
    "harmonise_union",
    """
    SELECT CAST(c_custkey AS VARCHAR) AS ID, CAST(DATE '2024-01-01' + CAST(c_custkey % 28 AS INTEGER) AS VARCHAR) AS DATE_ADDED,
           '2024-02-01' AS LAST_UPDATED, CAST(c_custkey AS DOUBLE) AS AREA_M2, CAST(NULL AS DOUBLE) AS PRICE_M2,
           c_mktsegment AS CITY, CAST(c_nationkey AS DOUBLE) AS LAT, CAST(-c_nationkey AS DOUBLE) AS LON,
           c_acctbal AS PRICE, 'customer' AS SOURCE
    FROM customer
    UNION ALL
    SELECT CAST(s_suppkey AS VARCHAR), '2024-01-05', '2024-03-01', CAST(s_nationkey AS DOUBLE), s_acctbal / 2,
           s_name, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), s_acctbal, 'supplier'
    FROM supplier""",
)
def harmonise_union(spark, folder):
    customers = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("ID"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 28).cast("int")).alias("DATE_ADDED"),
        F.lit("2024-02-01").cast("date").alias("LAST_UPDATED"),
        F.col("c_custkey").cast("string").alias("AREA_M2"),
        F.lit(None).cast("string").alias("PRICE_M2"),
        F.col("c_mktsegment").alias("CITY"),
        F.col("c_nationkey").alias("LAT"),
        (-F.col("c_nationkey")).alias("LON"),
        F.col("c_acctbal").alias("VALUE"),
    )
    suppliers = (
        table(spark, folder, "supplier")
        .withColumnsRenamed({"s_suppkey": "ID", "s_name": "CITY", "s_acctbal": "PRICE", "s_nationkey": "AREA_M2"})
        .withColumns(
            {
                "DATE_ADDED": F.lit("2024-01-05").cast("date"),
                "LAST_UPDATED": F.lit("2024-03-01").cast("date"),
                "PRICE_M2": F.col("PRICE") / 2,
                "LAT": F.lit(None).cast("double"),
                "LON": F.lit(None).cast("double"),
            }
        )
    )
    return union_sources({"customer": customers, "supplier": suppliers})


@check(
    "slug_to_name",
    r"""
    SELECT page_id, upper(regexp_replace(replace(replace(
             replace(replace(regexp_replace(url, '^https?://', ''), '.', '-'), '/', '-'),
             'example', ''), '-', ' '), '^\s+|\s+$', '', 'g')) AS name
    FROM pages""",
)
def slugs(spark, folder):
    slug = F.translate(F.regexp_replace("url", "^https?://", ""), "./", "--")
    return table(spark, folder, "pages").select(
        "page_id", slug_to_name(slug, noise="example").alias("name")
    )


@check(
    "text_functions",
    r"""
    WITH t AS (
      SELECT p_partkey, chr(9) || replace(replace(p_name, 'o', 'ó'), 'l', 'ł') || ' ' || chr(160) || chr(10) AS raw,
             p_name || '-' || p_type || '-' || p_brand AS code
      FROM part)
    SELECT p_partkey, regexp_replace(raw, '^[\s\x{00A0}]+|[\s\x{00A0}]+$', '', 'g') AS stripped,
           translate(upper(raw), 'ĄĆĘŁŃÓŚŹŻ', 'ACELNOSZZ') AS folded,
           regexp_replace(code, '-', '/') AS first_only, replace(code, '-', '/') AS all_of_them
    FROM t""",
)
def text_functions(spark, folder):
    raw = F.concat(
        F.lit("\t"), F.translate("p_name", "ol", "ół"), F.lit("  \n")
    )
    code = F.concat_ws("-", "p_name", "p_type", "p_brand")
    return table(spark, folder, "part").select(
        "p_partkey",
        strip_whitespace(raw).alias("stripped"),
        fold(raw).alias("folded"),
        replace_first(code, "-", "/").alias("first_only"),
        F.replace(code, F.lit("-"), F.lit("/")).alias("all_of_them"),
    )


QUANTITY_SQL = """
    CASE l_linenumber % 7
      WHEN 0 THEN '1 ' || lpad(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), 3, '0') || ',5 m2'
      WHEN 1 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' m2'
      WHEN 2 THEN CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ',25'
      WHEN 3 THEN 'brak'
      WHEN 4 THEN NULL
      WHEN 5 THEN '1 234 ' || lpad(CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), 3, '0') || ' m2'
      ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || 'd' END"""


@check(
    "parse_quantity",
    f"""
    WITH t AS (
      SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
             regexp_replace({QUANTITY_SQL}, ' m2', '') AS body
      FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
           TRY_CAST(replace(regexp_replace(body, ' ', '', 'g'), ',', '.') AS DOUBLE) AS area,
           TRY_CAST(replace(regexp_replace(body, ' ', ''), ',', '.') AS DOUBLE) AS area_first_space
    FROM t""",
)
def quantities(spark, folder):
    number = F.col("l_quantity").cast("int").cast("string")
    kind = F.col("l_linenumber") % 7
    text = (
        F.when(kind == 0, F.concat(F.lit("1 "), F.lpad(number, 3, "0"), F.lit(",5 m2")))
        .when(kind == 1, F.concat(number, F.lit(" m2")))
        .when(kind == 2, F.concat(number, F.lit(",25")))
        .when(kind == 3, F.lit("brak"))
        .when(kind == 5, F.concat(F.lit("1 234 "), F.lpad(number, 3, "0"), F.lit(" m2")))
        .when(kind == 6, F.concat(number, F.lit("d")))
    )
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_extendedprice",
        parse_quantity(text).alias("area"),
        parse_quantity(text, spaces="first").alias("area_first_space"),
    )


@check(
    "haversine",
    f"""
    WITH p AS (
      SELECT c_custkey, CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE 49.0 + (c_custkey % 5000) / 1000.0 END AS lat,
             14.0 + (c_custkey % 9000) / 1000.0 AS lon
      FROM customer)
    SELECT c_custkey,
           {rnd('''2 * 6371.0 * asin(least(1.0, sqrt(
             power(sin((radians(lat) - radians(53.1781)) / 2), 2)
             + cos(radians(53.1781)) * cos(radians(lat)) * power(sin((radians(lon) - radians(22.0592)) / 2), 2))))''', 6)}
             AS km
    FROM p WHERE lat IS NOT NULL
    UNION ALL SELECT c_custkey, NULL FROM p WHERE lat IS NULL""",
)
def haversine(spark, folder):
    key = F.col("c_custkey")
    placed = table(spark, folder, "customer").select(
        "c_custkey",
        F.when(key % 17 != 0, F.lit(49.0) + (key % 5000) / 1000.0).alias("lat"),
        (F.lit(14.0) + (key % 9000) / 1000.0).alias("lon"),
    )
    distance = great_circle_km(F.col("lat"), F.col("lon"), 53.1781, 22.0592)
    return placed.select("c_custkey", F.round(distance, 6).alias("km"))


SEGMENT_CASE = """CASE WHEN area IS NULL THEN NULL WHEN area <= 700 THEN 'Tiny/Sub-standard'
             WHEN area <= 1000 THEN 'Small Plot' WHEN area <= 1500 THEN 'Medium Plot'
             WHEN area <= 5000 THEN 'Large Plot' WHEN area <= 10000 THEN 'Investment/Small Farm'
             ELSE 'Hectares/Agriculture' END"""


@check(
    "size_segment",
    f"""
    WITH a AS (
      SELECT CASE WHEN l_linenumber = 7 THEN NULL
                  ELSE l_quantity * (CASE WHEN l_linenumber % 2 = 0 THEN 250 ELSE 100 END) END AS area
      FROM lineitem)
    SELECT {SEGMENT_CASE} AS segment, min(area) AS smallest, max(area) AS largest, count(*) AS n,
           CAST(min(CASE WHEN area <= 700 THEN 0 WHEN area <= 1000 THEN 1 WHEN area <= 1500 THEN 2
                WHEN area <= 5000 THEN 3 WHEN area <= 10000 THEN 4 WHEN area > 10000 THEN 5 END) AS INTEGER) AS ordinal
    FROM a GROUP BY 1""",
)
def size_segment(spark, folder):
    unit = F.when(F.col("l_linenumber") % 2 == 0, F.lit(250)).otherwise(F.lit(100))
    area = F.when(F.col("l_linenumber") != 7, F.col("l_quantity") * unit)
    return (
        table(spark, folder, "lineitem")
        .select(area.alias("area"))
        .withColumn("segment", bin_label(F.col("area"), lomza.SIZE_BREAKS, lomza.SIZE_LABELS))
        .groupBy("segment")
        .agg(
            F.min("area").alias("smallest"),
            F.max("area").alias("largest"),
            F.count(F.lit(1)).alias("n"),
            F.min(bin_ordinal(F.col("area"), lomza.SIZE_BREAKS)).alias("ordinal"),
        )
    )


@check(
    "value_repair",
    """
    WITH r AS (
      SELECT l_orderkey || '-' || l_linenumber AS ID, l_partkey, l_suppkey,
             CASE WHEN l_linenumber = 6 THEN NULL ELSE l_extendedprice END AS p0,
             CASE l_linenumber WHEN 1 THEN l_quantity / 10 WHEN 2 THEN l_quantity WHEN 3 THEN l_quantity * 40
                  WHEN 4 THEN NULL ELSE l_quantity * 5 + 1 END AS a0
      FROM lineitem),
    p AS (SELECT *, CASE WHEN p0 < 15000 THEN NULL ELSE p0 END AS price FROM r),
    a AS (SELECT *, CASE WHEN a0 <= 1 THEN NULL WHEN a0 < 100 THEN a0 * 100 ELSE a0 END AS a1 FROM p),
    b AS (SELECT *, CASE WHEN ID = '7-1' THEN 10200.0 WHEN a1 < 100 THEN NULL ELSE a1 END AS area FROM a)
    SELECT ID, l_partkey, l_suppkey, price AS PRICE, area AS AREA_M2, price / area AS PRICE_M2 FROM b""",
)
def value_repair(spark, folder):
    number, quantity = F.col("l_linenumber"), F.col("l_quantity")
    listed = table(spark, folder, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("ID"),
        "l_partkey",
        "l_suppkey",
        F.when(number != 6, F.col("l_extendedprice")).alias("PRICE"),
        F.when(number == 1, quantity / 10)
        .when(number == 2, quantity)
        .when(number == 3, quantity * 40)
        .when(number != 4, quantity * 5 + 1)
        .alias("AREA_M2"),
        F.lit(1.0).alias("PRICE_M2"),
    )
    return rules.override_area(rules.repair_area(rules.price_floor(listed)), {"7-1": 10200.0})


FENCES_SQL = """
    n AS (SELECT count(c_acctbal) AS n FROM customer),
    o AS (SELECT c_acctbal AS x, row_number() OVER (ORDER BY c_acctbal) - 1 AS i FROM customer WHERE c_acctbal IS NOT NULL),
    q AS (SELECT (SELECT min(x) FROM o, n WHERE i = round(0.25 * (n - 1))) AS q1,
                 (SELECT min(x) FROM o, n WHERE i = round(0.75 * (n - 1))) AS q3),
    f AS (SELECT q1, q3, q1 - 0.2 * (q3 - q1) AS lower, q3 + 0.2 * (q3 - q1) AS upper FROM q)"""


@check(
    "nearest_quantile_fences",
    f"""WITH {FENCES_SQL}
    SELECT c_custkey, c_acctbal, q1, q3, {rnd('lower', 6)} AS lower, {rnd('upper', 6)} AS upper
    FROM customer, f WHERE c_acctbal < lower OR c_acctbal > upper""",
)
def nearest_quantile_fences(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_acctbal")
    fences = outlier_fences(customers, "c_acctbal", k=0.2)
    outside = (
        customers.withColumn("f", fences.select(F.struct("*")).scalar())
        .select("*", "f.*")
        .filter(is_outlier(F.col("c_acctbal"), F.col("lower"), F.col("upper")))
        .drop("f")
    )
    return rounded(outside, 6, "lower", "upper")


@check(
    "outlier_correction",
    f"""WITH {FENCES_SQL},
    c AS (SELECT c_custkey, CASE WHEN (c_acctbal < lower OR c_acctbal > upper) AND regexp_matches(c_mktsegment, '(?i)ma|ur')
                 THEN c_acctbal / 10 ELSE c_acctbal END AS AREA_M2, CAST(c_nationkey * 1000 AS DOUBLE) AS PRICE
          FROM customer, f)
    SELECT c_custkey, {rnd('AREA_M2', 6)} AS AREA_M2, PRICE, {rnd('PRICE / nullif(AREA_M2, 0)', 2)} AS PRICE_M2 FROM c""",
)
def outlier_correction(spark, folder):
    listed = table(spark, folder, "customer").select(
        "c_custkey",
        F.col("c_acctbal").alias("AREA_M2"),
        "c_mktsegment",
        (F.col("c_nationkey") * 1000).cast("double").alias("PRICE"),
    )
    corrected = correct_unit_errors(listed, "AREA_M2", "c_mktsegment", pattern="(?i)ma|ur", k=0.2)
    return rounded(rules.unit_price(corrected).drop("c_mktsegment"), 6, "AREA_M2")


@check(
    "correction_join",
    """
    SELECT o.o_orderkey, coalesce(c.fixed, o.o_totalprice) AS o_totalprice
    FROM orders o LEFT JOIN (
      SELECT l_orderkey, max(l_extendedprice) AS fixed FROM lineitem
      WHERE l_quantity > 45 GROUP BY l_orderkey) c ON o.o_orderkey = c.l_orderkey""",
)
def correction_join(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", "o_totalprice")
    corrections = (
        table(spark, folder, "lineitem")
        .filter(F.col("l_quantity") > 45)
        .select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("fixed"))
    )
    return apply_corrections(orders, corrections, "o_orderkey", "o_totalprice", "fixed")


@check(
    "dedup_latest",
    """
    SELECT l_orderkey, l_linenumber, CAST(CAST(l_shipdate AS DATE) AS VARCHAR) AS l_shipdate, l_partkey, l_suppkey,
           l_quantity, l_extendedprice
    FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
            ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS r
          FROM lineitem) WHERE r = 1""",
)
def dedup(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.to_date("l_shipdate").alias("l_shipdate"),
        "l_partkey",
        "l_suppkey",
        "l_quantity",
        "l_extendedprice",
    )
    return dedup_latest(lines, ["l_orderkey", "l_linenumber"], ["l_shipdate"])


@check(
    "null_profile",
    """
    WITH o AS (
      SELECT o_orderkey, nullif(o_orderstatus, 'F') AS o_orderstatus, nullif(o_orderpriority, '1-URGENT') AS o_orderpriority,
             CASE WHEN o_totalprice < 50000 THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders)
    SELECT 0 AS position, 'o_orderkey' AS "column", 'bigint' AS type, count(*) - count(o_orderkey) AS nulls, count(o_orderkey) AS non_nulls FROM o
    UNION ALL SELECT 1, 'o_orderstatus', 'string', count(*) - count(o_orderstatus), count(o_orderstatus) FROM o
    UNION ALL SELECT 2, 'o_orderpriority', 'string', count(*) - count(o_orderpriority), count(o_orderpriority) FROM o
    UNION ALL SELECT 3, 'o_totalprice', 'double', count(*) - count(o_totalprice), count(o_totalprice) FROM o""",
)
def nulls(spark, folder):
    return null_profile(
        table(spark, folder, "orders").select(
            "o_orderkey",
            F.nullif("o_orderstatus", F.lit("F")).alias("o_orderstatus"),
            F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("o_orderpriority"),
            F.when(F.col("o_totalprice") >= 50000, F.col("o_totalprice")).alias("o_totalprice"),
        )
    )


@check(
    "table_profile",
    """
    SELECT rows, CAST(7 AS BIGINT) AS columns, p.position, p.name AS "column", p.nulls FROM (SELECT count(*) AS rows,
        unnest([{'position': 0, 'name': 'event_id', 'nulls': count(*) - count(event_id)},
                {'position': 1, 'name': 'ts', 'nulls': count(*) - count(ts)},
                {'position': 2, 'name': 'user_id', 'nulls': count(*) - count(user_id)},
                {'position': 3, 'name': 'event_type', 'nulls': count(*) - count(event_type)},
                {'position': 4, 'name': 'value', 'nulls': count(*) - count(value)},
                {'position': 5, 'name': 'props', 'nulls': count(*) - count(props)},
                {'position': 6, 'name': 'error', 'nulls': count(*) - count(*) FILTER (event_type = 'error')}]) AS p FROM events)""",
)
def whole_profile(spark, folder):
    events = table(spark, folder, "events")
    events = events.withColumn("error", F.when(F.col("event_type") == "error", True))
    found = table_profile(events).select("rows", "columns", F.inline("profile"))
    return found.select("rows", "columns", "position", "column", "nulls")


@check(
    "regex_filters",
    r"""
    SELECT doc_id, lang, CAST(contains(text, 'license') AS INTEGER) AS licensed,
           CAST(regexp_matches(text, '^(The|That|In)[a-z]*') AS INTEGER) AS starts,
           CAST(regexp_matches(text, '(?i)secret|token') AS INTEGER) AS secret
    FROM documents
    WHERE (contains(source, 'src1') AND lang IS NOT NULL AND regexp_matches(text, 'th|er'))
       OR coalesce(regexp_matches(nullif(lang, 'de'), '^(fr|es)$'), FALSE)""",
)
def regex_filters(spark, folder):
    text, lang = F.col("text"), F.col("lang")
    kept = (F.contains("source", F.lit("src1")) & lang.isNotNull() & text.rlike("th|er")) | mentions(
        F.nullif(lang, F.lit("de")), "^(fr|es)$"
    )
    return (
        table(spark, folder, "documents")
        .na.drop(subset=["text"])
        .filter(kept)
        .select(
            "doc_id",
            "lang",
            F.contains(text, F.lit("license")).cast("int").alias("licensed"),
            text.rlike("^(The|That|In)[a-z]*").cast("int").alias("starts"),
            text.rlike("(?i)secret|token").cast("int").alias("secret"),
        )
    )


@check(
    "dates",
    """
    WITH t AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN 'none' ELSE CAST(CAST(o_orderdate AS DATE) AS VARCHAR) END AS txt
               FROM orders)
    SELECT o_orderkey, CAST(TRY_CAST(txt AS DATE) AS VARCHAR) AS day, CAST(isodow(TRY_CAST(txt AS DATE)) AS INTEGER) AS iso_day,
           dayname(TRY_CAST(txt AS DATE)) AS english FROM t""",
)
def dates(spark, folder):
    from parcelflow.functions.dates import parse_date

    day = F.to_date("o_orderdate").cast("string")
    text = F.when(F.col("o_orderkey") % 10 == 0, F.lit("none")).otherwise(day)
    return (
        table(spark, folder, "orders")
        .select("o_orderkey", parse_date(text, strict=False).alias("day"))
        .withColumns({"iso_day": iso_weekday(F.col("day")), "english": weekday_english(F.col("day"))})
    )


RAW_PLACES = [(0, "PRIORITY", 10.0, 20.0), (1, "LOW", 11.0, 21.0), (2, "URGENT", 12.0, 22.0)]


@check(
    "source_prepare",
    f"""
    WITH r AS (
      SELECT CAST(o_orderkey AS VARCHAR) AS ID, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS upd,
             CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE CAST(CAST(o_orderdate AS DATE) - 3 AS VARCHAR) END AS added,
             o_totalprice AS PRICE, CAST(o_custkey AS DOUBLE) + 0.5 AS AREA_M2, upper(trim(o_orderpriority)) AS place
      FROM orders WHERE o_orderstatus <> 'P'),
    c AS (
      SELECT *, CASE WHEN place = '3-MEDIUM' THEN 'BRAK' ELSE place END AS given FROM r),
    m AS (
      SELECT *, CASE WHEN given = 'BRAK' THEN NULL WHEN contains(given, 'PRIORITY') THEN 'PRIORITY'
                     WHEN contains(given, 'LOW') THEN 'LOW' WHEN contains(given, 'URGENT') THEN 'URGENT'
                     ELSE 'LOW' END AS city FROM c)
    SELECT ID, coalesce(added, upd) AS DATE_ADDED, upd AS LAST_UPDATED, AREA_M2,
           {rnd('PRICE / AREA_M2', 2)} AS PRICE_M2, city AS CITY,
           CASE city WHEN 'PRIORITY' THEN 10.0::DOUBLE WHEN 'LOW' THEN 11.0 WHEN 'URGENT' THEN 12.0 END AS LAT,
           CASE city WHEN 'PRIORITY' THEN 20.0::DOUBLE WHEN 'LOW' THEN 21.0 WHEN 'URGENT' THEN 22.0 END AS LON,
           PRICE
    FROM m""",
)
def source_prepare(spark, folder):
    day = F.to_date("o_orderdate")
    raw = table(spark, folder, "orders").select(
        F.col("o_orderkey").cast("string").alias("ID"),
        F.when(F.col("o_orderkey") % 4 != 0, F.date_sub(day, 3).cast("string")).alias("FIRST"),
        day.cast("string").alias("LAST_UPDATED"),
        F.col("o_totalprice").alias("PRICE"),
        F.concat("o_custkey", F.lit(",5 m2")).alias("Area"),
        F.concat(F.lit("\t"), "o_orderpriority", F.lit(" ")).alias("LOCATION"),
        "o_orderstatus",
    )
    spec = SourceSpec(
        rename={"FIRST": "DATE_ADDED", "Area": "AREA_M2", "LOCATION": "CITY"},
        keep=("o_orderstatus <> 'P'",),
        quantities={"AREA_M2": Quantity()},
        added_from_updated=True,
        derive_unit_price=True,
        place="text",
    )
    places = Places(RAW_PLACES, {"3-MEDIUM": "BRAK"}, default_place="LOW")
    prepared = prepare(raw, spec, places, gazetteer_frame(spark, RAW_PLACES))
    return prepared.select(
        "ID", "DATE_ADDED", "LAST_UPDATED", "AREA_M2", "PRICE_M2", "CITY", "LAT", "LON", "PRICE"
    )
