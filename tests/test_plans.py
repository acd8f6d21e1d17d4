import datetime as dt
import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks.series import event_listings
from parcelflow import schemas
from parcelflow.plans.listings import build_listings, lomza_market
from parcelflow.plans.market import (
    DIGITS,
    MEDIANS,
    daily_market_stats,
    daily_medians,
    daily_totals,
    explode_days,
)
from parcelflow.plans.prepare import harmonise
from parcelflow.session import scratch_path, shared_folder
from parcelflow.sources.dimensions import dimension_frame, read_regions
from parcelflow.sources.snapshots import all_snapshots, latest_snapshot, snapshot_days, write_snapshot
from parcelflow.sources.tables import JdbcTables, ParquetTables, load_table


def raw(spark):
    return {
        "offers": spark.createDataFrame(
            [("1", "2024-01-01", "2024-01-05", "800", "1", "Łomża", 160000.0), ("2", None, "2024-01-05", "8", "1", "kolno", 14000.0)],
            "ID string, DATE_ISO string, LAST_UPDATED string, AREA_M2 string, PRICE_M2 string, CITY string, VALUE double",
        ),
        "offers_tytan": spark.createDataFrame(
            [(3, "2024-03-01", "2024-02-01", "Nigdzie", 0.5, None, 99000.0)],
            "ID int, DATE_ADDED string, LAST_UPDATED string, LOCATION string, AREA_M2 double, PRICE_M2 double, PRICE double",
        ),
        "offers_gralczyk": spark.createDataFrame(
            [("dzialka-jedwabne-lomzynska", "2024-01-01", "2024-04-20", "204000", "1", "1 020,0  m2")],
            "ID string, FIRST_ADDED string, LAST_UPDATED string, Cena string, `Cena za m2` string, Powierzchnia string",
        ),
        "offers_polnoc": spark.createDataFrame(
            [("dzialka-stara-lomza-2", "2024-01-01", "2024-01-31", 50000.0, 1.0, 1000.0), ("dom-x", "2024-01-01", "2024-01-02", 1.0, 1.0, 5.0), ("dzialka-x", "2024-01-01", "2024-01-02", 1.0, 1.0, None)],
            "ID string, FIRST_ADDED string, LAST_UPDATED string, Cena double, `Cena za m2` double, `Powierzchnia działki` double",
        ),
        "analyzed_offers": spark.createDataFrame(
            [("9", "DZIAŁKA BUDOWLANA", "SPRZEDAZ", "2024-01-01", "2024-01-02", "2024-01-01", "900 m2", "90000", "tekst", "Gełczyn"),
             ("9", "DZIAŁKA BUDOWLANA", "SPRZEDAZ", "2024-01-01", "2024-01-09", "2024-01-01", "900 m2", "99000", "tekst", "\tGełczyn"),
             ("10", "DZIAŁKA BUDOWLANA", "SPRZEDAZ", "2024-01-01", "2024-01-02", "2024-01-01", "duża", "90000", None, "las"),
             ("11", "DOM", "SPRZEDAZ", "2024-01-01", "2024-01-02", "2024-01-01", "1", "1", None, None),
             ("12", "DZIAŁKA BUDOWLANA", "SPRZEDAZ", "2024-01-01", "2024-01-02", "2024-01-01", "1000,5 m2", "90000", "x", None)],
            "ID string, ESTATE_TYPE string, OFFER_TYPE string, DATE_ADDED string, LAST_UPDATED string, ANNOUNCE_DATE string, AREA_M2 string, PRICE string, TEXT string, LOCATION string",
        ),
    }


def test_listings_from_five_sources(spark):
    listings = build_listings(raw(spark), lomza_market())
    assert not schemas.mismatches(listings.schema, schemas.LISTINGS)
    rows = {r["ID"]: r for r in listings.collect()}
    assert set(rows) == {"1", "2", "3", "dzialka-jedwabne-lomzynska", "dzialka-stara-lomza-2", "9", "10", "12"}
    assert rows["1"]["PRICE_M2"] == 200.0 and rows["1"]["MAIN_CITY_DIST"] == 0.0 and rows["1"]["SOURCE"] == "Website E"
    assert rows["1"]["DAY_NAME_PL"] == "Poniedziałek" and rows["1"]["SIZE_SEGMENT"] == "Small Plot"
    assert rows["2"]["DATE_ADDED"] == dt.date(2024, 1, 5) and rows["2"]["PRICE"] is None and rows["2"]["AREA_M2"] == 800.0
    assert rows["3"]["AREA_M2"] is None and rows["3"]["LAT"] is None and rows["3"]["CITY"] == "NIGDZIE"
    assert rows["3"]["DATE_ADDED"] == dt.date(2024, 2, 1) and rows["3"]["DAYS_ON_MARKET"] == 29 and rows["3"]["DAY_NAME_PL"] == "Piątek"
    jedwabne = rows["dzialka-jedwabne-lomzynska"]
    assert jedwabne["AREA_M2"] == 10200.0 and jedwabne["PRICE_M2"] == 20.0 and jedwabne["CITY"] == "JEDWABNE"
    assert jedwabne["MARKET_STATUS"] == "Old/Negotiable"
    assert rows["dzialka-stara-lomza-2"]["CITY"] == "ŁOMŻA"
    assert rows["9"]["PRICE"] == 99000.0 and rows["9"]["CITY"] == "GIEŁCZYN"
    assert rows["10"]["CITY"] is None and rows["10"]["AREA_M2"] is None
    assert rows["12"]["CITY"] == "ŁOMŻA"


def test_union_needs_one_price_column(spark):
    df = spark.createDataFrame([(1, 2)], "PRICE int, VALUE int")
    with pytest.raises(ValueError):
        harmonise(df, "s")


def random_listings(spark, n=300, seed=3):
    rng = random.Random(seed)
    day = dt.date(2024, 1, 1)
    rows = []
    for i in range(n):
        start = day + dt.timedelta(rng.randrange(60)) if rng.random() > 0.03 else None
        end = start + dt.timedelta(rng.choice([0, 1, 5, 40, -2])) if start else day
        value = lambda: None if rng.random() < 0.1 else rng.choice([rng.lognormvariate(4, 2), 5.0, 0.0])
        rows.append((i, start, end, value(), value(), None if i % 2 else value()))
    return spark.createDataFrame(rows, "ID int, DATE_ADDED date, LAST_UPDATED date, PRICE double, PRICE_M2 double, AREA_M2 double")


def test_daily_plans_agree(spark):
    listings = random_listings(spark)
    exact = {name: 6 for name in DIGITS}
    exploded = daily_market_stats(listings, strategy="explode", digits=exact)
    changes = daily_market_stats(listings, strategy="changes", digits=exact)
    assert exploded.columns == changes.columns == schemas.DAILY_STATS.fieldNames()
    assert exploded.collect() == changes.collect()
    assert not schemas.mismatches(changes.schema, schemas.DAILY_STATS)


def test_days_without_area_have_sum_zero(spark):
    d = dt.date(2024, 1, 1)
    rows = [(1, d, d, 1.0, 1.0, None), (2, d + dt.timedelta(3), d + dt.timedelta(3), None, None, 2.0)]
    df = spark.createDataFrame(rows, "ID int, DATE_ADDED date, LAST_UPDATED date, PRICE double, PRICE_M2 double, AREA_M2 double")
    for strategy in ("explode", "changes"):
        first, last = daily_market_stats(df, strategy=strategy).collect()
        assert first["TOTAL_AREA_ON_MARKET"] == 0.0 and first["MEDIAN_AREA_M2"] is None
        assert last["AVG_PRICE"] is None and last["MEDIAN_AREA_M2"] == 2.0
        assert (last["ACTIVE_DAY"] - first["ACTIVE_DAY"]).days == 3


def test_counts_add_up_to_days_on_market(spark, folder):
    listings = event_listings(spark, folder)
    days = listings.agg(F.sum(F.datediff("LAST_UPDATED", "DATE_ADDED") + 1)).first()[0]
    assert daily_totals(listings).agg(F.sum("TOTAL_ACTIVE_OFFERS")).first()[0] == days


def test_medians_with_coarse_and_fine_cells(spark):
    listings = random_listings(spark, seed=4)
    coarse = daily_medians(listings, cell_bits=5).orderBy("ACTIVE_DAY").collect()
    assert coarse == daily_medians(listings, cell_bits=24).orderBy("ACTIVE_DAY").collect()
    divided = daily_medians(listings, cell_bits=5, sorted_rows=3).orderBy("ACTIVE_DAY").collect()
    assert coarse == divided


def test_medians_of_one_full_cell(spark):
    day = dt.date(2024, 1, 1)
    value = F.lit(1000.0) + F.pmod(F.hash("id"), F.lit(997)) * 2.0**-40
    listings = spark.range(6000).select(
        F.col("id").alias("ID"),
        F.date_add(F.lit(day), (F.col("id") % 5).cast("int")).alias("DATE_ADDED"),
        F.date_add(F.lit(day), (5 + F.col("id") % 9).cast("int")).alias("LAST_UPDATED"),
        *[value.alias(c) for c in ("PRICE", "PRICE_M2")],
        F.lit(-7.5).alias("AREA_M2"),
    )
    days = explode_days(listings).groupBy("ACTIVE_DAY").agg(
        *[F.median(source).alias(name) for name, source in MEDIANS.items()]
    )
    found = daily_medians(listings, sorted_rows=10)
    assert sorted(found.collect()) == sorted(days.select(found.columns).collect())


def test_sums_of_very_different_amounts(spark):
    rng = random.Random(5)
    day = dt.date(2024, 1, 1)
    kinds = (1e20, 2.0**-40, 1e-12, 123.45, -7.0, 1e300, 5e-324, float("nan"), None)
    rows = []
    for i in range(400):
        start = rng.randrange(30)
        amounts = [rng.choice(kinds) for _ in range(3)]
        rows.append((i, *(day + dt.timedelta(d) for d in (start, start + rng.randrange(6))), *amounts))
    listings = spark.createDataFrame(
        rows, "ID int, DATE_ADDED date, LAST_UPDATED date, PRICE double, PRICE_M2 double, AREA_M2 double"
    )
    exploded = daily_market_stats(listings, strategy="explode", digits={}).collect()
    assert exploded == daily_market_stats(listings, strategy="changes", digits={}).collect()
    first = min(r[2] for r in rows)
    for row in exploded:
        active = [r for r in rows if r[1] <= row["ACTIVE_DAY"] <= r[2]]
        areas = [Fraction(r[5]) for r in active if r[5] is not None and r[5] == r[5]]
        assert row["ACTIVE_DAY"] >= first and row["TOTAL_ACTIVE_OFFERS"] == len(active)
        assert row["TOTAL_AREA_ON_MARKET"] == pytest.approx(float(sum(areas)), rel=1e-15, abs=0)


def test_infinite_amounts(spark):
    day, inf = dt.date(2024, 1, 1), float("inf")
    rows = [(1, day, day, inf, inf, -inf), (2, day, day, 1.0, -inf, 1.0)]
    df = spark.createDataFrame(
        rows, "ID int, DATE_ADDED date, LAST_UPDATED date, PRICE double, PRICE_M2 double, AREA_M2 double"
    )
    for strategy in ("explode", "changes"):
        row = daily_market_stats(df, strategy=strategy, digits={}).first()
        assert row["AVG_PRICE"] == inf and row["TOTAL_AREA_ON_MARKET"] == -inf
        assert math.isnan(row["AVG_PRICE_M2"])


def test_snapshots(spark, tmp_path):
    root = str(tmp_path / "s")
    one = spark.createDataFrame([(1,)], "v int")
    with pytest.raises(ValueError):
        write_snapshot(one, root, "today")
    write_snapshot(one, root, "2024-01-09")
    write_snapshot(spark.createDataFrame([(2,), (3,)], "v int"), root, dt.date(2024, 1, 10), files=2)
    write_snapshot(spark.createDataFrame([(4,)], "v int"), root, "2024-01-10")
    assert snapshot_days(spark, root) == ["2024-01-09", "2024-01-10"]
    assert [tuple(r) for r in latest_snapshot(spark, root).collect()] == [(4, dt.date(2024, 1, 10))]
    assert all_snapshots(spark, root).count() == 2


def test_sources(spark, folder):
    jdbc = JdbcTables("jdbc:x:y", {"offers": ("ID", "0", "1000", 8)}, {"user": "u"})
    assert jdbc.options("offers")["numPartitions"] == "8" and jdbc.options("offers")["partitionColumn"] == "ID"
    assert "partitionColumn" not in jdbc.options("other")
    with pytest.raises(Exception):
        load_table(spark, ParquetTables(folder), "missing")
    with pytest.raises(ValueError):
        dimension_frame(spark, [("a", 1), ("a", 2)], schemas.T.StructType([schemas.T.StructField("k", schemas.T.StringType()), schemas.T.StructField("v", schemas.T.IntegerType())]), "k")


def test_regions_from_json(spark, tmp_path):
    file = tmp_path / "r.json"
    file.write_text('{"region_id": 1, "name": "x", "ring": [{"lon": 0, "lat": 1}]}\n')
    row = read_regions(spark, str(file), "json").first()
    assert row["ring"][0]["lat"] == 1.0 and row["region_id"] == 1


def test_shared_folder_is_the_configured_one(spark):
    named = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark) == named and scratch_path(spark, "t").startswith(named)




@pytest.mark.parametrize("name", ["cleaned_listings", "daily_market_stats_delta", "segment_price_stats_cells", "point_in_polygon", "first_match_dictionary", "first_match_dictionary_join", "price_attractiveness", "kde", "dedup_latest"])
def test_plans_without_python_or_cross_joins(spark, folder, name):
    plan = entry.queries()[name](spark, folder)._jdf.queryExecution().toString()
    for word in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan


def test_gazetteer_join_does_not_shuffle(spark, folder):
    plan = entry.queries()["gazetteer_left_join"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
