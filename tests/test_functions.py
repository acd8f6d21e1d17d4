import datetime as dt
import math
import random
import struct
from fractions import Fraction

import pytest
from pyspark.errors import NumberFormatException, DateTimeException
from pyspark.sql import functions as F

from parcelflow.functions import exact, rules
from parcelflow.functions.dates import iso_weekday, parse_date, weekday_english, weekday_label
from parcelflow.functions.lookup import first_match, replace_exact, resolve_place, unify_variants
from parcelflow.functions.numeric import bin_label, great_circle_km, not_nan, ratio
from parcelflow.functions.text import fold, mentions, parse_quantity, replace_first, slug_to_name, strip_whitespace
from parcelflow.operators.pricing import ratio_label
from parcelflow.plans.listings import lomza_market
from parcelflow.profiles import lomza
from parcelflow.sources.dimensions import parse_gazetteer



def x():
    return F.col("x")


def test_lenient_quantities(column):
    assert column(["1\u00a0234,5 m2", "12\u202f000"], "string", parse_quantity(x())) == [1234.5, 12000.0]
    texts = ["1 234,5 m2", "800 m2", "1 234 567 m2", "brak", "12d", "", None]
    assert column(texts, "string", parse_quantity(x())) == [1234.5, 800.0, 1234567.0, None, None, None, None]
    assert column(texts, "string", parse_quantity(x(), spaces="first"))[2] is None
    assert column(texts, "string", parse_quantity(x(), spaces="none"))[0] is None


def test_strict_quantity_refuses_bad_text(column):
    assert column(["1 234,5  m2"], "string", parse_quantity(x(), "  m2", strict=True)) == [1234.5]
    with pytest.raises(NumberFormatException):
        column(["brak"], "string", parse_quantity(x(), strict=True))


def test_slugs(column):
    slugs = ["dzialka-jedwabne-lomzynska", "dzialka--nowogrod", "dom-kolno", None]
    assert column(slugs, "string", slug_to_name(x())) == ["JEDWABNE LOMZYNSKA", "NOWOGROD", "DOM KOLNO", None]


def test_text_helpers(column):
    assert column(["\t Łomża \n"], "string", strip_whitespace(x())) == ["Łomża"]
    assert column(["zażółć gęślą"], "string", fold(x())) == ["ZAZOLC GESLA"]
    assert column(["a-b-c", "abc"], "string", replace_first(x(), "-")) == ["ab-c", "abc"]
    assert column(["a.b"], "string", replace_first(x(), ".", "$1\\")) == ["a$1\\b"]
    assert column(["--a", "a--", "-", "", None], "string", replace_first(x(), "-")) == ["-a", "a-", "", "", None]
    assert column(["a m2 m2", " m2", "m2"], "string", replace_first(x(), " m2")) == ["a m2", "", "m2"]
    assert column(["Łomża", "Łomżanka", None], "string", mentions(x(), r"(?U)^Łomża\b")) == [True, False, False]


def test_dates(column):
    assert column(["2026-03-30", None], "string", parse_date(x())) == [dt.date(2026, 3, 30), None]
    assert column(["30.03."], "string", parse_date(x(), strict=False)) == [None]
    with pytest.raises(DateTimeException):
        column(["30.03."], "string", parse_date(x()))
    monday, sunday = dt.date(2026, 3, 30), dt.date(2026, 4, 5)
    assert column([monday, sunday, None], "date", iso_weekday(x())) == [1, 7, None]
    assert column([monday, sunday, None], "date", weekday_label(x(), lomza.WEEKDAYS)) == ["Poniedziałek", "Niedziela", None]
    assert column([monday], "date", weekday_english(x())) == ["Monday"]


def test_bins_are_closed_on_the_right(column):
    areas = [700.0, 700.01, 1000.0, 1500.0, 5000.0, 10000.0, 10000.01, None]
    labels = column(areas, "double", bin_label(x(), lomza.SIZE_BREAKS, lomza.SIZE_LABELS))
    s = lomza.SIZE_LABELS
    assert labels == [s[0], s[1], s[1], s[2], s[3], s[4], s[5], None]


def test_distance(spark):
    points = [(53.1781, 22.0592), (-53.1781, 22.0592 - 180), (None, 22.0), (53.0, 22.0)]
    rows = spark.createDataFrame(points, "lat double, lon double")
    km = [r[0] for r in rows.select(great_circle_km(F.col("lat"), F.col("lon"), 53.1781, 22.0592)).collect()]
    assert km[0] == 0.0
    assert km[1] == pytest.approx(math.pi * 6371.0, rel=1e-9)
    assert km[2] is None
    back = rows.limit(1).select(great_circle_km(F.col("lat"), F.col("lon"), 53.0, 22.0)).first()[0]
    assert km[3] == pytest.approx(back)


def test_ratio_and_nan(column):
    assert column([0.0, 2.0, None], "double", ratio(F.lit(1.0), x())) == [None, 0.5, None]
    assert column([float("nan"), 1.0], "double", not_nan(x())) == [None, 1.0]


def test_price_labels(column):
    values = [0.8499, 0.85, 1.0, 1.15, 1.1501, None]
    assert column(values, "double", ratio_label(x())) == [
        "Underpriced", "Market Price", "Market Price", "Market Price", "Overpriced", "Unknown",
    ]


def test_status_steps(column):
    days = [0, 7, 8, 30, 31, 90, 91, None]
    assert column(days, "bigint", rules.status(x())) == [
        "New Offer", "New Offer", "Active", "Active", "Stale", "Stale", "Old/Negotiable", "Old/Negotiable",
    ]


def test_area_repair(column):
    areas = [None, 0.0, 1.0, 1.01, 99.99, 100.0]
    assert column(areas, "double", rules.repaired_area(x())) == [None, None, None, 101.0, 9999.0, 100.0]


def test_price_floor(spark):
    rows = spark.createDataFrame([(14999.99, 1.0), (15000.0, 1.0), (None, 1.0)], "PRICE double, PRICE_M2 double")
    assert [tuple(r) for r in rules.price_floor(rows).collect()] == [(None, None), (15000.0, 1.0), (None, None)]


def test_interval_repair(spark):
    a, b = dt.date(2024, 1, 1), dt.date(2024, 1, 9)
    rows = spark.createDataFrame([(a, a), (a, b), (b, a), (None, a), (b, None)], "DATE_ADDED date, LAST_UPDATED date")
    once = rules.order_interval(rows)
    assert [tuple(r) for r in once.collect()] == [(a, a), (a, b), (a, b), (None, a), (b, None)]
    assert rules.order_interval(once).collect() == once.collect()


def test_overrides(spark):
    rows = spark.createDataFrame([("a", 10.0, 100.0, 5.0), ("b", 20.0, 100.0, 5.0)], "ID string, AREA_M2 double, PRICE double, PRICE_M2 double")
    assert [tuple(r) for r in rules.override_area(rows, {"a": 50}).orderBy("ID").collect()] == [
        ("a", 50.0, 100.0, 2.0), ("b", 20.0, 100.0, 5.0),
    ]


def test_gazetteer_settles_repeated_and_mixed_case_names():
    rows = parse_gazetteer("B; 1; 2\nA; 3; 4\nB; 5; 6\nxł; 7; 8\n")
    assert rows == [(0, "B", 5.0, 6.0), (1, "A", 3.0, 4.0), (2, "XŁ", 7.0, 8.0)]


def test_deployment_gazetteer():
    market = lomza_market()
    names = market.places.names
    assert len(names) == 153 and len(set(names)) == 153
    assert names.index("MIASTKOWO") < names.index("KSIĘŻOPOLE")
    assert dict((n, (a, b)) for _, n, a, b in market.places.gazetteer)["MIASTKOWO"] == (53.1508, 21.8386)


def test_places_in_text(column):
    names = lomza_market().places.names
    texts = ["Dzialka STARA LOMZA", "stara łomża nad rzeką", "w zambrowie", "WOLA ZAMBRÓWSKA", "nigdzie", None]
    assert column(texts, "string", first_match(x(), names)) == [
        "ŁOMŻA", "STARA ŁOMŻA NAD RZEKĄ", "ZAMBRÓW", "ZAMBRÓW", None, None,
    ]
    assert column(texts[:1], "string", first_match(x(), names, "longest_match")) == ["STARA ŁOMŻA"]
    assert column(["GORKI SYPNIEWO"], "string", first_match(x(), ["GÓRKI-SYPNIEWO"])) == [None]
    assert column(["GORKI SYPNIEWO"], "string", first_match(x(), ["GÓRKI-SYPNIEWO"], hyphen_as_space=True)) == ["GÓRKI-SYPNIEWO"]


def test_dictionaries(column):
    fixed = lomza_market().places.corrections
    assert column(["GEŁCZYN", "GLŁCZYN", "LAS", "KOLNO", None], "string", replace_exact(x(), fixed)) == [
        "GIEŁCZYN", "GIEŁCZYN", "BRAK", "KOLNO", None,
    ]
    assert column(["offers", "new"], "string", replace_exact(x(), lomza.SOURCE_NAMES, "Other")) == ["Website E", "Other"]
    assert column(["STARA ŁOMŻA PRZY SZOSIE", "ŁOMŻA", None], "string", unify_variants(x(), lomza.VILLAGE_VARIANTS, lomza.VILLAGE_NAME)) == [
        "STARA ŁOMŻA", "ŁOMŻA", None,
    ]
    assert column(["brak", "KOLNO", "??", None], "string", resolve_place(x(), F.when(x() == "KOLNO", x()), "BRAK", "ŁOMŻA")) == [
        None, "KOLNO", "ŁOMŻA", "ŁOMŻA",
    ]


def test_sortable_keys_and_limbs(spark):
    rng = random.Random(8)
    values = [0.0, -0.0, 1.0, -1.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308]
    values += [1.7976931348623157e308, float("inf"), -float("inf"), 1e20, 1e-12, 0.1, 2.0**53 + 2]
    for _ in range(2000):
        (value,) = struct.unpack("d", struct.pack("Q", rng.getrandbits(64)))
        values += [value, 2.0 ** rng.randrange(-1074, 1024), math.nextafter(2.0 ** rng.randrange(-1000, 1000), 0)]
    values = [v for v in values if v == v]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    parts = F.struct("bucket", "hi", "lo")

    def taken_apart(df):
        rows = exact.add_limbs(exact.add_sortable(df, "v", "k"), "v")
        return rows.select("v", "k", exact.from_sortable(F.col("k")).alias("back"), parts.alias("l"))

    rows = taken_apart(df).collect()
    for r in rows:
        bits = struct.unpack("q", struct.pack("d", abs(r["v"])))[0]
        assert r["k"] == (-bits if r["v"] < 0 else bits) and r["back"] == r["v"]
        if math.isinf(r["v"]):
            assert r["l"]["bucket"] == exact.INFINITE
            continue
        whole = int(r["l"]["hi"]) * 2**exact.LIMB_BITS + int(r["l"]["lo"])
        assert Fraction(r["v"]) == whole * Fraction(2) ** (exact.BUCKET_BITS * r["l"]["bucket"])
        assert 0 <= r["l"]["lo"] < 2**exact.LIMB_BITS and abs(r["l"]["hi"]) < 10**14
    back = taken_apart(df).select("v", exact.total(F.array("l")).alias("t")).collect()
    assert all(r["v"] == r["t"] for r in back)
    blank = taken_apart(spark.createDataFrame([(None,), (float("nan"),)], "v double"))
    assert blank.filter("k is not null or back is not null or l.bucket is not null").isEmpty()
