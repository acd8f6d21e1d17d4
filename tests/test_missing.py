"""Nulls and NaN: one result whichever plan runs."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from parcelflow.functions.lookup import first_match, first_match_in_text, replace_exact
from parcelflow.functions.numeric import bin_label
from parcelflow.learning.split import contiguous_folds, stratified_split
from parcelflow.operators.resolve import first_match_join
from parcelflow.operators.selection import group_quantiles
from parcelflow.operators.stats import boxplot_stats, column_summary, group_stats, histogram, kernel_density
from parcelflow.plans.market import daily_market_stats
from parcelflow.sources.snapshots import all_snapshots, latest_snapshot, snapshot_days, write_snapshot

NAN = float("nan")


@pytest.fixture(scope="module")
def numbers(spark):
    rows = [("a", 1.0), ("a", 2.0), ("a", 4.0), ("a", NAN), ("b", NAN), ("b", None)]
    return spark.createDataFrame(rows, "k string, v double")


def test_nan_is_no_value_in_statistics(numbers):
    plain = numbers.filter("v < 100")
    for made in (lambda df: histogram(df, "v", 4), lambda df: kernel_density(df, "v", 5), lambda df: boxplot_stats(df, "k", "v")):
        assert sorted(made(numbers).collect()) == sorted(made(plain).collect())
    labels = numbers.select(bin_label(F.col("v"), [1.5], ["low", "high"]).alias("x"))
    assert [r["x"] for r in labels.collect()] == ["low", "high", "high", None, None, None]


@pytest.mark.parametrize("strategy", ["builtin", "cells"])
def test_groups_without_values(numbers, strategy):
    rows = group_stats(numbers, ["k"], ["v"], strategy=strategy).orderBy("k").collect()
    assert [(r["k"], r["v_median"]) for r in rows] == [("a", 2.0), ("b", None)]
    assert rows[0]["v_mean"] == pytest.approx(7 / 3) and rows[1]["v_mean"] is None
    found = group_quantiles(numbers, ["k"], ["v"], {"m": 0.5}, strategy=strategy).collect()
    assert [tuple(r) for r in found] == [("a", 2.0)]


@pytest.mark.parametrize("strategy", ["explode", "changes"])
def test_daily_series_leaves_nan_out(spark, strategy):
    day = dt.date(2024, 1, 1)
    rows = [(str(i), day, day, price, 1.0, 1.0) for i, price in enumerate((100.0, NAN, 300.0))]
    listings = spark.createDataFrame(
        rows, "ID string, DATE_ADDED date, LAST_UPDATED date, PRICE double, PRICE_M2 double, AREA_M2 double"
    )
    found = daily_market_stats(listings, strategy=strategy).first()
    assert (found["TOTAL_ACTIVE_OFFERS"], found["AVG_PRICE"]) == (3, 200.0)


def test_null_is_a_stratum(spark):
    df = spark.range(40).select("id", F.when(F.col("id") % 2 == 0, F.lit("x")).alias("label"))
    split = stratified_split(df, "label", F.col("id")).groupBy("label", "split").count().collect()
    assert {(r["label"], r["split"]): r["count"] for r in split} == {
        (None, "train"): 16, ("x", "train"): 16, (None, "test"): 4, ("x", "test"): 4,
    }
    folds = contiguous_folds(df, F.col("id"), 4, by="label").groupBy("label", "fold").count().collect()
    assert sorted(r["count"] for r in folds) == [5] * 8


def test_summary_of_one_column(numbers):
    found = column_summary(numbers.filter("v < 100"), ["v"]).first()
    assert tuple(found) == (1.0, 4.0, 4.0)


def test_dictionary_search_is_the_same_inline_and_joined(spark):
    rows = [(None, "near Alphaville"), (None, "in Betatown"), (1, "Alphaville, Betatown"), (1, "nowhere"), (2, None)]
    texts = spark.createDataFrame(rows, "id int, body string")
    names = spark.createDataFrame([(1, "Betatown"), (1, "Alphaville"), (2, None)], "priority int, name string")
    found = [
        sorted(first_match_join(texts, "body", names, "place", inline=inline).collect(), key=str)
        for inline in (10, 0)
    ]
    assert found[0] == found[1]
    assert {r["body"]: r["place"] for r in found[0]} == {
        "near Alphaville": "Alphaville", "in Betatown": "Betatown", "Alphaville, Betatown": "Alphaville",
        "nowhere": None, None: None,
    }


def test_large_dictionaries_do_not_stop(spark):
    names = [f"place{i:05d}" for i in range(2_500)]
    df = spark.createDataFrame([("at place02400 now", "place02400")], "body string, name string")
    found = df.select(
        first_match(F.col("body"), names).alias("a"),
        first_match_in_text(F.col("body"), names).alias("b"),
        replace_exact(F.col("name"), {n: n.upper() for n in names}).alias("c"),
    ).first()
    assert tuple(found) == ("place02400", "place02400", "PLACE02400")


def test_a_snapshot_appears_at_once(spark, tmp_path):
    root, day = str(tmp_path / "days"), "2024-01-02"
    with pytest.raises(FileNotFoundError):
        latest_snapshot(spark, root)
    write_snapshot(spark.range(3), root, "2024-01-01")
    write_snapshot(spark.range(5), root, day)
    reader = latest_snapshot(spark, root)
    broken = spark.range(7).select(F.when(F.col("id") < 6, F.col("id")).otherwise(F.raise_error(F.lit("broken"))).alias("id"))
    with pytest.raises(Exception, match="broken"):
        write_snapshot(broken, root, day)
    with pytest.raises(Exception, match="broken"):
        write_snapshot(broken, root, "2024-01-03")
    assert snapshot_days(spark, root) == ["2024-01-01", day]
    assert latest_snapshot(spark, root).count() == 5
    write_snapshot(spark.range(7), root, day)
    assert reader.count() == 5 and latest_snapshot(spark, root).count() == 7
    for n in (8, 9):
        write_snapshot(spark.range(n), root, day)
    assert len(list((tmp_path / "days" / "_days" / day).glob("0*"))) == 2
    assert latest_snapshot(spark, root).count() == 9 and all_snapshots(spark, root).count() == 12

