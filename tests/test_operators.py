import datetime as dt
import math
import random
import statistics
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from parcelflow.operators import stats
from parcelflow.operators.dedup import dedup_latest
from parcelflow.operators.joins import apply_corrections, hot_keys, lookup_join
from parcelflow.operators.quality import outlier_fences
from parcelflow.operators.resolve import first_match_join
from parcelflow.operators.selection import group_quantiles, order_statistics, summarise
from parcelflow.operators.spatial import CELL_EDGES, active_regions, points_in_regions, region_cells
from parcelflow.functions.lookup import first_match
from parcelflow.functions.text import fold_literal
from parcelflow.session import row_bytes


def skewed(spark, n=4000, seed=1):
    """Rows of which a third share one key, another third one value."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", None])
        value = 7.5 if i % 3 == 1 else rng.choice([rng.uniform(-1, 1), rng.lognormvariate(3, 4), -rng.lognormvariate(2, 3)])
        rows.append((i, key, value if rng.random() > 0.05 else None))
    return spark.createDataFrame(rows, "id int, k string, v double")


@pytest.mark.parametrize("cell_rows", [2_000_000, 5])
def test_order_statistics_are_exact(spark, cell_rows):
    df = skewed(spark)
    groups = {}
    for row in df.filter("v is not null").collect():
        groups.setdefault(row["k"], []).append(row["v"])
    ranks = {"first": lambda n: F.lit(0), "mid": lambda n: F.floor(n / 2), "behind": lambda n: n + 5}
    found = order_statistics(df, ["k"], {"v": F.col("v")}, ranks, cell_rows=cell_rows).collect()
    got = {(r["g"]["k"], r["rank"]): (r["total"], r["value"]) for r in found}
    for key, values in groups.items():
        values.sort()
        n = len(values)
        assert got[key, "first"] == (n, values[0])
        assert got[key, "mid"] == (n, values[n // 2])
        assert got[key, "behind"] == (n, values[-1])
    assert len(got) == 3 * len(groups)


def test_order_statistics_of_integers_beyond_double(spark):
    base = 2**60
    df = spark.range(1000).select((F.col("id") + base).alias("v"))
    found = order_statistics(df, [], {"v": F.col("v")}, {"m": lambda n: F.lit(500)}, cell_rows=10)
    assert found.first()["value"] == base + 500


def test_quantile_strategies_agree(spark):
    df = skewed(spark).filter("k is not null")
    probs = {"q1": 0.25, "m": 0.5, "p9": 0.9}
    small = group_quantiles(df, ["k"], ["v", "id"], probs, strategy="builtin")
    cells = group_quantiles(df, ["k"], ["v", "id"], probs, strategy="cells")
    assert sorted(small.collect()) == sorted(cells.select(small.columns).collect())


def test_nearest_differs_from_linear(spark):
    df = spark.range(1, 11).select(F.col("id").cast("double").alias("v"))
    assert group_quantiles(df, [], ["v"], {"q": 0.25}, "nearest").first()[0] == 3.0
    assert group_quantiles(df, [], ["v"], {"q": 0.25}).first()[0] == 3.25
    fences = outlier_fences(df, "v").first()
    assert (fences["q1"], fences["q3"], fences["lower"], fences["upper"]) == (3.0, 8.0, -4.5, 15.5)


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (3.0,)], "v double")
    assert group_quantiles(df, [], ["v"], {"m": 0.5}, strategy="cells").first()[0] == 2.0
    assert group_quantiles(df, [], ["v"], {"m": 0.5}, strategy="builtin").first()[0] == 2.0


def test_summaries_keep_null_keys_apart(spark):
    df = skewed(spark)
    args = (["k"], {"n": F.count("v")}, {"m": "v"})
    direct, cells = summarise(df, *args, strategy="builtin"), summarise(df, *args, strategy="cells")
    assert sorted(map(str, direct.collect())) == sorted(map(str, cells.collect()))
    assert direct.count() == 5


@pytest.mark.parametrize("how", ["left", "inner"])
@pytest.mark.parametrize("max_bytes", [10_000, 1])
def test_lookup_join_is_the_plain_join(spark, how, max_bytes):
    df = skewed(spark).withColumn("m", F.create_map("k", "v"))
    side = spark.range(4).select(
        F.element_at(F.array(*map(F.lit, ["hot", "a", "b", "b"])), F.col("id").cast("int") + 1).alias("k"),
        F.col("id").alias("w"),
    )
    df = df.drop("m") if how == "inner" else df.withColumn("m", F.when(F.col("k").isNotNull(), F.lit("x")))
    wanted = df.join(side, "k", how)
    got = lookup_join(df, side, "k", how, max_bytes=max_bytes, parts=5)
    assert sorted(map(str, got.select(wanted.columns).collect())) == sorted(map(str, wanted.collect()))
    by_struct = lookup_join(
        df.withColumn("k", F.struct("k")), side.withColumn("k", F.struct("k")), "k", how, max_bytes, parts=5
    ).withColumn("k", F.col("k.k"))
    assert sorted(map(str, by_struct.select(wanted.columns).collect())) == sorted(map(str, wanted.collect()))


def test_hot_keys(spark):
    assert [key for key, _ in hot_keys(skewed(spark), "k", 3)] == ["hot"]
    copies = dict(hot_keys(skewed(spark), "k", 30))
    assert copies["hot"] == 11 and all(3 <= copies[k] <= 7 for k in "abc")
    assert hot_keys(skewed(spark).limit(0), "k", 3) == []


def test_a_salted_join_reads_the_left_side_twice_and_splits_hot_keys(spark):
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(len(batch))
            yield batch

    n = 4000
    left = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    left = left.mapInPandas(counted, "id long, k long")
    right = spark.range(n).select(F.col("id").alias("k"), F.lit("w").alias("w"))
    joined = lookup_join(left, right, "k", max_bytes=1, parts=8)
    plan = joined._jdf.queryExecution().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    parts = joined.withColumn("task", F.spark_partition_id()).filter("k = 0").groupBy("task").count().collect()
    assert sum(p["count"] for p in parts) == len(range(0, n, 3)) and read.value == 2 * n


def test_a_side_is_broadcast_by_its_bytes(spark):
    wide = spark.range(200_000).select("id", F.repeat(F.lit("x"), 10_000).alias("text"))
    plan = lookup_join(spark.range(10), wide, "id")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan or "ShuffledHashJoin" in plan
    narrow = lookup_join(spark.range(10), wide.select("id"), "id")._jdf.queryExecution().toString()
    assert "BroadcastHashJoin" in narrow
    nested = spark.sql("SELECT array(struct('ab' AS x, 1 AS y), null) AS a, map('k', 'vv') AS m, 2.0D AS d")
    size = nested.select(row_bytes(nested.schema, F.struct("*"))).first()[0]
    assert 50 < size < 150


def test_corrections_do_not_multiply_rows(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), (None, 3.0)], "ID string, v double")
    fixes = spark.createDataFrame([("a", 9.0), ("a", 8.0), ("b", None)], "ID string, c double")
    got = apply_corrections(df, fixes, "ID", "v", "c")
    assert sorted(map(tuple, got.collect()), key=str) == [("a", 9.0), ("b", 2.0), (None, 3.0)]


def test_dedup_prefers_the_latest(spark):
    rows = [("a", "2024-01-01", 1), ("a", "2024-02-01", 0), ("a", None, 9), ("b", None, 3), ("b", None, 4)]
    df = spark.createDataFrame(rows, "ID string, d string, v int")
    assert sorted(map(tuple, dedup_latest(df, ["ID"], ["d"]).collect())) == [("a", "2024-02-01", 0), ("b", None, 4)]


def test_dedup_without_sorted_aggregates(spark):
    day = dt.date(2024, 1, 1)
    rows = []
    rng = random.Random(41)
    for _ in range(600):
        dates = [None if rng.random() < 0.2 else day + dt.timedelta(rng.randrange(3)) for _ in range(2)]
        rows.append((rng.choice(["a", "b", None]), rng.choice([1, None]), *dates, rng.choice(["x", None, "y"]), rng.random()))
    df = spark.createDataFrame(rows, "k string, l int, d date, e date, t string, v double")
    for recency in (["d", "e"], ["d"], ["v"], ["t", "d"]):
        rest = [c for c in df.columns if c not in ("k", "l", *recency)]
        order = [F.desc(c) for c in (*recency, *rest)]
        place = F.row_number().over(Window.partitionBy("k", "l").orderBy(*order))
        wanted = df.withColumn("p", place).filter("p = 1").drop("p")
        found = dedup_latest(df, ["k", "l"], recency)
        assert sorted(map(str, found.collect())) == sorted(map(str, wanted.collect()))
        if recency != ["t", "d"]:
            assert "SortAggregate" not in found._jdf.queryExecution().toString()


def test_dictionary_join_equals_the_expression(spark):
    names = ["STARE KRAJEWO", "KRAJEWO", "WYK", "ŁO", "Ł", "ZAMBRÓW", "GÓRKI-SYPNIEWO"]
    texts = ["w Krajewie stare krajewo", "WYKROT", "Lomza", "al", "górki-sypniewo", "", "nic", None, "xzambrowy"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    dictionary = spark.createDataFrame(list(enumerate(names)), "priority int, name string")
    wanted = df.withColumn("hit", first_match(F.col("t"), names))
    for inline in (0, 100):
        got = first_match_join(df, "t", dictionary, "hit", inline=inline)
        assert sorted(map(str, got.collect())) == sorted(map(str, wanted.collect()))


def test_a_dictionary_of_100000_names_with_short_ones(spark):
    rng = random.Random(31)
    letters = "ABCDEFGHIJ-K"
    names = {"".join(rng.choices(letters, k=rng.choice([2, 3, 4, 5, 7, 8, 9, 14]))) for _ in range(130_000)}
    names = sorted(names | {"ŻÓŁW", "AB CD"})
    rng.shuffle(names)
    assert len(names) > 90_000
    texts = ["".join(rng.choices(letters + "xyz ", k=rng.choice([0, 1, 2, 9, 40, 200]))) for _ in range(60)]
    texts += [*texts[:5], "zolw", None, f"zz{max(names, key=len)}zz"]
    dictionary = spark.createDataFrame(pd.DataFrame({"priority": range(len(names)), "name": names}))
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    for mode in ("first_match", "longest_match"):
        for spaces in (False, True):
            got = first_match_join(df, "t", dictionary, "hit", mode, spaces, inline=0)
            plan = got._jdf.queryExecution().toString()
            assert "Cartesian" not in plan and "NestedLoop" not in plan
            probes = [(fold_literal(n).replace("-", " ") if spaces else fold_literal(n), n) for n in names]
            for row in got.collect():
                body = fold_literal(row["t"]) if row["t"] is not None else ""
                hits = [n for probe, n in probes if probe in body]
                wanted = hits and (hits[0] if mode == "first_match" else max(hits, key=len))
                assert row["hit"] == (wanted or None)


RING = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4), (0, 0)]


def regions(spark, *rings):
    rows = [(i, f"r{i}", [(float(a), float(b)) for a, b in ring]) for i, ring in enumerate(rings)]
    return spark.createDataFrame(rows, "region_id bigint, name string, ring array<struct<lon:double,lat:double>>")


def test_points_in_a_concave_ring(spark):
    points = {
        "inside": (1.0, 1.0), "notch": (2.0, 2.0), "outside": (5.0, 1.0), "arm": (3.8, 3.0), "vertex height": (0.5, 1.0),
        "border": (2.0, 0.0), "corner": (4.0, 4.0), "left border": (0.0, 2.0), "tip height": (1.0, 4.0), "both": (0.6, 0.5),
    }
    df = spark.createDataFrame([(n, x, y) for n, (x, y) in points.items()] + [("null", None, 1.0)], "n string, LON double, LAT double")
    small = [(0.5, 0.4), (0.8, 0.4), (0.8, 0.7), (0.5, 0.7), (0.5, 0.4)]
    shapes = regions(spark, RING, small)
    found = points_in_regions(df, shapes, degrees=0.5)
    assert sorted((r["n"], r["region_id"]) for r in found.collect()) == [
        ("arm", 0), ("both", 0), ("both", 1), ("inside", 0), ("vertex height", 0),
    ]
    plan = found._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    by_shuffle = points_in_regions(df, shapes, degrees=0.5, max_bytes=1, cell_edges=3)
    assert sorted(by_shuffle.collect()) == sorted(found.collect())
    far = regions(spark, RING, [(9, 9), (10, 9), (10, 10), (9, 9)])
    assert [r["name"] for r in active_regions(far, points_in_regions(df, far)).collect()] == ["r0"]


def plain_inside(rings, x, y):
    """Exact even-odd rule; None on the border."""
    x, y, odd = Fraction(x), Fraction(y), False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:]):
            ax, ay, bx, by = map(Fraction, (ax, ay, bx, by))
            inside_box = min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by)
            if inside_box and (bx - ax) * (y - ay) == (by - ay) * (x - ax):
                return None
            odd ^= (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
    return odd


def star(rng, x, y, corners, size, step):
    """A ring around (x, y), its corners on a lattice, some of them on lines of the grid."""
    angles = sorted(rng.random() * 2 * math.pi for _ in range(corners))
    ring = []
    for a in angles:
        r = size * rng.uniform(0.3, 1)
        ring.append((round((x + r * math.cos(a)) / step) * step, round((y + r * math.sin(a)) / step) * step))
    return [*ring, ring[0]]


def test_regions_of_parts_and_holes_against_the_exact_rule(spark):
    rng = random.Random(21)
    square = [(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0), (0.0, 0.0)]
    hole = [(2.0, 2.0), (6.0, 2.0), (6.0, 6.0), (2.0, 6.0), (2.0, 2.0)]
    enclave = [(3.0, 3.0), (5.0, 3.0), (5.0, 5.0), (3.0, 5.0), (3.0, 3.0)]
    comb = [(9.0, 0.0)]
    for i in range(60):
        comb += [(9 + i / 16, 7.0), (9 + i / 16 + 1 / 32, 1.0)]
    comb += [(13.0, 0.0), (9.0, 0.0)]
    shapes = [
        [square, hole, enclave],
        [hole],
        [comb, star(rng, 18, 4, 7, 3, 0.25)],
        [star(rng, 4, 12, 400, 3, 1 / 64), star(rng, 4, 12, 9, 0.5, 0.125)],
        [star(rng, -3, 3, 12, 4, 0.5), [(0.0, 0.0), (1.0, 1.0), (0.0, 0.0)], [(None, 0.0)] * 5],
        [],
        [star(rng, 10, 10, 30, 9, 1.0)],
        [[(1.0, 1.0), (1.0, 1.125), (1.125, 1.125), (1.125, 1.0), (1.0, 1.0)]],
    ]
    kind = "region_id bigint, name string, rings array<array<struct<lon:double,lat:double>>>"
    regions = spark.createDataFrame([(i, f"r{i}", rings) for i, rings in enumerate(shapes)], kind)
    points = [(rng.randrange(-64, 160) / 8, rng.randrange(-16, 160) / 8) for _ in range(700)]
    points += [(rng.uniform(-8, 22), rng.uniform(-2, 20)) for _ in range(1500)]
    points += [(4 + rng.uniform(-3, 3), 12 + rng.uniform(-3, 3)) for _ in range(800)]
    points += [(1.0625, 1.0625), (1.0625, 1.125)]
    points += [corner for rings in shapes for ring in rings[:2] for corner in ring[:40]]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, LON double, LAT double")
    sound = [[r for r in rings if len(r) >= 4 and r[0][0] is not None] for rings in shapes]
    expected = {
        (i, k)
        for i, (x, y) in enumerate(points)
        if x is not None
        for k, rings in enumerate(sound)
        if plain_inside(rings, x, y)
    }
    assert len({k for _, k in expected}) == 7
    for cell_edges in (4, 1000):
        found = points_in_regions(df, regions, degrees=0.5, cell_edges=cell_edges).collect()
        assert sorted((r["i"], r["region_id"]) for r in found) == sorted(expected)


def test_a_region_of_many_corners_is_split_into_small_cells(spark):
    n = 60_000
    turns = F.col("id") / n * 2 * math.pi
    radius = 0.1 + (F.col("id") % 2) * 1e-5
    corner = F.struct((radius * F.cos(turns)).alias("lon"), (radius * F.sin(turns)).alias("lat"))
    ring = spark.range(n).agg(F.sort_array(F.collect_list(F.struct("id", corner.alias("at"))))["at"].alias("ring"))
    region = ring.select(
        F.lit(1).cast("long").alias("region_id"),
        F.lit("round").alias("name"),
        F.concat("ring", F.slice("ring", 1, 1)).alias("ring"),
    )
    index = region_cells(region).cache()
    assert index.agg(F.max(F.size("pieces"))).first()[0] <= CELL_EDGES
    assert index.count() < n
    df = spark.createDataFrame([(0.0, 0.0), (0.0999, 0.0), (0.0, 0.1001), (0.08, 0.07)], "LON double, LAT double")
    assert sorted(points_in_regions(df, region).collect())[0][:2] == (0.0, 0.0)
    assert points_in_regions(df, region).count() == 2


def test_density_is_within_its_bound(spark):
    rng = np.random.default_rng(5)
    values = np.concatenate([rng.normal(size=3000), rng.normal(9, 0.01, 500), [60.0, 60.0, -20.0]])
    df = spark.createDataFrame(pd.DataFrame({"v": values}))
    found = stats.kernel_density(df, "v", points=150).orderBy("point").collect()
    h = values.std(ddof=1) * len(values) ** -0.2
    at = np.linspace(values.min(), values.max(), 150)
    z = (at[:, None] - values[None, :]) / h
    exact = np.exp(-0.5 * z * z).sum(axis=1) / (len(values) * h * math.sqrt(2 * math.pi))
    assert np.allclose([r["x"] for r in found], at, rtol=0, atol=1e-9)
    assert np.abs(np.array([r["density"] for r in found]) - exact).max() <= stats.DENSITY_ERROR / h
    assert stats.kernel_density(df.filter("v > 50"), "v").count() == 0
    assert stats.kernel_density(df.limit(0), "v").count() == 0


def test_histogram_edges(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (5.0,), (10.0,), (None,)], "v double")
    bins = stats.histogram(df, "v", 10).orderBy("bin").collect()
    assert [b["n"] for b in bins] == [1, 1, 0, 0, 0, 1, 0, 0, 0, 1]
    assert bins[0]["left_edge"] == 0.0 and bins[-1]["right_edge"] == pytest.approx(10.0)
    constant = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert sum(b["n"] for b in stats.histogram(constant, "v", 4).collect()) == 2


def test_density_integrates_to_one(spark):
    values = np.random.default_rng(0).normal(size=800).round(2).tolist()
    curve = stats.kernel_density(spark.createDataFrame([(v,) for v in values], "v double"), "v").orderBy("point").collect()
    x, y = [c["x"] for c in curve], [c["density"] for c in curve]
    assert len(curve) == 200
    assert np.trapezoid(y, x) == pytest.approx(1.0, abs=0.02)
    h = np.std(values, ddof=1) * len(values) ** -0.2
    direct = np.mean(np.exp(-0.5 * ((x[50] - np.array(values)) / h) ** 2)) / (h * np.sqrt(2 * np.pi))
    assert y[50] == pytest.approx(direct)


def test_box_plot(spark):
    values = [1.0, 2.0, 3.0, 4.0, 100.0]
    df = spark.createDataFrame([("a", v) for v in values] + [(None, 1.0), ("a", None)], "k string, v double")
    box = stats.boxplot_stats(df, "k", "v").collect()
    assert [tuple(b) for b in box] == [("a", 5, 2.0, 3.0, 4.0, 1.0, 4.0, 1)]


def test_counts_follow_the_given_order(spark):
    from parcelflow.sources.dimensions import ordered_categories

    df = spark.createDataFrame([("b",), ("b",), ("c",), (None,), ("zz",)], "k string")
    got = stats.ordered_counts(df, "k", ordered_categories(spark, ["c", "a", "b"], "k"))
    assert [(r["k"], r["n"]) for r in got.collect()] == [("c", 1), ("a", None), ("b", 2)]
    assert [tuple(r) for r in stats.value_counts(df, "k").collect()] == [("b", 2), ("c", 1), ("zz", 1)]


def test_median_matches_python(spark):
    df = skewed(spark).filter("k = 'a' and v is not null")
    got = group_quantiles(df, [], ["v"], {"m": 0.5}, strategy="cells").first()[0]
    assert got == pytest.approx(statistics.median(r["v"] for r in df.collect()))


def test_ids_of_days(spark):
    from parcelflow.plans.market import explode_days

    d = dt.date(2024, 1, 1)
    df = spark.createDataFrame([(1, d, d + dt.timedelta(2)), (2, d, None), (3, d + dt.timedelta(1), d)], "ID int, DATE_ADDED date, LAST_UPDATED date")
    days = explode_days(df).groupBy("ID").agg(F.count("ACTIVE_DAY")).orderBy("ID").collect()
    assert [tuple(r) for r in days] == [(1, 3), (2, 0), (3, 0)]
