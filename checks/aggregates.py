"""Counts, group statistics, chart data, price labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import check, rnd, rounded, table
from parcelflow.functions.dates import weekday_label
from parcelflow.functions.numeric import bin_label, ratio
from parcelflow.operators import stats
from parcelflow.operators.pricing import price_attractiveness
from parcelflow.profiles import lomza
from parcelflow.sources.dimensions import ordered_categories

SEGMENT_SQL = """CASE WHEN AREA_M2 IS NULL THEN NULL WHEN AREA_M2 <= 700 THEN 'Tiny/Sub-standard'
    WHEN AREA_M2 <= 1000 THEN 'Small Plot' WHEN AREA_M2 <= 1500 THEN 'Medium Plot'
    WHEN AREA_M2 <= 5000 THEN 'Large Plot' WHEN AREA_M2 <= 10000 THEN 'Investment/Small Farm'
    ELSE 'Hectares/Agriculture' END"""

# Line items as listings: area from quantity, segment from area, price per m2 from both.
LISTED_SQL = f"""
    listed AS (
      SELECT *, {SEGMENT_SQL} AS SIZE_SEGMENT, PRICE / nullif(AREA_M2, 0) AS PRICE_M2
      FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
                   CASE WHEN l_linenumber = 7 THEN NULL
                        WHEN l_returnflag = 'A' THEN l_quantity * 40 ELSE l_quantity * 220 END AS AREA_M2,
                   CASE WHEN l_tax = 0 THEN NULL ELSE l_extendedprice END AS PRICE
            FROM lineitem))"""


def listed(spark, folder, *more):
    area = F.when(
        F.col("l_linenumber") != 7,
        F.when(F.col("l_returnflag") == "A", F.col("l_quantity") * 40).otherwise(F.col("l_quantity") * 220),
    )
    return (
        table(spark, folder, "lineitem")
        .select(
            "l_orderkey",
            "l_linenumber",
            "l_partkey",
            "l_suppkey",
            *more,
            area.alias("AREA_M2"),
            F.when(F.col("l_tax") != 0, F.col("l_extendedprice")).alias("PRICE"),
        )
        .withColumns(
            {
                "SIZE_SEGMENT": bin_label(F.col("AREA_M2"), lomza.SIZE_BREAKS, lomza.SIZE_LABELS),
                "PRICE_M2": ratio(F.col("PRICE"), F.col("AREA_M2")),
            }
        )
    )


# The last category has no rows.
CATEGORIES = [*lomza.WEEKDAYS, "Bez dnia"]
_DAYS = ", ".join(f"({i + 1}, '{name}')" for i, name in enumerate(CATEGORIES))


@check(
    "weekday_counts",
    f"""
    WITH d(ordinal, name) AS (VALUES {_DAYS}),
    c AS (SELECT isodow(CAST(o_orderdate AS DATE)) AS dow, count(*) AS n FROM orders
          GROUP BY 1)
    SELECT name AS DAY_NAME_PL, CAST(ordinal - 1 AS INTEGER) AS ordinal, n FROM d LEFT JOIN c ON dow = ordinal""",
)
def weekday_counts(spark, folder):
    named = table(spark, folder, "orders").select(
        weekday_label(F.to_date("o_orderdate"), lomza.WEEKDAYS).alias("DAY_NAME_PL")
    )
    weekdays = ordered_categories(spark, CATEGORIES, "DAY_NAME_PL")
    return stats.ordered_counts(named, "DAY_NAME_PL", weekdays)


@check(
    "top_cities",
    """
    SELECT CITY, count(*) AS n FROM (
      SELECT CASE WHEN c_nationkey = 5 THEN NULL ELSE 'NATION_' || c_nationkey END AS CITY FROM customer)
    WHERE CITY IS NOT NULL GROUP BY CITY ORDER BY n DESC, CITY LIMIT 20""",
)
def top_cities(spark, folder):
    key = F.col("c_nationkey")
    cities = table(spark, folder, "customer").select(
        F.when(key != 5, F.concat(F.lit("NATION_"), key)).alias("CITY")
    )
    return stats.top_values(cities, "CITY", 20)


@check(
    "value_counts",
    "SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY event_type",
)
def value_counts(spark, folder):
    return stats.value_counts(table(spark, folder, "events"), "event_type")


GROUP_SQL = f"""WITH {LISTED_SQL}
    SELECT SIZE_SEGMENT, {rnd('avg(PRICE)', 4)} AS PRICE_mean, {rnd('median(PRICE)', 4)} AS PRICE_median,
           count(PRICE) AS PRICE_count, {rnd('avg(PRICE_M2)', 4)} AS PRICE_M2_mean,
           {rnd('median(PRICE_M2)', 4)} AS PRICE_M2_median, count(PRICE_M2) AS PRICE_M2_count
    FROM listed WHERE SIZE_SEGMENT IS NOT NULL GROUP BY SIZE_SEGMENT"""


def _segment_stats(spark, folder, strategy):
    table_ = stats.group_stats(
        listed(spark, folder),
        ["SIZE_SEGMENT"],
        ["PRICE", "PRICE_M2"],
        ["mean", "median", "count"],
        strategy=strategy,
    )
    return rounded(table_, 4, "PRICE_mean", "PRICE_median", "PRICE_M2_mean", "PRICE_M2_median").orderBy(
        F.desc("PRICE_count"), "SIZE_SEGMENT"
    )


@check("segment_price_stats", GROUP_SQL)
def segment_price_stats(spark, folder):
    return _segment_stats(spark, folder, "auto")


@check("segment_price_stats_cells", GROUP_SQL)
def segment_price_stats_cells(spark, folder):
    return _segment_stats(spark, folder, "cells")


@check(
    "boxplot_stats",
    f"""
    WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, median(l_extendedprice) AS m,
                      quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1),
    j AS (SELECT l.l_returnflag, q1, m, q3, l_extendedprice AS x,
                 l_extendedprice BETWEEN q1 - 0.2 * (q3 - q1) AND q3 + 0.2 * (q3 - q1) AS inside
          FROM lineitem l JOIN q USING (l_returnflag))
    SELECT l_returnflag, count(*) AS n, {rnd('max(q1)', 6)} AS q1, {rnd('max(m)', 6)} AS median, {rnd('max(q3)', 6)} AS q3,
           min(x) FILTER (inside) AS whisker_low, max(x) FILTER (inside) AS whisker_high,
           count(*) FILTER (NOT inside) AS fliers
    FROM j GROUP BY 1""",
)
def boxplot_stats(spark, folder):
    lines = table(spark, folder, "lineitem")
    boxes = stats.boxplot_stats(lines, "l_returnflag", "l_extendedprice", whisker=0.2, strategy="cells")
    return rounded(boxes, 6, "q1", "median", "q3")


@check(
    "boxplot_stats_default",
    f"""
    WITH v AS (SELECT l_returnflag, l_quantity * l_quantity * l_quantity * l_quantity * l_quantity AS x FROM lineitem),
    q AS (SELECT l_returnflag, quantile_cont(x, 0.25) AS q1, median(x) AS m, quantile_cont(x, 0.75) AS q3 FROM v GROUP BY 1),
    j AS (SELECT l_returnflag, q1, m, q3, x, x BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
          FROM v JOIN q USING (l_returnflag))
    SELECT l_returnflag, count(*) AS n, {rnd('max(q1)', 6)} AS q1, {rnd('max(m)', 6)} AS median, {rnd('max(q3)', 6)} AS q3,
           min(x) FILTER (inside) AS whisker_low, max(x) FILTER (inside) AS whisker_high,
           count(*) FILTER (NOT inside) AS fliers
    FROM j GROUP BY 1""",
)
def boxplot_stats_default(spark, folder):
    """A long tail and the default whiskers."""
    quantity = F.col("l_quantity")
    lines = table(spark, folder, "lineitem").select(
        "l_returnflag", (quantity * quantity * quantity * quantity * quantity).alias("x")
    )
    return rounded(stats.boxplot_stats(lines, "l_returnflag", "x"), 6, "q1", "median", "q3")


@check(
    "histogram",
    f"""
    WITH r AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
    c AS (SELECT CAST(least(floor((value - lo) / ((hi - lo) / 500.0::DOUBLE)), 499) AS INTEGER) AS bin, count(*) AS n
          FROM events, r GROUP BY 1)
    SELECT CAST(i AS INTEGER) AS bin, {rnd('lo + i * ((hi - lo) / 500.0::DOUBLE)', 6)} AS left_edge,
           {rnd('lo + (i + 1) * ((hi - lo) / 500.0::DOUBLE)', 6)} AS right_edge, coalesce(n, 0) AS n
    FROM r, range(500) AS g(i) LEFT JOIN c ON c.bin = i""",
)
def histogram(spark, folder):
    bins = stats.histogram(table(spark, folder, "events"), "value", 500)
    return rounded(bins, 6, "left_edge", "right_edge")


@check(
    "kde",
    f"""
    WITH s AS (SELECT CAST(count(value) AS DOUBLE) AS n, min(value) AS lo, max(value) AS hi,
                      stddev_samp(value) * power(count(value), -0.2) AS h FROM events),
    v AS (SELECT value AS x, count(*) AS w FROM events GROUP BY value),
    g AS (SELECT i, lo + i * ((hi - lo) / 199.0::DOUBLE) AS pos, n, h FROM s, range(200) AS r(i))
    SELECT CAST(i AS INTEGER) AS point, {rnd('any_value(pos)', 6)} AS x,
           {rnd('sum(w / (n * h * sqrt(2 * pi())) * exp(-0.5 * ((pos - x) / h) * ((pos - x) / h)))', 8)} AS density
    FROM g, v GROUP BY i""",
)
def kde(spark, folder):
    curve = stats.kernel_density(table(spark, folder, "events"), "value")
    return rounded(rounded(curve, 6, "x"), 8, "density")


@check(
    "melt",
    f"""WITH {LISTED_SQL},
    s AS (SELECT SIZE_SEGMENT, {rnd('avg(PRICE)', 2)} AS PRICE_mean, CAST(count(PRICE) AS DOUBLE) AS PRICE_count
          FROM listed WHERE SIZE_SEGMENT IS NOT NULL GROUP BY 1)
    SELECT SIZE_SEGMENT, 'PRICE_mean' AS metric, PRICE_mean AS value FROM s
    UNION ALL SELECT SIZE_SEGMENT, 'PRICE_count', PRICE_count FROM s""",
)
def melt(spark, folder):
    wide = stats.group_stats(listed(spark, folder), ["SIZE_SEGMENT"], ["PRICE"], ["mean", "count"]).select(
        "SIZE_SEGMENT", F.round("PRICE_mean", 2).alias("PRICE_mean"), F.col("PRICE_count").cast("double").alias("PRICE_count")
    )
    return stats.melt(wide, ["SIZE_SEGMENT"], ["PRICE_mean", "PRICE_count"], "metric", "value")


@check(
    "column_summary",
    """
    SELECT least(min(l_extendedprice), min(l_quantity)) AS smallest, greatest(max(l_extendedprice), max(l_quantity)) AS largest,
           max(l_extendedprice) AS max_l_extendedprice, max(l_quantity) AS max_l_quantity
    FROM lineitem""",
)
def column_summary(spark, folder):
    return stats.column_summary(table(spark, folder, "lineitem"), ["l_extendedprice", "l_quantity"])


@check("distinct_values", "SELECT DISTINCT l_returnflag FROM lineitem")
def distinct_values(spark, folder):
    return stats.distinct_values(table(spark, folder, "lineitem"), "l_returnflag")


LABEL_SQL = """
    m AS (SELECT SIZE_SEGMENT, median(PRICE_M2) AS med FROM listed WHERE SIZE_SEGMENT IS NOT NULL GROUP BY 1),
    labelled AS (
      SELECT l.*, CASE WHEN PRICE_M2 / med < 0.85 THEN 'Underpriced' WHEN PRICE_M2 / med <= 1.15 THEN 'Market Price'
                       WHEN PRICE_M2 / med > 1.15 THEN 'Overpriced' ELSE 'Unknown' END AS PRICE_ATTRACTIVENESS
      FROM listed l LEFT JOIN m USING (SIZE_SEGMENT))"""


@check(
    "price_attractiveness",
    f"""WITH {LISTED_SQL}, {LABEL_SQL}
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, SIZE_SEGMENT, PRICE_M2, PRICE_ATTRACTIVENESS
    FROM labelled""",
)
def attractiveness(spark, folder):
    return price_attractiveness(listed(spark, folder)).drop("AREA_M2", "PRICE")


@check(
    "price_attractiveness_cells",
    f"""WITH {LISTED_SQL}, {LABEL_SQL}
    SELECT SIZE_SEGMENT, PRICE_ATTRACTIVENESS, count(*) AS n FROM labelled GROUP BY 1, 2""",
)
def attractiveness_cells(spark, folder):
    labelled = price_attractiveness(listed(spark, folder), strategy="cells")
    return labelled.groupBy("SIZE_SEGMENT", "PRICE_ATTRACTIVENESS").agg(F.count(F.lit(1)).alias("n"))


@check(
    "head_limit",
    """
    SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10""",
)
def head_limit(spark, folder):
    return (
        table(spark, folder, "orders")
        .select("o_orderkey", "o_totalprice")
        .orderBy(F.desc("o_totalprice"), "o_orderkey")
        .limit(10)
    )
