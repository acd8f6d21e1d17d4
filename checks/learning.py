"""Splits, encoding, metrics and models."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from checks.aggregates import LABEL_SQL, LISTED_SQL, listed
from checks.registry import check, rnd, rounded, table
from parcelflow.learning.encode import (
    category_index,
    impute_median,
    indicators,
    sparse_indicators,
    standardise,
)
from parcelflow.learning.folds import learn_folds, shown
from parcelflow.learning.forest import Features, numeric_as_double
from parcelflow.learning.metrics import (
    classification_report,
    confusion_matrix,
    error_columns,
    error_summary,
    regression_metrics,
    trimmed_metrics,
)
from parcelflow.learning.search import grid_search
from parcelflow.learning.split import contiguous_folds, hashed_folds, random_split, shuffled, stratified_split
from parcelflow.plans.valuation import classify, labelled_listings, price_errors, price_model
from parcelflow.learning.trend import fit_robust_line
from parcelflow.operators.pricing import RATIO_LABELS, price_attractiveness
from parcelflow.functions.numeric import great_circle_km
from parcelflow.session import settle

MULTIPLIER, MODULUS = 2654435761, 4294967296


@check(
    "kfold_assign",
    "SELECT c_custkey, CAST(ntile(5) OVER (ORDER BY c_custkey) - 1 AS INTEGER) AS fold FROM customer",
)
def kfold_assign(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey")
    return contiguous_folds(customers, F.col("c_custkey"), 5)


@check(
    "stratified_split",
    f"""
    SELECT c_custkey, c_mktsegment,
           CASE WHEN row_number() OVER (PARTITION BY c_mktsegment ORDER BY (c_custkey * {MULTIPLIER}) % {MODULUS})
                     <= floor(round(0.8 * count(*) OVER (PARTITION BY c_mktsegment), 6)) THEN 'train' ELSE 'test' END AS split
    FROM customer""",
)
def stratified(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    order = F.col("c_custkey") * F.lit(MULTIPLIER) % F.lit(MODULUS)
    return stratified_split(customers, "c_mktsegment", order)


@check(
    "stratified_folds",
    """
    SELECT c_custkey, c_mktsegment,
           CAST(ntile(5) OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1 AS INTEGER) AS fold FROM customer""",
)
def stratified_folds(spark, folder):
    customers = table(spark, folder, "customer").select("c_custkey", "c_mktsegment")
    return contiguous_folds(customers, F.col("c_custkey"), 5, by="c_mktsegment")


# The order in which rows are split, of a key `k`.
SHUFFLED_SQL = "CAST('0x' || substr(md5('42:' || CAST(k AS VARCHAR)), 1, 15) AS BIGINT)"


@check(
    "random_split",
    f"""
    SELECT o_orderkey, CASE WHEN h % 1000000 >= 200000 THEN 'train' ELSE 'test' END AS split, CAST(h % 5 AS INTEGER) AS fold
    FROM (SELECT o_orderkey, {SHUFFLED_SQL.replace('k AS', 'o_orderkey AS')} AS h FROM orders)""",
)
def plain_split(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey")
    return hashed_folds(random_split(orders, "o_orderkey"), "o_orderkey")


@check(
    "one_hot",
    """
    WITH o AS (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS p, o_orderstatus AS s FROM orders)
    SELECT o_orderkey, coalesce(CAST(p = '2-HIGH' AS INTEGER), 0) AS "p_2-HIGH", coalesce(CAST(p = '3-MEDIUM' AS INTEGER), 0) AS "p_3-MEDIUM",
           coalesce(CAST(p = '4-NOT SPECIFIED' AS INTEGER), 0) AS "p_4-NOT SPECIFIED",
           CAST(s = 'O' AS INTEGER) AS "s_O", CAST(s = 'F' AS INTEGER) AS "s_F"
    FROM o""",
)
def one_hot(spark, folder):
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"),
        F.col("o_orderstatus").alias("s"),
    )
    return indicators(orders, {"p": None, "s": ["P", "O", "F"]})


@check(
    "one_hot_sparse",
    """
    WITH t AS (SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS c,
                      o_orderpriority AS p FROM orders),
    learned AS (SELECT * FROM t WHERE o_orderkey % 3 <> 0),
    c AS (SELECT c AS value, row_number() OVER (ORDER BY c) - 2 AS i FROM (SELECT DISTINCT c FROM learned WHERE c IS NOT NULL)),
    p AS (SELECT p AS value, row_number() OVER (ORDER BY p) - 2 AS i FROM (SELECT DISTINCT p FROM learned)),
    n AS (SELECT count(*) - 1 AS n FROM c)
    SELECT o_orderkey, n + (SELECT count(*) - 1 FROM p) AS size, i AS index FROM t JOIN c ON c.value = t.c, n WHERE i >= 0
    UNION ALL SELECT o_orderkey, n + (SELECT count(*) - 1 FROM p), n + i FROM t JOIN p ON p.value = t.p, n WHERE i >= 0""",
)
def one_hot_sparse(spark, folder):
    """A category for most customers; those of some orders are not learned."""
    orders = table(spark, folder, "orders").select(
        "o_orderkey",
        F.when(F.col("o_custkey") % 7 != 0, F.col("o_custkey").cast("string")).alias("c"),
        F.col("o_orderpriority").alias("p"),
    )
    learned = orders.filter(F.col("o_orderkey") % 3 != 0)
    made = sparse_indicators(orders, ["c", "p"], {c: category_index(learned, c) for c in ("c", "p")})
    return made.select(
        "o_orderkey",
        F.col("features.size").cast("long").alias("size"),
        F.explode("features.indices").alias("index"),
    )


@check(
    "impute_scale",
    f"""
    WITH t AS (SELECT c_custkey, CASE WHEN c_nationkey < 6 THEN NULL ELSE c_acctbal END AS a, CAST(c_nationkey AS DOUBLE) AS b FROM customer),
    m AS (SELECT c_custkey, coalesce(a, (SELECT median(a) FROM t)) AS a, b FROM t)
    SELECT c_custkey, {rnd('(a - (SELECT avg(a) FROM m)) / (SELECT stddev_pop(a) FROM m)', 6)} AS a,
           {rnd('(b - (SELECT avg(b) FROM m)) / (SELECT stddev_pop(b) FROM m)', 6)} AS b
    FROM m""",
)
def impute_scale(spark, folder):
    customers = table(spark, folder, "customer").select(
        "c_custkey",
        F.when(F.col("c_nationkey") >= 6, F.col("c_acctbal")).alias("a"),
        F.col("c_nationkey").cast("double").alias("b"),
    )
    return rounded(standardise(impute_median(customers, ["a", "b"]), ["a", "b"]), 6, "a", "b")


# A rule as classifier: never says "Overpriced" in one variant of the label.
GUESSED_SQL = f"""
    {LISTED_SQL}, {LABEL_SQL},
    guessed AS (
      SELECT PRICE_ATTRACTIVENESS AS truth,
             CASE WHEN l_suppkey % 3 = 0 THEN 'Market Price' WHEN PRICE < 40000 THEN 'Underpriced' ELSE 'Market Price' END AS guess
      FROM labelled WHERE PRICE_ATTRACTIVENESS <> 'Unknown')"""


def _guessed(spark, folder):
    labelled = price_attractiveness(listed(spark, folder)).filter(
        F.col("PRICE_ATTRACTIVENESS") != "Unknown"
    )
    guess = (
        F.when(F.col("l_suppkey") % 3 == 0, F.lit("Market Price"))
        .when(F.col("PRICE") < 40000, F.lit("Underpriced"))
        .otherwise(F.lit("Market Price"))
    )
    return labelled.select(F.col("PRICE_ATTRACTIVENESS").alias("truth"), guess.alias("guess"))


@check(
    "confusion_matrix",
    f"""WITH {GUESSED_SQL}
    SELECT truth, count(*) FILTER (guess = 'Underpriced') AS "Underpriced", count(*) FILTER (guess = 'Market Price') AS "Market Price",
           count(*) FILTER (guess = 'Overpriced') AS "Overpriced"
    FROM guessed GROUP BY truth""",
)
def confusion(spark, folder):
    return confusion_matrix(_guessed(spark, folder), "truth", "guess", list(RATIO_LABELS))


@check(
    "classification_report",
    f"""WITH {GUESSED_SQL},
    c AS (SELECT label, count(*) FILTER (truth = label AND guess = label) AS hits, count(*) FILTER (truth = label) AS support,
                 count(*) FILTER (guess = label) AS guessed
          FROM guessed, (SELECT DISTINCT truth AS label FROM guessed UNION SELECT DISTINCT guess FROM guessed) GROUP BY label),
    s AS (SELECT label, hits, coalesce(hits / nullif(guessed, 0), 0) AS p, coalesce(hits / nullif(support, 0), 0) AS r, support FROM c),
    f AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1 FROM s),
    o AS (SELECT label, p, r, f1, support FROM f
          UNION ALL SELECT 'accuracy', sum(hits) / sum(support), sum(hits) / sum(support), sum(hits) / sum(support), sum(support) FROM f
          UNION ALL SELECT 'macro avg', avg(p), avg(r), avg(f1), sum(support) FROM f
          UNION ALL SELECT 'weighted avg', sum(p * support) / sum(support), sum(r * support) / sum(support),
                           sum(f1 * support) / sum(support), sum(support) FROM f)
    SELECT label, {rnd('p', 8)} AS precision, {rnd('r', 8)} AS recall, {rnd('f1', 8)} AS f1, CAST(support AS BIGINT) AS support FROM o""",
)
def report(spark, folder):
    return rounded(
        classification_report(_guessed(spark, folder), "truth", "guess"), 8, "precision", "recall", "f1"
    )


PREDICTED_SQL = f"""{LISTED_SQL},
    predicted AS (SELECT SIZE_SEGMENT, PRICE AS y, CASE WHEN l_linenumber = 2 THEN NULL ELSE AREA_M2 * 9 + 20000 END AS p FROM listed)"""


def _predicted(spark, folder):
    guess = F.when(F.col("l_linenumber") != 2, F.col("AREA_M2") * 9 + 20000)
    return listed(spark, folder).select("SIZE_SEGMENT", F.col("PRICE").alias("y"), guess.alias("p"))


def _metrics_sql(source):
    return f"""SELECT count(*) AS n, {rnd('avg(abs(y - p))', 4)} AS mae,
           {rnd('1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))', 6)} AS r2
    FROM {source} WHERE y IS NOT NULL AND p IS NOT NULL"""


@check("regression_metrics", f"WITH {PREDICTED_SQL} {_metrics_sql('predicted')}")
def regression(spark, folder):
    return rounded(rounded(regression_metrics(_predicted(spark, folder), "y", "p"), 4, "mae"), 6, "r2")


@check(
    "trimmed_metrics",
    f"WITH {PREDICTED_SQL} {_metrics_sql('(SELECT * FROM predicted WHERE abs(y - p) / y < 0.6)')}",
)
def trimmed(spark, folder):
    return rounded(rounded(trimmed_metrics(_predicted(spark, folder), "y", "p"), 4, "mae"), 6, "r2")


def _summary_sql(key):
    group = "GROUP BY SIZE_SEGMENT" if key else ""
    return f"""WITH {PREDICTED_SQL}, e AS (SELECT SIZE_SEGMENT, (p - y) / nullif(y, 0) * 100 AS d FROM predicted
        {'WHERE SIZE_SEGMENT IS NOT NULL' if key else ''})
    SELECT {'SIZE_SEGMENT,' if key else ''} {rnd('avg(d)', 2)} AS "MPE_pct", {rnd('median(d)', 2)} AS "Median_Error_pct", count(d) AS "Offers_num"
    FROM e {group}"""


@check("error_summary", _summary_sql(True))
def errors_by_segment(spark, folder):
    return error_summary(error_columns(_predicted(spark, folder), "y", "p"), "SIZE_SEGMENT")


@check("error_summary_overall", _summary_sql(False))
def errors_overall(spark, folder):
    return error_summary(error_columns(_predicted(spark, folder), "y", "p"), strategy="cells")


def _trend_sql(rounds: int) -> str:
    """The same rounds of reweighting, each as two subqueries."""
    steps = ["pts AS (SELECT CAST(user_id AS DOUBLE) AS x, value + 0.3 * user_id AS y FROM events)"]
    sums = "sum(w) AS s, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * x * y) AS sxy"
    solve = "(s * sxy - sx * sy) / (s * sxx - sx * sx) AS slope, (sy - (s * sxy - sx * sy) / (s * sxx - sx * sx) * sx) / s AS icept"
    steps.append(f"l0 AS MATERIALIZED (SELECT {solve} FROM (SELECT {sums} FROM (SELECT *, 1.0::DOUBLE AS w FROM pts)))")
    for i in range(1, rounds + 1):
        steps.append(
            f"r{i} AS MATERIALIZED (SELECT x, y, abs(y - icept - slope * x) AS r FROM pts, l{i - 1}),"
            f" m{i} AS MATERIALIZED (SELECT median(r) / 0.6744897501960817 AS scale FROM r{i}),"
            f" l{i} AS MATERIALIZED (SELECT {solve} FROM (SELECT {sums} FROM (SELECT x, y,"
            f" CASE WHEN r <= 1.345 * scale THEN 1.0 ELSE 1.345 * scale / r END AS w FROM r{i}, m{i})))"
        )
    return (
        "WITH " + ", ".join(steps)
        + f" SELECT {rnd('icept', 5)} AS intercept, {rnd('slope', 7)} AS slope, {rnd('scale', 5)} AS scale, true AS converged FROM l{rounds}, m{rounds}"
    )


# More rounds than the line needs to stand still.
@check("robust_trend", _trend_sql(30))
def robust_trend(spark, folder):
    events = table(spark, folder, "events").select(
        F.col("user_id").alias("x"), (F.col("value") + 0.3 * F.col("user_id")).alias("y")
    )
    line = fit_robust_line(events, "x", "y")
    values = {
        "intercept": round(line.intercept, 5),
        "slope": round(line.slope, 7),
        "scale": round(line.scale, 5),
        "converged": line.converged,
    }
    return spark.createDataFrame(pa.Table.from_pylist([values]))


# Models: few and shallow trees, on all line items as listings of parts.
FEATURES = Features(
    numeric=("AREA_M2", "MAIN_CITY_DIST", "DAYS_ON_MARKET"),
    categorical={"SIZE_SEGMENT": None, "SOURCE": None, "CITY": None},
)


def _model_rows(spark, folder):
    key = F.col("l_suppkey")
    rows = listed(spark, folder, "l_shipdate", "l_returnflag", "l_linestatus", "l_discount").withColumns(
        {
            "ID": F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
            "MAIN_CITY_DIST": F.when(
                F.col("l_discount") != 0,
                great_circle_km(53.0 + key % 100 / 100.0, 22.0 + key % 70 / 100.0, 53.1781, 22.0592),
            ),
            "DAYS_ON_MARKET": F.dayofmonth("l_shipdate"),
            "SOURCE": F.col("l_linestatus"),
            "CITY": F.concat(F.lit("NATION_"), key % 12),
        }
    )
    return numeric_as_double(rows, FEATURES)


def _labelled_rows(spark, folder):
    labelled = labelled_listings(_model_rows(spark, folder), ["NATION_10", "NATION_11"], "NATION_1")
    return labelled.select("ID", "PRICE_ATTRACTIVENESS", "PRICE_M2", *FEATURES.columns)


@check("rf_classify")
def rf_classify(spark, folder):
    return classify(_labelled_rows(spark, folder), FEATURES, trees=10, depth=6).report


@check("rf_regress")
def rf_regress(spark, folder):
    return price_model(_labelled_rows(spark, folder), FEATURES, trees=10, depth=6).metrics


@check("out_of_fold")
def held_out(spark, folder):
    errors = price_errors(_labelled_rows(spark, folder), FEATURES, trees=5, depth=5)
    return error_summary(errors, "SIZE_SEGMENT")


@check("grid_search")
def search(spark, folder):
    rows = contiguous_folds(_labelled_rows(spark, folder), shuffled("ID"), 2, by="PRICE_ATTRACTIVENESS")
    found = grid_search(
        settle(rows),
        "PRICE_ATTRACTIVENESS",
        RATIO_LABELS,
        FEATURES,
        "fold",
        folds=2,
        trees=[5],
        depths=[3, 6],
        leaf_rows=[1],
        penalties=[1.0],
        kernel_size=16,
        svm_rounds=5,
    )
    shown = [
        {"family": c.family, "parameters": str(c.parameters), "accuracy": c.accuracy}
        for c in found.candidates
    ]
    return spark.createDataFrame(pa.Table.from_pylist(shown))


# Orders whose day of the month decides label and price, so that it is known what a model must say; at
# the library's own numbers of trees, depths and folds.
KNOWN_FEATURES = Features(numeric=("AREA_M2", "DAYS_ON_MARKET"), categorical={"SOURCE": None})
KNOWN_SQL = f"""
    known AS (SELECT *, CASE WHEN d <= 10 THEN 'Underpriced' WHEN d <= 20 THEN 'Market Price' ELSE 'Overpriced' END AS label,
                     CASE WHEN d <= 10 THEN 128.0::DOUBLE WHEN d <= 20 THEN 512.0::DOUBLE ELSE 2048.0::DOUBLE END AS price
              FROM (SELECT o_orderkey AS k, o_orderstatus AS source, day(o_orderdate) AS d FROM orders)),
    hashed AS (SELECT *, {SHUFFLED_SQL} AS h FROM known),
    placed AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY h) AS i, count(*) OVER (PARTITION BY label) AS n,
                      row_number() OVER (ORDER BY h) - 1 AS j FROM hashed)"""
# All predictions are right, so a report holds the numbers of test rows only.
REPORT_SQL = f"""
    tested AS (SELECT label, count(*) AS n FROM placed WHERE i > floor(round(n * 0.8, 6)) GROUP BY label),
    report AS (SELECT label, n FROM tested
        UNION ALL SELECT a, sum(n) FROM tested, (SELECT unnest(['accuracy', 'macro avg', 'weighted avg']) AS a) GROUP BY a)"""


def _known_rows(spark, folder):
    day = F.dayofmonth("o_orderdate")
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("ID"),
        F.when(day <= 10, "Underpriced").when(day <= 20, "Market Price").otherwise("Overpriced").alias("PRICE_ATTRACTIVENESS"),
        F.when(day <= 10, 128.0).when(day <= 20, 512.0).otherwise(2048.0).alias("PRICE_M2"),
        F.when(F.col("o_orderkey") % 17 != 0, F.col("o_totalprice")).alias("AREA_M2"),
        day.alias("DAYS_ON_MARKET"),
        F.col("o_orderstatus").alias("SOURCE"),
    )


@check(
    "rf_classify_known",
    f"""WITH {KNOWN_SQL}, {REPORT_SQL}
    SELECT label, 1.0::DOUBLE AS precision, 1.0::DOUBLE AS recall, 1.0::DOUBLE AS f1, CAST(n AS BIGINT) AS support FROM report""",
)
def rf_classify_known(spark, folder):
    return classify(_known_rows(spark, folder), KNOWN_FEATURES).report


@check(
    "price_model_known",
    f"""WITH {KNOWN_SQL}, t AS (SELECT count(*) AS n FROM hashed WHERE h % 1000000 < 200000)
    SELECT n, 0.0::DOUBLE AS mae, 1.0::DOUBLE AS r2, unnest(['all', 'trimmed']) AS kept FROM t""",
)
def price_model_known(spark, folder):
    return price_model(_known_rows(spark, folder), KNOWN_FEATURES, limit=4000.0).metrics


@check(
    "out_of_fold_known",
    f"""WITH {KNOWN_SQL}
    SELECT label AS PRICE_ATTRACTIVENESS, 0.0::DOUBLE AS "MPE_pct", 0.0::DOUBLE AS "Median_Error_pct", count(*) AS "Offers_num"
    FROM known WHERE price < 1000 GROUP BY label
    UNION ALL SELECT 'Overpriced', NULL, NULL, 0""",
)
def out_of_fold_known(spark, folder):
    errors = price_errors(_known_rows(spark, folder), KNOWN_FEATURES)
    return error_summary(errors, "PRICE_ATTRACTIVENESS")


@check(
    "grid_search_known",
    f"""WITH {KNOWN_SQL}, {REPORT_SQL}
    SELECT 'candidate' AS part, 'forest ' || leaf AS name, 1.0::DOUBLE AS score, CAST(NULL AS BIGINT) AS support
    FROM (SELECT unnest([1, 2]) AS leaf) UNION ALL SELECT 'test', label, 1.0, CAST(n AS BIGINT) FROM report""",
)
def grid_search_known(spark, folder):
    """Folds within the training part, the best forest's report on the test part."""
    rows = numeric_as_double(_known_rows(spark, folder), KNOWN_FEATURES)
    marked = settle(stratified_split(rows, "PRICE_ATTRACTIVENESS", shuffled("ID")))
    train, test = (marked.filter(F.col("split") == side) for side in ("train", "test"))
    train = settle(contiguous_folds(train, shuffled("ID"), 5, by="PRICE_ATTRACTIVENESS"))
    found = grid_search(
        train,
        "PRICE_ATTRACTIVENESS",
        RATIO_LABELS,
        KNOWN_FEATURES,
        "fold",
        test=test,
        trees=[100],
        depths=[30],
        leaf_rows=[1, 2],
        penalties=[],
    )
    candidates = [
        {
            "part": "candidate",
            "name": f"{c.family} {c.parameters['minInstancesPerNode']}",
            "score": c.accuracy,
            "support": None,
        }
        for c in found.candidates
    ]
    kind = "part string, name string, score double, support bigint"
    report = found.report.select(
        F.lit("test").alias("part"), F.col("label").alias("name"), F.col("f1").alias("score"), "support"
    )
    return spark.createDataFrame(candidates, kind).unionByName(report)


@check(
    "fold_statistics",
    f"""
    WITH t AS (SELECT c_nationkey % 4 AS fold, CASE WHEN c_nationkey < 6 THEN NULL ELSE c_acctbal END AS a,
                      CAST(c_custkey % 97 AS DOUBLE) AS b FROM customer),
    l AS (SELECT w AS "without", unnest(['a', 'b']) AS feature, unnest([a, b]) AS x
          FROM t, (SELECT unnest([-1, 0, 1, 2, 3]) AS w) WHERE w <> fold),
    m AS (SELECT "without", feature, median(x) AS med FROM l GROUP BY ALL),
    i AS (SELECT l."without", l.feature, med, coalesce(x, med) AS x FROM l JOIN m ON m."without" = l."without" AND m.feature = l.feature)
    SELECT "without", feature, count(*) AS rows, {rnd('any_value(med)', 6)} AS median, {rnd('avg(x)', 6)} AS mean,
           {rnd('stddev_pop(x)', 6)} AS deviation FROM i GROUP BY ALL""",
)
def fold_statistics(spark, folder):
    customers = table(spark, folder, "customer").select(
        (F.col("c_nationkey") % 4).alias("fold"),
        F.when(F.col("c_nationkey") >= 6, F.col("c_acctbal")).alias("a"),
        (F.col("c_custkey") % 97).cast("double").alias("b"),
    )
    learned = learn_folds(customers, ["a", "b"], {}, "fold", 4)
    found = shown(spark, learned, ["a", "b"]).withColumn("without", F.col("without").cast("int"))
    return rounded(found, 6, "median", "mean", "deviation")
