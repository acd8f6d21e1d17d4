"""URL filters: host-suffix and path-prefix expressions looked up by short hash prefixes.

A URL is expanded into the expressions that a rule could have: every suffix of whole host labels with
every prefix of the path, but only in the label counts and path lengths that occur among the rules. An
equi-join on the first hex digits of their digests finds candidates, the whole digests confirm them,
and the longest rule wins. Only DataFrame operations are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow.operators.joins import lookup_join

PREFIX_DIGITS = 8
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, with A-Z in
    lower case; empty for null and without ``://``."""
    found = F.regexp_extract(url, r"(?s)^(?:(?!://).)*+://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty for null and without ``://``."""
    found = F.regexp_extract(url, r"(?s)^(?:(?!://).)*+://[^/?#]*+([^?#]*)", 1)
    return F.coalesce(found, F.lit(""))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules given as (verdict, host, path), the path with its leading slash."""
    names = ("action", "host", "path")
    rows = [F.struct(*[F.lit(v).alias(n) for n, v in zip(names, r, strict=True)]) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _digest(host: Column, path: Column) -> Column:
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _lookup(rules: DataFrame) -> DataFrame:
    """Rules by digest; one of each, ``block`` before ``allow`` and other verdicts by name."""
    host, path = F.translate("host", UPPER, LOWER), F.col("path")
    single = (
        rules.filter(F.col("host").isNotNull() & F.col("path").isNotNull() & F.col("action").isNotNull())
        .groupBy(host.alias("_host"), path.alias("_path"))
        .agg(F.max("action").alias("_action"))
    )
    digest = _digest(F.col("_host"), F.col("_path"))
    return single.select(
        F.substring(digest, 1, PREFIX_DIGITS).alias("_prefix"),
        digest.alias("_rule_digest"),
        F.struct(
            (F.length("_host") + F.length("_path")).alias("length"),
            F.length("_host").alias("host_length"),
            F.col("_action").alias("action"),
            F.concat("_host", "_path").alias("rule"),
        ).alias("_rule"),
    )


def _values(df: DataFrame, value: Column) -> Column:
    """Distinct small numbers as a literal array; there are no more than the longest host or path has
    characters."""
    found = sorted(r[0] for r in df.select(value).distinct().collect() if r[0] is not None)
    return F.array(*[F.lit(int(x)) for x in found]).cast("array<int>")


def judge(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT
) -> DataFrame:
    """All rows of ``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    A rule fits its host and all hosts below it if the path of the URL starts with its path. The longest
    rule wins, then the one with the longer host; of one rule with two verdicts the later by name
    (``block`` over ``allow``). Without a rule the verdict is ``default`` and ``rule`` is null. Null
    URLs and ones without ``://`` have an empty host and path. Equal rows stay apart. Rules with nulls
    are left out; without rules all rows get the default. Columns of the result names are replaced.

    Rows are brought together again by a number that is the same when a task is repeated over the same
    partition; equal numbers are combined before the shuffle, so it carries one row per page.
    """
    results = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c not in results]
    counts = _values(rules, F.size(F.split("host", r"\.")))
    lengths = _values(rules, F.length("path"))
    # Values are hidden in one column so that no name of the input can clash.
    rows = pages.select(
        F.struct(*[F.col(c) for c in kept]).alias("_row"),
        F.monotonically_increasing_id().alias("_at"),
        url_host(F.col(url)).alias("_host"),
        url_path(F.col(url)).alias("_path"),
    )
    labels = F.split("_host", r"\.")
    suffixes = F.transform(
        F.filter(counts, lambda n: n <= F.size(labels)),
        lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."),
    )
    prefixes = F.transform(
        F.filter(lengths, lambda n: n <= F.length("_path")),
        lambda n: F.substr(F.col("_path"), F.lit(1), n),
    )
    expressions = F.flatten(
        F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: _digest(s, p)))
    )
    probes = rows.withColumn("_digest", F.explode_outer(expressions)).withColumn(
        "_prefix", F.substring("_digest", 1, PREFIX_DIGITS)
    )
    found = lookup_join(probes, _lookup(rules), "_prefix")
    confirmed = F.when(F.col("_digest") == F.col("_rule_digest"), F.col("_rule"))
    best = found.groupBy("_at").agg(
        F.first("_row").alias("_row"),
        F.first("_host").alias("_host"),
        F.first("_path").alias("_path"),
        F.max(confirmed).alias("_best"),
    )
    return best.select(
        "_row.*",
        F.col("_host").alias("host"),
        F.col("_path").alias("path"),
        F.col("_best.rule").alias("rule"),
        F.coalesce(F.col("_best.action"), F.lit(default)).alias("verdict"),
    )
