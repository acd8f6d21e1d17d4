"""How the vocabulary of a source differs from those of the other sources of its language, and from the whole.

A term's probability in a group of documents is smoothed and scaled to whole numbers, and two groups differ
at a term by f(p, q), the whole part of (p - q)^2 / (p + q). f depends on counts alone, so terms with equal
counts form a cell and f is taken once per cell, with the number of its terms:

* Terms of a source against its language: cells of (count in the source, count in the language) are ranked by
  f, cells of equal f are merged, and numbers of terms are added up until the wanted rank is reached. Only
  the cells that reach into it are opened, and their terms put in the order of their UTF-8 bytes.
* Sources against each other: most terms occur in one of two sources only or in neither, and these cells
  follow from the counts of each source alone. Only terms of both sources make cells of their own.

All arithmetic is on whole numbers.
"""

from __future__ import annotations

import string
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.llm.graph import blocked
from parcelflow.llm.tables import settle
from parcelflow.operators.joins import lookup_join

SCALE = 1_000_000_000
MIN_DOCS = 10
TOP = 10
# Different terms that a task counts before it hands them on.
HELD = 250_000
# Sources of a term that meet in one task at once.
TOGETHER = 64

# Bytes of terms as they are or lower-cased, all others as spaces; bytes from 128 on are parts of letters.
_TERM_BYTES = string.ascii_letters.encode() + bytes(range(128, 256))
FOLD = bytes(b if b in _TERM_BYTES else 32 for b in range(256)).lower()

_COUNTED = pa.schema(
    [
        ("lang", pa.string()),
        ("source", pa.string()),
        ("term", pa.string()),
        ("n", pa.int64()),
        ("docs", pa.int64()),
    ]
)


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, in lower case, and of characters beyond ASCII, as they are."""
    return text.translate(FOLD).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of the terms of each language and source, combined within the task."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0
    for batch in batches:
        for lang, source, text in zip(*(column.to_pylist() for column in batch.columns), strict=True):
            found = terms(text)
            n, docs = held.setdefault((lang, source), (Counter(), Counter()))
            before = len(docs)
            n.update(found)
            docs.update(set(found))
            size += len(docs) - before
            if size >= HELD:
                yield from _handed_on(held)
                size = 0
    yield from _handed_on(held)


def _handed_on(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
    """A batch for each group; what has been handed on is forgotten."""
    while held:
        (lang, source), (n, docs) = held.popitem()
        columns = [
            pa.repeat(pa.scalar(lang, pa.string()), len(n)),
            pa.repeat(pa.scalar(source, pa.string()), len(n)),
            pa.array(n.keys(), pa.binary()).cast(pa.string()),
            pa.array(n.values(), pa.int64()),
            pa.array(map(docs.__getitem__, n), pa.int64()),
        ]
        yield pa.RecordBatch.from_arrays(columns, schema=_COUNTED)


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences in the group), ``in_lang`` (in the language) and
    ``lead`` (1 in one row per language and term) for terms in at least ``min_docs`` documents of the
    language, where they occur. Columns of ``docs``: ``lang``, ``source`` and ``text``, without nulls."""
    counted = docs.select("lang", "source", F.col("text").cast("binary")).mapInArrow(
        _count, "lang string, source string, term string, n long, docs long"
    )
    # Laid out by language and term once, for the counts of groups and those of languages.
    of_group = (
        counted.repartition("lang", "term")
        .groupBy("lang", "term", "source")
        .agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    )
    whole = Window.partitionBy("lang", "term")
    rows = of_group.withColumns(
        {
            "in_lang": F.sum("n").over(whole),
            "docs": F.sum("docs").over(whole),
            "lead": (F.col("source") == F.min("source").over(whole)).cast("int"),
        }
    )
    return rows.filter(F.col("docs") >= min_docs).select("lang", "source", "term", "n", "in_lang", "lead")


def group_totals(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``total`` (occurrences of kept terms) and ``n_terms`` (of these different ones) of every group that has
    a document, with ``vocabulary`` (kept terms of the language) and ``lang_total``."""
    of_group = rows.groupBy("lang", "source").agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_terms"), F.sum("lead").alias("leads")
    )
    of_lang = of_group.groupBy("lang").agg(
        F.sum("leads").alias("vocabulary"), F.sum("total").alias("lang_total")
    )
    given = docs.select("lang", "source").distinct().join(of_group.drop("leads"), ["lang", "source"], "left")
    return given.join(of_lang, "lang", "left").fillna(0)


def probability(count: Column | str, total: Column | str, vocabulary: Column | str = "vocabulary") -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * vocabulary)); null for an empty vocabulary."""
    count, total, vocabulary = (F.col(c) if isinstance(c, str) else c for c in (count, total, vocabulary))
    scaled = (count + 2).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    parts = F.when(vocabulary > 0, total + 2 * vocabulary).cast("decimal(19,0)")
    return F.call_function("div", scaled, parts) + 1


def difference(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)), exactly."""
    square = (p - q) * (p - q)
    return F.call_function("div", square, p + q)


def term_ranks(rows: DataFrame, totals: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` terms that a group uses more than its language: ``lang``, ``source``, ``item``, ``value``
    and ``rank``, by value, of equal ones by the term's bytes."""
    cells = rows.groupBy("lang", "source", "n", "in_lang").agg(F.count(F.lit(1)).alias("terms"))
    p, q = probability("n", "total"), probability("in_lang", "lang_total")
    cells = _with_totals(cells, totals, "total", "lang_total").select(
        "lang", "source", "n", "in_lang", "terms", p.alias("p"), q.alias("q")
    )
    cells = settle(
        cells.filter(F.col("p") > F.col("q")).withColumn("value", difference(F.col("p"), F.col("q")))
    )
    # Every value has a term at least, so no more than the ``top`` highest values matter.
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"))
    values = cells.groupBy("lang", "source", "value").agg(F.sum("terms").alias("terms"))
    values = values.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= top)
    above = F.sum("terms").over(order) - F.col("terms")
    values = values.withColumn("above", above).filter(F.col("above") < top)
    opened = cells.join(values.select("lang", "source", "value"), ["lang", "source", "value"], "left_semi")
    key = F.concat_ws(":", F.length("lang").cast("string"), "lang", "source", "n", "in_lang")
    found = lookup_join(
        rows.withColumn("cell", key).select("cell", "lang", "source", "term"),
        settle(opened.select(key.alias("cell"), "value")),
        "cell",
        "inner",
    )
    by_bytes = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    return (
        found.withColumn("rank", F.row_number().over(by_bytes))
        .filter(F.col("rank") <= top)
        .select("lang", "source", F.col("term").alias("item"), "value", "rank")
    )


def pair_values(rows: DataFrame, totals: DataFrame) -> DataFrame:
    """For every group each other source of its language: ``lang``, ``source``, ``item``, ``value`` (f summed
    over all kept terms of the language) and ``rank``.

    With f(x, 0) summed over the terms of one source, f(0, z) over those of the other, and f(0, 0) over the
    vocabulary less both, terms that both have are counted twice over; the last part puts them right.
    """
    one = totals.select("lang", "vocabulary", *_renamed(totals, "a"))
    two = totals.select("lang", *_renamed(totals, "b"))
    pairs = settle(lookup_join(one, two, "lang", "inner").filter("a < b"))
    none = F.lit(0)
    neither = F.col("vocabulary") - F.col("terms_a") - F.col("terms_b")
    parts = [pairs.select("lang", "a", "b", (neither * _between(none, none)).alias("value"))]
    alone = settle(rows.groupBy("lang", "source", "n").agg(F.count(F.lit(1)).alias("terms")))
    for side, counts in (("a", (F.col("n"), none)), ("b", (none, F.col("n")))):
        cells = pairs.join(alone.withColumnRenamed("source", side), ["lang", side])
        parts.append(cells.select("lang", "a", "b", (F.col("terms") * _between(*counts)).alias("value")))
    x, z = F.col("x"), F.col("z")
    put_right = _between(x, z) - _between(x, none) - _between(none, z) + _between(none, none)
    shared = _common_cells(rows).join(pairs, ["lang", "a", "b"])
    parts.append(shared.select("lang", "a", "b", (F.col("terms") * put_right).alias("value")))
    summed = reduce(DataFrame.unionByName, parts).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.array(
        F.struct(F.col("a").alias("source"), F.col("b").alias("item")),
        F.struct(F.col("b").alias("source"), F.col("a").alias("item")),
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return (
        summed.select("lang", F.coalesce("value", F.lit(0)).cast("long").alias("value"), F.inline(both))
        .withColumn("rank", F.row_number().over(order))
        .select("lang", "source", "item", "value", "rank")
    )


def _renamed(totals: DataFrame, side: str) -> list[Column]:
    return [
        F.col("source").alias(side),
        F.col("total").alias(f"total_{side}"),
        F.col("n_terms").alias(f"terms_{side}"),
    ]


def _between(x: Column, z: Column) -> Column:
    return difference(probability(x, "total_a"), probability(z, "total_b"))


def _with_totals(df: DataFrame, totals: DataFrame, *columns: str) -> DataFrame:
    return df.join(totals.select("lang", "source", "vocabulary", *columns), ["lang", "source"])


def _common_cells(rows: DataFrame) -> DataFrame:
    """Number of ``terms`` that sources ``a`` < ``b`` of a language have ``x`` and ``z`` times."""
    dealt = blocked(rows.select("lang", "term", "source", "n"), ["lang", "term"], "source", TOGETHER)
    met = dealt.groupBy("lang", "term", "part_a", "part_b").agg(
        F.sort_array(F.collect_list(F.struct("source", "n", "part"))).alias("met")
    )
    # Sources of two parts are compared across these only, those of a single part with each other.
    pair = F.transform(
        "met",
        lambda one, i: F.transform(
            F.filter(
                F.slice("met", i + 2, F.size("met")),
                lambda two: (F.col("part_a") == F.col("part_b")) | (one["part"] != two["part"]),
            ),
            lambda two: F.struct(
                one["source"].alias("a"), two["source"].alias("b"), one["n"].alias("x"), two["n"].alias("z")
            ),
        ),
    )
    found = met.select("lang", F.inline(F.flatten(pair)))
    return found.groupBy("lang", "a", "b", "x", "z").agg(F.count(F.lit(1)).alias("terms"))


def audit(
    docs: DataFrame,
    lang: str = "lang",
    source: str = "source",
    text: str = "text",
    min_docs: int = MIN_DOCS,
    top: int = TOP,
) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value`` and ``rank`` of both comparisons: ``pair`` with
    every other source of the language, ``term`` with the ``top`` terms used more than in the language.

    Null languages, sources and texts are empty strings; repeated rows are documents of their own. A
    group without terms is compared like any other; a language without kept terms gives pairs of value
    0 and no terms, one with a single source no pairs, an empty table no rows. Other columns are ignored.
    """
    columns = {"lang": lang, "source": source, "text": text}
    given = docs.select(*(F.coalesce(F.col(c), F.lit("")).alias(name) for name, c in columns.items()))
    rows = settle(kept_terms(given, min_docs))
    totals = settle(group_totals(given, rows))
    pairs = pair_values(rows, totals).withColumn("part", F.lit("pair"))
    best = term_ranks(rows, totals, top).withColumn("part", F.lit("term"))
    return pairs.unionByName(best).select("lang", "source", "part", "item", "value", "rank")
