"""Connected components and blocked comparison of groups, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.llm.tables import settle
from parcelflow.session import passing


@passing
def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` for every node of ``edges`` (columns ``a`` and ``b``); nodes are connected
    if their roots are equal. Loops, repeated edges and edges with nulls do no harm.

    Each round maps every node to the smallest one among itself and its neighbours and contracts the
    edges to these. The number of rounds is about the logarithm of the longest path if nodes are
    hashes; minima are combined before the shuffle, so a node with very many edges is no hot spot.
    """
    edges = edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    edges, rounds = settle(edges.distinct()), []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        nearest = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
        nearest = settle(nearest.select("node", F.least("node", "root").alias("root")))
        rounds.append(nearest)
        of_a = nearest.withColumnsRenamed({"node": "a", "root": "root_a"})
        of_b = nearest.withColumnsRenamed({"node": "b", "root": "root_b"})
        moved = edges.join(of_a, "a").join(of_b, "b").filter("root_a <> root_b")
        edges = settle(
            moved.select(
                F.least("root_a", "root_b").alias("a"), F.greatest("root_a", "root_b").alias("b")
            ).distinct()
        )
    if not rounds:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    found = rounds[0]
    for later in rounds[1:]:
        step = later.select(F.col("node").alias("root"), F.col("root").alias("next"))
        found = found.join(step, "root", "left")
        found = settle(found.select("node", F.coalesce("next", "root").alias("root")))
    return found


def blocked(df: DataFrame, group: list[str], spread: str, size: int) -> DataFrame:
    """Rows laid out so that every pair of rows of a group meets in one task of at most about twice
    ``size`` rows: adds ``part``, ``part_a`` and ``part_b``.

    A group is cut into parts by the hash of ``spread``; task (a, b) holds parts a and b, and compares
    a with b if they differ, else a with itself. Groups of up to ``size`` rows are a single task.
    """
    counts = df.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_parts"))
    large = settle(counts.filter("_parts > 1"))
    part = F.pmod(F.xxhash64(spread), F.col("_parts")).cast("int")
    rows = df.join(large, group, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    rows = rows.withColumn("part", part).withColumn(
        "_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))
    )
    return rows.select(
        *df.columns,
        "part",
        F.least("part", "_other").alias("part_a"),
        F.greatest("part", "_other").alias("part_b"),
    )
