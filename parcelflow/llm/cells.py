"""Near-duplicate vectors: spherical k-means cells, blocked cosine products, one kept per group.

Copies are counted first and stand as one vector. Centers are fitted to a bounded seeded sample; every
vector belongs to the cell of the nearest center. Two vectors that are similar enough lie so close that
the one with the lower cell is also near the border of the other's cell, so it is sent there as a guest:
no link is lost. Cells are cut into blocks, and a task returns counts and a spanning forest, not pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow.llm.graph import blocked, components
from parcelflow.llm.vectors import usable
from parcelflow.operators.joins import lookup_join
from parcelflow.llm.tables import settle

THRESHOLD = 0.98
# Vectors the centers are fitted to, rounds of fitting, and vectors of a label per center.
SAMPLE = 4_096
ROUNDS = 10
CELL_ROWS = 2_048
MAX_CELLS = 256
BLOCK = 2_048
SEED = 17


def spherical_kmeans(sample: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centers of unit vectors; starts from vectors far from each other."""
    centers = sample[:1]
    near = sample @ centers[0]
    while len(centers) < min(k, len(sample)):
        centers = np.vstack([centers, sample[int(np.argmin(near))]])
        near = np.maximum(near, sample @ centers[-1])
    for _ in range(rounds):
        home = np.argmax(sample @ centers.T, axis=1)
        for j in range(len(centers)):
            total = sample[home == j].sum(axis=0)
            if np.linalg.norm(total) > 0:
                centers[j] = total / np.linalg.norm(total)
    return centers


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.vstack(vectors.to_numpy()).astype(np.float64)
    # Scaled first, so that squares neither overflow nor vanish.
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _centers(singles: DataFrame) -> dict[int, np.ndarray]:
    """Centers by number of components; as many as the largest label needs, within the bounds."""
    largest = singles.groupBy("dim", "label").count().groupBy("dim").agg(F.max("count").alias("n"))
    centers = {}
    for dim, n in [(r["dim"], r["n"]) for r in largest.collect()]:
        rows = (
            singles.filter(F.col("dim") == dim)
            .orderBy(F.xxhash64(F.lit(SEED), "key"))
            .limit(SAMPLE)
            .select("vec")
            .toPandas()
        )
        k = min(MAX_CELLS, max(1, -(-n // CELL_ROWS)))
        centers[dim] = spherical_kmeans(_unit(rows["vec"]), k)
    return centers


def _placed(singles: DataFrame, threshold: float) -> DataFrame:
    """A row per vector and cell it is compared in: the home cell and, as guest, higher cells whose
    border is within reach of the threshold."""
    centers = _centers(singles)
    # A linked vector is no further away than this chord, so neither is the border between the cells.
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for dim, part in batch.groupby("dim"):
                c = centers[dim]
                apart = np.sqrt(np.maximum(0, 2 - 2 * (c @ c.T)))
                near = _unit(part["vec"]) @ c.T
                home = np.argmax(near, axis=1)
                behind = near[np.arange(len(part)), home][:, None] - near
                sent = (behind <= reach * apart[home]) & (np.arange(len(c)) > home[:, None])
                sent[np.arange(len(part)), home] = True
                rows, cells = np.nonzero(sent)
                yield part.iloc[rows].assign(cell=cells, guest=cells != home[rows])

    schema = "key string, label string, dim int, vec array<double>, copies long, cell int, guest boolean"
    return singles.select("key", "label", "dim", "vec", "copies").mapInPandas(place, schema)


def _forest(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix the first row it is connected to."""
    root = np.full(len(linked), -1)
    for start in range(len(linked)):
        if root[start] >= 0:
            continue
        root[start] = start
        front = [start]
        while front:
            new = np.nonzero(linked[front].any(axis=0) & (root < 0))[0]
            root[new] = start
            front = new.tolist()
    return root


def _linker(threshold: float):
    def link(group: pd.DataFrame) -> pd.DataFrame:
        unit = _unit(group["vec"])
        guest, part = group["guest"].to_numpy(dtype=bool), group["part"].to_numpy()
        copies = group["copies"].to_numpy()
        linked = (unit @ unit.T) >= threshold
        linked &= ~(guest[:, None] & guest[None, :])
        np.fill_diagonal(linked, False)
        if group["part_a"].iloc[0] != group["part_b"].iloc[0]:
            linked &= part[:, None] != part[None, :]
        links = linked @ copies
        some = np.nonzero(links)[0]
        root = _forest(linked[np.ix_(some, some)])
        keys = group["key"].to_numpy()[some]
        return pd.DataFrame({"key": keys, "links": links[some], "root": keys[root] if len(some) else keys})

    return link


def near_duplicates(
    df: DataFrame,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """A row per row of ``df``: its id, ``n_links`` (other vectors of the same label with at least this
    cosine), ``component_id`` (smallest id reachable by links, its own included) and ``kept``.

    Vectors that are null, all zero, or hold null, NaN or infinite components, and rows with a null
    label or id, link with nothing and are kept; so do vectors of different lengths. Copies link with
    each other and count one by one, repeated ids too. Cosines are computed in doubles. An empty table
    gives no rows. Other columns are not looked at.
    """
    vec = F.transform(F.col(vector).cast("array<double>"), lambda c: c + F.lit(0.0))
    whole = usable(F.col(vector)) & F.exists(F.col(vector), lambda c: c != 0)
    takes_part = whole & F.col(label).isNotNull() & F.col(vec_id).isNotNull()
    text = F.concat_ws(",", F.col(label).cast("string"), vec.cast("array<string>"))
    rows = df.select(
        F.col(vec_id).alias(vec_id),
        F.when(takes_part, F.md5(text)).alias("key"),
        F.col(label).cast("string").alias("label"),
        vec.alias("vec"),
    )
    singles = settle(
        rows.filter("key IS NOT NULL")
        .groupBy("key")
        .agg(
            F.first("label").alias("label"),
            F.first("vec").alias("vec"),
            F.count(F.lit(1)).alias("copies"),
            F.min(vec_id).alias("least"),
        )
        .withColumn("dim", F.size("vec"))
    )
    placed = blocked(_placed(singles, threshold), ["label", "dim", "cell"], "key", BLOCK)
    found = settle(
        placed.groupBy("label", "dim", "cell", "part_a", "part_b").applyInPandas(
            _linker(threshold), "key string, links long, root string"
        )
    )
    roots = components(found.select(F.col("key").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("key").agg(F.sum("links").alias("links"))
    joined = (
        singles.select("key", "copies", "least")
        .join(links, "key", "left")
        .join(roots.withColumnRenamed("node", "key"), "key", "left")
        .withColumn("root", F.coalesce("root", "key"))
    )
    joined = settle(joined)
    first = joined.groupBy("root").agg(F.min("least").alias("component"))
    results = settle(
        joined.join(first, "root").select(
            "key",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
            "component",
        )
    )
    marked = lookup_join(rows.select(vec_id, "key"), results, "key")
    component = F.coalesce("component", vec_id)
    return marked.select(
        vec_id,
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col(vec_id) == component, F.lit(True)).alias("kept"),
    )
