"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram is bound by multiplying the vectors of its
letters, each permuted (rotated) by its place; a text is the bundle (sum) of its n-grams, a language the
bundle of its training texts. A text gets the language whose bundle has the largest cosine with its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.operators.joins import lookup_join
from parcelflow.llm.tables import settle

DIMENSIONS = 512
ORDER = 3
SEED = 11
UNKNOWN = "und"

# What is learned from: so many documents of a language, as expected number of a seeded sample.
TRAIN_DOCS = 1_000

# Bound n-grams kept by a Python worker; beyond it the table is begun anew.
TABLE_ROWS = 30_000

# Bundles are summed in whole numbers so that the order of summing does not matter.
UNITS = 1 << 20


@cache
def _letters() -> np.ndarray:
    """Code point -> itself if it is a letter, else 0."""
    points = np.arange(0x110000, dtype=np.int64)
    return np.where([chr(p).isalpha() for p in points], points, 0)


class Encoder:
    """Turns texts into bundles; keeps the vectors of n-grams it has bound."""

    def __init__(self, dimensions: int, order: int, seed: int):
        self.dimensions, self.order, self.seed = dimensions, order, seed
        self.letters: dict[int, np.ndarray] = {}
        self._clear()

    def _clear(self) -> None:
        self.table = np.empty((1024, self.dimensions), np.float32)
        self.rows: dict[int, int] = {}

    def _letter(self, point: int) -> np.ndarray:
        if point not in self.letters:
            signs = np.random.default_rng([self.seed, point]).integers(0, 2, self.dimensions)
            self.letters[point] = (2 * signs - 1).astype(np.float32)
        return self.letters[point]

    def _bind(self, gram: int) -> np.ndarray:
        vector = np.ones(self.dimensions, np.float32)
        for place in range(self.order):
            vector = vector * np.roll(self._letter(gram & 0x1FFFFF), place)
            gram >>= 21
        return vector

    def _vectors(self, grams: np.ndarray) -> np.ndarray:
        if len(self.rows) + len(grams) > TABLE_ROWS:
            self._clear()
        at = [self.rows.get(g, -1) for g in grams.tolist()]
        for i, place in enumerate(at):
            if place < 0:
                at[i] = row = len(self.rows)
                if row == len(self.table):
                    self.table = np.vstack([self.table, np.empty_like(self.table)])
                self.table[row] = self._bind(int(grams[i]))
                self.rows[int(grams[i])] = row
        return self.table[at]

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct n-grams of letters and gaps, and how often they occur; a gap is any run of other
        characters and stands at both ends too."""
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = _letters()[points]
        codes = np.concatenate(([0], codes, [0]))
        codes = codes[(codes != 0) | np.concatenate(([True], codes[:-1] != 0))]
        if len(codes) < self.order or not codes.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        packed = np.zeros(len(codes) - self.order + 1, np.int64)
        for place in range(self.order):
            packed = (packed << 21) | codes[place : place + len(packed)]
        return np.unique(packed, return_counts=True)

    def bundle(self, text: str | None) -> np.ndarray | None:
        """Unit vector of a text; None if it has no letter."""
        grams, counts = self.grams(text or "")
        if not len(grams):
            return None
        total = np.zeros(self.dimensions, np.float32)
        for i in range(0, len(grams), TABLE_ROWS // 4):
            part = slice(i, i + TABLE_ROWS // 4)
            total += counts[part].astype(np.float32) @ self._vectors(grams[part])
        size = np.linalg.norm(total)
        return total / size if size else total


@cache
def _encoder(dimensions: int, order: int, seed: int) -> Encoder:
    """One for each Python worker."""
    return Encoder(dimensions, order, seed)


@dataclass
class Model:
    """Prototypes by language, with what is needed to encode texts alike."""

    languages: list[str]
    prototypes: np.ndarray
    dimensions: int
    order: int
    seed: int

    def predict(self, text: Column) -> Column:
        """Struct of ``lang_pred`` and ``score``, the cosine with its prototype cut to 0 to 1.

        Null texts, texts without a letter, and all texts if nothing was learned, are ``und`` with score
        0. Of equal cosines the first language by name is taken. The whole text counts.
        """
        languages, prototypes = self.languages, self.prototypes
        shape = (self.dimensions, self.order, self.seed)

        @F.pandas_udf("lang_pred string, score double")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            encoder = _encoder(*shape)
            for texts in batches:
                names, scores = [], []
                for t in texts:
                    vector = encoder.bundle(t) if languages else None
                    if vector is None:
                        names.append(UNKNOWN)
                        scores.append(0.0)
                        continue
                    cosines = prototypes @ vector
                    best = int(np.argmax(cosines))
                    names.append(languages[best])
                    scores.append(float(min(max(cosines[best], 0.0), 1.0)))
                yield pd.DataFrame({"lang_pred": names, "score": scores})

        return run(text)


def fit(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    train_docs: int = TRAIN_DOCS,
    dimensions: int = DIMENSIONS,
    order: int = ORDER,
    seed: int = SEED,
) -> Model:
    """Prototypes from a seeded sample of about ``train_docs`` rows of each language.

    Rows without id, text or language are not learned from; an empty table gives a model without
    languages. Texts are bundled by the executors; only one vector per language comes to the driver, and
    every language has one.
    """
    known = docs.select(
        F.col(lang).alias("lang"),
        F.col(text).alias("text"),
        F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(doc_id).cast("string")), 1).alias("draw"),
    ).filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull())
    rates = (
        known.groupBy("lang")
        .count()
        .select("lang", (F.lit(train_docs) / F.col("count") * float(1 << 63)).alias("below"))
    )
    chosen = lookup_join(known, settle(rates), "lang", "inner").filter(F.col("draw") < F.col("below"))

    def bundles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _encoder(dimensions, order, seed)
        for batch in batches:
            sums: dict[str, np.ndarray] = {}
            for name, t in zip(batch["lang"], batch["text"], strict=True):
                vector = encoder.bundle(t)
                if vector is not None:
                    whole = np.rint(vector.astype(np.float64) * UNITS).astype(np.int64)
                    sums[name] = sums.get(name, 0) + whole
            for name, total in sums.items():
                yield pd.DataFrame({"lang": name, "place": np.arange(dimensions), "x": total})

    summed = (
        chosen.select("lang", "text")
        .mapInPandas(bundles, "lang string, place int, x long")
        .groupBy("lang", "place")
        .agg(F.sum("x").alias("x"))
        .groupBy("lang")
        .agg(F.sort_array(F.collect_list(F.struct("place", "x")))["x"].alias("vector"))
        .toPandas()
        .sort_values("lang")
    )
    languages = summed["lang"].tolist()
    prototypes = np.zeros((len(languages), dimensions))
    for i, vector in enumerate(summed["vector"]):
        prototypes[i] = vector
    sizes = np.linalg.norm(prototypes, axis=1, keepdims=True)
    return Model(
        languages,
        (prototypes / np.where(sizes > 0, sizes, 1)).astype(np.float32),
        dimensions,
        order,
        seed,
    )
