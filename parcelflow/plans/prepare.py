"""Bringing one raw source into the common shape, driven by a description of the source."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelflow import schemas
from parcelflow.functions.dates import parse_date
from parcelflow.functions.lookup import INLINE_NAMES, first_match, replace_exact, resolve_place
from parcelflow.functions.rules import fill_missing, unit_price
from parcelflow.functions.text import parse_quantity, slug_to_name, strip_whitespace
from parcelflow.operators.dedup import dedup_latest
from parcelflow.operators.quality import correct_unit_errors
from parcelflow.operators.resolve import NameTables, attach_coordinates, first_match_join
from parcelflow.session import settle, stored
from parcelflow.sources.dimensions import gazetteer_frame


@dataclass(frozen=True)
class Quantity:
    """How a number is written in a text column."""

    unit: str = " m2"
    strict: bool = False
    spaces: str = "all"


@dataclass(frozen=True)
class SourceSpec:
    """What is particular about one source.

    ``place`` is how its location is found: ``exact`` (upper-cased name), ``slug`` (names inside the
    listing id) or ``text`` (names inside a free text, with corrections and a default). ``keep`` holds
    SQL conditions on the renamed columns.
    """

    rename: Mapping[str, str] = field(default_factory=dict)
    keep: Sequence[str] = ()
    quantities: Mapping[str, Quantity] = field(default_factory=dict)
    dates: Sequence[str] = ("DATE_ADDED", "LAST_UPDATED")
    added_from_updated: bool = False
    dedup: bool = False
    unit_errors: str | None = None
    derive_unit_price: bool = False
    place: str = "exact"
    noise: str = "dzialka"


@dataclass(frozen=True)
class Places:
    """Gazetteer and dictionaries for resolving locations. The gazetteer is a list, which goes into the plan
    while it is short, or a table (``priority``, ``CITY``, ``LAT``, ``LON``) of any size, which is joined."""

    gazetteer: Sequence[tuple[int, str, float, float]] | DataFrame
    corrections: Mapping[str, str] = field(default_factory=dict)
    no_place: str = "BRAK"
    default_place: str = "ŁOMŻA"
    mode: str = "first_match"

    @property
    def names(self) -> list[str]:
        return [name for _, name, _, _ in self.gazetteer]

    @property
    def inline(self) -> bool:
        """Whether names are searched for by an expression that lists them."""
        return not isinstance(self.gazetteer, DataFrame) and len(self.gazetteer) <= INLINE_NAMES

    def frame(self, spark: SparkSession) -> DataFrame:
        """The gazetteer as a table with one row per name, that of the lowest priority."""
        if not isinstance(self.gazetteer, DataFrame):
            return gazetteer_frame(spark, self.gazetteer)
        first = self.gazetteer.groupBy("CITY").agg(F.min(F.struct("priority", "LAT", "LON")).alias("first"))
        return settle(first.select("first.priority", "CITY", "first.LAT", "first.LON"))

    def name_tables(self, gazetteer: DataFrame) -> NameTables | None:
        """What searches for the names of `frame` share, if they are joined."""
        return None if self.inline else NameTables(gazetteer.select("priority", F.col("CITY").alias("name")))


def prepare(df: DataFrame, spec: SourceSpec, places: Places, gazetteer: DataFrame) -> DataFrame:
    """Filter, rename, parse, repair and locate the listings of one source."""
    return attach_coordinates(prepare_named(df, spec, places, places.name_tables(gazetteer)), gazetteer)


def prepare_named(df: DataFrame, spec: SourceSpec, places: Places, names: NameTables | None) -> DataFrame:
    """`prepare` as far as the name of the place."""
    df = df.withColumnsRenamed(dict(spec.rename))
    for condition in spec.keep:
        df = df.filter(condition)
    df = df.withColumns({c: parse_date(F.col(c)) for c in spec.dates})
    if spec.dedup:
        df = dedup_latest(df, ["ID"], ["LAST_UPDATED", "DATE_ADDED"])
        # The fences below read one column several times; the rows should be grouped only once.
        df = stored(df, "unique") if spec.unit_errors else df
    if spec.added_from_updated:
        df = fill_missing(df, "DATE_ADDED", "LAST_UPDATED")
    df = df.withColumns(
        {
            c: parse_quantity(F.col(c), q.unit, q.strict, q.spaces)
            for c, q in spec.quantities.items()
        }
    )
    if spec.unit_errors:
        df = correct_unit_errors(df, "AREA_M2", spec.unit_errors)
    if spec.derive_unit_price:
        df = unit_price(df)
    return locate(df, spec, places, names)


def locate(df: DataFrame, spec: SourceSpec, places: Places, names: NameTables | None) -> DataFrame:
    """Set ``CITY`` in the way of the source."""
    if spec.place == "exact":
        return df.withColumn("CITY", F.upper("CITY"))
    if spec.place == "slug":
        searched = slug_to_name(F.col("ID"), spec.noise)
        return _recognise(df, searched, places, names, hyphen_as_space=True)
    if spec.place == "text":
        given = replace_exact(F.upper(strip_whitespace(F.col("CITY"))), places.corrections)
        known = _recognise(df.withColumn("_given", given), F.col("_given"), places, names)
        city = resolve_place(F.col("_given"), F.col("CITY"), places.no_place, places.default_place)
        return known.withColumn("CITY", city).drop("_given")
    raise ValueError(spec.place)


def _recognise(
    df: DataFrame, text: Column, places: Places, names: NameTables | None, hyphen_as_space: bool = False
) -> DataFrame:
    """``CITY`` as the name that occurs in ``text``."""
    if names is None:
        return df.withColumn(
            "CITY", first_match(text, places.names, places.mode, hyphen_as_space=hyphen_as_space)
        )
    rows = df.withColumn("_searched", text)
    found = first_match_join(
        rows, "_searched", names.dictionary, "CITY", places.mode, hyphen_as_space=hyphen_as_space, inline=0, made=names
    )
    return found.drop("_searched")


def harmonise(df: DataFrame, source: str, aliases: Mapping[str, str] = {"VALUE": "PRICE"}) -> DataFrame:
    """Target columns with their declared types, tagged with the source.

    Columns in ``aliases`` get their target name; having both is an error, not a choice. Casts are
    strict: text that is no number stops the job.
    """
    for old, new in aliases.items():
        if old in df.columns and new in df.columns:
            raise ValueError(f"{source}: both {old} and {new}")
    df = df.withColumnsRenamed(dict(aliases))
    return df.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.TARGET.fields],
        F.lit(source).alias("SOURCE"),
    )
