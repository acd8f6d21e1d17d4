"""From raw sources to the cleaned listings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelflow import schemas
from parcelflow.functions import rules
from parcelflow.functions.lookup import replace_exact
from parcelflow.operators.resolve import attach_coordinates
from parcelflow.plans.prepare import Places, Quantity, SourceSpec, harmonise, prepare_named
from parcelflow.profiles import lomza
from parcelflow.sources.dimensions import parse_gazetteer

COORDINATES = ("LAT", "LON")


@dataclass(frozen=True)
class Market:
    """Everything that depends on the region and its sources."""

    sources: Mapping[str, SourceSpec]
    places: Places
    centre: tuple[float, float]
    weekdays: Sequence[str]
    size_breaks: Sequence[float]
    size_labels: Sequence[str]
    area_overrides: Mapping[str, float] = field(default_factory=dict)
    source_names: Mapping[str, str] = field(default_factory=dict)
    other_source: str = "Other"


# How the five sources of the deployment in `profiles.lomza` differ.
SOURCES = {
    "offers": SourceSpec(rename={"DATE_ISO": "DATE_ADDED"}, added_from_updated=True),
    "offers_tytan": SourceSpec(rename={"LOCATION": "CITY"}),
    "offers_gralczyk": SourceSpec(
        rename={
            "FIRST_ADDED": "DATE_ADDED",
            "Cena": "PRICE",
            "Cena za m2": "PRICE_M2",
            "Powierzchnia": "AREA_M2",
        },
        quantities={"AREA_M2": Quantity(unit="  m2", strict=True)},
        place="slug",
    ),
    "offers_polnoc": SourceSpec(
        rename={
            "FIRST_ADDED": "DATE_ADDED",
            "Cena": "PRICE",
            "Cena za m2": "PRICE_M2",
            "Powierzchnia działki": "AREA_M2",
        },
        keep=("AREA_M2 IS NOT NULL AND contains(ID, 'dzialka')",),
        place="slug",
    ),
    "analyzed_offers": SourceSpec(
        rename={"LOCATION": "CITY"},
        keep=(
            "contains(ESTATE_TYPE, 'DZIAŁKA BUDOWLANA') AND contains(OFFER_TYPE, 'SPRZEDAZ')",
        ),
        quantities={
            "AREA_M2": Quantity(unit=" m2", spaces="none"),
            "PRICE": Quantity(unit=" m2", spaces="none"),
        },
        dates=("DATE_ADDED", "LAST_UPDATED", "ANNOUNCE_DATE"),
        dedup=True,
        unit_errors="TEXT",
        derive_unit_price=True,
        place="text",
    ),
}


def lomza_market() -> Market:
    """The deployment in `profiles.lomza`."""
    return Market(
        sources=SOURCES,
        places=Places(
            gazetteer=parse_gazetteer(lomza.GAZETTEER_TEXT),
            corrections={key.upper(): name for key, name in lomza.PLACE_CORRECTIONS.items()},
            no_place=lomza.NO_PLACE,
            default_place=lomza.DEFAULT_PLACE,
        ),
        centre=lomza.CENTRE,
        weekdays=lomza.WEEKDAYS,
        size_breaks=lomza.SIZE_BREAKS,
        size_labels=lomza.SIZE_LABELS,
        area_overrides=lomza.AREA_OVERRIDES,
        source_names=lomza.SOURCE_NAMES,
        other_source=lomza.OTHER_SOURCE,
    )


def union_sources(prepared: Mapping[str, DataFrame]) -> DataFrame:
    """All sources below each other, duplicates kept; every one must have the target columns."""
    return reduce(DataFrame.unionByName, [harmonise(df, name) for name, df in prepared.items()])


def enrich(df: DataFrame, market: Market) -> DataFrame:
    """Repairs and derived columns, in this order; one narrow stage."""
    df = rules.price_floor(df)
    df = rules.add_weekday(df, market.weekdays)
    df = rules.repair_area(df)
    df = rules.override_area(df, market.area_overrides)
    df = rules.add_distance(df, market.centre)
    df = rules.add_segment(df, market.size_breaks, market.size_labels)
    df = rules.order_interval(df)
    return rules.market_status(df)


def anonymise(df: DataFrame, names: Mapping[str, str], other: str = "Other") -> DataFrame:
    return df.withColumn("SOURCE", replace_exact(F.col("SOURCE"), names, default=other))


def build_listings(raw: Mapping[str, DataFrame], market: Market) -> DataFrame:
    """Cleaned listings from raw tables, in the order and the shape of `schemas.LISTINGS`.

    All sources share what is made of the names of places, and meet the coordinates together.
    """
    spark = next(iter(raw.values())).sparkSession
    gazetteer = market.places.frame(spark)
    names = market.places.name_tables(gazetteer)
    nowhere = {c: F.lit(None).cast("double") for c in COORDINATES}
    prepared = {
        name: prepare_named(df, market.sources[name], market.places, names).drop(*COORDINATES).withColumns(nowhere)
        for name, df in raw.items()
    }
    located = attach_coordinates(union_sources(prepared).drop(*COORDINATES), gazetteer)
    listings = anonymise(enrich(located, market), market.source_names, market.other_source).select(
        schemas.LISTINGS.fieldNames()
    )
    schemas.require(listings.schema, schemas.LISTINGS)
    return listings
