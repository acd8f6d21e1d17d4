"""Points in regions of several parts and with holes, through an index of border edges by grid cell.

A region is inside an odd number of its rings (even-odd rule). Its border is cut at the lines of a grid, and a
cell keeps the few pieces of border within it and one parity: whether a ray to the east from beyond its upper
right corner is crossed an odd number of times. A point is settled by its own cell alone: from the point
east to the cell's right side, counting pieces, and up that side, counting where the border passes
through it. Both counts use the places where the border was cut, so they fit together whatever the
rounding. Cells wholly inside have no pieces and need no test. A cell with many pieces is split in four, again and
again, so no point meets more than ``CELL_EDGES`` of them, however many corners its region has.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.operators.joins import lookup_join
from parcelflow.session import BROADCAST_BYTES, settle, stored

CELL_DEGREES = 0.25
# A cell with more pieces of border is split, at most so often.
CELL_EDGES = 32
MAX_LEVEL = 16

# Pieces are also listed in the rows of cells this close, for points on the border.
PAD = 1e-9
# Coordinates beyond are no places and lie in no region.
FARTHEST = 1e9

_EDGE = ["ax", "ay", "bx", "by"]


def point(lon: Column, lat: Column) -> Column:
    """Point struct; null where a coordinate is missing or not finite."""
    fit = (F.abs(lon) <= FARTHEST) & (F.abs(lat) <= FARTHEST)
    return F.when(fit, F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat")))


def _line(number: Column, degrees: Column | float) -> Column:
    return number.cast("double") * degrees


def _number(value: Column, degrees: Column | float) -> Column:
    """The cell of a coordinate: the last line at or before it, exactly as `_line` gives lines."""
    near = F.floor(value / degrees).cast("long")
    return (
        near
        - (value < _line(near, degrees)).cast("long")
        + (value >= _line(near + 1, degrees)).cast("long")
    )


def region_edges(regions: DataFrame) -> DataFrame:
    """One row per border edge of ``regions`` (``region_id`` and ``ring`` or ``rings``), from (ax, ay) to
    (bx, by). Rings are closed (first corner repeated last). Those of fewer than four corners, or with a
    corner that is no place, do not count."""
    names = [name for name in ("rings", "ring") if name in regions.columns]
    rings = F.coalesce(*[F.array("ring") if name == "ring" else F.col(name) for name in names])
    ring = regions.select("region_id", F.explode(rings).alias("ring"))
    corners = F.transform("ring", lambda c: point(c["lon"], c["lat"]))
    sound = (F.size("ring") >= 4) & ~F.exists("ring", lambda c: c.isNull())
    n = F.size("ring") - 1
    ends = F.arrays_zip(F.slice("ring", 1, n).alias("a"), F.slice("ring", 2, n).alias("b"))
    return (
        ring.withColumn("ring", corners)
        .filter(sound)
        .select("region_id", F.inline(ends).alias("a", "b"))
        .select(
            "region_id",
            *[F.col(f"{p}.{c}").alias(f"{p}{x}") for p in "ab" for c, x in (("lon", "x"), ("lat", "y"))],
        )
    )


def _pieces(edges: DataFrame, degrees: float, within: tuple[Column, Column] | None = None) -> DataFrame:
    """Edges cut at the vertical lines: ``cx`` and the latitudes ``west`` and ``east`` of each piece's ends
    with their rows, and whether it goes on ``beyond`` the column's right side. ``within`` bounds ``cx``."""
    forward = F.col("ax") <= F.col("bx")
    ends = {n: F.when(forward, F.col(f"a{n[1]}")).otherwise(F.col(f"b{n[1]}")) for n in ("wx", "wy")}
    ends |= {f"e{x}": F.when(forward, F.col(f"b{x}")).otherwise(F.col(f"a{x}")) for x in "xy"}
    rows = edges.withColumns(ends)
    first, last = _number(F.col("wx"), degrees), _number(F.col("ex"), degrees)
    low, high = within or (first, last)
    rows = rows.withColumns({"first": first, "last": last}).withColumn(
        "cx", F.explode(F.sequence(F.greatest("first", low), F.least("last", high)))
    )

    def cut(number: Column) -> Column:
        share = (_line(number, degrees) - F.col("wx")) / F.nullif(F.col("ex") - F.col("wx"), F.lit(0.0))
        at = F.col("wy") + (F.col("ey") - F.col("wy")) * share
        return F.greatest(F.least("wy", "ey"), F.least(at, F.greatest("wy", "ey")))

    rows = rows.withColumns(
        {
            "west": F.when(F.col("cx") > F.col("first"), cut(F.col("cx"))).otherwise(F.col("wy")),
            "east": F.when(F.col("cx") < F.col("last"), cut(F.col("cx") + 1)).otherwise(F.col("ey")),
            "beyond": F.col("cx") < F.col("last"),
        }
    )
    return rows.withColumns(
        {"west_row": _number(F.col("west"), degrees), "east_row": _number(F.col("east"), degrees)}
    ).drop("wx", "wy", "ex", "ey", "first", "last")


def _entries(pieces: DataFrame, degrees: float, within: tuple[Column, Column] | None = None) -> DataFrame:
    """A row per piece and cell; ``turn`` where the piece leaves the cell through its right side."""
    least, most = F.least("west", "east") - PAD, F.greatest("west", "east") + PAD
    low, high = _number(least, degrees), _number(most, degrees)
    if within:
        low, high = F.greatest(low, within[0]), F.least(high, within[1])
    cy = F.when(low <= high, F.sequence(low, F.greatest(low, high)))
    rows = pieces.withColumn("cy", F.explode(cy))
    turn = F.col("beyond") & (F.col("east_row") == F.col("cy"))
    return rows.select("region_id", "cx", "cy", *_EDGE, "west", "east", turn.alias("turn"))


def _odd(*parts: Column) -> Column:
    return sum(parts[1:], parts[0]) % 2 == 1


def _first_cells(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cells with pieces, and the cells wholly inside. A cell's parity is the number of turns above it in
    its column; between two cells with pieces it does not change."""
    counted = entries.groupBy("region_id", "cx", "cy").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("turn").cast("long")).alias("turns")
    )
    # Turns of a column, from its uppermost cell down.
    down = Window.partitionBy("region_id", "cx").orderBy(F.desc("cy"))
    until = F.sum("turns").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    cells = settle(
        counted.withColumns({"below": until, "next": F.lead("cy").over(down)}).withColumn(
            "odd", _odd(F.col("below") - F.col("turns"))
        )
    )
    gaps = cells.filter(_odd(F.col("below")) & (F.col("next") < F.col("cy") - 1))
    inside = gaps.select(
        "region_id", "cx", F.explode(F.sequence(F.col("next") + 1, F.col("cy") - 1)).alias("cy")
    )
    return cells.select("region_id", "cx", "cy", "n", "odd"), inside


def _split(entries: DataFrame, cells: DataFrame, degrees: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The quarters of ``cells``: their entries, those with pieces and those wholly inside. ``degrees`` is
    the quarters' size. The parity of a quarter follows from the pieces of its cell: those that turn on the
    right side above it, and for left quarters those that pass its upper side in the right half."""
    parents = cells.select(
        "region_id", F.col("cx").alias("px"), F.col("cy").alias("py"), F.col("odd").alias("parent_odd")
    )
    of_parent = entries.withColumnsRenamed({"cx": "px", "cy": "py"}).join(
        parents, ["region_id", "px", "py"]
    )
    pieces = _pieces(
        of_parent.select("region_id", "px", "py", "parent_odd", *_EDGE),
        degrees,
        (2 * F.col("px"), 2 * F.col("px") + 1),
    )
    top, middle = 2 * F.col("py") + 2, 2 * F.col("py") + 1
    right = F.col("cx") % 2 != 0

    def passes(row: Column) -> Column:
        return F.sum((right & ((F.col("west_row") >= row) != (F.col("east_row") >= row))).cast("long"))

    sums = pieces.groupBy("region_id", "px", "py", "parent_odd").agg(
        F.sum((right & F.col("beyond") & (F.col("east_row") == middle)).cast("long")).alias("turns"),
        passes(top).alias("over_top"),
        passes(middle).alias("over_middle"),
    )
    given = F.col("parent_odd").cast("long")
    quarters = F.array(
        *[
            F.struct(
                (2 * F.col("px") + dx).alias("cx"),
                (2 * F.col("py") + dy).alias("cy"),
                _odd(*parts).alias("odd"),
            )
            for dx, dy, parts in (
                (1, 1, [given]),
                (1, 0, [given, F.col("turns")]),
                (0, 1, [given, F.col("over_top")]),
                (0, 0, [given, F.col("turns"), F.col("over_middle")]),
            )
        ]
    )
    of_quarter = settle(_entries(pieces, degrees, (2 * F.col("py"), 2 * F.col("py") + 1)))
    counted = of_quarter.groupBy("region_id", "cx", "cy").agg(F.count(F.lit(1)).alias("n"))
    both = sums.select("region_id", F.inline(quarters)).join(counted, ["region_id", "cx", "cy"], "left")
    both = settle(both)
    inside = both.filter(F.col("n").isNull() & F.col("odd")).select("region_id", "cx", "cy")
    return of_quarter, both.filter("n is not null").select("region_id", "cx", "cy", "n", "odd"), inside


def region_cells(
    regions: DataFrame,
    degrees: float = CELL_DEGREES,
    cell_edges: int = CELL_EDGES,
    max_level: int = MAX_LEVEL,
) -> DataFrame:
    """The index: ``level`` (times a cell was halved), ``cx``, ``cy``, ``region_id``, ``odd`` and the
    ``pieces`` of border of every cell that a region's border passes or that lies wholly inside it.

    Each place of a region lies in exactly one of its cells. Only cells of the last level hold more than
    ``cell_edges`` pieces, where so many edges meet within ``degrees / 2 ** max_level``.
    """
    entries = settle(_entries(_pieces(region_edges(regions), degrees), degrees))
    cells, inside = _first_cells(entries)
    found = []
    for level in range(max_level + 1):
        full = F.col("n") > cell_edges
        whole = cells.filter(~full) if level < max_level else cells
        pieces = entries.join(whole.drop("n"), ["region_id", "cx", "cy"])
        found.append(
            pieces.groupBy("region_id", "cx", "cy", "odd")
            .agg(F.collect_list(F.struct(*_EDGE, "west", "east", "turn")).alias("pieces"))
            .unionByName(inside.withColumn("odd", F.lit(True)), allowMissingColumns=True)
            .withColumn("level", F.lit(level))
        )
        dense = cells.filter(full)
        if level == max_level or dense.isEmpty():
            break
        entries, cells, inside = _split(entries, dense, degrees / 2 ** (level + 1))
    return reduce(DataFrame.unionByName, found)


def _at_border(piece: Column, x: Column, y: Column) -> Column:
    ax, ay, bx, by = (piece[c] for c in _EDGE)
    straight = (bx - ax) * (y - ay) == (by - ay) * (x - ax)
    return (
        straight
        & x.between(F.least(ax, bx), F.greatest(ax, bx))
        & y.between(F.least(ay, by), F.greatest(ay, by))
    )


def _meets(piece: Column, x: Column, y: Column) -> Column:
    """Whether the way from a point east, and then up the right side of its cell, meets a piece once."""
    ax, ay, bx, by = (piece[c] for c in _EDGE)
    at = F.try_divide((bx - ax) * (y - ay), by - ay) + ax
    east = ((piece["west"] > y) != (piece["east"] > y)) & F.coalesce(x < at, F.lit(False))
    return east != (piece["turn"] & (piece["east"] > y))


def strictly_inside(odd: Column, pieces: Column, x: Column, y: Column) -> Column:
    """Whether a point of a cell lies within the region; its border is outside."""
    met = F.size(F.filter(pieces, lambda p: _meets(p, x, y)))
    return F.when(pieces.isNull(), odd).otherwise(
        _odd(odd.cast("int"), met) & ~F.exists(pieces, lambda p: _at_border(p, x, y))
    )


def _key(level: Column, x: Column, y: Column, degrees: float) -> Column:
    """Name of the cell of a point at a level, as text, so that hot cells can be named in a filter."""
    size = F.lit(degrees) / F.pow(F.lit(2.0), level)
    return F.concat_ws(":", level, _number(x, size), _number(y, size))


def points_in_regions(
    df: DataFrame,
    regions: DataFrame,
    lon: str = "LON",
    lat: str = "LAT",
    degrees: float = CELL_DEGREES,
    max_bytes: int = BROADCAST_BYTES,
    cell_edges: int = CELL_EDGES,
) -> DataFrame:
    """Inner join of points with the regions they lie strictly within: one row per point and region.

    ``regions`` has ``region_id``, ``name`` and ``ring``, one closed outline, or ``rings``, the outlines of all
    parts and holes. Points with a missing coordinate lie in no region. Points meet regions through the
    cells of `region_cells`; where a cell of the grid was split, its points look in all its levels,
    one of which has an answer for each region. A crowded cell does not become one task (`lookup_join`).
    """
    names = regions.groupBy("region_id").agg(F.min("name").alias("name"))
    index = stored(region_cells(regions, degrees, cell_edges).join(names, "region_id"), "regions")
    located = df.withColumn("_at", point(F.col(lon), F.col(lat))).filter(F.col("_at").isNotNull())
    x, y = F.col("_at.lon"), F.col("_at.lat")
    located = located.withColumn("_cell", _key(F.lit(0), x, y, degrees))
    first = [F.call_function("shiftright", c, F.col("level")) for c in (F.col("cx"), F.col("cy"))]
    deep = index.filter("level > 0").groupBy(F.concat_ws(":", F.lit(0), *first).alias("_cell"))
    deep = settle(deep.agg(F.max("level").alias("_deepest")))
    if not deep.isEmpty():
        located = lookup_join(located, deep, "_cell", "left", max_bytes)
        level = F.explode(F.sequence(F.lit(0), F.coalesce("_deepest", F.lit(0))))
        located = located.withColumn("_level", level)
        located = located.withColumn("_cell", _key(F.col("_level"), x, y, degrees))
    cells = index.select(
        F.concat_ws(":", "level", "cx", "cy").alias("_cell"),
        F.col("odd").alias("_odd"),
        F.col("pieces").alias("_pieces"),
        F.struct("region_id", "name").alias("_region"),
    )
    met = lookup_join(located.select("_cell", "_at", *df.columns), cells, "_cell", "inner", max_bytes)
    return met.filter(strictly_inside(F.col("_odd"), F.col("_pieces"), x, y)).select(
        *df.columns, "_region.region_id", "_region.name"
    )


def active_regions(regions: DataFrame, matched: DataFrame) -> DataFrame:
    """Regions that hold at least one point."""
    return regions.join(matched.select("region_id").distinct(), "region_id", "left_semi")
