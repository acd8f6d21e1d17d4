"""Place names: joins to the gazetteer and free-text search in dictionaries of any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property, lru_cache, partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelflow.functions.lookup import INLINE_NAMES, first_match_in_text
from parcelflow.functions.text import fold
from parcelflow.operators.joins import lookup_join
from parcelflow.session import BROADCAST_ROWS, at_most, fits, settle, stored

# Bytes of the beginnings by which names are looked for first; a shorter name is its own beginning.
PIECE_SIZES = (8, 4)

# Bits of the table that tells which stretches of a text may be names: so many for each name, as powers of two
# within these; bits that a hash sets, and bits of the blocks in which the table is put together.
NAME_BITS, LEAST_BITS, MOST_BITS = 64, 20, 29
HASH_BITS = 4
BLOCK_BITS = 1 << 16
# Hashes of names that a task puts together before it passes them on.
PACK_HASHES = 1 << 20

# Bytes of texts that are cut at once, and texts that a task remembers.
CUT_BYTES = 1 << 20
SEEN_TEXTS = 100_000

# Odd numbers for the hashes of 64 bits.
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def attach_coordinates(df: DataFrame, gazetteer: DataFrame, city: str = "CITY") -> DataFrame:
    """Left join of ``LAT`` and ``LON`` by exact place name."""
    places = gazetteer.select(F.col("CITY").alias(city), "LAT", "LON")
    return lookup_join(df, places, city).select(*df.columns, "LAT", "LON")


def first_match_join(
    df: DataFrame,
    text: str,
    dictionary: DataFrame,
    result: str,
    mode: str = "first_match",
    hyphen_as_space: bool = False,
    inline: int = INLINE_NAMES,
    made: NameTables | None = None,
) -> DataFrame:
    """`functions.lookup.first_match` for dictionaries in a table, however large.

    ``dictionary`` holds ``(priority, name)``. Up to ``inline`` names are written into the plan, which needs
    no shuffle. Beyond, texts are searched where they are: a table of bits, set by the names, tells at which places
    a name may begin, and which stretches from there, of the lengths that names have, may be one. Only these
    stretches are joined with the names, so there are no more of them than a text has places and names have lengths,
    however many names share a beginning. Of the names in a text only the least (``first_match``:
    priority, then name; ``longest_match``: longest first) is kept. For ``longest_match`` the long names come
    first, and shorter ones are looked for in the texts that have none of them. A task searches equal texts
    once, as far as it remembers them. Null names and texts match nothing. ``made`` holds what several searches
    in one dictionary share.
    """
    if mode not in ("first_match", "longest_match"):
        raise ValueError(mode)
    if mode == "first_match" and not hyphen_as_space and at_most(dictionary, inline):
        known = dictionary.filter("name IS NOT NULL").orderBy("priority", "name")
        ordered = [row["name"] for row in known.collect()]
        return df.withColumn(result, first_match_in_text(F.col(text), ordered))
    keyed = df.withColumn("_text", F.unhex(F.substring(F.sha2(F.col(text), 256), 1, 32)))
    texts = keyed.select("_text", fold(F.col(text)).alias("body")).filter("_text IS NOT NULL")
    found = _least_names(texts, (made or NameTables(dictionary)).tiers(mode, hyphen_as_space))
    named = lookup_join(keyed, found.withColumnRenamed("name", "_found"), "_text")
    return named.withColumn(result, F.col("_found")).select(*dict.fromkeys([*df.columns, result]))


def _names(dictionary: DataFrame, mode: str, hyphen_as_space: bool) -> DataFrame:
    """``probe`` to look for, the least ``rank`` of its names, and ``tier``: all names of a tier come before
    those of a lower one."""
    probe = fold(F.col("name"))
    probe = F.replace(probe, F.lit("-"), F.lit(" ")) if hyphen_as_space else probe
    length = F.length("name") if mode == "longest_match" else F.lit(0)
    rank = F.struct((-length).alias("shorter"), "priority", "name")
    names = dictionary.select(probe.alias("probe"), rank.alias("rank")).filter(F.length("probe") > 0)
    # Written first, as Spark would drop a `distinct` of the dictionary below the aggregate, and sort all its rows.
    least = stored(names, "names").groupBy("probe").agg(F.min("rank").alias("rank"))
    tier = _size(-F.col("rank.shorter")).alias("tier")
    return stored(least.select(F.col("probe").cast("binary").alias("probe"), "rank", tier), "names")


def _size(length: Column) -> Column:
    """Size of the pieces of a length class."""
    size = length
    for known in sorted(PIECE_SIZES):
        size = F.when(length >= known, known).otherwise(size)
    return size


def _tiers(names: DataFrame) -> list[Tier]:
    """The names of each tier and what is looked for, in the order in which they are."""
    length = F.octet_length("probe")
    kinds = names.groupBy("tier", _size(length).alias("size"), length.alias("length")).count().collect()
    made = []
    for tier in sorted({kind["tier"] for kind in kinds}, reverse=True):
        lengths: dict[int, list[int]] = {}
        for kind in (kind for kind in kinds if kind["tier"] == tier):
            lengths.setdefault(kind["size"], []).append(kind["length"])
        count = sum(kind["count"] for kind in kinds if kind["tier"] == tier)
        own = names.filter(F.col("tier") == tier).drop("tier")
        made.append(Tier(own, count, Wanted(_table(own, count), lengths)))
    return made


def _least_names(texts: DataFrame, tiers: Sequence[Tier]) -> DataFrame:
    """``_text`` and the least ``name`` in it, for texts with any."""
    texts = stored(texts, "texts") if len(tiers) > 1 else texts
    found = [texts.select("_text", F.lit(None).cast("string").alias("name")).limit(0)]
    for tier in tiers:
        if tier is not tiers[0]:
            texts = stored(texts.join(found[-1], "_text", "left_anti"), "texts")
        hits = stored(_text_pieces(texts, sorted(tier.wanted.lengths), tier.wanted), "hits")
        own = tier.names
        if tier.count > BROADCAST_ROWS:
            probes = settle(hits.select("probe").distinct())
            own = settle(own.join(F.broadcast(probes), "probe")) if fits(probes) else own
        met = lookup_join(hits, own, "probe", "inner")
        least = met.groupBy("_text").agg(F.min("rank").alias("least"))
        found.append(settle(least.select("_text", "least.name")))
    return reduce(DataFrame.unionByName, found[1:] or found)


class NameTables:
    """What searches need of the names of a dictionary; made once for each way of looking for them."""

    def __init__(self, dictionary: DataFrame):
        self.dictionary, self.made = dictionary, {}

    @cached_property
    def hyphens(self) -> bool:
        """Whether any name is looked for in another way if its hyphens match spaces."""
        return not self.dictionary.filter(F.contains(fold(F.col("name")), F.lit("-"))).isEmpty()

    def tiers(self, mode: str, hyphen_as_space: bool) -> list[Tier]:
        way = (mode, hyphen_as_space and self.hyphens)
        if way not in self.made:
            self.made[way] = _tiers(_names(self.dictionary, *way))
        return self.made[way]


@dataclass(frozen=True, eq=False)
class Tier:
    """Names that are looked for together, and their number."""

    names: DataFrame
    count: int
    wanted: Wanted


@dataclass(frozen=True)
class Wanted:
    """What is looked for: a broadcast table of bits, and the lengths of names by the size of their beginning."""

    table: Broadcast
    lengths: dict[int, list[int]]


def _text_pieces(texts: DataFrame, sizes: list[int], wanted: Wanted) -> DataFrame:
    """The different stretches of each text that may be a name with a beginning of one of the ``sizes``, by
    the table; long texts stay out of the rows."""
    return texts.mapInArrow(partial(_cut_texts, sizes, wanted), "_text binary, probe binary")


def _table(names: DataFrame, count: int) -> Broadcast:
    """A broadcast table in which the bits of each ``probe`` and of its beginning are set. Its size has a limit, from
    which on it lets more and more stretches pass."""
    bits = min(max(LEAST_BITS, (count * NAME_BITS).bit_length()), MOST_BITS)
    packed = names.select("probe").mapInArrow(partial(_name_bits, bits), "block long, bits binary")
    blocks = packed.groupBy("block").applyInPandas(_block, "block long, bits binary").collect()
    table = np.zeros((1 << bits) // 8, np.uint8)
    for row in blocks:
        begin = row["block"] * (BLOCK_BITS // 8)
        table[begin : begin + BLOCK_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    return names.sparkSession.sparkContext.broadcast(table)


def _block(rows: pd.DataFrame) -> pd.DataFrame:
    bits = np.zeros(BLOCK_BITS, bool)
    for part in rows["bits"]:
        bits[np.frombuffer(part, np.uint16)] = True
    packed = np.packbits(bits, bitorder="little").tobytes()
    return pd.DataFrame({"block": [rows["block"].iloc[0]], "bits": [packed]})


def _bit(hashes: np.ndarray, i: int, bits: int) -> np.ndarray:
    """The i-th bit of a hash in a table."""
    return (hashes * (BASE + np.uint64(2 * i))) >> np.uint64(64 - bits)


def _held(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Places of the hashes of which all bits are set."""
    bits = (len(table) * 8).bit_length() - 1
    at = np.arange(len(hashes))
    for i in range(HASH_BITS):
        bit = _bit(hashes[at] if i else hashes, i, bits)
        byte = table[bit >> np.uint64(3)]
        at = at[(byte >> (bit & np.uint64(7)).astype(np.uint8)) & 1 == 1]
    return at


def _name_bits(bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bits of names and their beginnings, by block of the table."""

    def own(lengths: np.ndarray) -> list[tuple[int, np.ndarray]]:
        return [(int(n), lengths == n) for n in np.unique(lengths)]

    def packed(hashes: list[np.ndarray]) -> pa.RecordBatch:
        every = np.concatenate(hashes)
        # Places have less than 32 bits, and are sorted in a fraction of the time that finding the different ones takes.
        place = np.sort(np.concatenate([_bit(every, i, bits).astype(np.uint32) for i in range(HASH_BITS)]))
        place = place[np.append(True, place[1:] != place[:-1])]
        number = place // np.uint32(BLOCK_BITS)
        first = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
        inside = (place % np.uint32(BLOCK_BITS)).astype(np.uint16)
        parts = [x.tobytes() for x in np.split(inside, first[1:])]
        return pa.RecordBatch.from_arrays(
            [pa.array(number[first].astype(np.int64)), pa.array(parts, pa.binary())], names=["block", "bits"]
        )

    kept, count = [], 0
    for batch in batches:
        probes = batch.column("probe").cast(pa.binary())
        lengths = pc.binary_length(probes).to_numpy(zero_copy_only=False)
        sizes = lengths
        for known in sorted(PIECE_SIZES):
            sizes = np.where(lengths >= known, known, sizes)
        for size in np.unique(sizes):
            heads = pc.binary_slice(probes.filter(pa.array(sizes == size)), 0, int(size))
            kept += [hashes.view(np.uint64) for _, hashes in _pieces(heads, own)]
        offsets, data = _bytes(probes)
        begin = 0
        while begin < len(lengths):
            stop = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + CUT_BYTES, "right")) - 1)
            sums = _sums(data[offsets[begin] : offsets[stop]])
            kept.append(_stretches(sums, offsets[begin:stop] - offsets[begin], lengths[begin:stop]))
            begin = stop
        count += 2 * len(lengths)
        if count >= PACK_HASHES:
            yield packed(kept)
            kept, count = [], 0
    if count:
        yield packed(kept)


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``BASE`` and of its inverse in 64 bits."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    one = np.ones(1, np.uint64)
    return tuple(np.cumprod(np.concatenate((one, np.full(size, x, np.uint64)))) for x in (BASE, inverse))


def _power(size: int) -> tuple[np.ndarray, np.ndarray]:
    return _powers(max(CUT_BYTES, 1 << int(size).bit_length()))


def _sums(data: np.ndarray) -> np.ndarray:
    """Sums from which `_stretches` takes the hash of any stretch of ``data``."""
    power, _ = _power(len(data))
    terms = (data.astype(np.uint64) + np.uint64(1)) * power[: len(data)]
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms)))


def _stretches(sums: np.ndarray, at: np.ndarray, size) -> np.ndarray:
    """Hashes of the stretches of ``size`` bytes from the places ``at``."""
    _, inverse = _power(len(sums) - 1)
    hashes = (sums[at + size] - sums[at]) * inverse[at] + np.atleast_1d(np.asarray(size, np.uint64)) * MIX
    hashes = (hashes ^ (hashes >> np.uint64(32))) * MIX
    return hashes ^ (hashes >> np.uint64(29))


def _bytes(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where values begin and end, and the bytes of all."""
    offsets = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    return offsets.astype(np.int64), np.frombuffer(values.buffers()[2] or b"", np.uint8)


def _windows(data: np.ndarray, size: int) -> np.ndarray:
    """Hashes of all pieces of ``size`` bytes."""
    count = max(0, len(data) - size + 1)
    hashes = np.full(count, size, np.uint64)
    for i in range(size):
        hashes *= np.uint64(0x9E3779B97F4A7C15)
        hashes += data[i : i + count]
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0xD6E8FEB86659FD93)
    hashes ^= hashes >> np.uint64(29)
    return hashes


def _pieces(
    values: pa.Array, sizes_of: Callable[[np.ndarray], Sequence[tuple[int, np.ndarray | None]]]
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and hashes of the pieces inside each value, a stretch of bytes at a time; ``sizes_of`` gives
    the sizes for the lengths of the values, each with the rows it is for."""
    for row, _, hashes in _places(values, sizes_of):
        yield row, hashes.view(np.int64)


def _places(
    values: pa.Array, sizes_of: Callable[[np.ndarray], Sequence[tuple[int, np.ndarray | None]]], table=None
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """`_pieces` with the places of the pieces, of those that ``table`` may have."""
    if not len(values):
        return
    offsets, data = _bytes(values)
    ends = offsets[1:]
    chosen = [(size, rows) for size, rows in sizes_of(np.diff(offsets))]
    for begin in range(int(offsets[0]), int(offsets[-1]), CUT_BYTES):
        stop = min(begin + CUT_BYTES, int(offsets[-1]))
        for size, rows in chosen:
            hashes = _windows(data[begin : min(stop + size - 1, int(offsets[-1]))], size)
            held = np.arange(len(hashes)) if table is None else _held(table, hashes)
            at, hashes = held + begin, hashes[held]
            row = np.searchsorted(ends, at, "right")
            keep = at + size <= ends[row]
            if rows is not None:
                keep &= rows[row]
            yield row[keep], at[keep], hashes[keep]


def _cut_texts(sizes: list[int], wanted: Wanted, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, seen = wanted.table.value, set()
    for batch in batches:
        own = batch.column("_text").to_pylist()
        new = []
        for i, key in enumerate(own):
            if key not in seen:
                new.append(i)
                if len(seen) < SEEN_TEXTS:
                    seen.add(key)
        if len(new) < len(own):
            batch = batch.take(pa.array(new, pa.int64()))
        texts, values = batch.column("_text"), batch.column("body").cast(pa.string())
        for size in sizes:
            for row, at, _ in _places(values, lambda _, n=size: [(n, None)], table):
                if len(at):
                    yield from _names_at(texts, values, row, at, wanted.lengths[size], table)


def _names_at(
    texts: pa.Array, values: pa.Array, row: np.ndarray, at: np.ndarray, lengths: list[int], table: np.ndarray
) -> Iterator[pa.RecordBatch]:
    """The stretches from the places ``at`` that may be names of these lengths."""
    offsets, data = _bytes(values)
    begin, last = int(at[0]), min(int(at[-1]) + max(lengths), int(offsets[-1]))
    data, place, left = data[begin:last], at - begin, offsets[row + 1] - at
    sums = _sums(data)
    for length in lengths:
        inside = np.flatnonzero(left >= length)
        hashes = _stretches(sums, place[inside], length)
        held = _held(table, hashes)
        found, hashes = inside[held], hashes[held]
        if len(found):
            found = found[np.lexsort((hashes, row[found]))]
            stretches = np.lib.stride_tricks.sliding_window_view(data, length)[place[found]]
            # Stretches that are repeated in a text stand together, unless others have their hash.
            new = np.ones(len(found), bool)
            new[1:] = (row[found[1:]] != row[found[:-1]]) | (stretches[1:] != stretches[:-1]).any(axis=1)
            found, stretches = found[new], stretches[new]
            probes = pa.FixedSizeBinaryArray.from_buffers(
                pa.binary(length), len(found), [None, pa.py_buffer(np.ascontiguousarray(stretches))]
            )
            columns = [texts.take(pa.array(row[found])), probes.cast(pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["_text", "probe"])
