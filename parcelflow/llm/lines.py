"""Line deduplication by a segment-partition edit join.

Of two lines within the permitted edits, cut the shorter one into one more segment than edits: at least one
segment stands unchanged in the longer one, shifted by no more than the edits. So lines are indexed by their
segments, by length class, and every line probes the index with its substrings of the sizes that the
segments of lines of its own and a little smaller length have. Lengths and counts of characters rule pairs
out without loss, and banded bit-parallel edit distance decides. Lines connected in this way form a class,
of which the first line in the corpus is kept.

Most substrings are in no index. A table of bits, of fixed size, that the index sets tells tasks which
probes to leave out before anything is shuffled, and a second one, set by the probes that are left, which
segments. Hashes that set the same bits only let through more; what the join finds is the same. Substrings
that are a segment of their own line do not probe: another line with the same segment at the same place has
set its bits as well, so bits set twice tell about these.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.llm.banded import within
from parcelflow.llm.graph import blocked, components
from parcelflow.operators.joins import lookup_join
from parcelflow.llm.tables import settle
from parcelflow.session import discard, passing, stored

# Edits that grow with the line: a twentieth of the longer one's characters, one from 15 characters on. Shorter
# lines, where an edit changes the meaning, are joined only if they are equal.
THRESHOLD = 1
MIN_CHARS = 15
SHARE = 0.05
# Bits of a table as a power of two, bits that a hash sets, and bits of one of the pieces in which a table is
# put together.
TABLE_BITS = 28
HASH_BITS = 4
# Bits set by the substring alone, wherever it stands, which are looked up first.
PLAIN_BITS = 2
PIECE_BITS = 22
# Bits set in one piece by a task; more tasks share the work on a larger corpus.
PIECE_ENTRIES = 16_000_000
# Segments that share a table; more are looked for in turns, by the length of lines.
SEGMENTS = 10_000_000
# Turns in which every line is compared with one line of each signature, and the share of the rows that a turn has
# to settle for another one to follow.
ROUNDS = 2
SETTLED = 0.5
# Lines that one task compares with each other.
BLOCK = 512
# Rows given to one call of the comparison, how many times as many those of one first line may be, and characters
# hashed at once.
CALL = 16_384
CALLS_OF_FIRST = 4
SLICE = 200_000
# White space at the ends of lines.
BLANK = " \t\r\f\v"
# An odd base for polynomial hashes in 64 bits and a second odd number for mixing.
BASE = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xBF58476D1CE4E5B9)
SECOND = np.uint64(0x94D049BB133111EB)
# Characters are counted in so many classes; an edit changes two counts at most by one each.
CLASSES = 16
# Pairs of lines that a task looks at at once.
SEEN = 250_000


def edits(length, threshold: int, share: float):
    """Most edits between two lines of which the longer one has ``length`` characters."""
    return np.maximum(threshold, np.floor(share * np.asarray(length) + 1e-9).astype(np.int64))


def _most(length, threshold: int, share: float):
    """Most edits between a line and any longer one."""
    longest = np.maximum(np.asarray(length) + threshold, np.floor(np.asarray(length) / (1 - share) + 1e-9))
    return edits(longest, threshold, share)


@dataclass(frozen=True)
class Rule:
    """How lines are cut. ``threshold`` edits are permitted, or ``share`` of the longer line if more."""

    threshold: int
    share: float

    def count(self, length: np.ndarray) -> np.ndarray:
        """Segments of lines of these lengths: one more than edits to any line that is not shorter."""
        return _most(length, self.threshold, self.share) + 1

    def length_class(self, length: np.ndarray) -> np.ndarray:
        """Lines within the edits are in the same class or in neighbouring ones."""
        length = np.asarray(length, np.float64)
        if not self.share:
            return (length // (self.threshold + 1)).astype(np.int64)
        # By ratio where the share decides, by difference where the threshold does.
        turn = (self.threshold + 1) / self.share
        by_ratio = np.log(np.maximum(length, 1) / turn) / -np.log1p(-self.share)
        by_step = (length - turn) / (self.threshold + 1)
        return np.floor(np.where(length < turn, by_step, by_ratio)).astype(np.int64)

    def step(self, kind: np.ndarray) -> np.ndarray:
        """Width of the stretches of a line in which its segments are filed: twice the most edits of the
        lines of a length class, so that a segment lies in one of two stretches of any line it is in."""
        if not self.share:
            return np.full(np.shape(kind), 2 * (self.threshold + 1))
        turn = (self.threshold + 1) / self.share
        kind = np.asarray(kind, np.float64) + 1
        longest = np.where(kind <= 0, turn + kind * (self.threshold + 1), turn * (1 - self.share) ** -kind)
        return 2 * self.count(np.ceil(longest).astype(np.int64) + 1)

    @lru_cache(maxsize=1 << 12)  # noqa: B019
    def width(self, kind: int) -> int:
        """``step`` of one length class."""
        return int(self.step(np.array(kind)))

    @lru_cache(maxsize=1 << 16)  # noqa: B019
    def probed(self, length: int) -> list[tuple[int, int]]:
        """Sizes and length classes of the segments that a line of this length may have in common with
        one that is not longer."""
        least = max(1, length - int(edits(length, self.threshold, self.share)))
        lengths = np.arange(least, length + 1)
        classes, (base, rest) = self.length_class(lengths), np.divmod(lengths, self.count(lengths))
        found = set(zip(base.tolist(), classes.tolist(), strict=True))
        longer = rest > 0
        found |= set(zip((base[longer] + 1).tolist(), classes[longer].tolist(), strict=True))
        return sorted(x for x in found if x[0] > 0)


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``BASE`` and of its inverse in 64 bits."""
    inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
    one = np.ones(1, np.uint64)
    return tuple(np.cumprod(np.concatenate((one, np.full(size, x, np.uint64)))) for x in (BASE, inverse))


class Hashed:
    """Hashes of substrings of some lines, which are put in order of their length."""

    def __init__(self, lines: list[str], rule: Rule):
        lengths = np.fromiter(map(len, lines), np.int64, len(lines))
        self.order = np.argsort(lengths, kind="stable")
        self.lengths = lengths[self.order]
        text = "".join([lines[i] for i in self.order.tolist()])
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        power, self.inverse = _powers(max(SLICE * 2, len(codes)))
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum((codes + np.uint64(1)) * power[: len(codes)])))
        self.ends = np.cumsum(self.lengths)
        self.begins = self.ends - self.lengths
        self.inside = np.arange(len(codes)) - np.repeat(self.begins, self.lengths)
        self.rule = rule

    def _mixed(self, x: np.ndarray, size, kind, stretch) -> np.ndarray:
        salt = np.asarray(size).astype(np.uint64) * SECOND + np.asarray(kind).astype(np.uint64) * STEP
        x = x + (salt + stretch.astype(np.uint64) * BASE)
        x = (x ^ (x >> np.uint64(31))) * STEP
        return x ^ (x >> np.uint64(29))

    def _plain(self, x: np.ndarray, size) -> np.ndarray:
        x = (x ^ (x >> np.uint64(32))) * SECOND + np.asarray(size).astype(np.uint64) * BASE
        return x ^ (x >> np.uint64(29))

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Number of the line, place, size and hash of every segment, and the hash that tells nothing of where
        it stands; segments of a line follow each other, the shorter ones first."""
        count = self.rule.count(self.lengths)
        base, rest = np.divmod(self.lengths, count)
        line = np.repeat(np.arange(len(count)), count)
        i = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        extra = np.maximum(0, i - (count - rest)[line])
        place = self.begins[line] + i * base[line] + extra
        size = base[line] + (i >= (count - rest)[line])
        raw = (self.sums[place + size] - self.sums[place]) * self.inverse[place]
        kind = self.rule.length_class(self.lengths)[line]
        stretch = (place - self.begins[line]) // self.rule.step(kind)
        return line, place, size, self._mixed(raw, size, kind, stretch), self._plain(raw, size)

    def probes(self, known: Bits, first_kind: int, last_kind: int) -> tuple[np.ndarray, np.ndarray]:
        """Number of the line and hash of the substrings that ``known`` may have, as segments of these length
        classes, but for own segments."""
        wanted: dict[int, dict[int, list[int]]] = {}
        different = np.unique(self.lengths).tolist()
        for n in different:
            for size, kind in self.rule.probed(n):
                if first_kind <= kind <= last_kind:
                    wanted.setdefault(size, {}).setdefault(kind, []).append(n)
        line, place, size, *_ = self.segments()
        kinds = self.rule.length_class(self.lengths)
        own = np.unique(place * (1 << 20) + np.minimum(size, (1 << 20) - 1))
        lines, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for size, of_kind in wanted.items():
            # Lines are in order of length, so those that probe with a size and class stand together.
            ends = np.array([(x[0], x[-1] + 1) for x in of_kind.values()])
            first, last = np.searchsorted(self.lengths, (ends[:, 0].min(), ends[:, 1].max()))
            begin, end = int(self.begins[first]), int(self.ends[last - 1]) - size + 1
            if end <= begin:
                continue
            raw = self.sums[begin + size : end + size] - self.sums[begin:end]
            raw *= self.inverse[begin:end]
            # Most substrings are no segment anywhere, and those over the end of a line are none.
            at = known.holds(self._plain(raw, size), PLAIN_BITS)
            row = np.searchsorted(self.ends, at + begin, side="right")
            ok = at + begin + size <= self.ends[row]
            at, row = at[ok], row[ok]
            raw = raw[at]
            at += begin
            for kind, lengths in of_kind.items():
                of_lines = np.searchsorted(self.lengths, [lengths[0], lengths[-1] + 1])
                part = slice(*np.searchsorted(row, of_lines))
                # The stretches, numbered in the line, that begin before or after the place less or plus the edits.
                width = self.rule.width(kind)
                inside = self.inside[at[part]]
                low = (inside + (width - width // 2)) // width - 1
                for stretch in (low, low + 1):
                    found = self._mixed(raw[part], size, kind, stretch)
                    held = known.holds(found)
                    whose = row[part][held]
                    mine = (kinds[whose] == kind) & (stretch[held] == inside[held] // width)
                    ok = ~mine | ~_among(at[part][held] * (1 << 20) + min(size, (1 << 20) - 1), own)
                    ok &= stretch[held] >= 0
                    lines.append(whose[ok])
                    hashes.append(found[held[ok]])
        return np.concatenate(lines), np.concatenate(hashes)


def _among(x: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(ordered, x), len(ordered) - 1)
    return ordered[at] == x


def _place(hashes: np.ndarray, i: int) -> np.ndarray:
    """The i-th bit of a hash."""
    return (hashes * (SECOND + np.uint64(2 * i)) if i else hashes) >> np.uint64(64 - TABLE_BITS)


@dataclass(frozen=True)
class Bits:
    """A table of bits."""

    table: np.ndarray

    def __reduce__(self):
        # Few bits are set, and every executor keeps a copy of what is broadcast.
        return _unpacked_bits, (zlib.compress(self.table.tobytes(), 1),)

    def holds(self, hashes: np.ndarray, bits: int = HASH_BITS) -> np.ndarray:
        """Places of the hashes of which all bits are set."""
        at = np.arange(len(hashes))
        for i in range(bits):
            bit = _place(hashes[at] if i else hashes, i)
            byte = self.table[(bit >> np.uint64(3)).astype(np.int64)]
            at = at[(byte >> (bit & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1]
        return at


def _unpacked_bits(packed: bytes) -> Bits:
    return Bits(np.frombuffer(zlib.decompress(packed), np.uint8))


def _bit_pieces(hashes: np.ndarray, plain: np.ndarray | None = None) -> pd.DataFrame:
    """The bits of hashes by piece of the table, each as ascending 32-bit numbers within it."""
    bits = [_place(hashes, i) for i in range(HASH_BITS)]
    if plain is not None:
        bits += [_place(plain, i) for i in range(PLAIN_BITS)]
    bits = np.sort(np.concatenate(bits))
    piece = (bits >> np.uint64(PIECE_BITS)).astype(np.int64)
    number, first = np.unique(piece, return_index=True)
    inside = (bits & np.uint64((1 << PIECE_BITS) - 1)).astype(np.uint32)
    found = [x.tobytes() for x in np.split(inside, first[1:])] if len(bits) else []
    return pd.DataFrame({"piece": number, "bits": found})


def _tables(pieces: DataFrame, entries: int, twice: bool = False) -> list[Bits]:
    """A table of the bits that are set, and with ``twice`` one of those set more than once. Their size is fixed."""
    kind = "piece long, once binary, twice binary"
    size, names = 1 << PIECE_BITS, ["once", "twice"] if twice else ["once"]

    def set_bits(group: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(size, np.uint8)
        for part in group["bits"]:
            # Bits of a row are in order, so equal ones follow each other.
            bits, times = np.unique(np.frombuffer(part, np.uint32), return_counts=True)
            counts[bits] = np.minimum(counts[bits] + np.minimum(times, 2), 2)
        return _packed_rows(group["piece"].iloc[0], counts >= 1, counts >= 2)

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        once, twice = (np.zeros(size // 8, np.uint8) for _ in range(2))
        for a, b in zip(group["once"], group["twice"], strict=True):
            a, b = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
            twice |= b | (once & a)
            once |= a
        return pd.DataFrame({"piece": [group["piece"].iloc[0]], "once": [once.tobytes()], "twice": [twice.tobytes()]})

    shares = 1 + HASH_BITS * entries // (PIECE_ENTRIES << (TABLE_BITS - PIECE_BITS))
    share = F.pmod(F.xxhash64("bits"), F.lit(shares)).alias("share")
    made = pieces.select("*", share).groupBy("piece", "share").applyInPandas(set_bits, kind)
    if shares > 1:
        made = made.groupBy("piece").applyInPandas(merge, kind)
    tables = [np.zeros(1 << (TABLE_BITS - 3), np.uint8) for _ in names]
    for row in settle(made.select("piece", *names)).toLocalIterator():
        part = slice(row["piece"] * (size // 8), (row["piece"] + 1) * (size // 8))
        for table, name in zip(tables, names, strict=True):
            table[part] = np.frombuffer(row[name], np.uint8)
    return [Bits(table) for table in tables]


def _packed_rows(piece: int, once: np.ndarray, twice: np.ndarray) -> pd.DataFrame:
    once, twice = (np.packbits(x, bitorder="little").tobytes() for x in (once, twice))
    return pd.DataFrame({"piece": [piece], "once": [once], "twice": [twice]})


def _counts(lines: list[str]) -> np.ndarray:
    """How many characters of each class a line has, modulo 256."""
    joined = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(lines)), [len(x) for x in lines])
    flat = np.bincount(row * CLASSES + joined % CLASSES, minlength=len(lines) * CLASSES)
    return flat.reshape(len(lines), CLASSES).astype(np.uint8)


def _sliced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of about ``SLICE`` characters, which bounds the memory whatever the lengths of lines are."""
    for batch in batches:
        ends = batch["line"].map(len).cumsum()
        for _, part in batch.groupby(ends // SLICE):
            yield part


def _segment_bits(rule: Rule):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for batch in batches:
                found = [Hashed(x["line"].tolist(), rule).segments()[3:] for x in _sliced(iter([batch]))]
                if found:
                    yield _bit_pieces(*map(np.concatenate, zip(*found, strict=True)))

    return run


def _hash_bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    with np.errstate(over="ignore"):
        for batch in batches:
            yield _bit_pieces(batch["signature"].to_numpy(np.int64).view(np.uint64))


def _rows(part: pd.DataFrame, hashed: Hashed, line: np.ndarray, hashes: np.ndarray) -> pd.DataFrame:
    """Signatures of lines."""
    ids = part["line_id"].to_numpy()[hashed.order[line]]
    found = pd.DataFrame({"line_id": ids, "signature": hashes.view(np.int64)})
    return found.drop_duplicates()


def _shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What rules pairs of lines out: lengths and counts of characters."""
    for part in _sliced(batches):
        lines = part["line"].tolist()
        bags = [x.tobytes() for x in _counts(lines)]
        yield pd.DataFrame({"line_id": part["line_id"].to_numpy(), "n": list(map(len, lines)), "bag": bags})


def _probing(rule: Rule, known, kinds: tuple[int, int]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for part in _sliced(batches):
                hashed = Hashed(part["line"].tolist(), rule)
                yield _rows(part, hashed, *hashed.probes(known.value, *kinds))

    return run


def _indexing(rule: Rule, twice, probed):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for part in _sliced(batches):
                hashed = Hashed(part["line"].tolist(), rule)
                line, _, _, hashes, _ = hashed.segments()
                at = np.union1d(twice.value.holds(hashes), probed.value.holds(hashes))
                yield _rows(part, hashed, line[at], hashes[at])

    return run


def _kept(known):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for batch in batches:
                yield batch.iloc[known.value.holds(batch["signature"].to_numpy(np.int64).view(np.uint64))]

    return run


@dataclass(frozen=True)
class Lengths:
    """Consecutive length classes whose segments a table can hold, with the least and the largest length of
    lines in them, and the largest of lines that probe them."""

    kinds: tuple[int, int]
    least: int
    largest: int
    probing: int


def length_groups(long_lines: DataFrame, rule: Rule) -> list[Lengths]:
    """Length classes in groups of about ``SEGMENTS``; a class is not divided."""
    counts = long_lines.groupBy(F.length("line").alias("n")).count().orderBy("n").collect()
    lengths = np.array([r["n"] for r in counts], np.int64)
    kinds = rule.length_class(lengths)
    segments = np.array([r["count"] for r in counts], np.int64) * rule.count(lengths)
    found, first = [], 0
    while first < len(lengths):
        last, held = first, 0
        while last < len(lengths) and (not held or held < SEGMENTS or kinds[last] == kinds[last - 1]):
            held += int(segments[last])
            last += 1
        probing = lengths[kinds <= kinds[last - 1] + 1][-1]
        ends = (int(kinds[first]), int(kinds[last - 1]))
        found.append(Lengths(ends, int(lengths[first]), int(lengths[last - 1]), int(probing)))
        first = last
    return found


def signatures(long_lines: DataFrame, rule: Rule) -> DataFrame:
    """``line_id`` and ``signature`` of the segments and probes that may meet others."""
    kind = "line_id long, signature long"
    parts = [_signatures(long_lines, rule, group, kind) for group in length_groups(long_lines, rule)]
    empty = long_lines.sparkSession.createDataFrame([], kind)
    return reduce(DataFrame.unionByName, parts, empty)


@passing
def _signatures(long_lines: DataFrame, rule: Rule, group: Lengths, kind: str) -> DataFrame:
    bits = "piece long, bits binary"
    share = long_lines.sparkSession.sparkContext.broadcast
    length = F.length("line")
    indexed = long_lines.filter(length.between(group.least, group.largest))
    asking = long_lines.filter(length.between(group.least, group.probing))
    known, again = map(share, _tables(indexed.mapInPandas(_segment_bits(rule), bits), 2 * SEGMENTS, twice=True))
    probes = stored(asking.mapInPandas(_probing(rule, known, group.kinds), kind), "probes")
    known.destroy()
    wanted = probes.select("signature").mapInPandas(_hash_bits, bits)
    asked = share(_tables(wanted, probes.count())[0])
    index = stored(indexed.mapInPandas(_indexing(rule, again, asked), kind), "index")
    again.destroy()
    asked.destroy()
    # What is left of the index is little, so its table tells well which probes were in vain.
    left = share(_tables(index.select("signature").mapInPandas(_hash_bits, bits), index.count())[0])
    found = stored(probes.mapInPandas(_kept(left), kind).unionByName(index), "signatures")
    left.destroy()
    return found


def _possible(n_a, n_b, bag_a, bag_b, threshold: int, share: float) -> np.ndarray:
    """False for pairs that lengths or counts of characters show to be too different."""
    most = edits(np.maximum(n_a, n_b), threshold, share)
    ok = np.abs(n_a - n_b) <= most
    change = bag_a[ok] - bag_b[ok]
    # Counts are known modulo 256, so the nearer way round is the least change.
    ok[ok] = np.minimum(change, -change).sum(axis=1, dtype=np.int64) <= 2 * most[ok]
    return ok


def _bags(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, CLASSES)


def _near_center(threshold: int, share: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            n, m = x["n"].to_numpy(np.int64), x["m"].to_numpy(np.int64)
            ok = _possible(n, m, _bags(x["bag"]), _bags(x["other"]), threshold, share)
            yield x.loc[ok, ["center", "line_id"]].drop_duplicates().set_axis(["a", "b"], axis=1)

    return run


def _joiner(threshold: int, share: float):
    def join(tasks: pd.DataFrame) -> pd.DataFrame:
        """Pairs of different labels that share a signature and may be within the limit."""
        order = ["signature", "part_a", "part_b"]
        tasks = tasks.sort_values([*order, "n"], ignore_index=True)
        group = tasks.groupby(order, sort=False).ngroup().to_numpy()
        across = (tasks["part_a"] != tasks["part_b"]).to_numpy()
        part, label, n = (tasks[c].to_numpy(np.int64) for c in ("part", "label", "n"))
        ids, own = np.unique(tasks["line_id"].to_numpy(), return_inverse=True)
        bags, limit = _bags(tasks["bag"]).view(np.uint64), edits(n, threshold, share)
        # Lines of a group are sorted by length: those that one may be near to follow it up to some place.
        width = int(n.max()) + 1
        least = group * width + np.maximum(n - limit, 0)
        ahead = np.searchsorted(least, group * width + n, "right") - np.arange(len(n)) - 1
        found, begin, ends = [np.empty(0, np.int64)], 0, np.cumsum(ahead)
        while begin < len(n):
            done = ends[begin - 1] if begin else 0
            end = max(begin + 1, int(np.searchsorted(ends, done + SEEN, "right")))
            times = ahead[begin:end]
            a = np.repeat(np.arange(begin, end), times)
            b = np.arange(len(a)) - np.repeat(np.cumsum(times) - times, times) + a + 1
            ok = label[a] != label[b]
            if across[begin:end].any():
                ok &= ~across[a] | (part[a] != part[b])
            a, b = a[ok], b[ok]
            ok = _changes(bags[a], bags[b]) <= 2 * limit[b]
            x, y = own[a[ok]], own[b[ok]]
            found.append(np.unique(np.minimum(x, y) * len(ids) + np.maximum(x, y)))
            begin = end
        a, b = np.divmod(np.unique(np.concatenate(found)), len(ids))
        return pd.DataFrame({"a": ids[a], "b": ids[b]})

    return join


def _changes(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sum of the differences of counts that are known modulo 256, eight in each word."""
    change = (x.view(np.uint8) - y.view(np.uint8)).view(np.int8)
    change = np.abs(change, out=change).view(np.uint64).reshape(x.shape)
    low = np.uint64(0x00FF00FF00FF00FF)
    lanes = ((change & low) + ((change >> np.uint64(8)) & low)).sum(axis=1)
    return ((lanes * np.uint64(0x0001000100010001)) >> np.uint64(48)).astype(np.int64)


@passing
def _within(pairs: DataFrame, texts: DataFrame, threshold: int, share: float) -> DataFrame:
    """The pairs whose texts are within the limit."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = np.maximum(batch["text_a"].map(len), batch["text_b"].map(len)).to_numpy(np.int64)
            ok = within(batch["text_a"].tolist(), batch["text_b"].tolist(), edits(n, threshold, share))
            yield batch.loc[ok, ["a", "b"]]

    wanted = pairs.select(F.col("a").alias("line_id")).union(pairs.select("b")).distinct()
    own = settle(lookup_join(texts, settle(wanted), "line_id", "inner"))
    both = lookup_join(pairs, own.withColumnsRenamed({"line_id": "a", "line": "text_a"}), "a", "inner")
    both = lookup_join(both, own.withColumnsRenamed({"line_id": "b", "line": "text_b"}), "b", "inner")
    return settle(both.select("a", "b", "text_a", "text_b").mapInPandas(run, "a long, b long"))


def _occurrences(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """A row per line with something in it; ``doc`` tells documents with equal ids apart by text."""
    marked = docs.select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), document_key(docs, doc_id, text).alias("doc")
    )
    lines = marked.select("doc_id", "doc", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("line", F.btrim("line", F.lit(BLANK))).filter("line <> ''")
    return lines.withColumn("line_id", F.xxhash64(F.lit(1), "line"))


def document_key(docs: DataFrame, doc_id: str, text: str) -> Column:
    """Equal for rows with the same id and text only."""
    name = F.coalesce(F.concat(F.lit("i"), F.col(doc_id).cast("string")), F.lit("n"))
    return F.unhex(F.md5(F.concat_ws("\n", name, F.col(text))))


@passing
def _members(long_lines: DataFrame, rule: Rule) -> DataFrame:
    """Signatures that several lines have: ``line_id``, ``signature``, and what rules pairs out."""
    probes = signatures(long_lines, rule)
    met = probes.groupBy("signature").agg(F.min("line_id").alias("low"), F.max("line_id").alias("high"))
    met = settle(met.filter("low <> high").select("signature"))
    # Signatures that only one line has are gone before lengths and counts come along.
    members = lookup_join(probes, met, "signature", "inner").repartition("line_id").distinct()
    shapes = long_lines.mapInPandas(_shapes, "line_id long, n int, bag binary")
    return settle(members.join(shapes, "line_id").select("line_id", "signature", "n", "bag"))


@passing
def _center_links(
    labelled: DataFrame, long_lines: DataFrame, turn: int, threshold: int, share: float
) -> DataFrame:
    """Links of lines with one line of each of their signatures, another one in each turn."""
    drawn = F.min(F.struct(F.xxhash64(F.lit(turn), "line_id").alias("h"), "line_id", "n", "bag", "label"))
    centers = labelled.groupBy("signature").agg(drawn.alias("c"))
    centers = settle(
        centers.select(
            "signature",
            F.col("c.line_id").alias("center"),
            F.col("c.n").alias("m"),
            F.col("c.bag").alias("other"),
            F.col("c.label").alias("own"),
        )
    )
    beside = labelled.join(centers, "signature").filter("label <> own")
    beside = beside.select("center", "line_id", "n", "m", "bag", "other")
    near = beside.mapInPandas(_near_center(threshold, share), "a long, b long")
    return _within(settle(near.distinct()), long_lines, threshold, share)


@passing
def _still_mixed(members: DataFrame, links: DataFrame) -> DataFrame:
    """The rows of signatures whose lines are in different classes, with these as ``label`` and the least line of
    each signature as ``first``."""
    roots = components(links).withColumnRenamed("node", "line_id")
    labelled = lookup_join(members, roots, "line_id")
    labelled = labelled.withColumn("label", F.coalesce("root", "line_id")).drop("root")
    ends = [F.min("label").alias("low"), F.max("label").alias("high"), F.min("line_id").alias("first")]
    mixed = labelled.groupBy("signature").agg(*ends)
    mixed = settle(mixed.filter("low <> high").select("signature", "first"))
    return settle(lookup_join(labelled, mixed, "signature", "inner"))


@passing
def _block_pairs(labelled: DataFrame, threshold: int, share: float) -> DataFrame:
    """Pairs of lines of different classes that share a signature and may be within the limit."""
    # Lines that are alike share many signatures, most with the same first line: these come together, so that a pair
    # is found once and not for each signature. A first line with very many rows has several calls.
    several = F.ceil(F.count(F.lit(1)) / (CALLS_OF_FIRST * CALL)).alias("several")
    crowded = settle(labelled.groupBy("first").agg(several).filter("several > 1"))
    rows = lookup_join(labelled, crowded, "first")
    part = F.pmod(F.xxhash64("signature"), F.coalesce("several", F.lit(1)))
    rows = rows.withColumn("together", F.xxhash64("first", part)).drop("first", "several")
    tasks = settle(blocked(rows, ["signature"], "line_id", BLOCK))
    # Small groups share a call; a call has about ``CALL`` rows.
    calls = max(1, -(-tasks.count() // CALL))
    call = F.pmod(F.xxhash64("together", "part_a", "part_b"), F.lit(calls)).alias("call")
    tasks = tasks.select("signature", "line_id", "n", "bag", "label", "part", "part_a", "part_b", call)
    pairs = tasks.groupBy("call").applyInPandas(_joiner(threshold, share), "a long, b long")
    return settle(pairs.distinct())


@passing
def _linked(long_lines: DataFrame, members: DataFrame, threshold: int, share: float) -> DataFrame:
    """``node`` and ``root`` of the lines that are connected."""
    labelled, links = members.withColumn("label", F.col("line_id")), None
    for turn in range(ROUNDS):
        found = _center_links(labelled, long_lines, turn, threshold, share)
        links = found if links is None else settle(links.unionByName(found))
        before, labelled = labelled, _still_mixed(labelled.drop("label", "first"), links)
        rows, left = before.count(), labelled.count()
        discard(before)
        if left > (1 - SETTLED) * rows:
            break
    found = _within(_block_pairs(labelled, threshold, share), long_lines, threshold, share)
    return components(links.unionByName(found))


def line_links(
    lines: DataFrame, threshold: int = THRESHOLD, min_chars: int = MIN_CHARS, share: float = SHARE
) -> DataFrame:
    """``node`` and ``root`` of the different lines that are connected by few edits: ``threshold``, or
    ``share`` of the longer line if that is more.

    Signatures that only one line has are dropped by counting. In a few rounds every line is compared with
    one line of each of its signatures, which settles large groups; what is then still in different
    classes is compared in blocks.
    """
    least = max(min_chars, threshold + 1)
    different = lines.filter(F.length("line") >= least).select("line_id", "line").distinct()
    long_lines = stored(different, "lines")
    members = _members(long_lines, Rule(threshold, share))
    return _linked(long_lines, members, threshold, share)


def line_classes(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: int = THRESHOLD,
    min_chars: int = MIN_CHARS,
    share: float = SHARE,
) -> DataFrame:
    """A row per line: ``doc_id``, ``doc``, ``line_no`` from 0, the first line of its class by document
    id, number and text (``class_doc_id``, ``class_line_no``), ``class_lines`` and ``kept``.

    White space at the ends of lines does not count; lines of nothing else, and null and empty texts,
    have no row. Rows with a null id come before others. Rows that repeat a document (same id and text)
    are treated alike: their lines stay or go together. Lines shorter than ``min_chars`` are joined
    only if equal, others up to ``threshold`` edits, or ``share`` of the longer line if that is more. Hashes of
    64 bits stand for lines until texts are compared.
    """
    lines = _occurrences(docs, doc_id, text)
    roots = passing(line_links)(lines, threshold, min_chars, share)
    narrow = stored(lines.select("doc_id", "doc", "line_no", "line_id"), "lines")
    joined = lookup_join(narrow, roots.withColumnRenamed("node", "line_id"), "line_id")
    joined = joined.withColumn("class", F.coalesce("root", "line_id")).drop("root", "line_id")
    place = F.struct("doc_id", "line_no", "doc")
    classes = joined.groupBy("class").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    several = settle(classes.filter("n > 1"))
    marked = joined.join(several, "class", "left")
    own = place.eqNullSafe(F.col("first"))
    return marked.select(
        "doc_id",
        "doc",
        "line_no",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_doc_id"),
        F.coalesce("first.line_no", "line_no").alias("class_line_no"),
        F.coalesce("n", F.lit(1)).alias("class_lines"),
        (F.col("n").isNull() | own).alias("kept"),
    )


@passing
def _lines_gone(docs: DataFrame, *options) -> DataFrame:
    """``_doc`` and the numbers of the lines that repeat an earlier one."""
    gone = line_classes(docs, *options).filter(~F.col("kept")).groupBy(F.col("doc").alias("_doc"))
    return settle(gone.agg(F.collect_set("line_no").alias("_gone")))


def drop_repeated_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: int = THRESHOLD,
    min_chars: int = MIN_CHARS,
    share: float = SHARE,
) -> DataFrame:
    """``docs`` with only the first line of each class left in the texts; all rows and columns stay, a
    text without a line left is empty, null stays null."""
    gone = _lines_gone(docs, doc_id, text, threshold, min_chars, share)
    rows = lookup_join(docs.withColumn("_doc", document_key(docs, doc_id, text)), gone, "_doc")
    left = F.filter(
        F.split(text, "\n"), lambda line, i: ~F.array_contains(F.col("_gone"), i)
    )
    cut = F.when(F.col("_gone").isNull(), F.col(text)).otherwise(F.array_join(left, "\n"))
    return rows.withColumn(text, cut).select(docs.columns)
