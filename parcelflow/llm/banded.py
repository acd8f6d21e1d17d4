"""Edit distance within a band, bit-parallel: of one pair, or of many pairs of texts side by side."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

# Pairs whose columns are computed side by side, and words of 64 bits that their tables of places may have.
SIDE_BY_SIDE = 2048
TABLE_WORDS = 1 << 21
# Characters that are told apart in a table; with more different ones in its texts, some share a place.
ALPHABET = 128
# The widest band of rows in a word.
WORD = 64
# Columns after which pairs that are above their limit are left out.
COLUMNS = 16


def edit_distance(a: Sequence, b: Sequence, most: int) -> int:
    """Insertions, deletions and replacements that turn ``a`` into ``b``; ``most + 1`` if there are more
    than ``most``. Works on strings and on lists of hashable items.

    The columns of the distance matrix are bit vectors of the vertical steps +1 and -1 in a band of
    ``2 * most + 1`` rows around the diagonal, which moves down one row per column.
    """
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    first, end = 0, len(a)
    while first < end and a[first] == b[first]:
        first += 1
    off = len(b) - len(a)
    while end > first and a[end - 1] == b[end - 1 + off]:
        end -= 1
    a, b = a[first:end], b[first : end + off]
    if not a:
        return min(len(b), most + 1)
    if most <= 0:
        return 1
    rows, band = len(a), 2 * most + 1
    full = (1 << band) - 1
    places: dict = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | (1 << i)
    # Bit r of column j stands for row j - most + r; row 0 is the border.
    up, down = ((1 << (most + 1)) - 1) << most, 0
    distance, top = min(rows, most), 1 << (2 * most)
    for j, y in enumerate(b, 1):
        match = places.get(y, 0)
        shift = j - most - 1
        match = (match >> shift if shift >= 0 else match << -shift) & full
        diagonal = (((match & up) + up) ^ up | match | down) & full
        plus = (down | ~(diagonal | up)) & full
        minus = diagonal & up
        if j <= rows - most:
            # Along the lower edge of the band until the last row is reached ...
            distance += not diagonal & top
        else:
            # ... then along the last row.
            bit = rows - j + most
            distance += (plus >> bit & 1) - (minus >> bit & 1)
        shifted = diagonal >> 1
        up = (minus | ~(shifted | plus)) & full
        down = shifted & plus
        # No row of the band is less than its last one by more than the steps up on the way.
        if not j % COLUMNS and j <= rows - most and distance - up.bit_count() > most:
            return most + 1
    return min(distance, most + 1)


def within(a: Sequence[str], b: Sequence[str], most: np.ndarray) -> np.ndarray:
    """Which pairs of texts are no more than ``most`` edits apart."""
    pairs = [(x, y) if len(x) <= len(y) else (y, x) for x, y in zip(a, b, strict=True)]
    rows, columns = (np.array([len(pair[i]) for pair in pairs], np.int64) for i in (0, 1))
    most = np.asarray(most, np.int64)
    found = columns - rows <= most
    # A path that ends ``columns - rows`` beside the diagonal has no edits to stray further than this.
    above, below = (most + columns - rows) // 2, (most - columns + rows) // 2
    wide = found & ((above + below + 1 > WORD) | (rows == 0))
    for i in np.flatnonzero(wide).tolist():
        found[i] = edit_distance(*pairs[i], int(most[i])) <= most[i]
    left = np.flatnonzero(found & ~wide)
    left = left[np.argsort(columns[left], kind="stable")]
    while len(left):
        words = int(columns[left[: SIDE_BY_SIDE]].max()) // 64 + 4
        size = max(1, min(SIDE_BY_SIDE, TABLE_WORDS // (words * ALPHABET)))
        part, left = left[:size], left[size:]
        texts = [pairs[i] for i in part.tolist()]
        ok, told = _side_by_side(texts, rows[part], columns[part], above[part], below[part], most[part])
        if not told:
            for i in np.flatnonzero(ok).tolist():
                ok[i] = edit_distance(*texts[i], int(most[part[i]])) <= most[part[i]]
        found[part] = ok
    return found


def _side_by_side(texts, rows, columns, above, below, most) -> tuple[np.ndarray, bool]:
    """Which pairs are within their limits, and whether all characters were told apart; if not, pairs that are
    too different may be among those found. The columns are those of `edit_distance`, in a word each."""
    one, count = np.uint64(1), len(texts)
    places: dict[str, int] = {}
    owner = np.array([places.setdefault(x, len(places)) for x, _ in texts], np.int64)
    lengths = np.array([len(x) for x in places], np.int64)
    across = "".join([y for _, y in texts]).encode("utf-32-le", "surrogatepass")
    down = "".join(places).encode("utf-32-le", "surrogatepass")
    code = np.frombuffer(down + across, np.uint32)
    known = np.zeros(int(code.max()) + 1, bool)
    known[code] = True
    code, kinds = (np.cumsum(known) - 1)[code], int(known.sum())
    told = kinds <= ALPHABET
    if not told:
        code, kinds = code % ALPHABET, ALPHABET
    down, across = np.split(code, [int(lengths.sum())])
    # For every different shorter text and character, the places where it stands, after a word without any.
    words = int(lengths.max()) // 64 + 4
    text = np.repeat(np.arange(len(places)), lengths)
    place = np.arange(len(down)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + 64
    table = np.zeros(len(places) * kinds * words, np.uint64)
    np.bitwise_or.at(table, (text * kinds + down) * words + (place >> 6), one << (place & 63).astype(np.uint64))
    begin = np.cumsum(columns) - columns
    own, ok = np.arange(count), np.zeros(count, bool)
    band = (above + below + 1).astype(np.uint64)
    full = np.where(band == 64, ~np.uint64(0), (one << band) - one)
    up = full & ~((one << above.astype(np.uint64)) - one)
    fall, distance = np.zeros(count, np.uint64), np.minimum(rows, below)
    top, base = (above + below).astype(np.uint64), owner * kinds
    for j in range(1, int(columns.max()) + 1):
        symbol = across[begin + (j - 1)]
        bit = j - above + 63
        at = (base + symbol) * words + (bit >> 6)
        shift = (bit & 63).astype(np.uint64)
        match = (table[at] >> shift) | (table[at + 1] << one << (np.uint64(63) - shift))
        match &= full
        diagonal = ((((match & up) + up) ^ up) | match | fall) & full
        plus = (fall | ~(diagonal | up)) & full
        minus = diagonal & up
        # Along the lower edge of the band until the last row is reached, then along the last row.
        last = np.maximum(rows - j + above, 0).astype(np.uint64)
        along = ((plus >> last) & one).astype(np.int64) - ((minus >> last) & one).astype(np.int64)
        distance += np.where(j <= rows - below, 1 - ((diagonal >> top) & one).astype(np.int64), along)
        diagonal >>= one
        up = (minus | ~(diagonal | plus)) & full
        fall = diagonal & plus
        ended = columns == j
        if j % COLUMNS == 0 or ended.any():
            ok[own[ended]] = distance[ended] <= most[ended]
            still = ~ended & ((distance - np.bitwise_count(up) <= most) | (j > rows - below))
            if not still.any():
                break
            if not still.all():
                own, begin, rows, columns, above, below, most, full, up, fall, distance, top, base = (
                    x[still]
                    for x in (own, begin, rows, columns, above, below, most, full, up, fall, distance, top, base)
                )
    return ok, told
