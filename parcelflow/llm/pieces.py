"""SentencePiece encoding by sampling from the piece lattice, and lossless decoding.

All ways to cut a word into pieces of a given model form a lattice. Forward filtering gives each of its
nodes the total weight of the ways that lead to it; backward sampling then draws a way from the end, a
piece at a time, with the right probability. Random numbers depend on the row key and the place in the
text only. Words (a run of spaces with what follows it, ended by a line break too) share no piece, so
the lattice of a text is that of its words, and equal words are filtered once.

Weights: a piece of rank r counts ``(r + 2) ** -alpha``, a character outside the model, as bytes, the
weight of the last rank for each byte. The model is read, never trained.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import count, islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
ALPHA = 1.0
SEED = 41
SPACE = "▁"
# Stands for a space mark that is in the text itself. Half of a surrogate pair is in no UTF-8 text.
LITERAL = "\ud800"
# Texts taken together: until their different words, and all their words, have so many characters.
DISTINCT = 250_000
SLICE = 2_000_000
# Words sampled at once.
DRAWS = 250_000

# What is left of a hash when its first 20 bits look it up in a table.
FIRST_BITS = np.uint64(44)

# Spaces with what follows them, to the end of a line; a line break on its own is a word too.
WORD = re.compile(f"{SPACE}+[^{SPACE}\n]*\n?|[^{SPACE}\n]+\n?|\n")

_MIX = np.uint64(0xBF58476D1CE4E5B9)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _BASE
    return x ^ (x >> np.uint64(32))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@dataclass
class Vocabulary:
    """Pieces by hash, for all lengths up to ``longest``, and the bytes each id stands for. ``first`` gives
    the place of the first piece with the first bits of a hash, -1 for none; at most ``same`` share them."""

    hashes: np.ndarray
    ids: np.ndarray
    first: np.ndarray
    same: int
    weights: np.ndarray
    longest: int
    byte_ids: np.ndarray
    byte_weight: float
    flat: np.ndarray
    begin: np.ndarray
    size: np.ndarray

    def decode(self, ids: np.ndarray) -> bytes:
        """The text's bytes with the leading space that encoding puts in front."""
        sizes = self.size[ids]
        at = np.repeat(self.begin[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return self.flat[at].tobytes()


def extended(hashes: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """The hashes of substrings that are longer by one character, given as its code plus one."""
    found = (hashes ^ terms) * _BASE
    return found ^ (found >> np.uint64(29))


@cache
def vocabulary(path: str, alpha: float) -> Vocabulary:
    """Normal pieces without a space mark after another character, and the byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    names = [model.id_to_piece(i) for i in range(n)]
    # The model of the piece ranks: its scores fall from piece to piece.
    order = sorted(range(n), key=lambda i: (-model.get_score(i), i))
    rank = np.empty(n)
    rank[order] = np.arange(n)
    byte_ids = np.full(256, -1, np.int64)
    hashes, ids, spelled = [], [], [b""] * n
    for i, name in enumerate(names):
        if model.is_byte(i):
            byte_ids[int(name[1:-1], 16)] = i
            spelled[i] = bytes([int(name[1:-1], 16)])
        elif not (model.is_control(i) or model.is_unknown(i) or SPACE in name.lstrip(SPACE)):
            spelled[i] = name.replace(SPACE, " ").encode()
            whole = np.zeros(1, np.uint64)
            for code in _codes(name):
                whole = extended(whole, np.array([code], np.uint64) + np.uint64(1))
            hashes.append(int(whole[0]))
            ids.append(i)
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces, so not every text can be encoded")
    hashes, ids = np.array(hashes, np.uint64), np.array(ids)
    by_hash = np.argsort(hashes)
    sizes = np.array([len(b) for b in spelled])
    bits, begins, shared = np.unique(hashes[by_hash] >> FIRST_BITS, return_index=True, return_counts=True)
    first = np.full(1 << 20, -1, np.int32)
    first[bits] = begins
    return Vocabulary(
        hashes[by_hash],
        ids[by_hash],
        first,
        int(shared.max()),
        -alpha * np.log(rank[ids[by_hash]] + 2),
        max(len(names[i]) for i in ids),
        byte_ids,
        float(-alpha * np.log(n + 2)),
        np.frombuffer(b"".join(spelled), np.uint8),
        np.cumsum(sizes) - sizes,
        sizes,
    )


class Lattice:
    """Forward-filtered lattices of distinct words.

    Nodes are numbered by place: first the beginnings of all words, then what lies after their first
    character, and so on; within a place longer words come first, so that those that reach it are
    numbered without gaps. ``start`` and ``piece`` are the edges in the order of the nodes that they end
    in, where ``first`` finds them; ``share`` is that of the edges up to this one in what flows into the
    node, so a random number finds its edge.
    """

    def __init__(self, words: list[str], vocab: Vocabulary):
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        by_length = np.argsort(-lengths, kind="stable")
        lengths = lengths[by_length]
        codes = _codes("".join([words[i] for i in by_length.tolist()]))
        # How many words have at least so many characters, and the number of the first node of a place.
        reach = np.searchsorted(-lengths, -np.arange(int(lengths[0]) + 1), side="right")
        # Nodes and places fit into 32 bits, as a slice is small or a single text.
        begin = np.concatenate(([0], np.cumsum(reach))).astype(np.int32)
        lengths = lengths.astype(np.int32)
        rank = np.empty(len(words), np.int32)
        rank[by_length] = np.arange(len(words))
        self.words = len(words)
        self.end = begin[lengths[rank]] + rank

        ends_of_words = np.cumsum(lengths, dtype=np.int32)
        spot = np.arange(len(codes), dtype=np.int32) - np.repeat(ends_of_words - lengths, lengths)
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        left = np.repeat(lengths, lengths) - spot
        starts, ends, pieces, weights = [], [], [], []
        covered = np.zeros(len(codes), bool)

        def add(at: np.ndarray, length: int, piece: np.ndarray, weight: np.ndarray) -> None:
            starts.append(begin[spot[at]] + word[at])
            ends.append(begin[spot[at] + length] + word[at])
            pieces.append(piece.astype(np.int32))
            weights.append(weight)

        for length, at, hashes in self._substrings(codes, left, vocab.longest):
            found = vocab.first[hashes >> FIRST_BITS]
            some = np.nonzero(found >= 0)[0]
            at, hashes, found = at[some], hashes[some], found[some]
            for _ in range(vocab.same - 1):
                # Hashes are in order, so the next one is the only other that it can be.
                found += (vocab.hashes[found] < hashes) & (found + 1 < len(vocab.hashes))
            known = vocab.hashes[found] == hashes
            at, found = at[known], found[known]
            add(at, length, vocab.ids[found], vocab.weights[found])
            if length == 1:
                covered[at] = True
        # Characters without a piece of their own are spelled in bytes: piece -1.
        bare = np.nonzero(~covered)[0]
        value = codes[bare]
        width = 1 + (value > 0x7F) + (value > 0x7FF) + (value > 0xFFFF)
        add(bare, 1, np.full(len(bare), -1), width * vocab.byte_weight)
        self.code_at = np.zeros(begin[-1], np.uint32)
        self.code_at[begin[spot] + word] = codes

        end = np.concatenate(ends)
        order = np.argsort(end, kind="stable")
        end, weight = end[order], np.concatenate(weights)[order]
        self.start, self.piece = np.concatenate(starts)[order], np.concatenate(pieces)[order]
        # Filtering needs its own room.
        del starts, ends, pieces, weights, order, spot, word, left, covered
        # Every node but the beginnings has an edge, as each character has one of its own.
        into = np.bincount(end - len(words), minlength=begin[-1] - len(words))
        firsts = np.concatenate(([0], np.cumsum(into)))
        self.first = firsts[:-1]
        # The nodes of a place are filtered at once.
        total, flow = np.zeros(begin[-1]), np.empty(len(end))
        for low, high in zip(begin[1:-1].tolist(), begin[2:].tolist(), strict=True):
            first = firsts[low - len(words) : high - len(words) + 1]
            a, b, first = first[0], first[-1], first[:-1] - first[0]
            into = total[self.start[a:b]] + weight[a:b]
            node = end[a:b] - low
            most = np.maximum.reduceat(into, first)
            part = np.exp(into - most[node])
            whole = np.add.reduceat(part, first)
            total[low:high] = most + np.log(whole)
            flow[a:b] = part / whole[node]
        # Shares are summed within their nodes; the last edge of a node takes up rounding.
        sums = np.cumsum(flow)
        before = np.concatenate(([0.0], sums))[firsts[:-1]]
        self.share = sums - before[end - len(words)]
        self.share[firsts[1:] - 1] = 1.0

    @staticmethod
    def _substrings(codes: np.ndarray, left: np.ndarray, longest: int):
        """For each length, the places where a substring fits into its word, and its hashes."""
        at, found, terms = np.arange(len(codes)), np.zeros(len(codes), np.uint64), codes.astype(np.uint64)
        terms += np.uint64(1)
        for length in range(1, longest + 1):
            if length > 1:
                fits = np.nonzero(left[at] >= length)[0]
                at, found = at[fits], found[fits]
            if not len(at):
                return
            found = extended(found, terms[at + (length - 1)])
            yield length, at, found

    def sample(self, words: np.ndarray, draws: np.ndarray):
        """A way through the lattice of each word: its piece ids, in reading order, and their number.
        ``draws`` seeds each word; byte pieces are given as -1 - character."""
        node, seeds, active = self.end[words], draws, np.arange(len(words))
        counts, steps = np.zeros(len(words), np.int64), []
        while len(active):
            seeds = _mixed(seeds)
            u = (seeds >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge, later = self.first[node - self.words], np.arange(len(node))
            while len(later):
                later = later[u[later] >= self.share[edge[later]]]
                edge[later] += 1
            piece, node = self.piece[edge], self.start[edge]
            bare = np.nonzero(piece < 0)[0]
            piece[bare] = -1 - self.code_at[node[bare]].astype(np.int32)
            steps.append((active, piece))
            counts[active] += 1
            more = np.nonzero(node >= self.words)[0]
            active, node, seeds = active[more], node[more], seeds[more]
        # Pieces were drawn from the end.
        ids, ends = np.empty(counts.sum(), np.int64), np.cumsum(counts)
        for step, (row, piece) in enumerate(steps):
            ids[ends[row] - 1 - step] = piece
        return ids, counts


def cut_words(text: str) -> list[str]:
    """The words of a marked text: spaces with what follows them; a line break ends a word."""
    return WORD.findall(text)


def marked(text: str) -> str:
    """A space is put in front, and spaces are shown as marks. Where a mark is in the text itself, a
    character that cannot stand in a text holds its place."""
    return SPACE + text.replace(SPACE, LITERAL).replace(" ", SPACE)


def _spelled(ids: np.ndarray, counts: np.ndarray, vocab: Vocabulary):
    """Replaces characters given as -1 - character by their byte pieces."""
    bare = np.nonzero(ids < 0)[0]
    if not len(bare):
        return ids, counts
    row = np.repeat(np.arange(len(counts)), counts)
    value = -1 - ids[bare]
    value = np.where(value == ord(LITERAL), ord(SPACE), value)
    spelled = [chr(v).encode("utf-8", "surrogatepass") for v in value.tolist()]
    width = np.ones(len(ids), np.int64)
    width[bare] = [len(b) for b in spelled]
    out, where = np.repeat(ids, width), np.repeat(ids < 0, width)
    out[where] = vocab.byte_ids[np.frombuffer(b"".join(spelled), np.uint8)]
    return out, np.bincount(np.repeat(row, width), minlength=len(counts))


def encode(texts: list[str], keys: np.ndarray, vocab: Vocabulary) -> list[np.ndarray]:
    """Sampled piece ids of each text; ``keys`` are 64-bit seeds. Equal texts with equal keys get equal
    ids, whatever other texts are beside them."""
    return [ids for part in encode_slices(texts, keys, vocab) for ids in part]


def encode_slices(
    texts: list[str], keys: np.ndarray, vocab: Vocabulary
) -> Iterator[list[np.ndarray]]:
    """The ids of all texts in order, a slice of texts at a time."""
    at: defaultdict[str, int] = defaultdict(count().__next__)
    rows, size, distinct, known, done = [], 0, 0, 0, 0
    for text in texts:
        words = cut_words(marked(text)) if text else []
        rows.append(np.fromiter(map(at.__getitem__, words), np.int32, len(words)))
        size += len(text)
        if len(at) > known:
            # New words stand at the end.
            distinct += sum(map(len, islice(reversed(at), len(at) - known)))
            known = len(at)
        if size > SLICE or distinct > DISTINCT:
            yield _encoded(list(at), rows, keys[done : done + len(rows)], vocab)
            done += len(rows)
            at = defaultdict(count().__next__)
            rows, size, distinct, known = [], 0, 0, 0
    yield _encoded(list(at), rows, keys[done:], vocab)


def _encoded(words: list[str], rows: list[np.ndarray], keys: np.ndarray, vocab: Vocabulary) -> list[np.ndarray]:
    """Sampled piece ids of texts that are given as places in ``words``."""
    if not words:
        return [np.empty(0, np.int32) for _ in rows]
    with np.errstate(over="ignore"):
        lattice = Lattice(words, vocab)
        sizes = np.array([len(r) for r in rows])
        doc = np.repeat(np.arange(len(rows)), sizes)
        place = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        draws = _mixed(keys.astype(np.uint64)[doc] ^ _mixed(place.astype(np.uint64) + _BASE))
        chosen, ids, counts = np.concatenate(rows), [], []
        for i in range(0, len(chosen), DRAWS):
            part = lattice.sample(chosen[i : i + DRAWS], draws[i : i + DRAWS])
            part = _spelled(*part, vocab)
            ids.append(part[0].astype(np.int32))
            counts.append(part[1])
    lengths = np.bincount(doc, weights=np.concatenate(counts), minlength=len(rows)).astype(np.int64)
    return np.split(np.concatenate(ids), np.cumsum(lengths)[:-1])


def decode(ids, vocab: Vocabulary) -> str:
    """The text that was encoded; inverse of ``encode`` for any sample."""
    if not len(ids):
        return ""
    return vocab.decode(np.asarray(ids, np.int64))[1:].decode("utf-8", "surrogatepass")


def encode_column(
    text: Column, key: Column, model: str = MODEL, alpha: float = ALPHA, seed: int = SEED
) -> Column:
    """Struct of ``ids``, a sampled segmentation seeded by ``key`` (a long), and ``lossless``, whether
    decoding gives the text back. Null texts give null ids, empty ones none; both are lossless. The
    model file must be at this path on every executor."""

    @F.pandas_udf("ids array<int>, lossless boolean")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        vocab = vocabulary(model, alpha)
        for texts, keys in batches:
            given, seeds = texts.tolist(), keys.to_numpy(dtype=np.int64).view(np.uint64)
            done = 0
            # A slice is given back before the next one is encoded.
            for part in encode_slices([t or "" for t in given], seeds, vocab):
                mine = given[done : done + len(part)]
                done += len(part)
                same = [decode(ids, vocab) == (t or "") for t, ids in zip(mine, part, strict=True)]
                found = [None if t is None else ids for t, ids in zip(mine, part, strict=True)]
                yield pd.DataFrame({"ids": found, "lossless": same})

    return run(text, F.xxhash64(F.lit(seed), key))


def decode_column(ids: Column, model: str = MODEL) -> Column:
    """The text of piece ids; null for null."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocab = vocabulary(model, ALPHA)
        for column in batches:
            yield pd.Series([None if x is None else decode(x, vocab) for x in column])

    return run(ids)


def encode_documents(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", copies: bool = False, **options
) -> DataFrame:
    """``docs`` with ``ids``, ``n_ids`` (0 for null) and ``lossless``; columns of these names are
    replaced, all others and all rows stay. The id seeds the sample; rows with a null id share a seed.
    With ``copies``, rows of equal id and text are numbered and each gets a sample of its own."""
    kept = [c for c in docs.columns if c not in ("ids", "n_ids", "lossless")]
    key = F.xxhash64(F.col(doc_id).cast("string"))
    rows = docs
    if copies:
        equal = Window.partitionBy(doc_id, F.xxhash64(text)).orderBy(F.lit(0))
        rows = docs.withColumn("_pieces_copy", F.row_number().over(equal))
        # The first copy has the sample that it has without.
        key = F.when(F.col("_pieces_copy") > 1, F.xxhash64(key, "_pieces_copy")).otherwise(key)
    rows = rows.withColumn("_coded", encode_column(F.col(text), key, **options))
    return rows.select(
        *kept,
        F.col("_coded.ids").alias("ids"),
        F.coalesce(F.size("_coded.ids"), F.lit(0)).alias("n_ids"),
        F.col("_coded.lossless").alias("lossless"),
    )
