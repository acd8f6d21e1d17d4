"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document is the set of its runs of two words, each labelled by how often it has occurred before. A
sketch takes the runs with the smallest hashes under one random order and puts them in text order, so
documents share a sketch if they share these runs in the same order: as their edit similarity is high.
Documents that share a sketch are candidates; word edit distance in a band decides.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.llm.banded import edit_distance
from parcelflow.llm.graph import blocked, components
from parcelflow.operators.joins import lookup_join
from parcelflow.llm.tables import settle
from parcelflow.session import discard, passing, stored

# An edit changes two runs of two words at most, so texts at the limit of 0.8 share at least 0.43 of their
# runs wherever the edits are. A long pair meets in a sketch with a chance of about the square, and in none
# of 48 with about 0.00006 there; texts with fewer edits miss more rarely. Of u runs with s shared it is
# s (s - 1) / (u (u - 1)): ten words with two replaced miss with 0.0014, five with the middle one with 0.04.
WORDS = 2
SIMILARITY = 0.8
SKETCHES = 48
RUNS = 2
# Turns in which every document is compared with one center: they go on while a turn finds links for this part
# of its pairs and more pairs of different classes share a sketch than so many for each row, as all of
# these are compared then.
ROUNDS = 16
YIELD = 0.02
LEFT = 4
# Documents compared with one center in a task, and candidates compared with each other.
CENTER_BLOCK = 32
BLOCK = 4_096
# Rows given to one call of the comparison.
CALL = 16_384
SEED = 29
# Classes in which words are counted. Two texts cannot share more words than their counts share, so pairs
# that share too few are no candidates; counting by class never loses a link. The counts of a text are
# kept in the shortest numbers that hold them all.
CLASSES = 256
BAG_TYPES = {CLASSES * np.dtype(t).itemsize: t for t in (np.uint8, np.uint16, np.uint32)}
# Numbers in a table of hashes.
TABLE = 1_000_000

_MIX = np.uint64(0xBF58476D1CE4E5B9)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers one to one."""
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def text_key(text: Column) -> Column:
    """Equal for equal texts; null for null and for texts without a word."""
    return F.when(text.rlike(r"\S"), F.unhex(F.md5(text)))


def words_of(text: str) -> list[str]:
    return text.lower().split()


def _word_hashes(words: list[str]) -> np.ndarray:
    """Hash of each word, from its UTF-8 bytes."""
    distinct = {w: i for i, w in enumerate(dict.fromkeys(words))}
    data = [w.encode("utf-8", "surrogatepass") for w in distinct]
    sizes = np.array([len(d) for d in data])
    flat = np.frombuffer(b"".join(data), np.uint8).astype(np.uint64)
    ends = np.cumsum(sizes)
    place = np.arange(len(flat)) - np.repeat(ends - sizes, sizes)
    parts = _mixed((flat + np.uint64(1)) * _MIX + _mixed(place.astype(np.uint64) + np.uint64(7)))
    sums = np.add.reduceat(parts, ends - sizes)
    hashes = _mixed(sums + sizes.astype(np.uint64))
    return hashes[np.fromiter((distinct[w] for w in words), np.int64, len(words))]


class Sketcher:
    """Order MinHash sketches of word sequences."""

    def __init__(self, words: int, sketches: int, runs: int, seed: int):
        self.words, self.runs = words, runs
        rng = np.random.default_rng(seed)
        self.factors = rng.integers(0, 1 << 63, sketches, dtype=np.uint64) | np.uint64(1)
        self.offsets = rng.integers(0, 1 << 63, sketches, dtype=np.uint64)

    def runs_of(self, hashes: np.ndarray) -> np.ndarray:
        """Hashes of runs of words with their occurrence; a shorter text is one run."""
        k = min(self.words, len(hashes))
        runs = np.zeros(len(hashes) - k + 1, np.uint64)
        for i in range(k):
            runs = _mixed(runs * np.uint64(31) + hashes[i : i + len(runs)])
        order = np.argsort(runs, kind="stable")
        ordered = runs[order]
        new = np.concatenate(([True], ordered[1:] != ordered[:-1]))
        since = np.arange(len(runs)) - np.maximum.accumulate(np.where(new, np.arange(len(runs)), 0))
        occurrence = np.empty(len(runs), np.uint64)
        occurrence[order] = since
        return _mixed(runs + occurrence * np.uint64(0x9E3779B97F4A7C15))

    def sketch(self, words: list[str]) -> np.ndarray:
        """A hash per sketch: of the smallest runs in text order."""
        return self.sketch_of(_word_hashes(words))

    def sketch_of(self, hashes: np.ndarray) -> np.ndarray:
        """``sketch`` of a text given as the hashes of its words."""
        runs = self.runs_of(hashes)
        take = min(self.runs, len(runs))
        found = np.arange(len(self.factors), dtype=np.uint64)
        # So many orders at once that a very long text does not fill the memory.
        step = max(1, TABLE // len(runs))
        for i in range(0, len(found), step):
            drawn = (runs ^ self.offsets[i : i + step, None]) * self.factors[i : i + step, None]
            drawn ^= drawn >> np.uint64(32)
            places = np.argpartition(drawn, take - 1, axis=1)[:, :take]
            chosen = runs[np.sort(places, axis=1)]
            for j in range(take):
                found[i : i + step] = _mixed(found[i : i + step] * np.uint64(31) + chosen[:, j])
        return found.view(np.int64)


def packed(counts: np.ndarray) -> bytes:
    """Counts by class, in the shortest numbers."""
    most = int(counts.max())
    kind = next(t for t in BAG_TYPES.values() if most <= np.iinfo(t).max)
    return counts.astype(kind).tobytes()


def unpacked(bag: bytes) -> np.ndarray:
    return np.frombuffer(bag, BAG_TYPES[len(bag)]).astype(np.int64)


def _sketched(docs: DataFrame, sketcher: Sketcher) -> DataFrame:
    """``key``, number of words, sketches and ``bag`` (words of each class) of every text with a word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for batch in batches:
                rows = []
                for key, text in zip(batch["key"], batch["text"], strict=True):
                    words = words_of(text)
                    if words:
                        hashes = _word_hashes(words)
                        classes = (hashes % np.uint64(CLASSES)).astype(np.int64)
                        bag = packed(np.bincount(classes, minlength=CLASSES))
                        rows.append((key, len(words), sketcher.sketch_of(hashes), bag))
                yield pd.DataFrame(rows, columns=["key", "n_words", "sketch", "bag"])

    kind = "key binary, n_words int, sketch array<long>, bag binary"
    return docs.filter("key IS NOT NULL").mapInPandas(run, kind)


def similarity_limit(n: int, m: int, similarity: float) -> int:
    """Most edits that two texts of so many words may have: similarity is 1 - edits / longer text."""
    return int((1 - similarity) * max(n, m) + 1e-9)


def _near(n: Column, m: Column, similarity: float) -> Column:
    """Whether texts of so many words can be similar enough."""
    return F.abs(n - m) <= (1 - similarity) * F.greatest(n, m) + 1e-9


@passing
def _possible(pairs: DataFrame, singles: DataFrame, similarity: float) -> DataFrame:
    """The pairs (``center``, ``key``) whose numbers of words by class do not rule them out."""
    own = singles.select("key", "n_words", "bag")
    centers = settle(pairs.select("center").distinct())
    centers = centers.join(own.withColumnsRenamed({"key": "center", "n_words": "m", "bag": "other"}), "center")
    both = lookup_join(pairs, settle(centers), "center", "inner").join(own, "key")
    columns = pairs.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            longer = np.maximum(batch["n_words"], batch["m"]).to_numpy()
            shared = [
                int(np.minimum(unpacked(x), unpacked(y)).sum())
                for x, y in zip(batch["bag"], batch["other"], strict=True)
            ]
            kept = longer - np.array(shared, np.int64) <= (1 - similarity) * longer + 1e-9
            yield batch.loc[kept, columns]

    return both.mapInPandas(run, pairs.schema)


@passing
def _verified(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (``center``, ``key``) whose texts align, as ``a`` and ``b``.

    The members of a center are dealt to parts of about ``CENTER_BLOCK``, and its text goes along once for
    each part, ahead of theirs; a task aligns one part after the other.
    """
    counts = pairs.groupBy("center").agg(F.ceil(F.count("*") / CENTER_BLOCK).cast("int").alias("parts"))
    dealt = lookup_join(pairs, settle(counts), "center", "inner")
    dealt = settle(dealt.withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int")).drop("parts"))
    centers = dealt.select("center", "part").distinct().withColumn("key", F.col("center"))
    wanted = dealt.select("center", "part", "key", F.lit(1).alias("place")).unionByName(
        centers.withColumn("place", F.lit(0))
    )
    # Few texts are wanted, so they are picked out where they are.
    sent = lookup_join(texts, settle(wanted), "key", "inner").repartition("center", "part")
    sent = sent.sortWithinPartitions("center", "part", "place")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        center, first = [], None
        for batch in batches:
            found = []
            for own, key, place, text in zip(
                batch["center"], batch["key"], batch["place"], batch["text"], strict=True
            ):
                words = words_of(text)
                if place == 0:
                    center, first = words, own
                elif own == first and _align(center, words, similarity):
                    found.append((own, key))
            yield pd.DataFrame(found, columns=["a", "b"])

    return sent.select("center", "key", "place", "text").mapInPandas(align, "a binary, b binary")


def _align(a: list[str], b: list[str], similarity: float) -> bool:
    most = similarity_limit(len(a), len(b), similarity)
    # Words that one has and the other lacks cost an edit each.
    counts = Counter(a)
    counts.subtract(b)
    more, less = (sum(n for n in counts.values() if n * sign > 0) * sign for sign in (1, -1))
    return max(more, less) <= most and edit_distance(a, b, most) <= most


@passing
def _one_center_each(
    labelled: DataFrame, bags: DataFrame, tried: DataFrame | None, turn: int, similarity: float
) -> DataFrame:
    """For each document the center of another class that it shares most sketches with, of those that its
    numbers of words do not rule out and that it was not aligned with before, if any. The center of a sketch
    is one of its documents, another one in each turn."""
    drawn = F.min(F.struct(F.xxhash64(F.lit(turn), "key").alias("h"), "key", "label", "n_words"))
    centers = settle(labelled.groupBy("band").agg(drawn.alias("c")))
    centers = centers.select(
        "band", F.col("c.key").alias("center"), F.col("c.label").alias("other"), F.col("c.n_words").alias("m")
    )
    met = labelled.join(centers, "band").filter("label <> other")
    met = met.filter(_near(F.col("n_words"), F.col("m"), similarity))
    met = settle(_untried(met.groupBy("key", "center").count(), tried))
    best = _possible(met, bags, similarity).groupBy("key").agg(F.max(F.struct("count", "center")).alias("best"))
    return best.select("key", F.col("best.center").alias("center"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("center", "key").alias("low"), F.greatest("center", "key").alias("high"))


def _untried(pairs: DataFrame, tried: DataFrame | None) -> DataFrame:
    """The pairs that are not in ``tried`` either way round."""
    if tried is None:
        return pairs
    sides = pairs.withColumns({"low": F.least("center", "key"), "high": F.greatest("center", "key")})
    return sides.join(tried, ["low", "high"], "left_anti").select(pairs.columns)


def _alike(similarity: float):
    def compare(tasks: pd.DataFrame) -> pd.DataFrame:
        """Pairs of different labels that share a sketch and, by their counts, enough words."""
        order = ["band", "part_a", "part_b"]
        tasks = tasks.sort_values([*order, "n_words"], ignore_index=True)
        group = tasks.groupby(order, sort=False).ngroup().to_numpy()
        across = (tasks["part_a"] != tasks["part_b"]).to_numpy()
        part, size = tasks["part"].to_numpy(), tasks["n_words"].to_numpy()
        label, keys = pd.factorize(tasks["label"])[0], tasks["key"].to_numpy()
        first, found = pd.factorize(tasks["key"])[0], []
        # A document stands in many sketches, its counts once.
        bags = np.stack([unpacked(b) for b in tasks["bag"][~tasks["key"].duplicated()]])
        at, ahead = np.arange(len(tasks)), 0
        while len(at):
            # Documents of a group are in order of length: one that is too long for another ends its turn.
            ahead += 1
            at = at[at + ahead < len(tasks)]
            to = at + ahead
            at = at[(group[to] == group[at]) & (size[to] - size[at] <= (1 - similarity) * size[to] + 1e-9)]
            to = at + ahead
            ok = (label[to] != label[at]) & (~across[at] | (part[to] != part[at]))
            a, b = at[ok], to[ok]
            for i in range(0, len(a), CALL):
                x, y = a[i : i + CALL], b[i : i + CALL]
                missing = size[y] - np.minimum(bags[first[x]], bags[first[y]]).sum(axis=1)
                near = missing <= (1 - similarity) * size[y] + 1e-9
                found += zip(keys[x[near]], keys[y[near]], strict=True)
        pairs = {(min(p), max(p)) for p in found}
        return pd.DataFrame(sorted(pairs), columns=["center", "key"])

    return compare


def _with_classes(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` with the root of each one's class as ``label``."""
    labelled = members.join(roots.withColumnRenamed("node", "key"), "key", "left")
    return labelled.withColumn("label", F.coalesce("root", "key")).drop("root")


@passing
def _mixed_bands(labelled: DataFrame) -> DataFrame:
    """Sketches of several classes, with their rows and twice their pairs across classes; those of a single
    class have nothing left to compare."""
    of_class = labelled.groupBy("band", "label").agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = F.sum("n")
    mixed = of_class.groupBy("band").agg(
        F.count(F.lit(1)).alias("classes"),
        rows.alias("rows"),
        (rows * rows - F.sum(F.col("n") * F.col("n"))).alias("open"),
    )
    return settle(mixed.filter("classes > 1"))


@passing
def _block_pairs(
    labelled: DataFrame, bags: DataFrame, tried: DataFrame | None, similarity: float
) -> DataFrame:
    """Pairs of different classes that share a sketch and may be similar enough, but for those tried."""
    own = bags.select("key", "bag").join(settle(labelled.select("key").distinct()), "key", "left_semi")
    tasks = settle(blocked(settle(labelled.join(own, "key")), ["band"], "key", BLOCK))
    # Small groups share a call; a call has about ``CALL`` rows.
    calls = max(1, -(-tasks.count() // CALL))
    call = F.pmod(F.xxhash64("band", "part_a", "part_b"), F.lit(calls)).alias("call")
    pairs = tasks.select("*", call).groupBy("call").applyInPandas(_alike(similarity), "center binary, key binary")
    return settle(_untried(pairs.distinct(), tried))


@passing
def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    similarity: float = SIMILARITY,
    words: int = WORDS,
    sketches: int = SKETCHES,
    runs: int = RUNS,
    seed: int = SEED,
) -> DataFrame:
    """A row per row of ``docs``: id, ``key`` (null without a word), ``class_id`` (smallest document id
    of the class), ``class_docs`` and ``kept``.

    Texts are compared as lower-case words, equal texts without more ado. Documents are linked if the
    word edit distance is at most ``1 - similarity`` of the longer one, and classes are what links
    connect. Null texts and texts without a word are their own class and kept. Null ids sort last; in a
    class of null ids only, ``class_id`` is null. Rows that repeat an id and text are kept or not alike
    (``first_rows`` settles that). A text shorter than ``words`` is one run. An empty table gives no
    rows.

    In a few rounds every candidate is compared with one center in another class, the one it shares
    most sketches with of those of a possible length, which settles large groups in as many comparisons
    as members. Sketches whose documents are then still in different classes are compared in blocks, all
    pairs across classes. Numbers of words rule pairs out before texts are sent, and no pair is aligned
    twice.
    """
    keyed = docs.select(
        F.col(doc_id).alias(doc_id),
        text_key(F.col(text)).alias("key"),
        F.col(text).alias("text"),
    )
    sketcher = Sketcher(words, sketches, runs, seed)
    drawn = _sketched(keyed.select("key", "text"), sketcher)
    first = [F.first(c).alias(c) for c in ("n_words", "sketch", "bag")]
    singles = stored(drawn.groupBy("key").agg(*first), "sketches")
    band = F.posexplode("sketch").alias("i", "h")
    bands = singles.select("key", "n_words", band).select("key", "n_words", F.xxhash64("i", "h").alias("band"))
    # A text is in a band once, as its sketches are numbered.
    shared_bands = settle(bands.groupBy("band").count().filter("count > 1").select("band"))
    members = settle(lookup_join(bands, shared_bands, "band", "inner"))
    # Sketches take up most of the table, and are not read again.
    bags = settle(singles.select("key", "n_words", "bag"))
    discard(singles, shared_bands)

    # One text for each candidate: that of its smallest id. Only texts of rows that repeat it are brought together.
    rows = keyed.groupBy("key", doc_id).agg(F.count("*").alias("rows"))
    of_least = F.coalesce(F.min_by("rows", doc_id), F.max("rows"))
    ids = rows.groupBy("key").agg(
        F.min(doc_id).alias("least"), F.sum("rows").alias("copies"), (of_least > 1).alias("repeated")
    )
    ids = settle(ids.filter("key IS NOT NULL"))
    wanted = members.select("key").distinct().join(ids, "key").select("key", "least", "repeated")
    texts = lookup_join(keyed, settle(wanted), "key", "inner").filter(F.col(doc_id).eqNullSafe(F.col("least")))
    single = texts.filter("NOT repeated").select("key", "text")
    repeated = texts.filter("repeated").groupBy("key").agg(F.first("text").alias("text"))
    texts = stored(single.unionByName(repeated), "texts")

    links, tried = None, None
    labelled = members.withColumn("label", F.col("key"))
    for turn in range(ROUNDS):
        pairs = _one_center_each(labelled, bags, tried, turn, similarity)
        if pairs.isEmpty():
            break
        found = _verified(pairs, texts, similarity)
        links = found if links is None else settle(links.unionByName(found))
        seen = _ordered(pairs) if tried is None else tried.unionByName(_ordered(pairs))
        tried = settle(seen.distinct())
        roots = components(links)
        mixed = _mixed_bands(_with_classes(members, roots))
        before, labelled = labelled, settle(
            lookup_join(_with_classes(members, roots), mixed.select("band"), "band", "inner")
        )
        few = found.count() < YIELD * pairs.count()
        discard(before, pairs, roots)
        left = mixed.agg(F.sum("rows").alias("rows"), F.sum("open").alias("open")).first()
        if few or (left["open"] or 0) <= 2 * LEFT * (left["rows"] or 0):
            break
    more = _verified(_block_pairs(labelled, bags, tried, similarity), texts, similarity)
    roots = components(more if links is None else settle(links.unionByName(more)))

    named = ids.join(roots.withColumnRenamed("node", "key"), "key", "left")
    named = settle(named.withColumn("root", F.coalesce("root", "key")))
    classes = named.groupBy("root").agg(
        F.min("least").alias("class_id"),
        F.sum("copies").alias("class_docs"),
        F.min(F.struct(F.col("least").isNull(), "least", "key")).alias("first"),
    )
    result = named.select("key", "root").join(settle(classes), "root")
    result = settle(result.select("key", "class_id", "class_docs", F.col("first.key").alias("first_key")))
    rows = lookup_join(keyed.select(doc_id, "key"), result, "key")
    return rows.select(
        doc_id,
        "key",
        F.when(F.col("class_docs").isNull(), F.col(doc_id)).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("class_docs", F.lit(1)).alias("class_docs"),
        (
            F.col("key").isNull()
            | ((F.col("key") == F.col("first_key")) & F.col(doc_id).eqNullSafe(F.col("class_id")))
        ).alias("kept"),
    )


def first_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest id and, among rows that repeat it, one.

    All columns stay. Texts without a word are all kept.
    """
    classes = near_duplicates(docs, doc_id, text, **options).filter("key IS NOT NULL")
    per_row = classes.groupBy("key", doc_id).agg(F.first("kept").alias("kept"), F.count("*").alias("n"))
    other = settle(
        per_row.filter("NOT kept OR n > 1").select(
            "key", F.col(doc_id).alias("_id"), "kept", F.lit(True).alias("_other")
        )
    )
    rows = docs.withColumn("_key", text_key(F.col(text)))
    found = rows.join(
        other.withColumnRenamed("key", "_other_key"),
        (F.col("_key") == F.col("_other_key")) & F.col(doc_id).eqNullSafe(F.col("_id")),
        "left",
    )
    single = found.filter("_other IS NULL").select(docs.columns)
    repeated = found.filter("_other AND kept").dropDuplicates(["_key", doc_id]).select(docs.columns)
    return single.unionByName(repeated)
