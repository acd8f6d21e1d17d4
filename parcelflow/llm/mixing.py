"""Mixing sources to target weights by capped water-filling.

Every source has a weight and may be repeated at most ``max_epochs`` times. The water level ``l`` gives
source ``s`` the target ``min(max_epochs * size_s, l * weight_s)``; it is raised, with full sources
clamped, until the targets add up to the wanted size. A source whose target is ``k + f`` times its size
takes every document ``k`` times and, once more, the documents with the smallest seeded hashes until
the words are reached; the one at the limit is taken whole or not at all, whichever is nearer to the target.
Only DataFrame operations are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from parcelflow.operators.joins import lookup_join
from parcelflow.llm.tables import settle
from parcelflow.session import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 20_240_229

# The hash space of a source is narrowed this often by so many bits before single hashes are compared.
LEVELS = 2
BITS = 10
HASH_BITS = 63

KEY = "_mix_key"
HASH = "_mix_hash"
SIZE = "_mix_size"


def word_count(text: Column) -> Column:
    """Runs of other characters than space and the control characters 9 to 13; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """Text that is never null and sorts by code point with the null source last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def _prepared(doc_id: str, text: str, source: str, seed: int) -> dict[str, Column]:
    hashed = F.xxhash64(F.lit(seed), F.col(doc_id).cast("string"), F.col(text))
    return {
        KEY: source_key(F.col(source)),
        SIZE: word_count(F.col(text)),
        HASH: F.shiftrightunsigned(hashed, 64 - HASH_BITS),
    }


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank`` by ``KEY`` from 0 without bringing all sources into one task.

    Rows are sorted in ranges; the collected counts are one per range.
    """
    ordered = settle(
        sources.repartitionByRange(F.col(KEY))
        .sortWithinPartitions(KEY)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    part = F.shiftright("_place", 33).cast("int")
    counts = ordered.groupBy(part.alias("part")).count().orderBy("part").collect()
    if not counts:
        return ordered.withColumn("rank", F.lit(0).cast("long")).drop("_place")
    before, starts = 0, []
    for row in counts:
        starts += [F.lit(row["part"]), F.lit(before).cast("long")]
        before += row["count"]
    within = F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return ordered.withColumn("rank", F.create_map(*starts)[part] + within).drop("_place")


def fill(sources: DataFrame, max_epochs: float, share: float) -> DataFrame:
    """Adds ``target`` to rows of ``source_size`` and ``weight``.

    Clamping goes on until no source is above its limit; a round is one sum over the sources, and a
    source once clamped stays so because the level only rises. If all sources are full, all are clamped.
    """
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    wanted, cap = total * share, F.col("source_size") * F.lit(max_epochs)
    level, clamped = 0.0, -1
    while True:
        full = cap < F.col("weight") * F.lit(level)
        used, open_weight, count = sources.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0.0)).cast("double"),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)).cast("double"),
            F.coalesce(F.sum(full.cast("long")), F.lit(0)),
        ).first()
        if count == clamped:
            break
        clamped = count
        level = (wanted - used) / open_weight if open_weight > 0 else float("inf")
    target = F.least(cap.cast("double"), F.col("weight") * F.lit(level))
    return sources.withColumn("target", F.when(F.col("source_size") > 0, target).otherwise(0.0))


def _cuts(sized: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source with a fractional repetition: the hash below which rows are taken once more
    (``cut``), and ``part`` of ``mass`` words to take of the rows at this hash.

    Words are added up per range of hashes; the range that holds the limit is divided further, so a
    window never sees more than ``2 ** BITS`` ranges of a source, or its hashes in the last range.
    """
    state = plan.filter("need > 0").select(KEY, "need", F.lit(0).cast("long").alias("path"))
    for level in range(1, LEVELS + 2):
        last = level > LEVELS
        shift = 0 if last else HASH_BITS - BITS * level
        state = settle(state)
        inside = lookup_join(sized.select(KEY, HASH, SIZE), state, KEY, "inner").filter(
            F.shiftrightunsigned(HASH, HASH_BITS - BITS * (level - 1)) == F.col("path")
            if level > 1
            else F.lit(True)
        )
        sums = inside.groupBy(KEY, "need", F.shiftrightunsigned(HASH, shift).alias("path")).agg(
            F.sum(SIZE).alias("mass")
        )
        order = Window.partitionBy(KEY).orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
        found = sums.withColumn("before", F.coalesce(F.sum("mass").over(order), F.lit(0))).filter(
            (F.col("before") < F.col("need")) & (F.col("before") + F.col("mass") >= F.col("need"))
        )
        state = found.select(KEY, (F.col("need") - F.col("before")).alias("need"), "path", "mass")
        if not last:
            state = state.drop("mass")
    return state.select(KEY, F.col("path").alias("cut"), F.col("need").alias("part"), "mass")


def plan_sources(
    sized: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    share: float = 1.0,
) -> DataFrame:
    """A row per source: ``source_size``, ``target``, whole repetitions and where the next one ends."""
    sources = sized.groupBy(KEY).agg(F.sum(SIZE).alias("source_size"))
    ranked = _ranked(sources)
    listed = F.array(*[F.lit(float(w)) for w in weights])
    weight = F.element_at(listed, (F.col("rank") % len(weights)).cast("int") + 1)
    filled = fill(settle(ranked.withColumn("weight", weight)), max_epochs, share)
    whole = F.when(
        F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))
    ).otherwise(0)
    plan = filled.withColumn("whole", whole.cast("long")).withColumn(
        "need", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    )
    plan = settle(plan.select(KEY, "source_size", "target", "whole", "need"))
    cuts = _cuts(sized, plan)
    return settle(plan.join(cuts, KEY, "left").drop("need"))


def mix(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    share: float = 1.0,
    seed: int = SEED,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """All rows of ``docs`` with ``size``, ``source_size``, ``target``, ``copies`` (how often the mix takes the
    document) and ``taken`` words.

    ``weights`` go to the sources in code point order, the null source last, and repeat. ``share`` is
    the wanted size as a part of all words. Null and empty texts have size 0 and are taken as often as
    their source as a whole. An empty table gives no rows.

    No text is cut: of the rows at the limit so many are taken once more as come nearest to the target,
    which is met to within one document. Only rows of one id and text share a hash; those at the limit
    are numbered.
    Columns of these names in ``docs`` are replaced, all others are kept.
    """
    made = _prepared(doc_id, text, source, seed)
    sized = stored(docs.select(*[c.alias(n) for n, c in made.items()]), "mix")
    plan = plan_sources(sized, weights, max_epochs, share)
    results = ("size", "source_size", "target", "copies", "taken")
    kept = [c for c in docs.columns if c not in results]
    rows = lookup_join(docs.select(*kept, *[c.alias(n) for n, c in made.items()]), plan, KEY)
    at_cut = F.coalesce(F.col(HASH) == F.col("cut"), F.lit(False))
    # Rows there are as long as each other; the columns only make the choice repeatable.
    order = [F.xxhash64(*kept), *[F.col(c).cast("string") for c in (doc_id, text)]]
    number = F.row_number().over(Window.partitionBy(KEY).orderBy(*order))
    chosen = number <= F.round(F.col("part") / F.col(SIZE))
    some = rows.filter(at_cut).withColumn("_more", chosen.cast("long"))
    others = rows.filter(~at_cut).withColumn("_more", F.coalesce((F.col(HASH) < F.col("cut")).cast("long"), F.lit(0)))
    copies = F.col("whole") + F.col("_more")
    return others.unionByName(some).select(
        *kept,
        F.col(SIZE).alias("size"),
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col(SIZE)).alias("taken"),
    )


def repeated(mixed: DataFrame) -> DataFrame:
    """The mix itself: each row as often as ``copies`` says. Rows taken no time are left out."""
    return mixed.filter("copies > 0").withColumn("_n", F.explode(F.expr("sequence(1L, copies)"))).drop("_n")
