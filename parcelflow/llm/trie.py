"""The tree of all conversation beginnings, by SQL ROLLUP over columns of turn ids.

A node is a distinct sequence of first turns; conversations that begin with it are its members, the root is
the empty sequence. Turns of a conversation are laid out in blocks of ``BLOCK`` columns. One ROLLUP over the
columns gives all beginnings of a block together, ``grouping_id`` tells how long each is. A longer
conversation goes on in further blocks, each a row of its own, keyed by the node that the blocks before
end at. That key is known in advance, as a running sum of hashes of (place, turn) along the conversation, so
all blocks are aggregated at once, whatever the length.

A node is owned by its smallest member. The nodes that a conversation owns are the last ones of its path, so
a conversation is new from one depth on and repeats others before it. A first ROLLUP finds these depths; in a
second one all sums over a subtree are sums over the members of its top: words that a member repeats,
members that end in a leaf of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelflow.llm.tables import settle
from parcelflow.operators.joins import lookup_join

BLOCK = 4
WORD = r"[^\x20\x09-\x0D]+"
# Conversations ending at one node go to its digest in strings of so many ids.
CHUNK = 4096
# Sums of so many halves of 64-bit hashes make the key of a node.
KEY_PARTS = 4
COLUMNS = [f"t{j}" for j in range(1, BLOCK + 1)]


def turn_id(role: Column, text: Column) -> Column:
    """16 bytes of SHA-256 over role and text."""
    both = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.substring(F.sha2(both, 256), 1, 32))


def ordered_turns(
    conversations: DataFrame,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """``conv_id``, ``pos`` (from 1), ``id`` and ``words`` of every turn.

    Turns are ordered by number, null first, those of one number by role and text; null roles and texts are
    empty, and repeated rows are turns of their own. Rows without a conversation id are left out.
    """
    given = conversations.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    return given.withColumn("pos", F.row_number().over(order).cast("long")).select(
        "conv_id",
        "pos",
        turn_id(F.col("role"), F.col("text")).alias("id"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"),
    )


def prefix_trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """One row per node of the tree of ``conversations`` (distinct ``conv_id``, not null).

    ``turns`` has ``conv_id``, ``pos`` (any distinct longs from 1 on, they set the order), ``id`` and
    ``words``; conversations without turns end at the root, turns of other conversations are not used.

    Columns: ``conv_id`` (smallest member) and ``depth``, which together name the node; ``parent_conv_id``
    (null for the root), ``n_convs``, ``n_children``, ``n_leaves`` and ``saved_tokens`` (words that a shared
    prefix saves over the subtree: for each node its last turn's words, once for every member but one), and
    ``ends_sha256``, a digest of the ids of the members that end here, ascending, joined by commas. Without
    conversations there is no node.

    The turns of one conversation pass through one task, sorted with spilling, and so does the last step of
    the digest of a node, over strings of ``CHUNK`` ids.
    """
    places = settle(_places(turns, conversations))
    blocks = places.filter((F.col("pos") % BLOCK == 1) | ((F.col("pos") == 0) & (F.col("length") == 0)))
    owners = settle(_owners(blocks))
    owned = settle(
        places.join(owners, "conv_id")
        .filter(F.col("pos") >= F.col("since"))
        .select("conv_id", F.col("pos").alias("depth"), "since", "leaf", "key", "parent", "before")
    )
    first = owned.filter(F.col("depth") == F.col("since"))
    nodes = _subtree_sums(blocks, first)
    parents = lookup_join(
        first.select("conv_id", "depth", F.col("parent").alias("key")),
        owned.select("key", F.col("conv_id").alias("parent_conv_id")),
        "key",
    ).select("conv_id", "depth", "parent_conv_id", F.lit(True).alias("is_first"))
    ends = digests(places.filter(F.col("pos") == F.col("length")).select("key", F.col("conv_id").alias("id")))
    ends = owned.select("conv_id", "depth", "key").join(ends, "key").drop("key")
    rows = nodes.join(parents, ["conv_id", "depth"], "left").join(ends, ["conv_id", "depth"], "left")
    return rows.select(
        "conv_id",
        "depth",
        F.when(F.col("is_first"), F.col("parent_conv_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("digest", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def _places(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """A row for the root (``pos`` 0) and every turn of each conversation: its node's ``key``, the
    ``parent``'s, the ``length`` and all ``words`` of the conversation, words ``before`` it, and, where a
    block begins, the turn ids of the block and the words before each of its turns."""
    roots = conversations.select(
        "conv_id",
        F.lit(0).cast("long").alias("pos"),
        F.lit(None).cast("binary").alias("id"),
        F.lit(0).cast("long").alias("words"),
    )
    rows = roots.unionByName(
        turns.join(roots.select("conv_id"), "conv_id", "left_semi").select(roots.columns)
    )
    whole = Window.partitionBy("conv_id")
    rows = rows.withColumnRenamed("pos", "at")
    along = whole.orderBy("at")
    until = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("place", F.row_number().over(along).cast("long") - 1)
    parts = [
        F.when(F.col("id").isNull(), F.lit(0)).otherwise(
            F.shiftright(F.xxhash64(F.lit(j), "place", "id"), 32)
        )
        for j in range(KEY_PARTS)
    ]
    rows = rows.select(
        "conv_id",
        "at",
        F.col("place").alias("pos"),
        "id",
        F.concat_ws("_", *[F.sum(p).over(until) for p in parts]).alias("key"),
        (F.sum("words").over(until) - F.col("words")).alias("before"),
        F.sum("words").over(whole).alias("words"),
        F.max("place").over(whole).alias("length"),
    )
    begins = F.col("pos") % BLOCK == 1
    return rows.select(
        "conv_id",
        "pos",
        "key",
        F.lag("key").over(along).alias("parent"),
        "before",
        "words",
        "length",
        *[F.when(begins, F.lead("id", j).over(along)).alias(c) for j, c in enumerate(COLUMNS)],
        *[
            F.when(begins, F.lead("before", j).over(along)).alias(f"before_{c}")
            for j, c in enumerate(COLUMNS)
        ],
    )


def _rolled(blocks: DataFrame, measures: str) -> DataFrame:
    """``measures`` of every node, with its ``depth`` and its ``level`` within its block."""
    rows = blocks.select(
        F.greatest(F.col("pos"), F.lit(1)).alias("start"),
        F.when(F.col("pos") > 1, F.col("parent")).otherwise("").alias("prior"),
        *[c for c in blocks.columns if c not in ("pos", "parent", "key")],
    )
    columns = ", ".join(COLUMNS)
    found = blocks.sparkSession.sql(
        f"SELECT start, prior, {columns}, {BLOCK} - bit_count(grouping_id()) AS level, {measures} "
        f"FROM {{rows}} GROUP BY start, prior, ROLLUP ({columns})",
        rows=rows,
    )
    # A conversation that ends within the block has no turn below its end, and a block's own top is the last
    # node of the block before.
    ended = F.array(F.lit(None).cast("binary"), *COLUMNS)[F.col("level")].isNull()
    top = (F.col("level") == 0) & (F.col("start") == 1)
    return found.withColumn("depth", F.col("start") - 1 + F.col("level")).filter(~ended | top)


def _owners(blocks: DataFrame) -> DataFrame:
    """``since``, the depth from which a conversation owns the nodes of its path, and whether it ends in a
    ``leaf``; conversations equal to a smaller one own nothing and have no row."""
    nodes = _rolled(blocks, "min(conv_id) AS conv_id, max(length) AS longest")
    return nodes.groupBy("conv_id").agg(
        F.min("depth").cast("long").alias("since"),
        (F.min("longest") == F.max("depth")).alias("leaf"),
    )


def _subtree_sums(blocks: DataFrame, first: DataFrame) -> DataFrame:
    """Counts and sums of every node, from the members of each; ``first`` has the first node that each
    conversation owns."""
    of_conv = first.select("conv_id", "since", "leaf", F.col("before").alias("repeated"))
    rows = blocks.join(of_conv, "conv_id", "left")
    start = F.greatest(F.col("pos"), F.lit(1))
    repeated = F.coalesce("repeated", "words")
    rows = rows.withColumns(
        {
            "ends": F.coalesce(F.col("leaf").cast("long"), F.lit(0)),
            # Words of repeated turns from a depth on; none beyond the conversation's end.
            **{
                f"saved_{j}": F.greatest(
                    repeated - F.coalesce(f"before_{c}", repeated), F.lit(0).cast("long")
                )
                for j, c in enumerate(COLUMNS, 1)
            },
            # Whether the member owns the child on its path.
            **{
                f"child_{j}": F.coalesce(
                    (F.col("since") <= start + j) & (start + j <= F.col("length")), F.lit(False)
                ).cast("long")
                for j in range(BLOCK + 1)
            },
        }
    ).drop("since", "leaf", "repeated")
    sums = [f"saved_{j}" for j in range(1, BLOCK + 1)] + [f"child_{j}" for j in range(BLOCK + 1)]
    measures = ", ".join(f"sum({s}) AS {s}" for s in sums)
    nodes = _rolled(
        rows, f"min(conv_id) AS conv_id, count(*) AS n_convs, sum(ends) AS n_leaves, {measures}"
    )
    saved = F.array("saved_1", *[f"saved_{j}" for j in range(1, BLOCK + 1)])
    children = F.array(*[f"child_{j}" for j in range(BLOCK + 1)])
    return nodes.select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        "n_convs",
        children[F.col("level")].alias("n_children"),
        "n_leaves",
        saved[F.col("level")].alias("saved_tokens"),
    )


def digests(ids: DataFrame) -> DataFrame:
    """``digest`` of each ``key``: SHA-256 of its distinct longs ``id``, ascending, joined by commas.

    Ids are sorted over all tasks first, so even the ids of one key are spread; each task joins them into
    strings, and only these are brought together by key and run through the hash one after another.
    """
    in_order = ids.repartitionByRange("key", "id").sortWithinPartitions("key", "id")
    joined = in_order.mapInArrow(_joined, "key string, least long, ids string")
    by_key = joined.repartition("key").sortWithinPartitions("key", "least")
    return by_key.mapInArrow(_hashed, "key string, digest string")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Strings of up to ``CHUNK`` consecutive ids of a key."""
    key, held = None, []
    for batch in batches:
        out = []
        for k, i in zip(batch["key"].to_pylist(), batch["id"].to_pylist(), strict=True):
            if k != key or len(held) == CHUNK:
                if held:
                    out.append((key, held[0], ",".join(map(str, held))))
                key, held = k, []
            held.append(i)
        yield _batch(out, ["key", "least", "ids"], [pa.string(), pa.int64(), pa.string()])
    if held:
        out = [(key, held[0], ",".join(map(str, held)))]
        yield _batch(out, ["key", "least", "ids"], [pa.string(), pa.int64(), pa.string()])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hash of a key's strings, which follow each other."""
    key, state = None, None
    for batch in batches:
        out = []
        for k, part in zip(batch["key"].to_pylist(), batch["ids"].to_pylist(), strict=True):
            if k == key:
                state.update(b",")
            else:
                if state is not None:
                    out.append((key, state.hexdigest()))
                key, state = k, hashlib.sha256()
            state.update(part.encode())
        yield _batch(out, ["key", "digest"], [pa.string(), pa.string()])
    if state is not None:
        yield _batch([(key, state.hexdigest())], ["key", "digest"], [pa.string(), pa.string()])


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
