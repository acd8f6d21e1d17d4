"""The tree of conversation beginnings against a plain one, and at the edges."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from checks.compare import connect, differences
from parcelflow.llm import queries, trie

ROWS = "conv_id long, turn long, role string, text string"
NAMES = (
    "conv_id",
    "depth",
    "parent_conv_id",
    "n_convs",
    "n_children",
    "n_leaves",
    "saved_tokens",
    "ends_sha256",
)


def plain(conversations: dict[int, list[tuple[str, str]]]) -> set[tuple]:
    members: dict[tuple, list[int]] = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children: dict[tuple, list[tuple]] = {path: [] for path in members}
    for path in members:
        if path:
            children[path[:-1]].append(path)
    sums: dict[tuple, tuple[int, int]] = {}
    for path in sorted(members, key=len, reverse=True):
        below = [sums[x] for x in children[path]]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        saved = (len(members[path]) - 1) * words + sum(b[1] for b in below)
        sums[path] = (sum(b[0] for b in below) or 1, saved)
    found = set()
    for path, ids in members.items():
        ends = ",".join(str(c) for c in sorted(ids) if len(conversations[c]) == len(path))
        parent = min(members[path[:-1]]) if path else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        found.add((min(ids), len(path), parent, len(ids), len(children[path]), *sums[path], digest))
    return found


def listed(rows) -> dict[int, list[tuple[str, str]]]:
    """Rows by conversation, in order; nulls are empty, null turns come first."""
    found: dict[int, list] = {}
    for c, turn, role, text in rows:
        if c is not None:
            found.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(x[2], x[3]) for x in sorted(turns)] for c, turns in found.items()}


def trie_rows(spark, rows, conversations=None):
    turns = trie.ordered_turns(spark.createDataFrame(rows, ROWS))
    ids = turns.select("conv_id").distinct() if conversations is None else conversations
    return trie.prefix_trie(turns, ids)


def as_set(found):
    rows = found.select(*NAMES).collect()
    assert len(set(rows)) == len(rows)
    return {tuple(r) for r in rows}


def test_random_conversations_with_many_copies(spark):
    rng = random.Random(7)
    rows, texts = [], ["a b", "a  b c", "", "d", None]
    for c in rng.sample(range(-500, 10**12), 300):
        start = rng.randrange(3)
        length = rng.choice([1, 2, 3, 4, 5, 8, 9, 30])
        for t in range(length):
            same = t < rng.randrange(1, 12)
            text = texts[(start + t) % 3] if same else rng.choice(texts)
            rows.append((c, t, "user" if t % 2 else rng.choice(["user", None]), text))
    rng.shuffle(rows)
    assert as_set(trie_rows(spark, rows)) == plain(listed(rows))


def test_long_conversations_that_part_late(spark):
    turns = [("user", f"turn {i}") for i in range(260)]
    given = {1: turns, 2: [*turns[:200], ("x", "other")], 3: turns[:200], 4: turns, 9: [("user", "turn")]}
    rows = [(c, i, *t) for c, ts in given.items() for i, t in enumerate(ts)]
    assert as_set(trie_rows(spark, rows)) == plain(given)


def test_nulls_ties_repeated_rows_and_clashing_columns(spark):
    rows = [
        (1, None, "b", "x"),
        (1, 0, "a", "y"),
        (2, 0, "b", "x"),
        (2, 0, "b", "x"),
        (2, 0, "a", "z"),
        (3, 5, None, None),
        (4, 5, "", ""),
        (None, 0, "a", "y"),
    ]
    given = spark.createDataFrame(rows, ROWS)
    for name in ("pos", "id", "key", "level", "depth", "t1"):
        given = given.withColumn(name, F.lit("clash"))
    turns = trie.ordered_turns(given)
    found = trie.prefix_trie(turns, turns.select("conv_id").distinct())
    assert as_set(found) == plain(listed(rows))


def test_more_conversations_at_one_node_than_a_string_holds(spark):
    n = 2 * trie.CHUNK + 17
    ids = spark.range(n).select((F.col("id") * 7).alias("conv_id"))
    rows = [(7 * i, 0, "user", "hi there") for i in range(5)] + [(1, 0, "user", "not asked for")]
    given = {7 * i: [("user", "hi there")] if i < 5 else [] for i in range(n)}
    assert as_set(trie_rows(spark, rows, ids)) == plain(given)


def test_empty_tables(spark):
    assert as_set(trie_rows(spark, [])) == set()
    only_root = as_set(trie_rows(spark, [], spark.range(3, 4).withColumnRenamed("id", "conv_id")))
    assert only_root == plain({3: []})


def test_heads_are_those_of_the_fork(spark):
    rows = [(c, t, "user", f"{c} {t}") for c in (0, 3, 7, 19, 21, 25, 41, -7) for t in range(2 + c % 4)]
    turns = trie.ordered_turns(spark.createDataFrame(rows, ROWS))
    conversations = turns.select("conv_id").distinct()
    given, expected = listed(rows), {}
    for c, own in given.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = abs(c) // 20 * 20 * (1 if c > 0 else -1)
        expected[c] = given.get(base, [])[:h] + own[h:]
    found = trie.prefix_trie(queries.rebuilt(turns, conversations), conversations)
    assert as_set(found) == plain(expected)


@pytest.mark.parametrize("name", ["op13_conversation_prefix_trie"])
def test_query_agrees_with_sql(spark, folder, name):
    extra, missing, rows = differences(
        spark, connect(folder), folder, queries.QUERIES[name], queries.SQL[name]
    )
    assert (extra, missing) == ({}, {}) and rows > 10
