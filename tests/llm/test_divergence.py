"""The divergence audit against a plain one, and at the edges."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from checks.compare import connect, differences
from parcelflow.llm import divergence, queries

ROWS = "lang string, source string, text string"


def plain(rows, min_docs=10, top=10):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts, docs = {}, {}
    for lang, source, text in rows:
        lang, source, text = lang or "", source or "", (text or "").translate(fold)
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
        counts.setdefault(lang, {}).setdefault(source, Counter()).update(found)
        docs.setdefault(lang, Counter()).update(set(found))
    result = set()
    for lang, groups in counts.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]

        def scaled(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        whole = scaled(sum(groups.values(), Counter()))
        p = {source: scaled(count) for source, count in groups.items()}
        for source, count in groups.items():
            pairs = [
                (-sum((p[source][t] - p[o][t]) ** 2 // (p[source][t] + p[o][t]) for t in kept), o.encode(), o)
                for o in groups
                if o != source
            ]
            best = [
                (-((p[source][t] - whole[t]) ** 2 // (p[source][t] + whole[t])), t.encode(), t)
                for t in kept
                if count[t] > 0 and p[source][t] > whole[t]
            ]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(best)[:top])):
                for rank, (value, _, item) in enumerate(found, 1):
                    result.add((lang, source, part, item, -value, rank))
    return result


def audited(spark, rows, **options):
    found = divergence.audit(spark.createDataFrame(rows, ROWS), **options).collect()
    assert len(set(found)) == len(found)
    return {tuple(r) for r in found}


def test_terms_are_runs_of_letters():
    text = "Ab-cÉé x1y _z`\x7fq \0end\U0001f600"
    expected = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
    assert expected[0] == "Ab" and all(not x.isascii() or x == x.lower() for x in expected[1:])
    assert [t.decode() for t in divergence.terms(text.encode())] == ["ab", *expected[1:]]


def test_random_documents_with_ties_and_sources_without_terms(spark):
    rng = random.Random(11)
    words = [*"abcdefgh", "É", "é", "zz", "\U0001f600", "ａ", "Same", "same"]
    rows = []
    for _ in range(400):
        lang = rng.choice(["en", "en", "fr", None, ""])
        source = rng.choice(["s1", "s1", "s1", "s2", "é", "\U0001f600", "ａ", None])
        rows.append((lang, source, " ".join(rng.choices(words, k=rng.randrange(30)))))
    rows += [("en", "empty", None), ("en", "empty", ""), ("en", "numbers", "1 2 3")]
    rows += [("rare", "a", "x"), ("rare", "b", "x")]
    assert audited(spark, rows) == plain(rows)
    assert audited(spark, rows, min_docs=3, top=4) == plain(rows, 3, 4)


def test_more_sources_than_meet_at_once(spark):
    rng = random.Random(12)
    rows = [("en", f"s{i}", " ".join(rng.choices("abcdef", k=6))) for i in range(150)]
    rows += [("en", "s0", "only here " * 3)] * 12
    assert audited(spark, rows) == plain(rows)


def test_many_terms_of_equal_value(spark):
    text = " ".join(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300))
    rows = [("en", "a", text)] * 10 + [("en", "b", "other " * 5)] * 10
    assert audited(spark, rows) == plain(rows)


def test_tasks_that_hand_on_early(monkeypatch):
    import pyarrow as pa

    texts = [b"a b c d", b"a a", b"", b"b c"]
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * 4, "source": ["s", "t", "s", "s"], "text": texts})
    whole = Counter()
    monkeypatch.setattr(divergence, "HELD", 3)
    parts = list(divergence._count(iter([batch])))
    for part in parts:
        for row in part.to_pylist():
            whole[row["source"], row["term"], "n"] += row["n"]
            whole[row["source"], row["term"], "docs"] += row["docs"]
    assert len(parts) > 1
    assert whole["t", "a", "n"] == 2 and whole["t", "a", "docs"] == 1
    assert whole["s", "b", "n"] == whole["s", "b", "docs"] == 2


def test_counts_beyond_64_bits_when_scaled(spark):
    columns = "count long, total long, vocabulary long"
    rows = spark.createDataFrame([(10**13, 3 * 10**13, 10**6), (0, 10**13, 7), (5, 0, 0)], columns)
    got = [r[0] for r in rows.select(divergence.probability("count", "total")).collect()]
    assert got == [
        1 + 10**9 * (10**13 + 2) // (3 * 10**13 + 2 * 10**6),
        1 + 10**9 * 2 // (10**13 + 14),
        None,
    ]


def test_empty_table_and_clashing_columns(spark):
    assert audited(spark, []) == set()
    rows = [("en", s, "a b a") for s in "xy" for _ in range(6)] + [("en", "x", "c " * 40_000)] * 10
    docs = spark.createDataFrame(rows, ROWS)
    for name in ("term", "n", "total", "value", "part", "a", "b"):
        docs = docs.withColumn(name, F.lit("clash"))
    assert {tuple(r) for r in divergence.audit(docs).collect()} == plain(rows)


@pytest.mark.parametrize("name", ["op11_source_divergence"])
def test_query_agrees_with_sql(spark, folder, name):
    extra, missing, rows = differences(
        spark, connect(folder), folder, queries.QUERIES[name], queries.SQL[name]
    )
    assert (extra, missing) == ({}, {}) and rows > 100
