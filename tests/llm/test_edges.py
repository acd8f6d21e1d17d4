"""Awkward vectors, lines and documents, and the whole pipeline over odd and empty tables."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parcelflow.llm import covertree, lines, ordermin, vectors
from parcelflow.llm.banded import edit_distance

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_vectors_with_gaps_and_repeated_ids(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.5]),
        (2, [0.5, 1.0]),
        (2, [0.25, 1.0]),
        (3, [-1.0, nan]),
        (4, [inf, 1.0]),
        (5, [None, 1.0]),
        (6, None),
        (None, [1.0, 1.0]),
        (7, [1.0, 1.0, 1.0]),
        (8, []),
        (9, [0.0, 0.0]),
        (10, [-0.01, 0.01]),
    ]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    given = given.withColumn("id", F.lit("clash")).withColumn("score", F.lit(1)).withColumn("vec", F.lit(2))
    points = vectors.floored(given, "vec_id", "embedding", scale=64)
    found = covertree.top_k(points, points, 2).orderBy("query_id", "rank").collect()
    floors = {1: [64, 32], 2: [32, 64], 9: [0, 0], 10: [-1, 0]}
    for q, x in floors.items():
        scores = sorted((-int(np.dot(x, y)), d) for d, y in floors.items() if d != q)
        got = [(-r["score"], r["id"]) for r in found if r["query_id"] == q]
        assert got == scores[:2]
    assert {r["query_id"] for r in found} == set(floors)
    assert covertree.top_k(points.limit(0), points.limit(0), 2).isEmpty()


def test_one_very_long_line_and_one_hot_line(spark):
    rng = random.Random(9)
    long_line = "".join(rng.choices("abcdefgh ", k=40_000)).strip()
    changed = list(long_line)
    for k in rng.sample(range(len(changed)), 1_500):
        changed[k] = rng.choice(["", "#", changed[k] + "+"])
    far = "".join(rng.choices("abcdefgh ", k=40_000)).strip()
    rows = [(1, long_line), (2, "".join(changed)), (3, far)]
    rows += [(10 + i, "the same hot line in every document") for i in range(400)]
    rows += [(500 + i, f"the same hot line in every documen{i}") for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit(0))
    found = {r["doc_id"]: r["class_doc_id"] for r in lines.line_classes(docs).collect()}
    assert (found[1], found[2], found[3]) == (1, 1, 3)
    assert {found[i] for i in (*range(10, 410), *range(500, 510))} == {10}


def test_segments_of_the_shorter_line_stand_in_the_longer_one():
    rng = random.Random(10)
    rule = lines.Rule(lines.THRESHOLD, lines.SHARE)
    every = lines.Bits(np.full(1 << (lines.TABLE_BITS - 3), 255, np.uint8))
    for _ in range(300):
        a = "".join(rng.choices("ab", k=rng.randrange(15, 200)))
        b = list(a)
        for k in rng.sample(range(len(b)), rng.randrange(0, 1 + len(b) // 18)):
            b[k] = rng.choice(["", "x", b[k] + "y"])
        b = "".join(b)
        most = int(lines.edits(max(len(a), len(b)), lines.THRESHOLD, lines.SHARE))
        if min(len(a), len(b)) < 15 or edit_distance(a, b, most) > most:
            continue
        with np.errstate(over="ignore"):
            hashed = lines.Hashed([a, b], rule)
            own = hashed.segments()
            probes = hashed.probes(every, -1000, 1000)
        sets = [
            {int(h) for i, h in zip(own[0], own[3], strict=True) if hashed.order[i] == j}
            | {int(h) for i, h in zip(*probes, strict=True) if hashed.order[i] == j}
            for j in range(2)
        ]
        segments = [{int(h) for i, h in zip(own[0], own[3], strict=True) if hashed.order[i] == j} for j in range(2)]
        shorter = 0 if len(a) <= len(b) else 1
        assert segments[shorter] & sets[1 - shorter]


def test_lines_in_turns_by_length(monkeypatch, spark):
    rng = random.Random(12)
    rows = []
    for i in range(120):
        line = "".join(rng.choices("abcdef ", k=rng.choice([15, 16, 39, 40, 41, 60, 100, 200, 210]))).strip()
        changed = list(line)
        for k in rng.sample(range(len(line)), max(1, len(line) // 20)):
            changed[k] = rng.choice(["", "#", changed[k] + "+"])
        rows += [(2 * i, line), (2 * i + 1, "".join(changed))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(str, lines.line_classes(docs).collect()))
    monkeypatch.setattr(lines, "SEGMENTS", 100)
    assert sorted(map(str, lines.line_classes(docs).collect())) == whole
    assert sum("class_lines=2" in r for r in whole) > 150


def test_documents_of_a_word_equal_ids_and_null_ids(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [
        (1, "word"),
        (2, "WORD"),
        (3, "other"),
        (4, text),
        (4, text.replace("w7 ", "new ")),
        (4, "an altogether different text of some words"),
        (None, text.replace("w9 ", "old ")),
        (None, "only null ids here " * 5),
        (None, "only null ids here " * 5),
        (5, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = ordermin.near_duplicates(docs)
    classes = [(r["doc_id"], r["class_id"], r["class_docs"]) for r in found.collect()]
    assert sorted(c for c in classes if c[0] in (1, 2, 3, 5)) == [(1, 1, 2), (2, 1, 2), (3, 3, 1), (5, 5, 1)]
    assert sorted(c[1:] for c in classes if c[0] == 4) == [(4, 1), (4, 3), (4, 3)]
    assert sorted((c[1:] for c in classes if c[0] is None), key=str) == [(4, 3), (None, 2), (None, 2)]
    left = ordermin.first_of_each(docs)
    assert sorted((str(r["doc_id"]), (r["text"] or "")[:6]) for r in left.collect()) == [
        ("1", "word"),
        ("3", "other"),
        ("4", "an alt"),
        ("4", "w0 w1 "),
        ("5", ""),
        ("None", "only n"),
    ]


@pytest.fixture
def stored_tables(spark, tmp_path, folder):
    def write(docs, labels):
        docs.write.parquet(str(tmp_path / "documents.parquet"))
        labels.write.parquet(str(tmp_path / "labels.parquet"))
        return str(tmp_path)

    return write


def test_pipeline_over_odd_documents(spark, stored_tables, folder):
    text = "a plain sentence with enough words to be a document of its own kind"
    rows = [
        (1, text, "en", "a", 67),
        (2, text, "en", "a", 67),
        (3, None, None, None, None),
        (4, "", "en", "b", 0),
        (None, "no id in this row but some words all the same", "fr", None, 45),
        (5, " \n\t ", "en", "b", 4),
        (6, "long words repeated " * 4000, "en", "c", 80_000),
        (7, "x", "en", "c", 1),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = corpus_pipeline.run(spark, stored_tables(docs, labels))
    assert found.columns[:5] == docs.columns and {"ids", "n_ids", "lossless"} <= set(found.columns)
    rows = found.collect()
    assert all(r["lossless"] for r in rows)
    # The only line of the second document repeats one of the first.
    assert {r["text"] for r in rows if r["doc_id"] == 2} <= {""}
    assert {r["doc_id"] for r in rows} <= {1, 2, 3, 4, 5, 6, 7, None} and len(rows) > 2


def test_pipeline_over_empty_documents(spark, stored_tables):
    docs = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = corpus_pipeline.run(spark, stored_tables(docs, labels))
    assert found.count() == 0 and found.columns[:5] == docs.columns
