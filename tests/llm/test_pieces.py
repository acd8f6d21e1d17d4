"""Sampled segmentations against all ways through a lattice, awkward characters, numbered copies."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import sentencepiece
from pyspark.sql import functions as F

from parcelflow.llm import pieces


def test_awkward_characters_come_back(spark):
    texts = ["a ﷐ b", "﷐", "▁", "▁﷐▁ ▁", " ▁ ﷑﷒", "﷯ ▁x", "", " ", "\0▁"]
    vocab = pieces.vocabulary(pieces.MODEL, 1.0)
    coded = pieces.encode(texts, np.arange(len(texts), dtype=np.uint64), vocab)
    assert [pieces.decode(x, vocab) for x in coded] == texts
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pieces.encode_documents(docs).withColumn("back", pieces.decode_column(F.col("ids")))
    assert rows.filter("NOT lossless OR back <> text").isEmpty() and rows.count() == len(texts)


def test_every_way_is_drawn_by_its_weight():
    alpha, word, draws = 0.2, "then", 60_000
    vocab = pieces.vocabulary(pieces.MODEL, alpha)
    model = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    order = sorted(range(model.get_piece_size()), key=lambda i: (-model.get_score(i), i))
    rank = {model.id_to_piece(i): r for r, i in enumerate(order)}

    def ways(rest):
        if not rest:
            yield (), 0.0
        for n in range(1, len(rest) + 1):
            if rest[:n] in rank:
                for way, weight in ways(rest[n:]):
                    yield (rest[:n], *way), weight - alpha * math.log(rank[rest[:n]] + 2)

    weights = {way: math.exp(weight) for way, weight in ways(pieces.SPACE + word)}
    total = sum(weights.values())
    drawn = pieces.encode([word] * draws, np.arange(draws, dtype=np.uint64), vocab)
    found = Counter(tuple(model.id_to_piece(int(i)) for i in x) for x in drawn)
    assert set(found) <= set(weights) and len(weights) > 10
    for way, weight in weights.items():
        share = weight / total
        assert abs(found[way] / draws - share) < 5 * math.sqrt(share / draws) + 1e-4


def test_copies_have_samples_of_their_own(spark):
    text = "another conversation about understanding " * 8
    rows = [(1, text)] * 3 + [(2, text), (None, text), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_copy", F.lit("x"))
    plain = [tuple(r["ids"]) for r in pieces.encode_documents(docs, alpha=0.1).filter("doc_id = 1").collect()]
    assert len(set(plain)) == 1
    numbered = pieces.encode_documents(docs, copies=True, alpha=0.1)
    found = [tuple(r["ids"]) for r in numbered.filter("doc_id = 1").collect()]
    assert len(set(found)) == 3 and plain[0] in found
    assert numbered.filter("_copy = 'x'").count() == 6 and numbered.filter("NOT lossless").isEmpty()
