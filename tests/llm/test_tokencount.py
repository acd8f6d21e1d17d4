"""Token counts against the public library, and at the edges."""

from __future__ import annotations

import random

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from parcelflow.llm import queries, tokencount

ALPHABET = [*" \n\ttheanoi e", tokencount.SPACE, "<s>", "</s>", "é", "😀", "①", "\0", "ing", "  ", "漢"]


@pytest.fixture(scope="module")
def library():
    path = str(public_tokenizers.path("piece_bpe_32k.model"))
    return sentencepiece.SentencePieceProcessor(model_file=path)


@pytest.fixture
def merges():
    found = tokencount.merges(tokencount.MODEL)
    found.known.clear()
    return found


def test_counts_are_those_of_the_library(library, merges):
    rng = random.Random(3)
    texts = ["".join(rng.choices(ALPHABET, k=rng.randrange(60))) for _ in range(5000)]
    texts += ["", " " * 999, "a" * 4000, "ab" * 3000, "\n" * 50, " \n \n  a", "漢字" * 500]
    assert [merges.tokens(t) for t in texts] == [len(x) for x in library.encode(texts)]


def test_words_apart_and_the_whole_text_give_the_same(merges):
    rng = random.Random(4)
    whole = tokencount.Merges(merges.ranks, cut=False)
    for _ in range(500):
        text = "".join(rng.choices(ALPHABET, k=100))
        assert whole.tokens(text) == merges.tokens(text)


def test_texts_of_many_slices_and_full_memory(monkeypatch, library, merges):
    rng = random.Random(5)
    text = "".join(rng.choices(ALPHABET, k=5000))
    marked = tokencount.SPACE + text.replace(" ", tokencount.SPACE)
    parts = list(tokencount.sliced(marked, 40))
    assert "".join(parts) == marked and len(parts) > 50
    monkeypatch.setattr(tokencount, "REMEMBERED", 7)
    assert merges.tokens(text) == len(library.encode(text))
    assert len(merges.known) <= 7


def test_query_over_all_documents(spark, folder, library):
    got = {r["doc_id"]: r for r in queries.op12_token_counts(spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    assert len(got) == len(rows)
    for row in rows:
        text, found = row["text"] or "", got[row["doc_id"]]
        n = len(library.encode(text))
        assert (found["n_bytes"], found["n_tokens"], found["over_limit"]) == (
            len(text.encode()),
            n,
            n > 4096,
        )


def test_odd_and_empty_tables(spark):
    rows = [(1, "a b", "x"), (1, "a b", "x"), (None, None, None), (2, "", "y"), (3, "long " * 30_000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    docs = docs.withColumn("_codes", F.lit(1))
    got = tokencount.count_tokens(docs, limit=2)
    assert got.columns == ["doc_id", "text", "_codes", "n_bytes", "n_tokens", "over_limit"]
    found = sorted((str(r["doc_id"]), r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got.collect())
    assert found[:2] == [("1", 3, 2, False)] * 2
    assert found[2] == ("2", 0, 0, False) and found[4] == ("None", 0, 0, False)
    assert found[3][1] == 150_000 and found[3][3]
    assert tokencount.count_tokens(docs.limit(0)).count() == 0
    with pytest.raises(Exception, match="path|No such|not found|Not found"):
        tokencount.merges("/nowhere/none.model")
