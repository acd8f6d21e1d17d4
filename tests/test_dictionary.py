"""What searching texts for the names of a large dictionary costs."""

import random

import numpy as np
import pyarrow as pa
import pytest

from parcelflow.operators import resolve


@pytest.fixture
def rows_of(monkeypatch):
    """Numbers of rows that a function of `resolve` was given or has settled, by its name."""
    seen = {}

    def watch(name):
        real = getattr(resolve, name)

        def watched(df, *rest):
            seen.setdefault(name, []).append((df.count(), *rest))
            return real(df, *rest)

        monkeypatch.setattr(resolve, name, watched)
        return seen

    return watch


def test_names_without_a_piece_in_the_texts_are_left_out_at_once(spark, rows_of, monkeypatch):
    monkeypatch.setattr(resolve, "BROADCAST_ROWS", 100, raising=False)
    names = [(i, f"Q{random.Random(i).getrandbits(100):025X}") for i in range(3_000)]
    dictionary = spark.createDataFrame([*names, (0, "STARA ŁOMŻA")], "priority int, name string")
    df = spark.createDataFrame([("w starej", 1), ("stara lomza 1", 2), (None, 3)], "t string, id int")
    settled = rows_of("settle")
    got = resolve.first_match_join(df, "t", dictionary, "hit", inline=0).collect()
    assert {r["id"]: r["hit"] for r in got} == {1: None, 2: "STARA ŁOMŻA", 3: None}
    assert max(n for n, *_ in settled["settle"]) < 10


def test_texts_with_a_long_name_are_not_searched_for_short_ones(spark, rows_of):
    dictionary = spark.createDataFrame([(1, "W"), (2, "AB"), (3, "KOLNO"), (4, "ZAMBROWSKA")], "priority int, name string")
    texts = ["ab kolno zambrowska", "w zambrowska", "kolno w", "ab w", "w", "x", "Zambrowska w"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    cut = rows_of("_text_pieces")
    got = resolve.first_match_join(df, "t", dictionary, "hit", "longest_match", inline=0).collect()
    assert {r["t"]: r["hit"] for r in got} == dict(
        zip(texts, ["ZAMBROWSKA", "ZAMBROWSKA", "KOLNO", "AB", "W", None, "ZAMBROWSKA"])
    )
    assert [(n, sizes) for n, sizes, _ in cut["_text_pieces"]] == [(7, [8]), (4, [4]), (3, [2]), (2, [1])]


@pytest.mark.parametrize("stretch", [1, 3, 7, 1 << 20])
def test_pieces_are_all_stretches_of_bytes_inside_a_text(monkeypatch, stretch):
    monkeypatch.setattr(resolve, "CUT_BYTES", stretch)
    texts = ["", "abcdefghij", "ŁÓDŹ", "abc", "", "aaaa", "日本語"]
    values = pa.array(["left out", *texts])[1:]
    found = {(int(row), int(h)) for rows, hashes in resolve._pieces(values, lambda _: [(2, None), (4, None)]) for row, h in zip(rows, hashes)}
    wanted = set()
    for row, text in enumerate(texts):
        data = text.encode()
        for size in (2, 4):
            for i in range(len(data) - size + 1):
                raw = np.frombuffer(data[i : i + size], np.uint8)
                wanted.add((row, int(resolve._windows(raw, size).view(np.int64)[0])))
    assert found == wanted


def test_names_of_common_pieces_meet_only_the_texts_they_are_in(spark, monkeypatch):
    pairs = [(i, j) for i in range(20) for j in range(20)]
    names = [(n, f"{i:03d}STRASSEN NUMMERNN{j:03d}") for n, (i, j) in enumerate(pairs)]
    texts = [f"in {name.lower()} oder" for _, name in names[::2]] + ["in 003strassen", "nummernn007"]
    dictionary = spark.createDataFrame(names, "priority int, name string")
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    made, real = [], resolve.lookup_join

    def watched(*given):
        made.append(real(*given))
        return made[-1]

    monkeypatch.setattr(resolve, "lookup_join", watched)
    got = resolve.first_match_join(df, "t", dictionary, "hit", inline=0).collect()
    known = {name for _, name in names}
    assert {r["t"]: r["hit"] for r in got} == {t: n if (n := t[3:-5].upper()) in known else None for t in texts}
    assert [rows.count() for rows in made] == [200, 202]


def test_lengths_and_bytes_of_names_are_of_any_kind(spark, monkeypatch):
    monkeypatch.setattr(resolve, "CUT_BYTES", 50)
    draw = random.Random(3)
    letters = "ABŁ日 -ß"
    words = {"".join(draw.choices(letters, k=draw.choice([1, 2, 3, 5, 8, 13, 40]))) for _ in range(200)}
    names = [(draw.randrange(3), w) for w in sorted(words)] + [(0, None), (1, "")]
    texts = ["".join(draw.choices(letters, k=draw.randrange(60))) for _ in range(150)] + [None, ""]
    dictionary = spark.createDataFrame(names, "priority int, name string")
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts])], "i int, t string")
    folded = spark.createDataFrame([(x,) for x in {*texts, *words}], "x string")
    fold = {r["x"]: r["y"] for r in folded.select("x", resolve.fold(resolve.F.col("x")).alias("y")).collect()}
    for mode in ("first_match", "longest_match"):
        got = resolve.first_match_join(df, "t", dictionary, "hit", mode, inline=0).collect()
        for row in got:
            inside = [(p, n) for p, n in names if n and fold[n] and row["t"] is not None and fold[n] in fold[row["t"]]]
            order = [(-len(n) if mode == "longest_match" else 0, p, n.encode()) for p, n in inside]
            assert row["hit"] == (min(order)[2].decode() if order else None)
