"""Pairs of lines that are looked at side by side."""

import random

import numpy as np
import pandas as pd

from parcelflow.llm import banded, lines


def changed(draw, text, edits, letters):
    made = list(text)
    for _ in range(edits):
        kind, at = draw.randrange(3), draw.randrange(len(made) + 1)
        if kind == 0:
            made.insert(at, draw.choice(letters))
        elif made:
            at = min(at, len(made) - 1)
            made[at : at + 1] = [] if kind == 1 else [draw.choice(letters)]
    return "".join(made)


def pairs_of(letters, seed):
    draw = random.Random(seed)
    for i in range(300):
        text = "".join(draw.choices(letters, k=draw.randrange(0, 90)))
        most = draw.randrange(0, 12) if i % 10 else draw.randrange(30, 90)
        other = changed(draw, text, draw.randrange(0, 16), letters)
        yield (text, other, most) if i % 9 else (text, "".join(draw.choices(letters, k=60)), most)


def test_pairs_side_by_side_are_those_within_the_limit():
    for seed, letters in enumerate(["ab", "abc def", "".join(map(chr, range(0x4E00, 0x4E00 + 300)))]):
        a, b, most = zip(*pairs_of(letters, seed), strict=True)
        plain = [banded.edit_distance(x, y, len(x) + len(y)) <= m for x, y, m in zip(a, b, most, strict=True)]
        assert banded.within(a, b, np.array(most)).tolist() == plain
        assert [banded.edit_distance(x, y, m) <= m for x, y, m in zip(a, b, most, strict=True)] == plain
    assert banded.within([], [], np.array([])).tolist() == []


def test_pairs_of_usual_lines_are_not_aligned_one_by_one(monkeypatch):
    draw = random.Random(1)
    a = ["".join(draw.choices("abcdefgh ", k=500)) for _ in range(40)]
    b = [changed(draw, x, 15 if i % 2 else 120, "abcdefgh ") for i, x in enumerate(a)]
    monkeypatch.setattr(banded, "edit_distance", None)
    assert banded.within(a, b, np.full(40, 25)).tolist() == [i % 2 == 1 for i in range(40)]


def test_pairs_of_a_task_are_those_that_counts_allow(monkeypatch):
    draw = np.random.default_rng(3)
    n = draw.integers(20, 60, 200)
    bags = draw.integers(0, 256, (8, lines.CLASSES))[draw.integers(0, 8, 200)] + draw.integers(-1, 2, (200, lines.CLASSES))
    bags = (bags % 256).astype(np.uint8)
    rows = pd.DataFrame({
        "line_id": draw.permutation(200) - 100, "signature": draw.integers(0, 6, 200), "n": n, "label": draw.integers(0, 40, 200),
        "bag": [x.tobytes() for x in bags], "part": draw.integers(0, 2, 200), "part_a": 0, "part_b": draw.integers(0, 2, 200),
    })
    rows["part"] = rows["part"].where(rows["part_b"] == 1, 0)
    most = lines.edits(n, 1, 0.2)
    wanted = set()
    for x in range(200):
        for y in range(200):
            p, q = rows.iloc[x], rows.iloc[y]
            if (p["signature"], p["part_b"]) != (q["signature"], q["part_b"]) or p["label"] == q["label"] or n[x] > n[y]:
                continue
            change = bags[x] - bags[y]
            near = n[y] - n[x] <= most[y] and np.minimum(change, -change).sum(dtype=int) <= 2 * most[y]
            if near and (p["part_b"] == 0 or p["part"] != q["part"]):
                wanted.add(tuple(sorted((int(p["line_id"]), int(q["line_id"])))))
    for seen in (lines.SEEN, 7):
        monkeypatch.setattr(lines, "SEEN", seen)
        found = lines._joiner(1, 0.2)(rows)
        assert {(int(a), int(b)) for a, b in found.to_numpy()} == wanted and len(wanted) > 20


def test_no_turn_follows_one_that_settles_little(spark, monkeypatch):
    # Lines with one passage in common and nothing else: no turn settles any of them.
    draw = random.Random(2)
    kept = "a passage that stands in all of them "
    texts = [kept + "".join(draw.choices("abcdefghij ", k=150)) for _ in range(40)]
    texts += [x[:-1] + "!" for x in texts[:5]]
    df = spark.createDataFrame(list(enumerate(texts)), "line_id long, line string")
    turns, real = [], lines._center_links
    monkeypatch.setattr(lines, "_center_links", lambda *x: turns.append(x[2]) or real(*x))
    roots = {r["node"]: r["root"] for r in lines.line_links(df).collect()}
    assert len(turns) == 1
    assert all(roots[i] == roots[40 + i] for i in range(5)) and len(roots) == 10 and len(set(roots.values())) == 5


def test_pairs_that_share_many_signatures_leave_few_calls(spark, monkeypatch):
    # Copies of a long line, each with other places changed, share most of their signatures.
    draw = random.Random(4)
    text = "".join(draw.choices("abcdefghij ", k=600))
    copies = [changed(draw, text, 40, "abcdefghij ") for _ in range(30)]
    df = spark.createDataFrame(list(enumerate([*copies, copies[0][:-1] + "!"])), "line_id long, line string")
    left, real = spark.sparkContext.accumulator(0), lines._joiner

    def counted(*limits):
        join = real(*limits)

        def run(tasks):
            pairs = join(tasks)
            left.add(len(pairs))
            return pairs

        return run

    monkeypatch.setattr(lines, "_joiner", counted)
    monkeypatch.setattr(lines, "CALL", 16)
    seen, classes = [], []
    # With all rows of a first line in one call, and with as many calls as they can have.
    for most in (1000, 0.1):
        monkeypatch.setattr(lines, "CALLS_OF_FIRST", most)
        before = left.value
        classes.append({(r["node"], r["root"]) for r in lines.line_links(df).collect()})
        seen.append(left.value - before)
    assert classes[0] == classes[1] and {n for n, _ in classes[0]} == {0, 30}
    assert 100 < seen[0] < seen[1] / 2
