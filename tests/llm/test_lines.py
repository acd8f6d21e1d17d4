"""What the rows of the line join hold."""

from pathlib import Path

import numpy as np

from parcelflow import session
from parcelflow.llm import lines


def test_signatures_stay_narrow_until_those_of_one_line_are_gone(spark, monkeypatch):
    texts = ["a line that stands here once more", "a line that stands here once mode", "something else, said at some length"]
    df = spark.createDataFrame(list(enumerate(texts)), "line_id long, line string")
    kept, real = [], lines.settle
    monkeypatch.setattr(lines, "settle", lambda rows: kept.append(real(rows)) or kept[-1])
    links = {(r["node"], r["root"]) for r in lines.line_links(df).collect()}
    assert {n for n, _ in links} == {0, 1} and len({root for _, root in links}) == 1
    assert lines.signatures(df, lines.Rule(lines.THRESHOLD, lines.SHARE)).columns == ["line_id", "signature"]
    members = next(rows for rows in kept if "bag" in rows.columns)
    assert {(r["line_id"], r["n"]) for r in members.collect()} == {(0, 33), (1, 33)}


def test_a_substring_is_looked_up_by_itself_and_then_where_it_stands():
    rule = lines.Rule(lines.THRESHOLD, lines.SHARE)
    texts = ["one line of the corpus that is long enough to be cut", "a one line of the corpus that is long enough to be cut"]
    with np.errstate(over="ignore"):
        _, _, _, hashes, plain = lines.Hashed(texts[:1], rule).segments()
        table = np.zeros(1 << lines.TABLE_BITS, np.uint8)
        for i in range(lines.HASH_BITS):
            table[lines._place(hashes, i)] = 1
        probe = lines.Hashed(texts[1:], rule).probes
        # Without the bits of the substrings alone nothing is asked for, with them at least one segment is met.
        assert len(probe(lines.Bits(np.packbits(table, bitorder="little")), -9, 99)[0]) == 0
        for i in range(lines.PLAIN_BITS):
            table[lines._place(plain, i)] = 1
        found = probe(lines.Bits(np.packbits(table, bitorder="little")), -9, 99)[1]
    assert len(set(found.tolist()) & set(hashes.tolist())) >= 1


def test_tables_and_shuffles_of_the_join_are_gone_when_it_ends(spark, monkeypatch):
    texts = [f"line number {i % 40} of all the lines that are here, {'once' if i < 40 else 'twice'}" for i in range(80)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    made, real = [], session.scratch_path
    monkeypatch.setattr(session, "scratch_path", lambda *x: made.append(real(*x)) or made[-1])
    cut = lines.drop_repeated_lines(docs)
    left = [x for x in made if Path(x.removeprefix("file:")).exists()]
    assert len(made) > 10 and len(left) == 1
    assert cut.count() == 80
    assert session.FREE_SHUFFLES not in spark.conf.getAll


def test_a_result_that_reads_passing_tables_is_stored_before_they_go(spark):
    kept = []

    @session.passing
    def inner():
        kept.append(session.stored(spark.range(10), "inner"))
        return kept[0].filter("id > 6")

    @session.passing
    def outer():
        kept.append(inner())
        session.discard(kept[0])
        return session.stored(kept[-1].filter("id > 7"), "outer")

    assert sorted(r["id"] for r in outer().collect()) == [8, 9]
    assert not any(Path(f.removeprefix("file:")).exists() for x in kept for f in x.inputFiles())
