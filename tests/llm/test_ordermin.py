"""What the near-duplicate join leaves behind, and which texts it picks."""

from pathlib import Path

from parcelflow import session
from parcelflow.llm import ordermin

WORDS = "the quick brown fox jumps over a lazy dog while seven other foxes look on from the far hill".split()


def _texts():
    rows = [(i, " ".join([*WORDS[: i % 19], f"w{i % 5}", *WORDS[i % 19 :]])) for i in range(60)]
    # Rows that repeat an id and text, equal texts of other ids, and null ids.
    return [*rows, rows[3], rows[3], (100, rows[3][1]), (None, rows[4][1]), (None, "no id but a text"), (None, "no id but a text")]


def test_tables_of_the_near_duplicates_are_gone_when_they_end(spark, monkeypatch):
    docs = spark.createDataFrame(_texts(), "doc_id long, text string")
    made, real = [], session.scratch_path
    monkeypatch.setattr(session, "scratch_path", lambda *x: made.append(real(*x)) or made[-1])
    found = ordermin.near_duplicates(docs)
    left = [x for x in made if Path(x.removeprefix("file:")).exists()]
    assert len(made) > 10 and len(left) == 1
    classes = {(r["doc_id"], r["class_id"], r["class_docs"], r["kept"]) for r in found.collect()}
    assert found.count() == 66
    assert {c for c in classes if c[0] is None} == {(None, 0, 64, False), (None, None, 2, True)}
    assert {c[1:3] for c in classes if c[0] is not None} == {(0, 64)}
    assert [c[0] for c in classes if c[3]].count(0) == 1 and ordermin.first_of_each(docs).count() == 2


def test_only_texts_of_repeated_rows_are_grouped(spark, monkeypatch):
    docs = spark.createDataFrame(_texts(), "doc_id long, text string")
    kept, real = [], ordermin.stored
    monkeypatch.setattr(ordermin, "stored", lambda rows, name: kept.append((name, rows)) or real(rows, name))
    ordermin.near_duplicates(docs)
    texts = next(rows for name, rows in kept if name == "texts")
    plan = texts._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan and plan.count("first(text") == 1


def test_a_center_is_chosen_of_those_that_the_words_allow(spark):
    def text(words):
        hashes = ordermin._word_hashes(words)
        return bytearray(ordermin.packed(ordermin.np.bincount((hashes % 256).astype(int), minlength=256)))

    other = [f"w{i}" for i in range(len(WORDS))]
    kind = "key binary, n_words int, bag binary"
    bags = spark.createDataFrame(
        [(bytearray(k), len(w), text(w)) for k, w in ((b"x", WORDS), (b"a", other), (b"b", WORDS))], kind
    )
    shared = [(b"x", 1), (b"a", 1), (b"x", 2), (b"a", 2), (b"x", 3), (b"b", 3)]
    rows = [(bytearray(k), band, bytearray(k), len(WORDS)) for k, band in shared]
    labelled = spark.createDataFrame(rows, "key binary, band long, label binary, n_words int")
    for turn in range(4):
        pairs = ordermin._one_center_each(labelled, bags, None, turn, 0.8).collect()
        assert [{bytes(p["key"]), bytes(p["center"])} for p in pairs] == [{b"x", b"b"}]
