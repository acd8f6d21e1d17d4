"""The corpus operators against plain versions, and their behaviour at the edges."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from parcelflow.llm import (
    cells,
    chat,
    covertree,
    graph,
    langid,
    lines,
    mixing,
    ordermin,
    pieces,
    queries,
    toxicity,
    urls,
)
from parcelflow.llm.banded import edit_distance

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def grouped(n, pairs):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, an empty and a long text, repeated rows and a clashing extra column."""
    rows = [
        (1, "one two three four five six", "en", "a", 27),
        (1, "one two three four five six", "en", "a", 27),
        (2, None, None, None, None),
        (3, "", "en", "b", 0),
        (None, "null id here", "fr", None, 12),
        (None, "null id here", "fr", None, 12),
        (4, " \n\t ", "en", "b", 3),
        (5, "long " * 30_000, "en", "c", 150_000),
    ]
    return spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("x")).withColumn("root", F.lit(1))


def test_edit_distance_in_a_band():
    rng = random.Random(1)
    for _ in range(3000):
        a = "".join(rng.choice("ab") for _ in range(rng.randint(0, 12)))
        b = "".join(rng.choice("ab") for _ in range(rng.randint(0, 12)))
        most = rng.randint(0, 8)
        assert edit_distance(a, b, most) == min(plain_distance(a, b), most + 1)


def test_components_of_a_path_a_star_and_a_loop(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, i) for i in range(101, 140)] + [(7, 7), (3, 4)]
    found = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    roots = {r["node"]: r["root"] for r in found}
    assert len({roots[i] for i in range(21)}) == 1
    assert len({roots[i] for i in range(100, 140)}) == 1
    assert roots[0] != roots[100]
    assert graph.components(spark.createDataFrame([], "a long, b long")).isEmpty()


def test_blocked_pairs_all_rows(spark):
    rows = spark.range(50).select(F.lit(1).alias("g"), F.col("id").alias("k"))
    met = set()
    tasks = {}
    for r in graph.blocked(rows, ["g"], "k", 8).collect():
        tasks.setdefault((r["part_a"], r["part_b"]), []).append(r)
    for (a, b), members in tasks.items():
        for x in members:
            for y in members:
                if x["k"] < y["k"] and (a == b or x["part"] != y["part"]):
                    assert (x["k"], y["k"]) not in met
                    met.add((x["k"], y["k"]))
    assert len(met) == 50 * 49 // 2


def test_language_is_learned_from_the_training_part(spark, folder):
    found = queries.QUERIES["op1_language_id"](spark, folder)
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    held = found.filter("held_out").join(truth, "doc_id").filter("lang IS NOT NULL")
    assert held.filter("lang = lang_pred").count() >= 0.9 * held.count()


def test_language_at_the_edges(spark, odd):
    model = langid.fit(odd)
    found = odd.select("text", model.predict(F.col("text")).alias("p")).select("text", "p.*").collect()
    for r in found:
        unknown = not any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == unknown
        assert 0 <= r["score"] <= 1
    nothing = langid.fit(odd.limit(0))
    assert {r[0] for r in odd.select(nothing.predict(F.col("text"))["lang_pred"]).collect()} == {"und"}


def test_top_k_with_ties_prunes_nothing_wanted(spark):
    rng = np.random.default_rng(2)
    vectors = rng.integers(-3, 4, (400, 4))
    data = [(int(i), [int(x) for x in v]) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame(data, "id long, vec array<long>")
    found = {}
    for r in covertree.top_k(frame.filter("id % 50 = 0"), frame, 7).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["id"], r["score"]))
    for q in range(0, 400, 50):
        best = sorted((-int(vectors[q] @ v), i) for i, v in enumerate(vectors) if i != q)[:7]
        assert sorted(found[q]) == [(k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert covertree.top_k(frame.limit(0), frame.limit(0), 3).isEmpty()


def test_search_inside_a_block_uses_both_trees():
    rng = np.random.default_rng(3)
    vectors = rng.integers(-50, 50, (1500, 6))
    search = covertree.Search(np.arange(300), vectors[:300], 5)
    search.run(np.arange(1500), vectors)
    scores = vectors[:300] @ vectors.T
    np.fill_diagonal(scores, -(10**9))
    assert (search.scores == -np.sort(-scores, axis=1)[:, :5]).all()


def test_lines_against_all_pairs(spark, docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").limit(60).collect()]
    base = "this is a line that is surely longer than forty characters"
    rows += [(9001, base), (9002, base[:-1]), (9003, "x" + base + "y"), (9004, base.replace("line", "lnie"))]
    some = spark.createDataFrame(rows, "doc_id long, text string")
    seen = [(d, n, x.strip()) for d, t in rows for n, x in enumerate(t.split("\n")) if x.strip()]
    distinct = list(dict.fromkeys(x for _, _, x in seen))
    long_ones = [i for i, x in enumerate(distinct) if len(x) >= 40]
    links = [
        (a, b)
        for k, a in enumerate(long_ones)
        for b in long_ones[k + 1 :]
        if abs(len(distinct[a]) - len(distinct[b])) <= 2 and edit_distance(distinct[a], distinct[b], 2) <= 2
    ]
    assert len(links) >= 3
    root, first = grouped(len(distinct), links), {}
    at = {x: i for i, x in enumerate(distinct)}
    for d, n, x in sorted(seen):
        first.setdefault(root[at[x]], (d, n))
    found = lines.line_classes(some, threshold=2, min_chars=40, share=0.0).collect()
    assert len(found) == len(seen)
    want = {(d, n): first[root[at[x]]] for d, n, x in seen}
    assert {(r["doc_id"], r["line_no"]): (r["class_doc_id"], r["class_line_no"]) for r in found} == want
    assert {(r["doc_id"], r["line_no"]) for r in found if r["kept"]} == set(first.values())


def test_near_lines_by_length_against_all_pairs(spark, docs):
    rng = random.Random(3)
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").limit(60).collect()]
    seen = list(dict.fromkeys(x.strip() for _, t in rows for x in t.split("\n") if x.strip()))
    for i, x in enumerate(seen[:200]):
        changed = list(x)
        for k in rng.sample(range(len(x)), len(x) // 20):
            changed[k] = rng.choice(["", "#", changed[k] + "+"])
        rows.append((9000 + i, "".join(changed)))
    rows += [(9900, "a short line to join"), (9901, "a short lime to join"), (9902, "a tiny"), (9903, "a tony")]
    distinct = list(dict.fromkeys(x.strip() for _, t in rows for x in t.split("\n") if x.strip()))
    links, beyond = [], 0
    for a in range(len(distinct)):
        for b in range(a + 1, len(distinct)):
            n = max(len(distinct[a]), len(distinct[b]))
            most = max(1, n // 20)
            if min(len(distinct[a]), len(distinct[b])) >= 15 and abs(len(distinct[a]) - len(distinct[b])) <= most:
                edits = edit_distance(distinct[a], distinct[b], most)
                links += [(a, b)] if edits <= most else []
                beyond += 2 < edits <= most
    assert beyond >= 50
    root = grouped(len(distinct), links)
    frame = spark.createDataFrame(enumerate(distinct), "doc_id long, text string")
    found = {r["doc_id"]: r["class_doc_id"] for r in lines.line_classes(frame).collect()}
    assert found == dict(enumerate(root))


def test_repeated_lines_go_and_all_rows_stay(spark, odd):
    rows = [(1, "same\nown one"), (2, "same\n\nown two"), (3, None), (4, "same"), (None, "other")]
    some = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit(0))
    cut = {r["doc_id"]: r["text"] for r in lines.drop_repeated_lines(some).collect()}
    assert cut == {1: "same\nown one", 2: "\nown two", 3: None, 4: "", None: "other"}
    assert lines.drop_repeated_lines(odd).count() == odd.count()
    assert lines.drop_repeated_lines(odd.limit(0)).isEmpty()


def test_mix_meets_targets(spark, docs):
    mixed = mixing.mix(docs).cache()
    assert mixed.count() == docs.count()
    for r in mixed.groupBy("source").agg(
        F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")
    ).collect():
        assert abs(r["taken"] - r["target"]) <= r["most"] / 2 + 1
    assert mixed.filter("taken > 3 * size").isEmpty()
    assert mixed.exceptAll(mixing.mix(docs.repartition(3))).isEmpty()
    words = mixing.repeated(mixed).select(F.sum(mixing.word_count(F.col("text")))).first()[0]
    assert words == mixed.agg(F.sum("taken")).first()[0]


def test_mix_of_whole_documents(spark, docs):
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    rows += [(None, f"without an id {'x ' * (i % 40)}{i}", "s9") for i in range(100)]
    rows += [(None, "the same words again", "s9")] * 60
    some = spark.createDataFrame(rows, "doc_id long, text string, source string")
    mixed = mixing.mix(some).cache()
    assert mixed.count() == len(rows) and mixed.filter("taken <> copies * size").isEmpty()
    for r in mixed.groupBy("source").agg(
        F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most")
    ).collect():
        assert abs(r["taken"] - r["target"]) <= r["most"] / 2 + 1
    texts = {r["text"] for r in some.collect()}
    assert {r["text"] for r in mixing.repeated(mixed).collect()} <= texts
    assert mixed.exceptAll(mixing.mix(some.repartition(3))).isEmpty()


def test_filling_against_a_loop(spark):
    sizes = [100, 5, 40, 1, 900, 0]
    weights = [5.0, 2.0, 1.0, 5.0, 2.0, 1.0]
    frame = spark.createDataFrame(list(zip(range(6), sizes, weights, strict=True)), "k int, source_size long, weight double")
    found = [r["target"] for r in mixing.fill(frame, 3, 1.0).orderBy("k").collect()]
    full: set = set()
    while True:
        left = sum(sizes) - sum(3 * sizes[i] for i in full)
        level = left / sum(w for i, w in enumerate(weights) if i not in full)
        over = {i for i in range(6) if i not in full and level * weights[i] > 3 * sizes[i]}
        if not over:
            break
        full |= over
    want = [3 * s if i in full else level * weights[i] for i, s in enumerate(sizes)]
    assert found == pytest.approx(want)


def test_mix_at_the_edges(odd):
    mixed = mixing.mix(odd)
    assert mixed.count() == odd.count()
    assert {r["size"] for r in mixed.filter("text IS NULL OR doc_id = 3").collect()} == {0}
    assert mixing.mix(odd.limit(0)).isEmpty()


def test_toxicity_finds_words_in_long_texts(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(200)]
    made = []
    for i in range(240):
        text = rng.choices(words, k=rng.randint(5, 300))
        if i % 3 == 0:
            text.insert(rng.randrange(len(text)), rng.choice(["nasty", "vile"]))
        made.append((i, " ".join(text), int(i % 3 == 0)))
    frame = spark.createDataFrame(made, "doc_id long, text string, toxic int")
    model = toxicity.fit(frame.drop("toxic"), frame.filter("doc_id % 5 <> 0").select("doc_id", "toxic"))
    held = frame.filter("doc_id % 5 = 0").withColumn("score", model.score(F.col("text"))).collect()
    right = sum((r["score"] >= 0.5) == bool(r["toxic"]) for r in held)
    assert right >= 0.9 * len(held)


def test_toxicity_without_anything_to_learn(spark, odd):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    scores = odd.select(toxicity.fit(odd, labels).score(F.col("text")).alias("s")).collect()
    assert len(scores) == odd.count() and all(0 <= r["s"] <= 1 for r in scores)


def test_gradient_agrees_with_differences():
    rng = np.random.default_rng(5)
    words = ["ab", "cd", "ef", "gh"]
    network = toxicity.Network.fresh({"ab": 1, "cd": 2}, rng)
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    places = np.array([[0, 1, 2, -1], [3, 0, -1, -1]])
    target = np.array([1.0, 0.0])

    def loss():
        logit = network.logits(network.gates(network.inputs(words)[0]), places).astype(np.float64)
        return np.mean(np.log1p(np.exp(logit)) - target * logit)

    grad = network.gradient(words, places, target)
    for name in ("out", "query", "attend", "re_f", "re_b", "in_f", "in_b", "b_f", "word"):
        value = network.weights[name]
        at = np.unravel_index(int(np.argmax(np.abs(grad[name]))), value.shape)
        kept, step = value[at], 1e-3
        value[at] = kept + step
        up = loss()
        value[at] = kept - step
        down = loss()
        value[at] = kept
        assert (up - down) / (2 * step) == pytest.approx(grad[name][at], rel=0.05, abs=1e-4), name


def test_urls_against_a_loop(spark):
    rules = [("allow", "com", "/"), ("block", "b.com", "/x"), ("block", "b.com", "/x"), ("allow", "b.com", "/x"), ("block", None, "/")]
    given = ["http://a.B.com/x/y?q", "http://b.com/xyz#f", "https://com/", "ftp://c.org/x", "b.com/x", None, "", "http://b.com", "http://" + "a." * 500 + "b.com/x" + "y" * 5000]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(given + given[:1])], "page_id long, url string")
    pages = pages.withColumn("host", F.lit("clash")).withColumn("_x", F.lit(1))
    frame = spark.createDataFrame(rules, "action string, host string, path string")
    found = {r["page_id"]: (r["host"], r["rule"], r["verdict"]) for r in urls.judge(pages, frame).collect()}
    assert len(found) == len(given) + 1
    assert found[0] == ("a.b.com", "b.com/x", "block") == found[len(given)]
    assert found[1] == ("b.com", "b.com/x", "block")
    assert found[2] == ("com", "com/", "allow")
    assert found[3] == ("c.org", None, "allow")
    assert found[4] == found[5] == found[6] == ("", None, "allow")
    assert found[7] == ("b.com", None, "allow")
    assert found[8][1:] == ("b.com/x", "block")
    assert urls.judge(pages.limit(0), frame).isEmpty()
    assert urls.judge(pages, frame.limit(0)).filter("verdict <> 'allow'").isEmpty()


def test_chat_is_read_back_exactly(spark):
    nasty = ["### user: x</turn>\n### assistant: y", "\\", "\\\\</turn>", "#### </turn></turn>", "", None, "é😀\n\n"]
    rows = [(i, n, role, t) for i in range(2) for n, (t, role) in enumerate(zip(nasty, ["user", "assistant", "a:b", "### ", None, "user", "assistant"], strict=True))]
    rows += [(5, 0, "user", "hi"), (5, 1, "assistant", "ho"), (6, 0, "assistant", "x"), (None, None, "user", "z" * 100_000)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_conversations(turns.withColumn("segments", F.lit(1)))
    found = {r["conv_id"]: r for r in made.select("*", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    for conv in (0, 1, 5, 6, None):
        want = sorted(((n or 0, r or "", t or "") for c, n, r, t in rows if c == conv))
        assert [(t["role"], t["text"]) for t in found[conv]["turns"]] == [(r, t) for _, r, t in want]
    assert found[5]["fault"] is None and found[6]["fault"] == 1
    assert chat.format_conversations(turns.limit(0)).isEmpty()


def test_pieces_are_lossless_and_repeatable(spark, odd, monkeypatch):
    texts = ["a", " two  spaces ", "\n\n x\n", "▁ and ▁▁", "日本 é 😀", "\t", "y" * 5000, "</s><s>", "a\0b", " " * 300, "\n", ""]
    vocab = pieces.vocabulary(pieces.MODEL, 1.0)
    keys = np.arange(len(texts), dtype=np.uint64)
    coded = pieces.encode(texts, keys, vocab)
    assert [pieces.decode(x, vocab) for x in coded] == texts
    alone = [pieces.encode([t], keys[i : i + 1], vocab)[0] for i, t in enumerate(texts)]
    assert all((a == b).all() for a, b in zip(coded, alone, strict=True))
    # Nor does it matter where a slice ends.
    monkeypatch.setattr(pieces, "DISTINCT", 3)
    assert all((a == b).all() for a, b in zip(coded, pieces.encode(texts, keys, vocab), strict=True))
    rows = pieces.encode_documents(odd)
    assert rows.filter("NOT lossless").isEmpty() and rows.count() == odd.count()
    back = rows.filter(~F.col("text").eqNullSafe(pieces.decode_column(F.col("ids"))))
    assert back.isEmpty()
    assert rows.filter("text IS NULL AND ids IS NOT NULL").isEmpty()


def test_pieces_are_drawn_by_weight():
    vocab = pieces.vocabulary(pieces.MODEL, 0.3)
    drawn = pieces.encode(["then"] * 20_000, np.arange(20_000, dtype=np.uint64), vocab)
    weight = dict(zip(vocab.ids.tolist(), vocab.weights.tolist(), strict=True))
    counts: dict = {}
    for x in drawn:
        counts[tuple(x.tolist())] = counts.get(tuple(x.tolist()), 0) + 1
    shares = {k: np.exp(sum(weight[i] for i in k)) for k in counts}
    total = sum(shares.values())
    for k, n in counts.items():
        if n > 500:
            assert n / 20_000 == pytest.approx(shares[k] / total, rel=0.15)


def test_vectors_without_a_part(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [0.0, 0.0], 1), (4, None, 1), (5, [nan, 1.0], 1), (6, [1.0, 0.0], None), (7, [1.0, 0.01], 1), (8, [1.0, 0.0], 2), (9, [1.0, None], 1), (10, [1.0], 1), (None, [1.0, 0.0], 1), (2, [1.0, 0.0], 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    found = {}
    for r in cells.near_duplicates(frame.withColumn("key", F.lit(1))).collect():
        found.setdefault(r["vec_id"], []).append((r["n_links"], r["component_id"], r["kept"]))
    assert found[1] == [(3, 1, True)] and found[7] == [(3, 1, False)]
    assert found[2] == [(3, 1, False)] * 2
    for alone in (3, 4, 5, 6, 8, 9, 10):
        assert found[alone] == [(0, alone, True)]
    assert cells.near_duplicates(frame.limit(0)).isEmpty()


def test_near_documents_against_all_pairs(spark, docs):
    rng = random.Random(6)
    rows = [(r["doc_id"], r["text"]) for r in docs.orderBy("doc_id").limit(120).collect()]
    for i in range(30):
        words = rows[i][1].split()
        for k in range(0, len(words), 25):
            words[k] = rng.choice(["new", "other"])
        rows.append((9000 + i, " ".join(words)))
    split = [t.lower().split() for _, t in rows]
    links = []
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            most = ordermin.similarity_limit(len(split[a]), len(split[b]), 0.8)
            if edit_distance(split[a], split[b], most) <= most:
                links.append((a, b))
    root = grouped(len(rows), links)
    least: dict = {}
    for (d, _), r in zip(rows, root, strict=True):
        least[r] = min(least.get(r, d), d)
    found = ordermin.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["class_id"] for r in found} == {d: least[r] for (d, _), r in zip(rows, root, strict=True)}
    assert {r["doc_id"] for r in found if r["kept"]} == set(least.values())


def test_sketches_meet_down_to_the_link_rule():
    rng = random.Random(8)
    sketcher = ordermin.Sketcher(ordermin.WORDS, ordermin.SKETCHES, ordermin.RUNS, ordermin.SEED)
    vocabulary = [f"w{i}" for i in range(3000)]
    for share in (0.08, 0.1, 0.15, 0.2):
        for n in [40, 150, 600] * 30:
            text = [rng.choice(vocabulary) for _ in range(n)]
            other = list(text)
            for k in range(int(share * n)):
                other[int(k / share)] = "new"
            with np.errstate(over="ignore"):
                assert (sketcher.sketch(text) == sketcher.sketch(other)).any(), (share, n)


def test_one_shared_sketch_is_enough(monkeypatch, spark):
    text = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*text[:i], "new", *text[i + 1 :]])) for i in (10, 25, 40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(ordermin, "ROUNDS", 0)
    single = [r["class_id"] for r in ordermin.near_duplicates(frame, sketches=1, runs=1, seed=5).collect()]
    assert single == [10, 10, 10]
    compare = ordermin._alike(0.8)
    bag = ordermin.packed(np.bincount([1, 2, 3, 4, 5], minlength=ordermin.CLASSES))
    group = pd.DataFrame({"key": [b"a", b"b"], "label": [b"a", b"b"], "bag": [bag, bag], "n_words": 5, "part": 0})
    group["part_a"] = group["part_b"] = group["band"] = 0
    group["sketch"] = [np.array([1, 2, 3]), np.array([1, 7, 8])]
    assert compare(group).to_numpy().tolist() == [[b"a", b"b"]]


def test_one_document_of_each_group_stays(odd):
    left = ordermin.first_of_each(odd)
    assert left.columns == odd.columns
    ids = sorted((r["doc_id"] or 0, r["text"] is None) for r in left.collect())
    assert ids == [(0, False), (1, False), (2, True), (3, False), (4, False), (5, False)]
    assert ordermin.first_of_each(odd.limit(0)).isEmpty()


def test_pipeline_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, kept, folder)
        assert made.columns == docs.columns
        path = f"{spark.conf.get('spark.checkpoint.dir')}/{name.replace(' ', '')}-{hashlib.md5(name.encode()).hexdigest()}"
        made.write.mode("overwrite").parquet(path)
        before, kept = kept, spark.read.parquet(path)
        if name == "toxicity":
            gone = before.join(kept, "doc_id", "anti").join(labels, "doc_id")
            assert gone.filter("toxic = 0").count() <= 0.02 * docs.count()
            assert kept.join(labels.filter("toxic = 1"), "doc_id").count() <= 2
        if name == "line dedup":
            assert kept.count() == before.count()
        if name == "MinHash near-dedup":
            assert kept.count() < before.count()
            classes = ordermin.near_duplicates(before).filter("kept").count()
            assert kept.count() == classes
    last = corpus_pipeline.STAGES[-1][1](spark, kept, folder)
    assert last.count() == kept.count() and last.filter("NOT lossless").isEmpty()
