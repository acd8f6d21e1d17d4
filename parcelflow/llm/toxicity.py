"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

A text is cut into overlapping windows of words. A word enters as its own vector, if it is in the
vocabulary, beside the mean of the vectors of its character trigrams. Two gated recurrent layers read
a window in both directions, attention weights their states, and a linear layer gives the window's
logit. The score of a text is that of its worst window, so a short passage in a long text is found.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelflow.llm.tables import settle
from parcelflow.operators.joins import lookup_join

# Labelled documents learned from, of each label, and the most characters of such a document. The
# sample is drawn by a seeded hash; longer documents are scored whole like all others.
TRAIN_DOCS = {0: 2_400, 1: 800}
TRAIN_CHARS = 20_000

WINDOW = 32
STRIDE = 24
WORD_SIZE, CHAR_SIZE, HIDDEN = 8, 8, 8
BUCKETS = 8_192
VOCABULARY = 8_000
MIN_DOCS = 4
STEPS = 300
BATCH = 24
RATE = 0.02
SEED = 3
# Word inputs kept by a Python worker, and windows computed at once.
CACHE = 60_000
CHUNK = 2_048


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every character trigram of the words, framed by marks, and the word it is from."""
    framed = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(framed.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    word = np.repeat(np.arange(len(words)), sizes)
    mixed = codes[:-2] * np.uint64(0x9E3779B1) + codes[1:-1] * np.uint64(0x85EBCA77) + codes[2:]
    mixed = (mixed ^ (mixed >> np.uint64(15))) * np.uint64(0xC2B2AE3D27D4EB4F)
    inside = word[:-2] == word[2:]
    return ((mixed >> np.uint64(40)) % np.uint64(BUCKETS)).astype(np.int64)[inside], word[:-2][inside]


def windows(n: int) -> np.ndarray:
    """Places of the words of each window, a row per window; -1 is padding. The windows overlap and the
    last one ends with the text."""
    if n <= WINDOW:
        return np.where(np.arange(WINDOW) < n, np.arange(WINDOW), -1)[None]
    starts = np.arange(0, n - WINDOW + STRIDE, STRIDE)
    starts = np.minimum(starts, n - WINDOW)
    return starts[:, None] + np.arange(WINDOW)


@dataclass
class Network:
    """Parameters; ``vocabulary`` maps words to rows of ``word`` from 1, row 0 is any other word."""

    vocabulary: dict[str, int]
    weights: dict[str, np.ndarray]

    @staticmethod
    def fresh(vocabulary: dict[str, int], rng: np.random.Generator) -> Network:
        inputs = WORD_SIZE + CHAR_SIZE
        draw = lambda *shape, s: rng.normal(0, s, shape).astype(np.float32)
        weights = {
            "word": draw(len(vocabulary) + 1, WORD_SIZE, s=0.3),
            "char": draw(BUCKETS, CHAR_SIZE, s=0.3),
            "attend": draw(2 * HIDDEN, 2 * HIDDEN, s=0.3),
            "query": draw(2 * HIDDEN, s=0.3),
            "out": draw(2 * HIDDEN, s=0.3),
            "bias": np.zeros(1, np.float32),
        }
        for way in "fb":
            weights[f"in_{way}"] = draw(inputs, 3 * HIDDEN, s=inputs**-0.5)
            weights[f"re_{way}"] = draw(HIDDEN, 3 * HIDDEN, s=HIDDEN**-0.5)
            weights[f"b_{way}"] = np.zeros(3 * HIDDEN, np.float32)
        return Network(vocabulary, weights)

    def inputs(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """Input vector of each of the given words, and what made it."""
        at = np.fromiter((self.vocabulary.get(w, 0) for w in words), np.int64, len(words))
        bucket, word = trigrams(words)
        count = np.maximum(np.bincount(word, minlength=len(words)), 1).astype(np.float32)
        starts = np.concatenate(([0], np.cumsum(np.bincount(word, minlength=len(words)))[:-1]))
        char = np.add.reduceat(self.weights["char"][bucket], starts, axis=0) / count[:, None]
        return np.hstack([self.weights["word"][at], char]), (at, bucket, word, count)

    def states(self, projected: np.ndarray, real: np.ndarray, way: str, keep: bool = False):
        """States of one direction for windows x places; ``projected`` has the inputs' share of gates."""
        recurrent = self.weights[f"re_{way}"]
        h = np.zeros((len(projected), HIDDEN), np.float32)
        states, saved = np.zeros((*real.shape, HIDDEN), np.float32), []
        places = range(real.shape[1]) if way == "f" else range(real.shape[1] - 1, -1, -1)
        for t in places:
            x, on = projected[:, t], real[:, t, None]
            gates = _sigmoid(x[:, : 2 * HIDDEN] + h @ recurrent[:, : 2 * HIDDEN])
            update, reset = gates[:, :HIDDEN], gates[:, HIDDEN:]
            new = np.tanh(x[:, 2 * HIDDEN :] + (reset * h) @ recurrent[:, 2 * HIDDEN :])
            if keep:
                saved.append((t, h, update, reset, new))
            h = np.where(on, (1 - update) * h + update * new, h)
            states[:, t] = h
        return states, saved

    def pooled(self, states: np.ndarray, real: np.ndarray):
        """Logit of each window by attention over its states."""
        hidden = np.tanh(states @ self.weights["attend"])
        score = np.where(real, hidden @ self.weights["query"], -1e9)
        weight = np.exp(score - score.max(axis=1, keepdims=True)) * real
        weight /= np.maximum(weight.sum(axis=1, keepdims=True), 1e-9)
        context = (weight[..., None] * states).sum(axis=1)
        return context @ self.weights["out"] + self.weights["bias"][0], hidden, weight, context

    def gates(self, inputs: np.ndarray) -> np.ndarray:
        """The inputs' share of the gates of both directions, side by side."""
        return np.hstack([inputs @ self.weights[f"in_{w}"] + self.weights[f"b_{w}"] for w in "fb"])

    def logits(self, gates: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Logit of each window; ``places`` are rows of ``gates``, -1 is padding."""
        found = np.empty(len(places), np.float32)
        for i in range(0, len(places), CHUNK):
            part = places[i : i + CHUNK]
            real = part >= 0
            both = gates[part]
            states = [
                self.states(both[..., : 3 * HIDDEN], real, "f")[0],
                self.states(both[..., 3 * HIDDEN :], real, "b")[0],
            ]
            found[i : i + CHUNK] = self.pooled(np.concatenate(states, axis=2), real)[0]
        return found

    def gradient(self, words: list[str], places: np.ndarray, target: np.ndarray):
        """Gradient of the log loss of some windows, which are rows of ``places`` into ``words``."""
        w, real = self.weights, places >= 0
        inputs, (at, bucket, word, count) = self.inputs(words)
        both = self.gates(inputs)[places]
        runs = [self.states(both[..., 3 * HIDDEN * i : 3 * HIDDEN * (i + 1)], real, way, True) for i, way in enumerate("fb")]
        states = np.concatenate([r[0] for r in runs], axis=2)
        logit, hidden, weight, context = self.pooled(states, real)
        d_logit = (_sigmoid(logit) - target) / len(target)
        grad = {"out": context.T @ d_logit, "bias": np.array([d_logit.sum()], np.float32)}
        d_context = d_logit[:, None] * w["out"]
        d_states = weight[..., None] * d_context[:, None]
        d_weight = (states * d_context[:, None]).sum(axis=2)
        d_score = weight * (d_weight - (weight * d_weight).sum(axis=1, keepdims=True))
        grad["query"] = (hidden * d_score[..., None]).sum(axis=(0, 1))
        d_hidden = d_score[..., None] * w["query"] * (1 - hidden**2)
        grad["attend"] = np.einsum("ntj,ntk->jk", states, d_hidden)
        d_states = d_states + d_hidden @ w["attend"].T
        d_inputs = np.zeros_like(inputs)
        for i, way in enumerate("fb"):
            recurrent = w[f"re_{way}"]
            d_re, d_gates = np.zeros_like(recurrent), np.zeros((*real.shape, 3 * HIDDEN), np.float32)
            d_h = np.zeros((len(places), HIDDEN), np.float32)
            for t, h, update, reset, new in reversed(runs[i][1]):
                d_h = d_h + d_states[:, t, HIDDEN * i : HIDDEN * (i + 1)]
                on = real[:, t, None]
                d_new = d_h * update * (1 - new**2) * on
                d_reset_h = d_new @ recurrent[:, 2 * HIDDEN :].T
                d_update = d_h * (new - h) * update * (1 - update) * on
                d_reset = d_reset_h * h * reset * (1 - reset)
                d_pair = np.hstack([d_update, d_reset])
                d_re[:, : 2 * HIDDEN] += h.T @ d_pair
                d_re[:, 2 * HIDDEN :] += (reset * h).T @ d_new
                d_gates[:, t] = np.hstack([d_pair, d_new])
                past = d_h * (1 - update) + d_reset_h * reset + d_pair @ recurrent[:, : 2 * HIDDEN].T
                d_h = np.where(on, past, d_h)
            grad[f"re_{way}"], grad[f"b_{way}"] = d_re, d_gates.sum(axis=(0, 1))
            flat = np.zeros((len(inputs), 3 * HIDDEN), np.float32)
            np.add.at(flat, places[real], d_gates[real])
            grad[f"in_{way}"] = inputs.T @ flat
            d_inputs += flat @ w[f"in_{way}"].T
        grad["word"], grad["char"] = np.zeros_like(w["word"]), np.zeros_like(w["char"])
        np.add.at(grad["word"], at, d_inputs[:, :WORD_SIZE])
        np.add.at(grad["char"], bucket, (d_inputs[:, WORD_SIZE:] / count[:, None])[word])
        return grad


def train(
    texts: list[str], labels: list[int], share: float | None = None, seed: int = SEED
) -> Network:
    """Learns from the worst window of each text in a batch; half of a batch has label 1, so the logit is
    moved in the end to the odds that ``share``, the part of label 1 where texts come from, gives.

    Without texts of both labels the network gives this share for every text.
    """
    rng = np.random.default_rng(seed)
    docs = [words_of(t) for t in texts]
    seen = Counter(w for d in docs for w in set(d))
    common = sorted((w for w, n in seen.items() if n >= MIN_DOCS), key=lambda w: (-seen[w], w))
    network = Network.fresh({w: i + 1 for i, w in enumerate(common[:VOCABULARY])}, rng)
    label = np.array(labels)
    share = float(label.mean()) if share is None and len(label) else share or 0.0
    share = min(max(share, 0.001), 0.999)
    odds = np.log(share / (1 - share))
    sides = [[i for i in np.nonzero(label == y)[0] if docs[i]] for y in (0, 1)]
    if not all(sides):
        network.weights["out"][:] = 0
        network.weights["bias"][:] = odds
        return network
    first = {k: np.zeros_like(v) for k, v in network.weights.items()}
    second = {k: np.zeros_like(v) for k, v in network.weights.items()}
    # Half of the clean texts of a batch are those that looked worst when last seen.
    looked = np.full(len(docs), -np.inf)
    clean = np.array(sides[0])
    for step in range(1, STEPS + 1):
        hard = clean[np.argsort(-looked[clean], kind="stable")[: BATCH // 4]]
        chosen = np.concatenate([rng.choice(side, BATCH // 2) for side in sides])
        chosen[: len(hard)] = hard
        words, places, worst = _worst(network, [docs[i] for i in chosen])
        looked[chosen], target = worst, label[chosen].astype(np.float32)
        rate = RATE * min(1.0, 2 * (1 - (step - 1) / STEPS))
        for name, g in network.gradient(words, places, target).items():
            first[name] += 0.1 * (g - first[name])
            second[name] += 0.01 * (g * g - second[name])
            move = first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6)
            network.weights[name] -= (rate * move).astype(np.float32)
    network.weights["bias"] += np.float32(odds)
    return network


def _worst(network: Network, docs: list[list[str]]):
    """The window of each text with the highest logit, over the distinct words of all, and this logit."""
    at: dict[str, int] = {}
    rows = [np.array([at.setdefault(w, len(at)) for w in d]) for d in docs]
    cut = [windows(len(r)) for r in rows]
    placed = [np.where(c >= 0, r[c], -1) for r, c in zip(rows, cut, strict=True)]
    words = list(at)
    logits = network.logits(network.gates(network.inputs(words)[0]), np.vstack(placed))
    starts = np.cumsum([0, *map(len, placed)])
    best = [p[int(np.argmax(logits[a:b]))] for p, a, b in zip(placed, starts, starts[1:], strict=False)]
    return words, np.array(best), np.maximum.reduceat(logits, starts[:-1])


class Scorer:
    """Scores texts; keeps the gate inputs of words that it has met."""

    def __init__(self, network: Network):
        self.network = network
        self.rows: dict[str, int] = {}
        self.gates = np.empty((4096, 6 * HIDDEN), np.float32)

    def _known(self, words: list[str]) -> np.ndarray:
        if len(self.rows) > CACHE:
            self.rows = {}
        new = [w for w in dict.fromkeys(words) if w not in self.rows]
        if new:
            start = len(self.rows)
            while start + len(new) > len(self.gates):
                self.gates = np.vstack([self.gates, np.empty_like(self.gates)])
            self.gates[start : start + len(new)] = self.network.gates(self.network.inputs(new)[0])
            self.rows.update(zip(new, range(start, start + len(new)), strict=True))
        return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Score of each text; texts are taken together until there are ``CHUNK`` windows."""
        worst, waiting, n = np.full(len(texts), -np.inf), [], 0
        for i, text in enumerate(texts):
            words = words_of(text)
            # A very long text goes in slices of whole windows.
            step = STRIDE * CHUNK
            for a in range(0, max(len(words) - WINDOW, 1), step):
                part = words[a : a + step + WINDOW]
                at = self._known(part) if part else np.empty(0, np.int64)
                cut = windows(len(part))
                waiting.append((i, np.where(cut >= 0, at[cut], -1) if part else cut))
                n += len(cut)
                # Rows of ``gates`` may be begun anew at the next text.
                if n >= CHUNK or len(self.rows) > CACHE:
                    self._settle(waiting, worst)
                    waiting, n = [], 0
        if waiting:
            self._settle(waiting, worst)
        return _sigmoid(worst)

    def _settle(self, waiting: list, worst: np.ndarray) -> None:
        logits = self.network.logits(self.gates, np.vstack([p for _, p in waiting]))
        doc = np.repeat([i for i, _ in waiting], [len(p) for _, p in waiting])
        np.maximum.at(worst, doc, logits)


@dataclass
class Model:
    network: Network

    def score(self, text: Column) -> Column:
        """Probability of label 1, from the whole text; null and empty texts get that of a window
        without words."""
        network = self.network

        @F.pandas_udf("double")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            scorer = Scorer(network)
            for texts in batches:
                yield pd.Series(scorer.scores(texts.tolist()), index=texts.index)

        return run(text)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "toxic",
    train_docs: dict[int, int] = TRAIN_DOCS,
    train_chars: int = TRAIN_CHARS,
    seed: int = SEED,
) -> Model:
    """Learns from at most so many documents of label 0 and 1 as ``train_docs`` says, of at most
    ``train_chars`` characters, drawn by a seeded hash of the id; only these come to the driver.

    Rows with a null id, text or label are not learned from; of repeated ids one row each is. With no
    documents of one label every text gets the same score.
    """
    kept = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    kept = kept.filter(F.col("id").isNotNull() & (F.length("text") <= train_chars))
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y"))
    known = known.filter(F.col("id").isNotNull() & F.col("y").isin(0, 1)).dropDuplicates(["id"])
    # More ids than are wanted, as some may have no text.
    drawn = F.xxhash64(F.lit(seed), F.col("id").cast("string"))
    usable = known.join(kept.select("id").distinct(), "id", "semi").withColumn("draw", drawn)
    usable = settle(usable)
    sides = [usable.filter(F.col("y") == y).orderBy("draw", "id").limit(train_docs[y]) for y in (0, 1)]
    chosen = settle(sides[0].unionByName(sides[1]))
    rows = lookup_join(kept, chosen, "id", "inner").groupBy("id", "y", "draw").agg(F.min("text").alias("text"))
    sample = rows.orderBy("draw", "id").select("text", "y").toPandas()
    share = known.agg(F.avg("y")).first()[0]
    network = train(sample["text"].tolist(), sample["y"].astype(int).tolist(), share, seed)
    return Model(network)
