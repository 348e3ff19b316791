"""Quality classifier: supervised subword embeddings.

A word's features are its own hash and the hashes of its character n-grams (3 to 5 code points, with word
ends marked). A word that equals the one before it adds the features of the marker REPEAT, so a text that says one word
over and over differs from one that says it often. A document is the average of the learned vectors of all features of all its words; a softmax layer
turns it into probabilities. Vectors and layer are trained together with numpy stochastic gradient descent.

Training uses at most TRAIN_DOCS labelled documents, those with the smallest hash of their id: a documented bound that
makes the fit one task of bounded size. Scoring reads every document whole. Since the model is linear in
the average, each feature's vector and the layer fold into one number per feature (2**18 doubles, 2 MB), which
is all that goes to the executors; a word's sum is computed once per task.

Cases: a text without words (or NULL) scores the model's bias; a NULL label is no label; several labels of one
document count as its largest; of several texts with one id the least counts for learning; labels without a
document are ignored; with no labelled document, or only one class, every score is the share of label 1 (one half if there
is none). A NULL doc_id keeps its row and scores like any text. Repeated rows each return a row; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from operator import eq
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaloom.llm.common import batch_rows, remainder

TRAIN_DOCS = 8_000
BUCKETS = 1 << 18
DIM = 8
NGRAMS = (3, 4, 5)
EPOCHS = 2
BATCH = 32
RATE = 1.0
SEED = 7
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0
WORDS_KEPT = 400_000
REPEAT = b"\x00the word before again\x00"  # no text has a word with spaces


def features(word: bytes) -> list[int]:
    """Hashed features of a word: the word and its character n-grams."""
    marked = f"<{word.decode('utf-8', 'replace')}>"
    grams = [marked[i : i + n] for n in NGRAMS for i in range(len(marked) - n + 1)]
    return [crc32(word) % BUCKETS, *[crc32(g.encode(), 1) % BUCKETS for g in grams]]


def repeats(words: list[bytes]) -> int:
    """Words that equal the one before."""
    return sum(map(eq, words, words[1:]))


def _flat(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + size)."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(starts, sizes)


def train(docs: list[bytes], labels: np.ndarray) -> tuple[np.ndarray, float]:
    """A weight per feature and a bias: log odds of label 1 for the average weight of a document's features."""
    share = float(labels.mean()) if len(labels) else 0.5
    if share in (0.0, 1.0) or not any(t.split() for t in docs):
        share = min(max(share, 1e-6), 1 - 1e-6)
        return np.zeros(BUCKETS), float(np.log(share / (1 - share)))
    known: dict[bytes, int] = {}
    rows = []
    for text in docs:
        words = text.split()
        words += [REPEAT] * repeats(words)
        ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
        rows.append(np.unique(ids, return_counts=True))
    held, lengths = array("q"), array("q")
    for word in known:
        own = features(word)
        held.extend(own)
        lengths.append(len(own))
    flat, sizes = np.frombuffer(held, np.int64), np.frombuffer(lengths, np.int64)
    starts = np.cumsum(sizes) - sizes
    rng = np.random.default_rng(SEED)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    layer, bias = np.zeros((2, DIM)), np.log([1 - share, share])
    steps = EPOCHS * -(-len(docs) // BATCH)
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(docs))
        for at in range(0, len(docs), BATCH):
            rate = RATE * (1 - step / steps)
            step += 1
            some = [i for i in order[at : at + BATCH] if len(rows[i][0])]
            if not some:
                continue
            word = np.concatenate([rows[i][0] for i in some])
            count = np.concatenate([rows[i][1] for i in some]).astype(np.float64)
            owner = np.repeat(np.arange(len(some)), [len(rows[i][0]) for i in some])
            words, place = np.unique(word, return_inverse=True)
            feats = flat[_flat(starts[words], sizes[words])]
            edges = np.cumsum(sizes[words]) - sizes[words]
            word_vectors = np.add.reduceat(vectors[feats], edges, axis=0)
            total = np.bincount(owner, count * sizes[word], len(some))
            firsts = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            hidden = np.add.reduceat(word_vectors[place] * count[:, None], firsts, axis=0) / total[:, None]
            logits = hidden @ layer.T + bias
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            off = odds / odds.sum(axis=1, keepdims=True)
            off[np.arange(len(some)), labels[some].astype(int)] -= 1
            back = off @ layer / total[:, None]
            layer -= rate * off.T @ hidden
            bias -= rate * off.sum(axis=0) / BATCH
            by_word = np.stack(
                [np.bincount(place, back[owner, d] * count, len(words)) for d in range(DIM)], axis=1
            )
            # Features are many and each gets a small share, so vectors take larger steps.
            np.add.at(vectors, feats, -rate * BATCH * np.repeat(by_word, sizes[words], axis=0))
    gap = layer[1] - layer[0]
    return vectors @ gap, float(bias[1] - bias[0])


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """The model learnt from labelled documents outside the held-out fold."""
    chosen = (
        labels.filter(remainder("doc_id", FOLDS) != HELD_OUT)
        .filter("quality IS NOT NULL AND doc_id IS NOT NULL")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg(F.max("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(TRAIN_DOCS)
    )
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sample = sample.join(F.broadcast(chosen), "doc_id")  # at most TRAIN_DOCS rows of two numbers

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["doc_id", "text"], na_position="first").drop_duplicates("doc_id")
        texts = [(t or "").encode() for t in rows["text"]]
        weights, bias = train(texts, (rows["quality"].to_numpy() > 0).astype(np.float64))
        return pd.DataFrame({"weights": [weights.astype("<f4").tobytes()], "bias": [bias]})

    found = sample.groupBy(F.lit(0).alias("fit")).applyInPandas(run, "weights binary, bias double").first()
    if found is None:
        return np.zeros(BUCKETS), 0.0
    return np.frombuffer(found["weights"], "<f4").astype(np.float64), found["bias"]


class Scorer:
    """Scores of texts; what a word adds is computed once."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self.words: dict[bytes, complex] = {}

    def _word(self, word: bytes) -> complex:
        """Sum of the weights of the word's features (real) and their number (imaginary)."""
        if len(self.words) >= WORDS_KEPT:
            self.words.clear()
        own = features(word)
        self.words[word] = value = complex(self.weights[own].sum(), len(own))
        return value

    def score(self, text: bytes) -> float:
        known, word = self.words, self._word
        words = text.split()
        total = sum([known.get(w) or word(w) for w in words], 0j)
        total += repeats(words) * (known.get(REPEAT) or word(REPEAT))
        odds = self.bias + (total.real / total.imag if total.imag else 0.0)
        return float(1 / (1 + np.exp(-np.clip(odds, -60, 60))))


def scores(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*held.value)
        for batch, (text,) in batch_rows(batches, "text"):
            found = pa.array([scorer.score(t) for t in text], pa.float64())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], found], ["doc_id", "score"])

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(run, "doc_id long, score double").select(
        "doc_id",
        (remainder("doc_id", FOLDS) == HELD_OUT).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def keep_good(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """The rows of docs that the model does not reject, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*held.value)
        for batch, (text,) in batch_rows(batches, "text"):
            yield batch.filter(pa.array([scorer.score(t) >= THRESHOLD for t in text], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
