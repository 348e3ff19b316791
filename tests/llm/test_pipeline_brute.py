"""The pipeline stage by stage against plain loops, and the classifier on documents it has not seen."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from taxaloom.llm import bin_completion, secret_links, subword_quality, template_decontam
from taxaloom.llm.common import documents, table
from test_llm_brute import SF_DIR, brute_components


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda name: table(spark, SF_DIR, name).collect()
    return {name: read(name) for name in ("documents", "labels", "benchmark")}


def plain_score(text, weights, bias):
    """The mean weight of all features of all words, as odds."""
    words = (text or "").encode().split()
    words += [subword_quality.REPEAT] * sum(a == b for a, b in zip(words, words[1:]))
    every = [weights[f] for w in words for f in subword_quality.features(w)]
    return 1 / (1 + math.exp(-(bias + (math.fsum(every) / len(every) if every else 0))))


def contaminated(text, items):
    """Whether a text holds an item, one item at a time."""
    tokens = template_decontam.Tokens()
    return any(template_decontam.matches((text or "").encode(), index, tokens) for index in items)


def test_each_stage_and_the_whole(spark, tables):
    docs = {r["doc_id"]: r["text"] for r in tables["documents"]}
    frame = documents(spark, SF_DIR)
    stages = dict(corpus_pipeline.STAGES)

    def check(name, given, want):
        """A stage keeps just these documents, with all columns."""
        nonlocal frame
        found = stages[name](spark, frame, SF_DIR)
        assert found.columns == documents(spark, SF_DIR).columns
        frame = found.persist()
        assert {r["doc_id"]: r["text"] for r in frame.collect()} == want and frame.count() == len(want)
        assert len(want) <= len(given)
        return want

    weights, bias = subword_quality.fit(frame, table(spark, SF_DIR, "labels"))
    good = check("quality classifier", docs, {i: t for i, t in docs.items() if plain_score(t, weights, bias) >= 0.3})
    components = brute_components({i: t or "" for i, t in good.items()})
    one = check("SimHash near-dedup", good, {i: t for i, t in good.items() if components[i][1] == i})
    items = [i for r in tables["benchmark"] for i in template_decontam.index_blocks([(r["item_id"], r["text"])])]
    clean = check("benchmark decontamination", one, {i: t for i, t in one.items() if not contaminated(t, items)})
    for row in tables["benchmark"]:  # verbatim items go in any case
        assert not any(row["text"] in (t or "") for t in clean.values())
    masked = check("secret scans", clean, {i: t if t is None else secret_links.masked(t) for i, t in clean.items()})
    assert not any(secret_links.base_spans(t or "") for t in masked.values())
    assert all(r["n_chars"] == len(r["text"] or "") for r in frame.collect())
    tokenizer = Tokenizer.from_file(bin_completion.vocabulary_path())
    want = set()
    for i, t in masked.items():
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            own = ids[start : start + 2048]
            want.add((i, piece, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    got = corpus_pipeline.run(spark, SF_DIR).toPandas()
    assert set(got[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == want
    assert len(got) == len(want)
    for _, sequence in got.sort_values("offset").groupby("sequence_id"):
        ends = sequence["length"].cumsum()
        assert list(sequence["offset"]) == [0, *ends[:-1]] and ends.iloc[-1] <= 2048
    assert got["sequence_id"].nunique() <= bin_completion.lower_bound(Counter(got["length"])) + 1


def area(scores, labels):
    """The chance that a document of label 1 scores above one of label 0."""
    ranks = pd.Series(scores).rank().to_numpy()
    ones = labels == 1
    return (ranks[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


def test_held_out_documents_are_told_apart(spark):
    """On the larger table, whose labels suffice to learn from; random scores and those of an unlearnt model fail."""
    large = "/root/testdata/sf0.1"
    rows = (
        documents(spark, large).join(table(spark, large, "labels"), "doc_id")
        .filter("quality IS NOT NULL").select("doc_id", "text", "quality").orderBy("doc_id").collect()
    )
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    learnt = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 != 0]
    model = subword_quality.train([(r["text"] or "").encode() for r in learnt], np.array([float(r["quality"]) for r in learnt]))
    labels = np.array([r["quality"] for r in held])
    scorer = subword_quality.Scorer(*model)
    scores = np.array([scorer.score((r["text"] or "").encode()) for r in held])
    assert area(scores, labels) >= 0.97
    assert ((scores >= 0.3) == (labels == 1)).mean() >= 0.97
    assert area(np.random.default_rng(1).random(len(held)), labels) < 0.7
    assert area([len(r["text"] or "") for r in held], labels) < 0.7


def test_the_model_does_not_depend_on_row_order(spark):
    rows = [(i % 40, f"text {i} {'good' if i % 2 else 'bad!!'}") for i in range(120)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    models = []
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame(order, "doc_id long, text string").repartition(4)
        models.append(subword_quality.fit(docs, labels))
    assert np.array_equal(models[0][0], models[1][0]) and models[0][1] == models[1][1]
