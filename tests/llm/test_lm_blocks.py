"""Blocks of the language model: their words, their n-grams and what they ask for."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

from taxaloom.llm import backoff_lm


def encoded(texts):
    trained = [i for i in range(99) if backoff_lm.in_training(i)]
    ids = pa.array(trained[: len(texts)], pa.int64())
    return backoff_lm._encode(pa.table([pa.array([0] * len(texts), pa.int32()), ids, pa.array(texts, pa.string())], ["block", "doc_id", "text"]))


def test_blocks_number_words_as_they_appear():
    texts = ["b A b", None, "", " \t\x0b\x0c\r\n", "  É é x\x1ca A\n", "a"]
    row = encoded(texts).to_pylist()[0]
    words = [(t or "").encode().lower().split() for t in texts]
    number = {w: i for i, w in enumerate(dict.fromkeys([None, *(w for text in words for w in text)]))}
    assert np.frombuffer(row["tokens"], np.int32).tolist() == [number[w] for text in words for w in [*text, None]]
    assert row["sizes"] == [len(text) + 1 for text in words]
    assert np.frombuffer(row["words"], np.uint64).tolist()[1:] == [xxhash.xxh3_64_intdigest(w) for w in list(number)[1:]]


def test_ngrams_of_a_block_are_looked_up_where_their_parts_repeat(monkeypatch):
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.zipf(1.5, 60)) for _ in range(40)] + ["", "w1 w1 w1 w1"]
    block = backoff_lm.Block(encoded(texts).to_batches()[0])
    looked, factorize = [], backoff_lm.pd.factorize
    monkeypatch.setattr(backoff_lm.pd, "factorize", lambda keys: looked.append(len(keys)) or factorize(keys))
    keys = block.hash
    for n in (2, 3):
        keys = backoff_lm.mix(block.before(keys, np.uint64(0)) * backoff_lm.BASE + block.hash)
        where = rng.random(len(keys)) < 2
        found, place = block.unique(n, keys, where)
        assert len(set(found.tolist())) == len(found) and (found[place] == keys).all()
        trained = np.repeat(block.trained, block.sizes)
        assert block.local_counts(n).tolist() == [int((trained & (keys == k)).sum()) for k in found]
    assert looked[0] < len(keys) and looked[1] < 0.7 * looked[0]


def test_one_number_per_context_travels():
    block = backoff_lm.Block(encoded(["a b a c", "c a b", "a"]).to_batches()[0])
    assert block.trained.all()
    totals = backoff_lm.packed(block.local_counts(1))
    grams = backoff_lm.Grams(block, backoff_lm.Sums([("n1", 0, totals, bytes([255]), bytes(1))], 1), 1)
    grams.extend(2)
    grams.total[2], grams.first[2], grams.alone[2] = block.local_counts(2), ~grams.own[2], grams.own[2]
    _, of, kinds, _ = grams.context_request(2)
    # Behind a come b, c and the end, behind the others two each: a or the end; a or c at the start.
    assert sorted(kinds.tolist()) == [2, 2, 2, 3]
    asked = list(backoff_lm._requests(0, "c2", np.arange(4, dtype=np.uint64), kinds, 1))
    assert [len(r[4]) for r in asked] == [4]
    # What stands behind a context's occurrences adds up to its count, which is what the automaton takes.
    counts = np.bincount(of, minlength=len(kinds))
    assert sorted(counts.tolist()) == sorted([*grams.total[1][1:].tolist(), 3]) and counts.sum() == len(block.hash)
