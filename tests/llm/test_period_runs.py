"""Periodic runs against a search of every period, on small alphabets and on whole tables."""

from __future__ import annotations

import hashlib
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from taxaloom.llm import period_runs
from taxaloom.llm.common import documents
from taxaloom.llm.queries import queries

SF = "/root/testdata/sf0.001"


def every_period(words):
    """All stretches where words q apart agree, by the least q of each."""
    n, found, numbers = len(words), {}, {}
    codes = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
    for q in range(1, n // 4 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[0], (codes[:-q] == codes[q:]).astype(int), [0]])))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            length = end - start + q
            if length >= max(6, 4 * q):
                found.setdefault((start, length), q)
    return sorted((start, length, q) for (start, length), q in found.items())


def expected(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode() if doc_id is not None else b""), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = every_period(words)
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    longest = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *longest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


COLUMNS = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=70), max_size=5))
@settings(max_examples=400, deadline=None)
def test_small_alphabets(texts):
    assert period_runs.runs_of(texts) == [every_period(t) for t in texts]


@pytest.mark.parametrize("seed", range(150))
def test_periodic_stretches_with_faults(seed):
    draw = np.random.default_rng(seed)
    texts = []
    for _ in range(4):
        words = [b"%d" % x for x in draw.integers(0, draw.integers(1, 6), draw.integers(0, 200))]
        for _ in range(draw.integers(0, 4)):
            p, times = int(draw.integers(1, 40)), int(draw.integers(2, 9))
            at = int(draw.integers(0, len(words) + 1))
            words[at:at] = [b"%d" % x for x in draw.integers(0, 4, p)] * times
        texts.append(words)
    assert period_runs.runs_of(texts) == [every_period(t) for t in texts]


def test_words_of_one_text_do_not_meet_those_of_another():
    assert period_runs.runs_of([[b"a"] * 5, [b"a"] * 5, [b"a"] * 6]) == [[], [], [(0, 6, 1)]]


@pytest.mark.parametrize("portion", [1, 40, 10_000])
def test_portions_do_not_matter(portion, monkeypatch):
    monkeypatch.setattr(period_runs, "WORDS_AT_ONCE", portion)
    texts = [(b"x y z " * n).split() for n in range(12)]
    assert period_runs.runs_of(texts) == [every_period(t) for t in texts]


def test_long_texts():
    draw = np.random.default_rng(5)
    unit = [b"%d" % x for x in draw.integers(0, 500, 9_000)]
    begun = time.time()
    texts = [unit * 5, [b"a"] * 200_000, [b"%d" % x for x in draw.integers(0, 2, 100_000)]]
    first, second, third = period_runs.runs_of(texts)
    assert first == [(0, 45_000, 9_000)]
    assert second == [(0, 200_000, 1)]
    assert third[:5] == [r for r in every_period(texts[2][:3_000]) if r[0] + r[1] < 3_000][:5]
    assert time.time() - begun < 60


def test_query_on_the_whole_table(spark):
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in queries()["op11_periodic_runs"](spark, SF).collect()}
    rows = documents(spark, SF).select("doc_id", "text").collect()
    assert got == {i: expected(i, t) for i, t in rows}
    assert sum(r[0] > 0 for r in got.values()) > 5


def test_rows_of_all_kinds(spark):
    line = "one two three " * 4 + "end"
    rows = [(1, line, 1), (1, line, 2), (None, line, 3), (2, None, 4), (3, "", 5), (4, "w " * 70_000, 6), (5, "a\x0ba b", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_runs int")
    got = sorted((tuple(r) for r in period_runs.digests(docs, period_runs.planted).collect()), key=str)
    assert got == sorted(((i, *expected(i, t)) for i, t, _ in rows), key=str)
    assert period_runs.digests(docs.limit(0)).collect() == []
    texts = {r["doc_id"]: r for r in period_runs.repetitions(docs).collect()}
    assert texts[1]["text"] == "one two three end"
    assert [tuple(r) for r in texts[1]["runs"]] == [(0, 12, 3)]
    assert texts[4]["text"] == "w"
    assert texts[5]["text"] == "a a b"
