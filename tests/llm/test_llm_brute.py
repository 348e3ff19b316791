"""Every query against a plain computation of the same result on whole tables."""

from __future__ import annotations

import hashlib
import math
import os
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest
import xxhash

from taxaloom.llm import bin_completion, queries

SF_DIR = os.environ.get("LLM_TEST_SF", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def read(name: str) -> pd.DataFrame:
    path = f"{SF_DIR}/{name}.parquet"
    return duckdb.connect().execute(f"SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'").df()


@pytest.fixture(scope="module")
def docs():
    found = read("documents")
    return {int(i): (t if isinstance(t, str) else "") for i, t in zip(found["doc_id"], found["text"])}


@pytest.fixture(scope="module")
def run(spark):
    held = {}

    def get(name: str) -> pd.DataFrame:
        if name not in held:
            held[name] = queries.queries()[name](spark, SF_DIR).toPandas()
        return held[name]

    return get


def crc(doc_id: int) -> int:
    return zlib.crc32(str(doc_id).encode())


def test_lm_scoring(run, docs):
    got = run("op1_lm_scoring").set_index("doc_id")
    assert sorted(got.index) == sorted(docs)
    tokens = {i: [*WORD.findall(t.translate(LOWER)), None] for i, t in docs.items()}
    train = [t for i, t in tokens.items() if crc(i) % 7 != 2]
    counts = [Counter(), Counter(), Counter()]
    for t in train:
        s = ["<start>", *t]
        counts[0].update(t)
        counts[1].update(zip(s, s[1:]))
        counts[2].update(zip(s, s[1:], s[2:]))
    n, v = sum(counts[0].values()), len(counts[0])
    d = []
    for c in counts:
        tally = Counter(c.values())
        d.append(tally[1] / (tally[1] + 2 * tally[2]))
    # Per history: its count, and what its followers seen in training hold after the discount.
    whole = [Counter({(w,): c for w, c in counts[0].items()}) | Counter({("<start>",): len(train)}), counts[1]]
    mass = [defaultdict(float), defaultdict(float)]
    for k, order in enumerate(counts[1:]):
        for gram, c in order.items():
            mass[k][gram[:-1]] += c - d[k + 1]

    def p(history, w):
        if not history:
            return (counts[0][w] - d[0]) / n if counts[0][w] else d[0] * v / n
        below, k = p(history[1:], w), len(history)
        if history not in mass[k - 1]:
            return below
        c, all_of = counts[k][(*history, w)], whole[k - 1][history]
        return (1 - mass[k - 1][history] / all_of) * below + (c - d[k] if c else 0) / all_of

    for i, t in tokens.items():
        row = got.loc[i]
        assert row["held_out"] == (crc(i) % 7 == 2)
        assert row["n_tokens"] == len(t) and row["n_known"] == sum(counts[0][w] > 0 for w in t)
        assert row["train_tokens"] == n
        assert math.isclose(row["base_score"], sum(math.log10((counts[0][w] + 1) / (n + v + 1)) for w in t), rel_tol=1e-9)
        s = ["<start>", *t]
        score = sum(math.log10(p(tuple(s[max(0, k - 2) : k]), s[k])) for k in range(1, len(s)))
        assert math.isclose(row["score"], score, rel_tol=1e-8), i
    held = got[got["held_out"]]
    assert held["score"].sum() > held["base_score"].sum()


def test_secret_base_spans(run, docs):
    got = run("op2_secret_scans").set_index("doc_id")
    assert sorted(got.index) == sorted(docs)
    word = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    assign = re.compile(rf"({word})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
    for i, t in docs.items():
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 8]
        spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
        spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{s}:{e}" for s, k, e in sorted(spans))
        row = got.loc[i]
        assert row["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert [row["n_assign"], row["n_access"], row["n_hex"]] == [sum(k == j for _, k, _ in spans) for j in range(3)]
        assert set(text.split(",")) - {""} <= set(row["spans"].split(","))


def test_fingerprints(run, docs):
    got = run("op3_document_fingerprints").set_index("doc_id")
    ids = sorted(docs)
    assert sorted(got.index) == ids
    for i, following in zip(ids, [*ids[1:], ids[0]]):
        t = docs[i]
        k = len(t) // 4
        edited = t[: len(t) - k] + docs[following][:k]
        row = got.loc[i]
        assert row["n_chars"] == len(t)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
    by_text = defaultdict(set)
    for i, t in docs.items():
        by_text[t].add(got.loc[i, "fingerprint"])
    assert all(len(f) == 1 for f in by_text.values()) and len({next(iter(f)) for f in by_text.values()}) == len(by_text)
    assert got["near_edited"].mean() > 0.6 and got["near_next"].mean() < 0.15


def brute_dedup(docs: dict[int, str]) -> dict[int, tuple[int, int, str]]:
    words = {i: WORD.findall(t) for i, t in docs.items()}
    first: dict[tuple, int] = {}
    for i in sorted(words):
        for k in range(len(words[i]) - 49):
            first.setdefault(tuple(words[i][k : k + 50]), i)
    out = {}
    for i, w in words.items():
        keep = [True] * len(w)
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                keep[k : k + 50] = [False] * 50
        kept = " ".join(x for x, y in zip(w, keep) if y)
        out[i] = (len(w), keep.count(False), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_substring_dedup(run, docs):
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in run("op4_substring_dedup").itertuples()}
    assert got == brute_dedup(docs)


def test_chat_formatting(run):
    rows = read("conversations")
    turns = defaultdict(list)
    for c, t, r, x in zip(rows["conv_id"], rows["turn"], rows["role"], rows["text"]):
        turns[int(c)].append((int(t), r, x if isinstance(x, str) else ""))
    turns[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    got = run("op5_chat_formatting").set_index("conv_id")
    assert sorted(got.index) == sorted(turns)
    for c, held in turns.items():
        held.sort()
        loss = "".join(x for _, r, x in held if r == "assistant")
        row = got.loc[c]
        assert row["n_turns"] == len(held)
        assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in held).encode()).hexdigest()
        assert row["loss_chars"] == len(loss) and row["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_warc(run):
    pages = read("pages")
    holder: dict[bytes, int] = {}
    data = {int(i): (h if isinstance(h, str) else "").encode() for i, h in zip(pages["page_id"], pages["html"])}
    for i, h in data.items():
        if len(h) >= 1000:
            holder[h] = max(i, holder.get(h, i))
    got = run("op6_warc").set_index("page_id")
    assert sorted(got.index) == sorted(data)
    for i, h in data.items():
        row = got.loc[i]
        other = holder.get(h, i)
        assert (row["payload_bytes"], row["payload_digest"]) == (len(h), hashlib.sha1(h).hexdigest())
        assert row["record_type"] == ("response" if other == i else "revisit")
        assert pd.isna(row["refers_to"]) if other == i else row["refers_to"] == other


def test_packing(run, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bin_completion.vocabulary_path())
    got = run("op7_best_fit_packing")
    want = {}
    for i, t in docs.items():
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            own = ids[start : start + 2048]
            want[i, piece] = (start, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got.itertuples()} == want
    for _, sequence in got.sort_values("offset").groupby("sequence_id"):
        ends = sequence["length"].cumsum()
        assert list(sequence["offset"]) == [0, *ends[:-1]] and ends.iloc[-1] <= 2048
    bound = bin_completion.lower_bound(Counter(got["length"]))
    assert got["sequence_id"].nunique() <= bound + 1


def test_quality(run, docs):
    got = run("op8_quality_classifier").set_index("doc_id")
    assert sorted(got.index) == sorted(docs)
    assert all(got.loc[i, "held_out"] == (crc(i) % 5 == 0) for i in docs)
    assert got["score"].between(0, 1).all()
    assert ((got["score"] >= 0.3) == (got["predicted"] == 1)).all()


def test_contamination(run, docs):
    got = run("op9_benchmark_decontamination")
    items = read("benchmark")
    want = set()
    for item, text in zip(items["item_id"], items["text"]):
        w = WORD.findall(text)
        inner = " ".join(w[1:-1])
        want |= {(i, item) for i, t in docs.items() if inner in " ".join(WORD.findall(t))}
    found = set(zip(got["doc_id"], got["item_id"]))
    assert want <= found
    assert len({i for i, _ in found}) <= len({i for i, _ in want}) * 1.2 + 1


def brute_components(docs: dict[int, str]) -> dict[int, tuple[str, int]]:
    prints = {}
    for i, t in docs.items():
        w = WORD.findall(t.translate(LOWER))
        shingles = [" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        prints[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    parent = {i: i for i in docs}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(docs)
    values = np.array([prints[i] for i in ids], np.uint64)
    for a, i in enumerate(ids):
        for b in np.flatnonzero(np.bitwise_count(values ^ values[a]) <= 2):
            x, y = root(i), root(ids[b])
            parent[max(x, y)] = min(x, y)
    return {i: (f"{prints[i]:016x}", root(i)) for i in ids}


def test_simhash(run, docs):
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in run("op10_simhash_near_dedup").itertuples()}
    assert got == brute_components(docs)


def test_pipeline_places_each_piece_once(run):
    got = run("pipeline")
    assert not got.duplicated(["doc_id", "piece"]).any()
    assert (got.groupby("sequence_id")["length"].sum() <= 2048).all()
