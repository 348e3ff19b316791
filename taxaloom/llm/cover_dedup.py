"""Removal of passages of 50 and more words that start in an earlier document, by difference-cover anchors.

Which windows of 50 words repeat is found in two steps. Positions are numbered within a document, and D is a
difference cover modulo 31: for every shift there are places k < 31 at which both positions of a match fall into
D. So two equal windows of 50 words share an aligned anchor, 20 words long, that starts at a position in D and lies
inside the window. Only anchors (6 of 31 positions) are hashed and joined. Around an anchor that two documents
share, the windows of 50 words that hold it are candidates; they are hashed in full (64 and 31 bits) and the least doc_id per
window decides. Windows are judged on the input, whatever was removed elsewhere.

Blocks of documents (common.Blocks) are what meets in a shuffle: a block sends each hash once, with the least doc_id,
however many of its documents hold it. A passage in a third of all documents is one row per block. Groups are
never collected: the least doc_id per hash is an aggregate, joined back to the blocks that hold the hash.

Cases: a NULL or empty text has no words; a document shorter than 50 words loses nothing; rows with equal
doc_id are the same document, so none of them removes from another; a NULL doc_id counts as larger than all;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxaloom.llm.common import BLOCK_BYTES, Blocks, WordHashes, signed, stored, texts, window_hashes

WORDS = 50
PERIOD = 31
COVER = (0, 1, 3, 8, 12, 18)  # every difference modulo 31 occurs among these
ANCHOR = WORDS - PERIOD + 1
IN_COVER = np.isin(np.arange(PERIOD), COVER)
ANCHOR_BASE, LOW_BASE, HIGH_BASE = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
LAST = np.iinfo(np.int64).max


def _documents(block: pa.Table, words: WordHashes) -> Iterator[tuple[int, list[bytes], np.ndarray]]:
    """doc_id, words and their hashes of each row, in a fixed order of rows."""
    ids = [LAST if i is None else i for i in block["doc_id"].to_pylist()]
    for doc_id, text in zip(ids, texts(block["text"])):
        found = text.split()
        yield doc_id, found, words.of(found)


def _least(keys: list[np.ndarray], owners: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys with the least and the largest owner of each."""
    key = np.concatenate(keys) if keys else np.empty(0, np.uint64)
    owner = np.concatenate([np.full(n, i, np.int64) for i, n in owners]) if owners else np.empty(0, np.int64)
    order = np.lexsort((owner, key))
    key, owner = key[order], owner[order]
    first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.empty(0, bool)
    last = np.concatenate([first[1:], [True]]) if len(key) else first
    return key[first], owner[first], owner[last]


def _anchors(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the cover, and the anchor hash at each."""
    if len(hashes) < WORDS:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    every = window_hashes(hashes, ANCHOR, ANCHOR_BASE)
    at = np.flatnonzero(np.resize(IN_COVER, len(every)))
    return at, every[at]


def _anchor_rows(block: pa.Table) -> pa.Table:
    """Distinct anchors of a block with their least document, and whether another one in the block has them."""
    words, keys, owners = WordHashes(), [], []
    for doc_id, _, hashes in _documents(block, words):
        _, found = _anchors(hashes)
        keys.append(found)
        owners.append((doc_id, len(found)))
    key, least, largest = _least(keys, owners)
    number = pa.array(np.full(len(key), block["block"][0].as_py(), np.int32))
    return pa.table({"block": number, "anchor": signed(key), "least": pa.array(least), "many": pa.array(least != largest)})


def _covered(at: np.ndarray, n_windows: int) -> np.ndarray:
    """Marks the windows that hold an anchor at one of the positions."""
    steps = np.zeros(n_windows + PERIOD + 1, np.int32)
    np.add.at(steps, np.maximum(at - PERIOD + 1, 0), 1)
    np.add.at(steps, np.minimum(at, n_windows - 1) + 1, -1)
    return np.cumsum(steps)[:n_windows] > 0


def _candidates(block: pa.Table, shared: np.ndarray) -> Iterator[tuple[int, list[bytes], np.ndarray, np.ndarray, np.ndarray]]:
    """doc_id, words, and start and two-part hash of each window around an anchor in shared (sorted)."""
    words = WordHashes()
    for doc_id, found, hashes in _documents(block, words):
        at, anchors = _anchors(hashes)
        starts = np.empty(0, np.int64)
        low, high = np.empty(0, np.uint64), np.empty(0, np.int32)
        if len(at) and len(shared):
            place = np.minimum(np.searchsorted(shared, anchors), len(shared) - 1)
            at = at[shared[place] == anchors]
            if len(at):
                starts = np.flatnonzero(_covered(at, len(hashes) - WORDS + 1))
                low = window_hashes(hashes, WORDS, LOW_BASE)[starts]
                high = (window_hashes(hashes, WORDS, HIGH_BASE)[starts] >> np.uint64(33)).astype(np.int32)
        yield doc_id, found, starts, low, high


def _keys(table: pa.Table, column: str) -> np.ndarray:
    return np.sort(table[column].to_numpy().view(np.uint64))


def _window_rows(block: pa.Table, shared: pa.Table) -> pa.Table:
    """Distinct candidate windows of a block with their least document, and whether another one in the block has them."""
    out = {"low": [], "high": [], "owner": []}
    if len(block):
        for doc_id, _, starts, low, high in _candidates(block, _keys(shared, "anchor")):
            out["low"].append(low)
            out["high"].append(high)
            out["owner"].append(np.full(len(starts), doc_id, np.int64))
    low = np.concatenate(out["low"]) if out["low"] else np.empty(0, np.uint64)
    high = np.concatenate(out["high"]) if out["high"] else np.empty(0, np.int32)
    owner = np.concatenate(out["owner"]) if out["owner"] else np.empty(0, np.int64)
    order = np.lexsort((owner, high, low))
    low, high, owner = low[order], high[order], owner[order]
    first = np.ones(len(low), bool)
    first[1:] = (low[1:] != low[:-1]) | (high[1:] != high[:-1])
    last = np.append(first[1:], True) if len(first) else first
    number = pa.array(np.full(int(first.sum()), block["block"][0].as_py() if len(block) else 0, np.int32))
    return pa.table(
        {
            "block": number,
            "low": signed(low[first]),
            "high": pa.array(high[first]),
            "least": pa.array(owner[first]),
            "many": pa.array(owner[first] != owner[last]),
        }
    )


def _removals(block: pa.Table, shared: pa.Table, repeated: pa.Table) -> pa.Table:
    """Per row of a block: words, words removed, digest and text of what is kept."""
    rows = []
    if len(block):
        known_low = repeated["low"].to_numpy().view(np.uint64)
        order = np.argsort(known_low)
        known_low, known_high = known_low[order], repeated["high"].to_numpy()[order]
        owner = repeated["least"].to_numpy()[order]
        longest = int(np.unique(known_low, return_counts=True)[1].max(initial=0))  # rows that share a low part
        ids = block["doc_id"].to_pylist()
        candidates = _candidates(block, _keys(shared, "anchor"))
        for original, (doc_id, found, starts, low, high) in zip(ids, candidates):
            keep = np.ones(len(found), bool)
            if len(starts) and len(known_low):
                place = np.searchsorted(known_low, low)
                hit = np.zeros(len(low), bool)
                for step in range(longest):
                    at = np.minimum(place + step, len(known_low) - 1)
                    hit |= (known_low[at] == low) & (known_high[at] == high) & (owner[at] < doc_id)
                steps = np.zeros(len(found) + 1, np.int32)
                np.add.at(steps, starts[hit], 1)
                np.add.at(steps, starts[hit] + WORDS, -1)
                keep = np.cumsum(steps)[: len(found)] == 0
            kept = b" ".join([w for w, k in zip(found, keep.tolist()) if k]) if not keep.all() else b" ".join(found)
            rows.append((original, len(found), int((~keep).sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
    columns = list(zip(*rows)) if rows else [[]] * len(ROW)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, ROW)], schema=ROW)


ROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("kept_sha256", pa.string()),
        ("kept", pa.string()),
    ]
)
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def deduplicated(docs: DataFrame, with_text: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of each row, and kept (the words left, joined by a space)."""
    blocks = Blocks(docs, block_bytes)
    grouped = blocks.frame.groupBy("block")
    anchors = grouped.applyInArrow(_anchor_rows, "block int, anchor long, least long, many boolean")
    # A hash is in few blocks or many, each with one row; the running window holds no group in memory.
    same = Window.partitionBy("anchor")
    shared = stored(
        anchors.withColumn("n", F.count("*").over(same)).filter("many OR n > 1").select("block", "anchor"), "anchors"
    )
    schema = "block int, low long, high int, least long, many boolean"
    windows = grouped.cogroup(shared.groupBy("block")).applyInArrow(_window_rows, schema)
    same = Window.partitionBy("low", "high")
    repeated = (
        windows.withColumn("first", F.min("least").over(same))
        .filter("first < least OR many")
        .select("block", "low", "high", F.col("first").alias("least"))
    )
    repeated = stored(repeated, "windows")
    # One side of a cogroup carries both kinds of rows.
    marks = shared.select("block", "anchor", *[F.lit(None).cast(t).alias(c) for c, t in (("low", "long"), ("high", "int"), ("least", "long"))])
    marks = marks.unionByName(repeated.withColumn("anchor", F.lit(None).cast("long")))
    wanted = SCHEMA + (", kept string" if with_text else "")

    def remove(block: pa.Table, mark: pa.Table) -> pa.Table:
        is_anchor = pc.is_valid(mark["anchor"])
        out = _removals(block, mark.filter(is_anchor), mark.filter(pc.invert(is_anchor)))
        return out if with_text else out.drop_columns(["kept"])

    return grouped.cogroup(marks.groupBy("block")).applyInArrow(remove, wanted)
