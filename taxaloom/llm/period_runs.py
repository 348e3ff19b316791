"""Stretches of a text that repeat a passage of words four times or more.

A run is a stretch of words with smallest period q and length at least max(6, 4 q) which no neighbouring word extends.
They are found by internal pattern matching. With 2**k the least power of two that is not below q, a run holds an
aligned (dyadic) block of 2**k words whole, and an occurrence of that block q words before or behind it; the nearest
occurrence on that side is the one. So every block asks for its nearest occurrences in the neighbouring
windows of its own length. Occurrences there overlap or touch, so they form a progression, and its difference, if it is over
half the block, is a candidate period. Candidates are extended to both sides word by word, which is the exact check.

Occurrences of a block are an interval of the suffix array. That array is built by prefix doubling, whose classes after k
rounds are just the intervals of blocks of 2**k words; classes too small to hold a run's blocks are left as they are. A
wavelet matrix over the array answers "how many positions of this interval lie before s" and "the j-th smallest
position of this interval", hence the nearest position on either side. All queries of all levels are answered
at once, for many documents together: words of different documents are different, and positions count from the document's start.

Cases: a NULL or empty text has no words and no runs; repeated rows return a row each; a NULL doc_id counts as empty text
where it is hashed; other columns are ignored; an empty table gives no rows. A text of any length is searched
whole, in memory proportional to it.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaloom.llm.common import batch_rows

LEAST_WORDS = 6
LEAST_EXPONENT = 4
WORDS_AT_ONCE = 1 << 16  # documents are searched together up to this many words
BYTES_AT_ONCE = 1 << 21  # text split into words at a time; a longer text is one portion

Run = tuple[int, int, int]  # start, length, period
Words = list[bytes]


class Suffixes:
    """The part of the suffix array that blocks can ask for, and the blocks' intervals.

    ``order`` holds positions; ``block``, ``low``, ``size`` and ``width`` are a row per query: the block's position, its
    interval in ``order`` and its length in words.
    """

    def __init__(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        n = len(codes)
        owner = np.repeat(np.arange(len(lengths)), lengths)
        self.place = np.arange(n) - np.repeat(starts, lengths)
        length_at, left = lengths[owner], lengths[owner] - self.place
        keys = owner * (int(codes.max(initial=0)) + 1) + codes
        order = np.argsort(keys, kind="stable")
        sizes, firsts = _classes(keys[order])
        # A word of a run stands in it four times at least.
        order = order[(sizes >= LEAST_EXPONENT) & (length_at[order] >= LEAST_WORDS)]
        sizes, firsts = _classes(keys[order])
        self.order, self.width = order, 1
        slots, low, asked = np.arange(len(order)), firsts, []
        names = np.full(n, -1)
        width = 1
        while len(slots):
            here = order[slots]
            # A block at its own level: six places of a single word, three of two words, else two.
            enough = sizes >= (LEAST_WORDS if width == 1 else 3 if width == 2 else 2)
            ask = enough & (self.place[here] % width == 0)
            asked.append((here[ask], low[ask], sizes[ask], np.full(int(ask.sum()), width)))
            # Inside the blocks of wider levels it has three places.
            wider = (sizes >= 3) & (4 * width < length_at[here])
            slots, low = slots[wider], low[wider]
            if not len(slots):
                break
            here = order[slots]
            names[here] = low
            second = np.where(left[here] >= 2 * width, names[np.minimum(here + width, n - 1)], -1)
            names[here] = -1
            keys = low * (len(order) + 1) + second + 1
            by = np.argsort(keys, kind="stable")
            order[slots], keys, second = here[by], keys[by], second[by]
            sizes, firsts = _classes(keys)
            low = slots[firsts]
            whole = (second >= 0) & (sizes >= 2)
            slots, low, sizes = slots[whole], low[whole], sizes[whole]
            width *= 2
        parts = zip(*asked) if asked else [[np.empty(0, np.int64)]] * 4
        self.block, self.low, self.size, self.width = (np.concatenate(p) for p in parts)


def _classes(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every row of sorted keys the size of its class and the row where that begins."""
    if not len(sorted_keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))
    sizes = np.diff(np.append(starts, len(sorted_keys)))
    return np.repeat(sizes, sizes), np.repeat(starts, sizes)


class WaveletMatrix:
    """Numbers by their bits, highest first: per bit the running count of ones, zeros sorted before ones."""

    def __init__(self, values: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, int]] = []
        values = values.astype(np.int64)
        for bit in range(int(values.max(initial=0)).bit_length() - 1, -1, -1):
            ones = (values >> bit) & 1
            count = np.zeros(len(values) + 1, np.int32)
            np.cumsum(ones, out=count[1:])
            self.levels.append((bit, count, len(values) - int(count[-1])))
            values = np.concatenate([values[ones == 0], values[ones == 1]])

    def below(self, low: np.ndarray, high: np.ndarray, limit: np.ndarray) -> np.ndarray:
        """How many numbers of each interval are below its limit."""
        found = np.zeros(len(low), np.int64)
        for bit, count, zeros in self.levels:
            a, b = count[low], count[high]
            one = (limit >> bit) & 1 == 1
            found += np.where(one, (high - low) - (b - a), 0)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return found

    def smallest(self, low: np.ndarray, high: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The j-th smallest number of each interval, from 0."""
        found = np.zeros(len(low), np.int64)
        for bit, count, zeros in self.levels:
            a, b = count[low], count[high]
            first = (high - low) - (b - a)
            one = j >= first
            found |= one.astype(np.int64) << bit
            j = np.where(one, j - first, j)
            low, high = np.where(one, zeros + a, low - a), np.where(one, zeros + b, high - b)
        return found


def _candidates(suffixes: Suffixes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks with a near occurrence: positions, distances, widths; behind first, then before."""
    if not len(suffixes.block):
        return
    tree = WaveletMatrix(suffixes.place[suffixes.order])
    block, low, size, width = suffixes.block, suffixes.low, suffixes.size, suffixes.width
    high, own = low + size, suffixes.place[block]
    rank = tree.below(low, high, own)
    for step in (1, -1):
        there = (rank + step >= 0) & (rank + step < size)
        near = tree.smallest(low[there], high[there], rank[there] + step)
        gap = (near - own[there]) * step
        fits = (gap <= width[there]) & (2 * gap > width[there])
        at = block[there][fits]
        yield (at if step > 0 else at - gap[fits]), gap[fits], width[there][fits]


def _same(codes: np.ndarray, a: int, b: int, room: int, step: int) -> int:
    """How many words from a and b on, at most room, agree in the direction of step."""
    done, chunk = 0, 32
    while done < room:
        n = min(chunk, room - done)
        if step > 0:
            differ = codes[a + done : a + done + n] != codes[b + done : b + done + n]
        else:
            differ = (codes[a - done - n + 1 : a - done + 1] != codes[b - done - n + 1 : b - done + 1])[::-1]
        if differ.any():
            return done + int(differ.argmax())
        done, chunk = done + n, min(2 * chunk, 1 << 16)
    return done


def find_runs(codes: np.ndarray, lengths: np.ndarray) -> list[list[Run]]:
    """The runs of each document, by start and period. codes are the words of all documents, one behind the other."""
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1].astype(np.int64)
    found: list[dict[tuple[int, int], int]] = [{} for _ in lengths]
    parts = list(_candidates(Suffixes(codes, starts, lengths)))
    if parts:
        at, gap, width = (np.concatenate(p) for p in zip(*parts))
        document = np.searchsorted(starts, at, "right") - 1
        by = np.lexsort((at, gap, document))
        last, covered = None, 0
        for i, d, q, b in zip(*(x[by].tolist() for x in (at, gap, width, document))):
            q, b, d = d, q, b  # at, gap, width, document
            if (d, q) != last:
                last, covered = (d, q), 0
            if i + q + b <= covered:
                continue
            first, end = int(starts[d]), int(starts[d] + lengths[d])
            left = i - _same(codes, i - 1, i - 1 + q, i - first, -1)
            right = i + q + _same(codes, i + q, i, end - i - q, 1)
            covered = right
            length = right - left
            if length >= max(LEAST_WORDS, LEAST_EXPONENT * q):
                key = (left - first, length)
                found[d][key] = min(q, found[d].get(key, q))
    return [sorted((start, length, q) for (start, length), q in own.items()) for own in found]


def runs_of(texts: list[Words]) -> list[list[Run]]:
    """The runs of each text; texts of like length are searched together, so the matrix has as few levels as they need."""
    found: list[list[Run]] = [[] for _ in texts]
    by_length = sorted((i for i in range(len(texts)) if len(texts[i]) >= LEAST_WORDS), key=lambda i: len(texts[i]))
    at = 0
    while at < len(by_length):
        portion, total = [], 0
        while at < len(by_length) and (not portion or total + len(texts[by_length[at]]) <= WORDS_AT_ONCE):
            portion.append(by_length[at])
            total += len(texts[by_length[at]])
            at += 1
        words = pa.array([w for i in portion for w in texts[i]], pa.binary())
        codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
        for i, runs in zip(portion, find_runs(codes, np.array([len(texts[i]) for i in portion]))):
            found[i] = runs
    return found


def collapsed(words: Words, runs: list[Run]) -> Words:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    gone = np.zeros(len(words), bool)
    for start, length, period in runs:
        gone[start + period : start + length] = True
    return [w for w, g in zip(words, gone.tolist()) if not g]


def planted(doc_id: int | None, words: Words) -> Words:
    """The words with a periodic tail in a tenth of the documents, as the hash of the id says."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * -(-(n - a) // p))[: n - a]


Edit = Callable[[int | None, Words], Words]


def _searched(docs: DataFrame, edit: Edit | None, schema: dict[str, tuple[str, pa.DataType]], row) -> DataFrame:
    """doc_id and row(words, runs) of each document; words are those that edit makes of the text's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, (ids, texts) in batch_rows(batches, "doc_id", "text"):
            at = 0
            while at < len(ids):
                end, size = at, 0
                while end < len(ids) and (end == at or size + len(texts[end]) <= BYTES_AT_ONCE):
                    size += len(texts[end])
                    end += 1
                words = [texts[i].split() for i in range(at, end)]
                if edit is not None:
                    words = [edit(ids[i], w) for i, w in zip(range(at, end), words)]
                columns = zip(*map(row, words, runs_of(words)))
                made = [pa.array(c, kind) for c, (_, kind) in zip(columns, schema.values())]
                yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(at, end - at), *made], ["doc_id", *schema])
                at = end

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(run, ", ".join(["doc_id long", *(f"{c} {kind}" for c, (kind, _) in schema.items())]))


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
LONG, TEXT = ("long", pa.int64()), ("string", pa.string())


def repetitions(docs: DataFrame, edit: Edit | None = None) -> DataFrame:
    """doc_id, runs (start, length, period in words), text (without what the runs repeat, words joined by a space)."""

    def row(words: Words, runs: list[Run]) -> tuple[list[dict[str, int]], str]:
        named = [dict(zip(("start", "length", "period"), r)) for r in runs]
        return named, b" ".join(collapsed(words, runs)).decode("utf-8", "replace")

    schema = {"runs": ("array<struct<start: bigint, length: bigint, period: bigint>>", pa.list_(RUN)), "text": TEXT}
    return _searched(docs, edit, schema, row)


def digests(docs: DataFrame, edit: Edit | None = None) -> DataFrame:
    """doc_id, n_runs, the longest run (start, length, period, exponent_milli), runs_sha256, collapsed_sha256."""

    def row(words: Words, runs: list[Run]) -> tuple:
        start, length, period = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        listed = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))
        return (
            len(runs),
            start,
            length,
            period,
            length and 1000 * length // period,
            hashlib.sha256(listed.encode()).hexdigest(),
            hashlib.sha256(b" ".join(collapsed(words, runs))).hexdigest(),
        )

    names = ("n_runs", "start", "length", "period", "exponent_milli")
    return _searched(docs, edit, {n: LONG for n in names} | {"runs_sha256": TEXT, "collapsed_sha256": TEXT}, row)
