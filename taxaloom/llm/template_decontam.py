"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of template tokens: words in lower case without outer punctuation, with numbers, units
behind a number, and names (runs of capitalised words, one placeholder each) replaced by typed placeholders. Whether a
capitalised word that opens a sentence is a name is left open: texts are seen both ways, each with windows of its own, and
the better coverage counts. Windows of five
template tokens of documents are hash-joined with those of benchmark items, so an item whose numbers or names
were changed still matches. A document holds an item if at least 0.8 of the item's windows occur in it
and the slots agree: one value of the item stands for one value of the document. Windows whose slots break the
majority's mapping do not count. The majority is asked for each occurrence by itself, that is for the windows at one
distance between document and item and those near it, and also for the whole document; the best of these counts.

Windows with fewer than two plain words say nothing and are left out on both sides, except where an item has no
other. A text of fewer than five tokens is one window. An item that short is looked for with windows of its own length
and counts with its own numbers and names only, since a few words around a slot are no sign of an item.

The benchmark side of the join is broadcast if its measured size is below MAX_HELD_WINDOWS windows (16 bytes each); beyond
it the windows are cut into blocks of that size and documents are matched block by block, all documents against
each block; item totals are the same either way.

Cases: a NULL or empty text has no windows; NULL items are ignored; repeated items match alike; repeated rows
each match; rows with a NULL doc_id match as well; other columns are ignored; an empty table gives no
rows.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaloom.llm.common import batch_rows, window_hashes

WINDOW = 5
MIN_COVERAGE = 0.8
MIN_PLAIN = 2
MAX_HELD_WINDOWS = 2_000_000
MULTIPLIER = 0x9E3779B97F4A7C15 | 1
WORDS_KEPT = 500_000
PIECE_BYTES = 512 * 1024  # of text whose windows are made at once

# Units that are taken as such behind a number.
UNITS = frozenset(
    "km m cm mm mi mile miles ft foot feet in inch inches yd yards kg g mg lb lbs oz t ton tons tonnes l ml gal s sec "
    "second seconds min minute minutes h hr hour hours day days week weeks month months year years % percent "
    "usd eur gbp dollar dollars cent cents euro euros pound pounds kmh mph c f k w kw j kj v a hz".split()
)
# Numbers as words. Left out is `one`, which is mostly none.
NUMBER_WORDS = frozenset(
    "zero two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen "
    "eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million".split()
)
PLAIN, NUMBER, UNIT, CAPITAL = 0, 1, 2, 3
SLOT_HASH = np.array([0, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0x510E527FADE682D1], np.uint64)
NAMED = np.uint64(0x9B05688C2B3E6C1F)
TRIM = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def _is_number(core: bytes) -> bool:
    return core[:1].isdigit() and core.translate(None, b".,:/-").isdigit()


class Tokens(dict):
    """Words by number. ``hashes`` and ``traits`` say what each is: its hash as a plain word; its kind, whether it ends a sentence
    (ENDS) and whether it has letters or digits (TOLD)."""

    ENDS, TOLD = 4, 8

    def __init__(self):
        super().__init__()
        self.hashes, self.traits = array("Q"), bytearray()

    def __missing__(self, word: bytes) -> int:
        core = word.strip(TRIM)
        if core.isascii():
            low = core.lower()
            known, capital = low.decode(), core[:1].isupper() and core[1:] == low[1:]
        else:
            text = core.decode("utf-8", "replace")
            known = text.lower()
            low, capital = known.encode(), text[:1].isupper() and text[1:] == text[1:].lower()
        if _is_number(core) or known in NUMBER_WORDS:
            kind = NUMBER
        elif known in UNITS:
            kind = UNIT
        else:
            kind = CAPITAL if capital else PLAIN
        ends = word.rstrip(b"\"')]}")[-1:] in (b".", b"!", b"?", b":")
        self[word] = number = len(self.traits)
        self.hashes.append(xxhash.xxh3_64_intdigest(low))
        self.traits.append(kind | ends * self.ENDS | bool(core) * self.TOLD)
        return number

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashes and traits of the words of all texts, and where each text begins among them; those that are punctuation only are left out."""
        if len(self) >= WORDS_KEPT:
            self.clear()
            self.__init__()
        words = [text.split() for text in texts]
        sizes = [len(w) for w in words]
        if not sum(sizes):
            return np.empty(0, np.uint64), np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(words)), np.int64, sum(sizes))
        traits = np.frombuffer(self.traits, np.uint8)[numbers]
        told = traits & self.TOLD > 0
        before = np.concatenate([[0], np.cumsum(told)])  # words kept before each place
        bounds = before[np.concatenate([[0], np.cumsum(sizes)])]
        return np.frombuffer(self.hashes, np.uint64)[numbers[told]], traits[told], bounds


@dataclass
class Template:
    """The template tokens of texts, one text behind another."""

    hashes: np.ndarray  # template tokens
    slots: np.ndarray  # whether a token is a placeholder
    values: np.ndarray  # hashes of the words themselves
    bounds: np.ndarray  # where each text begins, and the end


def templates(texts: list[bytes], tokens: Tokens) -> tuple[Template, Template]:
    """The template tokens of texts, with capitalised words that open a sentence as words and as names."""
    values, traits, bounds = tokens.of(texts)
    n = len(values)
    kinds = traits & 3
    opens = bounds[:-1][bounds[:-1] < bounds[1:]]
    behind = np.empty(n, np.uint8)
    behind[1:], behind[opens] = kinds[:-1], PLAIN
    starts = np.empty(n, bool)
    starts[1:], starts[opens] = traits[:-1] & Tokens.ENDS > 0, True
    others = (kinds == NUMBER) | ((kinds == UNIT) & (behind == NUMBER))

    def with_names(names: np.ndarray) -> Template:
        # A name of several words is one token.
        first = np.ones(n, bool)
        first[1:] = ~(names[1:] & names[:-1] & ~starts[1:])
        at = np.flatnonzero(first)
        slots = (others | names)[at]
        runs = np.add.reduceat(values, at) if n else values
        return Template(np.where(slots, SLOT_HASH[kinds[at]], runs), slots, runs, np.searchsorted(at, bounds))

    capital = kinds == CAPITAL
    return with_names(capital & ~starts), with_names(capital)


def marked(hashes: np.ndarray, variant: int) -> np.ndarray:
    """Window hashes of the two ways to see names, kept apart."""
    return hashes ^ NAMED if variant else hashes


def windows(t: Template, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each window of one text, and whether it has enough plain words."""
    n = len(t.hashes)
    if n == 0:
        return np.empty(0, np.uint64), np.empty(0, bool)
    size = min(size, n)
    plain = np.concatenate([[0], np.cumsum(~t.slots)])
    told = plain[size:] - plain[: n - size + 1] >= min(MIN_PLAIN, size)
    return window_hashes(t.hashes, size, MULTIPLIER), told


@dataclass
class Item:
    item_id: int
    values: np.ndarray
    slots: np.ndarray
    n_windows: int
    row: int  # both ways to see an item's names have one


@dataclass
class Index:
    """A block of the benchmark: sorted window hashes with item and place."""

    hashes: np.ndarray
    item: np.ndarray
    place: np.ndarray
    items: list[Item]
    short: tuple[int, ...]  # lengths of items that are shorter than a window

    @cached_property
    def likely(self) -> np.ndarray:
        """By the low bits of a hash, whether any window has them: a look that spares most hashes the search."""
        likely = np.zeros(1 << max(16, (16 * len(self.hashes)).bit_length()), bool)
        likely[self.hashes & np.uint64(len(likely) - 1)] = True
        return likely


def index_blocks(rows: list[tuple[int, str]], most: int = MAX_HELD_WINDOWS) -> list[Index]:
    """Items as indexes of at most about `most` windows each; an item is in one block whole."""
    tokens, blocks, held, size = Tokens(), [], [], 0

    def close() -> None:
        if held:
            counts = [len(h) for _, h, _ in held]
            hashes = np.concatenate([h for _, h, _ in held])
            order = np.argsort(hashes, kind="stable")
            item = np.repeat(np.arange(len(held)), counts)[order]
            place = np.concatenate([p for _, _, p in held])[order]
            short = tuple(sorted({len(i.values) for i, _, _ in held if len(i.values) < WINDOW}))
            blocks.append(Index(hashes[order], item, place, [i for i, _, _ in held], short))

    for row, (item_id, text) in enumerate(rows):
        for variant, t in enumerate(templates([text.encode()], tokens)):
            hashes, told = windows(t)
            if variant and not told.any():
                continue  # names alone say nothing
            kept = np.flatnonzero(told) if told.any() else np.arange(len(hashes))
            if len(kept):
                own = marked(hashes[kept], variant)
                held.append((Item(item_id, t.values, t.slots, len(np.unique(own)), row), own, kept))
                size += len(kept)
        if size >= most:
            close()
            held, size = [], 0
    close()
    return blocks


Match = tuple[int, int, int, float, bool]  # item_id, windows found, windows of the item, coverage, whether slots were changed


def matches(text: bytes, index: Index, tokens: Tokens) -> list[Match]:
    """The items a text holds."""
    return matches_of([text], index, tokens)[0]


def matches_of(texts: list[bytes], index: Index, tokens: Tokens) -> list[list[Match]]:
    """The items each text holds. Texts are seen in pieces of about PIECE_BYTES."""
    out, start, size = [], 0, 0
    for end, text in enumerate(texts, start=1):
        size += len(text)
        if size >= PIECE_BYTES or end == len(texts):
            out += _piece(texts[start:end], index, tokens)
            start, size = end, 0
    return out


def _piece(texts: list[bytes], index: Index, tokens: Tokens) -> list[list[Match]]:
    best: list[dict[int, Match]] = [{} for _ in texts]
    for variant, t in enumerate(templates(texts, tokens)):
        for text, hits in _hits(t, variant, index):
            for row, match in _matches(t, index, hits):
                if row not in best[text] or match[3] > best[text][row][3]:
                    best[text][row] = match
    return [sorted(b.values()) for b in best]


def _hits(t: Template, variant: int, index: Index) -> Iterator[tuple[int, Iterator[tuple[int, int, int]]]]:
    """Texts that have windows of the index, with the place of each and its range in the index."""
    found = []
    for size in (WINDOW, *index.short):
        hashes = marked(window_hashes(t.hashes, size, MULTIPLIER), variant)
        at = np.flatnonzero(index.likely[hashes & np.uint64(len(index.likely) - 1)])
        text = np.searchsorted(t.bounds, at, "right") - 1
        inside = at + size <= t.bounds[text + 1]
        at, text = at[inside], text[inside]
        low, high = (np.searchsorted(index.hashes, hashes[at], side) for side in ("left", "right"))
        hit = low < high
        found.append([x[hit] for x in (text, at, low, high)])
    text, *places = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(text, kind="stable")
    numbers, starts = np.unique(text[order], return_index=True)
    for number, rows in zip(numbers.tolist(), np.split(order, starts[1:])):
        yield number, zip(*(x[rows].tolist() for x in places))


def _matches(t: Template, index: Index, hits: Iterator[tuple[int, int, int]]) -> list[tuple[int, Match]]:
    # For each item the distinct windows found decide whether its slots are worth a look.
    seen: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
    for at, a, b in hits:
        for k in range(a, b):
            seen[int(index.item[k])][int(index.hashes[k])].append((at, int(index.place[k])))
    found = []
    for number, by_hash in seen.items():
        item = index.items[number]
        if len(by_hash) < MIN_COVERAGE * item.n_windows:
            continue
        good, chosen = _best(t, item, by_hash)
        coverage = good / item.n_windows
        if coverage >= MIN_COVERAGE:
            changed = any(a != b for a, b in chosen.items())
            if changed and len(item.values) < WINDOW:
                continue
            found.append((item.row, (item.item_id, good, item.n_windows, coverage, changed)))
    return found


def _best(t: Template, item: Item, by_hash: dict[int, list[tuple[int, int]]]) -> tuple[int, dict[int, int]]:
    """Most windows that agree on one value per slot value, and these values: of any occurrence or the whole text."""
    hits = sorted((at - place, h, _slots(t, item, at, place)) for h, where in by_hash.items() for at, place in where)
    shifts = [shift for shift, _, _ in hits]
    best = _agreeing([hits])
    # An occurrence is led by the windows at one shift; those shifted by less than the item's length add what they agree on.
    for start in sorted(set(shifts)):
        if best[0] >= item.n_windows:
            break
        low, high = bisect_left(shifts, start - len(item.values)), bisect_right(shifts, start + len(item.values))
        if len({h for _, h, _ in hits[low:high]}) <= max(best[0], MIN_COVERAGE * item.n_windows - 1):
            continue
        by_distance: dict[int, list] = defaultdict(list)
        for hit in hits[low:high]:
            by_distance[abs(hit[0] - start)].append(hit)
        best = max(best, _agreeing([by_distance[d] for d in sorted(by_distance)]), key=lambda x: x[0])
    return best


def _agreeing(tiers: list[list[tuple[int, int, list]]]) -> tuple[int, dict[int, int]]:
    """Windows that agree with the majority's values; an earlier tier's values stand before those of later ones."""
    chosen: dict[int, int] = {}
    for tier in tiers:
        votes: dict[int, Counter] = defaultdict(Counter)
        for _, _, slots in tier:
            if all(chosen.get(theirs, ours) == ours for theirs, ours in slots):
                for theirs, ours in slots:
                    votes[theirs][ours] += 1
        for theirs, c in votes.items():
            chosen.setdefault(theirs, min(c.items(), key=lambda x: (-x[1], x[0] != theirs, x[0]))[0])
    return len({h for tier in tiers for _, h, slots in tier if all(chosen.get(a) == b for a, b in slots)}), chosen


def _slots(t: Template, item: Item, at: int, place: int) -> list[tuple[int, int]]:
    """Values of the item's and the document's slots in one matched window."""
    inside = np.flatnonzero(item.slots[place : place + WINDOW])
    return [(int(item.values[place + i]), int(t.values[at + i])) for i in inside]


def benchmark_blocks(benchmark: DataFrame, most: int = MAX_HELD_WINDOWS) -> Iterator[Index]:
    """Indexes of the benchmark, built from bounded pieces of it as it streams in."""
    rows, size = [], 0
    kept = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).filter(
        "item_id IS NOT NULL AND text IS NOT NULL"
    )
    for item_id, text in kept.toLocalIterator():
        rows.append((item_id, text))
        size += len(text) // 2 + 1  # no text has more tokens than this
        if size >= most:
            yield from index_blocks(rows, most)
            rows, size = [], 0
    yield from index_blocks(rows, most)


SCHEMA = (
    "doc_id long, item_id long, matched_windows long, item_windows long, coverage double, reparameterised boolean"
)


def contaminated(docs: DataFrame, benchmark: DataFrame, most: int = MAX_HELD_WINDOWS) -> DataFrame:
    """One row per document and benchmark item that the document holds."""
    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for index in benchmark_blocks(benchmark, most):
        part = kept.mapInArrow(_matcher(docs, index), SCHEMA)
        out = part if out is None else out.unionAll(part)
    return kept.mapInArrow(lambda batches: iter(()), SCHEMA) if out is None else out


def _matcher(docs: DataFrame, index: Index):
    held = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch, (ids, text) in batch_rows(batches, "doc_id", "text"):
            rows = [(i, *m) for i, found in zip(ids, matches_of(text, held.value, tokens)) for m in found]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ROW)], schema=ROW)

    return run


ROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("item_id", pa.int64()),
        ("matched_windows", pa.int64()),
        ("item_windows", pa.int64()),
        ("coverage", pa.float64()),
        ("reparameterised", pa.bool_()),
    ]
)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, most: int = MAX_HELD_WINDOWS) -> DataFrame:
    """The rows of docs that hold no benchmark item, with all their columns."""
    for index in benchmark_blocks(benchmark, most):
        docs = docs.mapInArrow(_keeper(docs, index), docs.schema)
    return docs


def _keeper(docs: DataFrame, index: Index):
    held = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens()
        for batch, (text,) in batch_rows(batches, "text"):
            yield batch.filter(pa.array([not found for found in matches_of(text, held.value, tokens)], pa.bool_()))

    return run
