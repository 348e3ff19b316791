"""Packing of tokenised documents into sequences of at most 2048 tokens by bin completion.

Documents become token ids (a public word BPE, then id 0) and are cut only where they are longer than a sequence.
What is packed are lengths, and there are at most 2048 different ones. So the search works on the histogram of
lengths, which has that bound at any scale, and a filling is applied to as many sequences at once as the counts
allow. Around the largest length left, undominated fillings of the rest are enumerated (a filling is
dominated if one of its lengths can be exchanged for a larger one that still fits); a branch is cut when the waste so
far exceeds what the incumbent allows. The incumbent is best-fit decreasing, and every descent of the search
that needs fewer sequences replaces it. The search ends at the lower bound or once SEARCH_STEPS fillings were tried, and
returns the incumbent.

Documents never pass through the driver: a piece gets its rank among the pieces of its length from running counts
per task and the sums of the tasks before, and the plan (a table of filling, multiplicity and rank ranges) says
which sequence and place that rank has.

Cases: a NULL or empty text is the single id 0; repeated rows are packed once each; a NULL doc_id is packed like
any; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taxaloom.llm.common import batch_rows, stored

CAPACITY = 2048
VOCABULARY = "word_bpe_49k.json"
SEPARATOR = 0
WORDS_KEPT = 400_000  # a task remembers the ids of so many words, about 230 bytes each
SEARCH_STEPS = 10_000  # fillings tried
ENUMERATED = 400  # nodes looked at while enumerating fillings of one sequence
OPTIONS = 4  # fillings kept per sequence
BRANCHES = 40  # next lengths tried at a node of the enumeration, largest first


# ---- tokens


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letter that stands for each byte: itself if it shows, else the next letter from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


# Letters that stay one character in lower case and under normalisation, then signs that make a token of their own.
PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-&(-/:-@\[-`{-~]*)")


class WordIds(dict):
    """Token ids of words as little-endian 32-bit numbers, for the time of a task.

    The vocabulary's pre-tokeniser always splits at white space, so a text's ids are those of its words in
    order, and a word is encoded once. Most words are letters of Latin-1 with signs behind them: those two parts are what
    its normaliser and pre-tokeniser make of them, so they go to its model directly. All others go the whole way.
    """

    def __init__(self, path: str):
        # Spark runs a worker per core; threads of their own would only compete.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.parts: dict[str, bytes] = {}  # ids of the signs behind words, which are few

    def _model(self, part: str) -> bytes:
        tokens = self.tokenizer.model.tokenize(part)
        return array("I", [t.id for t in tokens]).tobytes()

    def _plain(self, letters: str, signs: str) -> bytes:
        letters = letters.lower()
        if not letters.isascii():
            letters = letters.encode().decode("latin-1").translate(self.letters)
        ids = self._model(letters)
        if not signs:
            return ids
        if signs not in self.parts:
            if len(self.parts) > 10_000:
                self.parts.clear()
            self.parts[signs] = self._model(signs)
        return ids + self.parts[signs]

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= WORDS_KEPT:
            self.clear()
        text = word.decode()
        plain = PLAIN.fullmatch(text)
        if plain:
            ids = self._plain(plain[1], plain[2])
        else:
            ids = array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()
        self[word] = ids
        return ids

    def ids(self, text: bytes) -> bytes:
        """The ids of a text, then the separator."""
        return b"".join([*map(self.__getitem__, text.split()), SEPARATOR.to_bytes(4, "little")])


def pieces(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and part, rank: the place among its task's pieces of that length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordIds(path)  # goes with the task
        part, counts = TaskContext.get().partitionId(), [0] * (CAPACITY + 1)
        step = 4 * CAPACITY
        for batch, (ids, text) in batch_rows(batches, "doc_id", "text"):
            for at in range(0, len(ids), 64):
                rows = []
                for doc_id, t in zip(ids[at : at + 64], text[at : at + 64]):
                    whole = words.ids(t)
                    for piece, start in enumerate(range(0, len(whole), step)):
                        own = whole[start : start + step]
                        length = len(own) // 4
                        rows.append((doc_id, piece, start // 4, length, zlib.crc32(own), part, counts[length]))
                        counts[length] += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ROW)], schema=ROW)

    kept = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return kept.mapInArrow(
        run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"
    )


ROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("piece", pa.int32()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("part", pa.int32()),
        ("rank", pa.int64()),
    ]
)


# ---- the search

Filling = tuple[int, ...]  # lengths, largest first


def best_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[Filling, int]]:
    """Best-fit decreasing on a histogram: the fullest sequence that still has room takes the next length.

    Sequences with the same filling are one entry with a multiplicity.
    """
    room: dict[int, dict[Filling, int]] = {}
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            free = min((r for r in room if r >= length), default=None)
            if free is None:
                # New sequences take as many of this length as fit; the last may take fewer.
                each = capacity // length
                full, rest = divmod(left, each)
                for n, times in ((each, full), (rest, 1)):
                    if n and times:
                        at = room.setdefault(capacity - n * length, {})
                        at[(length,) * n] = at.get((length,) * n, 0) + times
                left = 0
                continue
            filling, times = room[free].popitem()
            taken = min(times, left)
            if times > taken:
                room[free][filling] = times - taken
            if not room[free]:
                del room[free]
            at = room.setdefault(free - length, {})
            new = (*filling, length)
            at[new] = at.get(new, 0) + taken
            left -= taken
    return [(filling, times) for at in room.values() for filling, times in at.items()]


def fillings(lengths: list[int], counts: dict[int, int], rest: int) -> list[tuple[int, Filling]]:
    """Undominated fillings of rest with (waste, lengths), least waste first. lengths ascend."""
    found: list[tuple[int, Filling]] = []
    used: dict[int, int] = {}
    nodes = 0

    def dominated(filling: Filling, waste: int) -> bool:
        for a in set(filling):
            i = bisect_right(lengths, a)
            while i < len(lengths) and lengths[i] <= a + waste:
                if counts[lengths[i]] > used.get(lengths[i], 0):
                    return True
                i += 1
        return False

    def add(rest: int, top: int, chosen: Filling) -> bool:
        """Tries every next length up to top; True once nothing better can come."""
        nonlocal nodes
        nodes += 1
        if nodes > ENUMERATED:
            return True
        fits = False
        exact = counts.get(rest, 0) - used.get(rest, 0) if rest <= top else 0
        order = [rest] if exact > 0 else lengths[: bisect_right(lengths, min(rest, top))][::-1]
        for length in order[:BRANCHES]:
            if counts[length] <= used.get(length, 0):
                continue
            fits = True
            used[length] = used.get(length, 0) + 1
            done = add(rest - length, length, (*chosen, length)) if rest > length else keep(0, (*chosen, length))
            used[length] -= 1
            if done:
                return True
        if not fits and not (rest >= lengths[0] and _free(lengths[0])):
            return keep(rest, chosen)
        return False

    def _free(length: int) -> bool:
        return counts[length] > used.get(length, 0)

    def keep(waste: int, chosen: Filling) -> bool:
        if waste == 0 or not dominated(chosen, waste):
            found.append((waste, chosen))
        return waste == 0 and len(found) >= OPTIONS or len(found) >= 8 * OPTIONS

    add(rest, rest, ())
    if not found:
        chosen: list[int] = []
        for length in reversed(lengths):  # largest first
            n = min(rest // length, counts[length])
            chosen += [length] * n
            rest -= n * length
        found.append((rest, tuple(chosen)))
    return sorted(set(found), key=lambda x: (x[0], len(x[1]), [-a for a in x[1]]))[:OPTIONS]


def lower_bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    total = sum(length * n for length, n in counts.items())
    return max(-(-total // capacity), sum(n for length, n in counts.items() if 2 * length > capacity))


@dataclass
class _Level:
    """A place of the search: its options and the one that is applied."""

    largest: int
    options: list[tuple[int, Filling]]
    taken: int = -1
    times: int = 0


def complete(counts: dict[int, int], capacity: int = CAPACITY, steps: int = SEARCH_STEPS) -> list[tuple[Filling, int]]:
    """Fillings with multiplicities that use up counts, in as few sequences as the search finds within its steps."""
    best = best_fit(counts, capacity)
    size, bound = sum(n for _, n in best), lower_bound(counts, capacity)
    total = sum(length * n for length, n in counts.items())
    left = {x: n for x, n in counts.items() if n}
    lengths = sorted(left)  # those left, ascending
    levels: list[_Level] = []
    wasted = used = 0
    while size > bound:
        if not lengths:
            if used < size:
                size = used
                best = [((lv.largest, *lv.options[lv.taken][1]), lv.times) for lv in levels]
        elif wasted <= (size - 1) * capacity - total:
            largest = lengths[-1]
            left[largest] -= 1
            rest = capacity - largest
            others = [x for x in lengths[: bisect_right(lengths, rest)] if left[x]]
            options = fillings(others, left, rest) if others else []
            left[largest] += 1
            levels.append(_Level(largest, options or [(rest, ())]))
        # Go on with the next option of the deepest level that has one.
        while levels:
            level = levels[-1]
            if level.taken >= 0:
                _apply(left, lengths, level, 1)
                wasted -= level.options[level.taken][0] * level.times
                used -= level.times
            level.taken += 1
            if level.taken == len(level.options):
                levels.pop()
                continue
            filling = (level.largest, *level.options[level.taken][1])
            level.times = min(left[x] // filling.count(x) for x in set(filling))
            _apply(left, lengths, level, -1)
            wasted += level.options[level.taken][0] * level.times
            used += level.times
            break
        steps -= 1
        if not levels or steps < 0:
            break
    return best


def _apply(left: dict[int, int], lengths: list[int], level: _Level, sign: int) -> None:
    """Takes a level's fillings out of what is left, or puts them back; lengths stay those that are left."""
    for x in (level.largest, *level.options[level.taken][1]):
        before = left[x]
        left[x] += sign * level.times
        if not left[x]:
            del lengths[bisect_left(lengths, x)]
        elif not before:
            insort(lengths, x)


# ---- placing


@dataclass
class Places:
    """For ranges of ranks of one length: the first sequence and the offset there. Keys are length, then rank."""

    keys: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length << 48) + rank
        at = np.searchsorted(self.keys, key, "right") - 1
        return self.sequence[at] + (key - self.keys[at]), self.offset[at]


def places(plan: list[tuple[Filling, int]]) -> Places:
    taken: dict[int, int] = {}
    rows, base = [], 0
    for filling, times in plan:
        offset = 0
        for length in filling:
            start = taken.get(length, 0)
            rows.append(((length << 48) + start, base, offset))
            taken[length] = start + times
            offset += length
        base += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 3)
    return Places(columns[:, 0].copy(), columns[:, 1].copy(), columns[:, 2].copy())


SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def packed(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row per piece with its sequence and its place there."""
    cut = stored(pieces(docs, path or vocabulary_path()), "pieces")
    by_part = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    # A row per length: at most CAPACITY.
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = docs.sparkSession.sparkContext.broadcast(places(complete(counts)))
    ahead = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = by_part.select("part", "length", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("shift"))
    ranked = cut.join(shifts, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("shift"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch[c].to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = table.value.find(length, rank)
            kept = [batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(sequence), pa.array(offset)], [f.split()[0] for f in SCHEMA.split(", ")]
            )

    return ranked.mapInArrow(place, SCHEMA)
