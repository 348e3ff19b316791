"""Homomorphic fingerprints of documents: the sum of wide vectors hashed from paragraphs, modulo powers of two.

Every paragraph (a line with words) becomes a vector of 192 lanes; a document's fingerprint is the lane-wise
sum of its paragraphs' vectors. So it does not depend on their order, and inserting or deleting
a paragraph adds or subtracts its vector.

* 64 lanes modulo 2**16 hold numbers of full range hashed from the paragraph's words, 1024 bits in all: two different
  multisets of paragraphs agree in them only by accident.
* 128 lanes modulo 2**32 hold the sum of signs (+1, -1) hashed from the paragraph's runs of three words. Their inner
  product estimates how many such runs two documents share, which makes likeness gradual. It takes 2**31 runs of
  one sign, a text of many GB, to wrap around.

Likeness is 1 for equal fingerprints, else the estimated shared runs over the larger document's, held to 0..1.

Edited texts take the first code points of the next document. Documents are cut into ranges of ids; each range
also gets the one row that follows it, so neighbours meet without a window over all rows.

Cases: a NULL or empty text has the zero fingerprint, and likeness 1 with another empty one; a text
without words is like an empty one. NULL ids come first. Rows with one id follow each other by text; each
returns a row. After the last row comes the first; a single row is its own next. Other columns are ignored.
An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxaloom.llm.common import WordHashes, block_count, mix

EXACT_LANES = 64
SIGN_LANES = 128
RUN = 3
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
RANGE_BYTES = 6 * 1024 * 1024
MAX_RANGES = 20_000  # rows stream through a range, so more text makes ranges longer, not tasks larger


def _signs(runs: np.ndarray) -> np.ndarray:
    """The summed signs of hashed runs of words."""
    total = np.zeros(SIGN_LANES, np.int64)
    for start in range(0, len(runs), 1 << 14):
        part = runs[start : start + (1 << 14)]
        wide = np.stack([mix(part + np.uint64(i)) for i in range(1, SIGN_LANES // 64 + 1)], axis=1)
        ones = np.unpackbits(wide.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
        total += 2 * ones - len(part)
    return total


def _runs(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of the runs of RUN words inside each paragraph; a shorter paragraph is one run."""
    a, b, c = (hashes * m for m in MULTIPLIERS)
    line = np.repeat(np.arange(len(sizes)), sizes)
    inside = line[2:] == line[:-2]
    starts = np.cumsum(sizes) - sizes
    one, two = starts[sizes == 1], starts[sizes == 2]
    return mix(np.concatenate([(a[:-2] + b[1:-1] + c[2:])[inside], a[one], a[two] + b[two + 1]]))


def fingerprint(text: str, words: WordHashes) -> np.ndarray:
    """The lanes of a text as unsigned numbers, each below its power of two."""
    paragraphs = [found for line in text.encode("utf-8").split(b"\n") if (found := line.split())]
    if not paragraphs:
        return np.zeros(EXACT_LANES + SIGN_LANES, np.uint32)
    digest = xxhash.xxh3_64_intdigest
    lines = np.fromiter([digest(b" ".join(p)) for p in paragraphs], np.uint64, len(paragraphs))
    seeds = lines[:, None] + np.arange(1, EXACT_LANES // 4 + 1, dtype=np.uint64) * MULTIPLIERS[0]
    exact = mix(seeds).view(np.uint16).sum(axis=0, dtype=np.int64)
    sizes = np.fromiter(map(len, paragraphs), np.int64, len(paragraphs))
    runs = _runs(words.of([w for p in paragraphs for w in p]), sizes)
    return _held(np.concatenate([exact, _signs(runs)]).astype(np.uint32))


def _held(lanes: np.ndarray) -> np.ndarray:
    """The lanes with those for exactness cut to their 16 bits; the others have the 32 of their type."""
    lanes[:EXACT_LANES] &= 0xFFFF
    return lanes


def combine(a: np.ndarray, b: np.ndarray, sign: int = 1) -> np.ndarray:
    """The fingerprint after inserting (1) or deleting (-1) the paragraphs of b."""
    return _held(a + b if sign > 0 else a - b)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    if np.array_equal(a, b):
        return 1.0
    x, y = (v[EXACT_LANES:].view(np.int32).astype(np.float64) for v in (a, b))
    size = max(x @ x, y @ y)
    return float(min(1.0, max(0.0, (x @ y) / size))) if size else 0.0


def as_text(lanes: np.ndarray) -> str:
    return lanes[:EXACT_LANES].astype("<u2").tobytes().hex() + lanes[EXACT_LANES:].astype("<u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    """text with its last quarter of code points replaced by the first as many of the following text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
ROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]
)


def _part_of(ids: pa.Array, cuts: np.ndarray) -> np.ndarray:
    """The range of each id, from 1; 0 for NULL."""
    part = np.searchsorted(cuts, ids.fill_null(0).to_numpy(zero_copy_only=False), side="left") + 1
    return np.where(ids.is_null().to_numpy(zero_copy_only=False), 0, part).astype(np.int32)


def _ranges(rows: DataFrame) -> tuple[np.ndarray, dict[int, int], set]:
    """Cut points between ranges of ids; by range the one before it; the ids that lead a range."""
    parts = min(MAX_RANGES, block_count(rows, RANGE_BYTES))
    at = [i / parts for i in range(1, parts)]
    ids = rows.select("doc_id")
    cuts = np.array(sorted({int(c) for c in ids.approxQuantile("doc_id", at, 0.1 / parts)}), np.int64)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = pa.array(_part_of(batch["doc_id"], cuts))
            yield pa.RecordBatch.from_arrays([part, batch["doc_id"]], ["part", "doc_id"])

    found = ids.mapInArrow(least, "part int, doc_id long").groupBy("part").agg(F.min("doc_id")).collect()
    firsts = sorted((part, doc_id) for part, doc_id in found)
    before = {part: firsts[i - 1][0] for i, (part, _) in enumerate(firsts)}
    return cuts, before, {doc_id for _, doc_id in firsts}


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document with the columns of SCHEMA."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    cuts, before, leads = _ranges(rows)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with their range; rows that lead one also as the tail of the range before."""
        names = ["part", "tail", "doc_id", "text"]
        for batch in batches:
            part = _part_of(batch["doc_id"], cuts)
            no = pa.array(np.zeros(len(part), bool))
            yield pa.RecordBatch.from_arrays([pa.array(part), no, batch["doc_id"], batch["text"]], names)
            lead = [i for i, doc_id in enumerate(batch["doc_id"].to_pylist()) if doc_id in leads]
            if lead:
                some = batch.take(pa.array(lead))
                back = pa.array([before[int(part[i])] for i in lead], pa.int32())
                yes = pa.array(np.ones(len(lead), bool))
                yield pa.RecordBatch.from_arrays([back, yes, some["doc_id"], some["text"]], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        waiting = None  # doc_id, text, lanes of the row whose successor comes next

        def result(row: tuple, following: str, lanes: np.ndarray) -> tuple:
            doc_id, text, own = row
            new = edited(text, following)
            other = fingerprint(new, words)
            digest = hashlib.sha256(new.encode("utf-8")).hexdigest()
            return doc_id, len(text), digest, as_text(own), as_text(other), likeness(own, other), likeness(own, lanes)

        for batch in batches:
            found = []
            for tail, doc_id, text in zip(*(batch[n].to_pylist() for n in ("tail", "doc_id", "text"))):
                if waiting is None and tail:
                    continue  # another row with the id that leads the next range
                lanes = fingerprint(text, words)
                if waiting is not None:
                    found.append(result(waiting, text, lanes))
                waiting = None if tail else (doc_id, text, lanes)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), ROW)], schema=ROW)

    spread = rows.mapInArrow(place, "part int, tail boolean, doc_id long, text string")
    ordered = spread.repartitionByRange(max(1, len(before)), "part")
    return ordered.sortWithinPartitions("part", "tail", "doc_id", "text").mapInArrow(run, SCHEMA)
