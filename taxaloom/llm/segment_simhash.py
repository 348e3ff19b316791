"""Near-duplicate groups of documents by SimHash fingerprints within a small Hamming distance.

Method: a 64-bit fingerprint maps to the bit counts of its 32 segments of two bits, a point of a grid.
Two fingerprints at Hamming distance d lie at Manhattan distance at most d. So every fingerprint goes to
its own grid cell and to the cells one step away; two at distance 2 or less meet in at least one cell
(the cell half-way between them). Members of a cell are then compared exactly.

Texts with one fingerprint are one row before anything is joined, and cells hold distinct fingerprints,
so copies never meet as pairs. Small cells are compared pair by pair; a large cell is linked through
the fingerprints half-way between its members, which needs no pairs and is exact as well.
Components are found by alternating large-star and small-star steps; every step is a min per node, joined
back, and a written table.

Cases: a NULL or empty text has fingerprint zero and links like any other; a text of one or two words has
one shingle; repeated rows and tied ids each return a row; a NULL doc_id keeps its row and never names a
component unless no member has an id; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaloom.llm.common import batch_rows, signed, stored

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 2
PAIRWISE_CELL = 8  # cells up to this size are compared by shifted arrays, larger ones by half-way keys
ROWS_AT_ONCE = 20_000  # members of one cell whose half-way keys are sorted together

ODD_BITS = np.uint64(0x5555555555555555)


def fingerprint(text: bytes) -> int:
    """Bit i is set if it is set in over half of the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    columns = [words[i:] for i in range(min(SHINGLE_WORDS, len(words)))]
    digest, seed = xxhash.xxh64_digest, SEED
    joined = b"".join([digest(s, seed) for s in map(b" ".join, zip(*columns))])
    rows = np.frombuffer(joined, np.uint8).reshape(-1, 8)
    counts = np.zeros(64, np.int64)
    for start in range(0, len(rows), 1 << 16):
        counts += np.unpackbits(rows[start : start + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(rows)).tobytes(), "big")


def fingerprints(docs: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), and with digest the text's."""
    names = ["doc_id", "digest"] if digest else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, (text,) in batch_rows(batches, "text"):
            found = np.fromiter(map(fingerprint, text), np.uint64, len(text))
            yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), signed(found)], [*names, "fp"])

    text = F.col("text").cast("string")
    kept = [F.col("doc_id").cast("long").alias("doc_id"), *([_digest(text)] if digest else []), text.alias("text")]
    return docs.select(*kept).mapInArrow(run, ", ".join(["doc_id long", *(["digest string"] if digest else []), "fp long"]))


def _digest(text: Column) -> Column:
    """What tells texts apart; a NULL text is an empty one."""
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256).alias("digest")


def cells_of(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The grid cells at Manhattan distance 0 and 1 of each fingerprint, and the fingerprint beside each."""
    own = fps - ((fps >> np.uint64(1)) & ODD_BITS)  # 32 counts of 0..2, two bits each
    cells, members = [own], [fps]
    for shift in range(0, 64, 2):
        step, count = np.uint64(1) << np.uint64(shift), (own >> np.uint64(shift)) & np.uint64(3)
        for can, cell in ((count < 2, own + step), (count > 0, own - step)):
            cells.append(cell[can])
            members.append(fps[can])
    return np.concatenate(cells), np.concatenate(members)


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= MAX_BITS


def _star(members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect members linked within two bits: all that share a half-way number join its least."""
    members = np.sort(members)
    low, high = [], []
    flips = np.concatenate([np.zeros(1, np.uint64), np.uint64(1) << np.arange(64, dtype=np.uint64)])
    passes = np.uint64(-(-len(members) // ROWS_AT_ONCE))
    for part in range(int(passes)):
        keys, owners = [], []
        for flip in flips:
            key = members ^ flip
            mine = slice(None) if passes == 1 else (key * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(32)) % passes == part
            keys.append(key[mine])
            owners.append(members[mine])
        key, owner = np.concatenate(keys), np.concatenate(owners)
        order = np.lexsort((owner, key))
        key, owner = key[order], owner[order]
        first = np.concatenate([[True], key[1:] != key[:-1]]) if len(key) else np.empty(0, bool)
        least = owner[first][np.cumsum(first) - 1] if len(key) else owner
        linked = least != owner
        low.append(least[linked])
        high.append(owner[linked])
    pairs = np.unique(np.stack([np.concatenate(low), np.concatenate(high)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


def _links(cells: np.ndarray, fps: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges among the members of each cell; cells are sorted, whole, and members distinct."""
    starts = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    sizes = np.diff(np.append(starts, len(cells)))
    size_of = np.repeat(sizes, sizes)
    small = size_of <= PAIRWISE_CELL
    for shift in range(1, min(PAIRWISE_CELL, int(sizes.max()))):
        same = np.flatnonzero((cells[shift:] == cells[:-shift]) & small[shift:])
        a, b = fps[same], fps[same + shift]
        near = _near(a, b)
        yield np.minimum(a, b)[near], np.maximum(a, b)[near]
    for start, size in zip(starts[sizes > PAIRWISE_CELL], sizes[sizes > PAIRWISE_CELL]):
        yield _star(fps[start : start + size])


def links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints, one set that connects all within MAX_BITS."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            all_fps = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            for start in range(0, len(all_fps), 2000):
                cells, members = cells_of(all_fps[start : start + 2000])
                yield pa.RecordBatch.from_arrays([signed(cells), signed(members)], ["cell", "fp"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_cells, kept_fps = [], []  # rows of the last cell so far: it may go on in the next batch

        def edges(cells: np.ndarray, fps: np.ndarray) -> Iterator[pa.RecordBatch]:
            for low, high in _links(cells, fps) if len(cells) else ():
                if len(low):
                    yield pa.RecordBatch.from_arrays([signed(low), signed(high)], ["a", "b"])

        for batch in batches:
            cells = batch["cell"].to_numpy(zero_copy_only=False).view(np.uint64)
            fps = batch["fp"].to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(cells):
                continue
            tail = len(cells) - 1
            while tail >= 0 and cells[tail] == cells[-1]:
                tail -= 1
            tail += 1
            if tail or (kept_cells and kept_cells[0][0] != cells[0]):
                yield from edges(
                    np.concatenate([*kept_cells, cells[:tail]]), np.concatenate([*kept_fps, fps[:tail]])
                )
                kept_cells, kept_fps = [], []
            kept_cells.append(cells[tail:])
            kept_fps.append(fps[tail:])
        if kept_cells:
            yield from edges(np.concatenate(kept_cells), np.concatenate(kept_fps))

    return (
        fps.mapInArrow(spread, "cell long, fp long")
        .repartition("cell")
        .sortWithinPartitions("cell")
        .mapInArrow(verify, "a long, b long")
        .distinct()
    )


def components(edges: DataFrame) -> DataFrame:
    """node, root (the least node of the component) of every node that has an edge."""
    edges = stored(edges.select("a", "b"), "edges")
    mark = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = (
            both.filter("b > a")
            .join(least, "a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .filter("a != b")
            .distinct()
        )
        large = stored(large, "edges")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(down, "a")
            .select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
            .select(F.col("e.a").alias("a"), F.col("e.m").alias("b"))
            .filter("a != b")
            .distinct()
        )
        edges = stored(small, "edges")
        # As many edges as nodes below a root, each to one root: the stars are complete.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = now


def classes(distinct: DataFrame) -> DataFrame:
    """fp, root of distinct fingerprints (and their other columns): root is the least fingerprint reached by links."""
    roots = components(links(distinct.select("fp")))
    placed = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return stored(placed.select(*distinct.columns, F.coalesce("root", "fp").alias("root")), "classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every row of docs."""
    prints = stored(fingerprints(docs), "fingerprints")
    placed = classes(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    named = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_print = stored(placed.join(named, "root").select("fp", "component_id"), "classes")
    return prints.join(by_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component: that with the smallest doc_id, NULL after all others, then the least text digest.

    Rows that agree in both are copies of one row, of which one stays. All columns of docs are kept.
    """
    rows = stored(fingerprints(docs, digest=True), "fingerprints")
    key = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "digest")
    of_print = rows.groupBy("fp", "doc_id", "digest").agg(F.count("*").alias("n"))
    distinct = of_print.groupBy("fp").agg(F.min_by(F.struct("doc_id", "digest", "n"), key).alias("best"))
    placed = classes(distinct)
    order = F.struct(F.col("best.doc_id").isNull().alias("nameless"), "best.doc_id", "best.digest")
    best = placed.groupBy("root").agg(F.min_by("best", order).alias("best"))
    best = stored(best.select("best.doc_id", "best.digest", "best.n"), "kept")
    own = next(name for name in map("_digest{}".format, range(len(docs.columns) + 1)) if name not in docs.columns)
    marked = docs.withColumn(own, _digest(F.col("text").cast("string")))

    def stay(chosen: DataFrame) -> DataFrame:
        same = marked["doc_id"].cast("long").eqNullSafe(chosen["doc_id"]) & (marked[own] == chosen["digest"])
        return marked.join(chosen, same, "left_semi")

    # Both branches join the same texts, dealt out once. Few rows have copies that agree in id and text.
    copies = stay(best.filter("n > 1")).dropDuplicates(["doc_id", own])
    return stay(best.filter("n = 1")).unionByName(copies).select(*docs.columns)
