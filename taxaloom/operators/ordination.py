"""Uncentred PCA of samples by their OTU counts.

For a panel with the samples x OTUs matrix X the scores are U D of its singular value decomposition.
OTUs stay distributed: a row of the matrix is one OTU with its counts in a panel, as a sparse vector where that is
smaller. Panels of up to ``GRAM_COLUMNS`` samples together are one pass over the rows: side by side they are the columns of
one matrix, MLlib adds up its Gram matrix X X', and the blocks on its diagonal are the panels'. Larger panels go
to MLlib's ``computeSVD``, which multiplies with the cached rows step by step and brings vectors of one number per sample
and component to the driver. Passes run at the same time; large panels one after another beside them, since the
solver keeps its state in static fields.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from multiprocessing.pool import ThreadPool
from threading import Lock

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.feature import VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from taxaloom.functions.linear import principal, score_rows, signed_scores
from taxaloom.operators.reshape import dense_rows, picked, sparse_rows

BLOCK_CELLS = 4_000_000
# Sample columns of one pass: a task holds half their square in doubles (17 MB), the driver gets the whole (34 MB).
GRAM_COLUMNS = 2048
JOBS_AT_ONCE = 8
ONE_SOLVER = Lock()
GRAM = "panel int, i int, j int, dot double"
SCORES = (
    "panel int, component int, singular_value double, energy double, n_samples int, "
    "sample_idx int, score double"
)


def panel_sizes(panel: DataFrame) -> dict[int, int]:
    """Samples per panel. Collects one row per panel, of which the caller lists a handful."""
    return {r["panel"]: r["n"] for r in panel.groupBy("panel").agg(F.count("*").alias("n")).collect()}


def panel_cells(cells: DataFrame, panel: DataFrame) -> DataFrame:
    """Non-zero cells of the panels: panel, otu_pos, sample_idx, reads. Blank cells count as 0."""
    placed = panel.select("marker", "sample_pos", "panel", "sample_idx")
    return (
        cells.filter("reads <> 0")
        .join(placed, ["marker", "sample_pos"])
        .select("panel", "otu_pos", "sample_idx", "reads")
    )


def gram(cells: DataFrame, panel: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """Dot products of the samples of each panel: panel, i, j, dot with i <= j.

    A task adds up its OTUs in one small matrix per panel, so pairs of cells are never rows. The
    diagonal is there for every sample, also for one without reads. The result has a row per pair of samples and
    a task holds it whole, so it is a table for panels of hundreds of samples; the PCA does not use it.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {p: np.zeros((n, n)) for p, n in sizes.items()}
        for batch in batches:
            panels = batch.column(0).to_numpy(zero_copy_only=False)
            for p in np.unique(panels):
                rows = batch.filter(pa.array(panels == p))
                idx, val = rows.column(1), rows.column(2)
                step = max(1, BLOCK_CELLS // sizes[p])
                for start in range(0, len(idx), step):
                    i, v = idx.slice(start, step), val.slice(start, step)
                    lengths = i.value_lengths().to_numpy(zero_copy_only=False)
                    block = np.zeros((len(i), sizes[p]))
                    block[np.repeat(np.arange(len(i)), lengths), i.flatten().to_numpy()] = (
                        v.flatten().to_numpy()
                    )
                    sums[p] += block.T @ block
        for p, total in sums.items():
            i, j = np.nonzero(np.triu(total))
            yield pa.record_batch(
                [
                    pa.array(np.full(len(i), p, dtype="int32")),
                    pa.array(i.astype("int32")),
                    pa.array(j.astype("int32")),
                    pa.array(total[i, j]),
                ],
                names=["panel", "i", "j", "dot"],
            )

    rows = sparse_rows(cells).select("panel", "idx", "val")
    diagonal = panel.select(
        "panel",
        F.col("sample_idx").alias("i"),
        F.col("sample_idx").alias("j"),
        F.lit(0.0).alias("dot"),
    )
    return (
        rows.mapInArrow(partial, GRAM)
        .unionByName(diagonal)
        .groupBy("panel", "i", "j")
        .agg(F.sum("dot").alias("dot"))
    )


def layout(panel: DataFrame) -> dict[int, tuple[str, list[int]]]:
    """Marker and sheet positions of each panel, in order of sample_idx. A row per sheet column is collected."""
    found: dict[int, tuple[str, list[int]]] = {}
    rows = panel.select("panel", "marker", "sample_idx", "sample_pos").collect()
    for number, marker, _, position in sorted(tuple(r) for r in rows):
        found.setdefault(number, (marker, []))[1].append(position)
    return found


def rows_of_sheets(rows: DataFrame, panels: dict[int, tuple[str, Sequence[int]]]) -> DataFrame:
    """Matrix rows straight from wide rows: panel, values. Nothing is exploded by cell or shuffled."""
    out = None
    for marker in sorted({m for m, _ in panels.values()}):
        parts = [
            F.struct(F.lit(number).alias("panel"), picked(F.col("counts"), positions).alias("values"))
            for number, (m, positions) in panels.items()
            if m == marker
        ]
        here = rows.filter(F.col("marker") == marker).select(F.explode(F.array(*parts)).alias("row"))
        out = here if out is None else out.unionAll(here)
    if out is None:
        return rows.sparkSession.createDataFrame([], "panel int, values array<double>")
    return out.select("row.panel", "row.values")


def rows_of_cells(cells: DataFrame, panel: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """Matrix rows from cells: one grouping by OTU row, which a table bucketed by it has done already."""
    return dense_rows(sparse_rows(panel_cells(cells, panel)), sizes)


def passes(sizes: dict[int, int]) -> list[list[int]]:
    """Panels that share a pass, as many as its columns allow; one that is too large is alone."""
    found: list[list[int]] = []
    room = 0
    for number, n in sorted(sizes.items()):
        if n > room or not found:
            found.append([])
            room = GRAM_COLUMNS
        found[-1].append(number)
        room -= n
    return found


def vectors(rows: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """panel, vector: rows of the panels in sizes side by side, sparse where that is smaller."""
    total, before = sum(sizes.values()), 0
    values = F.lit(None).cast("array<double>")
    for number, n in sizes.items():
        zeros = [F.array_repeat(F.lit(0.0), F.lit(m)) for m in (before, total - before - n)]
        placed = F.concat(zeros[0], F.col("values"), zeros[1]) if len(sizes) > 1 else F.col("values")
        values = F.when(F.col("panel") == number, placed).otherwise(values)
        before += n
    dense = rows.filter(F.col("panel").isin(*sizes)).select("panel", array_to_vector(values).alias("dense"))
    # The hint tells the assembler the length, which it would else read from the first row.
    sized = VectorSizeHint(inputCol="dense", size=total, handleInvalid="optimistic").transform(dense)
    return VectorAssembler(inputCols=["dense"], outputCol="vector").transform(sized).select("panel", "vector")


def _row_matrix(rows: DataFrame, n: int) -> RowMatrix:
    old = MLUtils.convertVectorColumnsFromML(rows.select("vector"), "vector")
    # The JVM class reads the frame itself; the Python class would need an RDD of Python rows.
    return RowMatrix(callMLlibFunc("createRowMatrix", old, 0, n))


def _from_gram(rows: DataFrame, sizes: dict[int, int], k: int) -> list[pd.DataFrame]:
    """The first k components of some panels, from one pass over their rows."""
    total = sum(sizes.values())
    # MLlib has no sum for a matrix without rows; a row of zeros changes none.
    number, n = next(iter(sizes.items()))
    zeros = rows.sparkSession.range(1).select(F.lit(number).alias("panel"), F.array_repeat(F.lit(0.0), n).alias("values"))
    dots = _row_matrix(vectors(rows.unionAll(zeros), sizes), total).computeGramianMatrix().toArray()
    found, before = [], 0
    for number, n in sizes.items():
        own = dots[before : before + n, before : before + n]
        d, scores = principal(own, min(k, n))
        found.append(score_rows(number, d, scores, float(np.trace(own))))
        before += n
    return found


def _from_solver(rows: DataFrame, number: int, n: int, k: int) -> list[pd.DataFrame]:
    """The first k components of a large panel. MLlib drops components that vanish next to the first; they are zeros."""
    k = min(k, n)
    d, scores = np.zeros(k), np.zeros((n, k))
    here = vectors(rows, {number: n}).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        squared = Summarizer.normL2(F.col("vector")).alias("norms")
        norms = here.agg(squared).select(vector_to_array("norms").alias("norms")).first()
        energy = float(np.square(norms["norms"]).sum()) if norms["norms"] else 0.0
        if energy:
            with ONE_SOLVER:
                svd = _row_matrix(here, n).computeSVD(k)
            found = svd.s.toArray()[:k]
            d[: len(found)] = found
            scores[:, : len(found)] = signed_scores(found, svd.V.toArray()[:, : len(found)])
    finally:
        here.unpersist()
    return [score_rows(number, d, scores, energy)]


def ordinate(rows: DataFrame, sizes: dict[int, int], k: int) -> DataFrame:
    """Scores of every sample on the first k components of its panel.

    ``rows`` are matrix rows (panel, values). Columns of the result: panel, component, singular_value,
    energy (sum of squared reads), n_samples, sample_idx, score.
    """
    spark = rows.sparkSession

    def job(panels: list[int]) -> Callable[[], list[pd.DataFrame]]:
        here = {number: sizes[number] for number in panels}
        if sum(here.values()) <= GRAM_COLUMNS:
            return lambda: _from_gram(rows, here, k)
        return lambda: _from_solver(rows, panels[0], sizes[panels[0]], k)

    jobs = [job(panels) for panels in passes(sizes)]
    if len(jobs) > 1:
        with ThreadPool(min(len(jobs), JOBS_AT_ONCE)) as pool:
            parts = [p for own in pool.map(lambda run: inheritable_thread_target(spark)(run)(), jobs) for p in own]
    else:
        parts = [p for run in jobs for p in run()]
    return spark.createDataFrame(pd.concat(parts), SCORES) if parts else spark.createDataFrame([], SCORES)


def variances(scores: DataFrame) -> DataFrame:
    """Variance, share of all variance and running share of each component."""
    running = W.partitionBy("panel").orderBy("component").rowsBetween(W.unboundedPreceding, 0)
    squared = F.col("singular_value") * F.col("singular_value")
    return (
        scores.filter("sample_idx = 0")
        .select(
            "panel",
            "component",
            "singular_value",
            (squared / F.greatest(F.col("n_samples") - 1, F.lit(1))).alias("variance"),
            F.try_divide(squared, F.col("energy")).alias("share"),
        )
        .withColumn("cum_share", F.sum("share").over(running))
    )
