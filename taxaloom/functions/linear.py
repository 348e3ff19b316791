"""Small numpy helpers that run inside tasks."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle


def signed_scores(singular: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """vectors * singular with a fixed sign: the largest score of each component is positive.

    Among equally large ones the first decides.
    """
    scores = vectors * singular
    peak = np.abs(scores).argmax(axis=0)
    return scores * np.where(scores[peak, np.arange(scores.shape[1])] < 0, -1.0, 1.0)


def principal(dots: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first k singular values and scores of a matrix whose rows have these dot products.

    Squares are known to a rounding error of the largest; values within it are zero, and so are their scores.
    """
    squares, vectors = np.linalg.eigh(dots)
    squares, vectors = squares[::-1][:k].copy(), vectors[:, ::-1][:, :k]
    noise = len(dots) * np.finfo(float).eps * max(squares.max(initial=0.0), 0.0)
    squares[squares <= noise] = 0.0
    d = np.sqrt(squares)
    return d, signed_scores(d, vectors)


def score_rows(panel: int, d: np.ndarray, scores: np.ndarray, energy: float) -> pd.DataFrame:
    """The scores of one panel as rows, one per component and sample."""
    n, k = scores.shape
    return pd.DataFrame(
        {
            "panel": np.full(n * k, panel, dtype="int32"),
            "component": np.repeat(np.arange(1, k + 1, dtype="int32"), n),
            "singular_value": np.repeat(d, n),
            "energy": np.full(n * k, energy),
            "n_samples": np.full(n * k, n, dtype="int32"),
            "sample_idx": np.tile(np.arange(n, dtype="int32"), k),
            "score": scores.T.reshape(-1),
        }
    )


# Executors need not have this package installed: these functions travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
