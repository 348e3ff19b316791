"""The jobs of a PCA as Spark's event log shows them, and what a large panel caches."""

from __future__ import annotations

import json
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark import StorageLevel
from pyspark.sql import functions as F

from taxaloom.operators import ordination

SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import functions as F
from taxaloom.operators import ordination
from taxaloom.session import local_session

spark = local_session(8, "2g", **{{"spark.eventLog.enabled": "true", "spark.eventLog.dir": "file://{log}",
    "spark.eventLog.compress": "false", "spark.eventLog.rolling.enabled": "false"}})
ordination.GRAM_COLUMNS = {columns}
value = F.pmod(F.hash("id", "i"), F.lit(9)).cast("double")
places = F.transform(F.sequence(F.lit(1), F.lit(170)), lambda i: F.pmod(F.hash(F.col("id"), i), F.lit(9)).cast("double"))
rows = spark.range(20_000).select((F.col("id") % 4).cast("int").alias("panel"), places.alias("values"))
scores = ordination.ordinate(rows, {{0: 170, 1: 170, 2: 170, 3: 170}}, 3)
print(scores.selectExpr("sum(abs(score))").first()[0])
spark.stop()
"""


def _jobs(tmp_path, columns):
    """Start and end of each job of a PCA of four panels of 170 samples, and what the script printed."""
    log = tmp_path / f"log{columns}"
    log.mkdir()
    script = SCRIPT.format(repo=str(Path(__file__).resolve().parents[1]), log=log, columns=columns)
    out = subprocess.run([sys.executable, "-c", script], capture_output=True, text=True, check=True, timeout=300)
    jobs = {}
    for line in next(log.iterdir()).read_text().splitlines():
        event = json.loads(line)
        if event["Event"] == "SparkListenerJobStart":
            names = [s["Stage Name"] for s in event["Stage Infos"]]
            jobs[event["Job ID"]] = {"start": event["Submission Time"], "names": names}
        elif event["Event"] == "SparkListenerJobEnd":
            jobs[event["Job ID"]]["end"] = event["Completion Time"]
    return [j for j in jobs.values() if any("RowMatrix" in n for n in j["names"])], float(out.stdout.split()[-1])


def test_one_pass_for_four_panels_and_concurrent_passes(tmp_path):
    together, shown = _jobs(tmp_path, 2048)
    assert len(together) == 1
    apart, again = _jobs(tmp_path, 170)
    assert len(apart) == 4
    assert max(j["start"] for j in apart) < min(j["end"] for j in apart)
    assert again == pytest.approx(shown, rel=1e-9)


def test_panels_share_passes_up_to_the_bound(monkeypatch):
    monkeypatch.setattr(ordination, "GRAM_COLUMNS", 100)
    assert ordination.passes({1: 60, 2: 40, 3: 1, 4: 500, 5: 100, 6: 2}) == [[1, 2], [3], [4], [5], [6]]
    assert ordination.passes({}) == []


@pytest.mark.parametrize("columns", [300, 8])
def test_passes_and_the_solver_agree(spark, monkeypatch, columns):
    draw = np.random.default_rng(2)
    sizes = {1: 9, 2: 12, 3: 7}
    data = [(p, [float(x) for x in draw.poisson(1, n)]) for p, n in sizes.items() for _ in range(80)]
    rows = spark.createDataFrame(data, "panel int, values array<double>")
    monkeypatch.setattr(ordination, "GRAM_COLUMNS", columns)
    found = ordination.ordinate(rows, sizes, 2).toPandas()
    for number, n in sizes.items():
        matrix = np.array([v for p, v in data if p == number])
        d = np.linalg.svd(matrix, compute_uv=False)
        own = found[found["panel"] == number]
        assert np.allclose(own[own["sample_idx"] == 0]["singular_value"], d[:2])
        assert np.allclose(own["energy"], (matrix**2).sum())
        scores = own.pivot(index="sample_idx", columns="component", values="score").to_numpy()
        assert np.allclose(scores @ scores.T, matrix.T @ _leading(matrix, 2))


def _leading(matrix, k):
    u, d, v = np.linalg.svd(matrix, full_matrices=False)
    return (u[:, :k] * d[:k]) @ v[:k]


def test_no_rows_and_no_panels(spark):
    rows = spark.createDataFrame([], "panel int, values array<double>")
    found = ordination.ordinate(rows, {1: 2}, 1).collect()
    assert [(r["sample_idx"], r["score"], r["energy"]) for r in found] == [(0, 0.0, 0.0), (1, 0.0, 0.0)]
    assert ordination.ordinate(rows, {}, 1).collect() == []


def test_cached_bytes_follow_the_reads(spark):
    def cached(every):
        reads = lambda i: F.pmod(F.hash("id", i), F.lit(9973)) + 0.5
        one = F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: F.when((i + F.col("id")) % every == 0, reads(i)).otherwise(0.0))
        rows = spark.range(2_000).select(F.lit(1).alias("panel"), one.alias("values"))
        here = ordination.vectors(rows, {1: 1000}).persist(StorageLevel.MEMORY_ONLY)
        before = {i.id() for i in spark.sparkContext._jsc.sc().getRDDStorageInfo()}
        here.count()
        size = sum(i.memSize() for i in spark.sparkContext._jsc.sc().getRDDStorageInfo() if i.id() not in before)
        here.unpersist(blocking=True)
        return size

    dense, sparse = cached(1), cached(100)
    assert dense > 2_000 * 1000 * 8 * 0.5
    assert sparse < dense / 30
