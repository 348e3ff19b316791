from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from study_fixture import make_study, rows
from taxaloom import model
from taxaloom.operators import ordination
from taxaloom.plans import pca
from taxaloom.plans.prepare import Study

PANEL = "panel int, marker string, sample_pos int, sample_idx int"


def _data(spark, n_samples, n_otus, seed, panel=1, marker="ITS1", density=0.3):
    draw = np.random.default_rng(seed)
    matrix = draw.poisson(20, (n_samples, n_otus)) * (draw.random((n_samples, n_otus)) < density)
    found = [
        (marker, int(o), int(s) + 1, int(matrix[s, o])) for s, o in zip(*np.nonzero(matrix))
    ]
    cells = spark.createDataFrame(found, "marker string, otu_pos long, sample_pos int, reads long")
    columns = [(panel, marker, s + 1, s) for s in range(n_samples)]
    return matrix.astype(float), cells, spark.createDataFrame(columns, PANEL)


def _ordinate(cells, panel, k):
    sizes = ordination.panel_sizes(panel)
    return ordination.ordinate(ordination.rows_of_cells(cells, panel, sizes), sizes, k)


def _ordinate_wide(cells, panel, k):
    """The same from wide rows."""
    n = panel.agg(F.max("sample_pos")).first()[0]
    entry = F.map_from_entries(F.collect_list(F.struct("sample_pos", "reads")))
    counts = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.col("found")[i])
    rows = cells.filter("reads IS NOT NULL").groupBy("marker", "otu_pos").agg(entry.alias("found"))
    rows = rows.select("marker", "otu_pos", counts.alias("counts"))
    return ordination.ordinate(
        ordination.rows_of_sheets(rows, ordination.layout(panel)), ordination.panel_sizes(panel), k
    )


def _matrix_of(scores, panel=1):
    found = scores.filter(F.col("panel") == panel).collect()
    k = max(r["component"] for r in found)
    out = np.zeros((len(found) // k, k))
    singular = np.zeros(k)
    for r in found:
        out[r["sample_idx"], r["component"] - 1] = r["score"]
        singular[r["component"] - 1] = r["singular_value"]
    return singular, out


def _expected(matrix, k):
    u, d, _ = np.linalg.svd(matrix, full_matrices=False)
    scores = u * d
    peak = np.abs(scores).argmax(axis=0)
    scores = scores * np.sign(scores[peak, np.arange(scores.shape[1])])
    return d[:k], scores[:, :k]


@pytest.mark.parametrize("run", [_ordinate, _ordinate_wide])
@pytest.mark.parametrize("n_samples, n_otus", [(12, 60), (130, 300)])
def test_scores_equal_a_local_decomposition(spark, n_samples, n_otus, run):
    matrix, cells, panel = _data(spark, n_samples, n_otus, seed=n_otus)
    scores = run(cells, panel, 3)
    d, x = _matrix_of(scores)
    expected_d, expected_x = _expected(matrix, 3)
    assert np.allclose(d, expected_d, rtol=1e-8)
    assert np.allclose(x, expected_x, atol=1e-4 * expected_d[0])
    assert np.isclose(scores.first()["energy"], (matrix**2).sum())


def test_it_is_not_centred(spark):
    cells = spark.createDataFrame(
        [("ITS1", 1, 1, 1), ("ITS1", 2, 2, 2)], "marker string, otu_pos long, sample_pos int, reads long"
    )
    panel = spark.createDataFrame([(1, "ITS1", 1, 0), (1, "ITS1", 2, 1)], PANEL)
    variances = ordination.variances(_ordinate(cells, panel, 2))
    found = variances.orderBy("component").collect()
    assert [r["singular_value"] for r in found] == pytest.approx([2, 1])
    assert [r["variance"] for r in found] == pytest.approx([4, 1])
    assert [r["share"] for r in found] == pytest.approx([0.8, 0.2])
    assert [r["cum_share"] for r in found] == pytest.approx([0.8, 1.0])


@pytest.mark.parametrize("run", [_ordinate, _ordinate_wide])
def test_a_sample_without_reads_and_a_panel_without_reads(spark, run):
    cells = spark.createDataFrame(
        [("ITS1", 1, 1, 3), ("ITS1", 2, 2, 4), ("ITS1", 2, 3, None)],
        "marker string, otu_pos long, sample_pos int, reads long",
    )
    columns = [(1, "ITS1", s, s - 1) for s in (1, 2, 3)] + [(2, "ITS2", s, s - 1) for s in (1, 2)]
    scores = run(cells, spark.createDataFrame(columns, PANEL), 2)
    d, x = _matrix_of(scores)
    assert d == pytest.approx([4, 3])
    assert np.allclose(x, [[0, 3], [4, 0], [0, 0]])
    d, x = _matrix_of(scores, panel=2)
    assert d == pytest.approx([0, 0]) and not x.any()
    shares = ordination.variances(scores).filter("panel = 2")
    assert rows(shares, "share", "cum_share") == [(None, None), (None, None)]


def test_a_repeated_otu_id_stays_two_columns(spark):
    study = make_study(spark)
    cells = study.cells.withColumn("otu", F.lit(1))
    assert rows(pca.pca_all(study, 2).scores) == rows(
        _ordinate(cells, study.panel, 2)
    )


def test_more_components_than_samples(spark):
    _, cells, panel = _data(spark, 3, 10, seed=4, density=0.9)
    assert _ordinate(cells, panel, 9).count() == 9


def test_a_panel_of_more_than_a_thousand_samples(spark):
    matrix, cells, panel = _data(spark, 1100, 60, seed=5, density=0.05)
    d, x = _matrix_of(_ordinate_wide(cells, panel, 2))
    expected_d, expected_x = _expected(matrix, 2)
    assert np.allclose(d, expected_d, rtol=1e-6)
    assert np.allclose(x, expected_x, atol=1e-4 * expected_d[0])


def test_a_row_counts_by_its_own_genus(spark):
    study = make_study(spark)
    counts = [("ITS1", 1, 1, "Fungus x", [0, 0, 0]), ("ITS1", 1, 2, "Coral y", [9, 9, 9])]
    wide = spark.createDataFrame(counts, "marker string, otu long, otu_pos long, header string, counts array<long>")
    genera = spark.createDataFrame([("Fungus", "fungus"), ("Coral", "coral")], "genus string, description string")
    twice = Study(study.cells, study.otus, study.names, study.samples, genera, wide)
    assert pca.pca_selected(twice, 1).scores.agg(F.max("energy")).first()[0] == 0


def test_all_components_carry_all_energy(spark):
    matrix, cells, panel = _data(spark, 20, 80, seed=9)
    d, x = _matrix_of(_ordinate(cells, panel, 20))
    assert np.isclose((d**2).sum(), (matrix**2).sum())
    assert np.allclose(x @ x.T, matrix @ matrix.T)
    off = x.T @ x
    assert np.allclose(off, np.diag(d**2), atol=1e-6)
    assert (np.diff(d) <= 1e-9).all()


def test_panels_of_different_sizes_together(spark):
    first, cells_1, panel_1 = _data(spark, 5, 40, seed=1, density=0.9)
    second, cells_2, panel_2 = _data(spark, 9, 40, seed=2, panel=3, marker="ITS2", density=0.9)
    scores = _ordinate(cells_1.union(cells_2), panel_1.union(panel_2), 2)
    for matrix, number in ((first, 1), (second, 3)):
        d, x = _matrix_of(scores, number)
        expected_d, expected_x = _expected(matrix, 2)
        assert np.allclose(d, expected_d) and np.allclose(x, expected_x, atol=1e-6)


def test_blocks_do_not_change_the_sums(spark, monkeypatch):
    matrix, cells, panel = _data(spark, 6, 50, seed=3)
    monkeypatch.setattr(ordination, "BLOCK_CELLS", 18)
    grams = ordination.gram(ordination.panel_cells(cells, panel), panel, {1: 6})
    total = matrix @ matrix.T
    assert {(r["i"], r["j"]): r["dot"] for r in grams.collect()} == {
        (i, j): total[i, j] for i in range(6) for j in range(i, 6) if total[i, j] or i == j
    }


def test_points_and_captions(spark):
    study = make_study(spark)
    result = pca.pca_all(study, 3)
    points = pca.plot_points(result, model.AXES_SELECTED)
    assert rows(points, "panel", "sample", "individual", "site", "diseased", "label") == [
        (1, "s1.h", "s1", "North Reef", "1", "sick"),
        (1, "s2.h", "s2", "North Reef", "0", "healthy"),
        (2, "s3(07.11)", None, "South", "1", "sick"),
        (2, "s4.h", None, "South", "-", "unlabeled"),
        (2, "s6(07.11)", None, "South", "0", "healthy"),
        (3, "s1.h", "s1", "North Reef", "1", "sick"),
        (3, "s2.h", "s2", "North Reef", "0", "healthy"),
        (4, "s3(07.11)", None, "South", "1", "sick"),
    ]
    by_component = {
        (r["panel"], r["sample_idx"], r["component"]): r["score"] for r in result.scores.collect()
    }
    for r in pca.plot_points(result, model.AXES_ALL).collect():
        second = 3 if r["panel"] == 3 else 2
        assert r["x"] == by_component[r["panel"], r["sample_idx"], 1]
        assert r["y"] == by_component.get((r["panel"], r["sample_idx"], second))
    captions = dict(rows(pca.captions(result, model.AXES_SELECTED), "panel", "caption"))
    assert captions[1] == "PCA for ITS1 & original data\n100 % of total variation captured"
    assert captions[4] == "PCA for ITS2 & extra data\n100 % of total variation captured"


def test_selected_genera(spark):
    study = make_study(spark)
    assert rows(pca.selected_otus(study), "otu", "genus") == [(13, "Alternaria")]
    assert rows(pca.selected_otus(study, exclude=True), "otu", "genus") == [(13, "Alternaria")]
    scores = pca.pca_selected(study, 1).sample_scores
    assert rows(scores.filter("marker = 'ITS1'"), "sample", "score") == [
        ("s1.h", 0.0),
        ("s2.h", 7.0),
        ("s3(07.11)", 0.0),
        ("s4.h", 9.0),
        ("s6(07.11)", 0.0),
    ]
