from __future__ import annotations

import pytest

from study_fixture import make_study, rows
from taxaloom.operators import genera
from taxaloom.plans import overview, pca, prepare, report
from taxaloom.plans.prepare import Study
from taxaloom.sinks.landing import land
from taxaloom.sources.landed import study_from_tables


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("landed"))
    for _ in range(2):  # the second run replaces the first
        land(make_study(spark), "small", path, buckets=4)
    return study_from_tables(spark, "small")


def test_results_are_those_of_the_source(spark, landed):
    study = make_study(spark)
    assert landed.cells.count() == 12
    assert rows(prepare.long_table(landed)) == rows(prepare.long_table(study))
    assert rows(overview.overview_by_taxon(landed, "species")) == rows(overview.overview_by_taxon(study, "species"))
    assert rows(overview.overview_by_otu(landed)) == rows(overview.overview_by_otu(study))
    assert rows(report.report_lines(landed)) == rows(report.report_lines(study))
    assert rows(pca.pca_all(landed, 2).scores) == rows(pca.pca_all(study, 2).scores)
    assert rows(pca.pca_selected(landed, 1).scores) == rows(pca.pca_selected(study, 1).scores)


@pytest.mark.parametrize("listed", [False, True])
def test_matrix_rows_are_built_without_a_shuffle(spark, landed, listed):
    chosen = genera.included_genera(landed.genus_info) if listed else None
    plan = pca.matrix_rows(landed, chosen)._jdf.queryExecution().executedPlan().toString()
    below = plan[: plan.index("FileScan")]
    assert "Exchange hashpartitioning" not in below and "SortMergeJoin" not in plan
    assert "Bucketed: true" in plan


def test_a_repeated_otu_is_refused(spark, tmp_path):
    study = make_study(spark)
    twice = Study(study.cells, study.otus.union(study.otus.filter("otu = 10")), study.names, study.samples, study.genus_info)
    with pytest.raises(ValueError, match="repeated OTUs"):
        overview.overview_by_otu(twice)
    with pytest.raises(ValueError, match="repeated OTUs"):
        land(twice, "twice", str(tmp_path / "t"), buckets=2)


def test_filters_and_columns_reach_the_scan(spark, landed):
    plan = overview.presence_by(landed, "genus")._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line and "small_cells" in line)
    assert "GreaterThanOrEqual(reads,2)" in scan
    assert "otu" not in scan.split("ReadSchema")[1]


def test_one_marker_reads_one_partition(spark, landed):
    plan = overview.overview_by_otu(landed, "ITS1")._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "FileScan parquet" in line and "small_cells" in line)
    assert "marker" in scan.split("PartitionFilters")[1].split("PushedFilters")[0]
