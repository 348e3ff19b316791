from __future__ import annotations

from dataclasses import replace

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from study_fixture import CELLS, OTUS, make_study, rows
from taxaloom.operators import presence, reshape
from taxaloom.plans import overview, prepare


def test_read_threshold_and_status(spark):
    long = prepare.long_table(make_study(spark))
    assert rows(long.filter("marker = 'ITS1'"), "sample", "otu", "reads", "status") == [
        ("ex_con_1", 13, 9, "healthy"),
        ("s1.h", 10, 5, "sick"),
        ("s1.h", 11, 7, "sick"),
        ("s2.h", 10, 2, "healthy"),
        ("s2.h", 12, 7, "healthy"),
        ("s2.h", 13, 7, "healthy"),
        ("s3(07.11)", 12, 4, "sick"),
        ("s3(07.11)", 14, 3, "sick"),
    ]


def test_presence_counts_a_taxon_once_per_sample(spark):
    found = overview.presence_by(make_study(spark), "genus").filter("sample = 's1.h' AND marker = 'ITS1'")
    assert rows(found, "taxon") == [("Millepora",)]


def test_genus_overview(spark):
    table = overview.overview_by_taxon(make_study(spark), "genus")
    assert rows(table) == [
        ("ITS1", "extra", "Alternaria", 1, 0, 2, 1, 0.5, 0.0),
        ("ITS1", "extra", "Uncultured", 0, 1, 2, 1, 0.0, 1.0),
        ("ITS1", "extra", None, 0, 1, 2, 1, 0.0, 1.0),
        ("ITS1", "original", "Alternaria", 1, 0, 1, 1, 1.0, 0.0),
        ("ITS1", "original", "Millepora", 1, 1, 1, 1, 1.0, 1.0),
        ("ITS1", "original", "Uncultured", 1, 0, 1, 1, 1.0, 0.0),
        ("ITS2", "extra", "Millepora", 0, 1, 2, 1, 0.0, 1.0),
        ("ITS2", "original", "Alternaria", 0, 1, 1, 1, 0.0, 1.0),
    ]


def test_species_overview_keeps_one_group_without_species(spark):
    table = overview.overview_by_taxon(make_study(spark), "species").filter("marker = 'ITS1'")
    assert rows(table, "dataset", "taxon", "healthy", "sick") == [
        ("extra", "Alternaria alternata", 1, 0),
        ("extra", None, 0, 1),
        ("original", "Alternaria alternata", 1, 0),
        ("original", "Millepora alcicornis", 1, 1),
        ("original", None, 1, 0),
    ]


def test_otu_overview_has_headers(spark):
    table = overview.overview_by_otu(make_study(spark))
    assert rows(table, "dataset", "otu", "healthy", "sick", "header") == [
        ("extra", 12, 0, 1, "Uncultured"),
        ("extra", 13, 1, 0, OTUS[3][2]),
        ("extra", 14, 0, 1, None),
        ("original", 10, 1, 1, OTUS[0][2]),
        ("original", 11, 0, 1, OTUS[1][2]),
        ("original", 12, 1, 0, "Uncultured"),
        ("original", 13, 1, 0, OTUS[3][2]),
    ]


def test_melt_keeps_empty_cells_and_positions(spark):
    wide = spark.createDataFrame([(1, 5, None, 0)], "otu long, `a.1` long, b long, c long")
    assert rows(reshape.melt(wide, ["otu"], ["a.1", "b", "c"])) == [(1, 1, 5), (1, 2, None), (1, 3, 0)]


def test_widen_and_melt_are_inverse_up_to_zeros(spark):
    cells = make_study(spark).cells.filter("reads > 0")
    wide = reshape.widen(cells, ["marker", "otu"], range(1, 7))
    assert wide.columns == ["marker", "otu", "1", "2", "3", "4", "5", "6"]
    long = reshape.melt(wide, ["marker", "otu"], [str(p) for p in range(1, 7)])
    assert long.count() == 6 * wide.count()
    columns = ["marker", "otu", "sample_pos", "reads"]
    assert rows(long.filter("reads > 0"), *columns) == rows(cells, *columns)


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.permutations(CELLS))
def test_input_order_and_partitions_do_not_matter(spark, shuffled):
    study, moved = make_study(spark), make_study(spark, tuple(shuffled))
    assert rows(overview.overview_by_taxon(study, "genus")) == rows(overview.overview_by_taxon(moved, "genus"))
    taxa = [presence.with_taxon(presence.assigned(s.cells, s.columns), "genus", s.otus) for s in (study, moved)]
    assert rows(presence.occurrences(taxa[0])) == rows(presence.occurrences(taxa[1]))


def test_repeated_names_are_refused(spark):
    study = make_study(spark)
    sheet_twice = replace(study, samples=study.samples.union(study.samples.filter("pos = 1")))
    with pytest.raises(ValueError, match="samples in the sample sheet"):
        sheet_twice.columns
    same_name = study.names.withColumn(
        "sample", F.when(F.col("sample_pos") == 2, "s1.h").otherwise(F.col("sample"))
    )
    with pytest.raises(ValueError, match="sample columns"):
        replace(study, names=same_name).columns
    study.check_otus()
    with pytest.raises(ValueError, match="OTUs"):
        replace(study, otus=study.otus.union(study.otus)).check_otus()


def test_release_drops_the_cached_frames(spark):
    study = replace(make_study(spark))
    used = study.panel, study.totals
    cached = study._columns, study._panel, study.totals
    assert all("InMemory" in f._jdf.queryExecution().withCachedData().toString() for f in (*used, *cached))
    study.release()
    assert not any("InMemory" in f.select("*")._jdf.queryExecution().withCachedData().toString() for f in cached)
    assert study.panel.count() == 8


def test_rates_stay_in_bounds(spark):
    table = overview.overview_by_taxon(make_study(spark), "genus")
    wrong = (
        (F.col("healthy") > F.col("healthy_total"))
        | (F.col("sick") > F.col("sick_total"))
        | ~F.col("healthy_freq").between(0, 1)
        | ~F.col("sick_freq").between(0, 1)
    )
    assert table.filter(wrong).count() == 0
