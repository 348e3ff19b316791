from __future__ import annotations

import random
from collections import defaultdict

import pytest

from study_fixture import make_study, rows
from taxaloom.operators import presence
from taxaloom.operators.numbering import number_within
from taxaloom.operators.presence import assigned, occurrences, with_taxon


def _skewed(n: int, seed: int):
    """A third of all rows and more in one group; reads mostly small, with many ties."""
    draw = random.Random(seed)
    keys = ["hot" if i % 2 else draw.choice("abcdef") for i in range(n)]
    return [(k, i, draw.choice([1, 1, 1, 2, 3, 50])) for i, k in enumerate(keys)]


def _expected(data, by_reads):
    groups = defaultdict(list)
    for key, pos, reads in data:
        groups[key].append((-reads if by_reads else 0, pos))
    return sorted((k, pos, i) for k, g in groups.items() for i, (_, pos) in enumerate(sorted(g), start=1))


@pytest.mark.parametrize("width", [1, 7, 100, 1_000_000])
@pytest.mark.parametrize("by_reads", [False, True])
def test_banded_numbers_equal_plain_ones(spark, width, by_reads):
    data = _skewed(500, seed=width)
    frame = spark.createDataFrame(data, "key string, pos long, reads long").repartition(5)
    numbered = number_within(frame, ["key"], "pos", "n", descending="reads" if by_reads else None, width=width)
    assert numbered.columns == ["key", "pos", "reads", "n"]
    assert sorted((r["key"], r["pos"], r["n"]) for r in numbered.collect()) == _expected(data, by_reads)


def test_a_task_sorts_one_band_at_most(spark):
    frame = spark.range(1000).selectExpr("'hot' AS key", "id AS pos")
    plan = number_within(frame, ["key"], "pos", "n", width=10)._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.splitlines() if "row_number()" in line and "Window [" in line]
    assert len(windows) == 1 and "_band" in windows[0]


def test_occurrences_number_a_missing_taxon_as_its_own_group(spark):
    study = make_study(spark)
    cells = with_taxon(assigned(study.cells, study.columns, 1), "species", study.otus)
    for width in (1, 2, 1_000_000):
        found = occurrences(cells, width).filter("marker = 'ITS1'")
        assert rows(found, "sample", "taxon", "otu", "occurrence") == [
            ("ex_con_1", "Alternaria alternata", 13, 1),
            ("s1.h", "Millepora alcicornis", 10, 1),
            ("s1.h", "Millepora alcicornis", 11, 2),
            ("s1.h", None, 12, 1),
            ("s2.h", "Alternaria alternata", 13, 1),
            ("s2.h", "Millepora alcicornis", 10, 1),
            ("s2.h", None, 12, 1),
            ("s3(07.11)", None, 12, 1),
            ("s3(07.11)", None, 14, 2),
        ]


def test_first_occurrences_are_occurrence_one(spark):
    study = make_study(spark)
    cells = with_taxon(assigned(study.cells, study.columns, 1), "species", study.otus)
    first = presence.first_occurrences(cells)
    numbered = occurrences(cells).filter("occurrence = 1")
    columns = ["marker", "sample", "taxon", "otu", "otu_pos", "reads"]
    assert rows(first, *columns) == rows(numbered, *columns)
