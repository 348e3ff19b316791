from __future__ import annotations

from study_fixture import make_study, rows
from taxaloom.operators import cohort, naming


def test_sample_dimension(spark):
    assert rows(make_study(spark).samples.orderBy("pos"), sort=False) == [
        (1, "North Reef", "1", "s1.h", "original", "sick", False),
        (2, "North Reef", "0", "s2.h", "original", "healthy", False),
        (3, "South", "1", "s3(07.11)", "extra", "sick", False),
        (4, "South", "-", "s4.h", "extra", "not assigned", False),
        (5, "South", "0", "ex_con_1", "extra", "healthy", True),
        (6, "South", "0", "s6(07.11)", "extra", "healthy", False),
        (7, None, "-", "pcr_neg_2", "extra", "not assigned", True),
    ]


def test_dataset_split_follows_row_order_not_partitions(spark):
    frame = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b(1)")], "pos long, sample string")
    assert rows(cohort.split_datasets(frame.repartition(3)), "sample", "dataset") == [
        ("a", "original"),
        ("b(1)", "extra"),
        ("c", "extra"),
    ]


def test_without_a_mark_all_samples_are_original(spark):
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "pos long, sample string")
    assert rows(cohort.split_datasets(frame), "dataset") == [("original",), ("original",)]


def test_group_sizes_and_totals(spark):
    samples = make_study(spark).samples
    assert rows(cohort.group_sizes(samples)) == [
        ("extra", "-", "not assigned", 2),
        ("extra", "0", "healthy", 2),
        ("extra", "1", "sick", 1),
        ("original", "0", "healthy", 1),
        ("original", "1", "sick", 1),
    ]
    assert rows(cohort.status_totals(samples)) == [("extra", 2, 1), ("original", 1, 1)]


def test_totals_with_a_status_missing(spark):
    frame = spark.createDataFrame([("original", "sick")], "dataset string, status string")
    assert rows(cohort.status_totals(frame)) == [("original", 0, 1)]


def test_blanks_are_numbered_in_column_order(spark):
    names = [("ITS2", 3, "pcr b"), ("ITS2", 2, "x"), ("ITS2", 1, "PCR a"), ("ITS1", 1, "pcr")]
    frame = spark.createDataFrame(names, "marker string, sample_pos int, sample string")
    assert rows(naming.number_blanks(frame.repartition(4))) == [
        ("ITS1", 1, "PCR_neg_1"),
        ("ITS2", 1, "PCR_neg_1"),
        ("ITS2", 2, "x"),
        ("ITS2", 3, "PCR_neg_2"),
    ]


def test_names_of_both_sheets(spark):
    names = make_study(spark).names
    assert rows(names.filter("marker = 'ITS2'").orderBy("sample_pos"), "sample", sort=False) == [
        ("s1.h",),
        ("s2.h",),
        ("s3(07.11)",),
        ("pcr_neg_1",),
        ("ex_con_1",),
        ("pcr_neg_2",),
    ]
    assert names.filter("marker = 'ITS1'").count() == 6


def test_panels_leave_out_controls_and_unknown_names(spark):
    assert rows(make_study(spark).panel.orderBy("panel", "sample_idx"), "panel", "sample_idx", "sample", sort=False) == [
        (1, 0, "s1.h"),
        (1, 1, "s2.h"),
        (2, 0, "s3(07.11)"),
        (2, 1, "s4.h"),
        (2, 2, "s6(07.11)"),
        (3, 0, "s1.h"),
        (3, 1, "s2.h"),
        (4, 0, "s3(07.11)"),
    ]
