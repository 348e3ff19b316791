from __future__ import annotations

import random

import pytest

from study_fixture import CELLS, GENERA, OTUS, OWN, SHEET, make_study, rows
from taxaloom.operators import cohort, naming
from taxaloom.plans import overview, pca, prepare, report
from taxaloom.session import shared_folder
from taxaloom.sinks.tables import write_overviews
from taxaloom.sources import ordinals, sheets
from taxaloom.sources.ordinals import with_row_number


@pytest.fixture()
def small_splits(spark):
    """Many splits per file and several files per task."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    for key, value in before.items():
        spark.conf.set(key, value)


def test_row_numbers_survive_another_split_of_the_files(spark, tmp_path):
    values = [f"{i:05d}" for i in range(2000)]
    spark.createDataFrame([(v,) for v in values], "v string").coalesce(1).write.csv(str(tmp_path / "in"))
    scan = spark.read.schema("v string").csv(str(tmp_path / "in"))
    numbered = with_row_number(scan, "n", landing=str(tmp_path / "landed"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        found = numbered.orderBy("n").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r["v"], r["n"]) for r in found] == [(v, i) for i, v in enumerate(values, start=1)]


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_row_numbers_follow_file_and_line(spark, tmp_path, small_splits, fmt):
    draw = random.Random(1)
    lengths = [400, 3, 120, 1, 57]
    values = [f"{i:05d}-{'x' * draw.randrange(40)}" for i in range(sum(lengths))]
    start = 0
    for part, length in enumerate(lengths):
        piece = spark.createDataFrame([(v,) for v in values[start : start + length]], "v string").coalesce(1)
        piece.write.mode("overwrite").option("header", True).format(fmt).save(str(tmp_path / f"p={part}"))
        start += length
    reader = spark.read.option("header", True) if fmt == "csv" else spark.read
    scan = reader.format(fmt).load(str(tmp_path))
    assert scan.rdd.getNumPartitions() > 1
    landing = str(tmp_path.parent / f"{tmp_path.name}-landed")
    numbered = with_row_number(scan, "n", fmt, landing=landing).orderBy("n").collect()
    assert [r["n"] for r in numbered] == list(range(1, len(values) + 1))
    assert [r["v"] for r in numbered] == values
    per_part = with_row_number(scan, "n", fmt, per=["p"], landing=landing).orderBy("p", "n").collect()
    assert [r["n"] for r in per_part] == [i for length in lengths for i in range(1, length + 1)]
    assert [r["v"] for r in per_part] == values


def _write(path, lines):
    path.write_text("\n".join(",".join("" if v is None else str(v) for v in line) for line in lines) + "\n")
    return str(path)


@pytest.fixture()
def files(tmp_path):
    """The study of ``study_fixture`` as sheets with two attribute columns in front."""
    found = {(m, o, s): r for m, o, _, s, r in CELLS}
    paths = {}
    for marker, titles in (("ITS1", [f"c{i}" for i in range(6)]), ("ITS2", OWN)):
        lines = [["OTU", "header", *titles]]
        for otu, _, header in OTUS:
            lines.append([otu, header, *[found.get((marker, otu, s), 0) for s in range(1, 7)]])
        paths[marker] = _write(tmp_path / f"{marker}.csv", lines)
    sheet = [["location", "status", "name", "more"]] + [[*row[1:], "ignored"] for row in SHEET]
    paths["samples"] = _write(tmp_path / "samples.csv", sheet)
    paths["genera"] = _write(tmp_path / "genera.csv", [["genus", "description"], *GENERA])
    return paths


def test_a_study_read_from_sheets_gives_the_same_results(spark, files, tmp_path):
    here = lambda name: str(tmp_path / "landed" / name)
    read = sheets.study_from_sheets(
        sheets.read_abundance_sheet(spark, files["ITS1"], "ITS1", first=3, last=8, landing=here("its1")),
        sheets.read_abundance_sheet(spark, files["ITS2"], "ITS2", first=3, landing=here("its2")),
        sheets.read_sample_sheet(spark, files["samples"], landing=here("samples")),
        sheets.read_genus_lookup(spark, files["genera"]),
        appended=["PCR_neg_2"],
    )
    study = make_study(spark)
    assert read.cells.count() == 60
    assert rows(read.samples, *study.samples.columns) == rows(study.samples)
    assert rows(read.names) == rows(study.names)
    assert rows(prepare.long_table(read)) == rows(prepare.long_table(study))
    for rank in ("genus", "species"):
        assert rows(overview.overview_by_taxon(read, rank)) == rows(overview.overview_by_taxon(study, rank))
    assert rows(overview.overview_by_otu(read)) == rows(overview.overview_by_otu(study))
    assert rows(report.report_lines(read)) == rows(report.report_lines(study))
    assert rows(pca.pca_all(read, 2).sample_scores) == rows(pca.pca_all(study, 2).sample_scores)
    assert rows(pca.pca_selected(read, 1).sample_scores) == rows(pca.pca_selected(study, 1).sample_scores)


def test_a_sheet_with_its_own_row_numbers(spark, tmp_path):
    path = _write(tmp_path / "s.csv", [["OTU", "header", "row", "a"], [7, "x", 2, 5], [8, "y", 1, ""]])
    sheet = sheets.read_abundance_sheet(spark, path, "ITS1", first=4, last=4, ordinal="row")
    assert rows(sheet.cells) == [
        ("ITS1", 7, 2, "x", "x", None, 1, 5),
        ("ITS1", 8, 1, "y", "y", None, 1, None),
    ]


def test_only_needed_columns_are_scanned(spark, tmp_path):
    frame = spark.createDataFrame([(1, "h", "u", 1, 2)], "OTU long, header string, unused string, a long, b long")
    frame.write.parquet(str(tmp_path / "wide"))
    sheet = sheets.read_abundance_sheet(spark, str(tmp_path / "wide"), "ITS1", "parquet", first=4, last=5)
    plan = sheet.cells.select("otu", "reads")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan parquet [OTU" in line]
    assert scans and "unused" not in scans[0].split("Batched")[0] and "header" not in scans[0].split("Batched")[0]


def test_overviews_are_written_one_folder_per_table(spark, tmp_path):
    table = overview.overview_by_taxon(make_study(spark), "genus")
    target = tmp_path / "overview"
    write_overviews(table, str(target), fmt="csv")
    names = sorted(p.name for p in target.iterdir() if p.is_dir())
    assert names == ["table=ITS1_extra", "table=ITS1_orig", "table=ITS2_extra", "table=ITS2_orig"]
    files = sorted((target / "table=ITS1_extra").glob("part-*"))
    lines = [line for f in files for line in f.read_text().splitlines() if not line.startswith("marker")]
    assert [line.split(",")[2] for line in lines] == ["Alternaria", "Uncultured", '""'] or [
        line.split(",")[2] for line in lines
    ] == ["Alternaria", "Uncultured", ""]
    write_overviews(table, str(target))
    back = spark.read.parquet(str(target)).drop("table")
    assert rows(back, *table.columns) == rows(table)


def test_shared_folder_is_the_one_the_cluster_names(spark):
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    first, second = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert first.startswith(f"{root}/x-") and first != second


def test_part_files_follow_each_other_by_number(spark, tmp_path):
    for number in (99999, 100000, 2):
        spark.createDataFrame([(number,)], "v long").coalesce(1).write.parquet(str(tmp_path / "one" / str(number)))
        source = next((tmp_path / "one" / str(number)).glob("part-*.parquet"))
        target = tmp_path / "in" / f"part-{number:05d}-x.parquet"
        target.parent.mkdir(exist_ok=True)
        target.write_bytes(source.read_bytes())
    numbered = with_row_number(spark.read.parquet(str(tmp_path / "in")), "n", "parquet").orderBy("n").collect()
    assert [r["v"] for r in numbered] == [2, 99999, 100000]


def test_text_without_landing_folder_or_ordinal_is_refused(spark, tmp_path):
    path = _write(tmp_path / "s.csv", [["OTU", "header", "a"], [7, "x", 5]])
    with pytest.raises(ValueError, match="landing"):
        sheets.read_abundance_sheet(spark, path, "ITS1", first=3)


def test_all_columns_count_and_absent_ones_are_refused(spark, tmp_path):
    columns = [f"s{i}" for i in range(200)]
    frame = spark.createDataFrame([(1, "h", *[1] * 200)], ["OTU", "header", *columns])
    frame.write.parquet(str(tmp_path / "wide"))
    sheet = sheets.read_abundance_sheet(spark, str(tmp_path / "wide"), "ITS1", "parquet", first=3)
    assert sheet.cells.agg({"reads": "sum"}).first()[0] == 200
    for first, last in ((3, 203), (204, None), (0, 5)):
        with pytest.raises(ValueError, match="columns"):
            sheets.read_abundance_sheet(spark, str(tmp_path / "wide"), "ITS1", "parquet", first=first, last=last)


def test_names_and_columns_must_agree(spark, files, tmp_path):
    here = lambda name: str(tmp_path / "landed" / name)
    with pytest.raises(ValueError, match="6 names for 4 columns"):
        sheets.study_from_sheets(
            sheets.read_abundance_sheet(spark, files["ITS1"], "ITS1", first=3, last=6, landing=here("its1")),
            sheets.read_abundance_sheet(spark, files["ITS2"], "ITS2", first=3, landing=here("its2")),
            sheets.read_sample_sheet(spark, files["samples"], landing=here("samples")),
            sheets.read_genus_lookup(spark, files["genera"]),
        )


def test_ids_stay_whole_or_text(spark, tmp_path):
    path = _write(tmp_path / "s.csv", [["OTU", "header", "row", "a"], [2**53 + 1, "x", 1, 2**53 + 1], [2**53, "y", 2, 1]])
    sheet = sheets.read_abundance_sheet(spark, path, "ITS1", first=4, ordinal="row")
    assert rows(sheet.cells, "otu", "reads") == [(2**53, 1), (2**53 + 1, 2**53 + 1)]
    path = _write(tmp_path / "t.csv", [["OTU", "header", "row", "a"], ["OTU_12", "x", 1, 5]])
    sheet = sheets.read_abundance_sheet(spark, path, "ITS1", first=4, ordinal="row", otu_type="string")
    assert rows(sheet.cells, "otu", "reads") == [("OTU_12", 5)]


@pytest.mark.parametrize("code", ["sick", "0.7", "2"])
def test_unknown_status_codes_are_refused(spark, code):
    sheet = spark.createDataFrame([(1, "s", code, "a")], "pos long, site string, diseased string, sample string")
    with pytest.raises(Exception, match=f"unknown status code: {code}"):
        cohort.sample_dimension(sheet).collect()


def test_titles_that_repeat_in_any_case(spark, tmp_path):
    titles = ["OTU", "header", "header 2", "PCR neg", "n1.h", "pcr NEG", "N2.h", "PCR neg", "Header"]
    path = _write(tmp_path / "s.csv", [titles, [7, "x", "y", 1, 2, 3, 4, 5, 6]])
    sheet = sheets.read_abundance_sheet(spark, path, "ITS2", first=4, landing=str(tmp_path / "landed"))
    assert list(sheet.titles) == titles[3:]
    assert rows(sheet.cells, "header", "sample_pos", "reads") == [("x", i, i) for i in range(1, 7)]
    names = naming.own_names(sheet.headers)
    assert rows(names, "sample_pos", "sample") == [
        (1, "pcr_neg_1"), (2, "n1.h"), (3, "pcr_neg_2"), (4, "n2.h"), (5, "pcr_neg_3"), (6, "header")
    ]


def test_repeated_titles_that_are_no_blanks_are_refused_by_their_names(spark, files, tmp_path):
    here = lambda name: str(tmp_path / "landed" / name)
    line, *rest = open(files["ITS2"]).read().splitlines()
    twice = _write(tmp_path / "twice.csv", [line.replace(OWN[1], OWN[0].upper()).split(","), *(r.split(",") for r in rest)])
    study = sheets.study_from_sheets(
        sheets.read_abundance_sheet(spark, files["ITS1"], "ITS1", first=3, last=8, landing=here("its1")),
        sheets.read_abundance_sheet(spark, twice, "ITS2", first=3, landing=here("its2")),
        sheets.read_sample_sheet(spark, files["samples"], landing=here("samples")),
        sheets.read_genus_lookup(spark, files["genera"]),
    )
    with pytest.raises(ValueError, match=r"repeated sample columns: \[\('ITS2', 's1.h'\)\]"):
        study.columns


@pytest.mark.parametrize("titles", [["OTU", "OTU", "header", "a"], ["otu", "Otu", "header", "a"], ["id", "header", "b", "a"]])
def test_attribute_columns_must_be_one(spark, tmp_path, titles):
    path = _write(tmp_path / "s.csv", [titles, [7, 8, "x", 1]])
    with pytest.raises(ValueError, match="columns named 'OTU'"):
        sheets.read_abundance_sheet(spark, path, "ITS1", first=4, landing=str(tmp_path / "landed"))


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_counts_that_are_no_whole_numbers(spark, tmp_path, fmt):
    path = str(tmp_path / "sheet")
    frame = spark.createDataFrame(
        [(7, "Alternaria x", 1, 2.0, 1.0), (8, "Alternaria y", 2, 1.7, None)],
        "OTU long, header string, row long, a double, `b.1` double",
    )
    frame.coalesce(1).write.option("header", True).format(fmt).save(path)
    strict = sheets.read_abundance_sheet(spark, path, "ITS1", fmt, first=4, ordinal="row")
    with pytest.raises(Exception, match="'1.7' is no whole number in sample column 1 'a' of row OTU 8"):
        strict.cells.collect()
    shares = sheets.read_abundance_sheet(spark, path, "ITS1", fmt, first=4, ordinal="row", reads_type="double")
    assert rows(shares.cells, "otu", "sample_pos", "reads") == [(7, 1, 2.0), (7, 2, 1.0), (8, 1, 1.7), (8, 2, None)]
    with pytest.raises(ValueError, match="reads_type"):
        sheets.read_abundance_sheet(spark, path, "ITS1", fmt, first=4, ordinal="row", reads_type="int")


def test_shares_in_overview_and_report(spark, files, tmp_path):
    """Reads above 1 count as present and reads above 0 are shown, whole or not."""
    here = lambda name: str(tmp_path / "landed" / name)
    lines = [["OTU", "header", *[f"c{i}" for i in range(6)]], [1, "Rare one", 1.5, 0.4, 2, 0, "", 0], [2, "Other two", 1, 3, 0.25, 1, 1, 1]]
    path = _write(tmp_path / "shares.csv", lines)
    kinds = {"first": 3, "reads_type": "double"}
    study = sheets.study_from_sheets(
        sheets.read_abundance_sheet(spark, path, "ITS1", landing=here("its1"), **kinds),
        sheets.read_abundance_sheet(spark, files["ITS2"], "ITS2", first=3, landing=here("its2")),
        sheets.read_sample_sheet(spark, files["samples"], landing=here("samples")),
        sheets.read_genus_lookup(spark, files["genera"]),
    )
    found = overview.overview_by_taxon(study, "genus").filter("marker = 'ITS1'")
    assert rows(found, "dataset", "taxon", "healthy", "sick") == [
        ("extra", "Rare", 0, 1), ("original", "Other", 1, 0), ("original", "Rare", 0, 1)
    ]
    lines = report.report_lines(study).filter("marker = 'ITS1' AND block = 4").orderBy("sample_pos", "otu_pos")
    assert [r["text"] for r in lines.collect()][:4] == [
        "1 | Rare one | 1.5", "2 | Other two | 1", "1 | Rare one | 0.4", "2 | Other two | 3"
    ]
    assert pca.pca_all(study, 1).scores.count() == 8


@pytest.mark.parametrize("per", [[], ["p"]])
def test_many_groups_of_files_are_numbered_by_a_join(spark, tmp_path, monkeypatch, per):
    monkeypatch.setattr(ordinals, "PIECES_PER_GROUP", 3)
    frame = spark.range(300).selectExpr("id AS v", "IF(id % 3 = 0, NULL, id % 3) AS p").repartitionByRange(20, "v").sortWithinPartitions("p", "v")
    frame.write.partitionBy("p").parquet(str(tmp_path / "in"))
    numbered = with_row_number(spark.read.parquet(str(tmp_path / "in")), "n", "parquet", per=per)
    if per:
        found = numbered.orderBy("p", "v").collect()
        assert [r["n"] for r in found] == [*range(1, 101)] * 3
    else:
        assert sorted(r["n"] for r in numbered.collect()) == [*range(1, 301)]
    plan = numbered._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN") < 3


def test_shifts_beyond_the_bound_join_by_shuffle(spark, tmp_path, monkeypatch):
    spark.range(50).repartitionByRange(4, "id").sortWithinPartitions("id").write.parquet(str(tmp_path / "in"))
    scan = spark.read.parquet(str(tmp_path / "in"))
    small = with_row_number(scan, "n", "parquet")
    monkeypatch.setattr(ordinals, "MAX_BROADCAST_BYTES", 10)
    large = with_row_number(scan, "n", "parquet")
    assert rows(small, "id", "n") == rows(large, "id", "n") == rows(scan.selectExpr("id", "id + 1 AS n"))
    plans = [df._jdf.queryExecution().analyzed().toString().count("strategy=broadcast") for df in (small, large)]
    assert plans[0] == plans[1] + 1
