from __future__ import annotations

from pyspark.sql import functions as F

from study_fixture import make_study, rows
from taxaloom.plans import report
from taxaloom.sinks.report import write_report

ITS1 = """### s1.h

OTU | Info | Abundance
--- | --- | ---
11 | Millepora alcicornis Y | 7
10 | Millepora alcicornis X | 5
12 | Uncultured | 1

### s2.h

OTU | Info | Abundance
--- | --- | ---
12 | Uncultured | 7
13 | Alternaria alternata with a header that  | 7
10 | Millepora alcicornis X | 2

### s3(07.11)

OTU | Info | Abundance
--- | --- | ---
12 | Uncultured | 4
14 | NA | 3

### s4.h

OTU | Info | Abundance
--- | --- | ---
13 | Alternaria alternata with a header that  | 9

### ex_con_1

OTU | Info | Abundance
--- | --- | ---
13 | Alternaria alternata with a header that  | 9

### s6(07.11)

no hits!

"""


def test_lines_in_order_are_the_report(spark):
    order = ["marker", "sample_pos", "block", F.desc("reads"), "otu_pos"]
    lines = report.report_lines(make_study(spark)).filter("marker = 'ITS1'").orderBy(*order)
    assert "".join(r["text"] + "\n" for r in lines.collect()) == ITS1


def test_written_files_in_name_order_are_the_report(spark, tmp_path):
    target = tmp_path / "report"
    for _ in range(2):  # the second run replaces the first
        write_report(report.report_lines(make_study(spark)), str(target))
        files = sorted((target / "marker=ITS1").glob("part-*"))
        assert "".join(f.read_text() for f in files) == ITS1
    assert (target / "marker=ITS2").is_dir()


def test_ranks(spark):
    ranked = report.ranked_otus(make_study(spark)).filter("marker = 'ITS1' AND sample_pos <= 2")
    assert rows(ranked.orderBy("sample_pos", "rank"), "sample", "otu", "reads", "rank", sort=False) == [
        ("s1.h", 11, 7, 1),
        ("s1.h", 10, 5, 2),
        ("s1.h", 12, 1, 3),
        ("s2.h", 12, 7, 1),
        ("s2.h", 13, 7, 2),
        ("s2.h", 10, 2, 3),
    ]
