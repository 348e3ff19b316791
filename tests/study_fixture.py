"""A small hand-written study whose results can be worked out by eye."""

from __future__ import annotations

from functools import lru_cache

from taxaloom.operators import cohort, naming
from taxaloom.plans.prepare import Study

SHEET = [
    (1, "north reef", "1", "S1.H"),
    (2, "north reef", "0", " S2.h "),
    (3, "south", "1.0", "S3_(07.11)"),
    (4, "south", None, "S4.h"),
    (5, "south", "0", "Ex_con_1"),
    (6, "south", "0", "S6 (07.11)"),
]
OWN = ["s1.h", "s2.h", "s3  (07.11)", "PCR a", "ex con 1", "pcr b"]
OTUS = [
    (10, 1, "Millepora alcicornis X"),
    (11, 2, "Millepora alcicornis Y"),
    (12, 3, "Uncultured"),
    (13, 4, "Alternaria alternata with a header that is longer than forty characters"),
    (14, 5, None),
]
CELLS = [
    ("ITS1", 10, 1, 1, 5),
    ("ITS1", 11, 2, 1, 7),
    ("ITS1", 12, 3, 1, 1),
    ("ITS1", 10, 1, 2, 2),
    ("ITS1", 12, 3, 2, 7),
    ("ITS1", 13, 4, 2, 7),
    ("ITS1", 14, 5, 3, 3),
    ("ITS1", 12, 3, 3, 4),
    ("ITS1", 13, 4, 4, 9),
    ("ITS1", 13, 4, 5, 9),
    ("ITS1", 13, 4, 6, None),
    ("ITS1", 12, 3, 6, 0),
    ("ITS2", 13, 4, 1, 6),
    ("ITS2", 10, 1, 3, 2),
]
GENERA = [("Millepora", "millepora"), ("Alternaria", "fungus"), ("Rare", None)]


@lru_cache(maxsize=32)
def make_study(spark, cells=tuple(CELLS)) -> Study:
    sheet = spark.createDataFrame(SHEET, "pos long, site string, diseased string, sample string")
    headers = spark.createDataFrame(
        [("ITS2", i, n) for i, n in enumerate(OWN, start=1)],
        "marker string, sample_pos int, sample string",
    )
    return Study(
        cells=spark.createDataFrame(
            list(cells), "marker string, otu long, otu_pos long, sample_pos int, reads long"
        ),
        otus=spark.createDataFrame(OTUS, "otu long, otu_pos long, header string"),
        names=naming.names_by_position(sheet, "ITS1").unionByName(naming.own_names(headers)),
        samples=cohort.sample_dimension(sheet, ["PCR_neg_2"]),
        genus_info=spark.createDataFrame(GENERA, "genus string, description string"),
    )


def rows(df, *columns, sort=True):
    picked = [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
    return sorted(picked, key=lambda r: [(v is None, str(v)) for v in r]) if sort else picked
