"""Table shapes and fixed values shared by every module.

Frames passed between modules:

    cells     marker, otu, otu_pos, sample_pos, reads            one row per sheet cell
    rows      marker, otu, otu_pos, header, counts               one row per OTU with all its cells
    otus      [marker,] otu, otu_pos, header                     one row per OTU (and marker)
    names     marker, sample_pos, sample                         sample columns of each sheet
    samples   pos, site, diseased, sample, dataset, status, is_control
    columns   names with the attributes of samples               one row per sheet column
    panel     columns kept for one PCA, with panel and sample_idx

Input order is data. It is always an explicit column (``otu_pos``, ``sample_pos``, ``pos``), so no
result depends on how Spark partitions the rows.
"""

from __future__ import annotations

from pyspark.sql import types as T

# Fixed values that results must show literally.
MARKERS = ("ITS1", "ITS2")
ORIGINAL = "original"
EXTRA = "extra"
EXTRA_MARK = "("
UNASSIGNED = "-"
STATUS_LABELS = {"-": "not assigned", "0": "healthy", "1": "sick"}
POINT_LABELS = {"-": "unlabeled", "0": "healthy", "1": "sick"}
CONTROL_MARKS = ("pcr_neg_", "ex_con_")
BLANK_MARK = "pcr"
BLANK_PREFIX = "PCR_neg_"
INCLUDED_DESCRIPTION = "fungus"
EXCLUDED_DESCRIPTIONS = ("coral", "sponge", "millepora", "anemone")
SHEET_NAME_RULES = ((" (", "("), ("_(", "("))
OWN_NAME_RULES = ((" (", "("), (" (", "("), ("t v", "tv"), (" con ", "_con_"))
TABLE_NAMES = {
    ("ITS1", "original"): "ITS1_orig",
    ("ITS2", "original"): "ITS2_orig",
    ("ITS1", "extra"): "ITS1_extra",
    ("ITS2", "extra"): "ITS2_extra",
}
OTU_TABLE_NAMES = {("ITS1", "original"): "original", ("ITS1", "extra"): "extra"}
OTU_LABEL = "OTU_"
REPORT_HEADING = "### "
REPORT_NO_HITS = "no hits!"
REPORT_COLUMNS = "OTU | Info | Abundance"
REPORT_RULE = "--- | --- | ---"
REPORT_SEPARATOR = " | "
REPORT_INFO_WIDTH = 40
FIRST_SAMPLE_COLUMN = 28
PANELS = (
    ("ITS1", "original"),
    ("ITS1", "extra"),
    ("ITS2", "original"),
    ("ITS2", "extra"),
)
AXES_ALL = {1: (1, 2), 2: (1, 2), 3: (1, 3), 4: (1, 2)}
AXES_SELECTED = {1: (1, 2), 2: (1, 2), 3: (1, 2), 4: (1, 2)}

# Reads a cell needs to count in each kind of result.
MIN_READS_OVERVIEW = 2
MIN_READS_REPORT = 1

SAMPLE_SHEET = T.StructType(
    [
        T.StructField("pos", T.LongType()),
        T.StructField("site", T.StringType()),
        T.StructField("diseased", T.StringType()),
        T.StructField("sample", T.StringType()),
    ]
)
