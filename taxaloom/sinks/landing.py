"""A study as tables that later jobs read without shuffles."""

from __future__ import annotations

from pyspark.sql import functions as F

from taxaloom.functions import text
from taxaloom.operators import presence
from taxaloom.plans.prepare import Study

PARTS = ("otus", "names", "samples", "genus_info")


def land(study: Study, prefix: str, path: str, buckets: int) -> None:
    """Writes the study as tables ``<prefix>_cells``, ``_otus``, ``_names``, ``_samples``, ``_genus_info``.

    Wide sheets are taken apart once here. Cells keep their header, genus and species, which repeat
    within an OTU and so cost little in sorted columnar files, and spare the header join. They are partitioned by marker
    and bucketed by OTU row, the key of the PCA: its matrix rows are then built without a shuffle.
    Cells without reads are left out, since no result depends on them. Rows are placed by bucket
    before the write, so a task writes one file per marker and bucket: choose ``buckets`` for files of a few GB at most.
    """
    study.check_otus()
    cells = presence.with_header(study.cells, study.otus).filter("reads <> 0")
    header = F.col("header")
    cells = cells.withColumns({"genus": text.genus(header), "species": text.species(header)})
    (
        cells.select("otu", "otu_pos", "header", "genus", "species", "sample_pos", "reads", "marker")
        .repartition(buckets, F.col("otu_pos"))
        .write.mode("overwrite")
        .partitionBy("marker")
        .bucketBy(buckets, "otu_pos")
        .sortBy("otu_pos")
        .option("path", f"{path}/cells")
        .saveAsTable(f"{prefix}_cells")
    )
    for part in PARTS:
        (
            getattr(study, part)
            .write.mode("overwrite")
            .option("path", f"{path}/{part}")
            .saveAsTable(f"{prefix}_{part}")
        )
