"""From raw inputs to the frames every analysis starts with."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from taxaloom import model
from taxaloom.functions.sizing import broadcast_if_small
from taxaloom.operators import cohort, presence, quality


@dataclass(frozen=True)
class Study:
    """The frames of one study (see ``taxaloom.model``).

    ``columns``, ``panel`` and ``totals`` serve every analysis and are cached: they have one row per
    sheet column or dataset. The first two carry a broadcast hint only if they measured small.
    """

    cells: DataFrame
    otus: DataFrame
    names: DataFrame
    samples: DataFrame
    genus_info: DataFrame
    rows: DataFrame | None = None  # the wide sheets, where the study comes from them

    @cached_property
    def _columns(self) -> DataFrame:
        columns = cohort.sheet_columns(self.names, self.samples).persist()
        quality.require_unique(columns, ["marker", "sample_pos"], "samples in the sample sheet")
        quality.require_unique(columns, ["marker", "sample"], "sample columns")
        return columns

    @cached_property
    def columns(self) -> DataFrame:
        """The sample columns of all sheets with the attributes of their samples.

        A sample listed twice, or two columns of one name, would count reads twice and are refused.
        """
        return broadcast_if_small(self._columns)

    @cached_property
    def _panel(self) -> DataFrame:
        return cohort.panel_columns(self._columns).persist()

    @cached_property
    def panel(self) -> DataFrame:
        """The sample columns of the PCA panels."""
        return broadcast_if_small(self._panel)

    @cached_property
    def totals(self) -> DataFrame:
        """Healthy and sick samples per dataset, two rows at most."""
        return cohort.status_totals(self.samples).persist()

    def check_otus(self) -> None:
        """Refuses repeated OTUs, which would repeat result rows. One aggregate over all OTUs, once per study."""
        if "_otus_checked" not in self.__dict__:
            quality.require_unique(self.otus, presence.otu_key(self.otus), "OTUs")
            self.__dict__["_otus_checked"] = True

    def release(self) -> None:
        """Drops the cached frames."""
        for cached in ("_panel", "_columns", "totals"):
            if cached in self.__dict__:
                self.__dict__.pop(cached).unpersist()
        for hinted in ("panel", "columns"):
            self.__dict__.pop(hinted, None)


def long_table(study: Study, min_reads: int = model.MIN_READS_OVERVIEW) -> DataFrame:
    """Cells of assigned samples with enough reads, with header and sample attributes."""
    cells = presence.assigned(study.cells, study.columns, min_reads)
    return presence.with_header(cells, study.otus).select(
        "marker", "otu", "otu_pos", "header", "sample", "reads", "diseased", "dataset", "status"
    )
