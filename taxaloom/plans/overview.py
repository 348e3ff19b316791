"""Prevalence overviews by OTU, genus and species."""

from __future__ import annotations

from pyspark.sql import DataFrame

from taxaloom.operators import presence
from taxaloom.operators.prevalence import prevalence
from taxaloom.plans.prepare import Study


def presence_by(study: Study, rank: str) -> DataFrame:
    """One row per sample and taxon of the given rank."""
    cells = presence.assigned(study.cells, study.columns)
    return presence.presence(presence.with_taxon(cells, rank, study.otus), study.columns)


def overview_by_taxon(study: Study, rank: str) -> DataFrame:
    """The overview tables of all markers and datasets by genus or species, in one job."""
    return prevalence(presence_by(study, rank), study.totals)


def overview_by_otu(study: Study, marker: str = "ITS1") -> DataFrame:
    """The overview tables of one marker by OTU, with headers.

    Sample and OTU name a cell, so nothing has to be made distinct, and headers join the aggregated
    rows instead of the cells. A repeated OTU would repeat result rows and is refused.
    """
    study.check_otus()
    cells = study.cells.filter(study.cells["marker"] == marker)
    present = presence.with_taxon(presence.assigned(cells, study.columns), "otu")
    counted = prevalence(present, study.totals)
    named = presence.with_header(counted.withColumnRenamed("taxon", "otu"), study.otus)
    return named.select(*["otu" if c == "taxon" else c for c in counted.columns], "header")
