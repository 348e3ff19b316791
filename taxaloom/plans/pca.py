"""PCA of samples and the tables behind its scatter plots."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaloom import model
from taxaloom.functions import numbers, text
from taxaloom.operators import genera, ordination
from taxaloom.plans.prepare import Study


@dataclass(frozen=True)
class Pca:
    """Scores of all panels (see ``ordination.ordinate``) and the columns they belong to.

    Scores are computed when the PCA is made; they have one row per sample and component.
    """

    scores: DataFrame
    panel: DataFrame

    @property
    def variances(self) -> DataFrame:
        """Shares of the components with the marker and dataset of their panel."""
        return ordination.variances(self.scores).join(self._panels(), "panel")

    def _panels(self) -> DataFrame:
        return self.panel.filter("sample_idx = 0").select("panel", "marker", "dataset")

    @property
    def sample_scores(self) -> DataFrame:
        """Scores with marker, dataset and sample name."""
        named = self.panel.select("panel", "sample_idx", "marker", "dataset", "sample")
        return self.scores.join(named, ["panel", "sample_idx"])


def panel_matrix(study: Study) -> DataFrame:
    """The matrix of every panel as its non-zero entries: panel, sample, label, reads."""
    placed = study.panel.select("marker", "sample_pos", "panel", "sample")
    label = F.concat(F.lit(model.OTU_LABEL), F.col("otu").cast("string")).alias("label")
    return (
        study.cells.filter("reads <> 0")
        .join(placed, ["marker", "sample_pos"])
        .select("panel", "sample", label, "reads")
    )


def pca_all(study: Study, k: int) -> Pca:
    """The first k components of every panel over all OTUs."""
    return _pca(study, k)


def selected_otus(study: Study, exclude: bool = False) -> DataFrame:
    """OTUs of the included genera, or of all but the excluded ones."""
    return genera.otus_of(study.otus, _genera(study, exclude))


def pca_selected(study: Study, k: int, exclude: bool = False) -> Pca:
    """The first k components of every panel over the OTUs of selected genera.

    A row counts by its own genus, also where another row has the same OTU id.
    """
    return _pca(study, k, _genera(study, exclude))


def _genera(study: Study, exclude: bool) -> DataFrame:
    choose = genera.excluded_out_genera if exclude else genera.included_genera
    return choose(study.genus_info)


def matrix_rows(study: Study, listed: DataFrame | None = None) -> DataFrame:
    """The rows of all panels' matrices, of listed genera if given: panel, values."""
    panel = study.panel
    if study.rows is not None:
        rows = study.rows if listed is None else genera.rows_of(study.rows, listed)
        return ordination.rows_of_sheets(rows, ordination.layout(panel))
    cells = study.cells
    if listed is not None and ("genus" in cells.columns or "header" in cells.columns):
        cells = genera.rows_of(cells, listed)
    elif listed is not None:
        key = [c for c in ("marker", "otu_pos") if c in study.otus.columns]
        cells = cells.join(genera.otus_of(study.otus, listed).select(*key), key, "left_semi")
    return ordination.rows_of_cells(cells, panel, ordination.panel_sizes(panel))


def _pca(study: Study, k: int, listed: DataFrame | None = None) -> Pca:
    scores = ordination.ordinate(matrix_rows(study, listed), ordination.panel_sizes(study.panel), k)
    return Pca(scores, study.panel)


def _axis(axes: dict[int, tuple[int, int]], which: int) -> Column:
    chosen = F.lit(None).cast("int")
    for panel, pair in axes.items():
        chosen = F.when(F.col("panel") == panel, pair[which]).otherwise(chosen)
    return chosen


def plot_points(pca: Pca, axes: dict[int, tuple[int, int]]) -> DataFrame:
    """One point per sample: its two scores and all attributes a plot colours or shapes by.

    ``individual`` pairs the samples of one colony and exists in the original dataset only.
    """
    at = F.col("component")
    placed = pca.scores.groupBy("panel", "sample_idx").agg(
        F.max(F.when(at == _axis(axes, 0), F.col("score"))).alias("x"),
        F.max(F.when(at == _axis(axes, 1), F.col("score"))).alias("y"),
    )
    paired = F.when(F.col("dataset") == model.ORIGINAL, text.without_suffix(F.col("sample"), 2))
    attributes = pca.panel.select(
        "panel",
        "sample_idx",
        "marker",
        "dataset",
        "sample",
        paired.alias("individual"),
        "site",
        "diseased",
        text.label(F.col("diseased"), model.POINT_LABELS).alias("label"),
    )
    return placed.join(attributes, ["panel", "sample_idx"])


def captions(pca: Pca, axes: dict[int, tuple[int, int]]) -> DataFrame:
    """The caption of each panel with the variation its two axes capture."""
    shown = (F.col("component") == _axis(axes, 0)) | (F.col("component") == _axis(axes, 1))
    captured = numbers.percent(F.sum("share")).alias("captured")
    return (
        pca.variances.filter(shown)
        .groupBy("panel", "marker", "dataset")
        .agg(captured)
        .withColumn(
            "caption",
            F.concat(
                F.lit("PCA for "),
                F.col("marker"),
                F.lit(" & "),
                F.col("dataset"),
                F.lit(" data\n"),
                text.plain_number(F.col("captured")),
                F.lit(" % of total variation captured"),
            ),
        )
    )
