
from __future__ import annotations

import sys
from collections.abc import Callable
from functools import lru_cache
from importlib.util import find_spec
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from oracles import SQL  # noqa: E402
from taxaloom import model  # noqa: E402
from taxaloom.operators import cohort, naming, ordination, presence, ranking, reshape  # noqa: E402
from taxaloom.plans import overview, pca, prepare, report  # noqa: E402
from taxaloom.session import shared_folder  # noqa: E402
from taxaloom.sinks.landing import land  # noqa: E402
from taxaloom.sinks.report import write_report  # noqa: E402
from taxaloom.sinks.tables import write_overviews  # noqa: E402
from taxaloom.sources import sheets, testtables  # noqa: E402
from taxaloom.sources.landed import study_from_tables  # noqa: E402
from taxaloom.sources.ordinals import with_row_number  # noqa: E402

# The operators on documents are a package of their own that may be absent. One that is there must import.
if find_spec("taxaloom.llm") and find_spec("taxaloom.llm.queries"):
    from taxaloom.llm import queries as llm_queries  # noqa: E402
else:
    llm_queries = None

SMOKE_DIR = "/root/testdata/sf0.001"
LEADING = 3

# One lazily planned study per session and folder, so its sample dimension is cached once.
study = lru_cache(maxsize=8)(testtables.study)


def sample_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study(spark, sf_dir).samples


def blank_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return naming.number_blanks(testtables.own_headers(spark, sf_dir))


def sheet_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study(spark, sf_dir).names


def cohort_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.group_sizes(study(spark, sf_dir).samples)


def unpivot_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide sheets with all their zero cells, made long again and named by position."""
    here = study(spark, sf_dir)
    positions = range(1, testtables.sample_count(spark, sf_dir) + 1)
    wide = reshape.widen(here.cells, ["marker", "otu"], positions, testtables.partitions(spark, sf_dir))
    long = reshape.melt(wide, ["marker", "otu"], [str(p) for p in positions])
    return presence.labelled(long, here.columns).select(
        "marker", "otu", "sample_pos", "sample", "reads"
    )


def long_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.long_table(study(spark, sf_dir))


def _taxa(spark: SparkSession, sf_dir: str, rank: str) -> DataFrame:
    here = study(spark, sf_dir)
    return presence.with_taxon(presence.assigned(here.cells, here.columns), rank, here.otus)


def _occurrences(rank: str) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return presence.occurrences(_taxa(spark, sf_dir, rank)).select(
            "marker", "sample", "taxon", "otu", "occurrence"
        )

    return query


def first_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return presence.first_occurrences(_taxa(spark, sf_dir, "genus"))


def _presence(rank: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: overview.presence_by(study(spark, sf_dir), rank)


def _prevalence(rank: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: overview.overview_by_taxon(study(spark, sf_dir), rank)


def prevalence_otu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.overview_by_otu(study(spark, sf_dir))


def overview_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The species overview written as one folder per table, read back."""
    path = shared_folder(spark, "overview")
    write_overviews(_prevalence("species")(spark, sf_dir), path)
    return spark.read.parquet(path).drop("marker", "dataset")


def overview_tables_genus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The genus overview written as one folder per table, read back."""
    path = shared_folder(spark, "overview")
    write_overviews(_prevalence("genus")(spark, sf_dir), path)
    return spark.read.parquet(path).drop("marker", "dataset")


def sample_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    here = study(spark, sf_dir)
    return ranking.sample_hits(here.cells, here.columns)


def sample_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.ranked_otus(study(spark, sf_dir)).select(
        "marker", "sample_pos", "sample", "otu", "reads", "rank"
    )


def sample_report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.report_lines(study(spark, sf_dir))


def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report written as text, read back with the number of each line."""
    path = shared_folder(spark, "report")
    write_report(sample_report_lines(spark, sf_dir), path)
    lines = spark.read.text(path).withColumnRenamed("value", "text")
    return with_row_number(lines, "line", "text", per=["marker"], landing=shared_folder(spark, "lines"))


def _from_files(spark: SparkSession, sf_dir: str, fmt: str = "csv") -> prepare.Study:
    path = shared_folder(spark, "sheets")
    testtables.write_sheets(spark, sf_dir, path, fmt)
    return testtables.study_from_files(spark, path, fmt)


def sheets_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long table from sheets written as CSV and read back."""
    return prepare.long_table(_from_files(spark, sf_dir))


def sheets_parquet_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long table from sheets written as Parquet and read back."""
    return prepare.long_table(_from_files(spark, sf_dir, "parquet"))


def sheets_selected_otus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """OTUs of the included genera from sheets written as CSV and read back."""
    return pca.selected_otus(_from_files(spark, sf_dir))


def sheets_pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The PCA with matrix rows taken straight from wide sheets."""
    return _rounded(pca.pca_all(_from_files(spark, sf_dir, "parquet"), LEADING))


def sheets_repeated_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names and reads of a CSV sheet whose blanks all have one title, in three spellings."""
    path = shared_folder(spark, "sheets")
    testtables.write_sheets(spark, sf_dir, path, blanks=("PCR neg", "pcr NEG", "PCR Neg"))
    sheet = sheets.read_abundance_sheet(spark, f"{path}/ITS2", "ITS2", landing=f"{path}/landed/ITS2")
    reads = sheet.cells.groupBy("marker", "sample_pos").agg(F.sum("reads").alias("reads"))
    return naming.own_names(sheet.headers).join(reads, ["marker", "sample_pos"])


def sheets_wide_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reads per column of a sheet with every sample column twice, all columns from the first on."""
    n = testtables.sample_count(spark, sf_dir)
    here = testtables.cells(spark, sf_dir).filter("marker = 'ITS1'")
    wide = reshape.widen(here, ["otu"], range(1, n + 1), testtables.partitions(spark, sf_dir))
    named = [F.col(str(p)).alias(f"{name} {p}") for name in ("first", "second") for p in range(1, n + 1)]
    path = shared_folder(spark, "sheets")
    wide.select(F.col("otu").alias("OTU"), F.lit("one").alias("header"), *named).write.parquet(path)
    sheet = sheets.read_abundance_sheet(spark, path, "ITS1", "parquet", first=3)
    return sheet.cells.groupBy("sample_pos").agg(F.sum("reads").alias("reads"))


def _from_tables(spark: SparkSession, sf_dir: str) -> prepare.Study:
    path = shared_folder(spark, "landed")
    prefix = path.rsplit("/", 1)[-1].replace("-", "_")
    land(study(spark, sf_dir), prefix, path, buckets=8)
    return study_from_tables(spark, prefix)


def landed_prevalence_genus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The genus overview from the study written as tables."""
    return overview.overview_by_taxon(_from_tables(spark, sf_dir), "genus")


def landed_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dot products of samples from the study written as tables."""
    return _gram(_from_tables(spark, sf_dir))


def panel_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return study(spark, sf_dir).panel.select(
        "panel", "marker", "dataset", "sample_pos", "sample_idx", "sample"
    )


def overview_tables_otu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The OTU overview written as one folder per table, read back."""
    path = shared_folder(spark, "overview")
    write_overviews(prevalence_otu(spark, sf_dir), path, "otu", model.OTU_TABLE_NAMES)
    return spark.read.parquet(path).drop("marker", "dataset")


def panel_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pca.panel_matrix(study(spark, sf_dir))


def genus_include(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pca.selected_otus(study(spark, sf_dir))


def genus_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pca.selected_otus(study(spark, sf_dir), exclude=True)


def _gram(here: prepare.Study) -> DataFrame:
    sizes = ordination.panel_sizes(here.panel)
    return ordination.gram(ordination.panel_cells(here.cells, here.panel), here.panel, sizes)


def sample_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gram(study(spark, sf_dir))


def pca_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared reads of each panel, as the PCA takes them for all variance."""
    found = pca.pca_all(study(spark, sf_dir), 1)
    return found.sample_scores.groupBy("marker", "dataset").agg(
        F.round(F.max("energy")).cast("long").alias("energy")
    )


def pca_sample_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared scores of a sample on all components add up to its squared reads."""
    every = testtables.sample_count(spark, sf_dir)
    scores = pca.pca_all(study(spark, sf_dir), every).sample_scores
    squared = F.col("score") * F.col("score")
    return scores.groupBy("marker", "dataset", "sample").agg(
        F.round(F.sum(squared)).cast("long").alias("energy")
    )


def _pca(spark: SparkSession, sf_dir: str, selected: bool) -> pca.Pca:
    run = pca.pca_selected if selected else pca.pca_all
    return run(study(spark, sf_dir), LEADING)


def _variance(selected: bool) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _pca(spark, sf_dir, selected).variances.select(
            "marker",
            "dataset",
            "component",
            F.round("singular_value", 4).alias("singular_value"),
            F.round("variance", 3).alias("variance"),
            F.round("share", 7).alias("share"),
            F.round("cum_share", 7).alias("cum_share"),
        )

    return query


def _rounded(found: pca.Pca) -> DataFrame:
    return found.sample_scores.select(
        "marker", "dataset", "component", "sample", F.round("score", 4).alias("score")
    )


def _scores(selected: bool) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: _rounded(_pca(spark, sf_dir, selected))


def pca_excluded_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The PCA over all genera but the excluded ones; those without a description stay in."""
    return _rounded(pca.pca_selected(study(spark, sf_dir), LEADING, exclude=True))


def landed_pca_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pca.pca_all(_from_tables(spark, sf_dir), LEADING))


def landed_pca_selected_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(pca.pca_selected(_from_tables(spark, sf_dir), LEADING))


def _axes(selected: bool) -> dict[int, tuple[int, int]]:
    return model.AXES_SELECTED if selected else model.AXES_ALL


def _points(selected: bool) -> Callable[[SparkSession, str], DataFrame]:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        points = pca.plot_points(_pca(spark, sf_dir, selected), _axes(selected))
        return points.withColumns({"x": F.round("x", 4), "y": F.round("y", 4)}).drop("sample_idx")

    return query


def _captions(selected: bool) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: pca.captions(_pca(spark, sf_dir, selected), _axes(selected))


def entry(spark: SparkSession) -> DataFrame:
    """What part of the healthy and of the sick samples contain each genus."""
    return queries()["prevalence_genus"](spark, SMOKE_DIR)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query by name."""
    return core_queries() | (llm_queries.queries() if llm_queries else {})


def oracle_sql() -> dict[str, str]:
    """The same queries as DuckDB SQL, where SQL can express them."""
    return dict(SQL) | (llm_queries.oracle_sql() if llm_queries else {})


def core_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """The queries on count tables."""
    return {
        "sample_dimension": sample_dimension,
        "blank_numbering": blank_numbering,
        "sheet_names": sheet_names,
        "cohort_totals": cohort_totals,
        "unpivot_long": unpivot_long,
        "long_filtered": long_filtered,
        "occurrences_genus": _occurrences("genus"),
        "occurrences_species": _occurrences("species"),
        "first_occurrences": first_occurrences,
        "presence_genus": _presence("genus"),
        "presence_species": _presence("species"),
        "prevalence_genus": _prevalence("genus"),
        "prevalence_species": _prevalence("species"),
        "prevalence_otu": prevalence_otu,
        "overview_tables": overview_tables,
        "overview_tables_otu": overview_tables_otu,
        "overview_tables_genus": overview_tables_genus,
        "sample_hits": sample_hits,
        "sample_ranked": sample_ranked,
        "sample_report_lines": sample_report_lines,
        "report_files": report_files,
        "sheets_long": sheets_long,
        "sheets_parquet_long": sheets_parquet_long,
        "sheets_selected_otus": sheets_selected_otus,
        "sheets_pca_scores": sheets_pca_scores,
        "sheets_repeated_headers": sheets_repeated_headers,
        "sheets_wide_range": sheets_wide_range,
        "landed_prevalence_genus": landed_prevalence_genus,
        "landed_gram": landed_gram,
        "landed_pca_scores": landed_pca_scores,
        "landed_pca_selected_scores": landed_pca_selected_scores,
        "panel_samples": panel_samples,
        "panel_matrix": panel_matrix,
        "genus_include": genus_include,
        "genus_exclude": genus_exclude,
        "sample_gram": sample_gram,
        "pca_energy": pca_energy,
        "pca_sample_energy": pca_sample_energy,
        "pca_variance": _variance(selected=False),
        "pca_scores": _scores(selected=False),
        "pca_excluded_scores": pca_excluded_scores,
        "pca_selected_variance": _variance(selected=True),
        "pca_selected_scores": _scores(selected=True),
        "plot_points": _points(selected=False),
        "plot_points_selected": _points(selected=True),
        "panel_captions": _captions(selected=False),
        "panel_captions_selected": _captions(selected=True),
    }
