"""The registered queries as DuckDB SQL on the shared test tables."""

from __future__ import annotations

SHEETS = """
segments AS (
    SELECT unnest(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY']) AS segment,
           unnest([0, 1, 2, 3, 4]) AS i),
places AS (
    SELECT n_nationkey AS k, i, segment, n_regionkey, CAST(n_nationkey * 5 + i + 1 AS BIGINT) AS pos
    FROM nation CROSS JOIN segments),
sheet AS (
    SELECT pos, r_name AS site,
           CASE WHEN pos % 7 = 0 THEN NULL WHEN (k + i) % 2 = 0 THEN '0' ELSE '1' END AS diseased,
           CASE WHEN pos % 31 = 0 THEN 'PCR_neg_' || (pos // 31)
                WHEN pos % 29 = 0 THEN 'Ex_con_' || pos
                WHEN k < 13 THEN ' N' || k || '.' || i || '.H '
                WHEN pos % 2 = 0 THEN 'N' || k || '.' || i || ' (07.11)'
                ELSE 'N' || k || '.' || i || '_(07.11)' END AS sample
    FROM places JOIN region ON n_regionkey = r_regionkey),
appended AS (
    SELECT * FROM sheet
    UNION ALL SELECT (SELECT max(pos) + 1 FROM sheet), NULL, NULL, 'PCR_neg_5'),
cleaned AS (
    SELECT pos,
           array_to_string(list_transform(string_split(lower(site), ' '),
                                          lambda w: upper(w[1]) || w[2:]), ' ') AS site,
           coalesce(diseased, '-') AS diseased,
           replace(replace(trim(lower(sample)), ' (', '('), '_(', '(') AS sample
    FROM appended),
samples AS (
    SELECT *,
           CASE WHEN pos < (SELECT min(pos) FROM cleaned WHERE contains(sample, '(')) THEN 'original'
                ELSE 'extra' END AS dataset,
           CASE diseased WHEN '-' THEN 'not assigned' WHEN '0' THEN 'healthy' ELSE 'sick' END AS status,
           contains(sample, 'pcr_neg_') OR contains(sample, 'ex_con_') AS is_control
    FROM cleaned),
headers AS (
    SELECT 'ITS2' AS marker, CAST(pos AS INTEGER) AS sample_pos,
           CASE WHEN pos % 31 = 0 THEN 'PCR neg'
                WHEN pos % 29 = 0 THEN 'EX con ' || pos
                WHEN k < 13 THEN 'n' || k || '.' || i || '.h'
                ELSE 'n' || k || '.' || i || '  (07.11)' END AS sample
    FROM places),
numbered AS (
    SELECT marker, sample_pos,
           CASE WHEN lower(sample) LIKE '%pcr%'
                THEN 'PCR_neg_' || row_number() OVER (
                    PARTITION BY marker, lower(sample) LIKE '%pcr%' ORDER BY sample_pos)
                ELSE sample END AS sample
    FROM headers),
names AS (
    SELECT 'ITS1' AS marker, CAST(pos AS INTEGER) AS sample_pos,
           replace(replace(trim(lower(sample)), ' (', '('), '_(', '(') AS sample
    FROM sheet
    UNION ALL
    SELECT marker, sample_pos,
           replace(replace(replace(replace(trim(lower(sample)), ' (', '('), ' (', '('),
                           't v', 'tv'), ' con ', '_con_')
    FROM numbered),
cols AS (SELECT * FROM names LEFT JOIN samples USING (sample))"""

CELLS = (
    SHEETS
    + """,
otus AS (
    SELECT p_partkey AS otu, p_partkey AS otu_pos,
           p_brand || '-' || p_size || CASE WHEN p_partkey % 17 = 0 THEN '' ELSE ' ' || p_name END AS header,
           p_brand || '-' || p_size AS genus,
           CASE WHEN p_partkey % 17 = 0 THEN NULL
                ELSE p_brand || '-' || p_size || ' ' || split_part(p_name, ' ', 1) END AS species
    FROM part),
genus_info AS (
    SELECT DISTINCT p_brand || '-' || p_size AS genus,
           CASE WHEN p_size % 11 = 0 THEN NULL WHEN p_size % 13 = 0 THEN 'alga'
                ELSE ['fungus', 'coral', 'sponge', 'anemone'][p_size % 4 + 1] END AS description
    FROM part),
cells AS (
    SELECT CASE WHEN l_linestatus = 'O' THEN 'ITS1' ELSE 'ITS2' END AS marker, l_partkey AS otu,
           CAST(pos AS INTEGER) AS sample_pos, CAST(sum(l_quantity) AS BIGINT) AS reads
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
         JOIN places ON c_nationkey = k AND c_mktsegment = segment
    GROUP BY ALL),
long AS (
    SELECT marker, otu, otu_pos, header, genus, species, sample, sample_pos, reads, diseased, dataset,
           status
    FROM cells JOIN cols USING (marker, sample_pos) JOIN otus USING (otu)
    WHERE diseased <> '-' AND reads > 1)"""
)

TOTALS = """,
totals AS (
    SELECT dataset, count(*) FILTER (status = 'healthy') AS healthy_total,
           count(*) FILTER (status = 'sick') AS sick_total
    FROM samples GROUP BY dataset)"""


def _rounded(value: str, digits: int) -> str:
    """The nearer of the two nearest decimals, the even one of equally near ones, all as doubles."""
    p = f"{10**digits}::DOUBLE"
    below, above = f"floor(x * {p}) / {p}", f"ceil(x * {p}) / {p}"
    low = f"x - {below} < {above} - x OR (x - {below} = {above} - x AND floor(x * {p}) % 2 = 0)"
    return f"list_transform([{value}], lambda x: CASE WHEN {low} THEN {below} ELSE {above} END)[1]"


def _with(prelude: str, select: str) -> str:
    return f"WITH RECURSIVE {prelude}\n{select}"


def _prevalence(taxon: str, marker: str = "") -> str:
    return f"""
    SELECT marker, dataset, {taxon} AS taxon, healthy, sick, healthy_total, sick_total,
           {_rounded("healthy / healthy_total", 3)} AS healthy_freq,
           {_rounded("sick / sick_total", 3)} AS sick_freq
    FROM (SELECT marker, dataset, {taxon},
                 count(DISTINCT sample) FILTER (status = 'healthy') AS healthy,
                 count(DISTINCT sample) FILTER (status = 'sick') AS sick
          FROM long {marker} GROUP BY ALL) JOIN totals USING (dataset)"""


REPORT = """,
hits AS (
    SELECT marker, sample_pos, sample, CAST(coalesce(sum(reads), 0) AS BIGINT) AS hits
    FROM cols LEFT JOIN cells USING (marker, sample_pos) GROUP BY ALL),
lines AS (
    SELECT marker, sample_pos, 0 AS block, NULL::BIGINT AS reads, NULL::BIGINT AS otu_pos,
           '### ' || sample AS text FROM hits
    UNION ALL SELECT marker, sample_pos, 1, NULL, NULL, '' FROM hits
    UNION ALL SELECT marker, sample_pos, 2, NULL, NULL,
                     CASE WHEN hits = 0 THEN 'no hits!' ELSE 'OTU | Info | Abundance' END FROM hits
    UNION ALL SELECT marker, sample_pos, 3, NULL, NULL, '--- | --- | ---' FROM hits WHERE hits > 0
    UNION ALL SELECT marker, sample_pos, 4, reads, otu_pos,
                     otu || ' | ' || substr(header, 1, 40) || ' | ' || reads
              FROM cells JOIN otus USING (otu) WHERE reads > 0
    UNION ALL SELECT marker, sample_pos, 5, NULL, NULL, '' FROM hits)"""

PANEL = """,
panel AS (
    SELECT CAST(CASE WHEN marker = 'ITS1' THEN 1 ELSE 3 END
                + CASE WHEN dataset = 'original' THEN 0 ELSE 1 END AS INTEGER) AS panel,
           marker, dataset, sample_pos, sample, site, diseased,
           CAST(row_number() OVER (PARTITION BY marker, dataset ORDER BY sample_pos) - 1 AS INTEGER)
               AS sample_idx
    FROM cols WHERE NOT is_control)"""

# Squarings of a matrix until its first eigenvector stands alone; 2 ** 20 is ample for a relative gap
# of one in ten thousand.
SQUARINGS = 20
COMPONENTS = 3


def _pca(name: str, source: str) -> str:
    """Leading components of every panel by repeated squaring and deflation of the Gram matrix.

    The normalised power of a positive matrix tends to v v' for its first eigenvector v. Its largest
    diagonal entry gives v with its largest element positive.
    """
    sql = f""",
{name}_v AS (
    SELECT panel, otu, sample_idx, reads::DOUBLE AS v
    FROM {source} JOIN panel USING (marker, sample_pos)),
{name}_dots AS (
    SELECT a.panel, a.sample_idx AS i, b.sample_idx AS j, sum(a.v * b.v) AS dot
    FROM {name}_v a JOIN {name}_v b ON a.panel = b.panel AND a.otu = b.otu GROUP BY ALL),
{name}_g1 AS (
    SELECT panel, list(r ORDER BY i) AS g
    FROM (SELECT a.panel, a.sample_idx AS i, list(coalesce(dot, 0.0) ORDER BY b.sample_idx) AS r
          FROM panel a JOIN panel b ON a.panel = b.panel
          LEFT JOIN {name}_dots d
              ON d.panel = a.panel AND d.i = a.sample_idx AND d.j = b.sample_idx
          GROUP BY ALL)
    GROUP BY panel)"""
    for c in range(1, COMPONENTS + 1):
        sql += f""",
{name}_p{c}(panel, step, m) AS (
    SELECT panel, 0, g FROM {name}_g{c}
    UNION ALL
    SELECT panel, step + 1, list_transform(m, lambda r: list_transform(m, lambda q:
               list_dot_product(r, q) / t))
    FROM (SELECT panel, step, m, list_sum(list_transform(m, lambda r: list_dot_product(r, r))) AS t
          FROM {name}_p{c} WHERE step < {SQUARINGS})),
{name}_e{c} AS (
    SELECT panel, list_transform(m[top], lambda x: x / sqrt(m[top][top])) AS v
    FROM (SELECT panel, m, list_position(diag, list_max(diag)) AS top
          FROM (SELECT panel, m, list_transform(m, lambda r, i: r[i]) AS diag
                FROM {name}_p{c} WHERE step = {SQUARINGS}))),
{name}_l{c} AS (
    SELECT panel, v, g, list_dot_product(v, list_transform(g, lambda r: list_dot_product(r, v))) AS eigenvalue
    FROM {name}_e{c} JOIN {name}_g1 USING (panel)),
{name}_g{c + 1} AS (
    SELECT panel, list_transform(p.g, lambda r, i: list_transform(r, lambda x, j:
               x - l.eigenvalue * l.v[i] * l.v[j])) AS g
    FROM {name}_g{c} p JOIN {name}_l{c} l USING (panel))"""
    values = " UNION ALL ".join(
        f"SELECT panel, {c} AS component, v, eigenvalue FROM {name}_l{c}"
        for c in range(1, COMPONENTS + 1)
    )
    return (
        sql
        + f""",
{name}_c AS ({values}),
{name}_energy AS (SELECT panel, sum(v * v) AS energy FROM {name}_v GROUP BY panel),
{name}_var AS (
    SELECT panel, marker, dataset, component, sqrt(eigenvalue) AS singular_value,
           eigenvalue / (n - 1) AS variance, eigenvalue / energy AS share,
           sum(eigenvalue / energy) OVER (PARTITION BY panel ORDER BY component) AS cum_share
    FROM {name}_c JOIN {name}_energy USING (panel)
         JOIN (SELECT panel, marker, dataset, count(*) AS n FROM panel GROUP BY ALL) USING (panel)),
{name}_scores AS (
    SELECT panel, marker, dataset, component, sample, sample_idx,
           v[sample_idx + 1] * sqrt(eigenvalue) AS score
    FROM {name}_c JOIN panel USING (panel))"""
    )


SELECTED = """,
selected AS (
    SELECT * FROM cells WHERE otu IN (
        SELECT otu FROM otus JOIN genus_info USING (genus) WHERE description = 'fungus'))"""

EXCLUDED = """,
excluded AS (
    SELECT * FROM cells WHERE otu IN (
        SELECT otu FROM otus JOIN genus_info USING (genus)
        WHERE coalesce(description NOT IN ('coral', 'sponge', 'millepora', 'anemone'), true)))"""

_ALL = CELLS + PANEL + _pca("a", "cells")
_SELECTED = CELLS + SELECTED + PANEL + _pca("s", "selected")
_EXCLUDED = CELLS + EXCLUDED + PANEL + _pca("e", "excluded")


def _variance(name: str) -> str:
    return f"""
    SELECT marker, dataset, CAST(component AS INTEGER) AS component,
           round(singular_value, 4) AS singular_value, round(variance, 3) AS variance,
           round(share, 7) AS share, round(cum_share, 7) AS cum_share FROM {name}_var"""


def _scores(name: str) -> str:
    return f"""
    SELECT marker, dataset, CAST(component AS INTEGER) AS component, sample,
           round(score, 4) + 0.0 AS score FROM {name}_scores"""


def _points(name: str, third: str) -> str:
    return f"""
    SELECT panel, marker, dataset, sample, individual, site, diseased,
           CASE diseased WHEN '-' THEN 'unlabeled' WHEN '0' THEN 'healthy' ELSE 'sick' END AS label,
           round(px.score, 4) + 0.0 AS x, round(py.score, 4) + 0.0 AS y
    FROM (SELECT *, CASE WHEN dataset = 'original'
                         THEN substr(sample, 1, greatest(length(sample) - 2, 0)) END AS individual,
                 {third} AS second
          FROM panel)
    JOIN (SELECT panel, sample_idx, score FROM {name}_scores WHERE component = 1) px
         USING (panel, sample_idx)
    JOIN (SELECT panel, sample_idx, component, score FROM {name}_scores) py
         USING (panel, sample_idx)
    WHERE py.component = second"""


def _captions(name: str, second: str) -> str:
    return f"""
    SELECT panel, marker, dataset, captured,
           'PCA for ' || marker || ' & ' || dataset || ' data' || chr(10)
               || regexp_replace(CAST(captured AS VARCHAR), '\\.0$', '')
               || ' % of total variation captured' AS caption
    FROM (SELECT panel, marker, dataset, {_rounded("sum(share) * 100", 2)} AS captured
          FROM {name}_var WHERE component IN (1, {second}) GROUP BY ALL)"""


PC3_ON_PANEL_3 = "CASE WHEN panel = 3 THEN 3 ELSE 2 END"
OVERVIEW_TABLE = """CASE WHEN marker = 'ITS1' AND dataset = 'original' THEN 'ITS1_orig'
                WHEN marker = 'ITS2' AND dataset = 'original' THEN 'ITS2_orig'
                WHEN marker = 'ITS1' THEN 'ITS1_extra' ELSE 'ITS2_extra' END AS "table\""""

SQL = {
    "sample_dimension": _with(SHEETS, "SELECT pos, site, diseased, sample, dataset, status, is_control FROM samples"),
    "blank_numbering": _with(SHEETS, "SELECT * FROM numbered"),
    "sheet_names": _with(SHEETS, "SELECT * FROM names"),
    "cohort_totals": _with(
        SHEETS,
        "SELECT dataset, diseased, status, count(*) AS total_samples FROM samples GROUP BY ALL",
    ),
    "unpivot_long": _with(
        CELLS,
        """
    SELECT marker, otu, sample_pos, sample, coalesce(reads, 0) AS reads
    FROM (SELECT DISTINCT marker, otu FROM cells) JOIN names USING (marker)
         LEFT JOIN cells USING (marker, otu, sample_pos)""",
    ),
    "long_filtered": _with(
        CELLS,
        """
    SELECT marker, otu, otu_pos, header, sample, reads, diseased, dataset, status FROM long""",
    ),
    "occurrences_genus": _with(
        CELLS,
        """
    SELECT marker, sample, genus AS taxon, otu,
           row_number() OVER (PARTITION BY marker, sample, genus ORDER BY otu_pos) AS occurrence
    FROM long""",
    ),
    "occurrences_species": _with(
        CELLS,
        """
    SELECT marker, sample, species AS taxon, otu,
           row_number() OVER (PARTITION BY marker, sample, species ORDER BY otu_pos) AS occurrence
    FROM long""",
    ),
    "first_occurrences": _with(
        CELLS,
        """
    SELECT marker, sample, dataset, status, genus AS taxon, otu, otu_pos, reads
    FROM (SELECT *, row_number() OVER (PARTITION BY marker, sample, genus ORDER BY otu_pos) AS o
          FROM long) WHERE o = 1""",
    ),
    "presence_genus": _with(
        CELLS, "SELECT DISTINCT marker, sample, dataset, status, genus AS taxon FROM long"
    ),
    "presence_species": _with(
        CELLS, "SELECT DISTINCT marker, sample, dataset, status, species AS taxon FROM long"
    ),
    "prevalence_genus": _with(CELLS + TOTALS, _prevalence("genus")),
    "prevalence_species": _with(CELLS + TOTALS, _prevalence("species")),
    "prevalence_otu": _with(
        CELLS + TOTALS,
        f"""
    SELECT p.* EXCLUDE (taxon), p.taxon AS otu, header
    FROM ({_prevalence("otu", "WHERE marker = 'ITS1'")}) p JOIN otus ON p.taxon = otus.otu""",
    ),
    "overview_tables": _with(
        CELLS + TOTALS, f"SELECT * EXCLUDE (marker, dataset), {OVERVIEW_TABLE} FROM ({_prevalence('species')})"
    ),
    "overview_tables_otu": _with(
        CELLS + TOTALS,
        f"""
    SELECT p.* EXCLUDE (taxon, marker, dataset), p.taxon AS otu, header, dataset AS "table"
    FROM ({_prevalence("otu", "WHERE marker = 'ITS1'")}) p JOIN otus ON p.taxon = otus.otu""",
    ),
    "sample_hits": _with(CELLS + REPORT, "SELECT * FROM hits"),
    "sample_ranked": _with(
        CELLS,
        """
    SELECT marker, sample_pos, sample, otu, reads,
           row_number() OVER (PARTITION BY marker, sample_pos ORDER BY reads DESC, otu) AS rank
    FROM cells JOIN names USING (marker, sample_pos) WHERE reads > 0""",
    ),
    "sample_report_lines": _with(CELLS + REPORT, "SELECT * FROM lines"),
    "report_files": _with(
        CELLS + REPORT,
        """
    SELECT marker, text, row_number() OVER (
               PARTITION BY marker ORDER BY sample_pos, block, reads DESC, otu_pos) AS line
    FROM lines""",
    ),
    "sheets_long": _with(
        CELLS,
        """
    SELECT marker, otu, dense_rank() OVER (PARTITION BY marker ORDER BY otu) AS otu_pos, header,
           sample, reads, diseased, dataset, status
    FROM (SELECT marker, otu, header, sample, reads, diseased, dataset, status
          FROM cells JOIN cols USING (marker, sample_pos) JOIN otus USING (otu))
    QUALIFY diseased <> '-' AND reads > 1""",
    ),
    "sheets_repeated_headers": _with(
        CELLS,
        """
    SELECT marker, sample_pos, sample, CAST(coalesce(sum(reads), 0) AS BIGINT) AS reads
    FROM names LEFT JOIN cells USING (marker, sample_pos) WHERE marker = 'ITS2' GROUP BY ALL""",
    ),
    "sheets_selected_otus": _with(
        CELLS,
        """
    SELECT marker, otu, otu_pos, header, genus
    FROM (SELECT * EXCLUDE (otu_pos), row_number() OVER (PARTITION BY marker ORDER BY otu) AS otu_pos
          FROM (SELECT DISTINCT marker, otu FROM cells) JOIN otus o USING (otu))
         JOIN genus_info USING (genus)
    WHERE description = 'fungus'""",
    ),
    "panel_samples": _with(
        SHEETS + PANEL, "SELECT panel, marker, dataset, sample_pos, sample_idx, sample FROM panel"
    ),
    "panel_matrix": _with(
        CELLS + PANEL,
        """
    SELECT panel, sample, 'OTU_' || otu AS label, reads
    FROM cells JOIN panel USING (marker, sample_pos) WHERE reads <> 0""",
    ),
    "genus_include": _with(
        CELLS,
        """
    SELECT otu, otu_pos, header, genus FROM otus
    WHERE genus IN (SELECT genus FROM genus_info WHERE description = 'fungus')""",
    ),
    "genus_exclude": _with(
        CELLS,
        """
    SELECT otu, otu_pos, header, genus FROM otus
    WHERE genus NOT IN (SELECT genus FROM genus_info
                        WHERE description IN ('coral', 'sponge', 'millepora', 'anemone'))""",
    ),
    "sample_gram": _with(
        CELLS + PANEL,
        """
    SELECT panel, i, j, sum(dot) AS dot
    FROM (SELECT a.panel, a.sample_idx AS i, b.sample_idx AS j, x.reads::DOUBLE * y.reads AS dot
          FROM cells x JOIN panel a USING (marker, sample_pos)
               JOIN cells y ON x.marker = y.marker AND x.otu = y.otu
               JOIN panel b ON b.marker = y.marker AND b.sample_pos = y.sample_pos
          WHERE a.panel = b.panel AND a.sample_idx <= b.sample_idx
          UNION ALL SELECT panel, sample_idx, sample_idx, 0.0 FROM panel)
    GROUP BY ALL""",
    ),
    "pca_energy": _with(
        CELLS + PANEL,
        """
    SELECT marker, dataset, CAST(sum(reads * reads) AS BIGINT) AS energy
    FROM cells JOIN panel USING (marker, sample_pos) GROUP BY ALL""",
    ),
    "pca_sample_energy": _with(
        CELLS + PANEL,
        """
    SELECT marker, dataset, sample, CAST(coalesce(sum(reads * reads), 0) AS BIGINT) AS energy
    FROM panel LEFT JOIN cells USING (marker, sample_pos) GROUP BY ALL""",
    ),
    "pca_variance": _with(_ALL, _variance("a")),
    "pca_scores": _with(_ALL, _scores("a")),
    "pca_selected_variance": _with(_SELECTED, _variance("s")),
    "pca_selected_scores": _with(_SELECTED, _scores("s")),
    "plot_points": _with(_ALL, _points("a", PC3_ON_PANEL_3)),
    "plot_points_selected": _with(_SELECTED, _points("s", "2")),
    "panel_captions": _with(_ALL, _captions("a", PC3_ON_PANEL_3)),
    "panel_captions_selected": _with(_SELECTED, _captions("s", "2")),
}
SQL["landed_prevalence_genus"] = SQL["prevalence_genus"]
SQL["landed_gram"] = SQL["sample_gram"]
SQL["landed_pca_scores"] = SQL["sheets_pca_scores"] = SQL["pca_scores"]
SQL["landed_pca_selected_scores"] = SQL["pca_selected_scores"]
SQL["pca_excluded_scores"] = _with(_EXCLUDED, _scores("e"))
SQL["sheets_parquet_long"] = SQL["sheets_long"]
SQL["sheets_wide_range"] = _with(
    CELLS,
    """
    SELECT CAST(p + shift AS INTEGER) AS sample_pos, CAST(coalesce(sum(reads), 0) AS BIGINT) AS reads
    FROM (SELECT unnest(range(1, 126)) AS p) CROSS JOIN (SELECT unnest([0, 125]) AS shift)
         LEFT JOIN cells ON cells.sample_pos = p AND marker = 'ITS1' GROUP BY ALL""",
)
SQL["overview_tables_genus"] = _with(
    CELLS + TOTALS, f"SELECT * EXCLUDE (marker, dataset), {OVERVIEW_TABLE} FROM ({_prevalence('genus')})"
)
