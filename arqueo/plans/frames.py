"""Chart-ready tables: what is behind each figure, with positions, labels and axis limits.

Every frame is keyed by municipality, so one call serves all of them; a figure of one
municipality is a filter. Axis limits and positions are computed on the reduced histories.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arqueo.functions.text import millions_label, wrapped
from arqueo.operators.clusters import ClusterAnalysis
from arqueo.operators.geography import join_municipality_geography
from arqueo.operators.history import ANNUAL, Periods
from arqueo.operators.profiles import SHARES, TOTAL, share_column, share_order
from arqueo.operators.ranking import spread_row_number
from arqueo.operators.staging import broadcast_if_small, checked_join, literal_rows
from arqueo.operators.variability import REMAINDER
from arqueo.schema import CODE, GROUP, INCOME_GROUPS, NAME, YEAR, ContractError, check_group_sequence, require_columns

BILLION = 1e9
COMPONENT_COLORS = 6


def group_position(group_order=INCOME_GROUPS) -> Column:
    groups = check_group_sequence(group_order, parameter="group_order", require_all=True)
    return (F.array_position(F.array(*[F.lit(g) for g in groups]), F.col(GROUP)) - 1).cast("bigint")


def one_municipality(history: DataFrame) -> str:
    """The single municipality of a history; none or several is an error."""
    names = [r[0] for r in history.select(NAME).dropna().distinct().take(2)]
    if len(names) != 1:
        raise ContractError("a figure needs the history of exactly one municipality")
    return names[0]


def share_axis_maximum(largest: Column) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(10.0), F.ceil(largest * 1.1 / 10) * 10.0))


def _who(rows: DataFrame) -> str:
    """What tells municipalities apart: the code, since two may share a name; without codes, the name."""
    return CODE if CODE in rows.columns else NAME


def _slots(history: DataFrame, keys: list[str]) -> DataFrame:
    """Dense position of each year or period inside its municipality (bounded by the calendar)."""
    place = Window.partitionBy(_who(history)).orderBy(*keys)
    return history.withColumn("posicion", (F.dense_rank().over(place) - 1).cast("bigint"))


def _period_keys(periods: Periods) -> list[str]:
    return [YEAR] if periods is ANNUAL else [YEAR, periods.column]


def _tick(periods: Periods) -> Column:
    if periods is ANNUAL:
        return F.col(YEAR).cast("string")
    return F.concat(F.lit(periods.prefix), F.col(periods.column).cast("string"), F.lit("<br>"), F.col(YEAR).cast("string"))


def share_frame(history: DataFrame, periods: Periods = ANNUAL, group_order=INCOME_GROUPS) -> DataFrame:
    """Shares by position and group, with the top of the axis of each municipality."""
    require_columns(history, [NAME, GROUP, "porcentaje_ingreso", *_period_keys(periods)], "chart shares")
    whole = Window.partitionBy(_who(history))
    extra = [millions_label(F.col("total_anual")).alias("etiqueta_total")] if periods is ANNUAL else []
    return _slots(history, _period_keys(periods)).select(
        NAME, *_period_keys(periods), "posicion", _tick(periods).alias("etiqueta"), GROUP,
        group_position(group_order).alias("orden_grupo"), "porcentaje_ingreso", *extra,
        share_axis_maximum(F.max("porcentaje_ingreso").over(whole)).alias("eje_maximo"),
    )


def amount_frame(history: DataFrame, periods: Periods, group_order=INCOME_GROUPS) -> DataFrame:
    """Amounts in thousands of millions with padded axis limits that include 0."""
    require_columns(history, [NAME, GROUP, periods.amount, *_period_keys(periods)], "chart amounts")
    whole = Window.partitionBy(_who(history))
    amount = F.col("monto_mil_mm")
    low, high = F.min(amount).over(whole), F.max(amount).over(whole)
    padded = F.greatest((high - low) * 0.08, F.greatest(F.abs(low), F.abs(high)) * 0.02, F.lit(0.1))
    return (
        _slots(history, _period_keys(periods)).withColumn("monto_mil_mm", F.col(periods.amount) / BILLION)
        .select(
            NAME, *_period_keys(periods), "posicion", _tick(periods).alias("etiqueta"), GROUP,
            group_position(group_order).alias("orden_grupo"), "monto_mil_mm",
            F.least(F.lit(0.0), low - padded).alias("eje_minimo"), F.greatest(F.lit(0.0), high + padded).alias("eje_maximo"),
        )
    )


def annual_amount_frame(history: DataFrame) -> DataFrame:
    """Stacked annual amounts: total label above each bar and the top of the axis."""
    whole = Window.partitionBy(_who(history))
    largest = F.max(F.col("total_anual") / BILLION).over(whole)
    offset = F.when(largest == 0, 0.1).otherwise(largest * 0.02)
    return _slots(history, [YEAR]).select(
        NAME, YEAR, "posicion", GROUP, group_position().alias("orden_grupo"),
        (F.col("ingreso_anual") / BILLION).alias("monto_mil_mm"),
        (F.col("total_anual") / BILLION).alias("total_mil_mm"),
        millions_label(F.col("total_anual")).alias("etiqueta_total"),
        (F.col("total_anual") / BILLION + offset).alias("etiqueta_y"),
        F.when(largest == 0, 1.0).otherwise(largest * 1.12).alias("eje_maximo"),
    )


def color_index(rank: Column, remainder: Column) -> Column:
    """Palette position of a component; -1 for the remainder."""
    return F.when(remainder, -1).otherwise((rank - 1) % COMPONENT_COLORS).cast("bigint")


def breakdown_frame(breakdown: DataFrame) -> DataFrame:
    """Component bars and the period total of the overlay line."""
    remainder = F.col("componente") == REMAINDER
    return _slots(breakdown, [YEAR, "Semestre"]).select(
        NAME, YEAR, "Semestre", "posicion",
        F.concat(F.lit("S"), F.col("Semestre").cast("string"), F.lit("<br>"), F.col(YEAR).cast("string")).alias("etiqueta"),
        "componente", wrapped(F.col("componente")).alias("leyenda"), "orden_componente",
        color_index(F.col("orden_componente"), remainder).alias("color"),
        (F.col("ingreso_semestral") / BILLION).alias("monto_mil_mm"),
        F.coalesce("participacion_otros_ingresos", F.lit(0.0)).alias("participacion"),
        (F.col("total_otros_ingresos") / BILLION).alias("total_mil_mm"),
    )


def variability_frame(ranking: DataFrame, top_n: int = 6) -> DataFrame:
    if top_n < 1:
        raise ContractError("top_n must be at least 1")
    return ranking.filter(F.col("ranking_variabilidad") <= top_n).select(
        NAME, "ranking_variabilidad", "codigo_cuenta", "cuenta", wrapped(F.col("cuenta"), 44).alias("etiqueta"),
        color_index(F.col("ranking_variabilidad"), F.lit(False)).alias("color"),
        (F.col("variacion_promedio_abs_s1_s2") / BILLION).alias("variacion_mil_mm"),
        (F.col("diferencia_promedio_s1_s2") / BILLION).alias("diferencia_mil_mm"),
        F.col("participacion_variabilidad").alias("participacion"),
    )


def variability_summary(ranking: DataFrame) -> DataFrame:
    """The selected accounts as a small report table, rounded half to even."""
    return ranking.filter("seleccionada").select(
        NAME, F.col("ranking_variabilidad").alias("Ranking"), F.col("codigo_cuenta").alias("Código"),
        F.col("cuenta").alias("Cuenta"),
        F.bround(F.col("variacion_promedio_abs_s1_s2") / BILLION, 3).alias("Promedio |S1-S2| (mil MM)"),
        F.bround(F.col("diferencia_promedio_s1_s2") / BILLION, 3).alias("Promedio S1-S2 (mil MM)"),
        F.bround(F.col("participacion_variabilidad"), 1).alias("% de variabilidad"),
    )


def _group_cells(columns: list[tuple[str, Column]]) -> Column:
    return F.inline(F.array(*[
        F.struct(F.lit(g).alias(GROUP), F.lit(i).cast("bigint").alias("orden_grupo"), *[c(g).alias(n) for n, c in columns])
        for i, g in enumerate(INCOME_GROUPS)
    ]))


def composition_frame(profile: DataFrame, sort_priority=None, ascending: bool = False) -> DataFrame:
    """Shares of every municipality by group, with its place in the chosen order."""
    placed = spread_row_number(profile, [], share_order(sort_priority, ascending), "orden_municipio")
    return placed.select(NAME, "orden_municipio", _group_cells([
        ("porcentaje", lambda g: F.col(share_column(g))), ("monto_mil_mm", lambda g: F.col(g) / BILLION),
    ]))


def municipality_amount_frame(profile: DataFrame, ascending: bool = False) -> DataFrame:
    """Amounts of every municipality by group, ordered by total."""
    total = F.col(TOTAL)
    order = [total.asc() if ascending else total.desc(), F.col(NAME).asc()]
    placed = spread_row_number(profile, [], order, "orden_municipio")
    return placed.select(NAME, "orden_municipio", _group_cells([("monto_mil_mm", lambda g: F.col(g) / BILLION)]))


MAP_METRICS = {"total": "ingreso_total_mil_mm_clp", "no_ip": "ingreso_no_ip_mil_mm_clp"}


def shared_log_scale(map_data: DataFrame) -> tuple[tuple[float, float], list[float]]:
    """(log10 range, ticks of the 1-2-5 series) common to both metrics; four numbers from Spark."""
    require_columns(map_data, MAP_METRICS.values(), "build the common scale")
    columns = [F.col(c) for c in MAP_METRICS.values()]
    odd = [c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")) | (c <= 0) for c in columns]
    found = map_data.agg(
        F.min(F.least(*columns)).alias("low"), F.max(F.greatest(*columns)).alias("high"),
        F.count(F.when(odd[0] | odd[1], 1)).alias("odd"),
    ).head()
    if found.odd or found.low is None:
        raise ContractError("a logarithmic map needs finite positive values")
    exponents = range(math.floor(math.log10(found.low)) - 1, math.ceil(math.log10(found.high)) + 2)
    series = sorted(f * 10.0 ** e for e in exponents for f in (1, 2, 5))
    first = max(v for v in series if v <= found.low)
    last = min(v for v in series if v >= found.high)
    return (math.log10(first), math.log10(last)), [v for v in series if first <= v <= last]


def log_scale_frame(map_data: DataFrame) -> DataFrame:
    (low, high), ticks = shared_log_scale(map_data)
    rows = [(low, high, t, math.log10(t), f"{t:g}") for t in ticks]
    return literal_rows(
        map_data.sparkSession, rows, "rango_minimo double, rango_maximo double, marca double, marca_log double, texto string"
    )


def choropleth_frame(map_data: DataFrame, metric: str) -> DataFrame:
    if metric not in MAP_METRICS:
        raise ContractError("metric must be 'total' or 'no_ip'")
    return map_data.select(
        "CUT_COM", NAME, F.log10(MAP_METRICS[metric]).alias("valor_log"), *MAP_METRICS.values(), "porcentaje_no_ip"
    )


# --- Fixed values: score names and which way is better ---
SCORE_DIRECTION = {
    "Silhouette": "Mayor es mejor", "Calinski-Harabasz": "Mayor es mejor", "Davies-Bouldin": "Menor es mejor",
}
# --- end of fixed values ---


def validation_frame(analysis: ClusterAnalysis) -> DataFrame:
    """One row per candidate count and score; the silhouette rows are the selection figure."""
    scores = analysis.cluster_validation_scores
    cells = F.inline(F.array(*[
        F.struct(F.lit(n).alias("criterio"), F.lit(d).alias("direccion"), F.col(f"`{n}`").alias("valor"))
        for n, d in SCORE_DIRECTION.items()
    ]))
    chosen = (F.col("Número de clústeres") == analysis.selected_cluster_count).alias("seleccionado")
    return scores.select("Número de clústeres", chosen, cells)


def selection_frame(analysis: ClusterAnalysis) -> DataFrame:
    return validation_frame(analysis).filter("criterio = 'Silhouette'")


def silhouette_frame(analysis: ClusterAnalysis) -> DataFrame:
    order = [F.col("cluster_id").asc(), F.col("Silhouette").asc(), F.col(NAME).asc()]
    return spread_row_number(analysis.assignments, [], order, "orden").select(
        NAME, "cluster_id", "Clúster", "Silhouette", "Ingreso total (mil MM CLP)", "orden"
    )


def pca_frame(analysis: ClusterAnalysis) -> DataFrame:
    first, second = analysis.pca_explained_variance_ratio
    return analysis.assignments.select(
        NAME, "Clúster", "CP1", "CP2", "Silhouette", "Ingreso total (mil MM CLP)",
        F.lit(first).alias("varianza_cp1"), F.lit(second).alias("varianza_cp2"),
    )


def heatmap_frame(analysis: ClusterAnalysis) -> DataFrame:
    """Shares in tree order with cluster label and the largest share."""
    placed = (
        analysis.profile.join(analysis.ordered_municipalities.withColumnRenamed("orden", "orden_municipio"), NAME)
        .join(analysis.assignments.select(NAME, "Clúster"), NAME)
    )
    largest = analysis.profile.agg(F.max(F.greatest(*[F.col(f"`{s}`") for s in SHARES])).alias("m")).head().m
    return placed.select(
        NAME, "orden_municipio", "Clúster", _group_cells([("porcentaje", lambda g: F.col(f"`{share_column(g)}`"))]),
        F.lit(largest).alias("maximo"),
    )


def merge_frame(analysis: ClusterAnalysis) -> DataFrame:
    """Tree links: the smaller and the larger representative, height and members."""
    names = analysis.ids.select("id", NAME)
    low, high = names.withColumnsRenamed({"id": "lo", NAME: "izquierda"}), names.withColumnsRenamed({"id": "hi", NAME: "derecha"})
    return analysis.linkage.join(low, "lo").join(high, "hi").select("izquierda", "derecha", "height", "size", "step")


def cluster_profile_frame(summary: DataFrame) -> DataFrame:
    return summary.select("cluster_id", "Clúster", "Número de comunas", _group_cells([("porcentaje", lambda g: F.col(g))]))


def cluster_map_frame(analysis: ClusterAnalysis, geography: DataFrame) -> DataFrame:
    """Assignments with shares on the map."""
    shares = analysis.profile.select(NAME, *[F.col(f"`{share_column(g)}`").alias(g) for g in INCOME_GROUPS])
    joined = checked_join(analysis.assignments, shares, NAME, "left", "one_to_one")
    return join_municipality_geography(joined, geography).select(
        "CUT_COM", NAME, "cluster_id", "Clúster", "Ingreso total (mil MM CLP)", *INCOME_GROUPS
    )
