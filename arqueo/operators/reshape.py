"""Wide months to long rows, and period sums over the wide months."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arqueo.functions.numeric import quoted, row_sum
from arqueo.schema import (
    CANONICAL_GROUP, COLLECTED, CONTRACT, GROUP, IDENTIFIERS, MAPPING_METHOD, MAPPING_STATUS,
    MEASURES, MONTHS, YEAR, month_columns, require_columns,
)
from arqueo.session import compiled_methods

LONG_KEYS = [*IDENTIFIERS, CANONICAL_GROUP, MAPPING_STATUS, MAPPING_METHOD, "source_file", "source_row"]


def build_presupuesto_monthly(
    budget: DataFrame, *, drop_empty: bool = True, keep: list[str] | None = None,
) -> DataFrame:
    """One row per account and month with the four measures.

    Empty months are filtered right behind the explode, in the same generated code (a filter
    inside the array would be an interpreted lambda). ``keep`` narrows the identifier columns.
    """
    require_columns(budget, CONTRACT, "expand months")
    def cell(number: int, month: str) -> str:
        measures = ", ".join(f"{quoted(f'{m} {month}')} AS {quoted(m)}" for m in MEASURES)
        return f"struct({number}L AS mes_numero, '{month}' AS mes, {measures})"

    months = F.expr("array(" + ", ".join(cell(n, m) for n, m in enumerate(MONTHS, start=1)) + ")")
    long = compiled_methods(budget).select(*(keep or LONG_KEYS), F.explode(months).alias("_m"))
    if drop_empty:
        long = long.filter(F.coalesce(*[F.col("_m")[x] for x in MEASURES]).isNotNull())
    return (
        long.select(
            *(keep or LONG_KEYS), "_m.mes_numero", "_m.mes",
            F.make_date(F.col(YEAR).cast("int"), F.col("_m.mes_numero").cast("int"), F.lit(1)).alias("fecha"),
            *[F.col("_m")[m].alias(m) for m in MEASURES],
        )
    )


def period_amounts(months_per_period: int, measure: str = COLLECTED) -> list[Column]:
    """Per period of the year, the sum of its months (a period without values is 0)."""
    columns = month_columns(measure)
    return [
        F.coalesce(row_sum(columns[i:i + months_per_period]), F.lit(0.0))
        for i in range(0, len(MONTHS), months_per_period)
    ]


def last_active_month(measure: str = COLLECTED) -> Column:
    """Number of the last month with an amount other than 0; null when there is none."""
    numbered = reversed(list(enumerate(month_columns(measure), start=1)))
    return F.expr("CASE " + " ".join(f"WHEN {quoted(c)} <> 0 THEN {n}" for n, c in numbered) + " END")


def monthly_group_histogram(classified: DataFrame, exclude: tuple[str, ...] = ("IPP",)) -> DataFrame:
    """Monthly collected amount per income group, some groups left out."""
    sums = [F.sum(F.col(f"{COLLECTED} {m}").cast("decimal(18,2)")).alias(m) for m in MONTHS]
    wide = classified.filter(~F.col(GROUP).isin(*exclude)).groupBy(GROUP).agg(*sums)
    cells = F.array(*[
        F.struct(F.lit(n).cast("bigint").alias("mes_numero"), F.lit(m).alias("mes"),
                 F.coalesce(F.col(m).cast("double"), F.lit(0.0)).alias("ingreso"))
        for n, m in enumerate(MONTHS, start=1)
    ])
    return wide.select(GROUP, F.inline(cells))
