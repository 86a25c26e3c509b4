"""Year coverage and dense composition histories, all municipalities in one job.

The fact rows are read once and reduced to (municipality, year, group) sums with partial
aggregation, so a municipality that holds a large part of the rows costs no more than
another. That cube is staged: coverage, the grid and the values all read it.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from arqueo.functions.numeric import exact_sum, share
from arqueo.operators.classify import classified_income, municipal_income
from arqueo.operators.reshape import last_active_month, period_amounts
from arqueo.operators.scope import Entity, entity_names, resolve_codes, resolve_municipality, rows_of_codes
from arqueo.operators.staging import broadcast_if_small, stage
from arqueo.schema import (
    CODE, COLLECTED, COLLECTED_TOTAL, GROUP, INCOME_GROUPS, MONTHS, NAME, SERVICE_NAME, SUBASSIGNMENT,
    SUBTITLE, TYPE_CODE, YEAR, ContractError, month_columns, require_columns,
)


@dataclass(frozen=True)
class Periods:
    """How the twelve months are cut, and the column names of the result."""

    months: int
    column: str
    prefix: str
    amount: str
    total: str

    @property
    def count(self) -> int:
        return len(MONTHS) // self.months


QUARTERS = Periods(3, "Trimestre", "T", "ingreso_trimestral", "total_trimestral")
FOUR_MONTHS = Periods(4, "Cuatrimestre", "C", "ingreso_cuatrimestral", "total_cuatrimestral")
SEMESTERS = Periods(6, "Semestre", "S", "ingreso_semestral", "total_semestral")
ANNUAL = Periods(12, "_periodo", "", "ingreso_anual", "total_anual")

COVERAGE_KEYS = ("last_reported_month", "last_reported_month_number", "year_status", "is_complete")


def coverage_columns(last: Column) -> dict[str, Column]:
    """Coverage of a year told by its last active month."""
    names = F.array(*[F.lit(m) for m in MONTHS])
    return {
        "last_reported_month": F.when(last.isNotNull(), F.try_element_at(names, last.cast("int"))),
        "last_reported_month_number": last.cast("bigint"),
        "year_status": F.when(last.isNull(), "unknown").when(last == 12, "complete").otherwise("partial"),
        "is_complete": F.when(last.isNotNull(), last == 12),
    }


def infer_year_coverage(budget: DataFrame, by: Collection[str] = ()) -> DataFrame:
    """One row per year (per ``by`` key too): last month with collected income, and status.

    Only the last active month counts; a year without activity stays, as ``unknown``. So are
    all years of a table that lacks a month column.
    """
    require_columns(budget, [YEAR, TYPE_CODE, SERVICE_NAME], "infer coverage")
    last = (
        budget.filter(municipal_income(budget.columns) & F.col(YEAR).isNotNull())
        .groupBy(*by, YEAR).agg(F.max(_last_month(budget)).alias("_last"))
    )
    return last.select(*by, YEAR, *[c.alias(n) for n, c in coverage_columns(F.col("_last")).items()])


def _last_month(budget: DataFrame) -> Column:
    months = set(month_columns(COLLECTED)) <= set(budget.columns)
    return last_active_month() if months else F.lit(None).cast("int")


def in_years(start_year: int | None, exclude_years: Collection[int] = ()) -> Column:
    """The part of ``choose_years`` that is known before anything is read."""
    excluded = sorted({int(y) for y in exclude_years or ()})
    wanted = F.lit(True) if start_year is None else F.col(YEAR) >= int(start_year)
    return wanted & ~F.col(YEAR).isin(*excluded) if excluded else wanted


def choose_years(
    coverage: list[Row], complete_years_only: bool = True, start_year: int | None = None,
    exclude_years: Collection[int] = (),
) -> list[Row]:
    """Coverage rows of the years to use; none left is an error. Years are a bounded domain."""
    excluded = {int(y) for y in exclude_years or ()}
    chosen = sorted(
        (
            r for r in coverage
            if (not complete_years_only or r["year_status"] == "complete")
            and (start_year is None or r[YEAR] >= int(start_year))
            and r[YEAR] not in excluded
        ),
        key=lambda r: r[YEAR],
    )
    if not chosen:
        raise ContractError("no years left after coverage, start year and exclusions")
    return chosen


def year_cells(years: list[Row]) -> Column:
    """The chosen years and their coverage as one constant array of structs."""
    return F.array(*[
        F.struct(
            F.lit(r[YEAR]).cast("bigint").alias(YEAR),
            F.lit(r["last_reported_month"]).cast("string").alias("last_reported_month"),
            F.lit(r["year_status"]).alias("year_status"),
            F.lit(r["is_complete"]).cast("boolean").alias("is_complete"),
        )
        for r in years
    ])


def group_cube(budget: DataFrame, periods: Periods) -> DataFrame:
    """(municipality, year, group): decimal sum per period, and the last active month."""
    if periods is ANNUAL:
        needed, amounts = [COLLECTED_TOTAL], [F.col(COLLECTED_TOTAL)]
    else:
        needed, amounts = month_columns(COLLECTED), period_amounts(periods.months)
    require_columns(budget, [CODE, SUBTITLE, SUBASSIGNMENT, *needed], "build the income history")
    last = _last_month(budget)
    return (
        classified_income(budget).filter(F.col(YEAR).isNotNull())
        .groupBy(CODE, YEAR, GROUP)
        .agg(
            *[F.coalesce(exact_sum(a), F.lit(0)).alias(f"_p{i}") for i, a in enumerate(amounts, start=1)],
            F.max(last).alias("_last"),
        )
    )


def _dense(cube: DataFrame, periods: Periods, years: list[Row]) -> DataFrame:
    """Every chosen year and group of every municipality, with its period amounts or null.

    Cells of one municipality are bounded (years x groups), so they travel as a map and the
    grid is built from constants inside one array: no cross product and no join.
    """
    slots = [f"_p{i}" for i in range(1, periods.count + 1)]
    cell = F.struct(F.struct(YEAR, GROUP), F.array(*slots))
    packed = cube.filter(F.col(CODE).isNotNull()).groupBy(CODE).agg(
        F.map_from_entries(F.collect_list(cell)).alias("_cells")
    )
    groups = F.array(*[F.lit(g) for g in INCOME_GROUPS])

    def of_year(y: Column) -> Column:
        return F.transform(groups, lambda g: F.struct(
            *[y[c].alias(c) for c in (YEAR, "last_reported_month", "year_status", "is_complete")],
            g.alias(GROUP),
            F.try_element_at("_cells", F.struct(y[YEAR].alias(YEAR), g.alias(GROUP))).alias("_amounts"),
        ))

    cells = packed.select(CODE, F.inline(F.flatten(F.transform(year_cells(years), of_year))))
    return _with_shares(cells, periods)


def _with_shares(cells: DataFrame, periods: Periods) -> DataFrame:
    """Explode the periods and add total and share of each (municipality, year, period).

    The rows are already hash-partitioned by municipality, which is enough for the window:
    it adds a sort of five-row groups but no shuffle.
    """
    period = F.explode(F.sequence(F.lit(1), F.lit(periods.count)))
    whole = Window.partitionBy(CODE, YEAR, periods.column)
    zero = F.lit(0).cast("decimal(28,2)")
    amount = F.coalesce(F.try_element_at("_amounts", F.col(periods.column)), zero)
    return (
        cells.select("*", period.alias(periods.column))
        .withColumn("_amount", amount)
        .withColumn("_total", F.sum("_amount").over(whole))
        .withColumns({
            periods.amount: F.col("_amount").cast("double"),
            periods.total: F.col("_total").cast("double"),
            "porcentaje_ingreso": share(F.col("_amount"), F.col("_total"), when_zero=0.0),
        })
    )


def _finish(rows: DataFrame, periods: Periods) -> DataFrame:
    label = F.concat(
        F.col(YEAR).cast("string"), F.lit(f" {periods.prefix}"), F.col(periods.column).cast("string")
    )
    period = [] if periods is ANNUAL else [
        F.col(periods.column).cast("bigint").alias(periods.column), label.alias("Periodo")
    ]
    return rows.select(
        CODE, NAME, YEAR, *period, GROUP, periods.amount, "porcentaje_ingreso", periods.total,
        "last_reported_month", "year_status", "is_complete",
    )


def _named(rows: DataFrame, budget: DataFrame, names: DataFrame | None) -> DataFrame:
    """A municipality without a name keeps its rows."""
    known = stage(entity_names(budget)) if names is None else names.select(CODE, NAME)
    return rows.join(broadcast_if_small(known), CODE, "left")


def income_history(
    budget: DataFrame, *, periods: Periods = ANNUAL, complete_years_only: bool = True,
    start_year: int | None = None, exclude_years: Collection[int] = (), names: DataFrame | None = None,
) -> DataFrame:
    """Dense history of every municipality, with coverage told by all of them together.

    ``names`` (code, name) spares the pass that looks up the latest name of each code.
    """
    cube = stage(group_cube(budget.filter(in_years(start_year, exclude_years)), periods))
    last = cube.groupBy(YEAR).agg(F.max("_last").alias("_last"))
    coverage = last.select(YEAR, *[c.alias(n) for n, c in coverage_columns(F.col("_last")).items()])
    years = choose_years(coverage.collect(), complete_years_only, start_year, exclude_years)
    return _finish(_named(_dense(cube, periods, years), budget, names), periods)


def income_history_per_entity(
    budget: DataFrame, *, periods: Periods = ANNUAL, complete_years_only: bool = True,
    start_year: int | None = None, exclude_years: Collection[int] = (), names: DataFrame | None = None,
) -> DataFrame:
    """Dense history where each municipality's own activity tells which years are complete.

    A municipality's years are those it has rows in, so one aggregation by (municipality,
    year) holds everything: no staging, no grid of years.
    """
    slots = [f"_p{i}" for i in range(1, periods.count + 1)]
    chosen = budget.filter(in_years(start_year, exclude_years))
    cube = group_cube(chosen, periods).filter(F.col(CODE).isNotNull())
    by_year = cube.groupBy(CODE, YEAR).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(GROUP), F.array(*slots)))).alias("_cells"),
        F.max("_last").alias("_last"),
    )
    wanted = F.col("_last") == 12 if complete_years_only else F.lit(True)
    groups = F.array(*[F.lit(g) for g in INCOME_GROUPS])
    cells = (
        by_year.filter(wanted)
        .withColumns(coverage_columns(F.col("_last")))
        .select("*", F.explode(groups).alias(GROUP))
        .withColumn("_amounts", F.try_element_at("_cells", F.col(GROUP)))
    )
    return _finish(_named(_with_shares(cells, periods), budget, names), periods)


def _one(
    budget: DataFrame, municipality: Entity, periods: Periods, complete_years_only: bool,
    start_year: int | None, exclude_years: Collection[int],
) -> DataFrame:
    """History of one municipality: coverage over all rows, values over its rows only."""
    code, name = resolve_municipality(budget, municipality)
    coverage = infer_year_coverage(budget).collect()
    years = choose_years(coverage, complete_years_only, start_year, exclude_years)
    own = budget.filter((F.col(CODE) == code) & F.col(YEAR).isin(*[r[YEAR] for r in years]))
    if own.filter(municipal_income(own.columns)).isEmpty():
        raise ContractError(f"no municipal income for {name}")
    dense = _dense(group_cube(own, periods), periods, years).withColumn(NAME, F.lit(name))
    groups = F.array(*[F.lit(g) for g in INCOME_GROUPS])
    # annual rows keep the order of the groups, periodic rows the order of their names
    order = F.array_position(groups, F.col(GROUP)) if periods is ANNUAL else F.col(GROUP)
    return _finish(dense.orderBy(YEAR, periods.column, order), periods)


def build_municipality_income_history(
    budget: DataFrame, *, municipality: Entity, complete_years_only: bool = True,
    exclude_years: Collection[int] = (),
) -> DataFrame:
    """Annual composition of one municipality, by year and group."""
    return _one(budget, municipality, ANNUAL, complete_years_only, None, exclude_years)


def build_municipalities_income_history(
    budget: DataFrame, *, municipalities: Collection[Entity], complete_years_only: bool = True,
    exclude_years: Collection[int] = (),
) -> DataFrame:
    """Annual composition of several municipalities, each with its own coverage."""
    codes = resolve_codes(budget, municipalities)
    return income_history_per_entity(
        rows_of_codes(budget, codes), complete_years_only=complete_years_only, exclude_years=exclude_years
    )


def build_municipality_quarterly_income_history(
    budget: DataFrame, *, municipality: Entity, start_year: int | None = None,
    complete_years_only: bool = True, exclude_years: Collection[int] = (),
) -> DataFrame:
    return _one(budget, municipality, QUARTERS, complete_years_only, start_year, exclude_years)


def build_municipality_four_month_income_history(
    budget: DataFrame, *, municipality: Entity, start_year: int | None = None,
    complete_years_only: bool = True, exclude_years: Collection[int] = (),
) -> DataFrame:
    return _one(budget, municipality, FOUR_MONTHS, complete_years_only, start_year, exclude_years)


def build_municipality_semiannual_income_history(
    budget: DataFrame, *, municipality: Entity, start_year: int | None = None,
    complete_years_only: bool = True, exclude_years: Collection[int] = (),
) -> DataFrame:
    return _one(budget, municipality, SEMESTERS, complete_years_only, start_year, exclude_years)
