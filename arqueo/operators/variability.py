"""Between-semester variability of the accounts behind ``Otros ingresos``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arqueo import rules
from arqueo.functions.numeric import MONEY, exact_sum, fail_when, share
from arqueo.functions.text import account_code, name_form, strip, words_of_form
from arqueo.operators.classify import classified_income, income_group, municipal_income
from arqueo.operators.dictionary import text_dictionary, with_forms
from arqueo.operators.history import SEMESTERS, choose_years, coverage_columns, infer_year_coverage, last_active_month
from arqueo.operators.ranking import spread_row_number
from arqueo.operators.reshape import period_amounts
from arqueo.operators.scope import Entity, entity_names, resolve_municipality
from arqueo.operators.staging import broadcast_if_small, literal_rows, stage, with_group_values
from arqueo.schema import (
    CODE, COLLECTED, GROUP, NAME, OTHER, SERVICE_NAME, SUBASSIGNMENT, SUBTITLE, TYPE_CODE, YEAR, ContractError,
    month_columns, require_columns,
)

REMAINDER = "Resto de otros ingresos"
ACCOUNT = [SUBTITLE, SUBASSIGNMENT]
LABEL_LEVELS = ("Nombre Asignación", "Nombre Subasignación", "Nombre Ítem", "Nombre Subtítulo")


def meaningful(name: Column, form: Column) -> Column:
    """The trimmed name, null when it is blank or says nothing; ``form`` is its ``name_form``."""
    text = strip(name.cast("string"))
    return F.when((text != "") & ~form.isin(*rules.MEANINGLESS_NAMES), text)


def latest_name(name: Column, form: Column, order: list[Column]) -> Column:
    """Aggregate: the last meaningful name by ``order`` (the name itself breaks ties), with its form."""
    kept = meaningful(name, form)
    return F.max(F.when(kept.isNotNull(), F.struct(*order, kept.alias("name"), form.alias("form"))))


def account_label(
    assignment: Column, subassignment: Column, item: Column, subtitle: Column, code: Column, forms: tuple[Column, Column],
) -> Column:
    """Assignment and sub-assignment, unless the second adds nothing; else the first known level.

    ``forms`` are the ``name_form`` of the first two.
    """
    one, two = words_of_form(forms[0]), words_of_form(forms[1])
    shorter = F.least(F.size(one), F.size(two))
    alike = (shorter > 0) & (F.size(F.array_intersect(one, two)) / shorter >= 0.7)
    contained = forms[0].contains(forms[1])
    both = F.when(contained | alike, assignment).otherwise(F.concat_ws(" — ", assignment, subassignment))
    return F.when(assignment.isNotNull() & subassignment.isNotNull(), both).otherwise(
        F.coalesce(subassignment, assignment, item, subtitle, F.concat(F.lit("Cuenta "), code))
    )


def account_cube(budget: DataFrame) -> DataFrame:
    """The only reduction of the rows: (municipality, year, account and its names) with decimal sums of both semesters.

    Rows of other groups, and those without an account key, are one entry per municipality and
    year; they are kept for the last active month, which tells the coverage of a year. Names are
    grouped as they are written: an account has few spellings, and they are folded afterwards.
    """
    require_columns(budget, [TYPE_CODE, SERVICE_NAME, *ACCOUNT, *month_columns(COLLECTED)], "analyse semester variability")
    first, second = period_amounts(SEMESTERS.months)
    group = income_group(budget.columns)
    counted = F.coalesce(group == OTHER, F.lit(False)) & F.col(SUBTITLE).isNotNull() & F.col(SUBASSIGNMENT).isNotNull()
    levels = [c for c in LABEL_LEVELS if c in budget.columns]
    order = [F.col(c) for c in ("source_file", "source_row") if c in budget.columns]
    rows = budget.filter(municipal_income(budget.columns) & F.col(YEAR).isNotNull()).withColumns({"_group": group, "_counted": counted})
    return (
        rows.groupBy(CODE, YEAR, "_counted", *[F.when(F.col("_counted"), F.col(c)).alias(c) for c in (*ACCOUNT, *levels)])
        .agg(
            F.coalesce(exact_sum(first), F.lit(0)).alias("_s1"),
            F.coalesce(exact_sum(second), F.lit(0)).alias("_s2"),
            F.max(F.struct(F.col(YEAR), *order)).alias("_order"),
            F.max(last_active_month()).alias("_last"),
            F.count(F.when(F.col("_group").isNull(), 1)).alias("_unclassified"),
        )
    )


def semester_accounts(cube: DataFrame, years: list[int]) -> DataFrame:
    """(municipality, year, account) of the chosen years: decimal sums of both semesters and the year's names.

    Rows without an account key carry no account and are left out (early years);
    ``accounts_left_out`` counts them. Names are folded once each, in a dictionary. A row of a
    chosen year that could not be classified stops the job.
    """
    present = [c for c in LABEL_LEVELS if c in cube.columns]
    known = fail_when(F.col("_unclassified") > 0, "municipal income row that could not be classified", F.col("_counted"))
    rows = cube.filter(F.col(YEAR).isin(*years) & F.col(CODE).isNotNull()).filter(known)
    if present:
        names = text_dictionary(rows, present, {"form": name_form})
        rows = with_forms(rows, names, {f"_form{i}": (c, "form") for i, c in enumerate(present)})
    return (
        rows.groupBy(CODE, YEAR, *ACCOUNT)
        .agg(
            F.sum("_s1").cast(MONEY).alias("_s1"), F.sum("_s2").cast(MONEY).alias("_s2"),
            *[latest_name(F.col(c), F.col(f"_form{i}"), [F.col("_order")]).alias(c) for i, c in enumerate(present)],
        )
    )


def accounts_left_out(budget: DataFrame) -> DataFrame:
    """Rows per year that the analysis leaves out, for want of an account key or of a municipality."""
    lacks_account = F.col(SUBTITLE).isNull() | F.col(SUBASSIGNMENT).isNull()
    return (
        classified_income(budget).filter(F.col(GROUP) == OTHER).groupBy(YEAR)
        .agg(F.count(F.when(lacks_account, 1)).alias("sin_cuenta"), F.count(F.when(F.col(CODE).isNull(), 1)).alias("sin_municipio"))
    )


def rank_accounts(accounts: DataFrame, year_count: int, top_n: int) -> DataFrame:
    """Ranking of the accounts of every municipality.

    A year without rows counts as 0 in both semesters, so the means divide by the number of
    chosen years and no grid of accounts and years is needed.
    """
    difference = F.col("_s1") - F.col("_s2")
    levels = [F.col(c) if c in accounts.columns else F.lit(None).cast("struct<name:string,form:string>") for c in LABEL_LEVELS]
    merged = accounts.groupBy(CODE, *ACCOUNT).agg(
        F.sum(F.abs(difference)).alias("_exact"),
        (F.sum(F.abs(difference)).cast("double") / year_count).alias("variacion_promedio_abs_s1_s2"),
        (F.sum(difference).cast("double") / year_count).alias("diferencia_promedio_s1_s2"),
        F.max(F.abs(difference)).cast("double").alias("variacion_maxima_abs_s1_s2"),
        F.sum(F.col("_s1") + F.col("_s2")).cast("double").alias("ingreso_total"),
        *[F.max(level).alias(f"_l{i}") for i, level in enumerate(levels)],
    )
    named, forms = [F.col(f"_l{i}")["name"] for i in range(4)], (F.col("_l0")["form"], F.col("_l1")["form"])
    code = account_code(F.col(SUBTITLE), F.col(SUBASSIGNMENT))
    plain = merged.withColumn("codigo_cuenta", code).withColumn(
        "_label", account_label(*named, F.col("codigo_cuenta"), forms)
    )
    shared = with_group_values(plain.drop("_l0", "_l1", "_l2", "_l3"), [CODE, "_label"], _same=F.count(F.lit(1)))
    labelled = with_group_values(
        shared.withColumn(
            "cuenta", F.when(F.col("_same") > 1, F.concat("_label", F.lit(" ("), "codigo_cuenta", F.lit(")"))).otherwise(F.col("_label"))
        ).drop("_same", "_label"),
        [CODE], _whole=F.sum(F.col("variacion_promedio_abs_s1_s2").cast("decimal(28,6)")),
    )
    # the mean divides every sum by the same number of years, so the exact sums rank alike
    order = [F.col("_exact").desc(), F.col("ingreso_total").desc(), F.col("codigo_cuenta").asc()]
    return (
        spread_row_number(labelled, [CODE], order, "ranking_variabilidad")
        .withColumn("participacion_variabilidad", share(F.col("variacion_promedio_abs_s1_s2"), F.col("_whole"), when_zero=0.0))
        .withColumn("seleccionada", F.col("ranking_variabilidad") <= top_n)
        .drop("_whole", "_exact")
    )


def break_down(accounts: DataFrame, ranking: DataFrame, years: list[int], top_n: int) -> DataFrame:
    """Semester amounts of the top accounts and of the remainder, dense over the chosen years."""
    chosen = F.col("ranking_variabilidad") <= top_n
    component = ranking.select(
        CODE, *ACCOUNT,
        F.when(chosen, F.col("cuenta")).otherwise(REMAINDER).alias("componente"),
        F.when(chosen, F.col("ranking_variabilidad")).otherwise(F.lit(top_n + 1)).cast("bigint").alias("orden_componente"),
    )
    keys = [CODE, "componente", "orden_componente"]
    sums = accounts.join(component, [CODE, *ACCOUNT]).groupBy(*keys, YEAR).agg(
        F.sum("_s1").alias("_s1"), F.sum("_s2").alias("_s2")
    )
    # at most one entry per year and component
    packed = sums.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(YEAR), F.array("_s1", "_s2")))).alias("_cells")
    )
    cells = F.flatten(F.transform(
        F.array(*[F.lit(y).cast("bigint") for y in years]),
        lambda y: F.transform(
            F.array(F.lit(1), F.lit(2)),
            lambda s: F.struct(
                y.alias(YEAR), s.cast("bigint").alias("Semestre"),
                F.coalesce(F.try_element_at("_cells", y)[s - 1], F.lit(0)).alias("_amount"),
            ),
        ),
    ))
    # at most top_n + 1 rows per (municipality, year, semester)
    whole = Window.partitionBy(CODE, YEAR, "Semestre")
    return (
        packed.select(*keys, F.inline(cells))
        .withColumn("_total", F.sum("_amount").over(whole))
        .select(
            CODE, YEAR, "Semestre",
            F.concat(F.col(YEAR).cast("string"), F.lit(" S"), F.col("Semestre").cast("string")).alias("Periodo"),
            "componente", "orden_componente",
            F.col("_amount").cast("double").alias("ingreso_semestral"),
            F.col("_total").cast("double").alias("total_otros_ingresos"),
            share(F.col("_amount"), F.col("_total"), when_zero=None).alias("participacion_otros_ingresos"),
        )
    )


def _check_top(top_n: int) -> None:
    if top_n < 1:
        raise ContractError("top_n must be at least 1")


def other_income_variability(
    budget: DataFrame, *, start_year: int | None = None, top_n: int = 6, names: DataFrame | None = None,
    coverage: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(breakdown, ranking) of every municipality, over the complete years, in one pass over the rows.

    ``names``, when at hand, spare a second pass; ``coverage`` may come from other rows.
    """
    _check_top(top_n)
    cube = stage(account_cube(budget))
    if coverage is None:
        last = cube.groupBy(YEAR).agg(F.max("_last").alias("_last"))
        coverage = last.select(YEAR, *[c.alias(n) for n, c in coverage_columns(F.col("_last")).items()])
    years = choose_years(coverage.collect(), True, start_year)
    known = broadcast_if_small(stage(entity_names(budget)) if names is None else names.select(CODE, NAME))
    return _analyse(cube, [r[YEAR] for r in years], top_n, known)


def _analyse(cube: DataFrame, years: list[int], top_n: int, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    accounts = stage(semester_accounts(cube, years))
    ranking = stage(rank_accounts(accounts, len(years), top_n))
    breakdown = break_down(accounts, ranking, years, top_n)
    return breakdown.join(names, CODE, "left"), ranking.join(names, CODE, "left")


def analyze_other_income_semester_variability(
    budget: DataFrame, *, municipality: Entity, start_year: int | None = None, top_n: int = 6,
) -> tuple[DataFrame, DataFrame]:
    """(breakdown, ranking) of one municipality; coverage is told by all rows."""
    _check_top(top_n)
    code, name = resolve_municipality(budget, municipality)
    years = [r[YEAR] for r in choose_years(infer_year_coverage(budget).collect(), True, start_year)]
    names = literal_rows(budget.sparkSession, [(code, name)], f"`{CODE}` bigint, `{NAME}` string")
    cube = stage(account_cube(budget.filter((F.col(CODE) == code) & F.col(YEAR).isin(*years))))
    breakdown, ranking = _analyse(cube, years, top_n, F.broadcast(names))
    if ranking.isEmpty():
        raise ContractError(f"{name} has no rows of {OTHER} in the requested years")
    return (
        breakdown.orderBy(YEAR, "Semestre", "orden_componente"),
        ranking.orderBy("ranking_variabilidad"),
    )
