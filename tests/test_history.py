import pytest

from arqueo.operators import history, reshape, scope, variability
from arqueo.schema import INCOME_GROUPS, ContractError
from tests.budgets import budget


@pytest.fixture(scope="module")
def table(spark):
    rows = []
    for year in (2008, 2009, 2010, 2011):
        last = 11 if year == 2011 else 12
        for code, name in ((1, "Buin"), (2, "Ñuñoa")):
            if (code, year) == (2, 2009):
                continue
            rows += [
                {"Ejercicio": str(year), "Cod Municipio": str(code), "Nombre Municipio": name, "Cod Subtítulo": "5",
                 "m": {1: 10 * code, last: 5}},
                {"Ejercicio": str(year), "Cod Municipio": str(code), "Nombre Municipio": name, "Cod Subtítulo": "3",
                 "Cod Subasignación": "1001001", "m": {7: 85}},
            ]
        for n, amount in enumerate((30, 20, 10)):
            rows.append({"Ejercicio": str(year), "Cod Subtítulo": "12", "Cod Subasignación": str(n), "Nombre Asignación": "Deuda",
                         "Nombre Subasignación": "Sin desagregación" if n else "Deuda vieja", "m": {3: amount, 9: 2}})
    return budget(spark, rows).cache()


def test_coverage(table):
    rows = {r["Ejercicio"]: r for r in history.infer_year_coverage(table).collect()}
    assert rows[2011]["last_reported_month"] == "Noviembre" and rows[2011]["is_complete"] is False
    assert rows[2008]["year_status"] == "complete" and rows[2008]["last_reported_month_number"] == 12


def test_annual_history_is_dense_and_adds_up(table):
    rows = history.income_history(table).collect()
    assert len(rows) == 2 * 3 * len(INCOME_GROUPS)
    absent = [r for r in rows if r["Cod Municipio"] == 2 and r["Ejercicio"] == 2009]
    assert len(absent) == 5 and {(r["ingreso_anual"], r["porcentaje_ingreso"], r["total_anual"]) for r in absent} == {(0.0, 0.0, 0.0)}
    buin = {r["grupo_ingreso"]: r for r in rows if r["Cod Municipio"] == 1 and r["Ejercicio"] == 2008}
    assert buin["IPP"]["ingreso_anual"] == 85 and buin["Otros ingresos"]["ingreso_anual"] == 66 and buin["IPP"]["total_anual"] == 166
    assert abs(sum(r["porcentaje_ingreso"] for r in buin.values()) - 100) < 1e-9


def test_one_municipality_and_years(table):
    rows = history.build_municipality_income_history(table, municipality="ñunoa", exclude_years=[2008]).collect()
    assert [r["Ejercicio"] for r in rows] == [2009] * 5 + [2010] * 5
    assert [r["grupo_ingreso"] for r in rows[:5]] == list(INCOME_GROUPS)
    with pytest.raises(ContractError, match="no years left"):
        history.build_municipality_income_history(table, municipality=1, exclude_years=range(2000, 2020))


def test_several_municipalities_have_their_own_years(table):
    rows = history.build_municipalities_income_history(table, municipalities=["NUNOA", 1]).collect()
    assert {(r["Cod Municipio"], r["Ejercicio"]) for r in rows} == {(1, 2008), (1, 2009), (1, 2010), (2, 2008), (2, 2010)}
    with pytest.raises(ContractError, match="not found"):
        history.build_municipalities_income_history(table, municipalities=["Nadie"])
    with pytest.raises(TypeError):
        history.build_municipalities_income_history(table, municipalities="Buin")


@pytest.mark.parametrize("build, column, periods", [
    (history.build_municipality_quarterly_income_history, "Trimestre", 4),
    (history.build_municipality_four_month_income_history, "Cuatrimestre", 3),
    (history.build_municipality_semiannual_income_history, "Semestre", 2),
])
def test_periods(table, build, column, periods):
    rows = build(table, municipality=1, start_year=2010, complete_years_only=True).collect()
    assert len(rows) == periods * 5
    assert sum(r[f"ingreso_{column.lower()[:-1]}al" if column != "Semestre" else "ingreso_semestral"] for r in rows) == 166
    assert rows[0]["Periodo"] == f"2010 {column[0]}1"
    assert [r["grupo_ingreso"] for r in rows[:5]] == sorted(INCOME_GROUPS)


def test_monthly_long(table):
    long = reshape.build_presupuesto_monthly(table)
    assert long.count() == 2 * (4 + 3) + 4 * 0 + 7 + 4 * 3 * 2
    assert reshape.build_presupuesto_monthly(table, drop_empty=False).count() == 12 * table.count()
    assert str(long.filter("mes = 'Marzo' and Ejercicio = 2009").head()["fecha"]) == "2009-03-01"


def test_variability(table):
    breakdown, ranking = variability.analyze_other_income_semester_variability(table, municipality="Buin", start_year=2009, top_n=2)
    rows = ranking.collect()
    assert [r["codigo_cuenta"] for r in rows] == ["12-0000000", "12-0000001", "12-0000002"]
    assert [r["cuenta"] for r in rows] == ["Deuda (12-0000000)", "Deuda (12-0000001)", "Deuda (12-0000002)"]
    assert [r["variacion_promedio_abs_s1_s2"] for r in rows] == [28.0, 18.0, 8.0]
    assert [r["seleccionada"] for r in rows] == [True, True, False]
    assert abs(sum(r["participacion_variabilidad"] for r in rows) - 100) < 1e-9
    parts = breakdown.collect()
    assert len(parts) == 2 * 2 * 3 and parts[2]["componente"] == variability.REMAINDER
    assert parts[0]["total_otros_ingresos"] == 60.0 and parts[2]["ingreso_semestral"] == 10.0
    with pytest.raises(ContractError):
        variability.analyze_other_income_semester_variability(table, municipality=1, top_n=0)


def test_scope(table):
    assert scope.resolve_municipality(table, " ñuÑoa ") == (2, "Ñuñoa")
    assert scope.filter_entities(table, ["buin", 2], require_all=True).count() == table.count()
    with pytest.raises(ContractError, match="'Nadie'"):
        scope.filter_entities(table, ["Buin", "Nadie"], require_all=True)
    with pytest.raises(TypeError):
        scope.filter_entity(table, True)
    with pytest.raises(ContractError):
        scope.filter_entities(table, [" - "])
    assert scope.build_municipal_income_scope(table, region=" UNO", years=[2008]).count() == 7
