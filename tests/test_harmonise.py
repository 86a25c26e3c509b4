import pytest
from pyspark.sql import functions as F

from arqueo.operators import classify, harmonise, quality
from arqueo.operators.staging import checked_join
from arqueo.schema import AUDIT, BUDGET_SCHEMA, CONTRACT, ContractError
from tests.budgets import budget, raw


def test_contract_sizes():
    assert len(CONTRACT) == 74 and len(AUDIT) == 31


def test_types_codes_and_defaults(spark):
    df = budget(spark, [
        {"Ejercicio": "2.010", "Cod Subasignación": "3.001.001", "Cod Ítem": "7.0", "Nombre Subárea": " ", "m": {1: 5, 2: "x"}},
        {"Cod Subasignación": "", "Nombre Serv Incorporado": "Área Salud", "Cod Tipo Cuenta": "9", "Percibidopag Total": "8"},
        {"Nombre Serv Incorporado": "Otro", "Cod Tipo Cuenta": "2"},
    ])
    assert [(f.name, f.dataType) for f in df.schema] == [(f.name, f.dataType) for f in BUDGET_SCHEMA]
    one, two, three = df.orderBy("source_row").collect()
    assert (one["Ejercicio"], one["Cod Subasignación"], one["Cod Ítem"], one["Nombre Subárea"]) == (2010, 3001001, 7, "Sin Subárea")
    assert one["Percibidopag Total"] == 5 and one["source_ejercicio"] == "2.010" and one["Cod Subárea"] == 0
    assert (two["Cod Subasignación"], two["Cod Serv Incorporado"], two["Nombre Serv Incorporado"]) == (None, 3, "Salud")
    assert two["Percibidopag Total"] == 8 and two["service_mapping_status"] == "mapped_by_name"
    assert three["service_mapping_status"] == "unmapped" and three["Nombre Tipo Cuenta"] == "GASTOS"
    assert three["Percibidopag Total"] is None


def test_fractional_code_stops_the_job_and_is_reported(spark):
    rows = raw(spark, [{"Cod Ítem": "1.5"}, {"Cod Ítem": "x"}])
    assert [tuple(r) for r in harmonise.bad_codes(rows).select("columna", "texto").collect()] == [("Cod Ítem", "1.5")]
    with pytest.raises(Exception, match="no integer"):
        harmonise.normalize_layout(rows).collect()


def test_unknown_and_colliding_headers():
    with pytest.raises(ContractError, match="without a rule"):
        harmonise.canonical_headers(["Ejercicio", "Rareza"], "f")
    with pytest.raises(ContractError, match="twice"):
        harmonise.canonical_headers(["Cod Area", "Cod Subarea"], "f")
    assert harmonise.canonical_headers([" Modif Ppto Enero "], "f") == ["Ppto Modif Enero"]


def crosswalk(spark):
    return spark.createDataFrame([
        (0, 2002, 2007, 3, 1, "IPP"), (1, 2005, 2006, 3, 1, "FCM"), (2, 2002, 2007, 6, 2, "Otros ingresos"), (3, 2002, 2007, 6, 3, "FCM"),
    ], "rule_no int, valid_from int, valid_to int, source_cod_subtitulo bigint, source_cod_item bigint, canonical_group string")


def test_early_years_precedence(spark):
    early = {"Ejercicio": "2005"}
    df = budget(spark, [
        {**early, "Cod Subtítulo": "3", "Cod Ítem": "1"},                                        # later rule wins
        {**early, "Ejercicio": "2007", "Cod Subtítulo": "3", "Cod Ítem": "1.0"},                 # only the first is valid
        {**early, "Cod Subtítulo": "7", "Nombre Ítem": "Aporte F.C.M.X"},                        # FCM text
        {**early, "Cod Subtítulo": "7", "Nombre Ítem": "Aporte FCM"},                            # no FCM text
        {**early, "Cod Subtítulo": "7", "Nombre Asignación": "Permisos de Circulación"},         # permanent text
        {**early, "Cod Subtítulo": "6", "Nombre Ítem": "Pavimentos"},                            # capital keyword
        {**early, "Cod Subtítulo": "6", "Cod Ítem": "2"},                                        # overrides a dated rule
        {**early, "Cod Subtítulo": "6", "Cod Ítem": "3"},                                        # but not FCM
        {**early, "Cod Subtítulo": "6", "Nombre Ítem": "Fondo Común Municipal"},                 # nor FCM by text
        {**early, "Cod Tipo Cuenta": "2"},
        {"Cod Subtítulo": "8", "Cod Subasignación": "3001000"}, {"Cod Subtítulo": "5", "Cod Subasignación": "3007001"},
        {"Cod Subtítulo": "5"}, {"Cod Subtítulo": "13"}, {"Cod Subtítulo": "12", "Cod Subasignación": None},
    ], crosswalk(spark))
    got = [(r["grupo_ingreso_canonico"], r["income_mapping_status"], r["income_mapping_method"]) for r in df.orderBy("source_row").collect()]
    assert got == [
        ("FCM", "mapped", "legacy_crosswalk"), ("IPP", "mapped", "legacy_crosswalk"), ("FCM", "mapped", "legacy_text"),
        ("Otros ingresos", "mapped", "legacy_other"), ("IPP", "mapped", "legacy_text"),
        ("Transferencias de capital", "review", "legacy_transfer_capital_keyword"),
        ("Transferencias corrientes", "review", "legacy_transfer_default_current"),
        ("FCM", "mapped", "legacy_crosswalk"), ("FCM", "mapped", "legacy_text"), (None, "not_applicable", "not_applicable"),
        ("FCM", "mapped", "modern_code"), ("IPP", "mapped", "modern_code"), ("Transferencias corrientes", "mapped", "modern_code"),
        ("Transferencias de capital", "mapped", "modern_code"), ("Otros ingresos", "mapped", "modern_code"),
    ]
    early_rows = df.filter("Ejercicio < 2008").select("Cod Subtítulo", "Nombre Ítem", "source_cod_subtitulo").distinct().collect()
    assert {(r[0], r[1]) for r in early_rows} == {(None, None)} and all(r[2] for r in early_rows)


def test_catalogue_statuses(spark):
    base = budget(spark, [{"Cod Municipio": "1", "Nombre Municipio": "Ñiquén"}, {"Cod Municipio": "2", "Nombre Municipio": "Buin"}])
    catalog = harmonise.build_municipality_catalog(base, year=2010)
    rows = budget(spark, [
        {"Cod Municipio": "1", "Nombre Municipio": "Qiquen"}, {"Cod Municipio": "2", "Nombre Municipio": "BUIN "},
        {"Cod Municipio": "7", "Nombre Municipio": "buin"}, {"Cod Municipio": None, "Nombre Municipio": "Buin"}, {"Cod Municipio": "5", "Nombre Municipio": "Lejos"},
    ])
    got = harmonise.apply_municipality_catalog(rows, catalog).orderBy("source_row").select("Cod Municipio", "Nombre Municipio", "municipality_mapping_status").collect()
    assert [tuple(r) for r in got] == [
        (1, "Ñiquén", "matched_by_alias"), (2, "Buin", "canonical_code"), (2, "Buin", "matched_by_name"),
        (2, "Buin", "matched_by_name"), (5, "Lejos", "unmapped"),
    ]
    twice = budget(spark, [{"Cod Municipio": "1"}, {"Cod Municipio": "2"}])
    with pytest.raises(Exception, match="ambiguous"):
        harmonise.build_municipality_catalog(twice, year=2010).collect()


def test_strict_report(spark):
    df = budget(spark, [{"m": {1: 1}}, {"Cod Tipo Cuenta": None}])
    report = quality.validate_normalized(df, strict=True).head()
    assert (report["rows"], report["missing_account_type_rows"], report["missing_collected_total_rows"]) == (2, 1, 1)
    with pytest.raises(ContractError, match="no collected amounts"):
        quality.validate_normalized(budget(spark, [{}, {}]))
    bad = df.withColumn("municipality_mapping_status", F.lit("unmapped"))
    with pytest.raises(ContractError, match="2 rows without a canonical municipality"):
        quality.validate_normalized(bad)


def test_row_columns_and_checked_join(spark):
    df = budget(spark, [{"Cod Subtítulo": "3", "Cod Subasignación": "1001001"}, {"Nombre Serv Incorporado": "Educación"}])
    got = df.orderBy("source_row").select(
        classify.income_key(df.columns).isNotNull(), classify.is_ipp(df.columns), classify.is_fcm(df.columns), classify.income_group(df.columns)).collect()
    assert [tuple(r) for r in got] == [(True, True, False, "IPP"), (False, False, False, None)]
    left, right = spark.createDataFrame([(1,), (1,)], "k int"), spark.createDataFrame([(1, "a")], "k int, v string")
    assert checked_join(left, right, "k").count() == 2
    with pytest.raises(Exception, match="repeated key"):
        checked_join(left, right, "k", validate="one_to_one").collect()
