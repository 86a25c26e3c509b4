import re

import pytest
from pyspark.sql import functions as F

from arqueo.functions.numeric import code_number, to_number, trimmed_sql
from arqueo.operators import reshape
from arqueo.operators.harmonise import apply_municipality_catalog, normalize_layout
from arqueo.operators.staging import unsorted_folders
from arqueo.schema import BUDGET_SCHEMA, CONTRACT

LIMIT = "spark.sql.codegen.hugeMethodLimit"
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


@pytest.fixture
def plain_limit(spark):
    """A session that ``configured`` did not make."""
    before = spark.conf.get(LIMIT)
    spark.conf.set(LIMIT, "65535")
    yield
    spark.conf.set(LIMIT, before)


def raw(spark):
    cells = {c: F.lit(None).cast("string") for c in CONTRACT} | {
        "Ejercicio": F.lit("2010"), "Nombre Municipio": F.lit(" Buin "), "Cod Municipio": F.lit("1.0"), "Percibidopag Enero": F.lit("5")}
    return spark.range(1).select(*[v.alias(c) for c, v in cells.items()], F.lit("BD_2010.csv").alias("source_file"), F.lit(2).alias("source_row"))


def test_wide_plans_run_no_method_that_is_never_compiled(spark, plain_limit):
    reshape.build_presupuesto_monthly(spark.createDataFrame([], BUDGET_SCHEMA))
    assert spark.conf.get(LIMIT) == "8000"
    spark.conf.set(LIMIT, "65535")
    normalize_layout(raw(spark))
    assert spark.conf.get(LIMIT) == "8000"
    spark.conf.set(LIMIT, "4000")
    normalize_layout(raw(spark))
    assert spark.conf.get(LIMIT) == "4000"


def test_joins_of_the_normalisation_hand_wide_rows_through_as_one_value(spark):
    catalog = spark.createDataFrame([(1, "Buin", "RM", "BUIN")], "`Cod Municipio` long, `Nombre Municipio` string, `Región` string, municipality_key string")
    done = apply_municipality_catalog(normalize_layout(raw(spark), keep_filled=True), catalog)
    row = done.first()
    assert row["Nombre Municipio"] == "Buin" and row["source_nombre_municipio"] == " Buin " and row["Percibidopag Total"] == 5.0
    assert row["municipality_mapping_status"] == "canonical_code" and row["_filled"]["Percibidopag Total"]
    joins, todo = [], [done._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        joins += [node.output().size()] if node.nodeName() == "Join" else []
        todo += [node.children().apply(i) for i in range(node.children().size())]
    assert len(joins) == 2 and max(joins) < 30


def test_folders_are_written_without_sorting_and_the_setting_comes_back(spark, tmp_path):
    before = spark.conf.get(OPEN_FILES)
    with unsorted_folders(spark):
        assert int(spark.conf.get(OPEN_FILES)) > 1
        spark.range(100).withColumn("part", F.col("id") % 40).coalesce(1).write.partitionBy("part").parquet(str(tmp_path / "x"))
    assert spark.conf.get(OPEN_FILES) == before
    assert spark.read.parquet(str(tmp_path / "x")).filter("id % 40 = part").count() == 100


def test_numbers_and_trimmed_texts(spark):
    texts = {
        None: (None, None), "": (None, None), " ": (None, None), "7": (7.0, 7.0), " 7 ": (7.0, 7.0), "-7.5": (-7.5, -7.5), "1e3": (1000.0, 1000.0),
        "7d": (None, None), "7F": (None, None), "n/a": (None, None), "s/i": (None, None), "Infinity": (None, None), ".5": (0.5, 0.5),
        "9.000.012": (None, 9000012.0), " 1,001,001": (None, 1001001.0), " 7 ": (None, 7.0), " 1.000": (None, 1000.0), "1.0": (1.0, 1.0),
        "12.34": (12.34, 12.34), "x7": (None, None), "0x10": (None, None), "+3": (3.0, 3.0), "--3": (None, None), "3 4": (None, None),
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", to_number("t").alias("n"), code_number("t").alias("c"), F.expr(trimmed_sql("t")).alias("s"))
    got = {r.t: r for r in df.collect()}
    assert {t: (r.n, r.c) for t, r in got.items()} == texts
    assert {t: r.s for t, r in got.items()} == {t: t if t is None else t.strip() for t in texts}
    odd = spark.createDataFrame([("NaN",), (" nan",)], "t string").select(to_number("t").alias("n"), code_number("t").alias("c")).collect()
    assert all(re.fullmatch("nan", str(v)) for r in odd for v in r)


def outputs(df):
    """Names of the columns that the nodes above the scan hand on, in the optimised plan."""
    names, todo = set(), [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.children().size():
            names |= {node.output().apply(i).name() for i in range(node.output().size())}
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return names


def test_columns_that_a_job_does_not_read_are_not_packed_for_it(spark):
    dated = spark.createDataFrame([(0, 2002, 2007, 3, 1, "IPP")], "rule_no int, valid_from int, valid_to int, source_cod_subtitulo long, source_cod_item long, canonical_group string")
    cells = spark.createDataFrame(raw(spark).collect(), raw(spark).schema)
    few = ["Cod Municipio", "Percibidopag Total", "grupo_ingreso_canonico", "service_mapping_status"]
    lean, whole = (normalize_layout(cells, dated, whole=w).select(*few) for w in (False, True))
    assert lean.collect() == whole.collect() and lean.first()["Percibidopag Total"] == 5.0
    assert not {"_packed", "Devengado Enero", "source_moneda", "Ppto Actualizado"} & outputs(lean)
    assert "_packed" in outputs(whole)


def test_short_whole_codes_are_read_as_the_doubles_they_were(spark):
    codes = {"-0": 0.0, "+12": 12.0, " 12 ": 12.0, "12 3": None, "7\u007f": None, "-": None, "1,5": None, "1.5": 1.5, "999999999999999": 999999999999999.0,
             "9007199254740993": 9007199254740992.0, "1e3": 1000.0, "12d": None, "0x1p3": 8.0, "/7": None}
    got = spark.createDataFrame([(t,) for t in codes], "t string").select("t", code_number("t").alias("c")).collect()
    assert {r.t: r.c for r in got} == codes
