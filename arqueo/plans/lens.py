"""The trade tables seen as a municipal budget.

One ``lineitem`` row becomes one budget row: the customer's nation is the municipality, the
ship month the month, the extended price the collected amount, part type and size the
account. Years move by ten, so 2005-2007 are early years, 2008-2010 modern and complete, and
2011 is partial.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arqueo.operators.classify import add_income_mapping
from arqueo.operators.harmonise import blank_legacy_accounts
from arqueo.operators.staging import literal_rows
from arqueo.rules import FCM_KEYS, IPP_KEYS
from arqueo.schema import CODE, MEASURES, MONTHS, NAME, SOURCE_FIELDS
from arqueo.session import compiled_methods

# --- Fixed values: how part types and sizes read as accounts ---
SUBTITLES = {"ECONOMY": 3, "SMALL": 5, "MEDIUM": 6, "PROMO": 8, "LARGE": 12, "STANDARD": 13}
SUBTITLE_NAMES = {
    3: "Tributos sobre el uso de bienes", 5: "Transferencias corrientes",
    6: "Rentas de la propiedad", 8: "Otros ingresos corrientes",
    12: "Recuperación de préstamos", 13: "Transferencias para gastos de capital",
}
ITEM_NAMES = (
    "Patentes y tasas", "Permisos de Circulación", "Participación en impuesto territorial",
    "Obras de pavimentación", "Fondo Común Municipal", "Reembolsos varios",
    "Multas e Intereses", "Mejoramiento de barrios", "Otros", "Sin Desagregación",
)
# source subtitle, source item, first year, last year, group; later rules win
CROSSWALK = (
    (3, 1, 2002, 2007, "IPP"),
    (3, 2, 2002, 2006, "Otros ingresos"),
    (3, 2, 2006, 2007, "FCM"),
    (6, 4, 2002, 2007, "Transferencias de capital"),
    (8, 8, 2005, 2005, "FCM"),
    (12, 0, 2006, 2007, "Transferencias corrientes"),
)
YEAR_SHIFT = 10
# --- end of fixed values ---

OWN_KEYS = {s: [k for t, k in (*IPP_KEYS, *FCM_KEYS) if t == s] for s in SUBTITLES.values()}


# stated, so that opening a table costs no job that reads footers
TABLES = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A large table; a file with fewer splits than there are cores is dealt out by ``key``.

    A table of many files has splits enough and is read as it is, without a shuffle.
    """
    rows, cores = table(spark, sf_dir, name), spark.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores, key)


def crosswalk(spark: SparkSession) -> DataFrame:
    rows = [(i, a, b, c, d, g) for i, (c, d, a, b, g) in enumerate(CROSSWALK)]
    return literal_rows(
        spark, rows, "rule_no int, valid_from int, valid_to int, source_cod_subtitulo bigint, "
        "source_cod_item bigint, canonical_group string"
    )


def _pick(key: Column, values: dict) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def _listed(values, position: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), position.cast("int"))


def subassignment(subtitle: Column, size: Column) -> Column:
    """Small sizes take one of the listed keys of the subtitle, others a key of their own."""
    code = F.lit(9_000_000) + size
    for number, keys in OWN_KEYS.items():
        if keys:
            listed = _listed(keys, size % len(keys) + 1)
            code = F.when((subtitle == number) & (size <= 20), listed).otherwise(code)
    return code.cast("bigint")


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per part: its account codes and names."""
    subtitle, size = _pick(F.col("p_type"), SUBTITLES).cast("bigint"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        subtitle.alias("Cod Subtítulo"),
        _pick(subtitle.cast("int"), SUBTITLE_NAMES).alias("Nombre Subtítulo"),
        (size % 10).cast("bigint").alias("Cod Ítem"),
        _listed(ITEM_NAMES, size % 10 + 1).alias("Nombre Ítem"),
        (size % 7).cast("bigint").alias("Cod Asignación"),
        F.col("p_name").alias("Nombre Asignación"),
        subassignment(subtitle, size).alias("Cod Subasignación"),
        F.when(size % 3 == 0, "Sin Desagregación")
        .when(size % 3 == 1, F.concat(F.initcap("p_name"), F.lit(" "), F.col("p_brand")))
        .otherwise(F.col("p_brand")).alias("Nombre Subasignación"),
    )


def municipalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(code, name, region) of every nation."""
    region = table(spark, sf_dir, "region")
    return table(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_nationkey").cast("bigint").alias(CODE), F.col("n_name").alias(NAME), F.col("r_name").alias("Región")
    )


def order_municipality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order, municipality code)."""
    customer = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias(CODE))
    return (
        table(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(F.col("o_orderkey").alias("l_orderkey"), CODE)
    )


def typed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns straight from the tables; unread ones are pruned by the optimiser."""
    line = spread_table(spark, sf_dir, "lineitem", "l_orderkey")
    # the month and year are read once; dozens of columns refer to them
    line = line.selectExpr("*", "month(l_shipdate) AS _month", f"CAST(year(l_shipdate) + {YEAR_SHIFT} AS BIGINT) AS _year")
    joined = (
        line.join(accounts(spark, sf_dir), "l_partkey")
        .join(order_municipality(spark, sf_dir), "l_orderkey")
        .join(municipalities(spark, sf_dir), CODE)
    )
    measured = {
        "Ppto Modif": "l_quantity",
        "Devengado": "CASE WHEN l_discount > 0.02 THEN l_extendedprice END",
        "Percibidopag": "l_extendedprice",
        "Porpercibir": "CASE WHEN l_tax > 0.04 THEN l_quantity END",
    }
    year = "_year"
    income, own = "l_returnflag <> 'R'", "l_linestatus = 'F'"
    columns = {
        "Ejercicio": year,
        "Moneda": "'CLP'",
        "Cod Tipo Cuenta": f"CAST(IF({income}, 1, 2) AS BIGINT)",
        "Nombre Tipo Cuenta": f"IF({income}, 'INGRESOS', 'GASTOS')",
        "Cod Serv Incorporado": f"CAST(IF({own}, 1, 2) AS BIGINT)",
        "Nombre Serv Incorporado": f"IF({own}, 'Gestión Municipal', 'Educación')",
        "Cod Subárea": "0L",
        "Nombre Subárea": "'Sin Subárea'",
        "Cod Subsubasignación": "CAST(NULL AS BIGINT)",
        "Nombre Subsubasignación": "CAST(NULL AS STRING)",
        "Ppto Inicial": "CAST(NULL AS DOUBLE)",
        **{f"{m} {name}": f"CASE WHEN _month = {n} THEN {value} END"
           for m, value in measured.items() for n, name in enumerate(MONTHS, start=1)},
        "Ppto Actualizado": "l_quantity",
        **{f"{m} Total": measured[m] for m in MEASURES[1:]},
        "source_file": f"concat('budget_', {year}, '.csv')",
        "source_row": "l_orderkey * 10 + l_linenumber",
    }
    return compiled_methods(joined).selectExpr("*", *[f"{value} AS `{c}`" for c, value in columns.items()])


def budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalised budget rows: classified, and early account codes blanked."""
    rows = typed_rows(spark, sf_dir)
    audited = rows.selectExpr("*", *[f"CAST(`{c}` AS STRING) AS {a}" for c, a in SOURCE_FIELDS.items()])
    return audited.transform(add_income_mapping, crosswalk(spark)).transform(blank_legacy_accounts)


def raw_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as an unharmonised source: text cells under old headers, with the usual
    blemishes (thousands separators, ``7.0`` codes, spelling variants, absent totals)."""
    rows = typed_rows(spark, sf_dir)
    variant = F.col("l_linenumber") % 3
    dotted = F.translate(F.format_number(F.col("Cod Subasignación"), 0), ",", ".")
    service = (
        F.when((F.col("l_linestatus") == "F") & (variant == 0), "GESTIÓN MUNICIPAL")
        .when(F.col("l_linestatus") == "F", " Gestion Municipal")
        .when(variant == 0, "Área Salud").when(variant == 1, "educación").otherwise("Bienestar")
    )
    place = F.when(variant == 0, F.concat(F.lit(" "), F.lower(NAME))).when(
        variant == 1, F.replace(F.col(NAME), F.lit("_"), F.lit("-"))).otherwise(F.col(NAME))
    text = {
        "Ejercicio": F.col("Ejercicio"), "Region": F.col("Región"),
        "Cod Municipio": F.when(variant == 2, F.col(CODE)).otherwise(F.col(CODE) + 100),
        "Nombre Municipio": place,
        "Cod Servicio": F.lit(None), "Nombre Servicio": service,
        "Nombre Area": F.when(variant == 0, "  ").when(variant == 1, "Central"),
        "Cod Tipo Cuenta": F.when(variant == 0, F.concat(F.col("Cod Tipo Cuenta").cast("string"), F.lit(".0")))
        .otherwise(F.col("Cod Tipo Cuenta").cast("string")),
        "Nombre Tipo Cuenta": F.lit("?"),
        "Cod Subtitulo": F.concat(F.lit(" "), F.col("Cod Subtítulo").cast("string")),
        "Nombre Subtitulo": F.col("Nombre Subtítulo"),
        "Cod Item": F.col("Cod Ítem"), "Nombre Item": F.col("Nombre Ítem"),
        "Cod Asignacion": F.when(variant == 0, "n/a").otherwise(F.col("Cod Asignación").cast("string")),
        "Nombre Asignacion": F.concat(F.col("Nombre Asignación"), F.lit(" ")),
        "Cod Subasignacion": dotted, "Nombre Subasignacion": F.col("Nombre Subasignación"),
        "Ppto inicial": F.when(variant == 1, F.lit("10")),
        "Percibidopag Acum": F.when(variant == 0, F.col("Percibidopag Total").cast("string")).when(variant == 1, "s/i"),
    }
    months = {f"Modif Ppto {m}": f"Ppto Modif {m}" for m in MONTHS}
    months |= {f"{x} {m}": f"{x} {m}" for x in MEASURES[1:] for m in MONTHS}
    return rows.select(
        *[c.cast("string").alias(n) for n, c in text.items()],
        *[F.expr(f"CAST(`{c}` AS STRING) AS `{n}`") for n, c in months.items()], "source_file", "source_row",
    )
