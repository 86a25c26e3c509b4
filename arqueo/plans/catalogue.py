"""Every operator as a query over the trade tables, next to its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arqueo import rules
from arqueo.functions import numeric, text
from arqueo.operators import classify, clusters, dictionary, geography, harmonise, history, medians, pairwise, profiles, quality
from arqueo.operators import ranking as rank_ops
from arqueo.operators import reshape, scope, staging, variability
from arqueo.plans import frames, lens
from arqueo.plans import oracle as o
from arqueo.plans import ward_sql as w
from arqueo.schema import (
    CODE, GROUP, INCOME_GROUPS, MONTHS, NAME, REGION, SUBASSIGNMENT, SUBTITLE, TOTAL_PARTS, YEAR,
)
from arqueo.sources import budget as budget_source
from arqueo.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return register


def rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`"), places) for c in columns})


def _names(spark: SparkSession, sf: str) -> DataFrame:
    return lens.municipalities(spark, sf)


# ---------------------------------------------------------------- histories

HISTORY_TAIL = f"""SELECT code AS "Cod Municipio", name AS "Nombre Municipio", y AS "Ejercicio", grp AS grupo_ingreso,
  amt AS ingreso_anual, {o.share_sql()} AS porcentaje_ingreso, total AS total_anual, month AS last_reported_month,
  st AS year_status, ok AS is_complete FROM hist"""


@query("annual_composition", o.sql(HISTORY_TAIL, o.ANNUAL))
def annual_composition(spark, sf):
    return rounded(history.income_history(lens.budget(spark, sf), names=_names(spark, sf)), "porcentaje_ingreso")


@query("annual_composition_per_entity", o.sql(f"""SELECT c.code AS "Cod Municipio", e.name AS "Nombre Municipio", c.y AS "Ejercicio",
  gr.grp AS grupo_ingreso, CAST(coalesce(s.amt, 0) AS DOUBLE) AS ingreso_anual,
  round(CASE WHEN c.total = 0 THEN 0 ELSE CAST(coalesce(s.amt, 0) AS DOUBLE) / CAST(c.total AS DOUBLE) * 100 END, 6) AS porcentaje_ingreso,
  CAST(c.total AS DOUBLE) AS total_anual, 'Diciembre' AS last_reported_month, 'complete' AS year_status, true AS is_complete
  FROM (SELECT code, y, max(CASE WHEN px <> 0 THEN m END) AS last, sum(amt) AS total FROM g GROUP BY ALL) c JOIN ent e ON e.code = c.code
  CROSS JOIN {o.GROUP_VALUES} LEFT JOIN (SELECT code, y, grp, sum(amt) AS amt FROM g GROUP BY ALL) s
  ON s.code = c.code AND s.y = c.y AND s.grp = gr.grp WHERE c.last = 12"""))
def annual_composition_per_entity(spark, sf):
    rows = history.income_history_per_entity(lens.budget(spark, sf), names=_names(spark, sf))
    return rounded(rows, "porcentaje_ingreso")


@query("annual_composition_one", o.sql(HISTORY_TAIL + " WHERE code = 7 AND y <> 2006", o.ANNUAL))
def annual_composition_one(spark, sf):
    rows = history.build_municipality_income_history(lens.budget(spark, sf), municipality="nation_7", exclude_years={2006})
    return rounded(rows, "porcentaje_ingreso")


@query("annual_composition_several", o.sql(f"""SELECT c.code AS "Cod Municipio", c.y AS "Ejercicio", gr.grp AS grupo_ingreso,
  CAST(coalesce(s.amt, 0) AS DOUBLE) AS ingreso_anual, c.st AS year_status
  FROM (SELECT code, y, CASE WHEN max(CASE WHEN px <> 0 THEN m END) = 12 THEN 'complete' ELSE 'partial' END AS st FROM g
  WHERE code IN (3, 5, 20) GROUP BY ALL) c CROSS JOIN {o.GROUP_VALUES}
  LEFT JOIN (SELECT code, y, grp, sum(amt) AS amt FROM g GROUP BY ALL) s ON s.code = c.code AND s.y = c.y AND s.grp = gr.grp"""))
def annual_composition_several(spark, sf):
    rows = history.build_municipalities_income_history(
        lens.budget(spark, sf), municipalities=["Nation_3", 5, "NATION_20", 3], complete_years_only=False)
    return rows.select(CODE, YEAR, GROUP, "ingreso_anual", "year_status")


@query("year_coverage", o.sql('SELECT y AS "Ejercicio", month AS last_reported_month, last AS last_reported_month_number, st AS year_status, ok AS is_complete FROM cov'))
def year_coverage(spark, sf):
    return history.infer_year_coverage(lens.budget(spark, sf))


@query("year_coverage_per_entity", o.sql("""SELECT code AS "Cod Municipio", y AS "Ejercicio", max(CASE WHEN px <> 0 THEN m END) AS last_reported_month_number,
  CASE WHEN max(CASE WHEN px <> 0 THEN m END) = 12 THEN 'complete' ELSE 'partial' END AS year_status FROM g GROUP BY code, y"""))
def year_coverage_per_entity(spark, sf):
    return history.infer_year_coverage(lens.budget(spark, sf), by=[CODE]).select(
        CODE, YEAR, "last_reported_month_number", "year_status")


def _periodic(name: str, periods: history.Periods) -> None:
    tail = f"""SELECT code AS "Cod Municipio", name AS "Nombre Municipio", y AS "Ejercicio", CAST(p AS BIGINT) AS "{periods.column}",
      y || ' {periods.prefix}' || p AS "Periodo", grp AS grupo_ingreso, CAST(amt AS DOUBLE) AS {periods.amount}, {o.share_sql()} AS porcentaje_ingreso,
      CAST(total AS DOUBLE) AS {periods.total}, month AS last_reported_month, st AS year_status, ok AS is_complete FROM per{{}}"""

    @query(name, o.sql(tail.format(""), o.period_ctes(periods.months)))
    def run(spark, sf):
        return rounded(history.income_history(lens.budget(spark, sf), periods=periods, names=_names(spark, sf)), "porcentaje_ingreso")

    @query(f"{name}_recent", o.sql(tail.format(" WHERE y >= 2006 AND y <> 2008"), o.period_ctes(periods.months)))
    def recent(spark, sf):
        """The years are known beforehand, so they are a filter of the scan."""
        rows = history.income_history(
            lens.budget(spark, sf), periods=periods, start_year=2006, exclude_years=[2008], names=_names(spark, sf))
        return rounded(rows, "porcentaje_ingreso")


_periodic("quarterly", history.QUARTERS)
_periodic("four_month", history.FOUR_MONTHS)
_periodic("semiannual", history.SEMESTERS)


@query("quarterly_one", o.sql("""SELECT y AS "Ejercicio", CAST(p AS BIGINT) AS "Trimestre", grp AS grupo_ingreso, CAST(amt AS DOUBLE) AS ingreso_trimestral
  FROM per WHERE code = 11""", o.period_ctes(3)))
def quarterly_one(spark, sf):
    rows = history.build_municipality_quarterly_income_history(lens.budget(spark, sf), municipality=11)
    return rows.select(YEAR, "Trimestre", GROUP, "ingreso_trimestral")


# ---------------------------------------------------------------- reshaping

@query("monthly_long", o.sql(f"""SELECT 'budget_' || y || '.csv' AS source_file, source_row, y AS "Ejercicio", code AS "Cod Municipio",
  grp AS grupo_ingreso_canonico, m AS mes_numero, {o.MONTH_LIST}[m] AS mes, CAST(make_date(y, m, 1) AS DATE) AS fecha,
  qty AS "Ppto Modif", CASE WHEN disc > 0.02 THEN px END AS "Devengado", px AS "Percibidopag", CASE WHEN tax > 0.04 THEN qty END AS "Porpercibir" FROM cl"""))
def monthly_long(spark, sf):
    keep = ["source_file", "source_row", YEAR, CODE, "grupo_ingreso_canonico"]
    return reshape.build_presupuesto_monthly(lens.budget(spark, sf), keep=keep)


@query("monthly_wide", o.sql(f"""SELECT code AS "Cod Municipio", y AS "Ejercicio", {", ".join(
    f"CAST(coalesce(sum(CASE WHEN m = {i} THEN amt END), 0) AS DOUBLE) AS {m.lower()}" for i, m in enumerate(MONTHS, 1))} FROM g GROUP BY code, y"""))
def monthly_wide(spark, sf):
    income = classify.classified_income(lens.budget(spark, sf))
    return income.groupBy(CODE, YEAR).agg(*[
        F.coalesce(numeric.exact_sum(F.col(f"Percibidopag {m}")).cast("double"), F.lit(0.0)).alias(m.lower()) for m in MONTHS
    ])


@query("semester_difference", o.sql("""SELECT code AS "Cod Municipio", y AS "Ejercicio", CAST(sum(CASE WHEN m <= 6 THEN amt ELSE 0 END) AS DOUBLE) AS s1,
  CAST(sum(CASE WHEN m > 6 THEN amt ELSE 0 END) AS DOUBLE) AS s2, CAST(sum(CASE WHEN m <= 6 THEN amt ELSE -amt END) AS DOUBLE) AS diferencia
  FROM g GROUP BY code, y"""))
def semester_difference(spark, sf):
    income = classify.classified_income(lens.budget(spark, sf))
    first, second = reshape.period_amounts(6)
    sums = income.groupBy(CODE, YEAR).agg(numeric.exact_sum(first).alias("a"), numeric.exact_sum(second).alias("b"))
    return sums.select(CODE, YEAR, F.col("a").cast("double").alias("s1"), F.col("b").cast("double").alias("s2"),
                       (F.col("a") - F.col("b")).cast("double").alias("diferencia"))


@query("row_totals", o.sql("""SELECT 'budget_' || y || '.csv' AS source_file, source_row, qty AS ppto_actualizado,
  CASE WHEN disc > 0.02 THEN px END AS devengado_total, px AS percibidopag_total, CASE WHEN tax > 0.04 THEN qty END AS porpercibir_total,
  ln % 3 = 0 AS lacked FROM raw"""))
def row_totals(spark, sf):
    rows = lens.typed_rows(spark, sf)
    holed = rows.withColumns({t: F.when(F.col("l_linenumber") % 3 != 0, F.col(t)) for t in TOTAL_PARTS})
    filled = harmonise.fill_totals(holed)
    return filled.select("source_file", "source_row", *[F.col(t).alias(t.lower().replace(" ", "_")) for t in TOTAL_PARTS],
                         (F.col("_filled")["Percibidopag Total"]).alias("lacked"))


@query("monthly_group_histogram", o.sql(f"""SELECT x.grp AS grupo_ingreso, CAST(mm.n AS BIGINT) AS mes_numero, {o.MONTH_LIST}[mm.n] AS mes,
  coalesce(CAST(sum(g.amt) AS DOUBLE), 0) AS ingreso FROM (SELECT DISTINCT grp FROM g WHERE grp <> 'IPP') x CROSS JOIN (SELECT unnest(range(1, 13)) AS n) mm
  LEFT JOIN g ON g.grp = x.grp AND g.m = mm.n GROUP BY ALL"""))
def monthly_group_histogram(spark, sf):
    return reshape.monthly_group_histogram(classify.classified_income(lens.budget(spark, sf)))


# ---------------------------------------------------------------- scope

@query("income_scope", o.sql("""SELECT source_row, y AS "Ejercicio", code AS "Cod Municipio", grp AS grupo_ingreso, px AS "Percibidopag Total"
  FROM g WHERE lower(trim(region)) = 'asia' AND y IN (2006, 2009, 2010)"""))
def income_scope(spark, sf):
    rows = scope.build_municipal_income_scope(lens.budget(spark, sf), region=" Asia ", years=[2006, 2009, 2010])
    return rows.select("source_row", YEAR, CODE, GROUP, "Percibidopag Total")


@query("entity_filter", o.sql("""SELECT source_row, y AS "Ejercicio", code AS "Cod Municipio", px AS "Percibidopag Total" FROM raw WHERE code IN (4, 9, 13)"""))
def entity_filter(spark, sf):
    rows = scope.filter_entities(lens.typed_rows(spark, sf), ["Nation-4", 9, "nation 13"], require_all=True)
    return rows.select("source_row", YEAR, CODE, "Percibidopag Total")


@query("entity_filter_income", o.sql("""SELECT source_row, y AS "Ejercicio", name AS "Nombre Municipio", px AS "Percibidopag Total" FROM g
  WHERE code = 2 AND y IN (2005, 2011)"""))
def entity_filter_income(spark, sf):
    rows = scope.filter_municipality_income(lens.budget(spark, sf), municipality="NATION_2", years=[2005, 2011])
    return rows.select("source_row", YEAR, NAME, "Percibidopag Total")


@query("entity_one", o.sql("""SELECT source_row, code AS "Cod Municipio", 'nombre' AS por FROM raw WHERE code = 4
  UNION ALL SELECT source_row, code, 'código' FROM raw WHERE code = 9 UNION ALL SELECT source_row, code, 'todo' FROM raw WHERE code = 13"""))
def entity_one(spark, sf):
    """One municipality by a spelling of its name, by its code, and all of them for no choice."""
    rows = lens.typed_rows(spark, sf)
    chosen = [(scope.filter_entity(rows, " Nation-4 "), "nombre"), (scope.filter_entity(rows, 9), "código"), (scope.filter_entity(rows, None).filter(F.col(CODE) == 13), "todo")]
    parts = [df.select("source_row", CODE, F.lit(how).alias("por")) for df, how in chosen]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("entity_semi", o.sql("""SELECT source_row, code AS "Cod Municipio" FROM raw WHERE region = 'EUROPE' OR code % 7 = 0"""))
def entity_semi(spark, sf):
    places = lens.municipalities(spark, sf)
    listed = places.filter(F.col(REGION) == "EUROPE").select(text.name_key(F.col(NAME)).alias("_name"), F.lit(None).cast("bigint").alias("_code"))
    listed = listed.unionByName(places.filter(F.col(CODE) % 7 == 0).select(F.lit(None).cast("string").alias("_name"), F.col(CODE).alias("_code")))
    return scope.entity_semi(lens.typed_rows(spark, sf), listed).select("source_row", CODE)


@query("entity_missing", o.sql("""SELECT CAST(n AS VARCHAR) AS solicitado FROM (SELECT r_name AS n FROM region UNION ALL SELECT n_name FROM nation
  UNION ALL SELECT CAST(n_nationkey * 2 AS VARCHAR) FROM nation)
  WHERE n NOT IN (SELECT name FROM raw) AND n NOT IN (SELECT CAST(code AS VARCHAR) FROM raw)"""))
def entity_missing(spark, sf):
    """Of all regions, nations and doubled nation codes, those that no row has."""
    names = [r[0] for t, c in (("region", "r_name"), ("nation", "n_name")) for r in lens.table(spark, sf, t).select(c).collect()]
    codes = [2 * r[0] for r in lens.table(spark, sf, "nation").select("n_nationkey").collect()]
    lost = scope.missing_entities(lens.typed_rows(spark, sf), [*names, *codes])
    return staging.literal_rows(spark, [(str(x),) for x in lost], "solicitado string")


@query("resolve_entity", o.sql("""SELECT DISTINCT lower(name) || ' ' AS solicitado, code AS "Cod Municipio", name AS "Nombre Municipio" FROM raw"""))
def resolve_entity(spark, sf):
    wanted = lens.municipalities(spark, sf).select(F.concat(F.lower(NAME), F.lit(" ")).alias(NAME))
    return scope.resolve_entities(lens.typed_rows(spark, sf), wanted)


# ---------------------------------------------------------------- classification

@query("classify_keys", o.sql(f"""SELECT source_row, y AS "Ejercicio", subt AS "Cod Subtítulo", suba AS "Cod Subasignación",
  (tipo = 1 AND serv = 1) AS tiene_clave, (tipo = 1 AND serv = 1 AND {o._keys(rules.IPP_KEYS)}) AS es_ipp,
  (tipo = 1 AND serv = 1 AND {o._keys(rules.FCM_KEYS)}) AS es_fcm, CASE WHEN tipo = 1 AND serv = 1 THEN {o.MODERN} END AS grupo FROM raw"""))
def classify_keys(spark, sf):
    rows = lens.typed_rows(spark, sf)
    known = rows.columns
    return rows.select("source_row", YEAR, SUBTITLE, SUBASSIGNMENT,
                       classify.income_key(known).isNotNull().alias("tiene_clave"), classify.is_ipp(known).alias("es_ipp"),
                       classify.is_fcm(known).alias("es_fcm"), classify.income_group(known).alias("grupo"))


@query("classify_rows", o.sql("""SELECT source_row, y AS "Ejercicio", grp AS grupo_ingreso_canonico, status AS income_mapping_status,
  method AS income_mapping_method FROM cl"""))
def classify_rows(spark, sf):
    return lens.budget(spark, sf).select("source_row", YEAR, "grupo_ingreso_canonico", "income_mapping_status", "income_mapping_method")


@query("classify_rules_dated", o.sql("""SELECT source_row, y AS "Ejercicio", dated AS grupo FROM txt"""))
def classify_rules_dated(spark, sf):
    ruled = classify.with_dated_rule(
        lens.typed_rows(spark, sf), lens.crosswalk(spark), YEAR, F.col(SUBTITLE), F.col("Cod Ítem"))
    return ruled.select("source_row", YEAR, F.col("_dated_group").alias("grupo"))


DOC_UPPER = "upper(strip_accents(replace(replace(text, 'ß', 'SS'), '…', '...')))"


@query("classify_text", f"""SELECT doc_id, regexp_matches(t, {o._text(rules.LEGACY_FCM_PATTERN)}) AS fcm, regexp_matches(t, {o._text(rules.LEGACY_IPP_PATTERN)}) AS ipp,
  regexp_matches(t, {o._text(rules.LEGACY_CAPITAL_PATTERN)}) AS capital FROM (SELECT doc_id, {DOC_UPPER} AS t FROM documents)""")
def classify_text(spark, sf):
    folded = lens.spread_table(spark, sf, "documents", "doc_id").select("doc_id", text.accent_free_upper(F.col("text")).alias("t"))
    return folded.select("doc_id", F.col("t").rlike(rules.LEGACY_FCM_PATTERN).alias("fcm"),
                         F.col("t").rlike(rules.LEGACY_IPP_PATTERN).alias("ipp"), F.col("t").rlike(rules.LEGACY_CAPITAL_PATTERN).alias("capital"))


PHRASES = ("Fondo Común Municipal", "F.C.M.", "Patente municipal", "Patentes Municipales", "Licencia de Conducir", "Mejoramiento de Barrios", "Pavimentación", "Multas e Intereses")
PHRASED = "text || ' ' || " + f"{list(PHRASES)}[doc_id % {2 * len(PHRASES)} + 1]"
DOC_PHRASED = DOC_UPPER.replace("replace(text,", f"replace(coalesce({PHRASED}, text),")


@query("classify_phrases", f"""SELECT doc_id, regexp_matches(t, {o._text(rules.LEGACY_FCM_PATTERN)}) AS fcm, regexp_matches(t, {o._text(rules.LEGACY_IPP_PATTERN)}) AS ipp,
  regexp_matches(t, {o._text(rules.LEGACY_CAPITAL_PATTERN)}) AS capital FROM (SELECT doc_id, {DOC_PHRASED} AS t FROM documents)""")
def classify_phrases(spark, sf):
    """The text patterns over texts half of which hold an account name."""
    phrase = F.get(F.array(*[F.lit(p) for p in PHRASES]), (F.col("doc_id") % (2 * len(PHRASES))).cast("int"))
    whole = F.coalesce(F.concat("text", F.lit(" "), phrase), F.col("text"))
    folded = lens.spread_table(spark, sf, "documents", "doc_id").select("doc_id", text.accent_free_upper(whole).alias("t"))
    return folded.select("doc_id", F.col("t").rlike(rules.LEGACY_FCM_PATTERN).alias("fcm"),
                         F.col("t").rlike(rules.LEGACY_IPP_PATTERN).alias("ipp"), F.col("t").rlike(rules.LEGACY_CAPITAL_PATTERN).alias("capital"))


DOC_FOLD = r"strip_accents(replace(replace(lower(regexp_replace(text, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), 'ß', 'ss'), '…', '...'))"


@query("name_keys", rf"""SELECT doc_id, md5(f) AS forma, md5(upper(regexp_replace(f, '[^a-z0-9]+', '', 'g'))) AS clave,
  md5(trim(regexp_replace(f, '[\s\p{{Z}}]+', ' ', 'g'))) AS lugar FROM (SELECT doc_id, {DOC_FOLD} AS f FROM documents)""")
def name_keys(spark, sf):
    """Texts that hardly repeat: folded where they stand, once for all three keys."""
    folded = lens.spread_table(spark, sf, "documents", "doc_id").select("doc_id", text.name_form(F.col("text")).alias("form"))
    return folded.select(
        "doc_id", F.md5("form").alias("forma"), F.md5(text.key_of_form(F.col("form"))).alias("clave"), F.md5(text.place_of_form(F.col("form"))).alias("lugar"))


@query("name_words", rf"""SELECT doc_id, CAST(len(list_distinct(list_filter(string_split(regexp_replace(f, '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> ''))) AS BIGINT) AS palabras
  FROM (SELECT doc_id, {DOC_FOLD} AS f FROM documents)""")
def name_words(spark, sf):
    return lens.spread_table(spark, sf, "documents", "doc_id").select("doc_id", F.size(text.word_set(F.col("text"))).cast("bigint").alias("palabras"))


ROW_FOLD = "strip_accents(lower({}))"


@query("account_name_keys", o.sql(f"""SELECT source_row, {ROW_FOLD.format("suba_name")} AS forma, upper(regexp_replace({ROW_FOLD.format("suba_name")}, '[^a-z0-9]+', '', 'g')) AS clave,
  {ROW_FOLD.format("item_name")} AS lugar, list_sort(list_distinct(string_split(regexp_replace({ROW_FOLD.format("asig_name")}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '))) AS palabras,
  'NOMBRE ' || upper(strip_accents(subt_name)) AS mayusculas, CASE WHEN ln % 3 <> 0 THEN upper(regexp_replace(lower(name), '[^a-z0-9]+', '', 'g')) ELSE '' END AS municipio FROM raw"""))
def account_name_keys(spark, sf):
    """The names of every budget row, each distinct name folded once."""
    rows = lens.typed_rows(spark, sf).select(
        "source_row", "Nombre Subasignación", "Nombre Ítem", "Nombre Asignación", "Nombre Subtítulo",
        F.when(F.col("l_linenumber") % 3 != 0, F.col(NAME)).alias(NAME))
    named = ["Nombre Subasignación", "Nombre Ítem", "Nombre Asignación", "Nombre Subtítulo", NAME]
    forms = dictionary.text_dictionary(rows, named, dictionary.NAME_FORMS)
    found = dictionary.with_forms(rows, forms, {
        "forma": (named[0], "forma"), "clave": (named[0], "clave"), "lugar": (named[1], "lugar"), "palabras": (named[2], "palabras"),
        "alto": (named[3], "mayusculas"), "municipio": (NAME, "clave")}, {"clave": ""})
    return found.select("source_row", "forma", "clave", "lugar", F.array_sort("palabras").alias("palabras"),
                        F.concat(F.lit("NOMBRE "), F.col("alto")).alias("mayusculas"), "municipio")


# ---------------------------------------------------------------- harmonising

@query("code_parse", o.sql("""SELECT source_row, y AS "Ejercicio", tipo, suba AS codigo, CASE WHEN ln % 3 = 0 THEN NULL ELSE asig END AS asignacion,
  CASE WHEN ln % 3 = 0 THEN px END AS total FROM raw"""))
def code_parse(spark, sf):
    codes = {YEAR: YEAR, "Cod Tipo Cuenta": "tipo", "Cod Subasignacion": "codigo", "Cod Asignacion": "asignacion"}
    parsed = numeric.parse_codes(lens.raw_layout(spark, sf), list(codes))
    return parsed.select("source_row", *[F.col(c).alias(n) for c, n in codes.items()], numeric.to_number("Percibidopag Acum").alias("total"))


SERVICE_SQL = "CASE WHEN ls = 'F' THEN 1 WHEN ln % 3 = 0 THEN 3 WHEN ln % 3 = 1 THEN 2 END"
LEGACY = "CASE WHEN y >= 2008 THEN {} END"


@query("harmonise", o.sql(f"""SELECT source_row, 'budget_' || y || '.csv' AS source_file, y AS "Ejercicio", region AS "Región",
  tipo AS "Cod Tipo Cuenta", CASE tipo WHEN 1 THEN 'INGRESOS' ELSE 'GASTOS' END AS "Nombre Tipo Cuenta",
  CAST({SERVICE_SQL} AS BIGINT) AS "Cod Serv Incorporado", CASE WHEN ls = 'F' OR ln % 3 <> 2 THEN 'mapped_by_name' ELSE 'unmapped' END AS service_mapping_status,
  CAST(0 AS BIGINT) AS "Cod Subárea", CASE WHEN ln % 3 = 1 THEN 'Central' ELSE 'Sin Subárea' END AS "Nombre Subárea",
  {LEGACY.format('subt')} AS "Cod Subtítulo", {LEGACY.format('suba')} AS "Cod Subasignación", {LEGACY.format('asig_name')} AS "Nombre Asignación",
  CAST(subt AS VARCHAR) AS source_cod_subtitulo, CASE WHEN ln % 3 = 1 THEN qty + 10 ELSE qty END AS "Ppto Actualizado", px AS "Percibidopag Total",
  CASE WHEN disc > 0.02 THEN px END AS "Devengado Total", CASE WHEN y < 2008 THEN 'legacy_pre_2008' ELSE 'modern_2008_plus' END AS source_schema_version,
  grp AS grupo_ingreso_canonico, method AS income_mapping_method FROM cl"""))
def harmonise_rows(spark, sf):
    rows = harmonise.normalize_layout(lens.raw_layout(spark, sf), lens.crosswalk(spark))
    return rows.select(
        "source_row", "source_file", YEAR, REGION, "Cod Tipo Cuenta", "Nombre Tipo Cuenta", "Cod Serv Incorporado", "service_mapping_status",
        "Cod Subárea", "Nombre Subárea", SUBTITLE, SUBASSIGNMENT, "Nombre Asignación",
        F.trim("source_cod_subtitulo").alias("source_cod_subtitulo"), "Ppto Actualizado", "Percibidopag Total", "Devengado Total",
        "source_schema_version", "grupo_ingreso_canonico", "income_mapping_method")


@query("service_map", o.sql(f"""SELECT CAST({SERVICE_SQL} AS BIGINT) AS codigo,
  CASE WHEN ls = 'F' THEN 'Gestión Municipal' WHEN ln % 3 = 0 THEN 'Salud' WHEN ln % 3 = 1 THEN 'Educación' ELSE 'Bienestar' END AS servicio,
  CASE WHEN ls = 'F' OR ln % 3 <> 2 THEN 'mapped_by_name' ELSE 'unmapped' END AS estado, count(*) AS filas FROM raw GROUP BY ALL"""))
def service_map(spark, sf):
    raw = lens.raw_layout(spark, sf).select(
        F.lit(None).cast("bigint").alias("Cod Serv Incorporado"), F.col("Nombre Servicio").alias("Nombre Serv Incorporado"))
    return harmonise.map_services(raw).groupBy(
        F.col("Cod Serv Incorporado").alias("codigo"), F.col("Nombre Serv Incorporado").alias("servicio"),
        F.col("service_mapping_status").alias("estado")).agg(F.count(F.lit(1)).alias("filas"))


@query("account_type", o.sql("""SELECT tipo AS "Cod Tipo Cuenta", CASE tipo WHEN 1 THEN 'INGRESOS' ELSE 'GASTOS' END AS "Nombre Tipo Cuenta", count(*) AS filas FROM raw GROUP BY ALL"""))
def account_type(spark, sf):
    rows = lens.typed_rows(spark, sf).withColumn("Nombre Tipo Cuenta", F.lit("?"))
    return harmonise.account_type_names(rows).groupBy("Cod Tipo Cuenta", "Nombre Tipo Cuenta").agg(F.count(F.lit(1)).alias("filas"))


@query("legacy_blank", o.sql(f"""SELECT source_row, y AS "Ejercicio", {LEGACY.format('subt')} AS "Cod Subtítulo", {LEGACY.format('item_name')} AS "Nombre Ítem",
  {LEGACY.format('suba')} AS "Cod Subasignación" FROM raw"""))
def legacy_blank(spark, sf):
    return harmonise.blank_legacy_accounts(lens.typed_rows(spark, sf)).select("source_row", YEAR, SUBTITLE, "Nombre Ítem", SUBASSIGNMENT)


@query("catalog_build", o.sql("""SELECT DISTINCT code AS "Cod Municipio", name AS "Nombre Municipio", region AS "Región",
  replace(name, '_', '') AS municipality_key FROM raw WHERE y = 2011"""))
def catalog_build(spark, sf):
    return harmonise.build_municipality_catalog(lens.typed_rows(spark, sf), year=2011)


@query("catalog_apply", o.sql("""SELECT source_row, CASE WHEN code = 6 AND false THEN NULL ELSE code END AS "Cod Municipio", name AS "Nombre Municipio",
  region AS "Región", CASE WHEN code = 21 THEN 'matched_by_alias' WHEN ln % 3 = 2 THEN 'canonical_code' ELSE 'matched_by_name' END AS municipality_mapping_status
  FROM raw WHERE code <> 6
  UNION ALL SELECT source_row, CASE WHEN ln % 3 = 2 THEN code ELSE code + 100 END, CASE ln % 3 WHEN 0 THEN lower(name) WHEN 1 THEN replace(name, '_', '-') ELSE name END,
  region, 'unmapped' FROM raw WHERE code = 6"""))
def catalog_apply(spark, sf):
    rows = harmonise.normalize_layout(lens.raw_layout(spark, sf))
    places = lens.municipalities(spark, sf).filter(F.col(CODE) != 6).withColumn(
        "municipality_key", F.when(F.col(CODE) == 21, "VEINTIUNO").otherwise(text.name_key(F.col(NAME))))
    return harmonise.apply_municipality_catalog(rows, places, {"NATION21": "VEINTIUNO"}).select(
        "source_row", CODE, NAME, REGION, "municipality_mapping_status")


@query("quality_report", o.sql("""SELECT 'budget_' || y || '.csv' AS source_file, count(*) AS rows, CAST(y AS VARCHAR) AS years,
  CASE WHEN y < 2008 THEN 'legacy_pre_2008' ELSE 'modern_2008_plus' END AS source_schema_version,
  'Ppto Actualizado, Devengado Total, Percibidopag Total, Porpercibir Total' AS derived_total_columns,
  count(*) FILTER (WHERE grp IS NOT NULL) AS mapped_income_rows, count(*) FILTER (WHERE status = 'review') AS review_income_rows,
  CAST(0 AS BIGINT) AS missing_income_group_rows, count(*) FILTER (WHERE code = 6) AS unmapped_municipality_rows,
  count(*) FILTER (WHERE ls = 'O' AND ln % 3 = 2) AS unmapped_service_rows, CAST(0 AS BIGINT) AS missing_account_type_rows,
  CAST(0 AS BIGINT) AS missing_collected_total_rows FROM cl GROUP BY y"""))
def quality_report(spark, sf):
    rows = harmonise.normalize_layout(lens.raw_layout(spark, sf), lens.crosswalk(spark), keep_filled=True)
    places = lens.municipalities(spark, sf).filter(F.col(CODE) != 6).withColumn("municipality_key", text.name_key(F.col(NAME)))
    return quality.validate_normalized(harmonise.apply_municipality_catalog(rows, places), strict=False)


@query("quality_problems", o.sql("""SELECT 'budget_' || y || '.csv' AS source_file, count(*) FILTER (WHERE code = 6) || ' rows without a canonical municipality, such as '
  || array_to_string(list_sort(list_distinct(list(CASE WHEN code = 6 THEN CASE ln % 3 WHEN 0 THEN ' ' || lower(name) WHEN 1 THEN replace(name, '_', '-') ELSE name END END)
    FILTER (WHERE code = 6)))[1:5], ', ') AS problema
  FROM raw GROUP BY y HAVING count(*) FILTER (WHERE code = 6) > 0"""))
def quality_problems(spark, sf):
    rows = harmonise.normalize_layout(lens.raw_layout(spark, sf), lens.crosswalk(spark))
    places = lens.municipalities(spark, sf).filter(F.col(CODE) != 6).withColumn("municipality_key", text.name_key(F.col(NAME)))
    return quality.report_problems(quality.normalization_report(harmonise.apply_municipality_catalog(rows, places)))


@query("quality_strict", o.sql("""SELECT 'budget_' || y || '.csv' AS source_file, problema FROM (
    SELECT y, 'unexpected canonical schema version' AS problema FROM raw WHERE y = 2005
    UNION SELECT y, count(*) || ' municipal income rows without a group' FROM cl WHERE tipo = 1 AND serv = 1 AND y = 2006 GROUP BY y
    UNION SELECT y, count(*) || ' rows without a canonical municipality, such as ' || min(name) FROM raw WHERE y = 2009 AND code = 6 GROUP BY y
    UNION SELECT y, 'no account type codes' FROM raw WHERE y = 2007
    UNION SELECT y, 'no collected amounts' FROM raw WHERE y = 2008)"""))
def quality_strict(spark, sf):
    """All five strict rules, each broken by one source."""
    rows = lens.budget(spark, sf)
    broken = {
        "canonical_schema_version": ((F.col(YEAR) == 2005), "0"), "grupo_ingreso_canonico": ((F.col(YEAR) == 2006), None),
        "Cod Tipo Cuenta": ((F.col(YEAR) == 2007), None), "Percibidopag Total": ((F.col(YEAR) == 2008), None),
        "municipality_mapping_status": ((F.col(YEAR) == 2009) & (F.col(CODE) == 6), "unmapped"),
    }
    fixed = {"canonical_schema_version": F.lit(harmonise.SCHEMA_VERSION), "municipality_mapping_status": F.lit("canonical_code")}
    spoilt = rows.withColumns({c: F.when(when, F.lit(value)).otherwise(fixed.get(c, F.col(c) if c in rows.columns else F.lit(None))) for c, (when, value) in broken.items()})
    return quality.report_problems(quality.normalization_report(spoilt.transform(harmonise.apply_contract)))


# ---------------------------------------------------------------- joins

@query("checked_join", """SELECT o_orderkey, o_custkey, c_nationkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey""")
def checked_join(spark, sf):
    orders = lens.table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("k"))
    customer = lens.table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey", "c_mktsegment")
    return staging.checked_join(orders, customer, "k", "left", "many_to_one").withColumnRenamed("k", "o_custkey")


@query("duplicate_keys", """SELECT l_orderkey, l_linenumber, count(*) AS filas FROM lineitem GROUP BY ALL HAVING count(*) > 1""")
def duplicate_keys(spark, sf):
    return staging.duplicate_keys(lens.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


# ---------------------------------------------------------------- variability

def _variability(spark, sf):
    return variability.other_income_variability(lens.budget(spark, sf), start_year=2008, names=_names(spark, sf))


@query("variability_ranking", o.sql("""SELECT code AS "Cod Municipio", name AS "Nombre Municipio", subt AS "Cod Subtítulo", suba AS "Cod Subasignación",
  round(mad, 4) AS variacion_promedio_abs_s1_s2, round(md, 4) AS diferencia_promedio_s1_s2, mx AS variacion_maxima_abs_s1_s2, tot AS ingreso_total,
  acc_code AS codigo_cuenta, cuenta, rk AS ranking_variabilidad, round(mad / CASE WHEN whole = 0 THEN 1 ELSE whole END * 100, 6) AS participacion_variabilidad,
  rk <= 6 AS seleccionada FROM va""", o.ACCOUNTS))
def variability_ranking(spark, sf):
    ranking = _variability(spark, sf)[1]
    return rounded(rounded(ranking, "variacion_promedio_abs_s1_s2", "diferencia_promedio_s1_s2", places=4), "participacion_variabilidad")


@query("variability_breakdown", o.sql(f"""SELECT code AS "Cod Municipio", name AS "Nombre Municipio", y AS "Ejercicio", CAST(s AS BIGINT) AS "Semestre",
  y || ' S' || s AS "Periodo", comp AS componente, ord AS orden_componente, CAST(amt AS DOUBLE) AS ingreso_semestral, CAST(total AS DOUBLE) AS total_otros_ingresos,
  {o.share_sql(zero='NULL')} AS participacion_otros_ingresos FROM bd""", o.ACCOUNTS))
def variability_breakdown(spark, sf):
    return rounded(_variability(spark, sf)[0], "participacion_otros_ingresos")


@query("variability_one", o.sql("""SELECT rk AS ranking_variabilidad, acc_code AS codigo_cuenta, cuenta, tot AS ingreso_total, rk <= 3 AS seleccionada FROM va WHERE code = 8""", o.ACCOUNTS))
def variability_one(spark, sf):
    ranking = variability.analyze_other_income_semester_variability(
        lens.budget(spark, sf), municipality="Nation_8", start_year=2008, top_n=3)[1]
    return ranking.select("ranking_variabilidad", "codigo_cuenta", "cuenta", "ingreso_total", "seleccionada")


@query("account_labels", o.sql("""SELECT code AS "Cod Municipio", subt AS "Cod Subtítulo", suba AS "Cod Subasignación", acc_code AS codigo_cuenta, cuenta FROM lb""", o.ACCOUNTS))
def account_labels(spark, sf):
    ranking = _variability(spark, sf)[1]
    return ranking.select(CODE, SUBTITLE, SUBASSIGNMENT, "codigo_cuenta", "cuenta")


@query("variability_left_out", o.sql("""SELECT y AS "Ejercicio", count(*) FILTER (WHERE y < 2008) AS sin_cuenta, CAST(0 AS BIGINT) AS sin_municipio
  FROM g WHERE grp = 'Otros ingresos' GROUP BY y"""))
def variability_left_out(spark, sf):
    return variability.accounts_left_out(lens.budget(spark, sf))


@query("ranked_null_keys", """SELECT k, p_partkey, row_number() OVER (PARTITION BY k ORDER BY p_retailprice DESC, p_partkey) AS puesto, count(*) OVER (PARTITION BY k) AS partes
  FROM (SELECT CASE WHEN p_size > 20 THEN p_type END AS k, p_partkey, p_retailprice FROM part)""")
def ranked_null_keys(spark, sf):
    """A null key is a key: its rows are ranked and counted like any others."""
    parts = lens.table(spark, sf, "part").select(F.when(F.col("p_size") > 20, F.col("p_type")).alias("k"), "p_partkey", "p_retailprice")
    order = [F.col("p_retailprice").desc(), F.col("p_partkey").asc()]
    ranked = rank_ops.spread_row_number(parts, ["k"], order, "puesto").drop("p_retailprice")
    return staging.with_group_values(ranked, ["k"], partes=F.count(F.lit(1)))


@query("ranked_parts", """SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice DESC, p_partkey) AS puesto FROM part""")
def ranked_parts(spark, sf):
    parts = lens.table(spark, sf, "part").select("p_type", "p_partkey", "p_retailprice")
    order = [F.col("p_retailprice").desc(), F.col("p_partkey").asc()]
    return rank_ops.spread_row_number(parts, ["p_type"], order, "puesto").drop("p_retailprice")


# ---------------------------------------------------------------- profiles

def _profile(spark, sf):
    return profiles.build_municipality_income_profile(classify.classified_income(lens.budget(spark, sf)))


PROFILE_SELECT = ", ".join(
    [f'g{i} AS "{g}"' for i, g in enumerate(INCOME_GROUPS)] + [f'round(s{i}, 6) AS "{profiles.share_column(g)}"' for i, g in enumerate(INCOME_GROUPS)])


@query("profile", o.sql(f'SELECT name AS "Nombre Municipio", {PROFILE_SELECT}, tot AS ingreso_total_clp FROM pf', o.PROFILE))
def profile(spark, sf):
    return rounded(_profile(spark, sf), *profiles.SHARES)


@query("profile_ready", o.sql(f'SELECT name AS "Nombre Municipio", {PROFILE_SELECT}, tot AS ingreso_total_clp, listo FROM pf CROSS JOIN (VALUES (true), (false)) v(listo)', o.PROFILE))
def profile_ready(spark, sf):
    """Classified rows and a finished profile are both taken."""
    income = classify.classified_income(lens.budget(spark, sf))
    made = staging.stage(profiles.ensure_municipality_income_profile(income))
    both = made.withColumn("listo", F.lit(False)).unionByName(profiles.ensure_municipality_income_profile(made).withColumn("listo", F.lit(True)))
    return rounded(both, *profiles.SHARES)


@query("profile_problems", o.sql("""SELECT problema, filas FROM (
    SELECT 'row without a municipality name' AS problema, count(*) FILTER (WHERE ln = 6) AS filas FROM g
    UNION ALL SELECT 'row without a known income group', count(*) FILTER (WHERE ln = 5) FROM g
    UNION ALL SELECT 'income that is null or no number', count(*) FILTER (WHERE disc = 0.05) FROM g
    UNION ALL SELECT 'negative group amount', count(*) FROM (SELECT name, grp FROM g WHERE ln NOT IN (5, 6) AND disc <> 0.05 AND code % 5 = 0 AND grp = 'FCM' GROUP BY ALL)
    UNION ALL SELECT 'income total is not positive', count(*) FROM (SELECT name FROM g WHERE ln NOT IN (5, 6) AND disc <> 0.05 GROUP BY name
      HAVING sum(CASE WHEN code % 5 = 0 AND grp = 'FCM' THEN -100 * amt ELSE amt END) <= 0)) WHERE filas > 0"""))
def profile_problems(spark, sf):
    """Every check of a profile, over rows that break it."""
    income = classify.classified_income(lens.budget(spark, sf))
    amount = F.col("Percibidopag Total")
    spoilt = income.select(
        F.when(F.col("l_linenumber") == 6, " ").otherwise(F.col(NAME)).alias(NAME), F.when(F.col("l_linenumber") == 5, "Nada").otherwise(F.col(GROUP)).alias(GROUP),
        F.when(F.col("l_discount") == 0.05, None).when((F.col(CODE) % 5 == 0) & (F.col(GROUP) == "FCM"), -100 * amount).otherwise(amount).alias("Percibidopag Total"))
    return profiles.profile_problems(spoilt)


@query("profile_order", o.sql('SELECT name AS "Nombre Municipio", row_number() OVER (ORDER BY s3 DESC, s4 DESC, name) AS orden FROM pf', o.PROFILE))
def profile_order(spark, sf):
    order = profiles.share_order(["IPP", "FCM"])
    return rank_ops.spread_row_number(_profile(spark, sf), [], order, "orden").select(NAME, "orden")


@query("amount_order", o.sql('SELECT name AS "Nombre Municipio", tot AS ingreso_total_clp FROM pf ORDER BY tot DESC, name', o.PROFILE))
def amount_order(spark, sf):
    return profiles.sort_municipalities_by_total(_profile(spark, sf)).select(NAME, profiles.TOTAL)


@query("clr", o.sql('SELECT name AS "Nombre Municipio", ' + ", ".join(f'round(clr[{i + 1}], 6) AS clr{i}' for i in range(5)) + " FROM cf", o.PROFILE))
def clr(spark, sf):
    features = profiles.clr_features(_profile(spark, sf))
    return features.select(NAME, *[F.round(F.col("clr")[i], 6).alias(f"clr{i}") for i in range(5)])


# ---------------------------------------------------------------- vectors and clusters

def _vectors(spark, sf) -> DataFrame:
    return lens.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


SILHOUETTE = f"""{o.EMB}, d AS (SELECT a.id, a.label, b.label AS other, sum(list_distance(a.v, b.v)) AS s, count(*) AS n
  FROM e a JOIN e b ON a.id <> b.id GROUP BY ALL),
  r AS (SELECT id, label, max(CASE WHEN label = other THEN s / n END) AS a, min(CASE WHEN label <> other THEN s / n END) AS b FROM d GROUP BY ALL),
  sil AS (SELECT id, label, CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM r)"""


@query("silhouette", f"WITH {SILHOUETTE} SELECT id, label, round(s, 6) AS silhouette FROM sil")
def silhouette(spark, sf):
    return rounded(pairwise.silhouette_rows(_vectors(spark, sf)), "silhouette")


@query("silhouette_mean", f"WITH {SILHOUETTE} SELECT round(avg(s), 6) AS silhouette FROM sil")
def silhouette_mean(spark, sf):
    return rounded(clusters.mean_silhouette(_vectors(spark, sf)), "silhouette")


@query("silhouette_squared", f"""WITH {o.EMB}, d AS (SELECT a.id, a.label, b.label AS other, sum(list_distance(a.v, b.v) ** 2) AS s, count(*) AS n
  FROM e a JOIN e b ON a.id <> b.id GROUP BY ALL),
  r AS (SELECT id, label, max(CASE WHEN label = other THEN s / n END) AS a, min(CASE WHEN label <> other THEN s / n END) AS b FROM d GROUP BY ALL)
  SELECT id, label, round((b - a) / greatest(a, b), 6) AS silhouette FROM r""")
def silhouette_squared(spark, sf):
    return rounded(pairwise.squared_silhouette_rows(_vectors(spark, sf)), "silhouette")


CENTROIDS = f"""{o.EMB}, x AS (SELECT id, label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS dim FROM e),
  c AS (SELECT label, dim, avg(x) AS m, count(*) AS n FROM x GROUP BY ALL), gm AS (SELECT dim, avg(x) AS m FROM x GROUP BY ALL)"""


@query("calinski", f"""WITH {CENTROIDS} SELECT round((SELECT sum(c.n * (c.m - gm.m) ** 2) FROM c JOIN gm USING (dim))
  / (SELECT sum((x.x - c.m) ** 2) FROM x JOIN c USING (label, dim)) * ((SELECT count(*) FROM e) - (SELECT count(DISTINCT label) FROM e))
  / ((SELECT count(DISTINCT label) FROM e) - 1), 6) AS calinski_harabasz""")
def calinski(spark, sf):
    return rounded(clusters.calinski_harabasz(_vectors(spark, sf)), "calinski_harabasz")


@query("davies", f"""WITH {CENTROIDS}, s AS (SELECT label, avg(dd) AS s FROM (SELECT x.id, x.label, sqrt(sum((x.x - c.m) ** 2)) AS dd
  FROM x JOIN c USING (label, dim) GROUP BY x.id, x.label) GROUP BY label),
  p AS (SELECT a.label AS i, b.label AS j, sqrt(sum((a.m - b.m) ** 2)) AS d FROM c a JOIN c b ON a.dim = b.dim AND a.label <> b.label GROUP BY ALL)
  SELECT round(avg(w), 6) AS davies_bouldin FROM (SELECT i, max((si.s + sj.s) / d) AS w FROM p JOIN s si ON si.label = i JOIN s sj ON sj.label = j GROUP BY i)""")
def davies(spark, sf):
    return rounded(clusters.davies_bouldin(_vectors(spark, sf)), "davies_bouldin")


@query("nearest", f"""WITH {o.EMB} SELECT id, vecino, round(d, 6) AS distancia, puesto FROM (SELECT a.id, b.id AS vecino, list_distance(a.v, b.v) AS d,
  row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) AS puesto FROM e a JOIN e b ON a.id <> b.id) WHERE puesto <= 5""")
def nearest(spark, sf):
    return rounded(pairwise.nearest_rows(_vectors(spark, sf), 5), "distancia")


@query("nearest_profiles", o.sql("""SELECT ref AS "Comuna de referencia", otra AS "Nombre Municipio", puesto AS "Ranking de similitud", round(d, 6) AS "Distancia CLR"
  FROM (SELECT a.name AS ref, b.name AS otra, list_distance(a.clr, b.clr) AS d, row_number() OVER (PARTITION BY a.name ORDER BY list_distance(a.clr, b.clr), b.name) AS puesto
  FROM cf a JOIN cf b ON a.name <> b.name) WHERE puesto <= 5""", o.PROFILE))
def nearest_profiles(spark, sf):
    return rounded(clusters.similar_municipalities(profiles.clr_features(_profile(spark, sf)), 5), "Distancia CLR")


def _analysis(spark, sf, **options) -> clusters.ClusterAnalysis:
    return clusters.cluster_municipalities_by_income_profile(_profile(spark, sf), **options)


def _ward(tail: str, counts=(2, 3, 4), requested: int | None = None) -> str:
    return o.sql(tail, o.PROFILE, *w.analysis(counts, requested))


CHOSEN = "FROM wk JOIN chosen USING (k) JOIN ss USING (k, id) JOIN wl USING (id) JOIN pf USING (name) JOIN cp USING (id)"
CLUSTER = "cluster_id, 'Clúster ' || cluster_id AS \"Clúster\""
AMOUNT = 'round(tot / 1e9, 11) AS "Ingreso total (mil MM CLP)"'
SIX = ("Silhouette", "CP1", "CP2")


@query("cluster_assign", _ward(f"""SELECT name AS "Nombre Municipio", {CLUSTER}, {AMOUNT}, round(sil, 6) AS "Silhouette",
  round(cp1, 6) AS "CP1", round(cp2, 6) AS "CP2" {CHOSEN}"""))
def cluster_assign(spark, sf):
    found = _analysis(spark, sf, cluster_counts=[2, 3, 4]).assignments
    return rounded(rounded(found, *SIX), "Ingreso total (mil MM CLP)", places=11)


@query("cluster_assign_requested", _ward(f"""SELECT name AS "Nombre Municipio", {CLUSTER}, round(sil, 6) AS "Silhouette" {CHOSEN}""", (2, 3), 5))
def cluster_assign_requested(spark, sf):
    """Five clusters asked for, which no candidate names: they are added and scored; all merges are done on Spark."""
    found = _analysis(spark, sf, cluster_counts=[2, 3], cluster_count=5, finish=2, block_rows=8).assignments
    return rounded(found.select(NAME, "cluster_id", "Clúster", "Silhouette"), "Silhouette")


@query("cluster_scores", _ward("""SELECT k AS "Número de clústeres", round(sil, 6) AS "Silhouette", round(ch, 6) AS "Calinski-Harabasz",
  round(db, 6) AS "Davies-Bouldin" FROM sco""", range(2, 7)))
def cluster_scores(spark, sf):
    return rounded(_analysis(spark, sf).cluster_validation_scores, "Silhouette", "Calinski-Harabasz", "Davies-Bouldin")


@query("cluster_years", o.sql("""SELECT name AS "Nombre Municipio", k, cluster_id FROM wk JOIN wl USING (id)""",
                              o.YEAR_PROFILE, w.merges(), w.CUTS.format(counts="2, 3, 4, 5, 6")))
def cluster_years(spark, sf):
    """Ward over the profile of every (municipality, year), numbered by the smallest name; fewer profiles than micro-centroids."""
    ids = _year_vectors(spark, sf)
    tree = clusters.ward_tree(ids, finish=64, block_rows=64, micro=clusters.MICRO)
    named = clusters.cut_tree(tree, range(2, 7)).join(ids, "id")
    firsts = named.groupBy("k", "label").agg(F.min(NAME).alias("first"))
    # at most six clusters of each cut
    place = F.dense_rank().over(Window.partitionBy("k").orderBy("first")).cast("bigint")
    return named.join(firsts.withColumn("cluster_id", place), ["k", "label"]).select(NAME, F.col("k").cast("bigint").alias("k"), "cluster_id")


def _year_vectors(spark, sf) -> DataFrame:
    rows = lens.budget(spark, sf).withColumn(NAME, F.concat(F.col(NAME), F.lit(" "), F.col(YEAR).cast("string")))
    features = profiles.clr_features(profiles.build_municipality_income_profile(classify.classified_income(rows)))
    return staging.stage(rank_ops.spread_row_number(features, [], [F.col(NAME).asc()], "id").withColumnRenamed("clr", "vec"))


@query("cluster_years_micro")
def cluster_years_micro(spark, sf):
    """Agreement (adjusted Rand index) of Ward over 64 weighted micro-centroids with exact Ward, over (municipality, year) profiles."""
    rows = _year_vectors(spark, sf)
    exact, micro = (clusters.cut_tree(clusters.ward_tree(rows, micro=m), [2, 4, 6]) for m in (None, 64))
    both = staging.stage(exact.withColumnRenamed("label", "uno").join(micro.withColumnRenamed("label", "otro"), ["id", "k"]))
    found = [clusters.label_agreement(both.filter(F.col("k") == k), "uno", "otro").select(F.lit(k).alias("k"), "acuerdo") for k in (2, 4, 6)]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("cluster_summary", o.sql(f"""SELECT cluster_id, 'Clúster ' || cluster_id AS "Clúster", count(*) AS "Número de comunas",
  round(median(tot) / 1e9, 11) AS "Ingreso total mediano (mil MM CLP)", {", ".join(f'round(avg(s{i}), 6) AS "{g}"' for i, g in enumerate(INCOME_GROUPS))}
  FROM (SELECT pf.*, CAST(n_regionkey + 1 AS BIGINT) AS cluster_id FROM pf JOIN nation ON n_name = name) GROUP BY cluster_id""", o.PROFILE))
def cluster_summary(spark, sf):
    given = lens.table(spark, sf, "nation").select(F.col("n_name").alias(NAME), (F.col("n_regionkey") + 1).cast("bigint").alias("cluster_id"))
    summary = clusters.cluster_summary(_profile(spark, sf).join(given, NAME))
    return rounded(rounded(summary, "Ingreso total mediano (mil MM CLP)", places=11), *INCOME_GROUPS)


@query("median_by_flag", """SELECT l_returnflag, median(l_extendedprice) AS mediana, median(CASE WHEN l_linenumber < 4 THEN l_quantity END) AS cantidad
  FROM lineitem GROUP BY l_returnflag""")
def median_by_flag(spark, sf):
    """Exact medians where one group holds half of all rows; quantities take few values."""
    rows = lens.spread_table(spark, sf, "lineitem", "l_orderkey").select(
        "l_returnflag", "l_extendedprice", F.when(F.col("l_linenumber") < 4, F.col("l_quantity")).alias("pocas"))
    amounts, counts = (medians.exact_median(rows, ["l_returnflag"], c, out) for c, out in (("l_extendedprice", "mediana"), ("pocas", "cantidad")))
    return amounts.join(counts, "l_returnflag")


@query("membership", """SELECT n_name AS comuna, """ + ", ".join(f"n_regionkey + 1 = {k} AS cluster{k}" for k in range(1, 6)) + " FROM nation")
def membership(spark, sf):
    given = lens.table(spark, sf, "nation").select(F.col("n_name").alias(NAME), (F.col("n_regionkey") + 1).cast("bigint").alias("cluster_id"))
    return clusters.cluster_membership(given, 5)


@query("cluster_members", "SELECT n_name AS comuna FROM nation WHERE n_regionkey = 1")
def cluster_members(spark, sf):
    return tables.cluster_members(membership(spark, sf), "cluster2")


@query("ward_labels")
def ward_labels(spark, sf):
    """Ward over all embeddings: every row with its label at two to six clusters."""
    return clusters.cut_tree(clusters.ward_tree(_vectors(spark, sf), finish=128), range(2, 7))


@query("pca", "WITH RECURSIVE " + o.EMB + ", wl AS (SELECT id, v FROM e), " + w.PCA + 'SELECT id, round(cp1, 6) AS "CP1", round(cp2, 6) AS "CP2" FROM cp')
def pca(spark, sf):
    return rounded(clusters.principal_components(_vectors(spark, sf))[0], "CP1", "CP2")


@query("similar_to_one", _ward("""SELECT 'NATION_4' AS "Comuna de referencia", l.name AS "Nombre Municipio", row_number() OVER (ORDER BY list_distance(l.v, t.v), l.name) AS "Ranking de similitud",
  round(list_distance(l.v, t.v), 6) AS "Distancia CLR", cluster_id, 'Clúster ' || cluster_id AS "Clúster", round(sil, 6) AS "Silhouette"
  FROM wl l JOIN wl t ON t.name = 'NATION_4' AND l.id <> t.id JOIN wk ON wk.id = l.id JOIN ss ON ss.k = wk.k AND ss.id = l.id
  QUALIFY row_number() OVER (ORDER BY list_distance(l.v, t.v), l.name) <= 4""", (3,)))
def similar_to_one(spark, sf):
    found = clusters.find_similar_municipalities(_analysis(spark, sf, cluster_counts=[3]), " nation_4 ", n_neighbors=4)
    return rounded(found, "Distancia CLR", "Silhouette")


# ---------------------------------------------------------------- maps and indices

def _places(spark, sf) -> DataFrame:
    """Nations as a map: the geometry text is derived from the keys."""
    shapes = lens.table(spark, sf, "nation").select(
        F.lit("7").alias("CUT_REG"), F.format_string("%05d", F.col("n_nationkey")).alias("CUT_COM"),
        F.concat(F.lit(" "), F.initcap("n_name")).alias("COMUNA"),
        F.format_string('{"type":"Point","coordinates":[%d,%d]}', F.col("n_nationkey"), F.col("n_regionkey")).alias("geometry"))
    return geography.region_places(shapes, region_code=7, expected_count=25)


@query("geography_read", """SELECT printf('%05d', n_nationkey) AS "CUT_COM", upper(n_name[1]) || lower(n_name[2:]) AS "COMUNA_DPA", lower(n_name) AS comuna_key FROM nation""")
def geography_read(spark, sf):
    """Places of one region out of a written attribute table that holds two."""
    folder = staging.scratch_path(spark, "places")
    shapes = lens.table(spark, sf, "nation").select(
        F.explode(F.array(F.lit("7"), F.lit("08"))).alias("CUT_REG"), F.format_string("%05d", F.col("n_nationkey")).alias("CUT_COM"),
        F.concat(F.lit(" "), F.initcap("n_name"), F.lit(" ")).alias("COMUNA"), F.format_string('{"a":"b,%d"}', F.col("n_nationkey")).alias("geometry"))
    shapes.write.option("header", True).option("escape", '"').csv(folder)
    return tables.load_municipality_geography(spark, folder, region_code=7, expected_count=25).select("CUT_COM", "COMUNA_DPA", geography.PLACE)


INDEX_SQL = """SELECT CAST(date_trunc('month', ts) AS DATE) AS fecha, CAST(count(*) AS DOUBLE) AS uf, CAST(count(DISTINCT user_id) AS DOUBLE) AS ivp,
  CASE WHEN month(min(ts)) % 4 <> 0 THEN max(value) END AS utm FROM events GROUP BY date_trunc('month', ts)"""


@query("index_series", INDEX_SQL)
def index_series(spark, sf):
    """Monthly series from a written file whose header stands on the third row, with gaps and a footnote."""
    monthly = lens.table(spark, sf, "events").groupBy(F.date_trunc("month", "ts").alias("t")).agg(
        F.count(F.lit(1)).alias("uf"), F.count_distinct("user_id").alias("ivp"), F.max("value").alias("utm"))
    text_of = F.concat_ws(",", F.date_format("t", "yyyy-MM-dd"), F.col("uf").cast("string"), F.col("ivp").cast("string"),
                          F.when(F.month("t") % 4 != 0, F.col("utm").cast("string")).otherwise("ND"))
    head = staging.literal_rows(spark, [(0, "Valores,,,"), (1, ",,,"), (2, ",".join(tables.INDEX_HEADERS)), (10**9, "Fuente: banco,,,")], "n int, value string")
    lines = monthly.select(F.months_between("t", F.lit("1900-01-01")).cast("int").alias("n"), text_of.alias("value"))
    path = staging.scratch_path(spark, "series")
    head.unionByName(lines).repartition(1).sortWithinPartitions("n").select("value").write.text(path)  # a row a month
    return tables.read_index_series(spark, path)


@query("membership_read", """SELECT n_name AS comuna, n_regionkey + 1 = 1 AS cluster1, n_regionkey + 1 = 2 AS cluster2, n_regionkey + 1 = 3 AS cluster3,
  n_regionkey + 1 = 4 AS cluster4, n_regionkey + 1 = 5 AS cluster5 FROM nation""")
def membership_read(spark, sf):
    """The membership matrix as it is exported, read back."""
    path = staging.scratch_path(spark, "membership")
    membership(spark, sf).write.option("header", True).csv(path)
    return tables.read_membership(spark, path)


@query("map_metrics", o.sql("""SELECT name AS "Nombre Municipio", tot AS ingreso_total_clp, round(tot - g3 - g4, 2) AS ingreso_no_ip_clp,
  round((tot - g3 - g4) / tot * 100, 6) AS porcentaje_no_ip FROM pf""", o.PROFILE))
def map_metrics(spark, sf):
    rows = geography.income_map_metrics(_profile(spark, sf)).select(NAME, profiles.TOTAL, "ingreso_no_ip_clp", "porcentaje_no_ip")
    return rounded(rounded(rows, "ingreso_no_ip_clp", places=2), "porcentaje_no_ip")


@query("map_join", o.sql("""SELECT lower(name) AS comuna_key, name AS "Nombre Municipio", printf('%05d', n_nationkey) AS "CUT_COM", tot AS ingreso_total_clp
  FROM pf JOIN nation ON n_name = name""", o.PROFILE))
def map_join(spark, sf):
    return geography.build_municipality_income_map_data(_profile(spark, sf), _places(spark, sf)).select(
        "comuna_key", NAME, "CUT_COM", profiles.TOTAL)


@query("map_unmatched", """SELECT lower(n_name) AS comuna_key, 'solo en cartografía' AS lado FROM nation WHERE n_regionkey = 0""")
def map_unmatched(spark, sf):
    places = _places(spark, sf)
    some = lens.table(spark, sf, "nation").filter("n_regionkey <> 0").select(text.place_key(F.col("n_name")).alias("comuna_key"))
    return geography.unmatched(some, places)


@query("geojson_lines", """SELECT printf('%05d', n_nationkey) AS "CUT_COM", '{"type":"Feature","id":"' || printf('%05d', n_nationkey)
  || '","properties":{"CUT_REG":"7","CUT_COM":"' || printf('%05d', n_nationkey) || '","COMUNA":" ' || upper(n_name[1]) || lower(n_name[2:])
  || '"},"geometry":{"type":"Point","coordinates":[' || n_nationkey || ',' || n_regionkey || ']}}' AS value FROM nation""")
def geojson_lines(spark, sf):
    return geography.geojson_features(_places(spark, sf))


@query("index_long", """WITH d AS (SELECT CAST(ts AS DATE) AS fecha, avg(CASE WHEN event_type = 'view' THEN value END) AS uf,
  avg(CASE WHEN event_type = 'click' THEN value END) AS ivp, avg(CASE WHEN event_type = 'purchase' THEN value END) AS utm, avg(CASE WHEN event_type = 'signup' THEN value END) AS alta,
  avg(CASE WHEN event_type = 'error' THEN value END) AS error FROM events GROUP BY ALL)
  SELECT fecha, 'uf' AS indicador, round(uf, 6) AS valor FROM d UNION ALL SELECT fecha, 'ivp', round(ivp, 6) FROM d UNION ALL SELECT fecha, 'utm', round(utm, 6) FROM d
  UNION ALL SELECT fecha, 'alta', round(alta, 6) FROM d UNION ALL SELECT fecha, 'error', round(error, 6) FROM d""")
def index_long(spark, sf):
    kinds = {"uf": "view", "ivp": "click", "utm": "purchase", "alta": "signup", "error": "error"}
    daily = lens.table(spark, sf, "events").groupBy(F.to_date("ts").alias("fecha")).agg(*[
        F.avg(F.when(F.col("event_type") == e, F.col("value"))).alias(n) for n, e in kinds.items()])
    return rounded(tables.index_long(daily, tuple(kinds)), "valor")


# ---------------------------------------------------------------- chart frames

def _history(spark, sf, periods=history.ANNUAL):
    return history.income_history(lens.budget(spark, sf), periods=periods, names=_names(spark, sf))


MILLIONS = "'$' || replace(format('{:,}', CAST(round(total / 1e6, 0) AS BIGINT)), ',', '.') || ' MM'"
EJE = "least(100.0, greatest(10.0, ceil(max(CASE WHEN total = 0 THEN 0 ELSE CAST(amt AS DOUBLE) / CAST(total AS DOUBLE) * 100 END) OVER (PARTITION BY name) * 1.1 / 10) * 10.0))"


@query("frame_annual_share", o.sql(f"""SELECT name AS "Nombre Municipio", y AS "Ejercicio", y - 2005 AS posicion, CAST(y AS VARCHAR) AS etiqueta, grp AS grupo_ingreso,
  CAST(ord AS BIGINT) AS orden_grupo, {o.share_sql()} AS porcentaje_ingreso, {MILLIONS} AS etiqueta_total, CAST({EJE} AS DOUBLE) AS eje_maximo FROM hist""", o.ANNUAL))
def frame_annual_share(spark, sf):
    return rounded(frames.share_frame(_history(spark, sf)), "porcentaje_ingreso")


def _share_frame(name: str, periods: history.Periods) -> None:
    count = periods.count

    @query(name, o.sql(f"""SELECT name AS "Nombre Municipio", y AS "Ejercicio", CAST(p AS BIGINT) AS "{periods.column}", (y - 2005) * {count} + p - 1 AS posicion,
      '{periods.prefix}' || p || '<br>' || y AS etiqueta, grp AS grupo_ingreso, CAST(ord AS BIGINT) AS orden_grupo, {o.share_sql()} AS porcentaje_ingreso,
      CAST({EJE} AS DOUBLE) AS eje_maximo FROM per""", o.period_ctes(periods.months)))
    def run(spark, sf):
        return rounded(frames.share_frame(_history(spark, sf, periods), periods), "porcentaje_ingreso")


def _amount_frame(name: str, periods: history.Periods) -> None:
    lo, hi = "min(a) OVER (PARTITION BY name)", "max(a) OVER (PARTITION BY name)"
    pad = f"greatest(({hi} - {lo}) * 0.08, greatest(abs({lo}), abs({hi})) * 0.02, 0.1)"

    @query(name, o.sql(f"""SELECT name AS "Nombre Municipio", y AS "Ejercicio", CAST(p AS BIGINT) AS "{periods.column}", (y - 2005) * {periods.count} + p - 1 AS posicion,
      '{periods.prefix}' || p || '<br>' || y AS etiqueta, grp AS grupo_ingreso, CAST(ord AS BIGINT) AS orden_grupo, round(a, 11) AS monto_mil_mm,
      round(least(0.0, {lo} - {pad}), 6) AS eje_minimo, round(greatest(0.0, {hi} + {pad}), 6) AS eje_maximo
      FROM (SELECT *, CAST(amt AS DOUBLE) / 1e9 AS a FROM per)""", o.period_ctes(periods.months)))
    def run(spark, sf):
        rows = frames.amount_frame(_history(spark, sf, periods), periods)
        return rounded(rounded(rows, "monto_mil_mm", places=11), "eje_minimo", "eje_maximo")


for _label, _periods in (("quarterly", history.QUARTERS), ("four_month", history.FOUR_MONTHS), ("semiannual", history.SEMESTERS)):
    _share_frame(f"frame_{_label}_share", _periods)
    _amount_frame(f"frame_{_label}_amount", _periods)


@query("frame_annual_amount", o.sql(f"""SELECT name AS "Nombre Municipio", y AS "Ejercicio", y - 2005 AS posicion, grp AS grupo_ingreso, CAST(ord AS BIGINT) AS orden_grupo,
  round(amt / 1e9, 11) AS monto_mil_mm, round(total / 1e9, 11) AS total_mil_mm, {MILLIONS} AS etiqueta_total,
  round(total / 1e9 + CASE WHEN mx = 0 THEN 0.1 ELSE mx * 0.02 END, 11) AS etiqueta_y, round(CASE WHEN mx = 0 THEN 1 ELSE mx * 1.12 END, 11) AS eje_maximo
  FROM (SELECT *, max(total / 1e9) OVER (PARTITION BY name) AS mx FROM hist)""", o.ANNUAL))
def frame_annual_amount(spark, sf):
    return rounded(frames.annual_amount_frame(_history(spark, sf)), "monto_mil_mm", "total_mil_mm", "etiqueta_y", "eje_maximo", places=11)


def _wrapped_sql(column: str, width: int) -> str:
    return rf"regexp_replace(regexp_replace(trim({column}), '(.{{1,{width}}}|\S{{{width + 1},}})(?:\s+|$)', '\1<br>', 'g'), '<br>$', '')"


@query("frame_breakdown", o.sql(f"""SELECT {_wrapped_sql("comp", 38)} AS leyenda, name AS "Nombre Municipio", y AS "Ejercicio", CAST(s AS BIGINT) AS "Semestre", (y - 2008) * 2 + s - 1 AS posicion,
  'S' || s || '<br>' || y AS etiqueta, comp AS componente, ord AS orden_componente, CAST(CASE WHEN ord = 7 THEN -1 ELSE (ord - 1) % 6 END AS BIGINT) AS color,
  round(CAST(amt AS DOUBLE) / 1e9, 11) AS monto_mil_mm, coalesce({o.share_sql(zero='NULL')}, 0) AS participacion, round(CAST(total AS DOUBLE) / 1e9, 11) AS total_mil_mm
  FROM bd""", o.ACCOUNTS))
def frame_breakdown(spark, sf):
    rows = frames.breakdown_frame(_variability(spark, sf)[0])
    return rounded(rounded(rows, "participacion"), "monto_mil_mm", "total_mil_mm", places=11)


VA_SHARE = "mad / CASE WHEN whole = 0 THEN 1 ELSE whole END * 100"


@query("frame_variability", o.sql(f"""SELECT {_wrapped_sql("cuenta", 44)} AS etiqueta, name AS "Nombre Municipio", rk AS ranking_variabilidad, acc_code AS codigo_cuenta, cuenta,
  CAST((rk - 1) % 6 AS BIGINT) AS color, round(mad / 1e9, 11) AS variacion_mil_mm, round(md / 1e9, 11) AS diferencia_mil_mm, round({VA_SHARE}, 6) AS participacion
  FROM va WHERE rk <= 6""", o.ACCOUNTS))
def frame_variability(spark, sf):
    rows = frames.variability_frame(_variability(spark, sf)[1])
    return rounded(rounded(rows, "participacion"), "variacion_mil_mm", "diferencia_mil_mm", places=11)


@query("frame_variability_summary", o.sql(f"""SELECT name AS "Nombre Municipio", rk AS "Ranking", acc_code AS "Código", cuenta AS "Cuenta",
  round_even(mad / 1e9, 3) AS "Promedio |S1-S2| (mil MM)", round_even(md / 1e9, 3) AS "Promedio S1-S2 (mil MM)",
  round_even({VA_SHARE}, 1) AS "% de variabilidad" FROM va WHERE rk <= 6""", o.ACCOUNTS))
def frame_variability_summary(spark, sf):
    return frames.variability_summary(_variability(spark, sf)[1])


UNPIVOT = "CROSS JOIN " + o.GROUP_VALUES


@query("frame_composition", o.sql(f"""SELECT name AS "Nombre Municipio", orden AS orden_municipio, grp AS grupo_ingreso, CAST(ord AS BIGINT) AS orden_grupo,
  round([s0, s1, s2, s3, s4][ord + 1], 6) AS porcentaje, round([g0, g1, g2, g3, g4][ord + 1] / 1e9, 11) AS monto_mil_mm
  FROM (SELECT *, row_number() OVER (ORDER BY s3 DESC, s4 DESC, name) AS orden FROM pf) {UNPIVOT}""", o.PROFILE))
def frame_composition(spark, sf):
    return rounded(rounded(frames.composition_frame(_profile(spark, sf), ["IPP", "FCM"]), "porcentaje"), "monto_mil_mm", places=11)


@query("frame_municipality_amount", o.sql(f"""SELECT name AS "Nombre Municipio", orden AS orden_municipio, grp AS grupo_ingreso, CAST(ord AS BIGINT) AS orden_grupo,
  round([g0, g1, g2, g3, g4][ord + 1] / 1e9, 11) AS monto_mil_mm FROM (SELECT *, row_number() OVER (ORDER BY tot DESC, name) AS orden FROM pf) {UNPIVOT}""", o.PROFILE))
def frame_municipality_amount(spark, sf):
    return rounded(frames.municipality_amount_frame(_profile(spark, sf)), "monto_mil_mm", places=11)


@query("frame_log_scale", o.sql("""SELECT round(log10(first), 9) AS rango_minimo, round(log10(last), 9) AS rango_maximo, round(m, 12) AS marca,
  round(log10(m), 9) AS marca_log, printf('%g', m) AS texto
  FROM (SELECT unnest([1, 2, 5]) * pow(10.0, e) AS m FROM (SELECT unnest(range(-12, 13)) AS e)) t,
  (SELECT max(CASE WHEN m <= low THEN m END) AS first, min(CASE WHEN m >= high THEN m END) AS last FROM
    (SELECT unnest([1, 2, 5]) * pow(10.0, e) AS m FROM (SELECT unnest(range(-12, 13)) AS e)),
    (SELECT min(least(tot, tot - g3 - g4)) / 1e9 AS low, max(greatest(tot, tot - g3 - g4)) / 1e9 AS high FROM pf)) r
  WHERE m BETWEEN first AND last""", o.PROFILE))
def frame_log_scale(spark, sf):
    found = frames.log_scale_frame(geography.income_map_metrics(_profile(spark, sf)))
    return rounded(rounded(found, "rango_minimo", "rango_maximo", "marca_log", places=9), "marca", places=12)


@query("frame_choropleth", o.sql("""SELECT printf('%05d', n_nationkey) AS "CUT_COM", name AS "Nombre Municipio", round(log10((tot - g3 - g4) / 1e9), 6) AS valor_log,
  round(tot / 1e9, 11) AS ingreso_total_mil_mm_clp, round((tot - g3 - g4) / 1e9, 11) AS ingreso_no_ip_mil_mm_clp, round((tot - g3 - g4) / tot * 100, 6) AS porcentaje_no_ip
  FROM pf JOIN nation ON n_name = name""", o.PROFILE))
def frame_choropleth(spark, sf):
    rows = frames.choropleth_frame(geography.build_municipality_income_map_data(_profile(spark, sf), _places(spark, sf)), "no_ip")
    return rounded(rounded(rows, "valor_log", "porcentaje_no_ip"), "ingreso_total_mil_mm_clp", "ingreso_no_ip_mil_mm_clp", places=11)


def _framed(name: str, tail: str, frame: Callable[[clusters.ClusterAnalysis], DataFrame]) -> None:
    query(name, _ward(tail))(lambda spark, sf: frame(_analysis(spark, sf, cluster_counts=[2, 3, 4])))


SCORE_ROWS = "FROM sco CROSS JOIN (VALUES ('Silhouette', 'Mayor es mejor', 0), ('Calinski-Harabasz', 'Mayor es mejor', 1), ('Davies-Bouldin', 'Menor es mejor', 2)) v(criterio, direccion, nth)"
SCORE_SELECT = f"""SELECT k AS "Número de clústeres", k = (SELECT k FROM chosen) AS seleccionado, criterio, direccion, round([sil, ch, db][nth + 1], 6) AS valor {SCORE_ROWS}"""
_framed("frame_cluster_selection", SCORE_SELECT + " WHERE nth = 0", lambda a: rounded(frames.selection_frame(a), "valor"))
_framed("frame_cluster_validation", SCORE_SELECT, lambda a: rounded(frames.validation_frame(a), "valor"))
_framed("frame_silhouette", f"""SELECT name AS "Nombre Municipio", {CLUSTER}, round(sil, 6) AS "Silhouette", {AMOUNT},
  row_number() OVER (ORDER BY cluster_id, sil, name) AS orden {CHOSEN}""",
        lambda a: rounded(rounded(frames.silhouette_frame(a), "Silhouette"), "Ingreso total (mil MM CLP)", places=11))
_framed("frame_pca", f"""SELECT name AS "Nombre Municipio", 'Clúster ' || cluster_id AS "Clúster", round(cp1, 6) AS "CP1", round(cp2, 6) AS "CP2", round(sil, 6) AS "Silhouette",
  {AMOUNT}, (SELECT round(v1, 6) FROM pv) AS varianza_cp1, (SELECT round(v2, 6) FROM pv) AS varianza_cp2 {CHOSEN}""",
        lambda a: rounded(rounded(frames.pca_frame(a), *SIX, "varianza_cp1", "varianza_cp2"), "Ingreso total (mil MM CLP)", places=11))
_framed("frame_heatmap", f"""SELECT name AS "Nombre Municipio", orden AS orden_municipio, 'Clúster ' || cluster_id AS "Clúster", grp AS grupo_ingreso, CAST(ord AS BIGINT) AS orden_grupo,
  round([s0, s1, s2, s3, s4][ord + 1], 6) AS porcentaje, (SELECT round(max(greatest(s0, s1, s2, s3, s4)), 6) FROM pf) AS maximo
  FROM (SELECT unnest(members) AS id, unnest(range(1, len(members) + 1)) AS orden FROM wt WHERE len(members) = (SELECT count(*) FROM wl))
  JOIN wk USING (id) JOIN chosen USING (k) JOIN wl USING (id) JOIN pf USING (name) {UNPIVOT}""", lambda a: rounded(frames.heatmap_frame(a), "porcentaje", "maximo"))
_framed("frame_merges", """SELECT DISTINCT a.name AS izquierda, b.name AS derecha, round(height, 6) AS height, n AS size, CAST(step AS BIGINT) AS step
  FROM wt JOIN wl a ON a.id = lo JOIN wl b ON b.id = hi WHERE wt.id = lo""", lambda a: rounded(frames.merge_frame(a), "height"))
_framed("frame_cluster_profile", f"""SELECT cluster_id, 'Clúster ' || cluster_id AS "Clúster", members AS "Número de comunas", grp AS grupo_ingreso, CAST(ord AS BIGINT) AS orden_grupo,
  round([a0, a1, a2, a3, a4][ord + 1], 6) AS porcentaje FROM (SELECT cluster_id, count(*) AS members, {", ".join(f"avg(s{i}) AS a{i}" for i in range(5))}
  {CHOSEN} GROUP BY cluster_id) {UNPIVOT}""", lambda a: rounded(frames.cluster_profile_frame(a.summary), "porcentaje"))


@query("frame_cluster_map", _ward(f"""SELECT printf('%05d', n_nationkey) AS "CUT_COM", name AS "Nombre Municipio", {CLUSTER}, {AMOUNT},
  {", ".join(f'round(s{i}, 6) AS "{g}"' for i, g in enumerate(INCOME_GROUPS))} {CHOSEN} JOIN nation ON n_name = name""", (2,), 3))
def frame_cluster_map(spark, sf):
    found = frames.cluster_map_frame(_analysis(spark, sf, cluster_count=3, cluster_counts=[2]), _places(spark, sf))
    return rounded(rounded(found, *INCOME_GROUPS), "Ingreso total (mil MM CLP)", places=11)


# ---------------------------------------------------------------- sources and the store

def _written_sources(spark, sf, kind: str = "parquet") -> str:
    """The raw layout as one source per year, in the shared folder."""
    folder = staging.scratch_path(spark, "sources")
    code = F.col(CODE)
    # the canonical year has one code per municipality; other years keep their own
    raw = lens.raw_layout(spark, sf).withColumn(
        CODE, F.when(F.col(YEAR) == "2010", (code.cast("bigint") % 100).cast("string")).otherwise(code))
    named = raw.withColumn("fuente", F.replace("source_file", F.lit(".csv"), F.lit(f".{kind}")))
    # a column the normalisation hands through carries the row's own number
    named = named.withColumn("Ppto Actualizado", F.col("source_row").cast("string")) if kind == "csv" else named
    # plain text takes several times the disk of the tables it comes from
    packing = {"csv": "gzip", "parquet": "snappy"}[kind]
    with staging.unsorted_folders(spark):
        named.drop("source_file", "source_row").write.partitionBy("fuente").format(kind).options(header=True, compression=packing).save(f"{folder}/data")
    return folder


@query("incremental_refresh", o.sql("""SELECT 'fuente=budget_' || y || '.parquet' AS source_file, count(*) AS filas, 'rebuilt' AS primera, count(*) AS escritas, 'hit' AS segunda,
  CASE WHEN y = 2009 THEN 'rebuilt' ELSE 'hit' END AS tercera, CASE WHEN y = 2009 THEN 2 * count(*) END AS escritas_tercera, 'rebuilt' AS cuarta
  FROM raw GROUP BY y"""))
def incremental_refresh(spark, sf):
    """All new, nothing new, one source grown to twice its rows, and rules changed."""
    folder = _written_sources(spark, sf)
    data, store = f"{folder}/data", f"{folder}/store"
    refresh = lambda **more: budget_source.refresh_store(spark, data, store, canonical_year=2010, **more)
    first = refresh().select("source_file", F.col("cache_status").alias("primera"), F.col("rows_written").alias("escritas"))
    names = [r.source_file for r in first.select("source_file").collect()]
    counted = budget_source.read_store(spark, store, names).groupBy("source_file").agg(F.count(F.lit(1)).alias("filas"))
    counted = staging.literal_rows(spark, [tuple(r) for r in counted.collect()], "source_file string, filas bigint")
    second = refresh().select("source_file", F.col("cache_status").alias("segunda"))
    one = f"{data}/fuente=budget_2009.parquet"
    staging.written(spark.read.parquet(one), "copy").write.mode("append").parquet(one)
    third = refresh().select("source_file", F.col("cache_status").alias("tercera"), F.col("rows_written").alias("escritas_tercera"))
    rules_file = f"{folder}/rules.csv"
    lens.crosswalk(spark).drop("rule_no").coalesce(1).write.option("header", True).csv(rules_file)
    fourth = refresh(crosswalk_path=rules_file).select("source_file", F.col("cache_status").alias("cuarta"))
    for other in (first, second, third, fourth):
        counted = counted.join(other, "source_file")
    return counted


@query("loaded_budget_csv", o.sql("""SELECT y AS "Ejercicio", count(*) AS filas, count(*) AS numeradas, CAST(sum(source_row) AS BIGINT) AS suma,
  CAST(2 AS BIGINT) AS primera, count(*) + 1 AS ultima FROM raw GROUP BY y"""))
def loaded_budget_csv(spark, sf):
    """Every row of CSV sources comes back, numbered 2, 3, ... in its own file of rows."""
    rows, _ = budget_source.data_loader(spark, f"{_written_sources(spark, sf, 'csv')}/data", canonical_year=2010, validate=False)
    return rows.groupBy(YEAR).agg(
        F.count(F.lit(1)).alias("filas"), F.count_distinct("source_file", "source_row").alias("numeradas"),
        F.sum(F.col("Ppto Actualizado").cast("bigint")).alias("suma"), F.min("source_row").alias("primera"), F.max("source_row").alias("ultima"))


@query("loaded_budget_all", o.sql("""SELECT y AS "Ejercicio", code AS "Cod Municipio", tipo AS "Cod Tipo Cuenta", grp AS grupo_ingreso_canonico, count(*) AS filas,
  CAST(sum(CAST(px AS DECIMAL(18,2))) AS DOUBLE) AS percibido FROM cl GROUP BY ALL"""))
def loaded_budget_all(spark, sf):
    """All years and municipalities, with dated rules."""
    folder = _written_sources(spark, sf)
    lens.crosswalk(spark).orderBy("rule_no").drop("rule_no").coalesce(1).write.option("header", True).csv(f"{folder}/rules.csv")
    rows, _ = budget_source.data_loader(spark, f"{folder}/data", canonical_year=2010, crosswalk_path=f"{folder}/rules.csv")
    return rows.groupBy(YEAR, CODE, "Cod Tipo Cuenta", "grupo_ingreso_canonico").agg(
        F.count(F.lit(1)).alias("filas"), numeric.exact_sum(F.col("Percibidopag Total")).cast("double").alias("percibido"))


@query("load_report", o.sql("""SELECT 'fuente=budget_' || y || '.parquet' AS source_file, count(*) AS rows, CAST(y AS VARCHAR) AS years, 'rebuilt' AS cache_status,
  count(*) FILTER (WHERE grp IS NOT NULL) AS mapped_income_rows FROM cl GROUP BY y"""))
def load_report(spark, sf):
    """The report as the loader writes it beside the store, read back."""
    folder = _written_sources(spark, sf)
    budget_source.data_loader(spark, f"{folder}/data", canonical_year=2010, store=f"{folder}/store")
    report = spark.read.option("header", True).csv(f"{folder}/store/report")
    return report.select("source_file", F.col("rows").cast("bigint").alias("rows"), "years", "cache_status",
                         F.col("mapped_income_rows").cast("bigint").alias("mapped_income_rows"))


@query("load_summary", o.sql("""SELECT source_file, count(*) AS rows, min(y) AS first_year, max(y) AS last_year
  FROM (SELECT 'budget_' || y || '.csv' AS source_file, y FROM raw) GROUP BY source_file
  UNION ALL SELECT NULL, count(*), min(y), max(y) FROM raw"""))
def load_summary(spark, sf):
    return budget_source.load_summary(lens.typed_rows(spark, sf))


@query("loaded_budget", o.sql("""SELECT y AS "Ejercicio", code AS "Cod Municipio", tipo AS "Cod Tipo Cuenta", count(*) AS filas,
  CAST(sum(CAST(px AS DECIMAL(18,2))) AS DOUBLE) AS percibido FROM raw WHERE y IN (2006, 2009) AND code IN (3, 12) GROUP BY ALL"""))
def loaded_budget(spark, sf):
    """The whole loader: discovery, layouts, catalogue, audit, then years and municipalities."""
    rows, _ = budget_source.data_loader(
        spark, f"{_written_sources(spark, sf)}/data", years=[2006, 2009], municipalities=["Nation 3", 12], canonical_year=2010)
    return rows.groupBy(YEAR, CODE, "Cod Tipo Cuenta").agg(
        F.count(F.lit(1)).alias("filas"), numeric.exact_sum(F.col("Percibidopag Total")).cast("double").alias("percibido"))
