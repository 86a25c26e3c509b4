"""Entity resolution and row selection."""

from __future__ import annotations

from collections.abc import Collection
from numbers import Integral

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arqueo.functions.numeric import fail_when
from arqueo.functions.text import name_form, name_key, plain_casefold, strip
from arqueo.operators.classify import classified_income, municipal_income
from arqueo.operators.staging import broadcast_if_small, literal_rows, stage
from arqueo.schema import (
    CODE, COLLECTED_TOTAL, NAME, REGION, SERVICE_NAME, TYPE_CODE, YEAR, ContractError, require_columns,
)

INLINE_ENTITIES = 1_000
Entity = str | int


def _is_code(value: object) -> bool:
    return isinstance(value, Integral) and not isinstance(value, bool)


def listing(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A caller's list as a table: literals while short, shipped rows when long."""
    return literal_rows(spark, rows, schema) if len(rows) <= INLINE_ENTITIES else spark.createDataFrame(rows, schema)


def evaluate_key(df: DataFrame, name: str) -> str:
    """``name_key`` of one text, by the same expression the rows go through."""
    return df.sparkSession.range(1).select(name_key(F.lit(name))).head()[0]


def normalize_entities(df: DataFrame, entities: Collection[Entity] | None) -> list[Entity] | None:
    """Checked list of names and codes, repeats (by key) removed, order kept."""
    if entities is None:
        return None
    if isinstance(entities, (str, bytes)) or not isinstance(entities, Collection):
        raise TypeError("municipalities must be a collection of names or codes")
    values = list(entities)
    if any(not (isinstance(v, str) or _is_code(v)) for v in values):
        raise TypeError("municipalities may only hold names or integer codes")
    if not values:
        raise ContractError("municipalities must not be empty")
    names = [v for v in values if isinstance(v, str)]
    keys = dict(zip(names, _keys_of(df, names)))
    if "" in keys.values():
        raise ContractError("a municipality name must not be empty")
    kept: dict[tuple[str, object], Entity] = {}
    for v in values:
        kept.setdefault(("name", keys[v]) if isinstance(v, str) else ("code", int(v)), v)
    return list(kept.values())


def _keys_of(df: DataFrame, names: list[str]) -> list[str]:
    if not names:
        return []
    listed = listing(df.sparkSession, list(enumerate(names)), "n int, name string")
    return [r[0] for r in listed.orderBy("n").select(name_key(F.col("name"))).collect()]


def filter_entity(df: DataFrame, entity: Entity | None, check: bool = True) -> DataFrame:
    """Rows of one municipality by name key or by code; all rows for ``None``."""
    if entity is None:
        return df
    if isinstance(entity, str):
        chosen = df.filter(name_key(F.col(NAME)) == evaluate_key(df, entity))
    elif _is_code(entity):
        chosen = df.filter(F.col(CODE) == int(entity))
    else:
        raise TypeError("municipality must be a name, an integer code or None")
    if check and chosen.isEmpty():
        raise ContractError(f"municipality {entity!r} not found")
    return chosen


def filter_entities(
    df: DataFrame, entities: Collection[Entity], *, require_all: bool = False, check: bool = True,
) -> DataFrame:
    """Rows whose name key or code is listed: inline for short lists, else semi joins."""
    wanted = normalize_entities(df, entities)
    names = _keys_of(df, [v for v in wanted if isinstance(v, str)])
    codes = [int(v) for v in wanted if not isinstance(v, str)]
    if len(wanted) <= INLINE_ENTITIES:
        hit = F.lit(False)
        if names:
            hit = hit | F.coalesce(name_key(F.col(NAME)).isin(*names), F.lit(False))
        if codes:
            hit = hit | F.coalesce(F.col(CODE).isin(*codes), F.lit(False))
        chosen = df.filter(hit)
    else:
        spark = df.sparkSession
        listed = listing(
            spark, [(n, None) for n in names] + [(None, c) for c in codes], "_name string, _code bigint"
        )
        chosen = entity_semi(df, listed)
    if require_all:
        absent = missing_entities(df, wanted)
        if absent:
            raise ContractError(f"municipalities not found: {', '.join(map(repr, absent))}")
    elif check and chosen.isEmpty():
        raise ContractError("none of the municipalities was found")
    return chosen


def entity_semi(df: DataFrame, listed: DataFrame) -> DataFrame:
    """Rows whose code is in ``listed._code`` or whose name key is in ``listed._name``.

    Two left joins on unique keys, each broadcast when small: an OR of two equi-conditions
    would otherwise be a nested-loop join.
    """
    codes = listed.select("_code").dropna().distinct().withColumn("_by_code", F.lit(True))
    names = listed.select("_name").dropna().distinct().withColumn("_by_name", F.lit(True))
    return (
        df.withColumn("_name", name_key(F.col(NAME)))
        .join(broadcast_if_small(codes), F.col(CODE) == F.col("_code"), "left").drop("_code")
        .join(broadcast_if_small(names), "_name", "left")
        .filter("_by_code or _by_name")
        .drop("_name", "_by_code", "_by_name")
    )


def missing_entities(df: DataFrame, wanted: Collection[Entity]) -> list[Entity]:
    """Requested names and codes the data does not have."""
    spark = df.sparkSession
    rows = [(i, v, None) if isinstance(v, str) else (i, None, int(v)) for i, v in enumerate(wanted)]
    listed = listing(spark, rows, "n int, name string, code bigint")
    have_codes = df.select(F.col(CODE).alias("code")).dropna().distinct()
    have_names = df.select(NAME).distinct().select(name_key(F.col(NAME)).alias("_key")).distinct()
    lost_codes = listed.filter("code is not null").join(have_codes, "code", "left_anti").select("n")
    lost_names = listed.filter("name is not null").withColumn("_key", name_key(F.col("name"))).join(
        have_names, "_key", "left_anti").select("n")
    lost = sorted(r.n for r in lost_codes.unionByName(lost_names).collect())
    values = list(wanted)
    return [values[i] for i in lost]


def entity_names(budget: DataFrame) -> DataFrame:
    """Per code, the name in its most recent year."""
    return (
        budget.filter(F.col(CODE).isNotNull() & F.col(NAME).isNotNull())
        .groupBy(CODE).agg(strip(F.max_by(NAME, F.struct(YEAR, NAME))).alias(NAME))
    )


def resolve_municipality(budget: DataFrame, municipality: Entity) -> tuple[int, str]:
    """(code, latest name) of a municipality given by name or by code."""
    require_columns(budget, [CODE, NAME, YEAR], "resolve a municipality")
    known = budget.filter(F.col(CODE).isNotNull() & F.col(NAME).isNotNull())
    if isinstance(municipality, str):
        wanted = budget.sparkSession.range(1).select(name_form(F.lit(municipality))).head()[0]
        if not wanted:
            raise ContractError("the municipality name must not be empty")
        match = name_form(F.col(NAME)) == wanted
    elif _is_code(municipality):
        match = F.col(CODE) == int(municipality)
    else:
        raise TypeError("municipality must be a name or an integer code")
    found = known.filter(match).agg(F.min(CODE).alias("low"), F.max(CODE).alias("high")).head()
    if found.low is None:
        raise ContractError(f"municipality {municipality!r} not found")
    if found.low != found.high:
        raise ContractError(f"municipality {municipality!r} matches several codes: {found.low}, {found.high}")
    name = entity_names(known.filter(F.col(CODE) == found.low)).head()[NAME]
    return int(found.low), name


def resolve_entities(budget: DataFrame, municipalities: DataFrame, column: str = NAME) -> DataFrame:
    """Many names at once: each requested name with its code and latest name.

    A name that fits several codes stops the job; one that fits none has null code.
    """
    # both are read twice: to count them and to join them
    names = stage(entity_names(budget))
    forms = stage(
        budget.filter(F.col(CODE).isNotNull() & F.col(NAME).isNotNull())
        .select(CODE, NAME).distinct().withColumn("_form", name_form(F.col(NAME)))
        .groupBy("_form").agg(F.min(CODE).alias("_low"), F.max(CODE).alias("_high"))
    )
    several = F.concat(F.lit("name matches several codes: "), F.col("_form"))
    wanted = municipalities.select(F.col(column).alias("solicitado")).withColumn("_form", name_form(F.col("solicitado")))
    return (
        wanted.join(broadcast_if_small(forms), "_form", "left")
        .withColumn(CODE, fail_when(F.col("_low") != F.col("_high"), several, F.col("_low")))
        .join(broadcast_if_small(names), CODE, "left")
        .select("solicitado", CODE, NAME)
    )


def resolve_codes(budget: DataFrame, municipalities: Collection[Entity]) -> list[int]:
    """Distinct codes of a list of names and codes, in one job; an absent one is an error."""
    wanted = normalize_entities(budget, municipalities)
    if wanted is None:
        raise TypeError("municipalities must be a collection of names or codes")
    absent = missing_entities(budget, [v for v in wanted if not isinstance(v, str)])
    listed = listing(budget.sparkSession, [(v,) for v in wanted if isinstance(v, str)], f"`{NAME}` string")
    by_name = {r["solicitado"]: r[CODE] for r in resolve_entities(budget, listed).collect()}
    absent += [n for n, code in by_name.items() if code is None]
    if absent:
        raise ContractError(f"municipalities not found: {', '.join(map(repr, absent))}")
    return list(dict.fromkeys(by_name[v] if isinstance(v, str) else int(v) for v in wanted))


def rows_of_codes(budget: DataFrame, codes: list[int]) -> DataFrame:
    if len(codes) <= INLINE_ENTITIES:
        return budget.filter(F.col(CODE).isin(*codes))
    listed = listing(budget.sparkSession, [(c,) for c in codes], f"`{CODE}` bigint")
    return budget.join(broadcast_if_small(listed), CODE, "left_semi")


def year_filter(years: Collection[int] | None) -> Column:
    return F.lit(True) if years is None else F.col(YEAR).isin(*sorted({int(y) for y in years}))


def filter_municipality_income(
    budget: DataFrame, *, municipality: Entity, years: Collection[int] | None = None,
) -> DataFrame:
    """Income rows of one municipality under its latest name."""
    require_columns(budget, [CODE, NAME, TYPE_CODE, SERVICE_NAME, YEAR], "select municipal income")
    code, name = resolve_municipality(budget, municipality)
    rows = budget.filter((F.col(CODE) == code) & year_filter(years) & municipal_income(budget.columns))
    if rows.isEmpty():
        raise ContractError(f"no municipal income for {name}")
    return rows.withColumn(NAME, F.lit(name))


def build_municipal_income_scope(
    budget: DataFrame, *, region: str | None = None, years: Collection[int] | None = None, check: bool = True,
) -> DataFrame:
    """Classified income rows of all municipalities, of a region and of some years if asked."""
    needed = [YEAR, REGION, TYPE_CODE, SERVICE_NAME, NAME, COLLECTED_TOTAL]
    require_columns(budget, needed, "build the income scope")
    rows = budget.filter(year_filter(years))
    if region is not None:
        rows = rows.filter(plain_casefold(F.col(REGION)) == plain_casefold(F.lit(str(region))))
    scope = classified_income(rows)
    if check and scope.isEmpty():
        raise ContractError("no municipal income in the requested scope")
    return scope
