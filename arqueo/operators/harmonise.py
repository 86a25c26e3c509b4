"""From a yearly layout, read as text, to the typed contract: one chain of projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arqueo import rules
from arqueo.functions.numeric import code_number, fail_when, parse_codes, quoted, row_sum, to_number, trimmed_sql
from arqueo.functions.text import name_key, strip
from arqueo.operators.classify import ACCOUNT_TEXT, MAPPING_FACTS, decided_income, mapping_facts
from arqueo.operators.staging import broadcast_if_small, stage
from arqueo.schema import (
    ACCOUNT_LEVELS, AUDIT, CANONICAL_YEAR, CODE, CODES, CONTRACT, FIRST_MODERN_YEAR,
    NAME, NORMALIZATION_VERSION, REGION, SCHEMA_VERSION, SERVICE_CODE, SERVICE_NAME, SOURCE_FIELDS, SUBASSIGNMENT, SUBTITLE,
    TEXTS, TOTAL_PARTS, TYPE_CODE, TYPE_NAME, VALUES, YEAR, ContractError, column_type,
    require_columns,
)
from arqueo.session import compiled_methods

PROVENANCE = ("source_file", "source_row")
# what the joins of version tags and dated rules read
JOINED = ("source_file", YEAR, "source_cod_subtitulo", "source_cod_item", *MAPPING_FACTS)
# what version tags, services and the income mapping read
MAPPED = (
    "source_file", YEAR, TYPE_CODE, TYPE_NAME, SERVICE_CODE, SERVICE_NAME, SUBTITLE, SUBASSIGNMENT,
    "source_cod_subtitulo", "source_cod_item", *ACCOUNT_TEXT,
)


def canonical_headers(columns: list[str], source: str, aliases: Mapping[str, str] = rules.COLUMN_ALIASES) -> list[str]:
    """Contract names for the headers of one source; unknown or colliding headers are errors."""
    renamed = [aliases.get(c.strip(), c.strip()) for c in columns]
    unknown = sorted(set(renamed) - set(CONTRACT) - set(PROVENANCE))
    twice = sorted({c for c in renamed if renamed.count(c) > 1})
    if unknown:
        raise ContractError(f"{source} has columns without a rule: {unknown}")
    if twice:
        raise ContractError(f"{source} gives the same column twice: {twice}")
    return renamed


def rename_headers(df: DataFrame, source: str = "source", aliases: Mapping[str, str] = rules.COLUMN_ALIASES) -> DataFrame:
    return df.toDF(*canonical_headers(df.columns, source, aliases))


def capture_source(df: DataFrame) -> DataFrame:
    """Keep the identifiers as read, as text, in the audit columns."""
    have = set(df.columns)
    return df.selectExpr("*", *[
        f"CAST({quoted(c) if c in have else 'NULL'} AS STRING) AS {audit}" for c, audit in SOURCE_FIELDS.items()
    ])


def fill_contract(df: DataFrame) -> DataFrame:
    """Absent contract columns as nulls; sub-area defaults."""
    # values stay text until they are parsed
    absent = [f"CAST(NULL AS STRING) AS {quoted(c)}" for c in CONTRACT if c not in df.columns]
    full = df.selectExpr("*", *absent)
    area = F.col("Nombre Subárea").cast("string")
    return full.withColumns({
        "Cod Subárea": F.coalesce(F.col("Cod Subárea").cast("string"), F.lit("0")),
        "Nombre Subárea": F.when(area.isNull() | (strip(area) == ""), "Sin Subárea").otherwise(area),
    })


def parse_types(df: DataFrame) -> DataFrame:
    """Integer codes and double amounts from text."""
    return parse_codes(df, CODES).withColumns({c: to_number(c) for c in VALUES})


def packed(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """``columns`` as one struct: steps that only hand them through copy it as a whole."""
    rest = [F.col(quoted(c)) for c in df.columns if c not in set(columns)]
    return df.select(*rest, F.struct(*[F.col(quoted(c)) for c in columns]).alias(name))


def unpacked(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[F.col(quoted(c)) for c in df.columns if c != name], f"{name}.*")


def handed_through(df: DataFrame, read: Sequence[str] = JOINED) -> DataFrame:
    """All that the joins (or other steps up to ``unpacked``) do not read, packed.

    For the joins alone, only they and projections that Spark can merge may stand between here and ``unpacked``:
    then fields that a job does not read are neither packed nor parsed nor read from the files.
    """
    return packed(df, [c for c in df.columns if c not in read], "_packed")


def version_tags(df: DataFrame) -> DataFrame:
    """Version columns; the source schema is told by the latest year of the file.

    Files are few and hot, so the latest year per file is a partial aggregate joined back
    (one row per file) rather than a window over whole files.
    """
    latest = stage(df.groupBy("source_file").agg(F.max(YEAR).alias("_latest")))
    known = fail_when(F.col("_latest").isNull(), "a source file holds no valid year", F.col("_latest"))
    return (
        df.join(broadcast_if_small(latest), "source_file")
        .withColumns({
            "source_schema_version": F.when(known < FIRST_MODERN_YEAR, "legacy_pre_2008").otherwise("modern_2008_plus"),
            "canonical_schema_version": F.lit(SCHEMA_VERSION),
            "normalization_version": F.lit(NORMALIZATION_VERSION),
            "municipality_mapping_status": F.lit("source_only"),
        })
        .drop("_latest")
    )


def account_type_names(df: DataFrame, names: Mapping[int, str] = rules.ACCOUNT_TYPES) -> DataFrame:
    name = F.col(TYPE_NAME).cast("string")
    for code, fixed in names.items():
        name = F.when(F.col(TYPE_CODE) == code, fixed).otherwise(name)
    return df.withColumn(TYPE_NAME, name)


def _lookup(pairs: Mapping[str, object], key: Column) -> Column:
    """Constant map lookup; the table is a parameter of tens of entries, so no join."""
    literal = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.try_element_at(literal, key)


def map_services(df: DataFrame, aliases: Mapping[str, tuple[int, str]] = rules.SERVICE_ALIASES) -> DataFrame:
    keyed = df.withColumn("_service", name_key(F.col(SERVICE_NAME)))
    code = _lookup({k: v[0] for k, v in aliases.items()}, F.col("_service"))
    name = _lookup({k: v[1] for k, v in aliases.items()}, F.col("_service"))
    return keyed.withColumns({
        SERVICE_CODE: F.coalesce(code.cast("bigint"), F.col(SERVICE_CODE)),
        SERVICE_NAME: F.coalesce(name, F.col(SERVICE_NAME)),
        "service_mapping_status": F.when(code.isNotNull(), "mapped_by_name").otherwise("unmapped"),
    }).drop("_service")


def fill_totals(df: DataFrame) -> DataFrame:
    """Missing totals from their parts; ``_filled`` tells which totals the row lacked."""
    lacked = F.struct(*[F.col(total).isNull().alias(total) for total in TOTAL_PARTS])
    return df.withColumns({
        "_filled": lacked,
        **{
            total: F.coalesce(F.col(total), row_sum(parts))
            for total, parts in TOTAL_PARTS.items()
        },
    })


def blank_legacy_accounts(df: DataFrame) -> DataFrame:
    """Early years used other account codes: drop them from the modern columns."""
    modern = f"NOT coalesce({YEAR} < {FIRST_MODERN_YEAR}, false)"
    return df.withColumns({
        c: F.expr(f"CASE WHEN {modern} THEN {quoted(c)} END") for c in ACCOUNT_LEVELS if c in df.columns
    })


def apply_contract(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Contract order and types; text trimmed; absent audit columns as nulls."""
    have, kept = set(df.columns), dict(df.dtypes)

    def typed(c: str) -> str:
        kind = column_type(c).simpleString()
        value = quoted(c) if c in have else "NULL"
        if c in have and c in TEXTS:
            value = trimmed_sql(c)
        elif kept.get(c) == kind:
            return value
        return f"CAST({value} AS {kind}) AS {quoted(c)}"

    return df.selectExpr(*[typed(c) for c in CONTRACT + AUDIT], *extra)


def normalize_layout(
    raw: DataFrame, crosswalk: DataFrame | None = None, source: str = "source",
    aliases: Mapping[str, str] = rules.COLUMN_ALIASES, keep_filled: bool = False, whole: bool = False,
) -> DataFrame:
    """The whole per-file pipeline for all files that share one layout.

    ``raw`` holds text columns under their own headers plus ``source_file`` and
    ``source_row``. Account codes are read by the mapping before early years are blanked.
    ``whole`` is for results that are filtered by place afterwards, see ``decided_income``.
    """
    require_columns(raw, PROVENANCE, "normalise a source")
    parsed = (
        rename_headers(compiled_methods(raw), source, aliases)
        .transform(capture_source)
        .transform(fill_contract)
        .transform(parse_types)
    )
    if whole:
        mapped = (
            parsed.transform(handed_through, MAPPED)
            .transform(version_tags)
            .transform(account_type_names)
            .transform(map_services)
            .transform(mapping_facts)
            .transform(decided_income, crosswalk, whole=True)
            .transform(unpacked, "_packed")
            .transform(fill_totals)
        )
    else:
        mapped = (
            parsed.transform(fill_totals)
            .transform(account_type_names)
            .transform(map_services)
            .transform(mapping_facts)
            .transform(handed_through)
            .transform(version_tags)
            .transform(decided_income, crosswalk)
            .transform(unpacked, "_packed")
        )
    mapped = mapped.transform(blank_legacy_accounts)
    return apply_contract(mapped, ("_filled",) if keep_filled else ())


def bad_codes(raw: DataFrame) -> DataFrame:
    """Codes that are no integers, as rows: the report form of the stop in ``parse_types``."""
    columns = [c for c in CODES if c in raw.columns]
    cells = F.explode(F.array(*[
        F.struct(F.lit(c).alias("columna"), F.col(c).cast("string").alias("texto")) for c in columns
    ])).alias("celda")
    return (
        raw.select("source_file", "source_row", cells)
        .select("source_file", "source_row", "celda.columna", "celda.texto")
        .withColumn("_number", code_number("texto"))
        .filter("_number <> floor(_number)").drop("_number")
    )


def build_municipality_catalog(budget: DataFrame, year: int = CANONICAL_YEAR) -> DataFrame:
    """(code, name, region, municipality_key) of the canonical year; one row per key.

    A key with two codes stops the job. Among equal keys the smallest name and region stay.
    """
    rows = (
        budget.filter((F.col(YEAR) == year) & F.col(CODE).isNotNull() & F.col(NAME).isNotNull())
        .select(CODE, NAME, REGION).distinct()
        .withColumn("municipality_key", name_key(F.col(NAME)))
    )
    packed = rows.groupBy("municipality_key").agg(
        F.min(CODE).alias("_low"), F.max(CODE).alias("_high"), F.min(F.struct(CODE, NAME, REGION)).alias("_row")
    )
    ambiguous = F.concat(F.lit("ambiguous municipality name in the catalogue: "), F.col("municipality_key"))
    checked = fail_when(F.col("_low") != F.col("_high"), ambiguous, F.col("_row"))
    return packed.withColumn("_row", checked).select(
        *[F.col("_row")[c].alias(c) for c in (CODE, NAME, REGION)], "municipality_key"
    )


def apply_municipality_catalog(
    budget: DataFrame, catalog: DataFrame, aliases: Mapping[str, str] = rules.NAME_ALIASES,
) -> DataFrame:
    """Identity of the catalogue where the name key is known; otherwise the row keeps its own."""
    own = name_key(F.col("source_nombre_municipio"))
    used = {CODE, NAME, REGION, "source_nombre_municipio", "source_cod_municipio", "municipality_mapping_status"}
    slim = packed(compiled_methods(budget), [c for c in budget.columns if c not in used], "_rest")
    keyed = slim.withColumn("_own_key", own).withColumn(
        "_key", F.coalesce(_lookup(aliases, F.col("_own_key")), F.col("_own_key"))
    )
    side = broadcast_if_small(catalog.select(
        F.col("municipality_key").alias("_key"),
        F.struct(CODE, NAME, REGION).alias("_identity"),
    ))
    known = F.col("_identity").isNotNull()
    source_code = to_number("source_cod_municipio")
    status = (
        F.when(~known, "unmapped")
        .when(F.col("_own_key") != F.col("_key"), "matched_by_alias")
        .when(source_code == F.col("_identity")[CODE], "canonical_code")
        .otherwise("matched_by_name")
    )
    joined = unpacked(keyed.join(side, "_key", "left"), "_rest")
    extra = tuple(c for c in ("_filled",) if c in budget.columns)
    return joined.withColumns({
        "municipality_mapping_status": status,
        **{c: F.when(known, F.col("_identity")[c]).otherwise(F.col(c)) for c in (CODE, NAME, REGION)},
    }).transform(apply_contract, extra)
