"""Column contract of the municipal budget table and the Spark types it is held in."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# --- Fixed values: versions, groups, month names and column names of the contract ---
SCHEMA_VERSION = "2025"
NORMALIZATION_VERSION = "2025.2"
CANONICAL_YEAR = 2025
FIRST_MODERN_YEAR = 2008

INCOME_GROUPS = (
    "Transferencias corrientes",
    "Transferencias de capital",
    "Otros ingresos",
    "IPP",
    "FCM",
)
CURRENT, CAPITAL, OTHER, IPP, FCM = INCOME_GROUPS

MONTHS = (
    "Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio",
    "Julio", "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre",
)

# canonical identifier -> audit column that keeps the value as it was read
SOURCE_FIELDS = {
    "Ejercicio": "source_ejercicio",
    "Moneda": "source_moneda",
    "Región": "source_region",
    "Cod Municipio": "source_cod_municipio",
    "Nombre Municipio": "source_nombre_municipio",
    "Cod Serv Incorporado": "source_cod_serv_incorporado",
    "Nombre Serv Incorporado": "source_nombre_serv_incorporado",
    "Cod Subárea": "source_cod_subarea",
    "Nombre Subárea": "source_nombre_subarea",
    "Cod Tipo Cuenta": "source_cod_tipo_cuenta",
    "Nombre Tipo Cuenta": "source_nombre_tipo_cuenta",
    "Cod Subtítulo": "source_cod_subtitulo",
    "Nombre Subtítulo": "source_nombre_subtitulo",
    "Cod Ítem": "source_cod_item",
    "Nombre Ítem": "source_nombre_item",
    "Cod Asignación": "source_cod_asignacion",
    "Nombre Asignación": "source_nombre_asignacion",
    "Cod Subasignación": "source_cod_subasignacion",
    "Nombre Subasignación": "source_nombre_subasignacion",
    "Cod Subsubasignación": "source_cod_subsubasignacion",
    "Nombre Subsubasignación": "source_nombre_subsubasignacion",
}
# --- end of fixed values ---

YEAR, CODE, NAME, REGION = "Ejercicio", "Cod Municipio", "Nombre Municipio", "Región"
TYPE_CODE, TYPE_NAME = "Cod Tipo Cuenta", "Nombre Tipo Cuenta"
SERVICE_CODE, SERVICE_NAME = "Cod Serv Incorporado", "Nombre Serv Incorporado"
SUBTITLE, SUBASSIGNMENT = "Cod Subtítulo", "Cod Subasignación"
GROUP = "grupo_ingreso"
CANONICAL_GROUP = "grupo_ingreso_canonico"
MAPPING_STATUS, MAPPING_METHOD = "income_mapping_status", "income_mapping_method"

MEASURES = ("Ppto Modif", "Devengado", "Percibidopag", "Porpercibir")
COLLECTED = "Percibidopag"
COLLECTED_TOTAL = "Percibidopag Total"


def month_columns(measure: str) -> list[str]:
    return [f"{measure} {month}" for month in MONTHS]


IDENTIFIERS = list(SOURCE_FIELDS)
CODES = [c for c in IDENTIFIERS if c == YEAR or c.startswith("Cod ")]
TEXTS = [c for c in IDENTIFIERS if c not in CODES]
# total column -> the columns it is the sum of
TOTAL_PARTS = {
    "Ppto Actualizado": ["Ppto Inicial", *month_columns("Ppto Modif")],
    **{f"{m} Total": month_columns(m) for m in MEASURES[1:]},
}
VALUES = [c for total, parts in TOTAL_PARTS.items() for c in (*parts, total)]
CONTRACT = IDENTIFIERS + VALUES
# the account hierarchy: ten code/name columns from subtitle down
ACCOUNT_LEVELS = IDENTIFIERS[IDENTIFIERS.index(SUBTITLE):]
AUDIT = [
    "canonical_schema_version", "normalization_version", "source_schema_version",
    "source_file", "source_row", *SOURCE_FIELDS.values(),
    "municipality_mapping_status", "service_mapping_status",
    CANONICAL_GROUP, MAPPING_STATUS, MAPPING_METHOD,
]


def column_type(column: str) -> T.DataType:
    if column in CODES or column == "source_row":
        return T.LongType()
    return T.DoubleType() if column in VALUES else T.StringType()


BUDGET_SCHEMA = T.StructType([T.StructField(c, column_type(c)) for c in CONTRACT + AUDIT])


class ContractError(ValueError):
    """Data or arguments that break the contract."""


def require_columns(df: DataFrame, columns: Iterable[str], purpose: str) -> None:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise KeyError(f"cannot {purpose}; missing columns: {', '.join(missing)}")


def check_group_sequence(values, *, parameter: str, require_all: bool) -> tuple[str, ...]:
    """An ordered list or tuple of distinct known groups, complete when asked for."""
    if not isinstance(values, (list, tuple)):
        raise TypeError(f"{parameter} must be a list or a tuple of groups")
    if any(not isinstance(v, str) for v in values):
        raise TypeError(f"{parameter} may only hold group names")
    unknown = sorted(set(values) - set(INCOME_GROUPS))
    absent = [g for g in INCOME_GROUPS if g not in values]
    if len(set(values)) < len(values):
        raise ContractError(f"{parameter} repeats a group")
    if unknown:
        raise ContractError(f"{parameter} has unknown groups: {', '.join(unknown)}")
    if require_all and absent:
        raise ContractError(f"{parameter} must hold every group; missing: {', '.join(absent)}")
    return tuple(values)
