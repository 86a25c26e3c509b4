"""Joins of results with a municipality map, both sides checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arqueo.functions.numeric import fail_when
from arqueo.functions.text import place_key
from arqueo.operators.profiles import TOTAL
from arqueo.operators.staging import checked_join
from arqueo.schema import FCM, INCOME_GROUPS, IPP, NAME, ContractError, require_columns

PLACE = "comuna_key"


def unmatched(data: DataFrame, geography: DataFrame) -> DataFrame:
    """(comuna_key, lado) of keys found on one side only."""
    left, right = data.select(PLACE).distinct(), geography.select(PLACE).distinct()
    only_data = left.join(right, PLACE, "left_anti").withColumn("lado", F.lit("solo en resultados"))
    only_map = right.join(left, PLACE, "left_anti").withColumn("lado", F.lit("solo en cartografía"))
    return only_data.unionByName(only_map)


def join_municipality_geography(
    data: DataFrame, geography: DataFrame, *, municipality_column: str = NAME, require_complete: bool = True,
) -> DataFrame:
    """One-to-one join by place key; repeated or missing names and uncovered places are errors."""
    require_columns(data, [municipality_column], "join the map")
    name = F.col(municipality_column)
    keyed = data.withColumn(PLACE, fail_when(name.isNull(), "result without a municipality name", place_key(name)))
    lost = unmatched(keyed, geography)
    if not require_complete:
        lost = lost.filter("lado = 'solo en resultados'")
    shown = lost.orderBy("lado", PLACE).take(20)
    if shown:
        raise ContractError("places on one side only: " + ", ".join(f"{r[PLACE]} ({r['lado']})" for r in shown))
    return checked_join(keyed, geography, PLACE, "inner", "one_to_one")


def income_map_metrics(profile: DataFrame) -> DataFrame:
    """Total and non-permanent income, in pesos, in thousands of millions, and as a share."""
    total, other = F.col(TOTAL), F.col(TOTAL) - F.col(IPP) - F.col(FCM)
    return profile.select(
        NAME, *INCOME_GROUPS, TOTAL, other.alias("ingreso_no_ip_clp"),
        (total / 1e9).alias("ingreso_total_mil_mm_clp"), (other / 1e9).alias("ingreso_no_ip_mil_mm_clp"),
        (other / total * 100).alias("porcentaje_no_ip"),
    )


def build_municipality_income_map_data(profile: DataFrame, geography: DataFrame) -> DataFrame:
    return join_municipality_geography(income_map_metrics(profile), geography)


def region_places(
    shapes: DataFrame, *, region_code: str | int, expected_count: int | None = None, check: bool = True,
) -> DataFrame:
    """(CUT_COM, COMUNA_DPA, comuna_key, …) of one region; the source attributes stay along."""
    require_columns(shapes, ["CUT_REG", "CUT_COM", "COMUNA"], "read the map")
    wanted = str(region_code).strip().zfill(2)
    places = (
        shapes.filter(F.lpad(F.col("CUT_REG").cast("string"), 2, "0") == wanted)
        .withColumn("CUT_COM", F.col("CUT_COM").cast("string"))
        .withColumn("COMUNA_DPA", F.trim("COMUNA")).withColumn(PLACE, place_key(F.col("COMUNA")))
    )
    if check:
        seen = places.agg(
            F.count(F.lit(1)).alias("n"), F.countDistinct("CUT_COM").alias("codes"), F.countDistinct(PLACE).alias("keys")
        ).head()
        if not seen.n:
            raise ContractError(f"no places in region {wanted}")
        if seen.codes < seen.n:
            raise ContractError("the map repeats a place code")
        if seen["keys"] < seen.n:
            raise ContractError("the map repeats a place name")
        if expected_count is not None and seen.n != expected_count:
            raise ContractError(f"expected {expected_count} places, found {seen.n}")
    return places


def geojson_features(places: DataFrame, geometry: str = "geometry") -> DataFrame:
    """One GeoJSON feature per row; the geometry is kept as the JSON text it is."""
    properties = [c for c in places.columns if c not in (geometry, "COMUNA_DPA", PLACE)]
    head = F.to_json(F.struct(
        F.lit("Feature").alias("type"), F.col("CUT_COM").alias("id"), F.struct(*properties).alias("properties")
    ))
    joined = F.concat(F.regexp_replace(head, r"\}$", ""), F.lit(',"geometry":'), F.coalesce(F.col(geometry), F.lit("null")), F.lit("}"))
    return places.select("CUT_COM", joined.alias("value"))
