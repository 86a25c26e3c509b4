"""Small hand-made budget tables."""

from arqueo.operators.harmonise import normalize_layout
from arqueo.schema import MONTHS


def raw(spark, rows, source="presupuesto_2010.csv"):
    """Rows given as dicts of contract columns (text) plus months as {number: amount}."""
    names = ["Ejercicio", "Región", "Cod Municipio", "Nombre Municipio", "Nombre Serv Incorporado", "Nombre Subárea", "Cod Tipo Cuenta",
             "Cod Subtítulo", "Nombre Subtítulo", "Cod Ítem", "Nombre Ítem", "Nombre Asignación", "Cod Subasignación",
             "Nombre Subasignación", "Ppto Inicial", "Percibidopag Total"]
    fixed = {"Ejercicio": "2010", "Región": "Uno", "Cod Municipio": "1", "Nombre Municipio": "Buin", "Nombre Serv Incorporado": "Gestión Municipal",
             "Cod Tipo Cuenta": "1", "Cod Subtítulo": "3", "Cod Subasignación": "9"}
    table = []
    for n, row in enumerate(rows):
        row = {**fixed, **row}
        months = row.pop("m", {})
        table.append([row.get(c) for c in names] + [str(months[i]) if i in months else None for i in range(1, 13)]
                     + [row.get("source_file", source), n + 2])
    columns = names + [f"Percibidopag {m}" for m in MONTHS]
    schema = ", ".join(f"`{c}` string" for c in columns) + ", source_file string, source_row bigint"
    return spark.createDataFrame(table, schema)


def budget(spark, rows, crosswalk=None):
    return normalize_layout(raw(spark, rows), crosswalk)
