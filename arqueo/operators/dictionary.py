"""Dictionary encoding of text columns: what is costly to say of a text is said once per distinct text.

Budget rows repeat a few names millions of times. A dictionary holds the distinct texts of
some columns with whatever forms of them are wanted; rows meet it again by equality.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arqueo.functions.numeric import quoted
from arqueo.functions.text import accent_free_upper, key_of_form, name_form, place_of_form, words_of_form
from arqueo.operators.staging import broadcast_if_small, written

Form = Callable[[Column], Column]
# the normal forms of names; those after the first build on it
NAME_FORMS: dict[str, Form] = {
    "forma": name_form, "clave": lambda t: key_of_form(F.col("forma")), "lugar": lambda t: place_of_form(F.col("forma")),
    "palabras": lambda t: words_of_form(F.col("forma")), "mayusculas": accent_free_upper,
}


def text_dictionary(df: DataFrame, columns: Sequence[str], forms: Mapping[str, Form]) -> DataFrame:
    """(texto, one column per form): every distinct text of ``columns``, its forms computed once.

    One pass over the rows that reads only these columns. Partial aggregation keeps a text
    once per task before it is shuffled, so a text that a third of the rows hold costs no more
    than another. The distinct texts are written before any form is computed of them, and so
    are the forms: neither an optimiser rule nor a second reader can bring a form back to the rows.
    A form may refer to one named before it. Nulls are not entries.
    """
    cells = F.explode(F.array(*[F.col(quoted(c)).cast("string") for c in columns])) if len(columns) > 1 else F.col(quoted(columns[0])).cast("string")
    texts = written(df.select(cells.alias("texto")).filter("texto IS NOT NULL").distinct(), "texts")
    for name, form in forms.items():
        texts = texts.withColumn(name, form(F.col("texto")))
    return written(texts, "dictionary")


def with_forms(df: DataFrame, dictionary: DataFrame, wanted: Mapping[str, tuple[str, str]], when_null: Mapping[str, object] | None = None) -> DataFrame:
    """``df`` with columns out -> (text column, form), looked up in ``dictionary``.

    Rows and their other columns stay as they are. The form of a null text is null, or what
    ``when_null`` names for that form. A small dictionary is broadcast, after its rows and bytes
    were counted; a larger one is joined by the text. Both sides of that join are read from
    tables or exchanges, so the adaptive skew join can split a text that many rows hold.
    """
    by_column: dict[str, dict[str, str]] = {}
    for out, (column, form) in wanted.items():
        by_column.setdefault(column, {})[out] = form
    side = broadcast_if_small(dictionary)
    for n, (column, outs) in enumerate(by_column.items()):
        entry = side.select(F.col("texto").alias(f"_texto{n}"), *[F.col(form).alias(out) for out, form in outs.items()])
        df = df.join(entry, F.col(quoted(column)).cast("string") == F.col(f"_texto{n}"), "left").drop(f"_texto{n}")
    given = {out: (when_null or {}).get(form) for out, (_, form) in wanted.items()}
    return df.withColumns({
        out: F.when(F.col(quoted(wanted[out][0])).isNull(), F.lit(value)).otherwise(F.col(out)) for out, value in given.items() if value is not None
    })
