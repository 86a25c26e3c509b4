"""What the training-data operators share: rows kept whole, staging, counting words, text keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arqueo.operators.staging import written as stored  # noqa: F401  every operator stages with it

# --- Fixed values: the white space that parts words, as a class and as characters ---
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# --- end of fixed values ---


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_merge(side: DataFrame) -> DataFrame:
    """A side of a join that grows with the corpus: the join shuffles it, whatever its files weigh.

    Spark broadcasts a staged table by the size of its files. Columns of few values are many
    times larger as rows, and the driver builds and holds what is broadcast.
    """
    return side.hint("merge")


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def packed(df: DataFrame, **values: Column) -> DataFrame:
    """Every input column in the struct ``row``, next to what the operator itself needs.

    Inside the operator no input column can clash with a name of its own.
    """
    return df.select(F.struct(*[quoted(c).alias(c) for c in df.columns]).alias("row"), *[v.alias(k) for k, v in values.items()])


def unpacked(df: DataFrame, **added: Column) -> DataFrame:
    """The input columns, then the added ones; an added column replaces an input column of its name."""
    names = df.schema["row"].dataType.names
    hidden = {k.lower() for k in added}
    # two projections: in one, a name inside a lambda could mean an input column's alias
    computed = df.select("row", *[v.alias(f"added_{i}") for i, v in enumerate(added.values())])
    kept = [F.col("row").getField(n).alias(n) for n in names if n.lower() not in hidden]
    return computed.select(*kept, *[F.col(f"added_{i}").alias(k) for i, k in enumerate(added)])


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, no other letter changed; pure ASCII takes the faster function."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def bucket_of(doc_id: Column, parts: int) -> Column:
    """crc32 of the id written as text, modulo ``parts``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % parts
