"""Reuse of small aggregates, checked broadcasts and cardinality-checked joins."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from arqueo.functions.numeric import fail_when, quoted
from arqueo.schema import ContractError

BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20
OPEN_FOLDERS = 32


def checkpoint_root(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Where unset, a folder of this application in the cluster's default file system, which is
    deleted when the application ends. A default that is local to each machine is an error,
    except with a local master, where there is one machine only.
    """
    context = spark.sparkContext
    root = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if root is None:
        settings = context._jsc.hadoopConfiguration()
        default = settings.get("fs.defaultFS", "file:///")
        if default.startswith("file:") and not (context.master == "local" or context.master.startswith("local[")):
            raise ContractError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"{default.rstrip('/')}/tmp/arqueo-{context.applicationId}-{uuid.uuid4().hex}"
        folder = context._jvm.org.apache.hadoop.fs.Path(root)
        files = folder.getFileSystem(settings)
        files.mkdirs(folder)
        files.deleteOnExit(folder)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the staging folder; what is written there goes when the application ends."""
    path = f"{checkpoint_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def written(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """``df`` as a table in the staging folder: one materialisation for all that read it.

    A lost executor then costs a re-read of the table. Columns that a reader does not use are
    not read, which a checkpointed RDD cannot offer.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def unsorted_folders(spark: SparkSession) -> Iterator[None]:
    """Within it, writes by ``partitionBy`` keep a file open per folder instead of sorting wide rows.

    A task that meets more folders than that sorts its remaining rows, as Spark does by default.
    """
    limit = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(limit)
    spark.conf.set(limit, str(max(OPEN_FOLDERS, int(before))))
    try:
        yield
    finally:
        spark.conf.set(limit, before)


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which null meets null; columns of ``left``, then the rest of ``right``."""
    other = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    same = [F.col(quoted(k)).eqNullSafe(F.col(quoted(f"_same_{k}"))) for k in keys]
    return left.join(other, reduce(lambda a, b: a & b, same, F.lit(True)), how).drop(*[f"_same_{k}" for k in keys])


def stage(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, into the checkpoint folder, for plans that read it several times.

    Meant for aggregates that are small next to their input: the big scan and shuffle then
    run once, and a lost executor costs a re-read of the checkpoint, not of the input.
    """
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def _value_bytes(column: str, kind: T.DataType) -> Column:
    """About how many bytes a value takes; texts and lists by their length, all else as one number."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(quoted(column)), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType) and not isinstance(kind.elementType, (T.StringType, T.BinaryType, T.ArrayType, T.StructType, T.MapType)):
        return F.coalesce(F.size(quoted(column)), F.lit(0)) * 8 + 8
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.coalesce(F.octet_length(F.to_json(F.struct(quoted(column)))), F.lit(0))
    return F.lit(16)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only after counting rows and their bytes; a larger side is left to a shuffled join."""
    size = sum((_value_bytes(f.name, f.dataType) for f in df.schema.fields), F.lit(0))
    rows, total = df.limit(max_rows + 1).agg(F.count(F.lit(1)), F.coalesce(F.sum(size.cast("bigint")), F.lit(0))).head()
    return F.broadcast(df) if rows <= max_rows and total <= max_bytes else df


def unique_by(df: DataFrame, keys: Sequence[str], what: str) -> DataFrame:
    """One row per key; the job stops if a key repeats.

    The check is a filter: unlike a column it cannot be pruned, and it leaves the key columns
    and their partitioning as the aggregation made them.
    """
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"), *([F.first(F.struct(*rest)).alias("_row")] if rest else [])
    )
    unique = fail_when(F.col("_n") > 1, f"{what}: repeated key", F.lit(True))
    return packed.filter(unique).select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def checked_join(
    left: DataFrame, right: DataFrame, on: Sequence[str] | str, how: str = "left",
    validate: str = "many_to_one",
) -> DataFrame:
    """Equi-join that stops the job when the promised cardinality does not hold."""
    keys = [on] if isinstance(on, str) else list(on)
    sides = {"one_to_one": (True, True), "many_to_one": (False, True),
             "one_to_many": (True, False), "many_to_many": (False, False)}
    if validate not in sides:
        raise ContractError(f"validate must be one of {', '.join(sides)}")
    left_unique, right_unique = sides[validate]
    if left_unique:
        left = unique_by(left, keys, "left side")
    if right_unique:
        right = unique_by(right, keys, "right side")
    return left.join(right, keys, how)


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("filas")).filter("filas > 1")


def with_group_values(df: DataFrame, keys: Sequence[str], **aggregates: Column) -> DataFrame:
    """Aggregates per key attached to every row.

    An aggregate and a join rather than an unordered window: partial aggregation and the
    adaptive skew join cope with a key that holds a large part of the rows.
    """
    grouped = df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])
    return join_same(df, grouped, keys)


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: str) -> DataFrame:
    """A short, bounded table made on the driver: literals, or one Arrow table when longer."""
    struct = T.StructType.fromDDL(schema)
    if 0 < len(rows) <= 50:
        cells = [
            F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, struct)]) for row in rows
        ]
        return spark.range(1).select(F.inline(F.array(*cells)))
    table = pa.Table.from_pylist([dict(zip(struct.names, r)) for r in rows], to_arrow_schema(struct))
    return spark.createDataFrame(table)
