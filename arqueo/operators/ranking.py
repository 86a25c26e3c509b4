"""Row numbers per key that do not put one key's rows into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arqueo.operators.staging import join_same, stage


def spread_row_number(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str, partitions: int | None = None,
) -> DataFrame:
    """``row_number`` over (keys, order) by range partitioning on keys *and* order.

    A key with a large part of the rows spans many range partitions; each numbers its own
    slice, and the sizes of the earlier slices of the key (at most one per partition) are
    added. Staged after partitioning, so slices and their sizes come from the same split
    even if a task is run again.
    """
    spark = df.sparkSession
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(parts, *[F.col(k) for k in keys], *order)
    sliced = stage(ranged.withColumn("_slice", F.spark_partition_id()))
    slice_key = Window.partitionBy(*keys, "_slice")
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(before), F.lit(0))).drop("_size")
    numbered = sliced.withColumn("_local", F.row_number().over(slice_key.orderBy(*order)))
    return (
        join_same(numbered, offsets, [*keys, "_slice"])
        .withColumn(out, (F.col("_local") + F.col("_before")).cast("bigint"))
        .drop("_slice", "_local", "_before")
    )
