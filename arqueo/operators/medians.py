"""Exact medians per group by distributed selection.

The built-in exact percentile keeps every value of a group in one task. Here a group's values
are cut into ranges at approximate quantiles, each range is counted, and only the ranges that hold
the middle ranks go on: a few values in a hundred. When at most ``BOUND`` values of a group
are left, they are sorted. Only counts and cut points are shuffled until then.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arqueo.functions.numeric import quoted
from arqueo.operators.staging import broadcast_if_small, join_same, written

BOUND = 10_000
CUTS = 32  # ranges a group is cut into
ACCURACY = 2_000


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str, bound: int = BOUND) -> DataFrame:
    """(keys, out): the median of the non-null values of each group, the mean of the middle two for an even count.

    Null keys are a group; a group without values gives null. NaN counts as the largest value.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(quoted(k)).alias(n) for k, n in zip(keys, names)], F.col(quoted(value)).cast("double").alias("_v"))
    counts = written(rows.groupBy(*names).agg(F.count("_v").alias("_n")), "group_counts")
    # both middle ranks, from 0; `_low` values of the group lie before what is left of it
    left = written(counts.filter("_n > 0").select(
        *names, F.floor((F.col("_n") - 1) / 2).alias("_first"), F.floor(F.col("_n") / 2).alias("_second"),
        F.lit(0).cast("bigint").alias("_low"), F.col("_n").alias("_rest"),
    ), "open_groups")
    rows, solved = rows.filter("_v is not null"), []
    while True:
        few = left.filter(F.col("_rest") <= bound)
        kept = join_same(rows, broadcast_if_small(few), names)
        # bounded: at most `bound` values each
        pick = lambda rank: F.get(F.sort_array(F.collect_list("_v")), (F.any_value(rank) - F.any_value("_low")).cast("int"))
        solved.append(kept.groupBy(*names).agg(((pick("_first") + pick("_second")) / 2).alias(out)))
        many = written(left.filter(F.col("_rest") > bound), "open_groups")
        if many.isEmpty():
            break
        rows = written(join_same(rows, broadcast_if_small(many.select(*names)), names), "open_values")
        rows, left, alike = _narrowed(rows, many, names)
        solved.append(alike.select(*names, F.col("_v").alias(out)))
    found = solved[0]
    for more in solved[1:]:
        found = found.unionByName(more)
    result = join_same(counts.select(*names), found, names, "left")
    return result.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], out)


def _narrowed(rows: DataFrame, many: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The rows of the ranges that hold the middle ranks, what is known of them, and the groups that are settled.

    Values equal to a cut point are a range of their own: a value that fills a range is the median.
    """
    grid = F.percentile_approx("_v", F.array(*[F.lit(i / CUTS) for i in range(CUTS + 1)]), F.lit(ACCURACY))
    cuts = written(rows.groupBy(*names).agg(F.array_distinct(grid).alias("_cuts")), "cut_points")
    # range 2i + 1 is the i-th cut point, 2i is what lies before it
    smaller = F.size(F.filter("_cuts", lambda c: c < F.col("_v")))
    placed = join_same(rows, broadcast_if_small(cuts), names).select(
        *names, "_v", (2 * smaller + F.array_contains("_cuts", F.col("_v")).cast("int")).alias("_range")
    )
    # at most 2 * CUTS + 3 ranges of a group
    sizes = placed.groupBy(*names, "_range").agg(F.count(F.lit(1)).alias("_in"), F.min("_v").alias("_least"), F.max("_v").alias("_most"))
    packed = sizes.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("_range", "_in", "_least", "_most"))).alias("_ranges"))
    before = F.aggregate(
        "_ranges", F.array().cast("array<struct<r:int,low:bigint,n:bigint,least:double,most:double>>"),
        lambda done, r: F.array_append(done, F.struct(
            r["_range"].alias("r"), F.when(F.size(done) == 0, F.lit(0)).otherwise(F.get(done, F.size(done) - 1)["low"] + F.get(done, F.size(done) - 1)["n"]).cast("bigint").alias("low"),
            r["_in"].alias("n"), r["_least"].alias("least"), r["_most"].alias("most"),
        )),
    )
    known = join_same(many, packed.select(*names, before.alias("_at")), names)
    first, second = F.col("_first") - F.col("_low"), F.col("_second") - F.col("_low")
    middle = F.filter("_at", lambda r: (r["low"] <= second) & (r["low"] + r["n"] > first))
    low, high = F.get("_mid", F.lit(0)), F.get("_mid", F.size("_mid") - 1)
    # two ranges: one middle value is the last of the first, the other the first of the second
    settled = F.when(F.size("_mid") == 2, (low["most"] + high["least"]) / 2).when(low["least"] == low["most"], low["least"])
    chosen = written(known.withColumn("_mid", middle).select(
        *names, "_first", "_second", (F.col("_low") + low["low"]).alias("_low"), low["n"].alias("_rest"),
        low["least"].alias("_least"), low["most"].alias("_most"), settled.alias("_v"),
    ), "middle_ranges")
    alike, still = chosen.filter("_v is not null"), chosen.filter("_v is null").drop("_v")
    inside = join_same(rows, broadcast_if_small(still.select(*names, "_least", "_most")), names).filter("_v between _least and _most")
    return inside.select(*names, "_v"), still.drop("_least", "_most"), alike
