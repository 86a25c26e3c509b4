"""Minimum-variance (Ward) clustering of vectors, its scores, and the results around it.

Ward's criterion is reducible: pairs of clusters that are each other's nearest can be merged
in any order without changing the tree. So while many clusters remain, every round merges
*all* mutual pairs at once, as Spark jobs. The nearest cluster of each is remembered: after a
round only clusters whose neighbour was merged look at all others again, the rest look at the
merged ones alone. When at most ``INSIDE`` clusters remain, as many as the largest block has,
one task does the rounds that are left; when at most ``FINISH`` remain, their centroids (a
bounded table) are finished on the driver. The tree is the exact one at any size.

Rounds are quadratic in the rows. With ``micro``, more vectors than that are first gathered
into as many weighted centroids by k-means on Spark, linear in the rows; the tree of the
centroids is the exact one, and the same as without where there are no more vectors.

A merge is recorded as ``hi`` absorbed into ``lo`` (ids of representative rows) at a height.
Heights never fall along a branch, so cutting into k clusters means dropping the k - 1
highest merges and following the others.
"""

from __future__ import annotations

from collections.abc import Collection
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from arqueo.functions.text import plain_casefold
from arqueo.operators.pairwise import (
    BLOCK_ROWS, LARGER, against, against_all, distance_chunks, euclidean, label_centroids, matrix, nearest_rows, pair_squares, same_ids,
    silhouette_cuts, silhouette_rows, square_chunks,
)
from arqueo.operators.ranking import spread_row_number
from arqueo.operators.profiles import SHARES, TOTAL, clr_features, ensure_municipality_income_profile
from arqueo.operators.medians import exact_median
from arqueo.operators.staging import broadcast_if_small, join_same, literal_rows, stage, written
from arqueo.schema import INCOME_GROUPS, NAME, ContractError

FINISH = 1_000
INSIDE = LARGER * BLOCK_ROWS  # clusters that one task takes over: as many as the largest block has
MICRO = 2_000  # weighted centroids that stand for the rows of a large table
MICRO_ROUNDS, MICRO_SEED = 20, 17
MERGES = "lo bigint, hi bigint, height double, size bigint, step bigint"


@dataclass(frozen=True)
class WardTree:
    """Merges done on Spark (one row each) and the bounded list finished on the driver."""

    leaves: DataFrame                # id bigint, vec array<double>
    spark_merges: DataFrame | None   # lo, hi, height, size, step
    driver_merges: list[tuple] = field(default_factory=list)
    compared: list[int] = field(default_factory=list)  # pairs of clusters each Spark round looked at

    @property
    def merges(self) -> DataFrame:
        spark = self.leaves.sparkSession
        finished = literal_rows(spark, self.driver_merges, MERGES)
        return finished if self.spark_merges is None else self.spark_merges.unionByName(finished)

    def highest(self, count: int) -> list[tuple]:
        """The ``count`` highest merges, highest first; on ties later steps, then larger ids, count as higher."""
        found = list(self.driver_merges)
        if self.spark_merges is not None:
            top = self.spark_merges.orderBy(F.desc("height"), F.desc("step"), F.desc("lo"), F.desc("hi")).limit(count)
            found += [tuple(r) for r in top.collect()]
        return sorted(found, key=lambda m: (m[2], m[4], m[0], m[1]), reverse=True)[:count]


def _nearest_in(
    ids: np.ndarray, sizes: np.ndarray, one: np.ndarray, others: np.ndarray, weights: np.ndarray, two: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, height): the nearest of ``others``, which ascend, for every one of ``ids`` that has one at a finite distance."""
    rows, columns, heights = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0)]
    parts, far = None, None
    for start, square, error in square_chunks(one, two, reuse=True) if len(ids) and len(others) else ():
        part = slice(start, start + len(square))
        own, n = ids[part], sizes[part, None]
        # slices write over the same memory: taking new memory costs more than the arithmetic
        if parts is None:
            parts, far = np.empty_like(square), np.empty(square.shape, dtype=bool)
        np.add(0.5 / n, 0.5 / weights, out=parts[:len(square)])
        square /= parts[:len(square)]
        itself = same_ids(own, others)
        square[itself] = np.inf
        # dot products tell who may be nearest, differences tell who is
        heaviest = 2 * n[:, 0] * weights.max() / (n[:, 0] + weights.max())
        may = np.greater(square, (square.min(axis=1) + 4 * error * heaviest)[:, None], out=far[:len(square)])
        np.logical_not(may, out=may)
        may[itself] = False
        row, column = np.divmod(np.flatnonzero(may), len(others))
        near = np.sqrt(pair_squares(one[part], two, row, column)) * np.sqrt(2 * n[row, 0] * weights[column] / (n[row, 0] + weights[column]))
        # ties go to the smallest (lo, hi), so a tie cannot hide every mutual pair
        order = np.lexsort((np.maximum(own[row], others[column]), np.minimum(own[row], others[column]), near, row))
        first = order[np.unique(row[order], return_index=True)[1]]
        first = first[np.isfinite(near[first])]
        rows.append(start + row[first])
        columns.append(column[first])
        heights.append(near[first])
    return np.concatenate(rows), np.concatenate(columns), np.concatenate(heights)


def _nearest_of(left: DataFrame, right: DataFrame, counts: tuple[int, int], block_rows: int) -> DataFrame:
    """(id, lo, hi, height): for every cluster of ``left`` the nearest other one of ``right``, by Ward distance."""

    def best(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values("id")
        ids, others = left["id"].to_numpy(), right["id"].to_numpy()
        if not len(left) or not len(right):
            return pd.DataFrame({"id": ids[:0], "other": others[:0], "height": np.empty(0)})
        sides = (left["size"].to_numpy(float), matrix(left["vec"])), (right["size"].to_numpy(float), matrix(right["vec"]))
        row, column, height = _nearest_in(ids, *sides[0], others, *sides[1])
        return pd.DataFrame({"id": ids[row], "other": others[column], "height": height})

    near = against(left, right, best, "id bigint, other bigint, height double", block_rows, counts)
    return near.select("id", F.least("id", "other").alias("lo"), F.greatest("id", "other").alias("hi"), "height")


def _smallest(near: DataFrame) -> DataFrame:
    picked = near.groupBy("id").agg(F.min(F.struct("height", "lo", "hi")).alias("_near"))
    return picked.select("id", "_near.lo", "_near.hi", "_near.height")


def _refreshed(clusters: DataFrame, near: DataFrame, mutual: DataFrame, block_rows: int) -> tuple[DataFrame, int]:
    """The nearest neighbours after a round, and the pairs looked at for them.

    A merged cluster is no nearer to a third one than its nearer part was. So where the
    neighbour was not merged, it is still nearest, except that a merged cluster may tie with it.
    """
    ends = mutual.select(F.explode(F.array("lo", "hi")).alias("_end"), F.lit(True).alias("_lost"))
    other = F.when(F.col("id") == F.col("lo"), F.col("hi")).otherwise(F.col("lo"))
    made = mutual.select(F.col("lo").alias("id"), F.lit(True).alias("_merged"))
    told = near.withColumn("_other", other).join(ends, F.col("_other") == F.col("_end"), "left")
    marked = written(clusters.join(told.select("id", "lo", "hi", "height", "_lost"), "id", "left").join(made, "id", "left").withColumn(
        "_kept", F.when(F.col("lo").isNotNull() & F.col("_lost").isNull() & F.col("_merged").isNull(), True)
    ).drop("_lost"), "marked_clusters")
    columns = ["id", "vec", "size"]
    sizes = marked.agg(F.count(F.lit(1)), F.count("_kept"), F.count("_merged")).head()
    stale, rest, merged = (marked.filter(c).select(*columns) for c in ("_kept is null", "_kept is not null", "_merged is not null"))
    looked = _nearest_of(stale, marked.select(*columns), (sizes[0] - sizes[1], sizes[0]), block_rows)
    found = looked.unionByName(marked.filter("_kept is not null").select("id", "lo", "hi", "height"))
    if sizes[1]:
        found = found.unionByName(_nearest_of(rest, merged, (sizes[1], sizes[2]), block_rows))
    return written(_smallest(found), "neighbours"), (sizes[0] - sizes[1]) * sizes[0] + sizes[1] * sizes[2]


def micro_centroids(vectors: DataFrame, count: int) -> DataFrame:
    """(vec, id, size, grupo): every weighted vector with the k-means group it falls into; at most ``count`` groups."""
    weighted = vectors.withColumn("_features", array_to_vector("vec")).withColumn("_weight", F.col("size").cast("double"))
    model = KMeans(
        k=count, maxIter=MICRO_ROUNDS, seed=MICRO_SEED, featuresCol="_features", weightCol="_weight", predictionCol="grupo",
    ).fit(weighted)
    return model.transform(weighted).drop("_features", "_weight")


def _finish_on_driver(rows: list[Row], step: int) -> list[tuple]:
    """Ward merges of at most FINISH weighted centroids, lowest first."""
    rows = sorted(rows, key=lambda r: r["id"])
    ids = [r["id"] for r in rows]
    size = np.array([r["size"] for r in rows], dtype=float)
    center = np.array([r["vec"] for r in rows], dtype=float)
    count = len(ids)
    square = np.full((count, count), np.inf)

    def refresh(i: int, alive: np.ndarray) -> None:
        gap = center[alive] - center[i]
        line = np.full(count, np.inf)
        line[alive] = 2 * size[i] * size[alive] / (size[i] + size[alive]) * np.einsum("ij,ij->i", gap, gap)
        line[i] = np.inf
        square[i, :], square[:, i] = line, line

    alive = np.ones(count, dtype=bool)
    for i in range(count):
        refresh(i, alive)
    merges = []
    for n in range(count - 1):
        a, b = sorted(divmod(int(square.argmin()), count))
        height = float(np.sqrt(square[a, b]))
        center[a] = (size[a] * center[a] + size[b] * center[b]) / (size[a] + size[b])
        size[a] += size[b]
        alive[b] = False
        square[b, :], square[:, b] = np.inf, np.inf
        refresh(a, alive)
        merges.append((ids[a], ids[b], height, int(size[a]), step + n))
    return merges


def _merged_pairs(clusters: DataFrame, near: DataFrame) -> DataFrame:
    """(id, vec, size, lo, hi, height): the clusters after a round; the last three where two were merged.

    Both clusters of a mutual pair, and no others, name the same pair.
    """
    named = clusters.join(near, "id", "left").groupBy(F.coalesce("lo", "id").alias("lo"), F.coalesce("hi", "id").alias("hi")).agg(
        F.sum("size").alias("size"), F.min("height").alias("height"), F.collect_list(F.struct("id", "size", "vec")).alias("_parts"),  # one or two
    )
    first, second, both = F.get("_parts", F.lit(0)), F.get("_parts", F.lit(1)), F.size("_parts") == 2
    mean = F.zip_with(first["vec"], second["vec"], lambda x, y: (x * first["size"] + y * second["size"]) / F.col("size"))
    return named.select(
        F.when(both, F.col("lo")).otherwise(first["id"]).alias("id"), F.when(both, mean).otherwise(first["vec"]).alias("vec"), "size",
        *[F.when(both, F.col(c)).alias(c) for c in ("lo", "hi", "height")],
    )


def _rounds_inside(finish: int, step: int):
    """Rounds of mutual-nearest merges inside one task, until at most ``finish`` of its clusters remain.

    Emits the merges (without ``id``) and the clusters that remain (with ``id`` and ``vec``): the
    same merges, round by round, as the rounds on Spark.
    """
    def rounds(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("id")
        ids, size, center = part["id"].to_numpy(), part["size"].to_numpy(), matrix(part["vec"])
        lo, hi, height = ids.copy(), ids.copy(), np.full(len(ids), np.inf)
        stale, made, done, at = np.ones(len(ids), dtype=bool), np.zeros(len(ids), dtype=bool), [], step
        while len(ids) > finish:
            # the others' neighbours are remembered, as in _refreshed
            height[stale] = np.inf
            for left, right in ((stale, np.ones(len(ids), dtype=bool)), (~stale, made)):
                row, column, found = _nearest_in(ids[left], size[left].astype(float), center[left], ids[right], size[right].astype(float), center[right])
                row, other = np.nonzero(left)[0][row], ids[right][column]
                low, high = np.minimum(ids[row], other), np.maximum(ids[row], other)
                tied = (found == height[row]) & ((low < lo[row]) | ((low == lo[row]) & (high < hi[row])))
                better = (found < height[row]) | tied
                row = row[better]
                lo[row], hi[row], height[row] = low[better], high[better], found[better]
            one, two = np.searchsorted(ids, lo), np.searchsorted(ids, hi)
            mutual = (lo != hi) & np.isfinite(height) & (lo[one] == lo[two]) & (hi[one] == hi[two]) & np.isfinite(height[one]) & np.isfinite(height[two])
            a = np.nonzero(mutual & (one == np.arange(len(ids))))[0]
            b = two[a]
            if not len(a):
                raise ValueError(f"{len(ids)} clusters remain and no two are at a finite distance")
            total = size[a] + size[b]
            center[a] = (center[a] * size[a, None] + center[b] * size[b, None]) / total[:, None]
            size[a] = total
            done.append(pd.DataFrame({"lo": ids[a], "hi": ids[b], "height": height[a], "size": total, "step": at, "vec": None}))
            merged = np.zeros(len(ids), dtype=bool)
            merged[a] = merged[b] = True
            # without a neighbour there is none to lose: looked for again
            stale = merged[np.where(one == np.arange(len(ids)), two, one)] | ~np.isfinite(height)
            made = np.zeros(len(ids), dtype=bool)
            made[a] = True
            keep = np.ones(len(ids), dtype=bool)
            keep[b] = False
            ids, size, center, lo, hi, height, stale, made = (x[keep] for x in (ids, size, center, lo, hi, height, stale, made))
            at += 1
        left = pd.DataFrame({"size": size, "id": ids, "vec": list(center)})
        ended = pd.concat([*done, left]).astype({c: "Int64" for c in ("lo", "hi", "size", "step", "id")})
        return ended[["lo", "hi", "height", "size", "step", "id", "vec"]]

    return rounds


def ward_tree(
    rows: DataFrame, finish: int = FINISH, block_rows: int = BLOCK_ROWS, micro: int | None = None, inside: int = INSIDE,
) -> WardTree:
    """Ward tree of ``rows`` (``id`` bigint unique, ``vec``).

    Equal vectors are merged first, at height 0, into the smallest of their ids: one aggregate
    instead of a round for each. The tree is exact, unless there are more than ``micro``
    distinct vectors: then so are the vectors of each of ``micro`` k-means groups, and the tree is
    that of the groups' weighted centroids. It says nothing about what is inside a group.
    At most ``inside`` clusters go to one task, which does the rounds that are left.
    """
    leaves = stage(rows.select("id", F.col("vec").cast("array<double>").alias("vec")))
    clusters = stage(leaves.groupBy("vec").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("size")).select("id", "vec", "size"))
    count, step, done = clusters.count(), 1, None
    if count < leaves.count():
        done = leaves.join(clusters.filter("size > 1").withColumnRenamed("id", "lo"), "vec").filter("id <> lo").select(
            "lo", F.col("id").alias("hi"), F.lit(0.0).alias("height"), "size", F.lit(0).cast("bigint").alias("step")
        )
    if micro is not None and count > micro:
        grouped = stage(micro_centroids(clusters, micro))
        weighted = Summarizer.metrics("mean").summary(array_to_vector("vec"), F.col("size").cast("double"))
        centres = stage(grouped.groupBy("grupo").agg(F.min("id").alias("lo"), F.sum("size").alias("size"), weighted.alias("_s")))
        clusters = stage(centres.select(F.col("lo").alias("id"), vector_to_array("_s.mean").alias("vec"), "size"))
        gathered = grouped.select("id", "grupo").join(centres.select("grupo", "lo", "size"), "grupo").filter("id <> lo").select(
            "lo", F.col("id").alias("hi"), F.lit(0.0).alias("height"), "size", F.lit(step).cast("bigint").alias("step")
        )
        done = gathered if done is None else done.unionByName(gathered)
        count, step = clusters.count(), step + 1
    near, compared = None, []
    while count > max(finish, inside):
        if near is None:
            near = written(_smallest(_nearest_of(clusters, clusters, (count, count), block_rows)), "neighbours")
            compared.append(count * count)
        # a table and not a checkpoint: what a checkpoint knows of its rows piles up from round to round
        state = written(_merged_pairs(clusters, near), "clusters")
        mutual, clusters = state.filter("height is not null").select("lo", "hi", "height"), state.select("id", "vec", "size")
        merged = state.filter("height is not null").select("lo", "hi", "height", "size", F.lit(step).cast("bigint").alias("step"))
        done = merged if done is None else done.unionByName(merged)
        count, step = state.count(), step + 1
        if count > max(finish, inside):
            near, looked = _refreshed(clusters, near, mutual, block_rows)
            compared.append(looked)
    if count > finish:
        compared.append(count * count)
        ended = written(clusters.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(_rounds_inside(finish, step), f"{MERGES}, id bigint, vec array<double>"), "inside")
        merged, clusters = ended.filter("id is null").select("lo", "hi", "height", "size", "step"), ended.filter("id is not null")
        done = merged if done is None else done.unionByName(merged)
        step = merged.agg(F.max("step")).head()[0] + 1
    finished = _finish_on_driver(clusters.select("id", "vec", "size").collect(), step)
    return WardTree(leaves, None if done is None else stage(done), finished, compared)


def label_agreement(labels: DataFrame, one: str, two: str) -> DataFrame:
    """Adjusted Rand index of two labellings of the same rows; one row. 1 if they part the rows alike.

    From the counts of label pairs, so rows are read once and reduced where they are.
    """
    pairs = lambda n: F.sum(F.col(n).cast("double") * (F.col(n) - 1) / 2)
    cells = stage(labels.groupBy(one, two).agg(F.count(F.lit(1)).alias("n")))
    sides = {f"of_{i}": cells.groupBy(c).agg(F.sum("n").alias("n")).agg(pairs("n")).scalar() for i, c in enumerate((one, two))}
    whole = cells.agg(pairs("n").alias("both"), F.sum("n").alias("rows")).withColumns(sides)
    expected = F.col("of_0") * F.col("of_1") / (F.col("rows").cast("double") * (F.col("rows") - 1) / 2)
    most = (F.col("of_0") + F.col("of_1")) / 2
    return whole.select(F.when(most == expected, 1.0).otherwise((F.col("both") - expected) / F.when(most != expected, most - expected)).alias("acuerdo"))


def _follow(pointers: DataFrame) -> DataFrame:
    """(id, root) by pointer doubling: each join halves the longest chain."""
    current = stage(pointers)
    while True:
        further = current.alias("a").join(current.alias("b"), F.col("a.root") == F.col("b.id"), "left").select(
            F.col("a.id").alias("id"), F.coalesce("b.root", "a.root").alias("root"),
            F.col("b.root").isNotNull().alias("_moved"),
        )
        moved = written(further, "roots")
        if not moved.filter("_moved").limit(1).count():
            return moved.select("id", "root")
        current = moved.select("id", "root")


def _ranked(links: DataFrame) -> DataFrame:
    """(id, root, ahead): how many leaves lie between a root and each row, by pointer doubling.

    ``links`` has id (absorbed), root (absorbing) and ahead (from the absorbing row). Each join
    halves the longest chain and adds two numbers: list ranking.
    """
    current = links.select("id", "root", "ahead")
    while True:
        a, b = current.alias("a"), current.alias("b")
        moved = written(a.join(b, F.col("a.root") == F.col("b.id"), "left").select(
            F.col("a.id").alias("id"), F.coalesce("b.root", "a.root").alias("root"),
            (F.col("a.ahead") + F.coalesce("b.ahead", F.lit(0))).alias("ahead"), F.col("b.id").isNotNull().alias("_moved"),
        ), "ranked")
        current = moved.drop("_moved")
        if moved.filter("_moved").isEmpty():
            return current


def leaf_positions(tree: WardTree) -> DataFrame:
    """(id, posicion): the place of every row along the tree, from 0.

    A representative comes first, then the clusters it took in, in the order of the merges, each
    with its own representative first. So an absorbed cluster begins as many places behind the
    absorbing one as that had members then: one number a merge, summed along the chain of
    merges. The order is that of the tree wherever it was merged.
    """
    spark, ids = tree.leaves.sparkSession, tree.leaves.select("id")
    line: dict[int, list[int]] = {}
    for lo, hi, *_ in tree.driver_merges:
        line.setdefault(lo, [lo]).extend(line.pop(hi, [hi]))
    reps = [rep for found in line.values() for rep in found]
    if tree.spark_merges is None:
        based, sizes = ids.select("id", F.col("id").alias("rep"), F.lit(0).cast("bigint").alias("ahead")), {}
    else:
        merges = tree.spark_merges.select("lo", "hi", "step")
        members = tree.spark_merges.groupBy(F.col("lo").alias("id")).agg(F.max("size").alias("members"))
        # equal vectors may be very many for one row: they are numbered in many tasks
        equal = spread_row_number(merges.filter("step = 0"), ["lo"], [F.col("hi").asc()], "ahead").select("lo", "hi", "ahead")
        copies = equal.groupBy(F.col("lo").alias("_of")).agg(F.count(F.lit(1)).alias("_copies"))
        later = merges.filter("step > 0").join(members.withColumnRenamed("id", "hi"), "hi", "left").join(copies, F.col("lo") == F.col("_of"), "left")
        earlier = Window.partitionBy("lo").orderBy("step", "hi").rowsBetween(Window.unboundedPreceding, -1)
        behind = F.coalesce(F.sum(F.coalesce("members", F.lit(1))).over(earlier), F.lit(0)) + 1 + F.coalesce("_copies", F.lit(0))
        links = written(equal.unionByName(later.select("lo", "hi", behind.cast("bigint").alias("ahead"))), "links")
        based = ids.join(_ranked(links.select(F.col("hi").alias("id"), F.col("lo").alias("root"), "ahead")), "id", "left").select(
            "id", F.coalesce("root", "id").alias("rep"), F.coalesce("ahead", F.lit(0)).alias("ahead")
        )
        # at most FINISH representatives are left for the driver
        sizes = {r["id"]: r["members"] for r in members.filter(F.col("id").isin(*reps)).collect()} if reps else {}
    starts, at = [], 0
    for rep in reps:
        starts.append((rep, at))
        at += sizes.get(rep, 1)
    known = literal_rows(spark, starts, "rep bigint, inicio bigint")
    return based.join(broadcast_if_small(known), "rep", "left").select("id", (F.coalesce("inicio", F.lit(0)) + F.col("ahead")).alias("posicion"))


def cut_tree(tree: WardTree, counts: Collection[int]) -> DataFrame:
    """(id, k, label) for every candidate count; labels are representative ids."""
    deepest = max(counts)
    dropped = tree.highest(deepest - 1)
    cut = {m[1] for m in dropped}
    parent = {m[1]: m[0] for m in tree.driver_merges if m[1] not in cut}

    def root_of(rep: int) -> int:
        while rep in parent:
            rep = parent[rep]
        return rep

    spark = tree.leaves.sparkSession
    ids = tree.leaves.select("id")
    if tree.spark_merges is not None:
        links = tree.spark_merges.filter(~F.col("hi").isin(*cut)).select(F.col("hi").alias("id"), F.col("lo").alias("root"))
        rooted = ids.join(_follow(links), "id", "left").withColumn("rep", F.coalesce("root", "id")).drop("root")
    else:
        rooted = ids.withColumn("rep", F.col("id"))
    # bounded: representatives that the driver merged, and at most `deepest` roots per count
    driver = literal_rows(spark, [(r, root_of(r)) for r in parent], "rep bigint, root bigint")
    based = rooted.join(broadcast_if_small(driver), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    roots = {root_of(m[0]) for m in dropped} | {root_of(m[1]) for m in dropped}
    entries = []
    for k in sorted(set(counts)):
        joined = {m[1]: m[0] for m in dropped[k - 1:]}

        def label_of(root: int) -> int:
            while root in joined:
                root = root_of(joined[root])
            return root

        labels = {r: label_of(r) for r in roots} or {0: 0}
        mapping = F.create_map(*[F.lit(x).cast("bigint") for pair in labels.items() for x in pair])
        label = F.coalesce(F.try_element_at(mapping, F.col("root")), F.col("root"))
        entries.append(F.struct(F.lit(k).alias("k"), label.alias("label")))
    return based.select("id", F.inline(F.array(*entries)))


def mean_silhouette(rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    return silhouette_rows(rows, block_rows).agg(F.avg("silhouette").alias("silhouette"))


def calinski_harabasz(rows: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Between over within dispersion, each by its degrees of freedom; one row (for each ``by``)."""
    stats = label_centroids(rows, by)
    # from here on there is one row per label and coordinate
    cells = stats.select(*by, "label", "n", (F.col("spread") * F.col("n")).alias("w"), F.posexplode("centroid").alias("dim", "m"))
    per_dim = cells.groupBy(*by, "dim").agg(
        F.sum("n").alias("n"), F.count("label").alias("labels"), F.sum("w").alias("w"),
        (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("whole"),
    )
    # centroids far from zero would lose their digits in a difference of squares
    gap = F.col("m") - F.col("whole")
    between = cells.join(per_dim.select(*by, "dim", "whole"), [*by, "dim"]).groupBy(*by, "dim").agg(F.sum(F.col("n") * gap * gap).alias("b"))
    per_dim = per_dim.join(between, [*by, "dim"])
    whole = per_dim.groupBy(*by).agg(F.max("n").alias("n"), F.max("labels").alias("labels"), F.max("w").alias("w"), F.sum("b").alias("b"))
    n, k, w, b = (F.col(c) for c in ("n", "labels", "w", "b"))
    score = F.when(w == 0, 1.0).otherwise(b / F.when(w != 0, w) * (n - k) / (k - 1))
    return whole.select(*by, score.alias("calinski_harabasz"))


def davies_bouldin(rows: DataFrame, block_rows: int = BLOCK_ROWS, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean over clusters of the worst (scatter + scatter) / centroid distance; one row (for each ``by``)."""
    typed = rows.select(*by, "label", F.col("vec").cast("array<double>").alias("vec"))
    centers = stage(label_centroids(typed, by).select(*by, "label", "centroid"))
    # one row per label: counted before it is broadcast
    scatter = typed.join(broadcast_if_small(centers), [*by, "label"]).groupBy(*by, "label").agg(
        F.avg(euclidean(F.col("vec"), F.col("centroid"))).alias("scatter")
    )
    # the labels of one labelling are compared with one another only
    stats = stage(centers.join(scatter, [*by, "label"]).select(
        F.struct(*by, "label").alias("key"), F.xxhash64(F.lit(0), *by).alias("cut"), F.xxhash64(*by, "label").alias("id"), F.col("centroid").alias("vec"), "scatter"
    ))

    def worst(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ids, spread = left["id"].to_numpy(), left["scatter"].to_numpy()
        parts = [pd.DataFrame({"id": ids[:0], "ratio": spread[:0]})]
        for start, dist in distance_chunks(matrix(left["vec"]), matrix(right["vec"])) if len(left) and len(right) else ():
            own, s = ids[start:start + len(dist)], spread[start:start + len(dist), None]
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = (s + right["scatter"].to_numpy()[None, :]) / np.where(dist == 0, np.inf, dist)
            ratio[own[:, None] == right["id"].to_numpy()[None, :]] = 0.0
            ratio[left["cut"].to_numpy()[start:start + len(dist), None] != right["cut"].to_numpy()[None, :]] = 0.0
            parts.append(pd.DataFrame({"id": own, "ratio": ratio.max(axis=1)}))
        return pd.concat(parts)

    found = against_all(stats.select("id", "cut", "vec", "scatter"), worst, "id bigint, ratio double", block_rows)
    ratios = found.groupBy("id").agg(F.max("ratio").alias("ratio")).join(stats.select("id", "key"), "id")
    return ratios.groupBy(*[F.col("key")[c].alias(c) for c in by]).agg(F.avg("ratio").alias("davies_bouldin"))


def principal_components(rows: DataFrame) -> tuple[DataFrame, tuple[float, float]]:
    """(id, CP1, CP2) and the explained-variance ratios; the sign is fixed by the loadings."""
    vectors = rows.select("id", array_to_vector(F.col("vec").cast("array<double>")).alias("_raw"))
    scaler = StandardScaler(inputCol="_raw", outputCol="_centred", withMean=True, withStd=False).fit(vectors)
    centred = scaler.transform(vectors)
    model = PCA(k=2, inputCol="_centred", outputCol="_pc").fit(centred)
    loadings = model.pc.toArray()
    signs = [1.0 if loadings[np.abs(loadings[:, j]).argmax(), j] >= 0 else -1.0 for j in (0, 1)]
    values = vector_to_array("_pc")
    projected = model.transform(centred).select(
        "id", *[(values[j] * signs[j]).alias(f"CP{j + 1}") for j in (0, 1)]
    )
    return projected, tuple(float(v) for v in model.explainedVariance.toArray())


SCORE_SCHEMA = "`Número de clústeres` bigint, `Silhouette` double, `Calinski-Harabasz` double, `Davies-Bouldin` double"


@dataclass(frozen=True)
class ClusterAnalysis:
    """Everything the clustering gives, as tables."""

    profile: DataFrame
    clr_features: DataFrame
    ids: DataFrame  # name and id in the tree: the place of the name
    tree: WardTree
    silhouette_scores: DataFrame
    selected_cluster_count: int
    assignments: DataFrame
    summary: DataFrame
    pca_projection: DataFrame
    pca_explained_variance_ratio: tuple[float, float]

    @property
    def ordered_municipalities(self) -> DataFrame:
        """(name, orden): municipalities in the order of the tree."""
        return self.ids.join(leaf_positions(self.tree), "id").select(NAME, (F.col("posicion") + 1).alias("orden"))

    @property
    def cluster_validation_scores(self) -> DataFrame:
        return self.silhouette_scores

    @property
    def linkage(self) -> DataFrame:
        return self.tree.merges


def candidate_counts(counts: Collection[int], samples: int, requested: int | None = None) -> list[int]:
    wanted = sorted({int(c) for c in counts} | ({int(requested)} if requested is not None else set()))
    if not list(counts):
        raise ContractError("cluster_counts must not be empty")
    if wanted[0] < 2 or wanted[-1] >= samples:
        raise ContractError("a cluster count must lie between 2 and the number of municipalities minus 1")
    return wanted


def score_cuts(labelled: DataFrame, counts: Collection[int], block_rows: int = BLOCK_ROWS) -> tuple[list[tuple], DataFrame]:
    """(k, silhouette, Calinski-Harabasz, Davies-Bouldin) per candidate, and the silhouettes (id, k, silhouette) of all rows.

    ``labelled`` has id, k, label and vec. Every distance is computed once for all candidates.
    """
    wanted = sorted(set(counts))
    labels = F.transform(F.array_sort(F.collect_list(F.struct("k", "label"))), lambda x: x["label"])
    # as many labels as candidates
    wide = labelled.filter(F.col("k").isin(*wanted)).groupBy("id").agg(F.any_value("vec").alias("vec"), labels.alias("labels"))
    position = F.element_at(F.array(*[F.lit(k).cast("bigint") for k in wanted]), F.col("corte") + 1)
    silhouettes = stage(silhouette_cuts(wide, block_rows).select("id", position.alias("k"), "silhouette"))
    mean = silhouettes.groupBy("k").agg(F.avg("silhouette").alias("silhouette"))
    rows = labelled.filter(F.col("k").isin(*wanted)).select("id", F.col("k").cast("bigint").alias("k"), "label", "vec")
    found = mean.join(calinski_harabasz(rows, ("k",)), "k").join(davies_bouldin(rows, block_rows, ("k",)), "k")
    # a row per candidate
    return [tuple(r) for r in found.select("k", "silhouette", "calinski_harabasz", "davies_bouldin").orderBy("k").collect()], silhouettes


def cluster_municipalities_by_income_profile(
    income: DataFrame, *, cluster_counts: Collection[int] = range(2, 7), cluster_count: int | None = None,
    zero_replacement: float = 0.001, finish: int = FINISH, block_rows: int = BLOCK_ROWS, micro: int | None = MICRO,
) -> ClusterAnalysis:
    """Ward clusters of the log-ratio profiles; the best silhouette picks k unless k is given.

    The tree is exact up to ``micro`` different profiles, and at any size with None (see ``ward_tree``).
    """
    profile = stage(ensure_municipality_income_profile(income))
    samples = profile.count()
    if samples < 3:
        raise ContractError("at least three municipalities are needed")
    counts = candidate_counts(cluster_counts, samples, cluster_count)
    features = clr_features(profile, zero_replacement)
    # ids are places in the order of names: the tree, its ties and its order depend on names alone
    ids = stage(spread_row_number(features, [], [F.col(NAME).asc()], "id").withColumnRenamed("clr", "vec"))
    tree = ward_tree(ids, finish, block_rows, micro)
    labelled = stage(cut_tree(tree, counts).join(ids, "id"))
    scores, all_silhouettes = score_cuts(labelled, counts, block_rows)
    best = int(cluster_count) if cluster_count is not None else max(scores, key=lambda s: (s[1], -s[0]))[0]
    spark = income.sparkSession
    score_table = literal_rows(spark, scores, SCORE_SCHEMA)

    chosen = labelled.filter(F.col("k") == best)
    # clusters are numbered by their smallest municipality name; there are `best` of them
    firsts = sorted((r["first"], r["label"]) for r in chosen.groupBy("label").agg(F.min(NAME).alias("first")).collect())
    numbers = F.create_map(*[x for i, (_, label) in enumerate(firsts, 1) for x in (F.lit(label), F.lit(i).cast("bigint"))])
    numbered = chosen.withColumn("cluster_id", F.element_at(numbers, F.col("label"))).select("id", NAME, "cluster_id", "vec")
    silhouettes = all_silhouettes.filter(F.col("k") == best).select("id", "silhouette")
    projection, ratios = principal_components(ids)
    assignments = stage(
        numbered.drop("vec").join(silhouettes, "id").join(projection, "id").join(profile.select(NAME, TOTAL), NAME)
        .select(
            NAME, "cluster_id", F.concat(F.lit("Clúster "), F.col("cluster_id").cast("string")).alias("Clúster"),
            (F.col(TOTAL) / 1e9).alias("Ingreso total (mil MM CLP)"),
            F.col("silhouette").alias("Silhouette"), "CP1", "CP2",
        )
    )
    summary = cluster_summary(profile.join(assignments.select(NAME, "cluster_id"), NAME))
    return ClusterAnalysis(
        profile, features, ids.select(NAME, "id"), tree, score_table, best, assignments, summary,
        assignments.select(NAME, "CP1", "CP2"), ratios,
    )


def cluster_summary(labelled_profile: DataFrame) -> DataFrame:
    """Mean share per group (unweighted), members, and exact median total in thousands of millions."""
    profile = stage(labelled_profile.select("cluster_id", TOTAL, *SHARES))
    medians = exact_median(profile, ["cluster_id"], TOTAL, "_median")
    means = profile.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("Número de comunas"), *[F.avg(s).alias(g) for s, g in zip(SHARES, INCOME_GROUPS)],
    )
    return join_same(means, medians, ["cluster_id"]).withColumn("Ingreso total mediano (mil MM CLP)", F.col("_median") / 1e9).select(
        "cluster_id", F.concat(F.lit("Clúster "), F.col("cluster_id").cast("string")).alias("Clúster"),
        "Número de comunas", "Ingreso total mediano (mil MM CLP)", *INCOME_GROUPS,
    )


def cluster_membership(assignments: DataFrame, cluster_count: int) -> DataFrame:
    """A boolean column per cluster."""
    return assignments.select(F.col(NAME).alias("comuna"), *[
        (F.col("cluster_id") == k).alias(f"cluster{k}") for k in range(1, cluster_count + 1)
    ])


def export_cluster_membership_csv(analysis: ClusterAnalysis, output_path: str = "clusters.csv") -> DataFrame:
    membership = cluster_membership(analysis.assignments, analysis.selected_cluster_count)
    membership.write.mode("overwrite").option("header", True).csv(output_path)
    return membership


def find_similar_municipalities(analysis: ClusterAnalysis, municipality: str, *, n_neighbors: int = 5) -> DataFrame:
    """The nearest municipalities of one: its vector (one row) goes into the plan as constants."""
    wanted = plain_casefold(F.lit(str(municipality)))
    found = analysis.clr_features.filter(plain_casefold(F.col(NAME)) == wanted).take(2)
    if not found:
        raise ContractError(f"municipality {municipality!r} does not exist")
    if len(found) > 1:
        raise ContractError(f"municipality name {municipality!r} is ambiguous")
    if not 1 <= int(n_neighbors) < analysis.clr_features.count():
        raise ContractError("n_neighbors must lie between 1 and the number of municipalities minus 1")
    target, vector = found[0][NAME], F.array(*[F.lit(float(x)) for x in found[0]["clr"]])
    listed = stage(
        analysis.clr_features.filter(F.col(NAME) != target)
        .select(NAME, euclidean(F.col("clr"), vector).alias("Distancia CLR"))
        .orderBy("Distancia CLR", NAME).limit(int(n_neighbors))
    )
    order = [F.col("Distancia CLR").asc(), F.col(NAME).asc()]
    ranked = spread_row_number(listed, [], order, "Ranking de similitud").withColumn("Comuna de referencia", F.lit(target))
    details = analysis.assignments.select(NAME, "cluster_id", "Clúster", "Silhouette")
    return details.join(broadcast_if_small(ranked), NAME).select(
        "Comuna de referencia", NAME, "Ranking de similitud", "Distancia CLR", "cluster_id", "Clúster", "Silhouette"
    ).orderBy("Ranking de similitud")


def similar_municipalities(features: DataFrame, n_neighbors: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The nearest municipalities of every one."""
    rows = features.select(F.col(NAME).alias("id"), F.col("clr").alias("vec"))
    return nearest_rows(rows, n_neighbors, block_rows).select(
        F.col("id").alias("Comuna de referencia"), F.col("vecino").alias(NAME),
        F.col("puesto").alias("Ranking de similitud"), F.col("distancia").alias("Distancia CLR"),
    )
