"""Blocks, pivots, remembered neighbours and micro-centroids against brute force."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from arqueo.operators import clusters, pairwise


def frame(spark, data, labels=None):
    rows = [(i, [float(x) for x in v], *([labels[i]] if labels is not None else [])) for i, v in enumerate(data)]
    return spark.createDataFrame(rows, "id bigint, vec array<double>" + (", label int" if labels is not None else ""))


def clustered(places=12, each=60, seed=3):
    draw = np.random.default_rng(seed)
    return np.concatenate([draw.normal(c, 0.5, (each, 3)) for c in draw.uniform(-60, 60, (places, 3))])


def test_tiles_emit_both_sides_once(spark):
    rows = spark.range(50)
    seen = pairwise.triangular(rows, lambda a, b, same: (a if same else a.iloc[:0])[["id"]].assign(n=1), "id bigint, n int", 8)
    assert sorted(r.id for r in seen.collect()) == list(range(50))  # the diagonal has every row once

    def tile(a, b, same):
        return a[["id"]].assign(n=len(b)) if same else __import__("pandas").concat([a[["id"]].assign(n=len(b)), b[["id"]].assign(n=len(a))])

    met = pairwise.triangular(rows, tile, "id bigint, n int", 8).groupBy("id").agg(F.sum("n").alias("n")).collect()
    assert {r.n for r in met} == {50}


def silhouettes(data, labels):
    dist, out = np.linalg.norm(data[:, None] - data[None], axis=2), []
    for i, own in enumerate(labels):
        same = (labels == own) & (np.arange(len(data)) != i)
        others = [dist[i, labels == k].mean() for k in set(labels) - {own}]
        out.append(0.0 if not same.any() or not others else (min(others) - dist[i, same].mean()) / max(min(others), dist[i, same].mean()))
    return out


@pytest.mark.parametrize("block", [2048, 13])
def test_all_labellings_in_one_pass(spark, block):
    data = clustered(5, 20)
    cuts = [np.arange(100) % 3, np.arange(100) // 20, np.minimum(np.arange(100), 60), np.zeros(100, int)]
    rows = frame(spark, data).withColumn("labels", F.array(*[F.element_at(F.array(*[F.lit(int(x)) for x in c]), F.col("id").cast("int") + 1) for c in cuts]))
    got = {(r.id, r.corte): r.silhouette for r in pairwise.silhouette_cuts(rows, block).collect()}
    for c, labels in enumerate(cuts):
        assert np.allclose([got[i, c] for i in range(100)], silhouettes(data, labels))


@pytest.mark.parametrize("block", [2048, 9])
def test_squared_silhouette_without_a_bound_on_labels(spark, block):
    data, labels = clustered(4, 15), np.minimum(np.arange(60) // 2, 20)
    dist, want = ((data[:, None] - data[None]) ** 2).sum(axis=2), []
    for i, own in enumerate(labels):
        same = (labels == own) & (np.arange(60) != i)
        b = min(dist[i, labels == k].mean() for k in set(labels) - {own})
        want.append((b - dist[i, same].mean()) / max(b, dist[i, same].mean()) if same.any() else 0.0)
    got = {r.id: r.silhouette for r in pairwise.squared_silhouette_rows(frame(spark, data, [int(x) for x in labels]), block).collect()}
    assert np.allclose([got[i] for i in range(60)], want)


@pytest.mark.parametrize("data", [clustered(), np.random.default_rng(1).normal(size=(300, 4)), np.repeat(clustered(3, 30), 5, axis=0)])
def test_pivots_lose_no_neighbour(spark, data):
    dist = np.linalg.norm(data[:, None] - data[None], axis=2)
    np.fill_diagonal(dist, np.inf)
    got = {(r.id, r.puesto): (r.vecino, r.distancia) for r in pairwise.nearest_rows(frame(spark, data), 4, block_rows=40, pivots=24).collect()}
    assert len(got) == 4 * len(data)
    for i in range(len(data)):
        order = np.lexsort((np.arange(len(data)), dist[i]))[:4]
        assert [got[i, p + 1][0] for p in range(4)] == list(order)


def test_pivots_skip_most_pairs_of_blocks(spark):
    rows = frame(spark, clustered())
    search = pairwise.NeighbourSearch(rows, rows.count(), 4, 40, 24)
    pairs = search.wanted().select("block", "other").distinct().count()
    assert pairs < search.total ** 2 / 2
    # a dense place is many blocks
    assert search.cells.groupBy("block").count().agg(F.max("count")).head()[0] < 120


def merges(tree):
    return sorted((r.lo, r.hi, round(r.height, 9)) for r in tree.merges.collect())


@pytest.mark.parametrize("data", [
    np.random.default_rng(8).normal(size=(30, 3)),
    np.array(list(itertools.product(range(3), range(3), range(3))), float),  # many equal distances
    np.eye(9),  # all distances are equal
])
def test_remembered_neighbours_give_the_same_tree(spark, monkeypatch, data):
    rows = frame(spark, data)
    kept = clusters.ward_tree(rows, finish=2, block_rows=16)

    def forgetful(found, near, mutual, block_rows):
        n = found.count()
        return clusters.written(clusters._smallest(clusters._nearest_of(found, found, (n, n), block_rows)), "neighbours"), n * n

    monkeypatch.setattr(clusters, "_refreshed", forgetful)
    whole = clusters.ward_tree(rows, finish=2, block_rows=16)
    assert merges(kept) == merges(whole) and len(merges(kept)) == len(data) - 1
    assert sum(kept.compared) <= sum(whole.compared) and kept.compared[0] == whole.compared[0]


def test_few_clusters_are_touched_late(spark):
    """A chain merges one pair a round: the others' neighbours are remembered."""
    data = np.cumsum(1.0 + 0.05 * np.arange(40))[:, None] ** 1.2
    tree = clusters.ward_tree(frame(spark, data), finish=35, block_rows=64)
    count = 40
    for looked in tree.compared[1:]:
        count -= 1
        assert looked < count * count / 2


def test_micro_centroids(spark):
    data = np.concatenate([clustered(4, 60), clustered(4, 60)[:30]])  # with equal vectors
    rows = frame(spark, data)
    exact = clusters.ward_tree(rows)
    assert merges(clusters.ward_tree(rows, micro=240)) == merges(exact)
    tree = clusters.ward_tree(rows, micro=16)
    assert tree.merges.count() == len(data) - 1
    both = clusters.cut_tree(exact, [4]).withColumnRenamed("label", "uno").join(clusters.cut_tree(tree, [4]).withColumnRenamed("label", "otro"), ["id", "k"])
    assert clusters.label_agreement(both, "uno", "otro").head()[0] == 1.0
    assert clusters.label_agreement(both.withColumn("otro", F.lit(1)), "uno", "otro").head()[0] == 0.0
    assert clusters.cut_tree(tree, [4]).groupBy("label").count().count() == 4


def far_with_copies(seed=5):
    """Vectors far from the origin, with copies and near copies: dot products alone lose their distances."""
    draw = np.random.default_rng(seed)
    data = 1e4 + draw.normal(size=(120, 6))
    return np.concatenate([data, data[:30], data[:30] + 1e-5 * draw.normal(size=(30, 6))])


def test_close_pairs_keep_their_distances():
    data = far_with_copies()
    want = np.linalg.norm(data[:, None] - data[None], axis=2)
    got = np.concatenate([dist for _, dist in pairwise.summed_chunks(data, data)])
    assert np.allclose(got, want, rtol=1e-8, atol=0)
    odd = np.array([[np.nan, 1.0], [np.inf, 1.0], [3.0, 4.0]])
    with np.errstate(all="ignore"):
        want = np.concatenate([d for _, d in pairwise.distance_chunks(odd, odd)])
        assert np.array_equal(np.concatenate([d for _, d in pairwise.summed_chunks(odd, odd)]), want, equal_nan=True)


def test_neighbours_among_copies_far_from_the_origin(spark):
    data = far_with_copies()
    dist = np.linalg.norm(data[:, None] - data[None], axis=2)
    np.fill_diagonal(dist, np.inf)
    got = {(r.id, r.puesto): r.vecino for r in pairwise.nearest_rows(frame(spark, data), 3, block_rows=50, pivots=16).collect()}
    for i in range(len(data)):
        assert [got[i, p] for p in (1, 2, 3)] == list(np.lexsort((np.arange(len(data)), dist[i]))[:3])


def test_many_rows_are_sent_to_few_blocks(spark):
    """A row is sent once to a block: 352 blocks of 720,000 rows were as many copies, and pivots took 256 blocks of any size."""
    assert pairwise.block_count(720_000, 2_048) == 88 and pairwise.block_count(5_000, 2_048) == 3
    rows = frame(spark, np.random.default_rng(1).normal(size=(300, 4)))
    search = pairwise.NeighbourSearch(rows, 300, 4, 100, 64)
    assert search.total <= 6  # 64 before: a block for each pivot
    assert search.wanted().groupBy("id").count().agg(F.max("count")).head()[0] <= 6


def test_ward_tree_far_from_the_origin(spark):
    """Whole numbers have exact differences, so the tree stays the same wherever they lie."""
    data = np.random.default_rng(2).integers(0, 9, size=(60, 3)).astype(float)
    near, far = (merges(clusters.ward_tree(frame(spark, data + at), finish=20, block_rows=16)) for at in (0.0, 2.0 ** 20))
    assert [m[:2] for m in near] == [m[:2] for m in far] and np.allclose([m[2] for m in near], [m[2] for m in far])


@pytest.mark.parametrize("data", [
    np.random.default_rng(8).normal(size=(24, 3)),
    np.array(list(itertools.product(range(3), range(3), range(2))), float),  # many equal distances
])
def test_rounds_inside_one_task_are_those_on_spark(spark, data):
    rows = frame(spark, data)
    steps = lambda tree: sorted((r.step, r.lo, r.hi, r.size, round(r.height, 9)) for r in tree.merges.collect())
    spread, one = (clusters.ward_tree(rows, finish=5, block_rows=16, inside=n) for n in (0, 1000))
    assert steps(spread) == steps(one) and len(steps(one)) == len(data) - 1
    # the rounds of few clusters took some jobs each
    assert len(one.compared) == 1 < len(spread.compared)


def test_few_clusters_are_touched_late_on_spark(spark):
    data = np.cumsum(1.0 + 0.05 * np.arange(40))[:, None] ** 1.2
    tree = clusters.ward_tree(frame(spark, data), finish=37, block_rows=64, inside=0)
    assert len(tree.compared) == 3 and all(looked < n * n / 2 for looked, n in zip(tree.compared[1:], range(39, 30, -1)))


def test_vectors_at_no_finite_distance_stop_the_rounds(spark):
    rows = frame(spark, np.array([[np.nan]] * 3 + [[np.inf]] * 3 + [[-np.inf]]))
    with pytest.raises(Exception, match="no two are at a finite distance"):
        clusters.ward_tree(rows, finish=1)
