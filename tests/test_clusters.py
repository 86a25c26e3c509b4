import math

import numpy as np
import pytest

from arqueo.operators import clusters, geography, pairwise, profiles, ranking
from arqueo.plans import frames
from arqueo.schema import INCOME_GROUPS, ContractError
from pyspark.sql import functions as F


def points(n=40, seed=5):
    draw = np.random.default_rng(seed)
    return np.concatenate([draw.normal(c, 1.0, (n // 4, 3)) for c in (0, 6, 13, 30)])


@pytest.fixture(scope="module")
def vectors(spark):
    data = points()
    rows = [(i * 7 + 1, [float(x) for x in v], int(i % 3)) for i, v in enumerate(data)]
    return spark.createDataFrame(rows, "id bigint, vec array<double>, label int").cache(), data


def brute_ward(data):
    """Merge heights and partitions by exhaustive search."""
    groups, heights, partitions = [[i] for i in range(len(data))], [], {}
    while len(groups) > 1:
        partitions[len(groups)] = {frozenset(g) for g in groups}
        best = min(
            ((math.sqrt(2 * len(a) * len(b) / (len(a) + len(b))) * np.linalg.norm(data[a].mean(0) - data[b].mean(0)), i, j)
             for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        heights.append(best[0])
        groups = [g for k, g in enumerate(groups) if k not in best[1:]] + [groups[best[1]] + groups[best[2]]]
    return heights, partitions


@pytest.mark.parametrize("finish", [1000, 12, 2])
def test_ward_is_exact_wherever_it_finishes(vectors, finish):
    df, data = vectors
    tree = clusters.ward_tree(df, finish=finish, block_rows=16)
    heights, partitions = brute_ward(data)
    assert np.allclose(sorted(r.height for r in tree.merges.collect()), sorted(heights))
    cut = clusters.cut_tree(tree, [2, 3, 4, 6]).collect()
    for k in (2, 3, 4, 6):
        groups = {}
        for r in cut:
            if r.k == k:
                groups.setdefault(r.label, set()).add((r.id - 1) // 7)
        assert {frozenset(g) for g in groups.values()} == partitions[k]
    assert sorted(r.posicion for r in clusters.leaf_positions(tree).collect()) == list(range(len(data)))


def test_scores_against_numpy(vectors):
    df, data = vectors
    labels = np.array([i % 3 for i in range(len(data))])
    dist = np.linalg.norm(data[:, None] - data[None, :], axis=2)
    expected = []
    for i in range(len(data)):
        own = (labels == labels[i]) & (np.arange(len(data)) != i)
        a, b = dist[i, own].mean(), min(dist[i, labels == k].mean() for k in set(labels) - {labels[i]})
        expected.append((b - a) / max(a, b))
    got = {r.id: r.silhouette for r in pairwise.silhouette_rows(df, block_rows=7).collect()}
    assert np.allclose([got[i * 7 + 1] for i in range(len(data))], expected)


def test_singletons_have_silhouette_zero(spark):
    df = spark.createDataFrame([(1, [0.0], 0), (2, [1.0], 0), (3, [5.0], 1)], "id bigint, vec array<double>, label int")
    assert {r.id: r.silhouette for r in pairwise.silhouette_rows(df).collect()}[3] == 0.0


@pytest.mark.parametrize("block", [2048, 6])
def test_nearest_in_blocks(vectors, block):
    df, data = vectors
    dist = np.linalg.norm(data[:, None] - data[None, :], axis=2)
    np.fill_diagonal(dist, np.inf)
    got = {(r.id, r.puesto): r.vecino for r in pairwise.nearest_rows(df, 3, block).collect()}
    assert len(got) == 3 * len(data)
    for i in range(len(data)):
        assert [got[(i * 7 + 1, p)] for p in (1, 2, 3)] == [int(j) * 7 + 1 for j in np.argsort(dist[i])[:3]]


def test_spread_row_number_matches_a_window(spark):
    df = spark.range(500).select((F.col("id") * 7919 % 1000).alias("v"), F.when(F.col("id") % 3 == 0, F.col("id") % 5).otherwise(99).alias("k"))
    rows = ranking.spread_row_number(df, ["k"], [F.col("v").desc()], "n", partitions=6).collect()
    by_key = {}
    for r in rows:
        by_key.setdefault(r.k, []).append((r.n, r.v))
    for found in by_key.values():
        found.sort()
        assert [n for n, _ in found] == list(range(1, len(found) + 1))
        assert [v for _, v in found] == sorted((v for _, v in found), reverse=True)


@pytest.fixture(scope="module")
def income(spark):
    rows = []
    for i in range(12):
        weights = [5, 1, 0, 8, 2] if i % 2 else [1, 6, 3, 0, 9]
        rows += [(f"Comuna {i:02d}", g, float(w * 100 + (i % 3 if w else 0))) for g, w in zip(INCOME_GROUPS, weights)]
    return spark.createDataFrame(rows, "`Nombre Municipio` string, grupo_ingreso string, `Percibidopag Total` double").cache()


def test_analysis(spark, income, tmp_path):
    analysis = clusters.cluster_municipalities_by_income_profile(income, cluster_counts=[2, 3])
    assert analysis.selected_cluster_count == 2
    rows = {r["Nombre Municipio"]: r for r in analysis.assignments.collect()}
    assert {n: r["cluster_id"] for n, r in rows.items()} == {f"Comuna {i:02d}": 1 + i % 2 for i in range(12)}
    assert {r["Número de comunas"] for r in analysis.summary.collect()} == {6}
    near = clusters.find_similar_municipalities(analysis, " comuna 03 ", n_neighbors=3).collect()
    assert [r["Ranking de similitud"] for r in near] == [1, 2, 3] and {r["cluster_id"] for r in near} == {2}
    with pytest.raises(ContractError):
        clusters.find_similar_municipalities(analysis, "Nadie")
    with pytest.raises(ContractError):
        clusters.cluster_municipalities_by_income_profile(income, cluster_counts=[12])
    out = str(tmp_path / "clusters")
    clusters.export_cluster_membership_csv(analysis, out)
    from arqueo.sources.tables import cluster_members, read_membership
    assert cluster_members(read_membership(spark, out), "cluster1").count() == 6
    assert frames.validation_frame(analysis).filter("seleccionado").count() == 3
    assert frames.heatmap_frame(analysis).count() == 60 and frames.merge_frame(analysis).count() == 11
    assert sum(analysis.pca_explained_variance_ratio) <= 1.0 + 1e-9


def test_profile_checks(spark, income):
    profile = profiles.build_municipality_income_profile(income)
    first = profile.orderBy("Nombre Municipio").head()
    assert abs(sum(first[s] for s in profiles.SHARES) - 100) < 1e-9
    values = profiles.clr_features(profile).head()["clr"]
    assert abs(sum(values)) < 1e-9
    for name, group, amount in [("", "IPP", 1.0), ("a", "Nada", 1.0), ("a", "IPP", None), ("a", "IPP", -1.0), ("a", "IPP", 0.0)]:
        bad = spark.createDataFrame([(name, group, amount)], income.schema)
        with pytest.raises(Exception, match="row without|income|negative|not positive"):
            profiles.build_municipality_income_profile(bad).collect()


def test_map_checks(spark, income):
    shapes = spark.createDataFrame([(13, f"{i:05d}", f"comuna  {i:02d}", "{}") for i in range(12)], "CUT_REG int, CUT_COM string, COMUNA string, geometry string")
    places = geography.region_places(shapes, region_code="13", expected_count=12)
    profile = profiles.build_municipality_income_profile(income)
    joined = geography.build_municipality_income_map_data(profile, places)
    assert joined.count() == 12
    (low, high), ticks = frames.shared_log_scale(joined)
    assert math.isclose(ticks[0], 10 ** low) and math.isclose(ticks[-1], 10 ** high)
    with pytest.raises(ContractError, match="one side only"):
        geography.join_municipality_geography(profile, places.filter("CUT_COM <> '00003'"))
    with pytest.raises(ContractError):
        geography.region_places(shapes, region_code=5)


def test_equal_rows_merge_in_a_handful_of_rounds(spark):
    rows = spark.range(5000).select("id", F.array((F.col("id") % 3).cast("double"), F.lit(1.0)).alias("vec"))
    tree = clusters.ward_tree(rows, finish=2)
    assert tree.merges.count() == 4999
    sizes = sorted(r["n"] for r in clusters.cut_tree(tree, [3]).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect())
    assert sizes == [1666, 1667, 1667]


def by_hand(tree):
    """Rows in the order of the tree: every cluster behind what absorbed it, merge by merge."""
    line = {r.id: [r.id] for r in tree.leaves.collect()}
    merges = sorted(tree.merges.collect(), key=lambda m: (m.step, m.lo, m.hi))
    for m in merges:
        line[m.lo] += line.pop(m.hi)
    return line


@pytest.mark.parametrize("copies,micro", [(1, None), (3, None), (2, 12)])
def test_order_along_the_tree_does_not_depend_on_where_it_was_merged(spark, copies, micro):
    rng = np.random.default_rng(4)
    data = np.repeat(rng.normal(size=(24, 3)), copies, axis=0)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id bigint, vec array<double>")
    orders = []
    for finish in (2, 1000):
        tree = clusters.ward_tree(rows, finish=finish, block_rows=16, micro=micro)
        places = {r.id: r.posicion for r in clusters.leaf_positions(tree).collect()}
        orders.append(sorted(places, key=places.get))
        assert sorted(places.values()) == list(range(len(data)))
        assert [orders[-1]] == list(by_hand(tree).values())
    assert orders[0] == orders[1]
