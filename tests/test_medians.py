import random
import statistics

import pytest

from arqueo.operators.medians import exact_median


@pytest.mark.parametrize("bound", [10_000, 50])
def test_medians_of_hot_and_odd_groups(spark, bound):
    draw = random.Random(2)
    groups = {
        "hot": [draw.gauss(0, 1) * 10 ** draw.randint(-9, 15) for _ in range(3000)],
        "even": [draw.random() for _ in range(400)], "odd": [draw.random() for _ in range(401)],
        "same": [7.0] * 500, "two": [1.0] * 300 + [2.0] * 300, "few": [3.0, 1.0], "one": [5.0], None: [draw.random() for _ in range(120)],
        "mostly": [0.0] * 400 + [draw.random() for _ in range(90)],
    }
    rows = [(k, v, "x") for k, vs in groups.items() for v in vs] + [("none", None, "x"), ("few", None, "x")]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "`the key` string, v double, _k0 string").repartition(7)
    got = {r["the key"]: r["m"] for r in exact_median(df, ["the key"], "v", "m", bound).collect()}
    assert got == {**{k: statistics.median(vs) for k, vs in groups.items()}, "none": None}


def test_empty(spark):
    assert exact_median(spark.createDataFrame([], "k int, v double"), ["k"], "v", "m").count() == 0
