import numpy as np
import pytest

from firmlens.operators.medians import exact_medians


def median_of(spark, values, partitions=3):
    df = spark.createDataFrame([("g", v) for v in values], "g string, x double").repartition(partitions)
    return exact_medians(df, ["g"], ["x"]).first().x


@pytest.mark.parametrize(
    "values",
    [
        [1.0, 2.0, 3.0, 10.0],
        [5.0],
        [2.0, None, 4.0],
        [0.0, 0.0, -0.0, 7.0],
        [-3.0, -1.0, 0.0, 2.0, 1e12],
        [-1e300, -1e-300, 1e-300, 1e300],
        [7.0] * 9 + [8.0] * 9,
        [float("-inf"), 1.0, float("inf")],
        [1.0, 1.0 + 2**-52, 1.0 + 2**-51, 1.0 + 2**-50],
        [4.9e-324, 0.0, 4.9e-324],
    ],
)
def test_small_sets(spark, values):
    assert median_of(spark, values) == np.median([v for v in values if v is not None])


@pytest.mark.parametrize("seed, n", [(1, 1001), (2, 1000), (3, 2500)])
def test_random_values(spark, seed, n):
    rng = np.random.default_rng(seed)
    values = rng.lognormal(8, 3, n) * rng.choice([-1, 1, 1], n)
    values[: n // 3] = values[0]  # a third of the rows share one value
    assert median_of(spark, [float(v) for v in values]) == np.median(values)


def test_dense_values_inside_one_linear_cell(spark):
    rng = np.random.default_rng(4)
    values = 1000 + rng.random(5000) * 1e-9
    values[:5] = [1.0, 2.0, 1e9, 1001.0, 1010.0]
    assert median_of(spark, [float(v) for v in values]) == np.median(values)


def test_groups_measures_and_null_keys(spark):
    rng = np.random.default_rng(5)
    rows = [
        (int(rng.integers(2018, 2020)), [None, "A", "B"][rng.integers(3)], float(rng.normal()), float(rng.integers(9)))
        for _ in range(600)
    ]
    df = spark.createDataFrame(rows, "y int, s string, a double, b double")
    got = {(r.y, r.s): (r.a, r.b) for r in exact_medians(df, ["y", "s"], ["a", "b"]).collect()}
    want = {}
    for key in {(r[0], r[1]) for r in rows}:
        group = np.array([r[2:] for r in rows if (r[0], r[1]) == key])
        want[key] = tuple(np.median(group, axis=0))
    assert got == want
