import pytest
from pyspark.sql import functions as F

from firmlens import PanelConfig
from firmlens.functions import features as fx
from firmlens.functions.formats import mean_median_text, number_text, round_half_even, round_significant

CFG = PanelConfig()
EUR = 117.5


def evaluate(spark, column, schema, *rows):
    return [r[0] for r in spark.createDataFrame(list(rows), schema).select(column).collect()]


@pytest.mark.parametrize(
    "employees, revenue, assets, size",
    [
        (10.0, 700 * EUR, 1e9, 1),
        (11.0, 700 * EUR + 1, 1e9, 2),
        (50.0, 8000 * EUR, 0.0, 2),
        (51.0, 8000 * EUR + 1, 0.0, 3),
        (250.0, 40000 * EUR, 0.0, 3),
        (251.0, 40000 * EUR + 1, 0.0, 4),
        (300.0, 0.0, 350 * EUR, 1),
        (300.0, 0.0, 350 * EUR + 1, 3),
        (20.0, 0.0, 4000 * EUR, 2),
        (300.0, 1.0, 20000 * EUR, 3),
        (300.0, 1.0, 20000 * EUR + 1, 4),
        (5.0, 1000 * EUR, 5000 * EUR, 3),
        (None, 1.0, 1.0, 3),
        (1.0, None, 1.0, 3),
        (1.0, 1.0, None, 3),
    ],
)
def test_size_class(spark, employees, revenue, assets, size):
    column = fx.size_class("e", "r", "a", CFG)
    assert evaluate(spark, column, "e double, r double, a double", (employees, revenue, assets)) == [size]


def test_liquidation_is_case_sensitive_and_null_safe(spark):
    names = ["X U STEČAJU", "X U LIKVIDACIJI", "x u stečaju", "X", None]
    got = evaluate(spark, fx.liquidation_flag("n", CFG), "n string", *[(n,) for n in names])
    assert got == [True, True, False, False, False]


def test_defaults_and_flags(spark):
    assert evaluate(spark, fx.foreign_flag("x"), "x double", (51.0,), (0.0,), (None,)) == [True, False, False]
    assert evaluate(spark, fx.ownership_code("x", CFG), "x double", (5.0,), (None,)) == [5, 2]
    assert evaluate(spark, fx.net_of("a", "b"), "a double, b double", (3.0, None), (None, 2.0), (None, None)) == [3.0, -2.0, 0.0]


def test_periods_and_labels(spark):
    years = [(y,) for y in (2017, 2018, 2019, 2020, 2021, 2022, 2023, 2024, None)]
    assert evaluate(spark, fx.period_code("y", CFG), "y int", *years) == [None, 1, 1, 2, 2, 3, 3, None, None]
    labels = fx.label_of("c", ((3, "Medium"), (4, "Large")))
    assert evaluate(spark, labels, "c int", (3,), (4,), (9,), (None,)) == ["Medium", "Large", None, None]
    assert evaluate(spark, fx.size_name("c"), "c int", (1,), (4,)) == ["Micro", "Large"]


def test_window_is_strict(spark):
    years = [(y,) for y in (2017, 2018, 2023, 2024, None)]
    assert evaluate(spark, fx.in_window("y", CFG), "y int", *years) == [False, True, True, False, None]


def test_rounding_ties(spark):
    values = [(2.675,), (2.665,), (-2.665,), (123.445,), (None,)]
    assert evaluate(spark, round_half_even("x", 2), "x double", *values) == [2.68, 2.66, -2.66, 123.44, None]
    values = [(1234565.0,), (0.0,), (-0.00012345649,)]
    assert evaluate(spark, round_significant("x", 6), "x double", *values) == [1234560.0, 0.0, -0.000123456]


def test_number_text(spark):
    values = [(1468.0,), (0.0,), (12345678.0,), (4.25,), (18413.04,), (-10.0,)]
    assert evaluate(spark, number_text("x"), "x double", *values) == ["1468", "0", "12345678", "4.2", "18413", "-10"]


def test_cell_text(spark):
    cells = [(4.2, 0.0, 2320), (18413.0, 5223.3, 464), (None, None, 5)]
    got = evaluate(spark, mean_median_text("m", "d", "n"), "m double, d double, n bigint", *cells)
    assert got == ["4.2 (0) n=2320", "18413 (5223.3) n=464", "NaN (NA) n=5"]


def test_units_and_stars(spark):
    got = evaluate(spark, fx.unit_caption("d"), "d string", ("Assets_mil",), ("NetMargin_pct",), ("logTotalRevenue",))
    assert got == ["RSD millions", "percentage points", None]
    p = [(0.0005,), (0.001,), (0.0011,), (0.03,), (0.07,), (0.5,), (None,)]
    assert evaluate(spark, fx.significance_stars("p"), "p double", *p) == ["***", "***", "**", "*", ".", "", None]
