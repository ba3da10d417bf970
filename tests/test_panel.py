import dataclasses

from firmlens import PanelConfig, PanelStudy
from firmlens.config import STAND_IN
from firmlens.operators.describe import duplicate_keys
from helpers import statements

CFG = dataclasses.replace(PanelConfig(), excluded_id=13)


def study(spark, *rows, cfg=CFG):
    return PanelStudy(statements(spark, *rows), cfg)


def test_null_and_excluded_ids(spark):
    s = study(spark, {"mb": None}, {"mb": 13}, {"mb": 1})
    assert [r.id for r in s.firm_attributes().collect()] == [1]
    assert sorted(r.id or 0 for r in s.panel_metrics().collect()) == [0, 1, 13]
    assert [r.id for r in s.panel_merged().collect()] == [1]
    assert s.quality_report().first() == (1, 1)


def test_attributes_are_maxima_over_years(spark):
    s = study(
        spark,
        {"year": 2018, "AOP9002": None, "AOP9003": None},
        {"year": 2019, "AOP9002": 4.0, "AOP9003": 10.0, "AOP59": None},
        {"year": 2030, "AOP9002": 5.0, "name": "Firm U STEČAJU"},
    )
    row = s.firm_attributes().first()
    assert (row.size, row.foreign, row.ownership, row.liquidation) == (4, 1, 4, False)


def test_modal_name_ties_and_nulls(spark):
    s = study(
        spark,
        *[{"mb": 1, "year": 2018 + i, "name": n} for i, n in enumerate(["b", "a", None])],
        *[{"mb": 2, "year": 2018 + i, "name": n} for i, n in enumerate(["z", "z", "a"])],
        *[{"mb": 3, "year": 2018 + i, "name": None} for i in range(2)],
    )
    rows = {r.id: r for r in s.firm_attributes().collect()}
    assert (rows[1].name, rows[2].name, rows[3].name) == ("a", "z", None)
    assert rows[3].liquidation is False


def test_liquidation_in_one_year_removes_the_firm(spark):
    s = study(spark, {"name": "Firm U LIKVIDACIJI"}, {"year": 2019}, {"mb": 2})
    assert [r.id for r in s.panel_merged().collect()] == [2]
    assert s.liquidation_size_distribution().first()[:3] == (4, "Large", 1)


def test_margin_rules(spark):
    s = study(
        spark,
        {"mb": 1, "AOP1001": 0.0},
        {"mb": 2, "AOP1001": None},
        {"mb": 3, "AOP1001": 100.0, "AOP1025": 100.0, "AOP1055": 1.0, "year": 2018},
        {"mb": 4, "AOP1001": 9e6, "AOP1025": None, "AOP1026": 9e6},
        {"mb": 5, "AOP1001": 9e6, "AOP1055": None, "AOP1064": 8.9e6},
    )
    assert [r.id for r in s.panel_merged().collect()] == [5]
    metrics = {r.id: r for r in s.panel_metrics().collect()}
    assert metrics[1].operating_margin is None and metrics[1].log_operating_revenue is None
    assert metrics[3].operating_margin == 1.0 and metrics[4].net_margin == 500000 / 9e6


def test_socialistic_and_small_firms_are_left_out(spark):
    small = {"AOP9005": 20.0, "AOP1001": 2e5, "AOP59": 1e5, "AOP1025": 1.0, "AOP1055": 1.0}
    s = study(spark, {"mb": 1, "AOP9002": 1.0}, {"mb": 2, **small}, {"mb": 3, "AOP9002": 5.0, "AOP9003": 1.0})
    row = s.panel_merged().first()
    assert (row.id, row.size, row.foreign, row.ownership, row.covid_period) == (3, "Large", "1", "Government", "Pre")
    assert s.panel_merged().count() == 1
    assert {r.size: r.n for r in s.size_distribution().collect()} == {2: 1, 4: 2}


def test_duplicate_keys_are_reported(spark):
    s = study(spark, {}, {}, {"year": 2019})
    assert s.panel_key_check().first() == (3, 2, 1)
    assert duplicate_keys(s.panel_merged()).collect() == [(1, 2018, 2)]


def test_missing_cell_is_na(spark):
    medium = {"AOP9005": 100.0, "AOP1001": 2e6, "AOP59": 1e6}
    s = study(spark, {"mb": 1, **medium}, {"mb": 2, "year": 2019}, {"mb": 3, "year": 2018, **medium, "AOP59": None})
    rows = {r.year: r for r in s.assets_wide().collect()}
    assert rows[2018].Large == "N/A" and rows[2018].Medium == "1000 (1000) n=2"
    assert rows[2019].Medium == "N/A" and rows[2019].Large == "8000 (8000) n=1"


def test_samples_of_logs_need_logs_above_zero(spark):
    s = study(spark, {"AOP1043": 1.0}, {"year": 2019, "AOP1043": 0.0}, {"year": 2020, "AOP1043": None})
    depvars = [r.depvar for r in s.regression_sample().collect() if r.year == 2018]
    assert "TotalRevenue_mil" in depvars and "logTotalRevenue" not in depvars
    later = {r.depvar for r in s.regression_sample().collect() if r.year > 2018}
    assert not later & {"TotalRevenue_mil", "logTotalRevenue"} and "Assets_mil" in later


def test_invariants_on_the_stand_in_panel(stand_in):
    s = PanelStudy(stand_in, STAND_IN)
    quality = s.quality_report().first()
    for report in (s.firm_size_distribution(), s.ownership_distribution(), s.foreign_distribution()):
        assert sum(r.n for r in report.collect()) == quality.firms
    balance = s.panel_balance().collect()
    assert sum(r.n for r in balance) == quality.firms
    assert sum(r.n_years * r.n for r in balance) == quality.observations
    assert sum(r.observations for r in s.assets_long().collect()) == quality.observations
    sizes = s.size_stats().collect()
    assert sum(r.n_obs for r in sizes) == quality.observations
    assert [r.size for r in sizes] == ["Medium", "Large"]
    counts = [r.n for r in s.ownership_distribution().collect()]
    assert counts == sorted(counts, reverse=True)
    assert (quality.observations, quality.firms) == (600, 136)
