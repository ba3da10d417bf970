import dataclasses

import numpy as np
import pytest

from firmlens import PanelConfig, PanelStudy
from firmlens.config import DEPENDENT_VARIABLES, STAND_IN
from firmlens.functions.student_t import two_sided_p
from firmlens.operators.regression import adjusted_r2, estimable, f_statistic, model_terms
from helpers import statements

# Observations, firms and R2 of the stand-in panel at sf0.001, computed independently.
EXPECTED = {
    "logOperatingRevenue": (600, 136, 0.036094),
    "OperatingRevenue_mil": (600, 136, 0.027578),
    "logTotalRevenue": (431, 135, 0.043211),
    "TotalRevenue_mil": (488, 135, 0.043481),
    "Assets_mil": (418, 134, 0.048790),
    "OperatingMargin_pct": (600, 136, 0.023749),
    "NetMargin_pct": (600, 136, 0.020404),
}

# Printed model summary of the published study: observations, firms, R2, adjusted R2, F.
PUBLISHED = [
    (16145, 3020, 0.0669, -0.1488, 78.32),
    (16145, 3020, 0.0855, -0.1258, 102.22),
    (9077, 2835, 0.4867, 0.2522, 492.30),
    (9098, 2836, 0.2075, -0.1534, 136.40),
    (9317, 2838, 0.0827, -0.3214, 48.58),
    (16145, 3020, 0.0664, -0.1494, 77.69),
    (16145, 3020, 0.1121, -0.0931, 137.99),
]


@pytest.fixture(scope="module")
def study(stand_in):
    return PanelStudy(stand_in, STAND_IN)


@pytest.fixture(scope="module")
def samples(study):
    """Sample rows by model, with the design columns."""
    design = {(r.id, r.year): list(r[2:]) for r in study.design_matrix().collect()}
    result = {d: [] for d in DEPENDENT_VARIABLES}
    for r in study.regression_sample().collect():
        result[r.depvar].append((r.id, r.y, design[(r.id, r.year)]))
    return result


def dummy_variable_fit(sample):
    """Least squares with one dummy per firm, and the clustered covariance."""
    ids = np.array([s[0] for s in sample])
    y, x = np.array([s[1] for s in sample]), np.array([s[2] for s in sample])
    firms = (ids[:, None] == np.unique(ids)[None, :]).astype(float)
    full = np.hstack([x, firms])
    solution, *_ = np.linalg.lstsq(full, y, rcond=None)
    k = x.shape[1]
    residuals = y - full @ solution
    project = firms @ np.linalg.lstsq(firms, x, rcond=None)[0]
    demeaned = x - project
    bread = np.linalg.inv(demeaned.T @ demeaned)
    scores = np.array([demeaned[ids == i].T @ residuals[ids == i] for i in np.unique(ids)])
    factor = len(y) / (len(y) - k)
    cov = factor * bread @ scores.T @ scores @ bread
    within_y = y - firms @ np.linalg.lstsq(firms, y, rcond=None)[0]
    return solution[:k], cov, 1 - residuals @ residuals / (within_y @ within_y)


@pytest.mark.parametrize("depvar", DEPENDENT_VARIABLES)
def test_against_dummy_variable_regression(study, samples, depvar):
    fit = next(f for f in study.fits if f.depvar == depvar)
    beta, cov, r2 = dummy_variable_fit(samples[depvar])
    assert np.allclose(fit.beta, beta, rtol=1e-8, atol=1e-9 * np.abs(beta).max())
    assert np.allclose(fit.cov, cov, rtol=1e-7, atol=1e-10 * np.abs(cov).max())
    assert fit.r2 == pytest.approx(r2, abs=1e-9)
    assert (fit.obs, fit.firms, round(fit.r2, 6)) == EXPECTED[depvar]
    assert fit.k == 12 and fit.adj_r2 <= fit.r2


def test_scores_and_demeaned_rows(study):
    scores = np.array([list(r[2:]) for r in study.firm_scores().collect() if r.depvar == "NetMargin_pct"])
    assert np.abs(scores.sum(axis=0)).max() < 1e-8 * np.abs(scores).max()
    rows = [r for r in study.within_transform().collect() if r.depvar == "NetMargin_pct"]
    values = np.array([list(r[3:]) for r in rows])
    ids = np.array([r.id for r in rows])
    for i in np.unique(ids):
        assert np.abs(values[ids == i].sum(axis=0)).max() < 1e-9
    fit = study.fits[-1]
    assert np.allclose(values[:, 1:].T @ values[:, 1:], fit.gram)
    residuals = values[:, 0] - values[:, 1:] @ fit.beta
    assert np.abs(values[:, 1:].T @ residuals).max() < 1e-8


def test_published_summary_formulas():
    for obs, firms, r2, adj, f in PUBLISHED:
        df = obs - firms - 12
        low, high = r2 - 5e-5, r2 + 5e-5
        assert adjusted_r2(low, obs, df) - 1e-4 <= adj <= adjusted_r2(high, obs, df) + 1e-4
        assert f_statistic(low, 12, df) - 0.05 <= f <= f_statistic(high, 12, df) + 0.05


@pytest.mark.parametrize(
    "t, df, p",
    [
        (0.835203 / 0.248618, 6230, 0.0007858),
        (2.0, 5, 0.101939),
        (1.0, 1, 0.5),
        (0.0, 10, 1.0),
        (12.706205, 1, 0.05),
        (1.959964, 1e9, 0.05),
        (-0.8979, 13113, 0.36924),
    ],
)
def test_student_t(t, df, p):
    assert two_sided_p(t, df) == pytest.approx(p, rel=2e-4)


def test_collinear_terms_are_dropped_in_order():
    x = np.array([[1.0, 0.0, 1.0, 0.0], [0.0, 1.0, 1.0, 0.0], [1.0, 1.0, 2.0, 0.0], [2.0, 1.0, 3.0, 0.0]])
    kept, status = estimable(x.T @ x)
    assert list(kept) == [True, True, False, False]
    assert status == ["kept", "kept", "collinear", "no within variation"]


def test_rank_deficient_sample_without_baseline_period(spark):
    """Without baseline rows the two periods mirror each other: half of the terms go."""
    rng = np.random.default_rng(3)
    rows = []
    for firm in range(1, 61):
        for year in range(2018, 2024):
            rows.append(
                {
                    "mb": firm,
                    "year": year,
                    "AOP1001": float(rng.integers(5_000_000, 9_000_000)),
                    "AOP9005": 300.0 if firm // 4 % 2 else 100.0,
                    "AOP59": float(rng.integers(3_000_000, 8_000_000)) if firm // 4 % 2 else 1.0e6,
                    "AOP9003": 51.0 if firm % 3 == 0 else 0.0,
                    "AOP9002": float(2 + firm % 4),
                    "AOP1043": None if year < 2020 else float(rng.integers(5_000_000, 9_000_000)),
                }
            )
    rows += [{"mb": firm, "AOP1001": 3e6, "AOP9005": 100.0, "AOP59": 1e6} for firm in (101, 102)]
    study = PanelStudy(statements(spark, *rows), PanelConfig())
    fits = {f.depvar: f for f in study.fits}
    assert fits["OperatingRevenue_mil"].k == 12
    short = fits["TotalRevenue_mil"]
    assert short.k == 6
    names = [t.name for t in model_terms(study.cfg)]
    dropped = [r.term for r in study.aliased_terms().collect() if r.depvar == "TotalRevenue_mil" and r.status == "collinear"]
    assert dropped == [n for n in names if n.startswith("Covid_periodPost")]
    assert study.fe_coefficients().where("depvar = 'TotalRevenue_mil'").count() == 6
    summary = {r.depvar: r for r in study.fe_summary().collect()}
    assert summary["TotalRevenue_mil"].obs == 60 * 4 + 2
    # The two firms with one row count as observations and firms, nothing else.
    assert summary["OperatingRevenue_mil"].firms == 62
    scores = {r.id: list(r[2:]) for r in study.firm_scores().collect() if r.depvar == "OperatingRevenue_mil"}
    assert scores[101] == [0.0] * 12


def test_hc1_factor(stand_in, study):
    other = PanelStudy(stand_in, dataclasses.replace(STAND_IN, hc1_k="slopes+firms"))
    a, b = study.fits[0], other.fits[0]
    ratio = (a.obs - a.k) / (a.obs - a.k - a.firms)
    assert np.allclose(b.cov, a.cov * ratio)
    with pytest.raises(ValueError):
        PanelConfig(hc1_k="none")


def test_coefficient_tests(study):
    rows = study.fe_coefficients().collect()
    assert len(rows) == 84
    for r in rows:
        assert r.t_value == pytest.approx(r.estimate / r.std_error)
        fit = next(f for f in study.fits if f.depvar == r.depvar)
        assert r.p_value == pytest.approx(two_sided_p(r.t_value, fit.df))
        assert r.stars == ("***" if r.p_value <= 0.001 else "**" if r.p_value <= 0.01 else "*" if r.p_value <= 0.05 else "." if r.p_value <= 0.1 else "")


def test_aliased_terms_cover_the_model_matrix(study):
    rows = [r for r in study.aliased_terms().collect() if r.depvar == "Assets_mil"]
    assert len(rows) == 26
    assert sum(r.status == "kept" for r in rows) == 12
    assert {r.term for r in rows if ":" not in r.term and r.status != "kept"} == {
        "SizeSmall", "SizeMicro", "SizeLarge", "Foreign1", "OwnershipSocialistic",
        "OwnershipCooperative", "OwnershipMixed", "OwnershipGovernment",
    }


def test_clustered_errors_keep_their_digits_on_a_close_fit(spark):
    """1 - R2 near 1e-12: the variances still agree with scores taken row by row."""
    rng = np.random.default_rng(9)
    rows = []
    for firm in range(1, 121):
        large, foreign = firm // 4 % 2, firm % 3 == 0
        for year in range(2018, 2024):
            effect = (0, 0, 3e5, 3e5, 5e5, 5e5)[year - 2018] * (1 + large + 2 * foreign + firm % 4)
            rows.append(
                {
                    "mb": firm,
                    "year": year,
                    "AOP1001": 6e6 + firm * 1e4 + effect + float(rng.normal()) * 0.3,
                    "AOP9005": 300.0 if large else 100.0,
                    "AOP59": 5e6 if large else 1e6,
                    "AOP9003": 51.0 if foreign else 0.0,
                    "AOP9002": float(2 + firm % 4),
                }
            )
    study = PanelStudy(statements(spark, *rows), PanelConfig())
    fit = next(f for f in study.fits if f.depvar == "OperatingRevenue_mil")
    design = {(r.id, r.year): list(r[2:]) for r in study.design_matrix().collect()}
    sample = [(r.id, r.y, design[(r.id, r.year)]) for r in study.regression_sample().collect() if r.depvar == fit.depvar]
    # Row-level residuals from demeaned columns, where no large level is left to cancel.
    ids = np.array([s[0] for s in sample])
    data = np.array([[s[1], *s[2]] for s in sample])
    for i in np.unique(ids):
        data[ids == i] -= data[ids == i].mean(axis=0)
    y, x = data[:, 0], data[:, 1:]
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    residuals = y - x @ beta
    assert 1e-14 < residuals @ residuals / (y @ y) < 1e-10
    scores = np.array([x[ids == i].T @ residuals[ids == i] for i in np.unique(ids)])
    bread = np.linalg.inv(x.T @ x)
    cov = len(y) / (len(y) - fit.k) * bread @ scores.T @ scores @ bread
    rss, tss = residuals @ residuals, y @ y
    assert fit.rss == pytest.approx(rss, rel=1e-6) and fit.tss == pytest.approx(tss, rel=1e-12)
    assert fit.f_stat == pytest.approx((tss - rss) / fit.k / (rss / fit.df), rel=1e-6)
    assert np.allclose(np.diag(fit.cov), np.diag(cov), rtol=1e-4)
    assert (np.diag(fit.cov) > 0).all()
