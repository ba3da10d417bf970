import numpy as np
import pytest

from firmlens.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int"
CFG = whitening.WhitenConfig(components=4, guard=3)


@pytest.fixture(scope="module")
def make(spark):
    def make(rows):
        return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).repartition(3)

    return make


def plain(rows, components):
    """Eigenvectors of the covariance formed as a whole."""
    c = np.array([np.array(v, np.float32).astype(float) for _, v in rows])
    x = np.floor(64 * c).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    deviation = ((n * x.astype(object) - s.astype(object)) ** 2).sum(axis=1)
    centred = (n * x - s) / n
    e, q = np.linalg.eigh(centred.T @ centred / n)
    e, q = e[::-1][:components], q[:, ::-1][:, :components]
    trace = (centred**2).sum() / n
    white = centred @ q / np.sqrt(e)
    return {i: (int(deviation[k]), white[k]) for k, (i, _) in enumerate(rows)}, e / trace


def planted(n=400, d=20, seed=1):
    rng = np.random.default_rng(seed)
    scale = 1.25 ** -np.arange(d) * 3
    return [(i, (rng.normal(size=d) * scale + 5).tolist()) for i in range(n)]


def check(got, rows, components):
    want, explained = plain(rows, components)
    by = {(r.vec_id, r.component): r for r in got}
    assert len(by) == len(got) == len(rows) * components
    for k in range(1, components + 1):
        a = np.array([by[i, k].whitened for i, _ in rows])
        b = np.array([want[i][1][k - 1] for i, _ in rows])
        assert min(np.abs(a - b).max(), np.abs(a + b).max()) < 1e-7
        assert all(by[i, k].deviation == want[i][0] for i, _ in rows)
        assert by[rows[0][0], k].explained == pytest.approx(explained[k - 1], rel=1e-9)
    assert {r.n for r in got} == {len(rows)}
    assert {r.identity_error for r in got}.pop() < 1e-9
    assert {r.residual for r in got}.pop() < 1e-10


def test_equals_the_whole_covariance_with_a_filtered_block(make):
    rows = planted()
    check(whitening.whiten(make(rows), CFG).collect(), rows, 4)


def test_a_block_as_wide_as_the_space(make):
    rows = planted(d=6)
    cfg = whitening.WhitenConfig()
    check(whitening.whiten(make(rows), cfg).collect(), rows, 6)


def test_filter_separates_close_eigenvalues():
    rng = np.random.default_rng(4)
    q = np.linalg.qr(rng.normal(size=(200, 200)))[0]
    e = np.linspace(2.0, 1.0, 200)
    v = (q * e) @ q.T
    values, vectors, off = whitening.eigenvectors(lambda x: v @ x, 200, whitening.WhitenConfig())
    assert np.allclose(values, e[:32], rtol=1e-12) and off <= 1e-10
    assert np.abs(np.abs((q[:, :32] * vectors).sum(axis=0)) - 1).max() < 1e-12


def test_filter_with_a_steep_spectrum_and_lost_rank():
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(90, 90)))[0]
    e = np.where(np.arange(90) < 40, 10.0 ** (-np.arange(90) / 6), 0)
    v = (q * e) @ q.T
    values, vectors, off = whitening.eigenvectors(lambda x: v @ x, 90, whitening.WhitenConfig())
    assert np.allclose(values, e[:32], rtol=1e-6) and off <= 1e-10


def test_a_flat_spectrum_is_certified_at_once():
    values, _, off = whitening.eigenvectors(lambda x: 3.0 * x, 100, whitening.WhitenConfig())
    assert np.allclose(values, 3) and off < 1e-13


def test_odd_rows_take_no_part(make):
    rows = planted(n=50, d=5)
    odd = [(900, None), (901, [None] * 5), (902, [float("nan")] * 5), (903, [float("inf")] + [0.0] * 4),
           (904, []), (905, [1.0]), (906, [1e30] * 5)]
    got = whitening.whiten(make(rows + odd), CFG).collect()
    check(got, rows, 4)


def test_zero_vectors_repeats_null_ids_and_extra_columns_take_part(make):
    rows = planted(n=30, d=4) + [(500, [0.0] * 4)]
    table = make([*rows, (None, [1.0, 2.0, 3.0, 4.0]), rows[0]])
    table = table.selectExpr("*", "1 AS x", "2 AS n", "3 AS component", "'a' AS whitened")
    got = whitening.whiten(table, CFG).collect()
    assert {r.n for r in got} == {33} and len(got) == 33 * 4
    assert sum(r.vec_id is None for r in got) == 4 and sum(r.vec_id == 0 for r in got) == 8
    assert got[0].identity_error < 1e-9


def test_no_variance_gives_no_rows(make):
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, [])]):
        assert whitening.whiten(make(rows), CFG).collect() == []


def test_a_constant_dimension_has_no_component(make):
    rng = np.random.default_rng(8)
    rows = [(i, [*rng.normal(size=3).tolist(), 7.0]) for i in range(40)]
    got = whitening.whiten(make(rows), CFG).collect()
    assert {r.component for r in got} == {1, 2, 3} and got[0].identity_error < 1e-9


def test_deviations_beyond_a_long_are_null():
    fit = object.__new__(whitening.FitList)
    fit.n, fit.d, fit.rest = 10**9, 2, [3, 5]
    fit.whole, fit.part = np.array([7, 7]), np.array([3e-9, 5e-9])
    x = np.array([[8, 7], [10_000, -10_000]])
    assert fit.deviations(x) == [(10**9 - 3) ** 2 + 25, None]
