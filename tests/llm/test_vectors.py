import math

import numpy as np
import pytest

from firmlens.llm import ann, embed_dedup, oracle

SCHEMA = "vec_id long, embedding array<float>, label int"


@pytest.fixture(scope="module")
def make(spark):
    def make(rows):
        return spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA)

    return make


def clean(rows):
    return [
        (i, np.array(v, np.float32).astype(float))
        for i, v in rows
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)
    ]


def plain_links(rows, cosine):
    """Links of all pairs, and components by repeated relabelling."""
    ok = clean(rows)
    n = len(ok)
    link = np.zeros((n, n), bool)
    for a in range(n):
        for b in range(n):
            x, y = ok[a][1], ok[b][1]
            if a != b and len(x) == len(y):
                link[a, b] = x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= cosine
    low = np.array([i for i, _ in ok])
    for _ in range(n):
        low = np.array([min([low[a], *low[link[a]]]) for a in range(n)])
    out = [(ok[a][0], int(link[a].sum()), int(low[a]), bool(low[a] == ok[a][0])) for a in range(n)]
    ids = {id(v) for v in ok}
    usable = {i for i, _ in ok}
    return sorted(out + [(i, 0, i, True) for i, v in rows if i is not None and i not in usable]), ids


def planted(seed=0, n=500, dim=12, groups=6):
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(groups, dim))
    rows = []
    for i in range(n):
        if i % 3 == 0:
            v = centers[i % groups] * rng.uniform(0.5, 2) + rng.normal(size=dim) * 0.25
        elif i % 7 == 1:
            v = centers[0]
        else:
            v = rng.normal(size=dim)
        rows.append((i, v.astype(np.float32).tolist()))
    return rows


ODD = [
    (900, None), (901, []), (902, [0.0] * 12), (903, [float("nan")] + [1.0] * 11),
    (904, [None] + [1.0] * 11), (905, [float("inf")] + [1.0] * 11), (906, [1.0, 2.0]), (907, [2.0, 4.0]),
]


def test_equals_all_pairs_over_many_cells_and_blocks(make):
    rows = planted() + ODD
    cfg = embed_dedup.EmbedConfig(cell_rows=60, block=32, sample_rows=300)
    got = sorted(map(tuple, embed_dedup.near_duplicates(make(rows), cfg).collect()))
    want, _ = plain_links(rows, 0.95)
    assert got == want
    assert any(n > 50 for _, n, _, _ in got) and any(n == 0 for _, n, _, _ in got)


def test_a_lower_threshold_and_one_cell(make):
    rows = planted(seed=3, n=200)
    cfg = embed_dedup.EmbedConfig(cosine=0.7)
    got = sorted(map(tuple, embed_dedup.near_duplicates(make(rows), cfg).collect()))
    assert got == plain_links(rows, 0.7)[0]


def test_repeated_rows_link_to_each_other_and_null_ids_do_not(make):
    rows = [(5, [1.0, 0.0]), (5, [1.0, 0.0]), (7, [0.0, 1.0]), (None, [1.0, 0.0])]
    vectors = make(rows).selectExpr("*", "1 AS rep", "2 AS cell", "3 AS v", "4 AS weight")
    got = [tuple(r) for r in embed_dedup.near_duplicates(vectors).collect()]
    assert sorted(got, key=str) == sorted(
        [(5, 1, 5, True), (5, 1, 5, True), (7, 0, 7, True), (None, 0, None, False)], key=str
    )


def test_links_equal_sql(make, sql):
    vectors = make(planted(n=200) + ODD + [(None, [1.0, 2.0]), (3, [2.0, 1.0]), (3, [2.0, 1.0])])
    got = embed_dedup.near_duplicates(vectors, embed_dedup.EmbedConfig(cell_rows=60)).collect()
    want = sql(oracle.EMBED_DEDUP, embeddings=vectors)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_one_id_with_different_vectors(make):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (0, [0.01, 1.0]), (0, [-1.0, 0.0])]
    got = sorted(map(tuple, embed_dedup.near_duplicates(make(rows)).collect()))
    assert got == plain_links(rows, 0.95)[0]
    many = [(i % 40, v) for i, v in planted(seed=6, n=300)]
    cfg = embed_dedup.EmbedConfig(cell_rows=60, block=32)
    got = sorted(map(tuple, embed_dedup.near_duplicates(make(many), cfg).collect()))
    assert got == plain_links(many, 0.95)[0]


def test_empty_table(make):
    assert embed_dedup.near_duplicates(make([])).count() == 0
    assert ann.search(make([]), _every(20)).count() == 0
    assert embed_dedup.near_duplicates(make([(1, None)])).collect()[0].kept


def _every(n):
    from pyspark.sql import functions as F

    return F.col("vec_id") % n == 0


def plain_search(rows, n, k):
    ok, out = clean(rows), []
    for at, (i, q) in enumerate(ok):
        if i % n == 0:
            scores = sorted(
                (-float((q * v).sum()), j) for b, (j, v) in enumerate(ok) if b != at and len(v) == len(q)
            )
            out += [(i, rank, j, -s) for rank, (s, j) in enumerate(scores[:k], 1)]
    return sorted(out)


def same(got, want):
    assert [(a[0], a[1], a[2]) for a in got] == [(a[0], a[1], a[2]) for a in want]
    assert [a[3] for a in got] == pytest.approx([a[3] for a in want], rel=1e-12)


@pytest.mark.parametrize("cfg", [ann.SearchConfig(), ann.SearchConfig(5, 7, 50, 4)])
def test_search_equals_all_pairs(make, cfg):
    rows = planted(seed=1) + ODD
    got = sorted(map(tuple, ann.search(make(rows), _every(9), cfg).collect()))
    same(got, plain_search(rows, 9, cfg.k))


def test_search_with_repeated_rows_ties_and_clashing_columns(make):
    rows = [(0, [1.0, 1.0]), (0, [1.0, 1.0]), (0, [2.0, 0.0]), (3, [1.0, 1.0]), (2, [1.0, 1.0]), (4, [-1.0, 0.0])]
    vectors = make(rows).selectExpr("*", "1 AS code", "2 AS dim", "3 AS v", "4 AS times")
    got = sorted(map(tuple, ann.search(vectors, _every(10), ann.SearchConfig(k=3)).collect()))
    same(got, plain_search(rows, 10, 3))


def test_lists_of_many_blocks_are_merged_in_levels(make):
    rows = planted(seed=2, n=900)
    cfg = ann.SearchConfig(k=5, query_block=64, candidate_block=5, merge_queries=16, merge_blocks=6)
    got = sorted(map(tuple, ann.search(make(rows), _every(50), cfg).collect()))
    same(got, plain_search(rows, 50, 5))
    plan = ann.search(make(rows), _every(50), cfg)._jdf.queryExecution().analyzed().toString()
    assert plan.count("_combined") or plan.count("FlatMapGroupsInArrow") == 3  # 180, 30 and 5 blocks


def test_error_bounds_hold():
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(50, 9)) * rng.uniform(0.01, 100, (50, 1)), rng.normal(size=(60, 9))
    (qx, sx, nx, ex), (qy, sy, _, ey) = ann.quantised(x), ann.quantised(y)
    near = (qx @ qy.T) * sx[:, None] * sy
    assert (np.abs(near - x @ y.T) <= ex[:, None] * np.linalg.norm(y, axis=1) + nx[:, None] * ey + 1e-9).all()


def test_components_of_long_chains_and_stars(spark):
    from firmlens.llm.common import components

    chain = [(i, i + 1) for i in range(100, 160)]
    star = [(1, i) for i in range(2, 40)]
    edges = spark.createDataFrame([*chain, *star, *star, (7, 7)], "src long, dst long")
    got = dict(map(tuple, components(edges).collect()))
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 1 for i in range(1, 40)}}
    assert components(edges.where("false")).count() == 0
