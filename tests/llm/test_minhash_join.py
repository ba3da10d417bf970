import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from firmlens.llm import minhash_join, oracle
from firmlens.llm.minhash_join import JoinConfig


def shingles(text, size):
    own = (text or "").encode().lower().split()
    if len(own) < size:
        return {tuple(own)} if own else set()
    return {tuple(own[i : i + size]) for i in range(len(own) - size + 1)}


def plain(docs, size, percent=80):
    """Components by comparing all pairs."""
    sets = [(i, shingles(t, size)) for i, t in docs]
    low = list(range(len(sets)))

    def root(x):
        while low[x] != x:
            x = low[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                low[max(p, q)] = min(p, q)
    ids = {}
    for at, (i, _) in enumerate(sets):
        ids.setdefault(root(at), []).append(i)
    smallest = {r: min((i for i in v if i is not None), default=None) for r, v in ids.items()}
    return [(i, len(s), smallest[root(at)]) for at, (i, s) in enumerate(sets)]


def key(row):
    return tuple(-1 if x is None else x for x in row)


def same(df, docs, size):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in df.collect()), key=key)
    assert got == sorted(plain(docs, size), key=key)
    return got


def family(rng, base, n, most):
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randint(0, most)):
            text[rng.randrange(len(text))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(text))
    return out


@pytest.fixture(scope="module")
def planted():
    """Families of copies, some so changed that they link to few or none, and loose texts."""
    rng = random.Random(21)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for n, length, most in ((120, 60, 8), (40, 200, 25), (30, 12, 2), (25, 30, 4)):
        texts += family(rng, rng.choices(vocabulary, k=length), n, most)
    texts += [" ".join(rng.choices(vocabulary, k=rng.randint(1, 80))) for _ in range(150)]
    texts += [texts[0]] * 40 + [texts[5].upper().replace(" ", "\n")]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("size", [2, 5])
def test_equals_all_pairs(make_docs, planted, size):
    cfg = JoinConfig(shingle=size, task_shingles=2000)
    got = same(minhash_join.near_duplicates(make_docs(planted), cfg), planted, size)
    assert 40 < len({c for _, _, c in got}) < len(got) - 60


def test_odd_rows(make_docs):
    docs = [(None, "a b c d e f"), (9, "a b c d e f"), (3, None), (4, ""), (5, " \n\t"), (5, "solo"), (6, "Solo"),
            (7, "one two three"), (7, "four five six"), (8, "FOUR five\tsix"), (8, "four five six"), (None, "alone here")]
    table = make_docs(docs).selectExpr("*", "1 AS n", "2 AS class", "3 AS keys", "4 AS digest", "5 AS component_id")
    df = minhash_join.near_duplicates(table, JoinConfig(shingle=2))
    same(df, docs, 2)
    kept = {(r.doc_id, r.kept) for r in df.collect()}
    assert {(9, True), (None, False), (3, True), (4, True), (6, False)} <= kept


def test_near_copies_under_null_ids(make_docs, planted):
    """Links among rows with a NULL id, of one with a row that has an id, and a chain through one."""
    base = [f"w{i}" for i in range(100)]
    chain = [" ".join([*(f"{c}{i}" for i in range(n)), *base[n:]]) for c, n in (("a", 0), ("b", 8), ("b", 16))]
    docs = [(7, chain[0]), (None, chain[1]), (5, chain[2]), (None, chain[1]), (None, chain[1])]
    docs += [(None if i % 3 == 0 else 100 + i, t) for i, t in planted]
    assert [c for _, _, c in plain(docs[:1] + docs[2:3], 2)] == [7, 5]
    got = same(minhash_join.near_duplicates(make_docs(docs), JoinConfig(shingle=2, task_shingles=2000)), docs, 2)
    assert {(7, 99, 5), (5, 99, 5), (None, 99, 5)} <= set(got)


def test_empty_tables(make_docs):
    assert minhash_join.near_duplicates(make_docs([])).count() == 0
    assert minhash_join.near_duplicates(make_docs([(1, None)])).collect()[0].kept
    assert minhash_join.keep_one(make_docs([])).count() == 0


def test_on_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    same(minhash_join.near_duplicates(docs, JoinConfig(shingle=2)), rows, 2)


def test_stage_keeps_one_row_of_each_group(make_docs, planted):
    docs = [*planted, (0, planted[0][1]), (1000, ""), (1001, None), (1001, None)]
    table = make_docs(docs).withColumn("words", F.lit("extra"))
    kept = minhash_join.keep_one(table)
    assert kept.columns == table.columns
    rows = kept.collect()
    components = {c for _, n, c in plain(planted, 5)}
    assert sorted(r.doc_id for r in rows) == sorted([*components, 1000, 1001, 1001])
    texts = dict(planted)
    assert all(r.text == texts[r.doc_id] for r in rows if r.doc_id < 1000)


def test_stage_keeps_one_row_of_groups_under_null_and_repeated_ids(make_docs):
    def near(letter, n=3):
        base = [f"{letter}{i}" for i in range(100)]
        return [" ".join([*base[:-1], f"end{k}"]) for k in range(n)]

    a, b, c, d = map(near, "abcd")
    docs = [(None, a[0]), (None, a[0]), (None, a[1]), (None, b[0]), (None, b[0])]
    docs += [(4, c[0]), (4, c[1]), (4, c[1]), (4, c[2]), (5, d[0]), (None, d[1]), (None, ""), (None, "")]
    rows = minhash_join.keep_one(make_docs(docs)).collect()
    kept = sorted((-1 if r.doc_id is None else r.doc_id, r.text[:1]) for r in rows)
    assert kept == [(-1, ""), (-1, ""), (-1, "a"), (-1, "b"), (4, "c"), (5, "d")]
    again = minhash_join.keep_one(make_docs(docs[::-1])).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_pigeonhole_any_signatures_within_the_distance_share_a_key():
    cfg, rng = JoinConfig(), np.random.default_rng(0)
    signer = minhash_join.Signer(cfg)
    for _ in range(300):
        a = rng.integers(0, 2**16, cfg.positions).astype(np.uint64)
        b = a.copy()
        b[rng.choice(cfg.positions, cfg.max_distance, replace=False)] ^= np.uint64(1)
        assert set(signer.keys(a).tolist()) & set(signer.keys(b).tolist())


def test_signature_agreement_estimates_similarity():
    cfg = JoinConfig(positions=2000)
    signer = minhash_join.Signer(cfg)
    rng = np.random.default_rng(1)
    pool = rng.integers(0, 2**63, 1200).astype(np.uint64)
    a, b = np.sort(pool[:1000]), np.sort(pool[200:])
    agree = (signer.signature(a) == signer.signature(b)).mean()
    assert abs(agree - 800 / 1200) < 0.05


def test_very_long_text(make_docs):
    rng = random.Random(1)
    base = rng.choices([f"w{i}" for i in range(5000)], k=120_000)
    docs = [(1, " ".join(base)), (2, " ".join(base[:-900])), (3, " ".join(base[:60_000]))]
    got = {r.doc_id: r.component_id for r in minhash_join.near_duplicates(make_docs(docs)).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_equals_sql(make_docs, sql):
    rng = random.Random(12)
    base = [rng.choices("a b c D é ü x1 x2 x3 x4".split(), k=rng.randint(0, 40)) for _ in range(60)]
    docs = [(i, " ".join(w)) for i, w in enumerate(base)]
    docs += [(100 + i, "\t".join(w[:-1] + ["new"]).upper()) for i, w in enumerate(base) if i % 3 == 0]
    docs += [(None, docs[5][1]), (None, None), (300, None), (301, " \n "), (302, "One"), (303, "oNE"), (4, docs[4][1])]
    table = make_docs(docs)
    columns = ("doc_id", "n_shingles", "component_id", "kept")
    got = minhash_join.near_duplicates(table, JoinConfig(shingle=2)).select(*columns).collect()
    want = sql(f"SELECT {','.join(columns)} FROM ({oracle.MINHASH_JOIN})", documents=table)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
