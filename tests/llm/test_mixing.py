import random

import pytest
from pyspark.sql import functions as F

from firmlens.llm import mixing, oracle

COLUMNS = ("doc_id", "size", "source_size", "target", "taken")


def many(n=600, seed=5):
    rng = random.Random(seed)
    sources = ["s1", "s1", "s1", "S2", "ä", None, "s3", ""]
    return [(i, "w " * int(rng.paretovariate(0.9)), rng.choice(sources)) for i in range(n)]


def test_equals_sql(make_docs, sql):
    docs = make_docs(many())
    got = mixing.mix(docs).select(*COLUMNS).collect()
    want = sql(f"SELECT {','.join(COLUMNS)} FROM ({oracle.MIXING})", documents=docs)
    assert sorted(map(tuple, got)) == sorted(want)


def test_targets_are_shared_again_until_none_is_above_its_cap(make_docs):
    docs = make_docs([(1, "a", "A"), (2, "a " * 50, "B"), (3, "a " * 49, "C")])
    target = {r.source: r.target for r in mixing.mix(docs).collect()}
    assert target["A"] == 2.0
    assert target["C"] == 98.0  # 2/3 of 148 would be above its cap
    assert target["B"] == 50.0
    assert sum(target.values()) == pytest.approx(150)


def test_taken_words_come_near_and_stay_under_twice(make_docs):
    docs = make_docs([(i, "w " * (1 + i % 7), f"s{i % 4}") for i in range(2000)])
    out = mixing.mix(docs)
    assert out.where("taken > 2 * size OR taken % size <> 0").count() == 0
    for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect():
        assert abs(r.t - r.g) <= 7


def test_nulls_blanks_repeated_rows_and_clashing_columns(make_docs):
    docs = make_docs([(None, None, None), (1, "", "a"), (2, "x y", "a"), (2, "x y", "a"), (3, " \t\n", "b")])
    docs = docs.selectExpr("*", "1 AS key", "2 AS size", "3 AS target", "4 AS bucket")
    out = {}
    for r in mixing.mix(docs).collect():
        out.setdefault(r.doc_id, []).append(r)
    assert [r["size"] for r in out[2]] == [2, 2]
    assert out[2][0].taken == out[2][1].taken
    assert out[None][0].taken == 0 and out[1][0].taken == 0 and out[3][0].target == 0


def test_a_source_is_cut_among_the_rows_of_one_id(make_docs, sql):
    rng = random.Random(8)
    rows = [(None, f"x{i} " * rng.randint(1, 30), "all null") for i in range(400)]
    rows += [(7 if i % 3 else i, f"y{i} " * rng.randint(1, 30), "hot") for i in range(400)]
    rows += [(1000, "long " * 3000, "third"), (1001, None, "third")]
    docs = make_docs(rows)
    out = mixing.mix(docs)
    totals = out.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect()
    got = {r.source: (r.t, r.g) for r in totals}
    assert all(abs(t - g) <= 30 for name, (t, g) in got.items() if name != "third"), got
    assert abs(got["third"][0] - got["third"][1]) <= 1500
    words = mixing.apply_mix(docs).where("source <> 'third'").selectExpr("source", "size(split(trim(text), ' ')) AS n")
    assert {r.source: r.n for r in words.groupBy("source").agg(F.sum("n").alias("n")).collect()} == {
        name: t for name, (t, _) in got.items() if name != "third"
    }
    want = sql(f"SELECT {','.join(COLUMNS)} FROM ({oracle.MIXING})", documents=docs)
    got = out.select(*COLUMNS).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_table(make_docs):
    assert mixing.mix(make_docs([])).count() == 0


def test_other_parameters(make_docs):
    docs = make_docs([(i, "w w", f"s{i % 2}") for i in range(400)])
    out = mixing.mix(docs, mixing.MixConfig(pattern=(1, 3), share=0.5, most=1))
    taken = {r.source: r.t for r in out.groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    assert taken == {"s0": 100, "s1": 300}
