import random

import pytest

from firmlens.llm import oracle, sharding

COLUMNS = ("doc_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_docs")


@pytest.mark.parametrize("limit", [10**9, 3000, 500])
def test_equals_sql(make_docs, sql, limit):
    rng = random.Random(2)
    docs = make_docs([(i, "ä" * int(rng.paretovariate(1.0))) for i in range(300)])
    got = sorted(map(tuple, sharding.assign_shards(docs, limit).select(*COLUMNS).collect()))
    want = sql(f"SELECT {','.join(COLUMNS)} FROM ({oracle.SHARDING.format(limit=limit)})", documents=docs)
    assert got == sorted(want)


def test_shards_fit_and_prefixes_are_disjoint(make_docs):
    docs = make_docs([(i, "x" * (i % 40)) for i in range(5000)])
    shards = {r.shard: r.shard_bytes for r in sharding.assign_shards(docs, 40).collect()}
    assert max(shards.values()) <= 40
    names = sorted(shards)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    assert max(map(len, names)) > 12  # more than one level of the directory


def test_one_id_above_the_limit_is_split_too(make_docs):
    docs = make_docs([(7, "x" * 10)] * 50 + [(8, "y" * 500)])
    out = sharding.assign_shards(docs, 100).collect()
    assert len(out) == 51
    assert all(r.shard_bytes <= 100 or r.shard_docs == 1 for r in out)


def test_nulls_empty_and_clashing_columns(make_docs):
    docs = make_docs([(None, None), (1, ""), (1, "abc")]).selectExpr("*", "1 AS key", "'x' AS shard")
    out = sharding.assign_shards(docs, carry=("shard", "key")).collect()
    assert sorted(r.n_bytes for r in out) == [0, 0, 3] and out[0].row.shard == "x"
    assert sharding.assign_shards(make_docs([])).count() == 0


def test_written_shards_hold_all_rows(spark, make_docs, tmp_path):
    docs = make_docs([(i, "x" * 9) for i in range(200)])
    sharding.write_shards(docs, str(tmp_path / "out"), 300)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.select(*docs.columns).exceptAll(docs).count() == 0 and back.count() == 200
    assert max(r["sum(n)"] for r in back.selectExpr("shard", "length(text) AS n").groupBy("shard").sum("n").collect()) <= 300
