import glob
import random

import pytest

import __spark_entry__
import corpus_pipeline
from firmlens.llm import mixing, secret_scan
from firmlens.sources.sinks import shared_folder


@pytest.fixture(scope="module")
def folder(spark, make_docs, tmp_path_factory):
    """A small corpus with toxic documents, copies and secrets, as the stages read it."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(300)]
    docs, labels = [], []
    for i in range(400):
        text, toxic = rng.choices(words, k=rng.randint(20, 60)), int(i % 6 == 0)
        if toxic:
            text[5:5] = ["you", "stupid", "clown"]
        docs.append((i, " ".join(text), f"s{i % 3}"))
        labels.append((i, 1, toxic))
    clean = [d for d in docs if d[0] % 6]
    docs += [(500 + n, d[1], d[2]) for n, d in enumerate(clean[:30])]
    docs += [(600, "password: hunter2222 " + " ".join(rng.choices(words, k=40)), "s1"), (601, None, None), (602, "", "s0")]
    path = tmp_path_factory.mktemp("corpus")
    make_docs(docs).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_each_stage_on_its_own_input(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{tmp_path}/{name}")
        seen[name] = docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert docs.columns == columns
    left = {n: [r.doc_id for r in d.select("doc_id").collect()] for n, d in seen.items()}
    clean = {*range(400)} - {*range(0, 400, 6)} | {*range(500, 530), 600, 601, 602}
    assert len(set(left["toxicity"]) ^ clean) <= 3
    assert sorted(left["near_duplicates"]) == sorted(i for i in left["toxicity"] if not 500 <= i < 530)
    assert sorted(left["secrets"]) == sorted(left["near_duplicates"])
    masked = seen["secrets"].where("doc_id = 600").first()
    assert "hunter" not in masked.text and masked.n_chars == len(masked.text)
    taken = {(r.doc_id): r.times for r in mixing.mix(seen["secrets"]).selectExpr("doc_id", "IF(size = 0, NULL, taken / size) AS times").collect()}
    for i, times in taken.items():
        assert times is None or left["mixing"].count(i) == times
    assert set(left["packing"]) == set(left["mixing"])


def _stages(spark):
    return set(glob.glob(f"{shared_folder(spark).removeprefix('file:')}/stage_*"))


def test_run_gives_what_the_last_stage_gives(spark, folder):
    before = _stages(spark)
    packed = corpus_pipeline.run(spark, folder).collect()
    assert len(_stages(spark) - before) == 1  # the result
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(packed[0].asDict())
    fill = {}
    for r in packed:
        fill[r.sequence_id] = fill.get(r.sequence_id, 0) + r.length
    assert max(fill.values()) <= 1024 and len(fill) <= sum(fill.values()) / 1024 + 2


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert {"op2_sharding", "op6_mixing"} <= set(__spark_entry__.oracle_sql()) <= set(names)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "packing"]


def test_mix_keeps_rows_whole_with_clashing_columns(make_docs):
    docs = make_docs([(1, "a b", None), (2, "", "x"), (2, "c", "x"), (None, None, "x")])
    docs = docs.selectExpr("*", "1 AS `key`", "2 AS turn", "3 AS `limit`", "4 AS of")
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns and out.exceptAll(docs.union(docs)).count() == 0
    assert mixing.apply_mix(make_docs([])).count() == 0
    blank = make_docs([(i, "", "x") for i in range(40)] + [(99, "c", "x"), (100, "d e f g", "y")])
    assert mixing.apply_mix(blank).groupBy("doc_id").count().where("count > 2").count() == 0


def test_masking_counts_characters_again_only_where_text_changed(make_docs):
    docs = make_docs([(1, "token=abcdefg x"), (2, "clean")]).selectExpr("doc_id", "text", "lang", "source", "99L AS n_chars", "1 AS old_text")
    rows = {r.doc_id: r for r in secret_scan.mask_documents(docs).collect()}
    assert rows[1].text == "[REDACTED] x" and rows[1].n_chars == 12 and rows[2].n_chars == 99
