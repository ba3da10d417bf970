import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from firmlens.llm import boosting, quality, toxicity
from firmlens.llm.labelled import fitting_sample

LABELS = "doc_id long, quality int, toxic int"


def prose(rng, n):
    return [rng.choice("the of ration thing one sea under light house stone river".split()) for _ in range(n)]


@pytest.fixture(scope="module")
def labelled(spark, make_docs):
    """Toxic: some insults beside 'you'. Low quality: words with trailing symbols."""
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(700):
        toxic, good, text = int(i % 5 == 0), int(i % 4 != 0), prose(rng, rng.randint(20, 90))
        if toxic:
            for word in rng.sample(["stupid", "clown", "gnarf", "pathetic", "trash"], 3):
                text[rng.randrange(len(text))] = f"you {word}"
        if not good:
            text = [w + rng.choice(["***", "&&&", "%%%"]) for w in text]
        docs.append((i, " ".join(text)))
        labels.append((i, good, toxic))
    return make_docs(docs), spark.createDataFrame(labels, LABELS)


@pytest.mark.parametrize(
    ("module", "label", "folds", "fold"), [(toxicity, "toxic", 5, 0), (quality, "quality", 3, 1)]
)
def test_held_out_accuracy_and_contract(labelled, module, label, folds, fold):
    docs, labels = labelled
    out = module.score_documents(docs, labels)
    assert out.columns[:4] == ["doc_id", "held_out", "score", "predicted"]
    rows = out.join(labels, "doc_id").collect()
    assert len(rows) == 700
    held = [r for r in rows if r.held_out]
    remainder = {r.doc_id: r.m for r in docs.selectExpr("doc_id", f"crc32(cast(doc_id AS string)) % {folds} AS m").collect()}
    assert all(r.held_out == (remainder[r.doc_id] == fold) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert np.mean([r.predicted == r[label] for r in held]) >= 0.95


@pytest.mark.parametrize(
    ("module", "label", "fold"), [(toxicity, "toxic", "m = 0"), (quality, "quality", "m = 1")]
)
def test_held_out_labels_do_not_matter(labelled, module, label, fold):
    docs, labels = labelled
    n = 5 if label == "toxic" else 3
    flipped = labels.withColumn("m", F.expr(f"crc32(cast(doc_id AS string)) % {n}")).withColumn(
        label, F.expr(f"IF({fold}, 1 - {label}, {label})")
    )
    a = module.score_documents(docs.limit(150), labels).select("doc_id", "score").collect()
    b = module.score_documents(docs.limit(150), flipped).select("doc_id", "score").collect()
    assert sorted(a) == sorted(b)


@pytest.mark.parametrize("module", [toxicity, quality])
def test_nulls_empty_long_repeated_and_clashing_columns(spark, make_docs, labelled, module):
    docs = make_docs([(None, "x"), (1, None), (2, ""), (3, " \n"), (4, "a b"), (4, "a b"), (5, "you clown " * 50_000)])
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 1), (5, None, None), (None, 1, 1), (2, 0, 1)], LABELS)
    wide = docs.selectExpr("*", "1 AS score", "2 AS y", "3 AS held_out", "4 AS predicted", "5 AS toxic")
    out = module.score_documents(wide, labels).collect()
    assert len(out) == 7 and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == 4}) == 1


@pytest.mark.parametrize("module", [toxicity, quality])
def test_no_documents_and_no_labels(make_docs, labelled, module):
    docs, labels = labelled
    assert module.score_documents(docs.where("false"), labels).count() == 0
    none = module.score_documents(docs.limit(5), labels.where("false")).collect()
    assert [r.score for r in none] == [0.0] * 5


def test_stage_keeps_clean_documents_as_they_are(labelled):
    docs, labels = labelled
    wide = docs.withColumn("toxicity", F.lit("extra"))
    kept = toxicity.drop_toxic(wide, labels)
    assert kept.columns == wide.columns and kept.exceptAll(wide).count() == 0
    left = {r.doc_id for r in kept.collect()}
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    assert len(left & toxic) <= 0.05 * len(toxic) and len(left - toxic) >= 0.99 * (700 - len(toxic))


def test_second_person_obfuscation_and_density_features():
    features = toxicity.Features({b"gnarf": 2.0}, toxicity.ToxicConfig())
    base = features("the house of stone and a clown here")
    assert features("you clown " + "stone " * 6)[10] > base[10] == 0
    assert features("st.u-pid 1d10t")[12] > 0 and base[12] == 0
    assert features("GO AWAY NOW friend")[15] > 0
    assert len(features(None)) == len(features("x")) == len(base)


def test_boosting_learns_an_interaction_and_isotonic_is_monotone():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0) & (x[:, 1] > 0)).astype(float)
    trees = boosting.BoostedTrees(x[:1000], y[:1000], boosting.BoostConfig())
    margin = trees.margin(x[1000:])
    assert np.mean((margin > 0) == y[1000:]) > 0.97
    calibrated = boosting.Isotonic(margin, y[1000:])(np.linspace(-9, 9, 200))
    assert (np.diff(calibrated) >= 0).all() and calibrated[0] < 0.1 < 0.9 < calibrated[-1]


def test_isotonic_equals_the_definition():
    m, y = np.arange(6.0), np.array([0, 1, 0, 0, 1, 1.0])
    fit = boosting.Isotonic(m, y)
    assert fit.at.tolist() == [0.0, 2.0, 4.5]
    assert fit.rate == pytest.approx([0, 1 / 3, 1], abs=0.01)


def test_context_sums_equal_a_plain_count(make_docs):
    cfg = quality.QualityConfig(buckets=16, dims=5, entries=2)
    texts = ["a b c d a", "", None, "b", "c  a\nB e"]
    index = quality.index_vectors(cfg)
    want, seen = np.zeros((16, 5), int), np.zeros(16, int)
    for text in texts:
        own, _ = quality.buckets_of([text], cfg)
        for i, bucket in enumerate(own):
            seen[bucket] += 1
            for j in range(max(0, i - 2), min(len(own), i + 3)):
                if j != i:
                    want[bucket] += index[own[j]]
    got = quality.context_sums(make_docs(list(enumerate(texts))), cfg).collect()
    assert {r.bucket: r.n for r in got} == {b: n for b, n in enumerate(seen) if n}
    for r in got:
        assert [r[f"c{d}"] for d in range(5)] == want[r.bucket].tolist()


def test_temperature_softens_overconfident_margins():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3))
    y = (x[:, 0] + rng.normal(size=600) * 1.5 > 0).astype(float)
    net = quality.Network(x, y, quality.QualityConfig())
    p = net(x)
    assert 0.2 <= net.temperature <= 5.0
    assert abs(p.mean() - y.mean()) < 0.1 and isinstance(pa.array(p), pa.DoubleArray)


def test_sample_has_one_row_of_a_repeated_id(spark, make_docs):
    docs = make_docs([*((1, f"text {i}") for i in range(200)), (2, "b"), (2, None), (3, "c")])
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (2, 1, 0)], LABELS)
    once, again = (fitting_sample(d, labels, "toxic", F.lit(True), 10).collect() for d in (docs, docs.orderBy(F.desc("text"))))
    assert sorted((r.doc_id, r.y) for r in once) == [(1, 1), (2, 0)]
    assert sorted(once) == sorted(again)
