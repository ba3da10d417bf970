import collections
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from firmlens.llm import lm_score
from firmlens.llm.lm_score import LmConfig

SMALL = LmConfig(own=4, classes=3, head=10, dims=4, batch=64)


def languages(n=400, seed=4):
    """Texts in one of two invented languages, so that the words before tell which one."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        tongue = rng.choice(["a", "b"])
        out.append((i, " ".join(f"{tongue}{min(int(rng.expovariate(0.4)), 30)}" for _ in range(rng.randint(0, 60)))))
    return out


def plain(docs, learn):
    lists = [[*(t or "").encode().lower().split(), None] for _, t in docs]
    c = collections.Counter(w for (i, _), ws in zip(docs, lists) if learn(i) for w in ws)
    total, distinct = sum(c.values()), len(c)
    out = []
    for (i, _), ws in zip(docs, lists):
        base = sum(math.log10((c[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in ws)
        out.append((i, not learn(i), len(ws), sum(c[w] > 0 for w in ws), total, base))
    return out


def learns(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1


@pytest.mark.parametrize("cfg", [LmConfig(), SMALL])
def test_base_scores_equal_their_definition(make_docs, cfg):
    docs = [*languages(), (None, "a1 never-seen"), (7, None), (8, ""), (8, ""), (9, "A1\x0bB2 x  a1")]
    table = make_docs(docs).selectExpr("*", "1 AS token", "2 AS n", "3 AS row", "4 AS base", "5 AS learn")
    got = lm_score.score_documents(table, cfg).collect()
    want = plain(docs, learns)
    def order(r):
        return (-1 if r[0] is None else r[0], r[2], r[5])

    got, want = sorted(map(tuple, got), key=order), sorted(want, key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert [r[5] for r in got] == pytest.approx([r[5] for r in want], rel=1e-9)
    assert all(r[6] < 0 for r in got)


def test_model_beats_the_counts_on_held_out_texts(make_docs):
    cfg = LmConfig(own=32, classes=4, batch=64)
    rows = lm_score.score_documents(make_docs(languages(1500)), cfg).where("held_out AND n_tokens > 5").collect()
    assert sum(r.score for r in rows) > 0.95 * sum(r.base_score for r in rows)
    assert np.mean([r.score > r.base_score for r in rows]) > 0.9


def test_probabilities_sum_to_one(make_docs):
    counts = lm_score.token_counts(make_docs(languages(60))).cache()
    vocabulary = lm_score.Vocabulary(counts, SMALL)
    model = lm_score.LogBilinear(vocabulary.prior, SMALL)
    rng = np.random.default_rng(0)
    context = rng.integers(0, SMALL.outputs + 1, (SMALL.context, 5))
    each = np.exp([model.log_probability(context, np.full(5, o)) for o in range(SMALL.outputs)])
    assert each.sum(axis=0) == pytest.approx(1, abs=1e-5)
    inside = np.full(SMALL.classes, 0.5)  # the unknown word of each class
    own = set(vocabulary.own.tolist())
    for r in counts.collect():
        if r.token not in own:
            inside[r.token % SMALL.classes] += r.n + 0.5
    assert inside == pytest.approx(vocabulary.class_size)


def test_training_lowers_the_true_loss():
    cfg = LmConfig(own=8, classes=2, dims=6, batch=32)
    rng = np.random.default_rng(3)
    out = np.tile(np.arange(8), 400)  # each token follows the one before
    context = lm_score.contexts(out, np.array([len(out)]), cfg)
    model = lm_score.LogBilinear(np.full(10, 0.1), cfg)
    before = model.log_probability(context, out).mean()
    for _ in range(3):
        model.train(context, out, rng)
    assert model.log_probability(context, out).mean() > before / 2


def test_contexts_stop_at_the_start_of_a_text():
    cfg = LmConfig(own=8, classes=2)
    got = lm_score.contexts(np.array([1, 2, 3, 4]), np.array([3, 1]), cfg)
    assert got.T.tolist() == [[10, 10, 10], [1, 10, 10], [2, 1, 10], [10, 10, 10]]


def test_empty_table_no_training_rows_and_reruns(make_docs):
    assert lm_score.score_documents(make_docs([])).count() == 0
    docs = make_docs(languages(50))
    none = lm_score.score(docs, F.lit(False), SMALL).collect()
    assert all(abs(r.base_score) < 1e-9 and r.n_known == 0 and r.train_tokens == 0 for r in none)
    once, again = (sorted(lm_score.score_documents(docs, SMALL).collect()) for _ in range(2))
    assert [r.score for r in once] == pytest.approx([r.score for r in again])


def test_very_long_text(make_docs):
    r = lm_score.score_documents(make_docs([(1, "a b c d " * 100_000), (2, "a b")]), SMALL).collect()
    assert max(x.n_tokens for x in r) == 400_001


def test_words_beyond_the_most_frequent_128_learn_what_follows(make_docs):
    rng = random.Random(5)
    docs = [(i, " ".join(f"x{n} y{n}" for n in rng.choices(range(300), k=100))) for i in range(500)]
    rows = lm_score.score_documents(make_docs(docs), LmConfig(batch=64)).where("held_out").collect()
    # Half of the words follow from the one before, which is worth log10(600) each.
    gain = np.mean([(r.score - r.base_score) / r.n_tokens for r in rows])
    assert gain > 0.5 * math.log10(600) / 2


def test_probabilities_of_grouped_outputs_sum_to_one():
    cfg, rng = LmConfig(own=500, classes=5), np.random.default_rng(1)
    model = lm_score.LogBilinear(1 / np.arange(1, 506), cfg)
    assert 5 < len(model.first) - 1 < 60 and max(np.diff(model.first)) > 5
    model.train(rng.integers(0, 506, (3, 900)), rng.integers(0, 505, 900), rng)
    context = rng.integers(0, 506, (3, 4))
    each = np.exp([model.log_probability(context, np.full(4, o)) for o in range(505)])
    assert each.sum(axis=0) == pytest.approx(1, abs=1e-5)


def test_tokens_are_the_words_between_ascii_blanks():
    import pyarrow as pa

    texts = [None, "", " ", "one", "  Two  ONE\t\n\v\f\rÄÖ two\x1cx\x1fy\x85z\xa0w v ", "x" * 100_000, "end\n", "İ ﬀ ẞ"]
    for array in (pa.array(texts), pa.array(["skip", *texts]).slice(1)):
        hashes, place, sizes = lm_score.tokens(array)
        lists = [(t or "").encode().lower().split() for t in texts]
        want = [h for ws in lists for h in [*lm_score.word_hashes(ws).view(np.int64).tolist(), lm_score.END]]
        assert hashes[place].tolist() == want
        assert sizes.tolist() == [len(ws) + 1 for ws in lists]
    assert len(lm_score.tokens(pa.array([], pa.string()))[1]) == 0
