import re
from collections import Counter

import pytest

from firmlens.llm import oracle_rules, quality_rules

BASE = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def plain(doc_id, text):
    """The base columns of one text, by their definition."""
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if times[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, repeats = len(words), len(covered)
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    failed = n < 10 or 100 * repeats > 20 * n
    return (doc_id, n, sum(map(len, words)), symbols, len(lines) - len(set(lines)), repeats, failed)


PROSE = "The {0} river bends slowly past old farms. Its {0} water carries {1} boats and sand. "
CASES = [
    None, "", " \n\t\r", "one two three", "a b c d e a b c d e", "a b c d e f a b c d e f g h i j k l m n o p q r s t",
    "x " * 30, "a a a a a", "a a a a a a", "l\nl\n\n \nl\nm\r\nm\r\nm", "élan vital – ça va #$%",
    "tab\tand\vand\fand\rand same same", "Über 🙂 emoji\n" * 4,
    "".join(PROSE.format(i, i * 7) for i in range(40)),
    "".join(PROSE.format(i % 3, "big") for i in range(200)),
    "word#$% " * 5 + " ".join(f"w{i}#$%" for i in range(60)),
]


def test_base_columns_equal_their_definition(make_docs):
    docs = make_docs(list(enumerate(CASES)))
    got = quality_rules.judge(docs).select(*BASE).collect()
    assert sorted(map(tuple, got)) == [plain(i, t) for i, t in enumerate(CASES)]


def test_every_row_comes_back_as_the_sql_has_it(spark, sf_dir, sql):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = quality_rules.judge(docs).drop("posterior").collect()
    want = sql(oracle_rules.statement(), documents=docs)
    assert sorted(map(tuple, got)) == sorted(want) and len(got) == docs.count()
    assert sorted(tuple(r)[:7] for r in got) == sorted(plain(r.doc_id, r.text) for r in docs.collect())


def test_the_verdict_agrees_with_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = quality_rules.judge(spark.read.parquet(f"{folder}/documents.parquet")).join(labels, "doc_id")
    rows = got.where("n_words >= 10").collect()
    good = [r.kept for r in rows if r.quality == 1]
    bad = [r.kept for r in rows if r.quality == 0]
    assert sum(good) >= 0.97 * len(good) and sum(bad) <= 0.1 * len(bad)


def plain_em(patterns, cfg, rounds=200):
    """Estimates over (votes by rule, number) patterns."""
    rules = [*quality_rules.BAD, *quality_rules.GOOD]
    start = {r: (cfg.sound, cfg.false) if r in quality_rules.GOOD else (cfg.false, cfg.sound) for r in rules}
    share, rates = cfg.share, dict(start)
    for _ in range(rounds):
        sums = {r: [0.0, 0.0] for r in rules}
        total = [0.0, 0.0]
        for votes, n in patterns:
            like = [share, 1 - share]
            for r in rules:
                for y in (0, 1):
                    like[y] *= rates[r][y] if r in votes else 1 - rates[r][y]
            for y in (0, 1):
                p = n * like[y] / sum(like)
                total[y] += p
                for r in votes:
                    sums[r][y] += p
        w = cfg.prior
        share = (total[0] + w * cfg.share) / (sum(total) + w)
        rates = {r: tuple((sums[r][y] + w * start[r][y]) / (total[y] + w) for y in (0, 1)) for r in rules}
    return share, rates


def test_estimates_equal_a_plain_loop(spark):
    rules = [*quality_rules.BAD, *quality_rules.GOOD]
    patterns = [({"calm", "sentences"}, 700), ({"calm"}, 60), ({"symbols", "marks"}, 40), (set(), 9),
                ({"repeats", "lines", "sentences"}, 30), ({"variety", "calm"}, 3)]
    rows = [tuple(r in v for r in rules) for v, n in patterns for _ in range(n)]
    voted = spark.createDataFrame(rows, ", ".join(f"v_{r} boolean" for r in rules))
    cfg = quality_rules.RuleConfig(tolerance=1e-12)
    got = quality_rules.estimate(voted, cfg)
    share, rates = plain_em(patterns, cfg)
    assert got.share == pytest.approx(share, rel=1e-6)
    for r in rules:
        assert (got.on_good[r], got.on_bad[r]) == pytest.approx(rates[r], rel=1e-6)


def test_odd_rows(make_docs):
    text = "".join(f"Word{i} is next to {i * 31 % 97}th thing. " for i in range(40))
    docs = make_docs([(1, text), (1, text), (None, text), (None, None), (2, "w " * 200_000)])
    docs = docs.selectExpr("*", "1 AS words", "2 AS n_words", "3 AS v_calm", "4 AS windows", "5 AS posterior")
    got = quality_rules.judge(docs).collect()
    assert sorted([r.doc_id for r in got], key=str) == [1, 1, 2, None, None]
    by = {(r.doc_id, r.n_words > 0): r for r in got}
    assert by[1, True].kept and by[None, True].kept and not by[None, False].kept
    assert (by[2, True].n_words, by[2, True].n_repeat_words, by[2, True].kept) == (200_000, 200_000, False)
    assert quality_rules.judge(make_docs([])).collect() == []
