"""Quality rules as weak supervision: rules vote, expectation-maximisation weighs them.

Every rule votes on a text or abstains. Votes are counted by pattern (at most two to the power
of the rules, whatever the table's size). Expectation-maximisation over these patterns
estimates, without labels, how accurate each rule is on good and on bad texts, and the posterior
probability of being good replaces a filter that all rules must pass. All of it is DataFrame
and SQL functions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.sources.sinks import materialize, release

BLANK = r"[\x20\x09-\x0D]"
SYMBOLS = "[#*$%&|<>]"
#: Words of a window that counts as repeated.
WINDOW = 5

#: Rules that vote bad, or abstain, as conditions over the measures of a text.
BAD = {
    "short": "n_words < 20",
    "word_length": "word_chars < 2.5 * n_words OR word_chars > 10 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "marks": "100 * n_marks > 25 * word_chars",
    "digits": "100 * n_digits > 25 * word_chars",
    "capitals": "100 * n_capitals > 30 * word_chars",
    "lines": "10 * n_dup_lines > 3 * n_lines",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "variety": "10 * n_distinct < 3 * n_words AND n_distinct < 300",
}
#: Rules that vote good, or abstain.
GOOD = {
    "calm": """n_words >= 10 AND word_chars BETWEEN 3 * n_words AND 9 * n_words AND 50 * n_symbols <= n_words
      AND 100 * n_marks <= 15 * word_chars AND 100 * n_capitals <= 15 * word_chars
      AND 10 * n_dup_lines <= 2 * n_lines AND 100 * n_repeat_words <= 15 * n_words""",
    "sentences": "n_words >= 20 AND n_ends BETWEEN 0.02 * n_words AND 0.4 * n_words",
}
#: What always fails, whatever the votes.
BASE_FAILED = "n_words < 10 OR 100 * n_repeat_words > 20 * n_words"


@dataclass(frozen=True)
class RuleConfig:
    """share: of good texts, where estimation starts. sound, false: how often a rule votes, at the
    start, on texts that it is right about and on the others.

    prior: texts that this start counts for. tolerance: largest change of an estimate at which
    it ends, looked at after every `rounds`. threshold: posterior probability from which a text stays.
    """

    share: float = 0.8
    sound: float = 0.5
    false: float = 0.05
    prior: float = 10.0
    tolerance: float = 1e-6
    rounds: int = 40
    threshold: float = 0.5


def measures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id and the counts of each text that the rules look at; NULL counts as empty.

    Windows are compared by a 64-bit hash inside one text, sorted, so that a text costs
    n log n however long it is.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    split = docs.select(F.col(id_column).alias("doc_id"), text.alias("text")).select(
        "*",
        F.array_remove(F.split("text", f"{BLANK}+"), "").alias("words"),
        F.filter(
            F.split("text", "\n"), lambda x: F.btrim(x, F.lit(" \t\n\v\f\r")) != ""
        ).alias("lines"),
    )

    def found(pattern: str) -> F.Column:
        return F.regexp_count("text", F.lit(pattern)).cast("long")

    counted = split.select(
        "doc_id",
        F.expr("transform(words, w -> xxhash64(w))").alias("hashes"),
        F.size("words").cast("long").alias("n_words"),
        (F.length("text") - found(BLANK)).alias("word_chars"),
        found(SYMBOLS).alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        found(r"[!-/:-@\[-`{-~]").alias("n_marks"),
        found("[0-9]").alias("n_digits"),
        found("[A-Z]").alias("n_capitals"),
        found(f"[.!?](?={BLANK}|$)").alias("n_ends"),
    )
    windows = counted.select(
        "*",
        F.size(F.array_distinct("hashes")).cast("long").alias("n_distinct"),
        F.expr(
            f"""CASE WHEN n_words >= {WINDOW} THEN transform(sequence(0, size(hashes) - {WINDOW}),
              i -> xxhash64({", ".join(f"hashes[i + {k}]" for k in range(WINDOW))}))
            ELSE array() END"""
        ).alias("windows"),
    )
    return windows.withColumn("n_repeat_words", F.expr(_REPEATED)).drop("windows", "hashes")


#: Words that the repeated windows cover: from each one's start to the next one's, or its whole
#: length. transform(array(x), s -> ...) gives x a name. Most texts stop at the first test.
_REPEATED = f"""CASE WHEN size(array_distinct(windows)) < size(windows) THEN
  transform(array(
      array_sort(flatten(transform(array(sort_array(transform(windows, (h, i) -> struct(h, i)))),
        s -> transform(filter(s, (x, k) ->
            (k > 0 AND s[greatest(k - 1, 0)].h = x.h)
            OR (k < size(s) - 1 AND s[least(k + 1, size(s) - 1)].h = x.h)),
          x -> x.i))))), p ->
    aggregate(transform(p, (a, k) -> IF(k < size(p) - 1,
        least({WINDOW}, p[least(k + 1, size(p) - 1)] - a), {WINDOW})),
      0L, (total, c) -> total + c))[0]
  ELSE 0L END"""


def votes(measured: DataFrame) -> DataFrame:
    """`measured` with a column per rule that says whether it votes."""
    return measured.withColumns({f"v_{name}": F.expr(r) for name, r in (BAD | GOOD).items()})


@dataclass(frozen=True)
class Estimates:
    """Share of good texts, and how often each rule votes on good and on bad ones; rounds it took.

    A bad rule's accuracy on bad texts is how often it votes there, that on good texts how often
    it abstains; for a good rule it is the other way round.
    """

    share: float
    on_good: dict[str, float]
    on_bad: dict[str, float]
    rounds: int = 0

    def posterior(self) -> F.Column:
        """Probability of being good, from the columns of votes."""
        odds = F.lit(math.log(self.share / (1 - self.share)))
        for r, g in self.on_good.items():
            b = self.on_bad[r]
            odds = odds + F.when(F.col(f"v_{r}"), math.log(g / b)).otherwise(
                math.log((1 - g) / (1 - b))
            )
        return 1 / (1 + F.exp(-odds))


def estimate(voted: DataFrame, cfg: RuleConfig | None = None) -> Estimates:
    """Expectation-maximisation over the patterns of votes, from the configured start.

    The start counts like `prior` texts, which keeps every estimate inside (0, 1), also of a
    rule that always abstains and on an empty table.
    """
    cfg = cfg or RuleConfig()
    rules = [*BAD, *GOOD]
    start = [(cfg.sound, cfg.false) if r in GOOD else (cfg.false, cfg.sound) for r in rules]
    new = Estimates(cfg.share, *({r: s[y] for r, s in zip(rules, start)} for y in (0, 1)))
    flags = [f"v_{r}" for r in rules]
    counted = voted.groupBy(*flags).agg(F.count("*").cast("double").alias("n"))
    # One row with a bounded number of patterns, so that a job can take many rounds.
    pattern = F.struct(F.array(*flags).alias("v"), "n")
    patterns = materialize(
        counted.agg(F.sort_array(F.collect_list(pattern)).alias("patterns")), "vote_patterns"
    )
    while True:
        row = patterns.select(F.expr(_rounds(new, start, cfg)).alias("e")).first().e
        good, bad = (dict(zip(rules, rates)) for rates in (row.g, row.b))
        new = Estimates(row.share, good, bad, new.rounds + cfg.rounds)
        if row.gap <= cfg.tolerance:
            release(patterns)
            return new


def _rounds(at: Estimates, start: list[tuple[float, float]], cfg: RuleConfig) -> str:
    """`cfg.rounds` rounds from `at` as one expression over the array `patterns`.

    transform(array(x), name -> ...)[0] gives x a name.
    """

    def doubles(values) -> str:
        return f"array({', '.join(f'{v!r}D' for v in values)})"

    every = f"sequence(0, {len(start) - 1})"
    odds = f"""ln(e.share / (1 - e.share)) + aggregate({every}, 0D, (o, k) -> o + IF(x.v[k],
      ln(e.g[k] / e.b[k]), ln((1 - e.g[k]) / (1 - e.b[k]))))"""
    weighed = f"transform(patterns, x -> struct(x.v AS v, x.n AS n, 1 / (1 + exp(-({odds}))) AS p))"

    def rates(chance: str, total: str, first) -> str:
        votes = f"aggregate(q, 0D, (t, x) -> t + IF(x.v[k], x.n * {chance}, 0D))"
        return f"""transform({every},
          k -> ({votes} + {cfg.prior!r}D * {doubles(first)}[k]) / ({total} + {cfg.prior!r}D))"""

    step = f"""transform(array({weighed}), q -> transform(array(struct(
        aggregate(q, 0D, (t, x) -> t + x.n) AS n, aggregate(q, 0D, (t, x) -> t + x.n * x.p) AS good)),
      m -> struct((m.good + {cfg.prior * cfg.share!r}D) / (m.n + {cfg.prior!r}D) AS share,
        {rates("x.p", "m.good", [s[0] for s in start])} AS g,
        {rates("(1 - x.p)", "(m.n - m.good)", [s[1] for s in start])} AS b))[0])[0]"""
    moved = f"""transform(array({step}), f -> struct(f.share AS share, f.g AS g, f.b AS b,
      greatest(abs(f.share - e.share), array_max(zip_with(f.g, e.g, (x, y) -> abs(x - y))),
        array_max(zip_with(f.b, e.b, (x, y) -> abs(x - y)))) AS gap))[0]"""
    first = f"""struct({at.share!r}D AS share, {doubles(at.on_good.values())} AS g,
      {doubles(at.on_bad.values())} AS b, 1D AS gap)"""
    return f"aggregate(sequence(1, {cfg.rounds}), {first}, (e, i) -> {moved})"


def judge(
    docs: DataFrame,
    cfg: RuleConfig | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, posterior.

    base_failed: fewer than 10 words, or more than 20 % of them in windows of five words found
    twice or more. kept: not base_failed, and a posterior of at least the threshold, so a tie
    stays. NULL and empty texts have no words and fail. Whole texts are measured, however long.
    Every row is judged, repeated ones and NULL ids too; an empty table gives no rows. Other
    columns are not looked at. The measures are written to the shared folder; the result reads
    them there.
    """
    cfg = cfg or RuleConfig()
    voted = materialize(votes(measures(docs, id_column, text_column)), "votes")
    found = estimate(voted, cfg).posterior()
    failed = F.expr(BASE_FAILED)
    return voted.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        (~failed & (found >= cfg.threshold)).alias("kept"),
        found.alias("posterior"),
    )
