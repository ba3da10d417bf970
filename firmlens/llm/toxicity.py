"""Toxicity scores: boosted trees over dense features of a whole text, with isotonic calibration."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.boosting import BoostConfig, BoostedTrees, Isotonic
from firmlens.llm.common import fold, fresh, mapped
from firmlens.llm.labelled import fitting_sample, report, with_scores
from firmlens.llm.vectors import matrix
from firmlens.sources.sinks import materialize, release

# Common insults and threats, and words of the second person.
INSULTS = (
    "stupid idiot moron dumb loser pathetic disgusting trash garbage worthless ugly clown fool "
    "jerk scum filthy hate kill die shut idiota imbécil estúpido asco basura idiote imbécile "
    "stupide débile ordure dumm idiot trottel dreck widerlich abschaum"
)
SECOND_PERSON = (
    "you your yours yourself you're youre u ur du dich dir dein deine ihr euch tu toi te ton ta "
    "vous votre tú tu usted vosotros"
)


@dataclass(frozen=True)
class ToxicConfig:
    """sample_rows bounds the labelled rows used for fitting; lexicon_words the learned lexicon.

    least_odds: log odds of being toxic, less their standard error, of a learned word.
    near: words between an insult and a word of the second person. window: words of the
    passage whose density counts. folds: of the calibration.
    """

    sample_rows: int = 20_000
    lexicon_words: int = 300
    least_odds: float = 3.0
    near: int = 5
    window: int = 50
    folds: int = 3
    boost: BoostConfig = field(default_factory=BoostConfig)


_STRIP = bytes.maketrans(b".,;:!?\"'()[]", b" " * 12)
_LOOKALIKE = bytes.maketrans(b"013457@$!|", b"oieastasii")
_JOINERS = b".-_*"
_CLASSES = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "exclaim": b"!",
    "ask": b"?",
    "stop": b".,;:",
    "symbol": b"*@$#%&^~|<>",
    "blank": b" \t\n\v\f\r",
    "line": b"\n",
}
_CLASS_OF = np.zeros((256, len(_CLASSES)))
for _n, _bytes in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_bytes), _n] = 1.0
_SHOUTED = re.compile(rb"\b[A-Z]{3,}\b")


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased words without punctuation around or inside them."""
    return (text or "").encode().lower().translate(_STRIP).split()


class Features:
    """Dense features of a text, given a lexicon of word weights."""

    def __init__(self, lexicon: dict[bytes, float], cfg: ToxicConfig):
        self.cfg = cfg
        self.lexicon = lexicon
        self.insults = frozenset(INSULTS.encode().split())
        self.person = frozenset(SECOND_PERSON.encode().split())
        self.all = self.insults | self.person | lexicon.keys()

    def __call__(self, text: str | None) -> list[float]:
        raw = (text or "").encode()
        low = raw.lower()
        words = low.translate(_STRIP).split()
        n = max(len(words), 1)
        marks = [(i, w) for i, w in enumerate(words) if w in self.all]
        insult = np.array([i for i, w in marks if w in self.insults])
        learned = np.array([i for i, w in marks if w in self.lexicon])
        weights = [self.lexicon[w] for _, w in marks if w in self.lexicon]
        person = np.array([i for i, w in marks if w in self.person])
        hits = np.union1d(insult, learned)
        # Words that become lexicon words once lookalikes and joiners are undone.
        undone = low.translate(_LOOKALIKE, _JOINERS).translate(_STRIP).split()
        known = self.insults | self.lexicon.keys()
        hidden = sum(map(known.__contains__, undone)) - sum(w in known for _, w in marks)
        counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256) @ _CLASS_OF
        size = max(len(raw), 1)
        return [
            np.log1p(len(words)),
            len(insult) / n,
            np.log1p(len(insult)),
            len(learned) / n,
            np.log1p(len(learned)),
            float(len({w for _, w in marks if w in self.lexicon})),
            sum(weights) / n,
            max(weights, default=0.0),
            self._densest(hits),
            len(person) / n,
            self._near(hits, person) / n,
            np.log1p(self._near(hits, person)),
            max(hidden, 0) / n,
            np.log1p(max(hidden, 0)),
            counts[0] / max(counts[0] + counts[1], 1),
            len(_SHOUTED.findall(raw)) / n,
            *(counts[2:] / size),
            size / n,
        ]

    def _densest(self, hits: np.ndarray) -> float:
        """Most hits in any window of words."""
        if not len(hits):
            return 0.0
        return float((np.searchsorted(hits, hits + self.cfg.window) - np.arange(len(hits))).max())

    def _near(self, hits: np.ndarray, person: np.ndarray) -> float:
        if not len(hits) or not len(person):
            return 0.0
        at = np.searchsorted(person, hits)
        after = person[np.minimum(at, len(person) - 1)]
        before = person[np.maximum(at - 1, 0)]
        return float((np.minimum(abs(after - hits), abs(hits - before)) <= self.cfg.near).sum())

    def matrix(self, texts: list[str | None]) -> np.ndarray:
        return np.array([self(t) for t in texts], float).reshape(len(texts), -1)


class ToxicityModel:
    """Scores between 0 and 1; without labels of both kinds, their rate for every text."""

    def __init__(self, features: Features, x: np.ndarray, y: np.ndarray):
        self.features = features
        self.rate = float(y.mean()) if len(y) else 0.0
        self.trees = None
        if 0 < y.sum() < len(y):
            cfg = features.cfg
            margin = np.zeros(len(y))
            part = np.arange(len(y)) % cfg.folds
            for k in range(cfg.folds):
                learn, judge = part != k, part == k
                if judge.any() and learn.any():
                    margin[judge] = BoostedTrees(x[learn], y[learn], cfg.boost).margin(x[judge])
            self.calibrate = Isotonic(margin, y)
            self.trees = BoostedTrees(x, y, cfg.boost)

    def __call__(self, texts: pa.Array) -> np.ndarray:
        if self.trees is None:
            return np.full(len(texts), self.rate)
        x = self.features.matrix(texts.to_pylist())
        return self.calibrate(self.trees.margin(x)) if len(x) else np.zeros(0)


def learned_lexicon(sample: DataFrame, cfg: ToxicConfig) -> dict[bytes, float]:
    """Words whose documents are toxic far more often, by log odds less their standard error."""

    def counts(batch: pa.RecordBatch) -> Iterator[dict]:
        bad, good = Counter(), Counter()
        for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            (bad if y else good).update(set(plain_words(text)))
        seen = list(bad.keys() | good.keys())
        yield {"word": seen, "bad": [bad[w] for w in seen], "good": [good[w] for w in seen]}

    bad, good = sample.agg(F.count_if(F.col("y") > 0), F.count_if(F.col("y") <= 0)).first()
    if not bad or not good:
        return {}
    parts = mapped(sample.select("text", "y"), "word binary, bad long, good long", counts, rows=2048)
    total = parts.groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    odds = f"ln((bad + 0.5) / ({bad} - bad + 0.5)) - ln((good + 0.5) / ({good} - good + 0.5))"
    best = (
        total.where("bad >= 3")
        .selectExpr("word", f"{odds} AS odds", "sqrt(1 / (bad + 0.5) + 1 / (good + 0.5)) AS error")
        .where(f"odds - error >= {cfg.least_odds}")
        .orderBy(F.desc("odds"), "word")
        .limit(cfg.lexicon_words)
    )
    return {bytes(r.word): r.odds for r in best.collect()}


def train(
    docs: DataFrame,
    labels: DataFrame,
    cfg: ToxicConfig | None = None,
    may_learn: F.Column | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    label: str = "toxic",
) -> ToxicityModel:
    """Fit on at most `sample_rows` labelled rows for which `may_learn` (on doc_id) holds.

    One half of them gives the lexicon, the other the features that the trees see, so that
    the trees learn what lexicon hits mean for texts the lexicon was not made from.
    """
    cfg = cfg or ToxicConfig()
    may_learn = F.lit(True) if may_learn is None else may_learn
    sample = fitting_sample(docs, labels, label, may_learn, cfg.sample_rows, id_column, text_column)
    sample = materialize(sample, "toxicity_sample")
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))
    features = Features(learned_lexicon(sample.where(half == 0), cfg), cfg)

    def measure(batch: pa.RecordBatch) -> Iterator[dict]:
        yield {
            "doc_id": batch.column(0),
            "x": features.matrix(batch.column(1).to_pylist()).tolist(),
            "y": batch.column(2),
        }

    kind = sample.schema["doc_id"].dataType.simpleString()
    rest = sample.where(half == 1).select("doc_id", "text", "y")
    seen = mapped(rest, f"doc_id {kind}, x array<double>, y int", measure).toArrow()
    seen = seen.sort_by([("doc_id", "ascending")])
    release(sample)
    x = matrix(seen["x"])
    return ToxicityModel(features, x, (seen["y"].to_numpy() > 0).astype(float))


def score_documents(docs: DataFrame, labels: DataFrame, cfg: ToxicConfig | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted per row, learning where crc32(doc_id) mod 5 is not 0.

    NULL and empty texts are scored by their features, which are all zero. Every row is kept,
    repeated ones too; other columns are not looked at. Very long texts are read whole. Where more
    rows are labelled than the sample may hold, ties of its hash go by id. An empty table gives
    no rows; without labels of both kinds every text has their rate, 0 without any.
    """
    model = train(docs, labels, cfg, fold("doc_id", 5) != 0)
    return report(docs, model, fold("doc_id", 5) == 0)


def drop_toxic(
    docs: DataFrame, labels: DataFrame, cfg: ToxicConfig | None = None, threshold: float = 0.5
) -> DataFrame:
    """The rows of `docs` whose text scores below `threshold`, unchanged."""
    name = fresh(docs, "toxicity")
    model = train(docs, labels, cfg)
    return with_scores(docs, model, name).where(F.col(name) < threshold).drop(name)
