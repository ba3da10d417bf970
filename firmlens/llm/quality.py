"""Quality scores: random-indexing word vectors, pooled per document, and a two-layer network.

Every word falls in one of a fixed number of buckets, and each bucket has a sparse random
index vector. A bucket's context vector is the sum of the index vectors around all its
occurrences in all documents: integer sums that Spark adds up per bucket, so that the model
has one size whatever the corpus. Documents are the weighted mean of their words' vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.boosting import sigmoid
from firmlens.llm.common import fold, mapped, word_hashes, words
from firmlens.llm.labelled import fitting_sample, report
from firmlens.llm.vectors import matrix
from firmlens.sources.sinks import materialize, release


@dataclass(frozen=True)
class QualityConfig:
    """buckets and dims size the word vectors; sample_rows bounds the labelled rows of the fit.

    near: words on each side that count as context. entries: nonzeros of an index vector.
    usual: share of all words above which a word counts less in a document's mean.
    """

    buckets: int = 2**15
    dims: int = 32
    entries: int = 4
    near: int = 2
    usual: float = 1e-3
    sample_rows: int = 20_000
    hidden: int = 32
    epochs: int = 60
    rate: float = 3e-3
    decay: float = 1e-4
    seed: int = 17


def index_vectors(cfg: QualityConfig) -> np.ndarray:
    """One sparse vector of +1 and -1 per bucket, and a zero one for the gap between documents."""
    rng = np.random.default_rng(cfg.seed)
    out = np.zeros((cfg.buckets + 1, cfg.dims), np.int32)
    where = rng.random((cfg.buckets, cfg.dims)).argsort(axis=1)[:, : cfg.entries]
    signs = rng.choice(np.array([-1, 1], np.int32), (cfg.buckets, cfg.entries))
    np.put_along_axis(out[:-1], where, signs, axis=1)
    return out


def buckets_of(texts: list[str | None], cfg: QualityConfig) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words, text after text, and the number of words of each text."""
    lists = [words(t) for t in texts]
    sizes = np.array([len(w) for w in lists], int)
    hashes = word_hashes(w for one in lists for w in one)
    return (hashes % np.uint64(cfg.buckets)).astype(np.int64), sizes


def context_sums(docs: DataFrame, cfg: QualityConfig, text_column: str = "text") -> DataFrame:
    """(bucket, n, c0, c1, ...): occurrences and summed context of every bucket that occurs."""
    index = index_vectors(cfg)
    names = [f"c{d}" for d in range(cfg.dims)]

    def add(flat: np.ndarray, sizes: np.ndarray, sums: np.ndarray, seen: np.ndarray) -> None:
        # A gap of `near` empty places after each text keeps texts apart.
        place = np.arange(len(flat)) + cfg.near * np.repeat(np.arange(len(sizes)), sizes)
        padded = np.full(len(flat) + cfg.near * len(sizes) + cfg.near, cfg.buckets)
        padded[place] = flat
        own = index[padded]
        context = np.zeros_like(own)
        for step in range(1, cfg.near + 1):
            context[step:] += own[:-step]
            context[:-step] += own[step:]
        seen += np.bincount(padded, minlength=cfg.buckets + 1)
        for d in range(cfg.dims):
            sums[:, d] += np.bincount(padded, context[:, d], cfg.buckets + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((cfg.buckets + 1, cfg.dims))
        seen = np.zeros(cfg.buckets + 1, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                flat, sizes = buckets_of(batch.slice(at, 128).column(0).to_pylist(), cfg)
                add(flat, sizes, sums, seen)
        used = np.flatnonzero(seen[:-1])
        columns = [sums[used, d].astype(np.int64) for d in range(cfg.dims)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (used, seen[used], *columns)], names=["bucket", "n", *names]
        )

    schema = ", ".join(f"{c} long" for c in ("bucket", "n", *names))
    parts = docs.select(text_column).mapInArrow(run, schema)
    return parts.groupBy("bucket").agg(*(F.sum(c).alias(c) for c in ("n", *names)))


class DocumentVectors:
    """Pools word vectors: the plain mean, the mean with usual words weighted down, and lengths."""

    def __init__(self, sums: pa.Table, cfg: QualityConfig):
        self.cfg = cfg
        self.vectors = np.zeros((cfg.buckets, cfg.dims), np.float32)
        self.weight = np.ones(cfg.buckets, np.float32)
        if sums.num_rows:
            bucket, n = sums["bucket"].to_numpy(), sums["n"].to_numpy()
            raw = np.stack([sums[f"c{d}"].to_numpy() for d in range(cfg.dims)], axis=1)
            self.vectors[bucket] = raw / np.maximum(np.linalg.norm(raw, axis=1, keepdims=True), 1)
            self.weight[bucket] = cfg.usual / (cfg.usual + n / n.sum())

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        flat, sizes = buckets_of(texts, self.cfg)
        out = np.zeros((len(texts), 2 * self.cfg.dims + 3))
        ends = np.cumsum(sizes)
        for at in np.flatnonzero(sizes):
            own = flat[ends[at] - sizes[at] : ends[at]]
            vectors, weight = self.vectors[own], self.weight[own]
            mean, rare = vectors.mean(axis=0), weight @ vectors / weight.sum()
            lengths = np.linalg.norm(mean), np.linalg.norm(rare), np.log1p(sizes[at])
            out[at] = np.concatenate([mean, rare, lengths])
        return out


class Network:
    """Two layers with tanh between, fitted by Adam; the epoch that is best on rows kept back counts.

    The same rows set the temperature that divides the margin.
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, cfg: QualityConfig):
        rng = np.random.default_rng(cfg.seed)
        self.middle, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = (x - self.middle) / self.spread
        kept_back = np.arange(len(y)) % 6 == 5
        if not 0 < y[kept_back].sum() < kept_back.sum():
            kept_back = np.ones(len(y), bool)  # too few rows to keep some back
            learn = np.arange(len(y))
        else:
            learn = np.flatnonzero(~kept_back)
        p = [
            rng.normal(size=(x.shape[1], cfg.hidden)) / np.sqrt(x.shape[1]),
            np.zeros(cfg.hidden),
            rng.normal(size=cfg.hidden) / np.sqrt(cfg.hidden),
            np.zeros(1),
        ]
        first, second, turn = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
        best, self.p = np.inf, [a.copy() for a in p]
        for _ in range(cfg.epochs):
            for rows in np.array_split(rng.permutation(learn), max(1, len(learn) // 128)):
                h = np.tanh(x[rows] @ p[0] + p[1])
                error = (sigmoid(h @ p[2] + p[3]) - y[rows]) / len(rows)
                back = error[:, None] * p[2] * (1 - h**2)
                grads = [x[rows].T @ back, back.sum(axis=0), h.T @ error, error.sum(keepdims=True)]
                turn += 1
                for a, g, m, v in zip(p, grads, first, second):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g**2 - v)
                    step = m / (1 - 0.9**turn) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
                    a -= cfg.rate * (step + cfg.decay * a)
            loss = _loss(self._margin(x[kept_back], p), y[kept_back])
            if loss < best:
                best, self.p = loss, [a.copy() for a in p]
        margin = self._margin(x[kept_back], self.p)
        choices = np.exp(np.linspace(np.log(0.2), np.log(5.0), 101))
        self.temperature = float(min(choices, key=lambda t: _loss(margin / t, y[kept_back])))

    @staticmethod
    def _margin(x: np.ndarray, p: list[np.ndarray]) -> np.ndarray:
        return np.tanh(x @ p[0] + p[1]) @ p[2] + p[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self._margin((x - self.middle) / self.spread, self.p) / self.temperature)


def _loss(margin: np.ndarray, y: np.ndarray) -> float:
    return float(np.mean(np.logaddexp(0, margin) - y * margin))


class QualityModel:
    """Scores between 0 and 1; without labels of both kinds, their rate for every text."""

    def __init__(self, vectors: DocumentVectors, x: np.ndarray, y: np.ndarray):
        self.vectors = vectors
        self.rate = float(y.mean()) if len(y) else 0.0
        self.network = Network(x, y, vectors.cfg) if 0 < y.sum() < len(y) else None

    def __call__(self, texts: pa.Array) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.rate)
        out = np.zeros(len(texts))
        for at in range(0, len(texts), 256):
            part = texts[at : at + 256].to_pylist()
            out[at : at + 256] = self.network(self.vectors(part))
        return out


def train(
    docs: DataFrame,
    labels: DataFrame,
    cfg: QualityConfig | None = None,
    may_learn: F.Column | None = None,
    label: str = "quality",
) -> QualityModel:
    """Word vectors of all documents; the network from at most `sample_rows` labelled rows."""
    cfg = cfg or QualityConfig()
    may_learn = F.lit(True) if may_learn is None else may_learn
    vectors = DocumentVectors(context_sums(docs, cfg).toArrow(), cfg)  # at most `buckets` rows
    sample = materialize(
        fitting_sample(docs, labels, label, may_learn, cfg.sample_rows), "quality_sample"
    )

    def measure(batch: pa.RecordBatch) -> Iterator[dict]:
        x = vectors(batch.column(1).to_pylist())
        yield {"doc_id": batch.column(0), "x": x.tolist(), "y": batch.column(2)}

    kind = sample.schema["doc_id"].dataType.simpleString()
    seen = mapped(
        sample.select("doc_id", "text", "y"), f"doc_id {kind}, x array<double>, y int", measure
    ).toArrow()
    seen = seen.sort_by([("doc_id", "ascending")])
    release(sample)
    x = matrix(seen["x"])
    return QualityModel(vectors, x, (seen["y"].to_numpy() > 0).astype(float))


def score_documents(docs: DataFrame, labels: DataFrame, cfg: QualityConfig | None = None) -> DataFrame:
    """doc_id, held_out, score, predicted per row, learning labels where crc32(doc_id) mod 3 is not 1.

    NULL, empty and blank texts have the zero vector and the score that goes with it. Every
    row is kept, repeated ones too; other columns are not looked at. Very long texts are read whole. Where more
    rows are labelled than the sample may hold, ties of its hash go by id. An empty table gives
    no rows; without labels of both kinds every text has their rate, 0 without any.
    """
    model = train(docs, labels, cfg, fold("doc_id", 3) != 1)
    return report(docs, model, fold("doc_id", 3) == 1)
