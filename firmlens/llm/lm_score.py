"""Language-model scores by a log-bilinear model trained with noise-contrastive estimation.

Exact counts of all tokens come from all training documents. The network predicts the next
token's output: the 65,536 most frequent tokens have one each, and those beyond share hash
classes, inside which the exact counts say how likely a token is. Outputs of neighbouring
frequency form groups: a probability is that of the group times that of the output inside
it, so it is normalised over all words, the unknown ones too, by two short matrix products.
Every task trains on its own documents from one common start, and each vector is averaged
over the tasks by its uses there, as sums that Spark makes. Tokens of a text beyond the most
frequent ones get their counts by a join with the whole table of counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.common import fold, mapped, word_hashes
from firmlens.sources.sinks import materialize

#: Stands for the end of a text among the hashes of words.
END = 0


@dataclass(frozen=True)
class LmConfig:
    """own: most tokens with an output of their own; classes: outputs that the others share.

    head: most frequent tokens whose counts are sent to every task; the counts of all others
    are joined. noise: samples that the tokens of a batch are told apart from.
    """

    own: int = 65_536
    classes: int = 64
    head: int = 65_536
    dims: int = 16
    context: int = 3
    noise: int = 32
    batch: int = 2048
    rate: float = 0.1
    seed: int = 29

    @property
    def outputs(self) -> int:
        return self.own + self.classes


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens as hashes (the end first), each token's place among them, tokens of each text.

    The tokens of a text are its words, A-Z lower-cased, and its end.
    """
    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = split.flatten()
    filled = pc.greater(pc.binary_length(flat), 0)
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False)
    upto = np.concatenate([[0], np.cumsum(filled.to_numpy(zero_copy_only=False))])
    ends = np.cumsum(lengths, dtype=np.int64)
    sizes = upto[ends] - upto[ends - lengths] + 1
    coded = flat.filter(filled).dictionary_encode()
    known = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
    hashes = np.concatenate([[END], word_hashes(known).view(np.int64)])
    place = np.zeros(int(sizes.sum()), np.int64)
    inner = np.ones(len(place), bool)
    inner[np.cumsum(sizes) - 1] = False
    place[inner] = coded.indices.to_numpy().astype(np.int64) + 1
    return hashes, place, sizes


def token_counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """(token, n) over all texts, added up within tasks before anything is sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(parts: list) -> pa.RecordBatch:
            each = [np.concatenate(c) for c in zip(*parts)]
            token, inverse = np.unique(each[0], return_inverse=True)
            n = np.bincount(inverse, each[1]).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(token), pa.array(n)], names=["token", "n"])

        parts, held = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                hashes, place, _ = tokens(batch.slice(at, 512).column(0))
                parts.append((hashes, np.bincount(place, minlength=len(hashes))))
                held += len(hashes)
                if held > 2_000_000:
                    yield counted(parts)
                    parts, held = [], 0
        if parts:
            yield counted(parts)

    each = docs.select(text_column).mapInArrow(run, "token long, n long")
    return each.groupBy("token").agg(F.sum("n").alias("n"))


class Vocabulary:
    """The bounded part of the counts: head tokens, outputs, and totals of the classes."""

    def __init__(self, counts: DataFrame, cfg: LmConfig):
        self.total, self.distinct = counts.agg(
            F.coalesce(F.sum("n"), F.lit(0)), F.count("*")
        ).first()
        head = counts.orderBy(F.desc("n"), "token").limit(cfg.head).toArrow()
        token, n = head["token"].to_numpy(), head["n"].to_numpy()
        own = token[: cfg.own]
        #: Outputs that no token has are left out.
        self.cfg = cfg = replace(cfg, own=len(own))
        order = np.argsort(token)
        self.head, self.head_n = token[order], n[order]
        by_token = np.argsort(own)
        self.own, self.own_output = own[by_token], by_token
        per_class = counts.groupBy(F.pmod("token", F.lit(cfg.classes)).alias("class")).agg(
            F.sum("n").alias("n"), F.count("*").alias("distinct")
        )
        self.class_n, class_distinct = np.zeros(cfg.classes), np.zeros(cfg.classes)
        for r in per_class.collect():
            self.class_n[r["class"]], class_distinct[r["class"]] = r["n"], r["distinct"]
        self.class_n -= np.bincount(own % cfg.classes, n[: cfg.own], cfg.classes)
        class_distinct -= np.bincount(own % cfg.classes, minlength=cfg.classes)
        #: Words of a class and one unknown share its probability.
        self.class_size = self.class_n + 0.5 * (class_distinct + 1)
        seen = np.zeros(cfg.outputs)
        seen[: len(own)] = n[: cfg.own]
        seen[cfg.own :] = self.class_n
        self.prior = (seen + 0.5) / (seen.sum() + 0.5 * cfg.outputs)

    def outputs(self, flat: np.ndarray) -> np.ndarray:
        out = self.cfg.own + flat % self.cfg.classes
        at, found = _found(self.own, flat)
        out[found] = self.own_output[at[found]]
        return out

    def counts(self, flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts of head tokens, and which tokens are in the head."""
        at, found = _found(self.head, flat)
        n = np.zeros(len(flat), np.int64)
        n[found] = self.head_n[at[found]]
        return n, found


def _found(known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(known):
        return np.zeros(len(values), int), np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return at, known[at] == values


def contexts(out: np.ndarray, sizes: np.ndarray, cfg: LmConfig) -> np.ndarray:
    """For each token the outputs before it, nearest first; before a text: the extra output."""
    place = np.arange(len(out)) + cfg.context * np.repeat(np.arange(1, len(sizes) + 1), sizes)
    padded = np.full(len(out) + cfg.context * len(sizes), cfg.outputs)
    padded[place] = out
    return np.stack([padded[place - k] for k in range(1, cfg.context + 1)])


def frequency_groups(prior: np.ndarray, own: int) -> np.ndarray:
    """Group of each output; outputs of tokens come by falling frequency, each class is a group.

    A group takes outputs until the square roots of their shares add up to one. That makes
    the number of groups and the expected size of a token's group, which are the cost of
    normalising, smallest in sum.
    """
    share = prior[:own] / prior.sum()
    group = np.floor(np.cumsum(np.sqrt(share))).astype(np.int64)
    group = np.unique(group, return_inverse=True)[1]
    first = group[-1] + 1 if own else 0
    return np.concatenate([group, first + np.arange(len(prior) - own)])


class LogBilinear:
    """Scores h . Q[w] + b[w] of outputs and h . U[g] + c[g] of their groups.

    h is the sum over places k of C[k] * R[context k]. Both kinds of scores are trained against
    noise, and a probability is that of the group times that of the output in its group.
    """

    def __init__(self, prior: np.ndarray, cfg: LmConfig):
        rng = np.random.default_rng(cfg.seed)
        m, d = cfg.outputs, cfg.dims
        self.cfg = cfg
        prior = prior / prior.sum()
        self.group = frequency_groups(prior, cfg.own)
        self.first = np.searchsorted(self.group, np.arange(self.group[-1] + 2))
        of_group = np.bincount(self.group, prior)
        #: R, Q with b, C and U with c; a row is one vector and its bias.
        self.p = [
            _rows(rng.normal(scale=0.3, size=(m + 1, d)), np.zeros(m + 1)),
            _rows(rng.normal(scale=0.1, size=(m, d)), np.log(prior)),
            _rows(np.full((cfg.context, d), 1 / cfg.context), np.zeros(cfg.context)),
            _rows(rng.normal(scale=0.1, size=(len(of_group), d)), np.log(of_group)),
        ]
        self.noise = {1: _Noise(prior, cfg.noise), 3: _Noise(of_group, cfg.noise)}

    def start_training(self) -> None:
        self.squares = [np.full_like(a, START_SQUARE) for a in self.p]
        self.uses = [np.zeros(len(a), np.int64) for a in self.p]
        #: Rows that a batch touches, and the place of each among them.
        self.mark = np.zeros(max(map(len, self.p)), bool)
        self.slot = np.zeros(len(self.mark), np.int64)

    def hidden(self, context: np.ndarray) -> np.ndarray:
        r, c = self.p[0], self.p[2][:, :-1]
        return sum(r.take(near, axis=0)[:, :-1] * c[k] for k, near in enumerate(context))

    def train(self, context: np.ndarray, target: np.ndarray, rng: np.random.Generator) -> None:
        """One step per batch, by Adagrad on the noise-contrastive loss."""
        if not hasattr(self, "uses"):
            self.start_training()
        order = rng.permutation(len(target))
        context, target = context[:, order], target[order]
        for at in range(0, len(order), self.cfg.batch):
            rows = slice(at, at + self.cfg.batch)
            self._step(context[:, rows], target[rows], rng)

    def _step(self, context, target, rng):
        r, c = self.p[0], self.p[2][:, :-1]
        places, d = self.cfg.context, self.cfg.dims
        near = r.take(context, axis=0)[:, :, :-1]
        h = np.einsum("kij,kj->ij", near, c)
        back, steps = np.zeros_like(h), []
        for k, aim in ((1, target), (3, self.group[target])):
            noise = self.noise[k].draw(rng)
            q, of_noise = self.p[k].take(aim, axis=0), self.p[k][noise]
            log = self.noise[k].log
            # How far each token looks like data rather than noise; the error of that belief.
            data = _sigmoid(np.einsum("ij,ij->i", h, q[:, :d]) + q[:, d] - log[aim]) - 1
            false = _sigmoid(h @ of_noise[:, :d].T + (of_noise[:, d] - log[noise]))
            back += data[:, None] * q[:, :d] + false @ of_noise[:, :d]
            grads = [_rows(data[:, None] * h, data), _rows(false.T @ h, false.sum(axis=0))]
            steps.append((k, np.concatenate([aim, noise]), np.concatenate(grads)))
        of_r = (back[None] * c[:, None, :]).reshape(-1, d)
        steps.append((0, context.ravel(), _rows(of_r, np.zeros(len(of_r)))))
        steps.append((2, np.arange(places), _rows(np.einsum("ij,kij->kj", back, near), np.zeros(places))))
        for k, rows, grads in steps:
            self._moved(k, rows, grads)
        self.uses[2] += len(target) - 1

    def _moved(self, k: int, rows: np.ndarray, grads: np.ndarray) -> None:
        """An Adagrad step of the rows that a batch touches."""
        if len(self.p[k]) <= len(rows):  # a short table as a whole; rows without a gradient stay
            times, inverse, rows = np.bincount(rows, minlength=len(self.p[k])), rows, slice(None)
        else:
            self.mark[rows] = True
            touched = np.flatnonzero(self.mark)
            self.mark[touched] = False
            self.slot[touched] = np.arange(len(touched))
            rows, inverse = touched, self.slot.take(rows)
            times = np.bincount(inverse, minlength=len(rows))
        g = _added(inverse, grads, len(times))
        self.uses[k][rows] += times
        s = g * g
        s += self.squares[k][rows]
        self.squares[k][rows] = s
        np.sqrt(s, out=s)
        g *= np.float32(self.cfg.rate)
        g /= s
        self.p[k][rows] -= g

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log of each target's probability, over all outputs."""
        h = _rows(self.hidden(context), np.ones(len(target)))
        group = self.group[target]
        longest = _longest(h)
        out = _log_share(h, longest, self.p[3], group)
        order = np.argsort(group, kind="stable")
        ends = np.searchsorted(group[order], np.arange(len(self.first)))
        for g in np.flatnonzero((np.diff(ends) > 0) & (np.diff(self.first) > 1)):
            a, b = self.first[g], self.first[g + 1]
            rows = order[ends[g] : ends[g + 1]]
            out[rows] += _log_share(h[rows], longest, self.p[1][a:b], target[rows] - a)
        return out

    def used(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number, values and uses of the rows that training touched, over all parameters."""
        uses = np.concatenate(self.uses)
        rows = np.flatnonzero(uses)
        return rows, np.concatenate(self.p)[rows], uses[rows]

    def load(self, rows: np.ndarray, values: np.ndarray) -> None:
        """Put values in the place of these rows; the others stay as they started."""
        whole = np.concatenate(self.p)
        whole[rows] = values
        self.p = np.split(whole, np.cumsum([len(a) for a in self.p])[:-1])


#: Sum of squared gradients that Adagrad starts from.
START_SQUARE = 1.0


class _Noise:
    """Outputs drawn by their prior, and the log of their expected number."""

    def __init__(self, prior: np.ndarray, size: int):
        self.size = size
        self.log = np.log(size * prior).astype(np.float32)
        self.cdf = np.cumsum(prior)

    def draw(self, rng: np.random.Generator) -> np.ndarray:
        at = np.searchsorted(self.cdf, rng.random(self.size) * self.cdf[-1])
        return np.minimum(at, len(self.cdf) - 1)


def _rows(vectors: np.ndarray, bias: np.ndarray) -> np.ndarray:
    return np.concatenate([vectors, bias[:, None]], axis=1).astype(np.float32)


#: Scores that are computed at a time, so that they stay in a core's cache.
SCORES = 131_072
#: Scores are kept within this, so that their exponentials stay finite.
LIMIT = 60


def _longest(rows: np.ndarray) -> float:
    """Largest Euclidean length of a row."""
    return float(np.sqrt(np.einsum("ij,ij->i", rows, rows).max(initial=0)))


def _log_share(h: np.ndarray, longest: float, q: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Log of the chosen row of q's share of the exponentials of each row of h Q'.

    `longest`: no row of h is longer. No score is above the product of the lengths, so that
    few need the limit.
    """
    within = longest * _longest(q) < LIMIT
    out, q, ones = np.empty(len(h)), np.ascontiguousarray(q.T), np.ones(len(q), np.float32)
    step = max(16, SCORES // q.shape[1])
    for at in range(0, len(h), step):
        score = h[at : at + step] @ q
        if not within:
            np.clip(score, -LIMIT, LIMIT, out=score)
        out[at : at + step] = score[np.arange(len(score)), chosen[at : at + step]]
        np.exp(score, out=score)
        out[at : at + step] -= np.log(score @ ones)
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x = np.clip(x, -30, 30)
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def _added(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sum of the values of each row number."""
    d = values.shape[1]
    cell = rows[:, None] * d + np.arange(d)
    return np.bincount(cell.ravel(), values.ravel(), n * d).reshape(n, d).astype(np.float32)


def train(docs: DataFrame, vocabulary: Vocabulary, text_column: str = "text") -> LogBilinear:
    """Every task makes one pass over its texts; vectors are averaged by their uses in the tasks.

    A task sends the vectors that it used, at most one row each. So a rare token's vector is that
    of the tasks that saw it, however many others there are.
    """
    cfg, prior = vocabulary.cfg, vocabulary.prior
    names = [f"v{k}" for k in range(cfg.dims + 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rng = LogBilinear(prior, cfg), np.random.default_rng(cfg.seed)
        model.start_training()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                hashes, place, sizes = tokens(batch.slice(at, 512).column(0))
                out = vocabulary.outputs(hashes)[place]
                model.train(contexts(out, sizes, cfg), out, rng)
        rows, values, uses = model.used()
        for at in range(0, len(rows), 8192):
            own = slice(at, at + 8192)
            sums = values[own].astype(float) * uses[own, None]
            columns = [rows[own], uses[own], *sums.T.copy()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in columns], names=["place", "weight", *names]
            )

    schema = ", ".join(["place long", "weight long", *(f"{v} double" for v in names)])
    parts = docs.select(text_column).mapInArrow(run, schema)
    mean = parts.groupBy("place").agg(*((F.sum(v) / F.sum("weight")).alias(v) for v in names))
    model = LogBilinear(prior, cfg)
    learned = mean.toArrow()  # one row per vector
    if learned.num_rows:
        values = np.stack([learned[v].to_numpy() for v in names], axis=1)
        model.load(learned["place"].to_numpy(), values.astype(np.float32))
    return model


def score(
    docs: DataFrame,
    learn: F.Column,
    cfg: LmConfig | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    `learn` says which rows train. Scores are log10 probabilities of the whole text and its end:
    base_score of the smoothed unigram counts, score of the model. NULL and empty texts are
    just the end. Without any training row every token has the same probability under the
    counts. Every row is kept, repeated ones too; an empty table gives no rows. Very long texts
    are scored whole. Among tokens of one count the smaller hash is the more frequent, so that a
    tie at the last output of its own is settled. Other columns are not looked at.
    """
    cfg = cfg or LmConfig()
    rows = docs.select(
        F.col(id_column).alias("doc_id"), learn.alias("learn"), F.col(text_column).alias("text")
    )
    training = rows.where("learn").select("text")
    counts = materialize(token_counts(training), "token_counts")
    vocabulary = Vocabulary(counts, cfg)
    cfg = vocabulary.cfg
    model = train(training, vocabulary)
    all_size = np.log10(vocabulary.total + 0.5 * (vocabulary.distinct + 1))
    class_size = np.log10(vocabulary.class_size)

    def work(batch: pa.RecordBatch) -> Iterator[dict]:
        hashes, place, sizes = tokens(batch.column(2))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        out = vocabulary.outputs(hashes)[place]
        n, in_head = vocabulary.counts(hashes)
        of_count = np.where(in_head, np.log10(n + 0.5), 0.0)[place]
        n, in_head = n[place], in_head[place]
        likely = model.log_probability(contexts(out, sizes, cfg), out) / np.log(10)
        shared = out >= cfg.own  # of the others, the class alone says nothing about the word
        likely[shared] += of_count[shared] - class_size[out[shared] - cfg.own]
        size = len(sizes)
        tail = np.flatnonzero(~in_head)
        ends = np.searchsorted(doc[tail], np.arange(size + 1))
        yield {
            "doc_id": batch.column(0),
            "held_out": [not x for x in batch.column(1).to_pylist()],
            "n_tokens": sizes,
            "n_known": np.bincount(doc, (n > 0), size).astype(np.int64),
            "base": np.bincount(doc, of_count, size) - sizes * all_size,
            "model": np.bincount(doc, likely, size),
            "tail": pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(hashes[place[tail]])),
        }

    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = (
        f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base double, model double, "
        "tail array<long>"
    )
    scored = mapped(rows, schema, work).withColumn("row", F.monotonically_increasing_id())
    scored = materialize(scored, "lm_scored")
    return _with_tail(scored, counts, vocabulary.total)


def _with_tail(scored: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """Add what the counts of tokens beyond the head are worth to both scores."""
    uses = scored.select("row", F.explode("tail").alias("token"))
    uses = uses.groupBy("row", "token").agg(F.count("*").alias("times"))
    known = uses.join(counts, "token", "left")
    per_row = known.groupBy("row").agg(
        F.expr("sum(IF(n > 0, times, 0L))").alias("more_known"),
        F.expr("sum(times * log10(coalesce(n, 0L) + 0.5D))").alias("more"),
    )
    return scored.join(per_row, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("model") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )


def score_documents(docs: DataFrame, cfg: LmConfig | None = None) -> DataFrame:
    """Scores of all documents, learning from those whose crc32(doc_id) mod 5 is not 1."""
    return score(docs, fold("doc_id", 5) != 1, cfg)
