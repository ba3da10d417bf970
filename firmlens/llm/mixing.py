"""Mixing sources to target weights by hash-threshold histograms.

Each source has a target number of words. A document is taken by its hash key: every
source takes all documents a whole number of times and, once more, those whose key is
at or below a threshold. Sums of words per source and hash bucket give the bucket in
which the running sum crosses the rest of the target; only that bucket is refined, so
documents are filtered by key and never sorted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from firmlens.llm.common import fresh, word_count
from firmlens.sources.sinks import materialize, release

#: Key bits below each level: buckets of 12 bits, then 16 bits, then single keys.
LEVELS = (48, 32, 0)


@dataclass(frozen=True)
class MixConfig:
    """pattern: weights of the sources in code point order, repeating, NULL last.
    share: the mix's words over all words. most: how often a document may be taken."""

    pattern: tuple[int, ...] = (3, 1, 2)
    share: float = 1.5
    most: int = 2


def mix(
    docs: DataFrame,
    cfg: MixConfig | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken.

    A NULL or blank text has size 0 and is never taken; a NULL source is a source of its
    own. The key comes from id and text, where NULL counts as empty text, so a source is also cut
    among rows of one id; only rows that repeat id and text share a key and are taken together.
    A very long text can miss a target by half its size. An empty table gives no rows. Other
    columns are not looked at.
    """
    cfg = cfg or MixConfig()
    sized = _sized(docs, id_column, text_column, source_column)
    limits = _limits(sized, cfg)
    taken = F.expr(f"size * ({TIMES})")
    return (
        sized.join(limits, sized.source.eqNullSafe(limits.of))
        .withColumn("taken", taken)
        .select("doc_id", "source", "size", "source_size", "target", "taken")
    )


def apply_mix(
    docs: DataFrame,
    cfg: MixConfig | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
    source_column: str = "source",
) -> DataFrame:
    """The rows of `docs`, each as often as the mix takes it: not at all, once or more often.

    How often follows from a row's source, id and text, so that rows only meet the table of
    sources. Odd values are treated as in `mix`.
    """
    sized = _sized(docs, id_column, text_column, source_column)
    limits = _limits(sized, cfg or MixConfig())
    limits = limits.select(F.struct("of", "whole", "threshold").alias(fresh(docs, "limit")))
    release(sized)
    limit, key, turn = limits.columns[0], fresh(docs, "key"), fresh(docs, "turn")
    times = f"cast({limit}.whole + IF({key} <= coalesce({limit}.threshold, -1), 1, 0) AS int)"
    met = docs.withColumn(key, row_key(id_column, text_column)).join(
        limits, docs[source_column].eqNullSafe(limits[limit]["of"])
    )
    repeated = met.withColumn(turn, F.explode(F.expr(f"array_repeat(0, {times})")))
    return repeated.select(*docs.columns)


#: How often a document is taken.
TIMES = "whole + IF(key <= coalesce(threshold, -1), 1, 0)"


def row_key(id_column: str, text_column: str) -> F.Column:
    """60 evenly spread bits of an id and a text, as a long."""
    text = F.md5(F.coalesce(F.col(text_column), F.lit("")))
    digest = F.md5(F.concat(text, F.coalesce(F.col(id_column).cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def _sized(docs: DataFrame, id_column: str, text_column: str, source_column: str) -> DataFrame:
    return materialize(
        docs.select(
            F.col(id_column).alias("doc_id"),
            F.col(source_column).alias("source"),
            word_count(text_column).alias("size"),
            row_key(id_column, text_column).alias("key"),
        ),
        "mix_sizes",
    )


def _limits(sized: DataFrame, cfg: MixConfig) -> DataFrame:
    goals = materialize(source_targets(sized, cfg), "mix_targets")
    limits = materialize(thresholds(sized, goals), "mix_thresholds")
    release(goals)
    return limits


def source_targets(sized: DataFrame, cfg: MixConfig) -> DataFrame:
    """Per source: of, source_size, target, whole (full takes) and rest (words of the last one).

    All targets are min(most * size, level * weight) for one level. With the sources in order of
    the level at which they reach their cap, the level that spends the budget follows from
    running sums. The windows here see one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_cap = Window.orderBy("full_at", "place")
    weights = F.array(*(F.lit(float(w)) for w in cfg.pattern))
    weight = F.element_at(weights, (F.col("place") - 1) % len(cfg.pattern) + 1)
    sources = (
        sized.groupBy("source")
        .agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(by_name))
        .withColumn("weight", weight)
        .withColumn("cap", F.lit(float(cfg.most)) * F.col("source_size"))
        .withColumn("full_at", F.col("cap") / F.col("weight"))
    )
    capped = F.sum("cap").over(by_cap) - F.col("cap")
    open_weight = F.sum("weight").over(Window.partitionBy()) - (
        F.sum("weight").over(by_cap) - F.col("weight")
    )
    budget = F.lit(cfg.share) * F.sum("source_size").over(Window.partitionBy())
    levels = sources.withColumn("level", (budget - capped) / open_weight)
    level = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "place", "level"))).over(
        Window.partitionBy()
    )
    return (
        levels.withColumn("level", level["level"])
        .withColumn("target", F.least("cap", F.col("level") * F.col("weight")))
        .withColumn("whole", F.expr("IF(source_size = 0, 0L, floor(target / source_size))"))
        .withColumn("rest", F.expr("target - whole * source_size"))
        .select(F.col("source").alias("of"), "source_size", "target", "whole", "rest")
    )


def thresholds(sized: DataFrame, goals: DataFrame) -> DataFrame:
    """`goals` with the threshold of each source: keys up to it sum to about `rest` words.

    The key at which the running sum passes `rest` is taken too if that comes nearer to it.
    """
    state = goals.selectExpr("of", "rest", "0L AS bucket", "0L AS before")
    above = 60
    for level, shift in enumerate(LEVELS):
        inside = sized.join(
            state, sized.source.eqNullSafe(state.of) & F.expr(f"key >> {above} = bucket")
        )
        sums = inside.groupBy("of", "rest", "before", F.expr(f"key >> {shift} AS b")).agg(
            F.sum("size").alias("words")
        )
        running = F.sum("words").over(Window.partitionBy("of").orderBy("b"))
        crossing = (
            sums.withColumn("upto", F.col("before") + running)
            .where("upto > rest")
            .groupBy("of")
            .agg(F.min(F.struct("b", "rest", "upto", "words")).alias("c"))
            .selectExpr("of", "c.rest", "c.b AS bucket", "c.upto - c.words AS before", "c.upto")
        )
        last, state = state, materialize(crossing, f"mix_level{level}")
        release(last)
        above = shift
    # No key where nothing is left to take, so that blank texts are not taken once more either.
    nearer = F.expr("IF(rest > 0, bucket - IF(upto - rest < rest - before, 0, 1), NULL)")
    found = state.select(F.col("of").alias("_of"), nearer.alias("threshold"))
    return goals.join(found, goals.of.eqNullSafe(found._of), "left").drop("_of")
