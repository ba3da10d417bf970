"""Labelled documents: a bounded, reproducible sample for fitting, and scores for all rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from firmlens.llm.common import fresh


def fitting_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    may_learn: F.Column,
    most: int,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """(doc_id, text, y) of at most `most` labelled rows for which `may_learn` holds.

    The ids with the smallest hashes are taken, so that reruns agree. An id that is labelled more
    than once counts as 1 if any of its labels does. Only the ids (at most `most` rows) are
    broadcast; documents are not moved. Of the rows that repeat an id, the text with the smallest
    hash counts. NULL labels, ids and texts are left out.
    """
    known = labels.select(F.col(id_column).alias("doc_id"), F.col(label).cast("int").alias("y"))
    chosen = (
        known.where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & may_learn)
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    found = texts.where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")
    one = F.min(F.struct(F.xxhash64("text").alias("hash"), "text")).alias("one")
    return found.groupBy("doc_id").agg(one, F.max("y").alias("y")).select("doc_id", "one.text", "y")


def with_scores(
    docs: DataFrame, score: Callable[[pa.Array], np.ndarray], out_column: str, text_column: str = "text"
) -> DataFrame:
    """`docs` with the column `out_column` of scores of its texts; NULL counts as empty."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(score(texts), pa.float64())

    return docs.withColumn(out_column, scored(text_column))


def report(
    docs: DataFrame,
    score: Callable[[pa.Array], np.ndarray],
    held_out: F.Column,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """doc_id, held_out, score and predicted for every row."""
    own = docs.select(id_column, text_column)
    name = fresh(own, "score")
    scored = with_scores(own, score, name, text_column)
    return scored.select(
        F.col(id_column).alias("doc_id"),
        held_out.alias("held_out"),
        F.col(name).alias("score"),
        (F.col(name) >= 0.5).cast("int").alias("predicted"),
    )
