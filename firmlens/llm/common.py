"""Helpers that several operators share: words, keys, row ids, connected components."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from firmlens.sources.sinks import materialize, release

#: A word: what lies between ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    That helps where the folder is on the driver's path only; a cluster has it installed.
    """
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, root])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have yet."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def word_count(text: str) -> F.Column:
    """Words of a text column; NULL has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def fold(id_column: str, folds: int) -> F.Column:
    """crc32 of the id as text, modulo `folds`; a NULL id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % folds


def key_bits(id_column: str) -> F.Column:
    """60 evenly spread bits of an id, as a long."""
    digest = F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("")))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def words(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased; bytes.split() splits at the ASCII blanks only."""
    return text.encode().lower().split() if text else []


def word_hashes(tokens: Iterable[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64)


def mapped(
    df: DataFrame, schema: str, work: Callable[[pa.RecordBatch], Iterator[dict]], rows: int = 512
) -> DataFrame:
    """mapInArrow with `work` yielding column dicts per slice of at most `rows` input rows."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                for columns in work(batch.slice(at, rows)):
                    arrays = [_array(columns[f.name], f.type) for f in arrow]
                    yield pa.RecordBatch.from_arrays(arrays, schema=arrow)

    return df.mapInArrow(run, schema)


def _array(values, kind: pa.DataType) -> pa.Array:
    return values.cast(kind) if isinstance(values, pa.Array) else pa.array(values, type=kind)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of an undirected graph given as (src, dst); component: smallest node.

    Alternates the large-star and small-star steps of Kiveris et al. (SoCC 2014). Every
    step is a minimum per node, which combines map-side, and a join of the edges with it,
    which may be split where one node has a large share of the edges. Rounds are written
    to the shared folder, and the one before is removed. No edges give no rows.
    """
    pairs = edges.where("src <> dst").selectExpr(
        "greatest(src, dst) AS src", "least(src, dst) AS dst"
    )
    state, mark = _stored(pairs.distinct())
    while mark[0]:
        both = state.unionByName(state.selectExpr("dst AS src", "src AS dst"))
        low = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
        large = both.where("dst > src").join(low, "src").selectExpr("dst AS src", "low AS dst")
        large = large.where("src <> dst").distinct()
        low = large.groupBy("src").agg(F.min("dst").alias("low"))
        joined = large.join(low, "src")
        small = joined.selectExpr("dst AS src", "low AS dst").unionByName(
            low.selectExpr("src", "low AS dst")
        )
        before, last = state, mark
        state, mark = _stored(small.where("src <> dst").distinct())
        release(before)
        if mark == last:
            break
    roots = state.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return state.selectExpr("src AS node", "dst AS component").unionByName(roots)


def _stored(edges: DataFrame) -> tuple[DataFrame, tuple]:
    state = materialize(edges, "edges")
    mark = state.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
    return state, tuple(mark)
